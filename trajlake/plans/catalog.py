"""Every query of the library by name, with the SQL that states its result."""

from __future__ import annotations

from trajlake.plans import (
    catalog_evaluation,
    catalog_features,
    catalog_labels,
    catalog_leads,
    catalog_places,
    catalog_reviews,
    catalog_risk,
    catalog_rules,
    catalog_signals,
    catalog_streaming,
    catalog_tracks,
)

QUERIES: dict = {
    **catalog_features.QUERIES,
    **catalog_rules.QUERIES,
    **catalog_signals.QUERIES,
    **catalog_tracks.QUERIES,
    **catalog_labels.QUERIES,
    **catalog_leads.QUERIES,
    **catalog_reviews.QUERIES,
    **catalog_risk.QUERIES,
    **catalog_evaluation.QUERIES,
    **catalog_streaming.QUERIES,
    **catalog_places.QUERIES,
}
