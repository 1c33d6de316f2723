"""The library's formulas as functions of SQL, for queries written as text."""

from __future__ import annotations

from pyspark.sql import SparkSession

_SPANS = "s1 DOUBLE, e1 DOUBLE, s2 DOUBLE, e2 DOUBLE"
_BOXES = ", ".join(f"{b}_{c} DOUBLE" for b in "ab" for c in ("x1", "y1", "x2", "y2"))
_AREA = "greatest(1.0D, ({0}_x2 - {0}_x1) * ({0}_y2 - {0}_y1))"
FUNCTIONS = {
    "span_overlap": (_SPANS, "DOUBLE", "greatest(0.0D, least(e1, e2) - greatest(s1, s2))"),
    "tiou": (_SPANS, "DOUBLE", "CASE WHEN (e1 - s1) + (e2 - s2) - span_overlap(s1, e1, s2, e2) > 0 THEN span_overlap(s1, e1, s2, e2) / ((e1 - s1) + (e2 - s2) - span_overlap(s1, e1, s2, e2)) ELSE 0.0D END"),
    "box_overlap": (_BOXES, "DOUBLE", f"span_overlap(a_x1, a_x2, b_x1, b_x2) * span_overlap(a_y1, a_y2, b_y1, b_y2) / least({_AREA.format('a')}, {_AREA.format('b')})"),
    "line_side": ("x DOUBLE, y DOUBLE, ax DOUBLE, ay DOUBLE, bx DOUBLE, by DOUBLE", "DOUBLE", "signum((bx - ax) * (y - ay) - (by - ay) * (x - ax))"),
}


def register(spark: SparkSession) -> None:
    """Make the functions known to a session: tiou of two intervals, the share of the smaller box that two have in common, the side
    of a line on which a point lies, and the length that two intervals share. They are columns, not Python: SQL bodies are inlined."""
    for name, (arguments, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
