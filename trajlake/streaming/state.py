"""Operators of a live feed that keep state: features, risk, signal changes, alarms and sessions.

All but the stream join are Ordered or Chunked: rows may come out of order within the watermark's delay (late), and what is told is what
the operator of the same name tells of the whole table, however the feed falls into batches. State is small: a few rows for each
track or video, besides those that wait for the watermark.
"""

from __future__ import annotations

import math
import pickle
from collections import namedtuple
from collections.abc import Generator, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from trajlake.functions import geometry as geo
from trajlake.operators.risk import RiskConfig
from trajlake.plans.features import VEHICLES, body_axis, membership, stop_line, to_scene
from trajlake.sources.scene import Scene
from trajlake.streaming.ordered import HOUR, Chunked, Ordered, in_chunks, in_order, joined, picked

CHANGES = "video_id long, t double, state string"
ALARMS = "video_id long, t double"
SCORES = "video_id long, frame long, t double, score double"


class Changes(Ordered):
    """Samples at which the state is another than before."""

    def start(self, handle) -> None:
        self.known = handle.getValueState("known", "state string")

    def step(self, key, rows, now, ended) -> Iterator[Row]:
        first = not self.known.exists()
        known = None if first else self.known.get()[0]
        for r in rows:
            if first or r.state != known:
                yield Row(video_id=key[0], t=r.t, state=r.state)
            first, known = False, r.state
        if rows:
            self.known.update((known,))

    def clear(self) -> None:
        self.known.clear()


def change_points(samples: DataFrame, late: str = "10 seconds", silence: int = HOUR) -> DataFrame:
    """samples (video_id, t, state, ts) at which the state is another than before, and each video's first."""
    return in_order(samples.select("video_id", "t", "state", "ts"), ["video_id"], Changes, CHANGES, late, silence=silence)


class Alarms(Ordered):
    """Where runs of high samples begin that lie max_gap or more behind the last high one."""

    def __init__(self, schema: StructType, silence: int, threshold: float, max_gap: float) -> None:
        super().__init__(schema, silence)
        self.threshold, self.max_gap = threshold, max_gap

    def start(self, handle) -> None:
        self.last = handle.getValueState("last", "high boolean, hit double")

    def step(self, key, rows, now, ended) -> Iterator[Row]:
        high, hit = self.last.get() if self.last.exists() else (False, -math.inf)
        for r in rows:
            before, high = high, r.score is not None and r.score >= self.threshold
            if high and not before and r.t - hit >= self.max_gap:
                yield Row(video_id=key[0], t=r.t)
            hit = r.t if high else hit
        if rows:
            self.last.update((high, hit))

    def clear(self) -> None:
        self.last.clear()


def alarms(curve: DataFrame, threshold: float = 0.5, max_gap: float = 2.0, late: str = "10 seconds", silence: int = HOUR) -> DataFrame:
    """Where alarms begin (video_id, t) in a curve (video_id, t, score, ts).

    An alarm is an unbroken run of samples at the threshold or above, or several less than max_gap apart.
    """
    return in_order(curve.select("video_id", "t", "score", "ts"), ["video_id"], Alarms, ALARMS, late, threshold, max_gap, silence=silence)


class Sessions(Ordered):
    """Unions of intervals less than gap apart: told when the watermark is a gap behind their end."""

    order = ("start", "end")

    def __init__(self, schema: StructType, silence: int, keys: list[str], gap: float) -> None:
        super().__init__(schema, silence)
        self.keys, self.gap = keys, gap

    def start(self, handle) -> None:
        self.open = handle.getValueState("open", "start double, end double, n long, until long")

    def step(self, key, rows, now, ended) -> Iterator[Row]:
        held = self.open.get() if self.open.exists() else None
        made = Row(*self.keys, "start", "end", "n")
        told = lambda: made(*key, *held[:3])
        for r in rows:
            until = r.at + math.ceil((r.end - r.start + self.gap) * 1000)
            if held and r.start - held[1] < self.gap:
                held = (held[0], max(held[1], r.end), held[2] + 1, max(held[3], until))
                continue
            if held:
                yield told()
            held = (r.start, r.end, 1, until)
        if held and now >= held[3]:
            yield told()
            held = None
        if held:
            self.open.update(held)
            self.handle.registerTimer(held[3])
        elif self.open.exists():
            self.open.clear()

    def clear(self) -> None:
        self.open.clear()


def sessions_of(spans: DataFrame, keys: list[str], gap: float, late: str = "10 seconds", silence: int = HOUR) -> DataFrame:
    """keys, start, end and n of the unions of intervals (keys, start, end, ts of the start) that lie less than gap apart.

    Intervals just the gap apart stay apart. The time of silence must be longer than an interval and the gap.
    """
    kinds = dict(spans.dtypes)
    out = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "start double, end double, n long"])
    rows = spans.select(*keys, F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), "ts").filter("end > start OR ts IS NULL OR start IS NULL")
    return in_order(rows, keys, Sessions, out, late, keys, gap, silence=silence)


class Motion(Chunked):
    """The rows of a video's tracks with speed and heading, each when two more have come, the last two when the track ends.

    Kept are each track's rows not told yet and two before them: a speed is the median of three differences of neighbours.
    """

    order = ("t", "frame")

    def start(self, handle) -> None:
        self.held = handle.getValueState("held", "rows binary")

    def _differences(self, rows: dict, before: np.ndarray, after: np.ndarray, alone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Speed and heading at each row from the rows beside it; what is null, not a number or infinite counts as no motion."""
        step = {}
        for c in ("cx", "cy", "t"):
            x, null = rows[c].astype(float), self.is_null(rows, c)
            x = np.where(null, np.nan, x)
            a, b = (np.where(null[k], x, x[k]) for k in (before, after))
            step[c] = b - a
        with np.errstate(all="ignore"):
            raw = np.sqrt(step["cx"] * step["cx"] + step["cy"] * step["cy"]) / np.where(alone, 0.1, np.maximum(step["t"], 1e-3))
            turn = np.arctan2(step["cy"], step["cx"])
        return np.where(np.isfinite(raw), raw, 0.0), np.where(np.isfinite(turn), turn, 0.0)

    def step(self, key, due, left, now) -> Generator[pd.DataFrame, None, int | None]:
        known = self.held.get()
        due["told"] = np.zeros(len(due["at"]), bool)
        rows = joined([pickle.loads(known[0]), due]) if known else due
        if not len(rows["at"]):
            return None
        waits = set(zip(left["id"].tolist(), self.is_null(left, "id").tolist(), strict=True))
        rows = picked(rows, np.lexsort((self.is_null(rows, "id"), rows["id"])))
        null, name, at = self.is_null(rows, "id"), rows["id"], rows["at"]
        n = len(name)
        first = np.flatnonzero(np.concatenate([[True], (name[1:] != name[:-1]) | (null[1:] != null[:-1])]))
        size = np.diff(np.append(first, n))
        seen = at[first + size - 1]
        quiet = np.array([k not in waits for k in zip(name[first].tolist(), null[first].tolist(), strict=True)])
        ended = quiet & (seen + self.silence <= now)
        place, length = np.arange(n) - np.repeat(first, size), np.repeat(size, size)
        before, after = np.arange(n) - (place > 0), np.arange(n) + (place < length - 1)
        speed, heading = self._differences(rows, before, after, length == 1)
        middle = np.median(np.stack([speed[before], speed, speed[after]]), axis=0)
        # At an end two differences count, not three.
        middle = np.where(before == np.arange(n), (speed + speed[after]) / 2, np.where(after == np.arange(n), (speed[before] + speed) / 2, middle))
        tell = ~rows["told"] & (np.repeat(ended, size) | (place < length - 2))
        if tell.any():
            made = {c: rows[c][tell] for c in rows if c not in ("at", "told")}
            yield pd.DataFrame({"video_id": key[0], **made, "speed": middle[tell], "heading_rad": heading[tell]})
        upto = np.add.reduceat((rows["told"] | tell).astype(int), first)
        keep = ~np.repeat(ended, size) & (place >= np.repeat(upto, size) - 2)
        if not keep.any():
            self.held.clear()
            return None
        rows["told"] = rows["told"] | tell
        self.held.update((pickle.dumps(picked(rows, keep)),))
        silent = seen[quiet & ~ended]
        return int(silent.min()) + self.silence if len(silent) else None


def stream_features(tracks: DataFrame, scene: Scene, source_size: tuple[int, int], late: str = "10 seconds", silence: int = HOUR) -> DataFrame:
    """What extract_features gives of tracks with ts: motion by state, then positions and shapes by columns, so that state holds
    only what a track brings and its middle.

    The time of silence must be longer than a track's longest gap: after it a track is a new one.
    """
    rows = to_scene(tracks, scene, source_size).select(*tracks.columns, "cx", "cy")
    kept = [f for f in rows.schema if f.name not in ("video_id", "ts")]
    out = StructType([rows.schema["video_id"], StructField("nulls", LongType()), *kept, StructField("speed", DoubleType()), StructField("heading_rad", DoubleType())])
    moved = in_chunks(rows, ["video_id"], Motion, out, late, silence=silence).drop("cx", "cy")
    found = stop_line(body_axis(membership(to_scene(moved, scene, source_size), scene), scene), scene)
    return found.select("video_id", "id", *(c for c in found.columns if c not in ("video_id", "id", "speed", "heading_rad")), "speed", "heading_rad")


class Risk(Chunked):
    """Scores a video's frames from its tracks' last three samples and its signal, and fades the score in between.

    Tracks are kept in map state until the video ends, those that brake in another map, which each frame reads as a whole: a
    track that vanished while it braked counts until it is seen again.
    """

    order = ("t", "kind", "frame", "id")

    def __init__(self, columns: list[str], bits: dict[str, int], silence: int, config: RiskConfig, along: tuple[float, float]) -> None:
        super().__init__(columns, bits, silence)
        self.config, self.along = config, along

    def start(self, handle) -> None:
        self.tracks = handle.getMapState("tracks", "id long", "t double, x double, y double, v double")
        self.braking = handle.getMapState("braking", "id long", "risk double")
        self.last = handle.getValueState("last", "state string, at double, score double, seen long")

    def _rows(self, due: dict) -> list[tuple]:
        """The rows as tuples by name, with their nulls again."""
        names = [c for c in self.columns if c not in ("video_id", "ts", "nulls")]
        values = []
        for c in names:
            x, null = due[c].tolist(), self.is_null(due, c) if c in self.bits else None
            values.append([None if gone else v for v, gone in zip(x, null.tolist(), strict=True)] if null is not None and null.any() else x)
        return list(map(namedtuple("Seen", names)._make, zip(*values, strict=True)))

    def _moved(self, r: Row, known: dict, brakes: dict) -> tuple[float, float]:
        """The velocity of a track at a row; notes whether it brakes."""
        c = self.config
        x, y = (math.nan if v is None else v for v in (r.x, r.y))
        if r.id not in known:
            known[r.id] = self.tracks.getValue((r.id,)) if self.tracks.containsKey((r.id,)) else None
        before, velocity, v = known[r.id], (0.0, 0.0), None
        brakes.pop(r.id, None)
        if before:
            t, px, py, earlier = before
            velocity = tuple((a - b) / max(1e-3, r.t - t) for a, b in ((x, px), (y, py)))
            dt = max(0.1, r.t - t)
            v = math.hypot(x - px, y - py) / dt
            if earlier is not None and earlier >= c.braking_speed and (earlier - v) / dt >= c.braking_from:
                brakes[r.id] = min(c.braking_most, c.braking_least + ((earlier - v) / dt - c.braking_from) / 100)
        known[r.id] = (r.t, x, y, v)
        return velocity

    def _collision(self, rows: list[Row], velocities: list[tuple[float, float]]) -> float:
        """The highest risk of two moving objects of a frame, not both persons."""
        c, n = self.config, len(rows)
        if n < 2:
            return 0.0
        at, v = np.array([(r.x, r.y) for r in rows], float), np.array(velocities)
        radius, person = np.array([r.radius for r in rows], float), np.array([r.cls == 0 for r in rows])
        i, j = np.triu_indices(n, 1)
        d, dv = at[j] - at[i], v[j] - v[i]
        closing = np.sum(dv * dv, axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            after = -np.sum(d * dv, axis=1) / closing
            gap = np.hypot(*(d + dv * after[:, None]).T) - radius[i] - radius[j]
            fits = ~(person[i] & person[j]) & (closing >= 1e-5) & (after > 0) & (after <= c.horizon) & (gap <= c.clearance)
        if not fits.any():
            return 0.0
        close = 1 / (1 + np.exp(np.clip((gap[fits] - 4.0) / 5.0, -40.0, 40.0)))
        return float(np.max(close * np.exp(-after[fits] / 4.0) * c.collision_most))

    def _violation(self, rows: list[Row], velocities: list[tuple[float, float]]) -> float:
        best = 0.0
        for r, v in zip(rows, velocities, strict=True):
            if r.cls != 0 and r.in_junction:
                best = max(best, self.config.on_red)
            elif r.cls != 0 and r.approaches and (v[0] * self.along[0] + v[1] * self.along[1]) / max(math.hypot(*v), 1e-6) < -0.6:
                best = max(best, self.config.wrong_way)
        return best

    def step(self, key, due, left, now) -> Generator[pd.DataFrame, None, int | None]:
        last = self.last.get()
        state, at, score, seen = last or ("?", None, 0.0, None)
        rows, told = self._rows(due), []
        if rows:
            seen = rows[-1].at
            state, at, score = self._scored(rows, state, at, score, told)
            self.last.update((state, at, score, seen))
        if told:
            yield pd.DataFrame(told, columns=["frame", "t", "score"]).assign(video_id=key[0])[["video_id", "frame", "t", "score"]]
        if not len(left["at"]) and seen is not None and now >= seen + self.silence:
            for s in (self.tracks, self.braking, self.last):
                s.clear()
            return None
        return None if seen is None else seen + self.silence

    def _scored(self, rows: list[tuple], state: str, at: float | None, score: float, told: list) -> tuple[str, float | None, float]:
        """State, time and score after the rows; adds to told the samples (frame, t, score)."""
        known: dict = {}
        brakes = {k[0]: v[0] for k, v in self.braking.iterator()} if self.braking.exists() else {}
        held = dict(brakes)
        for (t,), group in groupby(rows, key=lambda r: (r.t,)):
            group = list(group)
            ticks, seen = [r for r in group if r.kind == 0], [r for r in group if r.kind == 1]
            state = ticks[-1].state if ticks else state
            if seen:
                objects = [r for r in seen if r.counts]
                velocities = [self._moved(r, known, brakes) for r in objects]
                fast = [k for k, v in enumerate(velocities) if math.hypot(*v) >= self.config.moving]
                moving, speeds = [objects[k] for k in fast], [velocities[k] for k in fast]
                rule = self._violation(moving, speeds) if state == "R" else 0.0
                at, score = t, max(0.0, min(1.0, max(self._collision(moving, speeds), rule, *brakes.values(), 0.0)))
            for r in ticks:
                told.append((r.frame, t, 0.0 if at is None else score * math.exp(-(t - at) / self.config.fade)))
        for k, v in known.items():
            self.tracks.updateValue((k,), v)
        for k in held.keys() - brakes.keys():
            self.braking.removeKey((k,))
        for k, v in brakes.items():
            if held.get(k) != v:
                self.braking.updateValue((k,), (v,))
        return state, at, score


def stream_risk(tracks: DataFrame, signals: DataFrame, scene: Scene, source_size: tuple[int, int], config: RiskConfig = RiskConfig(), late: str = "10 seconds", silence: int = HOUR) -> DataFrame:
    """The risk (video_id, frame, t, score) at each signal sample (video_id, frame, t, state, ts), from raw tracks with ts.

    What risk_curve gives of the samples' scores: all that comes up to a sample counts, and nothing later.
    """
    rows = to_scene(tracks, scene, source_size)
    wide, high = (F.col("x2") - F.col("x1")) * F.col("scale_x"), (F.col("y2") - F.col("y1")) * F.col("scale_y")
    inside = lambda shape: F.coalesce(geo.inside(F.col("cx"), F.col("foot_y"), shape), F.lit(False))
    seen = rows.select(
        "video_id", F.lit(1).alias("kind"), "frame", "t", "id", "cls", F.col("cx").alias("x"), F.col("foot_y").alias("y"),
        F.greatest(F.lit(6.0), F.hypot(wide, high) * 0.25).alias("radius"), ((F.col("cls") == 0) | F.col("cls").isin(*VEHICLES)).alias("counts"),
        inside(scene.junction).alias("in_junction"), inside(scene.carriageways["near"]).alias("approaches"), F.lit(None).cast("string").alias("state"), "ts",
    )
    ticks = signals.select("video_id", F.lit(0).alias("kind"), "frame", "t", F.lit(0).cast("long").alias("id"), "state", "ts")
    both = seen.unionByName(ticks, allowMissingColumns=True)
    return in_chunks(both, ["video_id"], Risk, SCORES, late, config, tuple(scene.directions["near"]), silence=silence)


def signals_near(points: DataFrame, samples: DataFrame, reach: float = 0.18, late: str = "10 seconds") -> DataFrame:
    """Pairs of points (video_id, id, t, ts) and signal samples (video_id, t, state, ts) at most reach seconds apart.

    Both are streams; each row is kept until no row within reach of it can come.
    """
    p = points.withWatermark("ts", late).select("video_id", "id", "t", F.col("ts"))
    s = samples.withWatermark("ts", late).select(F.col("video_id").alias("s_video"), F.col("t").alias("s_t"), "state", F.col("ts").alias("s_ts"))
    span = f"INTERVAL {reach} SECONDS"
    near = F.expr(f"s_video = video_id AND s_ts >= ts - {span} AND s_ts <= ts + {span}")
    return p.join(s, near).select("video_id", "id", "t", "s_t", "state")
