"""The scene map: named shapes in groups, as Python values for literal geometry and as a small table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

Points = list[tuple[float, float]]


@dataclass(frozen=True)
class Scene:
    """Shapes by group and name, in declared order; membership goes to the first shape that matches."""

    size: tuple[int, int]
    carriageways: dict[str, Points]
    directions: dict[str, tuple[float, float]]
    lanes: dict[str, Points]
    crosswalks: dict[str, Points]
    queue: Points
    junction: Points
    islands: dict[str, Points]
    stop_line: Points
    solid_lines: dict[str, Points]
    dashed_lines: dict[str, Points] = field(default_factory=dict)

    def groups(self) -> dict[str, dict[str, Points]]:
        return {
            "carriageways": self.carriageways, "lanes": self.lanes, "crosswalks": self.crosswalks,
            "zones": {"queue": self.queue, "junction": self.junction}, "islands": self.islands,
            "stop_lines": {"near": self.stop_line}, "solid_lines": self.solid_lines, "dashed_lines": self.dashed_lines,
        }

    def table(self, spark: SparkSession) -> DataFrame:
        """grp, ord, name and pts, one row a shape."""
        rows = [(g, i, name, [{"x": x, "y": y} for x, y in pts]) for g, shapes in self.groups().items() for i, (name, pts) in enumerate(shapes.items())]
        return spark.createDataFrame(rows, "grp string, ord int, name string, pts array<struct<x:double,y:double>>")


#: Along the road (u) and across it (w): x = 200 + .96 u - .28 w, y = 300 + .28 u + .96 w.
ALONG, ACROSS, ORIGIN = (0.96, 0.28), (-0.28, 0.96), (200.0, 300.0)


def place(u: float, w: float) -> tuple[float, float]:
    return tuple(round(o + a * u + c * w, 3) for o, a, c in zip(ORIGIN, ALONG, ACROSS, strict=True))


def _box(u0: float, u1: float, w0: float, w1: float) -> Points:
    return [place(u0, w0), place(u1, w0), place(u1, w1), place(u0, w1)]


def crossroads() -> Scene:
    """A straight road of two carriageways with a stop line, a queue zone before and a junction behind it."""
    return Scene(
        size=(1920, 1080),
        carriageways={"near": _box(0, 1000, 0, 200), "far": _box(0, 1000, -200, 0)},
        directions={"near": ALONG, "far": (-ALONG[0], -ALONG[1])},
        lanes={name: _box(0, 600, 40 * i, 40 * i + 40) for i, name in enumerate(["near_curb", "near_through_1", "near_through_2", "near_through_3", "near_through_4"])},
        crosswalks={"A": _box(640, 700, -20, 220), "B": _box(900, 950, -220, 220), "C": _box(200, 240, -220, -20)},
        queue=_box(300, 600, 0, 200),
        junction=_box(620, 1000, -220, 220),
        islands={"island_1": _box(720, 760, 90, 110)},
        stop_line=[place(600, 0), place(600, 80), place(600, 200)],
        solid_lines={"lane_edge": [place(480, 160), place(540, 160), place(600, 160)]},
        dashed_lines={f"far_lane_{i}": [place(0, -50 * i), place(500, -50 * i), place(1000, -50 * i)] for i in (1, 2, 3)},
    )
