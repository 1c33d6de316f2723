"""Membership of points in shapes of many cameras' scenes: a table of shapes, indexed by a grid of cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlake.sources.scene import Scene

SHAPES = "camera long, grp string, ord int, name string, margin double, pts array<struct<x:double,y:double>>"


def shapes_of(spark: SparkSession, scenes: dict[int, Scene], margins: dict[str, float]) -> DataFrame:
    """SHAPES of several cameras' scenes, of the groups that margins names: how far beyond its outline a shape of each reaches."""
    rows = [(camera, g, i, name, margins[g], [{"x": x, "y": y} for x, y in pts]) for camera, scene in scenes.items() for g, shapes in scene.groups().items() if g in margins for i, (name, pts) in enumerate(shapes.items())]
    return spark.createDataFrame(rows, SHAPES)


def grid(shapes: DataFrame, width: float = 64.0) -> DataFrame:
    """camera, cx, cy and shapes: for each cell of the grid that the box of any shape touches, those shapes, in declared order.

    Shapes of less than three points hold nothing and are left out.
    """
    before = F.concat(F.slice("pts", -1, 1), F.slice("pts", F.lit(1), F.size("pts") - 1))
    edges = F.zip_with(before, "pts", lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))
    span = lambda c: F.sequence(F.floor((F.array_min(F.col("pts")[c]) - F.col("margin")) / width), F.floor((F.array_max(F.col("pts")[c]) + F.col("margin")) / width))
    whole = shapes.filter(F.size("pts") >= 3).select("camera", F.struct("grp", "ord", "name", "margin", edges.alias("edges")).alias("shape"), span("x").alias("xs"), span("y").alias("ys"))
    cells = whole.select("camera", "shape", "ys", F.explode("xs").alias("cx")).select("camera", "shape", "cx", F.explode("ys").alias("cy"))
    return cells.groupBy("camera", "cx", "cy").agg(F.array_sort(F.collect_list("shape")).alias("shapes"))


def _holds(shape: Column, x: Column, y: Column) -> Column:
    """Even-odd, or with a margin also at most that far from the outline."""

    def crosses(e):
        return ((e["ay"] > y) != (e["by"] > y)) & (x < (e["bx"] - e["ax"]) * (y - e["ay"]) / (e["by"] - e["ay"] + F.lit(1e-12)) + e["ax"])

    def close(e):
        dx, dy = e["bx"] - e["ax"], e["by"] - e["ay"]
        square = dx * dx + dy * dy
        u = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - e["ax"]) * dx + (y - e["ay"]) * dy) / F.when(square > 0, square).otherwise(1.0)))
        qx, qy = e["ax"] + u * dx, e["ay"] + u * dy
        return (x - qx) * (x - qx) + (y - qy) * (y - qy) <= shape["margin"] * shape["margin"]

    odd = F.size(F.filter(shape["edges"], crosses)) % 2 == 1
    return odd | ((shape["margin"] > 0) & F.exists(shape["edges"], close))


def assign(points: DataFrame, cells: DataFrame, names: dict[str, str], width: float = 64.0, x: str = "x", y: str = "y") -> DataFrame:
    """points (camera, x, y and others) with, for each column of names, the first shape of its group that holds the point, or null.

    A point meets the shapes of its cell alone, in one join by camera and cell; width must be the grid's. A camera without a scene,
    or a point without coordinates, has no shapes.
    """
    at = points.withColumns({"__cx": F.floor(F.col(x) / width), "__cy": F.floor(F.col(y) / width)})
    c = cells.select(F.col("camera").alias("__camera"), F.col("cx").alias("__x"), F.col("cy").alias("__y"), F.col("shapes").alias("__shapes"))
    both = at.join(c, (F.col("camera") == F.col("__camera")) & (F.col("__cx") == F.col("__x")) & (F.col("__cy") == F.col("__y")), "left")
    first = lambda g: F.get(F.filter("__shapes", lambda s: (s["grp"] == g) & _holds(s, F.col(x), F.col(y))), F.lit(0))["name"]
    return both.withColumns({column: first(g) for column, g in names.items()}).drop("__cx", "__cy", "__camera", "__x", "__y", "__shapes")
