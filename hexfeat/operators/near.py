"""Exact nearest neighbours: by rings of squares that grow until no unseen neighbour can be nearer, or by squares that are split where the nearest may lie."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored

#: Growth of a square's side from one round to the next.
GROWTH = 4.0
#: Nodes of a square that isn't split.
LEAF = 32


def nearest(asked: DataFrame, nodes: DataFrame, ident: list[str], scope: list[str], gap: Column, reach: Callable[[float], float], first: float, other: Column | None = None) -> DataFrame:
    """asked with gap and node (a struct) of its nearest node in the same scope; both null where the scope has none.

    asked: ident (unique, no nulls), scope, x, y. nodes: scope, nx, ny, node. gap is a number over these columns, ties go
    to the smaller node; `other` says which nodes count. Each round deals nodes to squares and asks the nine around a
    point; a node outside of them has a gap of at least reach(side). Whoever has found a smaller gap is done, the others
    ask squares GROWTH times as wide, until these cover everything: rounds grow with the logarithm of the extent. Points
    that ask wide squares have no node near them. Rows without x and y find nothing. A point meets all nodes of its
    squares, so this is for points and nodes that can't crowd, like cells of a grid; nearest_grid_value is for others.
    """
    nodes, open_ = stored(nodes.dropna(subset=["nx", "ny"])), stored(asked)
    ends = nodes.select(F.col("nx").alias("x"), F.col("ny").alias("y")).unionByName(open_.select("x", "y")).agg(*[f(c).alias(f"{n}_{c}") for c in "xy" for n, f in (("low", F.min), ("high", F.max))]).first()
    widest = max((ends[f"high_{c}"] - ends[f"low_{c}"] for c in "xy" if ends[f"high_{c}"] is not None), default=0.0)
    square = lambda c, side: F.floor(F.col(c) / F.lit(side)).cast("long")
    done, side = [], float(first)
    while True:
        around = F.array(*[F.struct((square("x", side) + a).alias("_x"), (square("y", side) + b).alias("_y")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
        near = open_.withColumn("_s", F.explode(around)).select("*", "_s._x", "_s._y").drop("_s")
        met = near.join(nodes.withColumns({"_x": square("nx", side), "_y": square("ny", side)}), [*scope, "_x", "_y"])
        met = met if other is None else met.filter(other)
        best = met.groupBy(*ident).agg(F.min(F.struct(gap.alias("gap"), "node")).alias("_best")).select(*ident, "_best.gap", "_best.node")
        told = stored(open_.join(best, ident, "left"))
        if side > widest:
            done.append(told)
            break
        settled = F.coalesce(F.col("gap") < F.lit(reach(side)), F.lit(False))
        done.append(told.filter(settled))
        open_ = told.filter(~settled).drop("gap", "node")
        if open_.isEmpty():
            break
        side *= GROWTH
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def nearest_grid_value(points: DataFrame, nodes: DataFrame, values: list[str], step: float) -> DataFrame:
    """grid_id and the values of the node (lat, lon) nearest to each point (grid_id, latitude, longitude), planar in degrees.

    Nodes may lie anywhere; squares are step times powers of four wide. Of nodes equally near the one with the smaller
    lat, then lon counts. Points without a position have null values, nodes without a finite one don't count.

    Each place asks once, however many points share it. It begins with a few wide squares of nodes. A square's bounds say
    how near its nearest node is at least and at most, so squares that can't hold the nearest are left out and those
    with more than LEAF nodes are split, until a place has a few small squares whose nodes it meets. So neither crowded
    squares nor heaps far away are met whole. No node is on a place with another, so rounds end.
    """
    points = stored(points.select("grid_id", F.col("longitude").alias("x"), F.col("latitude").alias("y")))
    places = points.select("x", "y").filter("x is not null and y is not null").distinct()
    finite = [F.abs(F.col(c).cast("double")) < float("inf") for c in ("lat", "lon")]
    nodes = stored(nodes.filter(finite[0] & finite[1]).groupBy(F.col("lon").alias("nx"), F.col("lat").alias("ny")).agg(F.min(F.struct("lat", "lon", *values)).alias("node")))
    sides, least_side = _sides(nodes, float(step))

    met, asked, level = _bounded(places.crossJoin(F.broadcast(_squares(nodes, sides, 0).drop("_px", "_py")))), None, 0
    while True:
        best = F.min("high").over(Window.partitionBy("x", "y"))
        asked = stored(met.withColumn("best", best).filter(_WITHIN))
        wide = asked.filter(F.col("n") > LEAF)
        if sides(level) < least_side or wide.isEmpty():
            break
        level += 1
        split = wide.select("x", "y", "best", F.col("_x").alias("_px"), F.col("_y").alias("_py")).join(_squares(nodes, sides, level), ["_px", "_py"])
        met = asked.filter(F.col("n") <= LEAF).drop("best").unionByName(_bounded(split).filter(_WITHIN).drop("best", "_px", "_py"))

    levels = [r["level"] for r in asked.select("level").distinct().collect()] or [0]
    gap = F.pow(F.col("x") - F.col("nx"), 2) + F.pow(F.col("y") - F.col("ny"), 2)

    def pairs(asked: DataFrame) -> DataFrame:
        return reduce(DataFrame.unionByName, [asked.filter(F.col("level") == k).join(nodes.withColumns({"_x": _square("nx", sides(k)), "_y": _square("ny", sides(k))}), ["_x", "_y"]).withColumn("gap", gap) for k in levels])

    least = pairs(asked.select("x", "y", "level", "_x", "_y")).groupBy("x", "y").agg(F.min("gap").alias("best"))  # numbers alone, so pairs are neither sorted nor shuffled
    told = pairs(asked.drop("best").join(least, ["x", "y"]).filter(_WITHIN)).filter("gap = best").groupBy("x", "y").agg(F.min("node").alias("node"))
    return points.join(told, ["x", "y"], "left").select("grid_id", *[F.col(f"node.{v}").alias(v) for v in values])


#: Whether a square may hold the nearest node, with room for rounding.
_WITHIN = "low <= best * (1 + 1e-9D)"


def _square(c: str, side: float) -> Column:
    return F.floor(F.col(c) / F.lit(side)).cast("long")


def _sides(nodes: DataFrame, step: float) -> tuple[Callable[[int], float], float]:
    """The width of the squares of a level, a quarter of the level above; those of level 0 cover the nodes with a few. Also the width that needs no splitting."""
    ends = nodes.agg(*[(F.max(c) - F.min(c)).alias(c) for c in ("nx", "ny")]).first()
    widest = max(ends["nx"] or 0.0, ends["ny"] or 0.0)
    top = step
    while top * GROWTH < widest:
        top *= GROWTH
    return lambda level: top / GROWTH**level, widest * 2.0**-45


def _squares(nodes: DataFrame, sides: Callable[[int], float], level: int) -> DataFrame:
    """Squares of a level that hold nodes: the square above (_px, _py), its own (_x, _y), level, number of nodes and their bounds."""
    keys = [_square(c, sides(k)).alias(name) for name, c, k in (("_px", "nx", level - 1), ("_py", "ny", level - 1), ("_x", "nx", level), ("_y", "ny", level))]
    return nodes.groupBy(*keys).agg(F.count("*").alias("n"), *[f(c).alias(f"{end}_{c}") for c in ("nx", "ny") for end, f in (("low", F.min), ("high", F.max))]).withColumn("level", F.lit(level))


def _bounded(met: DataFrame) -> DataFrame:
    """met (places beside squares) with low and high: the nearest node is no nearer and no farther, as a node lies on each side of the bounds."""
    ends = {c: (F.col(c) - F.col(f"low_n{c}"), F.col(f"high_n{c}") - F.col(c)) for c in "xy"}
    out = {c: F.greatest(-a, -b, F.lit(0.0)) for c, (a, b) in ends.items()}
    near, far = ({c: f(F.abs(a), F.abs(b)) for c, (a, b) in ends.items()} for f in (F.least, F.greatest))
    sum_ = lambda a, b: a * a + b * b
    return met.withColumns({"low": sum_(out["x"], out["y"]), "high": F.least(sum_(near["x"], far["y"]), sum_(far["x"], near["y"]))}).drop(*[f"{end}_n{c}" for c in "xy" for end in ("low", "high")])
