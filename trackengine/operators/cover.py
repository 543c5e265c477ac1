"""Polygons as hierarchical covers of cells, for many points.

A cover is a quadtree of cells: a cell through which no edge of a region passes is inside or outside as a whole, and is kept
where it is inside; others are cut into four, down to the finest level. A finest cell with edges keeps these edges and
whether one point of it, its mark, is inside. A point in an inside cell needs no edge; in a border cell it is inside if the
way from the mark, across and then up or down, crosses edges an even number of times and the mark is inside, or an odd
number and it is not. The way stays in the cell, so that the cell's edges are enough."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackengine.operators.spatial import points_in_polygons
from trackengine.sources import scratch

#: Degrees of the coarsest cells, and levels; each one halves the last.
TOP, LEVELS = 8.0, 6
#: Where in a cell its mark is: at no round number, so that it is on no edge.
MARK_X, MARK_Y = 0.5136718273, 0.4862917354
#: Degrees by which cells are widened when edges are dealt to them.
PAD = 1e-9


@dataclass(frozen=True)
class Cover:
    """inside: level, cx, cy, region. border: cx, cy and region of finest cells, ``marked`` (their mark is inside), mx, my, and an edge."""

    inside: DataFrame
    border: DataFrame
    top: float
    levels: int
    path: str


def _touches(size: float) -> Column:
    """Whether an edge touches the cell (cx, cy): boxes meet, and the cell's corners aren't all on one side of the line."""
    half = size / 2 + PAD
    mx, my = (F.col("cx") + 0.5) * size, (F.col("cy") + 0.5) * size
    box = (F.greatest("x1", "x2") >= mx - half) & (F.least("x1", "x2") <= mx + half) & (F.greatest("y1", "y2") >= my - half) & (F.least("y1", "y2") <= my + half)
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    away = F.abs(dx * (F.col("y1") - my) - dy * (F.col("x1") - mx))
    return box & (away <= half * (F.abs(dx) + F.abs(dy)) + PAD)


def _marks(cells: DataFrame, size: float) -> DataFrame:
    return cells.withColumns({"mx": (F.col("cx") + MARK_X) * size, "my": (F.col("cy") + MARK_Y) * size})


def _marked(cells: DataFrame, edges: DataFrame, region: str) -> DataFrame:
    """``cells`` (region, cx, cy, mx, my) whose mark is inside their region."""
    named = cells.withColumn("cell", F.concat_ws(":", "cx", "cy"))
    marks = named.select("cell", F.col("mx").alias("lon"), F.col("my").alias("lat")).distinct()
    return named.join(points_in_polygons(marks, edges, "cell", region), ["cell", region], "left_semi").drop("cell")


def cover(edges: DataFrame, region: str = "region", top: float = TOP, levels: int = LEVELS) -> Cover:
    """The cover of all regions of an edge table (region, x1, y1, x2, y2). Runs a few jobs a level and writes small tables, since
    a cover is made once for many points; ``drop`` deletes them."""
    spark, path = edges.sparkSession, scratch.new_path(edges.sparkSession, "cover")

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{path}/{name}")
        return spark.read.parquet(f"{path}/{name}")

    edges = edges.select(region, "x1", "y1", "x2", "y2")
    span = lambda a, b: F.sequence(F.floor((F.least(a, b) - PAD) / top), F.floor((F.greatest(a, b) + PAD) / top))
    box = edges.groupBy(region).agg(F.min(F.least("x1", "x2")).alias("x0"), F.max(F.greatest("x1", "x2")).alias("x3"), F.min(F.least("y1", "y2")).alias("y0"), F.max(F.greatest("y1", "y2")).alias("y3"))
    cells = box.withColumn("cx", F.explode(span("x0", "x3"))).withColumn("cy", F.explode(span("y0", "y3"))).select(region, "cx", "cy")
    held = edges.withColumn("cx", F.explode(span("x1", "x2"))).withColumn("cy", F.explode(span("y1", "y2")))
    inside, size = None, top
    for level in range(levels):
        held = written(held.filter(_touches(size)), f"edges-{level}")
        border = held.select(region, "cx", "cy").distinct()
        clear = _marks(cells.join(border, [region, "cx", "cy"], "left_anti"), size)
        whole = written(_marked(clear, edges, region).select(F.lit(level).alias("level"), "cx", "cy", region), f"inside-{level}")
        inside = whole if inside is None else inside.unionByName(whole)
        if level < levels - 1:
            size /= 2
            quarters = F.explode(F.array(*(F.struct((F.col("cx") * 2 + a).alias("cx"), (F.col("cy") * 2 + b).alias("cy")) for a in (0, 1) for b in (0, 1))))
            cells = border.select(region, quarters.alias("q")).select(region, "q.cx", "q.cy")
            held = held.select(region, "x1", "y1", "x2", "y2", quarters.alias("q")).select(region, "x1", "y1", "x2", "y2", "q.cx", "q.cy")
    marks = _marks(border, size)
    good = _marked(marks, edges, region).select(region, "cx", "cy", F.lit(True).alias("marked"))
    flagged = marks.join(good, [region, "cx", "cy"], "left").withColumn("marked", F.coalesce("marked", F.lit(False)))
    return Cover(inside, written(held.join(flagged, [region, "cx", "cy"]), "border"), top, levels, path)


def drop(made: Cover) -> None:
    scratch.delete_path(made.border.sparkSession, made.path)


def _at(level: int, made: Cover, column: str) -> Column:
    return F.floor(F.col(column) / (made.top / 2**level))


def border_meetings(points: DataFrame, made: Cover, key: str) -> DataFrame:
    """Points beside the edges that they are tested against: those of their finest cell."""
    finest = made.levels - 1
    here = points.select(key, F.col("lon").alias("px"), F.col("lat").alias("py"), _at(finest, made, "lon").alias("cx"), _at(finest, made, "lat").alias("cy"))
    return here.join(made.border, ["cx", "cy"])


def points_in_cover(points: DataFrame, made: Cover, key: str, region: str = "region") -> DataFrame:
    """(key, region) of the points inside, by the even-odd rule over all rings, as ``spatial.points_in_polygons``."""
    cells = F.explode(F.array(*(F.struct(F.lit(k).alias("level"), _at(k, made, "lon").alias("cx"), _at(k, made, "lat").alias("cy")) for k in range(made.levels))))
    whole = points.select(key, cells.alias("c")).select(key, "c.*").join(made.inside, ["level", "cx", "cy"]).select(key, region)
    met = border_meetings(points, made, key)
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    at_x = dx * (F.col("py") - F.col("y1")) / F.when(dy == 0, 1e-9).otherwise(dy) + F.col("x1")
    at_y = dy * (F.col("mx") - F.col("x1")) / F.when(dx == 0, 1e-9).otherwise(dx) + F.col("y1")
    across = ((F.col("y1") > F.col("py")) != (F.col("y2") > F.col("py"))) & ((F.col("px") < at_x) != (F.col("mx") < at_x))
    along = ((F.col("x1") > F.col("mx")) != (F.col("x2") > F.col("mx"))) & ((F.col("py") < at_y) != (F.col("my") < at_y))
    crossed = met.groupBy(key, region).agg(F.sum(across.cast("int") + along.cast("int")).alias("crossings"), F.first("marked").alias("marked"))
    return whole.unionByName(crossed.filter((F.col("crossings") % 2 == 1) != F.col("marked")).select(key, region))
