"""Spatial operators: polygons by edge parity, density grids, nearest track segments. Cells make every join an equi-join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values: sea basins of genesis
WEST, SPLIT, EAST, NORTH = 45.0, 77.5, 100.0, 30.0
# ---


def points_in_polygons(points: DataFrame, edges: DataFrame, key: str, region: str = "region") -> DataFrame:
    """(key, region) of the points inside, by the even-odd rule over all rings (holes count by parity).

    Edges (region, x1, y1, x2, y2) are put into the 1-degree rows of latitude that they span and each region's columns of longitude, points
    into their cell; so a point meets the edges of regions near it only."""
    box = edges.groupBy(region).agg(F.min(F.least("x1", "x2")).alias("west"), F.max(F.greatest("x1", "x2")).alias("east"))
    spans = edges.join(box, region).withColumn("row", F.explode(F.sequence(F.floor(F.least("y1", "y2")), F.floor(F.greatest("y1", "y2")))))
    cells = spans.withColumn("col", F.explode(F.sequence(F.floor("west"), F.floor("east"))))
    here = points.select(key, F.col("lon").alias("px"), F.col("lat").alias("py"), F.floor("lat").alias("row"), F.floor("lon").alias("col"))
    met = here.join(cells, ["row", "col"])
    height = F.col("y2") - F.col("y1")
    at = (F.col("x2") - F.col("x1")) * (F.col("py") - F.col("y1")) / F.when(height == 0, 1e-9).otherwise(height) + F.col("x1")
    crossed = ((F.col("y1") > F.col("py")) != (F.col("y2") > F.col("py"))) & (F.col("px") < at)
    return met.groupBy(key, region).agg(F.sum(crossed.cast("int")).alias("crossings")).filter("crossings % 2 = 1").select(key, region)


def genesis_region(starts: DataFrame, land: DataFrame, water: DataFrame, key: str) -> DataFrame:
    """``india`` on land; else at sea ``bob`` or ``arabian`` by longitude; else ``other``. land and water are edge tables."""
    on_land = points_in_polygons(starts, land, key).select(key, F.lit(True).alias("on_land")).distinct()
    at_sea = points_in_polygons(starts, water, key).select(key, F.lit(True).alias("at_sea")).distinct()
    both = starts.join(on_land, key, "left").join(at_sea, key, "left")
    sea = F.col("at_sea") & F.col("lat").between(0, NORTH)
    value = (
        F.when(F.col("on_land"), "india").when(sea & F.col("lon").between(SPLIT, EAST), "bob").when(sea & (F.col("lon") >= WEST) & (F.col("lon") < SPLIT), "arabian").otherwise("other")
    )
    return both.select(key, value.alias("genesis_region"))


def crosses_region(points: DataFrame, edges: DataFrame, key: str, point_key: str) -> DataFrame:
    """(track, region) with at least one point inside."""
    hits = points_in_polygons(points, edges, point_key)
    return points.select(key, point_key).join(hits, point_key).select(key, "region").distinct()


def bbox_intersects(west: float, east: float, south: float, north: float) -> Column:
    """Whether a track's bounds meet a view; edges count."""
    return (F.col("max_lon") >= west) & (F.col("min_lon") <= east) & (F.col("max_lat") >= south) & (F.col("min_lat") <= north)


def track_density(stepped: DataFrame, cell: float = 0.5, months: tuple[int, ...] | None = None, key: str = "track_id", parent: str = "track_id", clamp: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Distinct tracks in each grid cell. Every step is sampled so finely that it skips no cell by more than its corner; steps over a break or
    with an end outside the months are left out, single points still count. clamp: least and greatest cell x and y."""
    w = Window.partitionBy(parent).orderBy("idx")
    inside = F.month("time").isin(*months) if months else F.lit(True)
    rows = stepped.withColumns({"lat0": F.lag("lat").over(w), "lon0": F.lag("lon").over(w), "in0": F.lag(inside).over(w), "in1": inside})
    joined = F.coalesce(F.col("within_segment") & F.col("in0"), F.lit(False))
    n = F.when(joined, F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(F.col("lat") - F.col("lat0")), F.abs(F.col("lon") - F.col("lon0"))) / cell))).otherwise(F.lit(0)).cast("int")
    rows = rows.filter("in1").withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0), "n")))
    share = F.when(F.col("n") > 0, F.col("k") / F.col("n")).otherwise(1.0)
    place = lambda a, b: F.coalesce(F.col(a) + (F.col(b) - F.col(a)) * share, F.col(b))
    x, y = (F.floor(F.when(F.col("n") > 0, place(a, b)).otherwise(F.col(b)) / cell).cast("long") for a, b in (("lon0", "lon"), ("lat0", "lat")))
    if clamp:
        x, y = (F.greatest(F.lit(lo), F.least(F.lit(hi), v)) for v, lo, hi in ((x, clamp[0], clamp[1]), (y, clamp[2], clamp[3])))
    return rows.select(key, x.alias("cell_x"), y.alias("cell_y")).distinct().groupBy("cell_x", "cell_y").agg(F.count("*").alias("n_tracks"))


def genesis_grid(starts: DataFrame, cell: float = 0.5) -> DataFrame:
    """Counts of first points in each cell."""
    return starts.groupBy(F.floor(F.col("lon") / cell).alias("cell_x"), F.floor(F.col("lat") / cell).alias("cell_y")).agg(F.count("*").alias("n"))


def segments(stepped: DataFrame, key: str = "track_id") -> DataFrame:
    """Steps inside a segment as planar segments (key, seg, ax, ay, bx, by)."""
    w = Window.partitionBy(key).orderBy("idx")
    rows = stepped.select(key, F.col("idx").alias("seg"), F.lag("lon").over(w).alias("ax"), F.lag("lat").over(w).alias("ay"), F.col("lon").alias("bx"), F.col("lat").alias("by"), "within_segment")
    return rows.filter("within_segment").drop("within_segment")


def nearest_track(queries: DataFrame, segs: DataFrame, radius: float, query_key: str, key: str = "track_id") -> DataFrame:
    """The nearest segment strictly within ``radius`` degrees of each query point, by planar distance; ties to the lowest
    track and segment. Segments are put into the 1-degree cells of their boxes, query points into the cells they reach."""
    over = lambda a, b: F.sequence(F.floor(F.least(a, b)), F.floor(F.greatest(a, b)))
    cells = segs.withColumn("cx", F.explode(over("ax", "bx"))).withColumn("cy", F.explode(over("ay", "by")))
    reach = lambda c: F.sequence(F.floor(F.col(c) - radius), F.floor(F.col(c) + radius))
    asked = queries.select(query_key, F.col("lon").alias("qx"), F.col("lat").alias("qy"), F.explode(reach("lon")).alias("cx"), "lat").withColumn("cy", F.explode(reach("lat"))).drop("lat")
    met = asked.join(cells, ["cx", "cy"])
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    length = dx * dx + dy * dy
    t = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("qx") - F.col("ax")) * dx + (F.col("qy") - F.col("ay")) * dy) / length))).otherwise(0.0)
    px, py = F.col("ax") + t * dx - F.col("qx"), F.col("ay") + t * dy - F.col("qy")
    distance = F.sqrt(px * px + py * py)
    best = met.withColumn("d", distance).filter(F.col("d") < radius).groupBy(query_key).agg(F.min(F.struct("d", key, "seg")).alias("m"))
    return best.select(query_key, f"m.{key}", "m.seg", F.col("m.d").alias("distance"))


def visible(points: DataFrame, cohort: DataFrame, months: tuple[int, ...], key: str = "track_id") -> DataFrame:
    """Bounds and number of the cohort's points in the months, in one row."""
    shown = points.join(cohort.select(key), key, "left_semi").filter(F.month("time").isin(*months))
    return shown.agg(F.min("lon").alias("min_lon"), F.max("lon").alias("max_lon"), F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"), F.count("*").alias("n_points"))
