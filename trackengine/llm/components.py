"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackengine.llm.common import Workspace


def _star(work: Workspace, edges: DataFrame, large: bool, name: str) -> DataFrame:
    """edges: a > b. Large star links each node's larger neighbours to its least neighbour, small star the others.

    The minima are written down first: both sides of the join are then plain scans, so that Spark can split a node with
    very many edges over tasks."""
    out = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        out = out.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = work.write(out.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{name}-least")
    joined = out.join(least, "u")
    if large:
        new = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        new = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return work.write(new.filter("a <> b").distinct(), name)


def components(work: Workspace, edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b); the component is the least node that is reached.

    Every step is written to the shared folder, so lineage stays short and a lost executor costs one step."""
    ordered = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    state = work.write(ordered, f"{name}-0")
    mark, step = None, 0
    while True:
        now = state.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == mark:
            break
        mark, step = now, step + 1
        state = _star(work, _star(work, state, True, f"{name}-{step}-large"), False, f"{name}-{step}-small")
        for old in (f"{name}-{step - 1}" if step == 1 else f"{name}-{step - 1}-small", f"{name}-{step}-large", f"{name}-{step}-large-least", f"{name}-{step}-small-least"):
            work.remove(old)
    roots = state.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return state.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
