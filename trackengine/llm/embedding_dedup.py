"""Near-duplicate vectors by a robust-pruned flat graph over overlapping shards.

1. *Classes*: rows of the same direction, bit for bit, become one vector with a number of copies.
2. *Bundles*: before anything is shuffled, the vectors that a task reads are bundled: all members lie within half of the
   threshold's angle of their leader, so that any two of them are linked. A bundle has a centre and a radius (its largest
   angle to a member); most are single vectors. A large group of near copies becomes few bundles, whatever its size.
3. *Shards*: a bounded sample of centres gives pivots; each bundle goes to its ``overlap`` nearest ones. Too large shards are
   cut again by pivots of their own, and at last, if their bundles can't be told apart, into blocks that meet in pairs.
4. *Graph*: in each shard, every bundle gets neighbours by robust pruning (a candidate goes if a chosen neighbour is closer
   to it by a factor ``ALPHA``), links back, and a way from the shard's medoid. The lists that a bundle has in its shards are
   united; near neighbours from other shards join a shard as a halo that can be found but leads no further.
5. *Search*: every bundle is sought from the medoid of its shards, best first for ``hops`` steps; then everything within range,
   the threshold's angle and both radii, is expanded until nothing new is in range.
6. *Verify*: two bundles whose radii fit into the threshold are linked as a whole (triangle inequality, with a margin); two
   single vectors are compared in double precision; members of others are compared in double precision, bundle with bundle.
7. *Audit*: the links of at most ``AUDIT`` vectors, chosen by hash, are counted over all vectors. Below ``RECALL`` everything is
   repeated with twice the overlap and steps, until shards cover all pivots.

So no link is below the threshold, and links within a group are counted, not listed. Counts of different runs differ only
where the search misses a link: bundles depend on how rows are dealt to tasks, so they are written down once.

Edge cases: vectors that are null, empty or zero or hold null or non-finite components link with nothing, like rows without
``vec_id``, whose component is null; all of them are kept. Vectors of different lengths are never linked. Rows with the same
``vec_id`` are vectors of their own. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackengine.llm.common import Workspace, map_batches
from trackengine.llm.components import components

#: Vectors that a task bundles at a time.
FLUSH = 8_192
#: Bundles that a shard should hold before overlap, and from where on it is cut again.
SHARD, MAX_SHARD = 500, 6_000
#: Centres that pivots are fitted on, and pivots, at most.
PIVOT_SAMPLE, MAX_PIVOTS = 20_000, 2_048
#: Neighbours that pruning leaves, its factor, and the nearest and the other candidates it chooses from.
DEGREE, ALPHA, NEAREST, OTHERS = 16, 1.2, 64, 32
OVERLAP, HOPS = 3, 16
#: Vectors whose links are counted in full, and the share of them that must be found.
AUDIT, RECALL = 1_000, 0.97
#: Angles are compared with this margin where no exact comparison follows.
MARGIN = 1e-6
#: Queries that a shard answers together.
TOGETHER = 256

_NODE = "node long, centre binary, radius double, weight long"


def _direction(x: np.ndarray) -> bytes | None:
    """A vector of length 1; None where there is none."""
    most = np.abs(x).max() if len(x) else 0.0
    if not np.isfinite(most) or most == 0:
        return None
    x = x / most
    return (x / np.sqrt(x @ x) + 0.0).tobytes()  # + 0.0: no negative zeros


def _directions(rows: DataFrame) -> DataFrame:
    """vec_id, unit (null where the vector has no direction), its 128-bit hash and its length."""

    def make():
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            column = batch.column("embedding")
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)  # null components are NaN
            at = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy())))
            units = [_direction(flat[at[k] : at[k + 1]]) for k in range(batch.num_rows)]
            keys = [None if u is None else xxhash.xxh3_128_digest(u) for u in units]
            sizes = [None if u is None else len(u) // 8 for u in units]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(units, pa.binary()), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32())], ["vec_id", "unit", "key", "size"])

        return each

    plain = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return map_batches(plain, make, "vec_id long, unit binary, key binary, size int")


def matrix(units: list[bytes], size: int) -> np.ndarray:
    return np.frombuffer(b"".join(units), float).reshape(-1, size)


def angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Between the unit vectors of rows, exact for small angles too."""
    return 2 * np.arcsin(np.minimum(1, np.sqrt(((x - y) ** 2).sum(-1)) / 2))


def leaders(x: np.ndarray, most: float) -> np.ndarray:
    """For each vector the place of the leader of its bundle, which is at most the angle ``most`` away and the first to take it."""
    least, out = math.cos(most), np.arange(len(x))
    narrow, crowded = x.astype(np.float32), np.zeros(len(x), bool)
    for k in range(0, len(x), 512):
        crowded[k : k + 512] = (narrow[k : k + 512] @ narrow.T >= least - 1e-4).sum(1) > 1
    rest = np.flatnonzero(crowded)
    while len(rest):
        taken = x[rest] @ x[rest[0]] >= least
        taken[0] = True
        out[rest[taken]] = rest[0]
        rest = rest[~taken]
    return out


def _bundles(classes: DataFrame, size: int, threshold: float) -> DataFrame:
    """Rows of ``_NODE`` with the least vec_id and the members: their nodes, copies and vectors."""

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        x = matrix([r[1] for r in rows], size)
        of = leaders(x, threshold / 2)
        order = np.argsort(of, kind="stable")
        starts = np.flatnonzero(np.append(True, of[order][1:] != of[order][:-1]))
        out = []
        for begin, end in zip(starts, np.append(starts[1:], len(order)), strict=True):
            m = order[begin:end]
            centre, radius = x[of[m[0]]], 0.0
            if len(m) > 1:
                mean = x[m].mean(0)
                mean /= np.sqrt(mean @ mean)
                centre, radius = min(((c, angles(x[m], c).max()) for c in (centre, mean)), key=lambda b: b[1])
            found = [rows[k] for k in m]
            out.append((rows[of[m[0]]][0], centre.tobytes(), float(radius), sum(r[2] for r in found), min(r[3] for r in found), [r[0] for r in found], [r[2] for r in found], x[m].tobytes()))
        kinds = [pa.int64(), pa.binary(), pa.float64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["node", "centre", "radius", "weight", "least", "members", "copies", "units"])

    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            held += zip(*(batch.column(c).to_pylist() for c in ("node", "unit", "copies", "least")), strict=True)
            while len(held) >= FLUSH:
                yield pack(held[:FLUSH])
                del held[:FLUSH]
        if held:
            yield pack(held)

    return classes.select("node", "unit", "copies", "least").mapInArrow(run, f"{_NODE}, least long, members array<long>, copies array<long>, units binary")


def fit_pivots(x: np.ndarray, n: int) -> np.ndarray:
    """Spherical k-means, begun with the first n vectors."""
    pivots = x[:n].copy()
    for _ in range(4):
        near = np.concatenate([(x[k : k + 4096] @ pivots.T).argmax(1) for k in range(0, len(x), 4096)])
        sums = np.zeros_like(pivots)
        np.add.at(sums, near, x)
        norms = np.sqrt((sums**2).sum(1))
        pivots = np.where((norms > 0)[:, None], sums / np.maximum(norms, 1e-300)[:, None], pivots)
    return pivots


def _dealt(rows: DataFrame, n: int, size: int, overlap: int) -> tuple[DataFrame, int]:
    """``rows`` (cell and the columns of ``_NODE``) dealt to the nearest pivots; the number of pivots."""
    spark = rows.sparkSession
    want = min(MAX_PIVOTS, max(1, math.ceil(n / SHARD)))
    drawn = rows.select("node", "centre").distinct().orderBy(F.xxhash64(F.lit(7), "node"), "node").limit(PIVOT_SAMPLE)
    sample = matrix([r["centre"] for r in drawn.select("centre").collect()], size)  # at most PIVOT_SAMPLE vectors
    pivots = fit_pivots(sample, min(want, len(sample)))
    sent = spark.sparkContext.broadcast(pivots)
    n_near = min(overlap, len(pivots))

    def make():
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            found = matrix(batch.column("centre").to_pylist(), size) @ sent.value.T
            near = np.argpartition(-found, n_near - 1, axis=1)[:, :n_near].astype(np.int64).ravel()
            again = batch.take(pa.array(np.repeat(np.arange(batch.num_rows), n_near)))
            cells = again.column("cell").to_numpy() * (MAX_PIVOTS + 1) + near + 1
            yield again.set_column(0, "cell", pa.array(cells))

        return each

    return map_batches(rows, make, f"cell long, {_NODE}"), len(pivots)


def _shards(work: Workspace, bundles: DataFrame, size: int, overlap: int, name: str) -> tuple[DataFrame, bool]:
    """cell and the columns of ``_NODE``, a row for each shard of a bundle; whether every shard has all bundles."""
    n = bundles.count()
    rows, whole = bundles.select(F.lit(0).cast("long").alias("cell"), "node", "centre", "radius", "weight"), False
    for level in range(3):
        if level == 0:
            dealt, pivots = _dealt(rows, n, size, overlap)
            whole = overlap >= pivots
        else:
            dealt, _ = _dealt(rows, n, size, overlap)
            dealt = dealt.unionByName(fitting)
        dealt = work.write(dealt.distinct(), f"{name}-cells-{level}")
        counted = dealt.groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") > MAX_SHARD)
        large = work.write(counted, f"{name}-large-{level}")
        n = large.agg(F.sum("n")).first()[0] or 0
        if not n:
            return dealt, whole
        fitting = dealt.join(large.select("cell"), "cell", "left_anti")
        rows = dealt.join(large.select("cell"), "cell", "left_semi")
    # bundles that pivots can't tell apart: parts of half a shard, each pair of parts is a shard
    parts = F.ceil(F.col("n") * 2 / MAX_SHARD).cast("int")
    placed = dealt.join(large.withColumn("parts", parts), "cell").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    pairs = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cell = F.xxhash64("cell", F.least("part", "other"), F.greatest("part", "other"))
    return work.write(fitting.unionByName(pairs.select(cell.alias("cell"), "node", "centre", "radius", "weight")), f"{name}-cells"), whole


def pruned_graph(x: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Directed edges (from, to) between the rows of ``x``; every row can be reached from the medoid."""
    n = len(x)
    if n < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    far = np.sqrt(np.maximum(0, 2 - 2 * (x @ x.T)))
    np.fill_diagonal(far, np.inf)
    near = np.argpartition(far, min(NEAREST, n - 1) - 1, axis=1)[:, : min(NEAREST, n - 1)]
    other = np.random.default_rng(seed).integers(0, n, (n, min(OTHERS, n)))
    found = np.concatenate((near, other), axis=1)
    each = np.arange(n)[:, None]
    found = found[each, np.argsort(far[each, found], axis=1, kind="stable")]
    away = far[each, found]
    alive, chosen = np.isfinite(away), []
    for _ in range(DEGREE):
        has = np.flatnonzero(alive.any(1))
        if not len(has):
            break
        pick = found[has, alive[has].argmax(1)]
        chosen.append((has, pick))
        between = far[pick[:, None], found[has]]
        between[found[has] == pick[:, None]] = 0
        alive[has] &= ALPHA * between > away[has]
    a, b = (np.concatenate(c) for c in zip(*chosen, strict=True))
    edges = np.unique(np.concatenate((a * n + b, b * n + a)))
    a, b = edges // n, edges % n
    # links back make lists of any length: the nearest stay
    order = np.lexsort((far[a, b], a))
    a, b = a[order], b[order]
    rank = np.arange(len(a)) - np.searchsorted(a, a)
    a, b = a[rank < 2 * DEGREE], b[rank < 2 * DEGREE]
    return _reachable(a, b, n, medoid(x))


def medoid(x: np.ndarray) -> int:
    return int((x @ x.mean(0)).argmax())


def _reachable(a: np.ndarray, b: np.ndarray, n: int, start: int) -> tuple[np.ndarray, np.ndarray]:
    seen, frontier = np.zeros(n, bool), np.array([start])
    indptr = np.searchsorted(a, np.arange(n + 1))  # a is in order
    more = []
    while True:
        seen[frontier] = True
        while len(frontier):
            to = np.unique(np.concatenate([b[indptr[k] : indptr[k + 1]] for k in frontier]))
            frontier = to[~seen[to]]
            seen[frontier] = True
        left = np.flatnonzero(~seen)
        if not len(left):
            break
        more.append(left[0])
        frontier = left[:1]
    more = np.array(more, np.int64)
    return np.concatenate((a, np.full(len(more), start))), np.concatenate((b, more))


def range_search(x: np.ndarray, radii: np.ndarray, indptr: np.ndarray, to: np.ndarray, queries: np.ndarray, start: int, hops: int, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, found, cosine) for rows of ``x`` within range that best-first search from ``start`` and the expansion reach."""
    for k in range(0, len(queries), TOGETHER):
        q = queries[k : k + TOGETHER]
        cosine = np.full((len(q), len(x)), -np.inf)
        open_ = np.full((len(q), len(x)), -np.inf)  # cosines of what is seen, but not expanded
        cosine[:, start] = open_[:, start] = x[q] @ x[start]
        each, step = np.arange(len(q)), 0
        while True:
            best = open_.argmax(1)
            score = open_[each, best]
            reach = np.cos(np.minimum(math.pi, threshold + radii[q] + radii[best] + MARGIN))
            go = (score > -np.inf) & ((step < hops) | (score >= reach))
            if not go.any():
                break
            rows, best = each[go], best[go]
            open_[rows, best] = -np.inf
            spread = indptr[best + 1] - indptr[best]
            inside = np.arange(spread.sum()) - np.repeat(np.cumsum(spread) - spread, spread) + np.repeat(indptr[best], spread)
            rows, nodes = np.repeat(rows, spread), to[inside]
            new = cosine[rows, nodes] == -np.inf
            rows, nodes = rows[new], nodes[new]
            open_[rows, nodes] = cosine[rows, nodes] = np.einsum("ij,ij->i", x[q[rows]], x[nodes])
            step += 1
        rows, nodes = np.nonzero(cosine >= math.cos(min(math.pi, threshold + 2 * (radii.max() if len(radii) else 0) + MARGIN)))
        yield q[rows], nodes, cosine[rows, nodes]


def _by_cell(rows: DataFrame, of_cell, schema: str) -> DataFrame:
    return rows.groupBy("cell").applyInArrow(of_cell, schema)


def _graph(shards: DataFrame, size: int, threshold: float) -> DataFrame:
    """Neighbour lists of bundles, those of all shards united: node, and (node, whether it may be in range)."""

    def of_cell(t: pa.Table) -> pa.Table:
        t = t.take(pa.array(np.argsort(t.column("node").to_numpy(), kind="stable")))
        nodes, radii = t.column("node").to_numpy(), t.column("radius").to_numpy()
        x = matrix(t.column("centre").to_pylist(), size)
        a, b = pruned_graph(x, int(nodes[0]) & 0xFFFF)
        near = angles(x[a], x[b]) <= threshold + radii[a] + radii[b] + MARGIN
        return pa.table({"node": nodes[a], "to": nodes[b], "near": near})

    edges = _by_cell(shards.select("cell", "node", "centre", "radius"), of_cell, "node long, to long, near boolean")
    return edges.groupBy("node").agg(F.collect_set(F.struct("to", "near")).alias("links"))


def _search(work: Workspace, bundles: DataFrame, shards: DataFrame, graph: DataFrame, size: int, hops: int, cosine: float) -> DataFrame:
    """Pairs of bundles within range: a < b, their radii and weights, and the cosine of their centres."""
    threshold = math.acos(cosine)
    members = shards.join(graph, "node", "left").withColumn("member", F.lit(True))
    near = shards.select("cell", "node").join(graph, "node").select("cell", F.explode(F.filter("links", lambda e: e["near"])).alias("e"))
    strange = near.select("cell", F.col("e.to").alias("node")).distinct().join(shards.select("cell", "node"), ["cell", "node"], "left_anti")
    halo = strange.join(bundles.select("node", "centre", "radius", "weight"), "node")
    pieces = members.select("cell", "node", "centre", "radius", "weight", F.transform("links", lambda e: e["to"]).alias("links"), "member").unionByName(halo.select("cell", "node", "centre", "radius", "weight", F.lit(None).cast("array<long>").alias("links"), F.lit(False).alias("member")))

    def of_cell(t: pa.Table) -> pa.Table:
        t = t.take(pa.array(np.argsort(t.column("node").to_numpy(), kind="stable")))
        nodes, radii, weights = (t.column(c).to_numpy() for c in ("node", "radius", "weight"))
        x = matrix(t.column("centre").to_pylist(), size)
        member = np.flatnonzero(t.column("member").to_numpy())
        links = [np.array(k or [], np.int64) for k in t.column("links").to_pylist()]
        a, b = np.repeat(np.arange(len(links)), [len(k) for k in links]), np.concatenate(links)
        at = np.minimum(np.searchsorted(nodes, b), len(nodes) - 1)
        here = nodes[at] == b  # lists name bundles of other shards too
        a, b = a[here], at[here]
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        for q, found, near in range_search(x, radii, np.searchsorted(a, np.arange(len(nodes) + 1)), b, member, int(member[medoid(x[member])]), hops, threshold):
            single = (radii[q] == 0) & (radii[found] == 0)
            turn = angles(x[q], x[found])
            linked = np.where(single, near >= cosine, turn <= threshold + radii[q] + radii[found] + MARGIN) & (q != found)
            out.append((q[linked], found[linked], np.where(single, -1.0, turn)[linked]))
        q, found, turn = (np.concatenate(c) for c in zip(*out, strict=True))
        q, found = np.minimum(q, found), np.maximum(q, found)
        keys, first = np.unique(q * len(nodes) + found, return_index=True)
        q, found, turn = keys // len(nodes), keys % len(nodes), turn[first]
        return pa.table({"a": nodes[q], "b": nodes[found], "a_radius": radii[q], "b_radius": radii[found], "a_weight": weights[q], "b_weight": weights[found], "angle": turn})

    pairs = _by_cell(pieces, of_cell, "a long, b long, a_radius double, b_radius double, a_weight long, b_weight long, angle double")
    return pairs.groupBy("a", "b").agg(*(F.first(c).alias(c) for c in ("a_radius", "b_radius", "a_weight", "b_weight", "angle")))


def _compared(pairs: DataFrame, bundles: DataFrame, size: int, cosine: float) -> DataFrame:
    """Members of pairs of bundles held against each other: (a, b, node, n) for each member with n links, vectors of the other bundle."""
    of = lambda side: bundles.select(F.col("node").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in ("members", "copies", "units")))
    both = pairs.select("a", "b").join(of("a"), "a").join(of("b"), "b")

    def make():
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for r in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
                x, y = (np.frombuffer(r[f"{s}_units"], float).reshape(-1, size) for s in "ab")
                x_copies, y_copies = (np.array(r[f"{s}_copies"], np.int64) for s in "ab")
                x_links, y_links = [], np.zeros(len(y), np.int64)
                for k in range(0, len(x), 1024):
                    near = x[k : k + 1024] @ y.T >= cosine
                    x_links.append(near @ y_copies)
                    y_links += x_copies[k : k + 1024] @ near
                nodes, n = np.array(r["a_members"] + r["b_members"], np.int64), np.concatenate((*x_links, y_links))
                some = n > 0
                yield pa.RecordBatch.from_pydict({"a": np.full(some.sum(), r["a"]), "b": np.full(some.sum(), r["b"]), "node": nodes[some], "n": n[some]})

        return each

    return map_batches(both, make, "a long, b long, node long, n long")


def _linked(work: Workspace, classes: DataFrame, bundles: DataFrame, size: int, cosine: float, overlap: int, hops: int, name: str) -> tuple[DataFrame, bool]:
    """node, n_links and component of every class; whether shards covered all bundles."""
    threshold = math.acos(cosine)
    shards, whole = _shards(work, bundles, size, overlap, name)
    graph = work.write(_graph(shards, size, threshold), f"{name}-graph")
    pairs = work.write(_search(work, bundles, shards, graph, size, hops, cosine), f"{name}-pairs")
    sure = (F.col("angle") < 0) | (F.col("angle") + F.col("a_radius") + F.col("b_radius") <= threshold - MARGIN)
    certain, open_ = pairs.filter(sure), pairs.filter(~sure)
    checked = work.write(_compared(open_, bundles, size, cosine), f"{name}-checked")
    by_bundle = certain.select(F.col("a").alias("bundle"), F.col("b_weight").alias("n")).unionByName(certain.select(F.col("b").alias("bundle"), F.col("a_weight").alias("n"))).groupBy("bundle").agg(F.sum("n").alias("of_bundle"))
    by_node = checked.groupBy("node").agg(F.sum("n").alias("of_node"))
    edges = certain.select("a", "b").unionByName(checked.select("a", "b").distinct())
    found = components(work, edges, f"{name}-components").select(F.col("node").alias("bundle"), "component")
    rooted = bundles.select(F.col("node").alias("bundle"), "least", "weight", "members").join(found, "bundle", "left").join(by_bundle, "bundle", "left")
    rooted = work.write(rooted.withColumn("component", F.coalesce("component", "bundle")), f"{name}-rooted")
    least = rooted.groupBy("component").agg(F.min("least").alias("component_id"))
    members = rooted.join(least, "component").select("weight", "of_bundle", "component_id", F.explode("members").alias("node"))
    n_links = F.col("weight") - 1 + F.coalesce("of_bundle", F.lit(0)) + F.coalesce("of_node", F.lit(0))
    return work.write(members.join(by_node, "node", "left").select("node", n_links.alias("n_links"), "component_id"), f"{name}-linked"), whole


def _recall(classes: DataFrame, linked: DataFrame, size: int, cosine: float) -> float:
    """The found share of the links of at most ``AUDIT`` classes, counted over all classes."""
    drawn = classes.orderBy(F.xxhash64(F.lit(11), "node"), "node").limit(AUDIT).select("node", "unit", "copies")
    sample = drawn.collect()  # at most AUDIT vectors
    sent = classes.sparkSession.sparkContext.broadcast(matrix([r["unit"] for r in sample], size))

    def make():
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            n = np.zeros(len(sent.value), np.int64)
            units, copies = batch.column("unit").to_pylist(), batch.column("copies").to_numpy()
            for k in range(0, len(units), 4096):
                n += copies[k : k + 4096] @ (matrix(units[k : k + 4096], size) @ sent.value.T >= cosine)
            yield pa.RecordBatch.from_pydict({"k": np.arange(len(n)), "n": n})

        return each

    counted = map_batches(classes.select("unit", "copies"), make, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
    true = {sample[r["k"]]["node"]: r["n"] - 1 for r in counted.collect()}  # a vector meets itself once
    found = {r["node"]: r["n_links"] for r in linked.join(F.broadcast(drawn.select("node")), "node", "left_semi").collect()}
    total = sum(true.values())
    return sum(min(found.get(k, 0), n) for k, n in true.items()) / total if total else 1.0


def near_duplicates(rows: DataFrame, cosine: float = 0.9, recall: float = RECALL, overlap: int = OVERLAP, hops: int = HOPS) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of ``rows`` (vec_id, embedding). Runs jobs.

    Raises ValueError if even shards that hold all bundles leave the audit below ``recall``."""
    work = Workspace(rows.sparkSession, "embedding-dedup")
    placed = work.write(_directions(rows), "directions")
    usable = placed.filter("vec_id is not null and unit is not null")
    grouped = usable.groupBy("size", "key").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("unit").alias("unit"))
    all_classes = work.write(grouped.withColumn("node", F.monotonically_increasing_id()), "classes")
    done = None
    for k, size in enumerate(sorted(r["size"] for r in all_classes.select("size").distinct().collect())):
        classes, trial = all_classes.filter(F.col("size") == size), 0
        bundles = work.write(_bundles(classes, size, math.acos(cosine)), f"{k}-bundles")
        while True:
            linked, whole = _linked(work, classes, bundles, size, cosine, overlap * 2**trial, hops * 2**trial, f"{k}-{trial}")
            found = _recall(classes, linked, size, cosine)
            if found >= recall:
                break
            if whole:
                raise ValueError(f"recall {found:.3f} of the audit is below {recall}")
            trial += 1
        done = linked if done is None else done.unionByName(linked)
    plain = placed.select("vec_id", "key", "size")
    if done is None:
        out = plain.withColumns({"n_links": F.lit(0).cast("long"), "component": F.lit(None).cast("long")})
    else:
        by_class = work.write(all_classes.select("size", "key", "node").join(done, "node").select("size", "key", "n_links", F.col("component_id").alias("component")), "by-class")
        # rows without an id must not meet the class of their vector
        keyed = plain.withColumn("key", F.when(F.col("vec_id").isNotNull(), F.col("key")))
        out = keyed.join(by_class, ["size", "key"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
