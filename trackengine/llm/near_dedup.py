"""Near-duplicates by SetSketch registers.

1. A sketch of each document's shingle set: register i holds 1 - floor(log_b(min of exponential hashes)), limited to
   0..q+1 (Ertl 2021; b = 1.001). Exponential hashes are a decreasing map of uniform ones, so the minimum is taken over 64-bit hashes and
   mapped once. Such registers merge by maximum and equal each other about as often as two sets share elements.
2. Documents with equal sets form a class, and one representative goes on: groups of copies never meet in pairs.
3. Bands of registers are hashed; representatives that share a band value form a bucket. ``bands_for`` gives so many
   bands of 6 registers that a pair at the threshold is missed with a probability of 1e-6 (30 bands at Jaccard 0.85).
4. Shingles that no other document of any bucket has can't be shared: n less their number bounds every intersection.
   The bound removes most pairs of a large group whose members differ each in their own way, without forming them.
5. In each bucket every member meets one centre, the member that others share most with. Pairs that pass the length and
   intersection bounds get a joint maximum-likelihood estimate from both sketches; pairs estimated far below the
   threshold go, all others are verified on the full sets. Components of the verified links are found.
6. Only members of one bucket that are in different components and have not met can still be linked. They are dealt into
   blocks of bounded size, by length class, and blocks meet in pairs; those of a bucket's largest component never meet each
   other. Inside a pair of blocks numpy compares counts of the sets' elements in ``GROUPS`` hashed groups: the sum of the
   smaller counts bounds an intersection from above, exactly and closely. Only pairs that this bound leaves, hardly more than
   the true links between components, become rows; they go the way of step 5.
   So every pair of a bucket is decided, no group's pairs are formed as rows, and no task holds a group.

Edge cases: a null, empty or wordless text has an empty set and is linked with nothing. Fewer words than a shingle are
one shingle. Rows with the same doc_id count as one document and are linked. A null doc_id is linked with nothing, its
component is null and it is kept. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackengine.llm.common import Workspace, delete_path, finish, map_batches, shingle_set, slices, texts
from trackengine.llm.components import components

BASE, Q, _RATE = 1.001, 2**16 - 2, 20.0
ROWS_IN_BAND = 6
#: Estimates this many standard deviations below the threshold end a pair.
DEVIATIONS = 5.0
#: Hashed groups whose element counts bound intersections, and members of a block (some 300 KB). Blocks are shipped to
#: all their partners, so what M members ship is some 300 * M * M / BLOCK_ROWS bytes.
GROUPS, BLOCK_ROWS = 256, 1024
_LIST = pa.list_(pa.int64())


def bands_for(similarity: float, miss: float = 1e-6) -> int:
    """Bands of ROWS_IN_BAND registers that miss a pair at ``similarity`` with at most this probability."""
    return math.ceil(math.log(miss) / math.log(1 - similarity**ROWS_IN_BAND))


@functools.cache
def _constants(m: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20210101)
    return draw.integers(0, 2**64, m, np.uint64), draw.integers(0, 2**63, m, np.uint64) * np.uint64(2) + np.uint64(1)


def registers(hashes: np.ndarray, m: int) -> np.ndarray:
    """m SetSketch registers (uint16) of a set given by 64-bit hashes; all 0 for the empty set."""
    if not len(hashes):
        return np.zeros(m, np.uint16)
    xors, factors = _constants(m)
    least = np.full(m, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), 512):
        part = (hashes[at : at + 512, None] ^ xors) * factors
        np.minimum(least, part.min(0), out=least)
    uniform = (least.astype(np.float64) + 0.5) / 2.0**64
    smallest = -np.log1p(-np.minimum(uniform, 1 - 2.0**-53)) / _RATE
    return np.clip(np.floor(1 - np.log(smallest) / math.log(BASE)), 0, Q + 1).astype(np.uint16)


def band_keys(regs: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key a band, different for different bands."""
    rows = regs[: bands * ROWS_IN_BAND].reshape(bands, ROWS_IN_BAND).astype(np.uint64)
    key = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(ROWS_IN_BAND):
        key = finish(key ^ (rows[:, k] + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F))
    return key


def _collide(x: np.ndarray) -> np.ndarray:
    """p_b(x) = -log_b(1 - x (b - 1) / b)."""
    return -np.log1p(-x * (BASE - 1) / BASE) / math.log(BASE)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Joint maximum-likelihood Jaccard of pairs of sketches (pairs x m) of sets of known sizes.

    With u and v the shares of the sizes, a register of the first is greater with probability p_b(u - v J), less with
    p_b(v - u J), else equal; the log-likelihood is concave in J and its maximum is found by golden section."""
    m = a.shape[1]
    more, less = (a > b).sum(1), (a < b).sum(1)
    equal = m - more - less
    u = n_a / (n_a + n_b)
    v = 1 - u
    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)

    def likelihood(j: np.ndarray) -> np.ndarray:
        p, q = _collide(np.maximum(u - v * j, 1e-12)), _collide(np.maximum(v - u * j, 1e-12))
        return more * np.log(p) + less * np.log(q) + equal * np.log(np.maximum(1 - p - q, 1e-12))

    ratio = (math.sqrt(5) - 1) / 2
    for _ in range(30):
        x, y = high - ratio * (high - low), low + ratio * (high - low)
        left = likelihood(x) >= likelihood(y)
        high, low = np.where(left, y, high), np.where(left, low, x)
    return (low + high) / 2


def sketch(docs: DataFrame, words: Callable[[bytes | None], list[bytes]], shingle: int, bands: int) -> DataFrame:
    """doc_id, n (set size), two 64-bit hashes of the whole set, and a key for each band."""

    def make():
        def each(batch: pa.RecordBatch):
            return map(sketch_of, slices(batch))

        def sketch_of(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingle_set(words(t), shingle) for t in texts(batch)]
            keys = [band_keys(registers(s, bands * ROWS_IN_BAND), bands).view(np.int64) if len(s) else None for s in sets]
            whole = [[int(finish(s * f).sum(dtype=np.uint64).view(np.int64)) for s in sets] for f in (np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0xAEF17502108EF2D9))]
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(h, pa.int64()) for h in whole), pa.array(keys, _LIST)], ["doc_id", "n", "h1", "h2", "bands"]
            )

        return each

    return map_batches(docs.select("doc_id", "text"), make, f"doc_id {_kind(docs)}, n long, h1 long, h2 long, bands array<long>")


def _kind(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def _sets(docs: DataFrame, words: Callable[[bytes | None], list[bytes]], shingle: int, bands: int) -> DataFrame:
    """doc_id, n, registers, the full set as sorted hashes, and how many of them are in each of ``GROUPS`` groups."""

    def make():
        def each(batch: pa.RecordBatch):
            return map(sets_of, slices(batch))

        def sets_of(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingle_set(words(t), shingle) for t in texts(batch)]
            regs = [registers(s, bands * ROWS_IN_BAND).tobytes() for s in sets]
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(regs, pa.binary()), pa.array([s.view(np.int64) for s in sets], _LIST), pa.array(map(_group_counts, sets), pa.binary())],
                ["doc_id", "n", "regs", "shingles", "counts"],
            )

        return each

    return map_batches(docs.select("doc_id", "text"), make, f"doc_id {_kind(docs)}, n long, regs binary, shingles array<long>, counts binary")


def _group_counts(hashes: np.ndarray) -> bytes:
    """One byte a group, or four where a group holds more than a byte counts."""
    counts = np.bincount((hashes % np.uint64(GROUPS)).astype(np.int64), minlength=GROUPS)
    return counts.astype(np.uint8 if counts.max() < 256 else np.int32).tobytes()


def _possible(n_a: Column, n_b: Column, most: Column, percent: int) -> Column:
    """Whether sets of n elements that share ``most`` at best can reach the similarity."""
    return 100 * most >= percent * (n_a + n_b - most)


def _reachable(work: Workspace, members: DataFrame, percent: int) -> DataFrame:
    """Leaves out members that can't be linked with any other component of their bucket, whatever the partner.

    A member that shares ``common`` at best reaches partners of up to common * (100 + percent) / percent - n elements.
    Each bucket keeps the smallest size and the furthest reach of its components and of the next best one, so that a
    member is held against other components only."""
    reach = F.floor(F.col("common") * (100 + percent) / percent).cast("long") - F.col("n")
    members = members.withColumn("reach", reach)
    per = work.write(members.groupBy("key", "component").agg(F.min("n").alias("low"), F.max("reach").alias("high"), F.count("*").alias("size")), "per-component")
    best = per.groupBy("key").agg(F.min(F.struct("low", "component")).alias("l"), F.max(F.struct("high", "component")).alias("h"), F.max(F.struct("size", "component"))["component"].alias("main"))
    best = work.write(best.select("key", "main", F.col("l.low").alias("low1"), F.col("l.component").alias("c_low"), F.col("h.high").alias("high1"), F.col("h.component").alias("c_high")), "best")
    other = lambda c, of: F.when(F.col("component") != F.col(of), F.col(c))
    both = per.join(best, "key").groupBy("key").agg(F.min(other("low", "c_low")).alias("low2"), F.max(other("high", "c_high")).alias("high2"))
    both = members.join(best, "key").join(work.write(both, "next-best"), "key")
    low = F.when(F.col("component") == F.col("c_low"), F.col("low2")).otherwise(F.col("low1"))
    high = F.when(F.col("component") == F.col("c_high"), F.col("high2")).otherwise(F.col("high1"))
    return both.filter((low <= F.col("reach")) & (F.col("n") <= high)).select("key", "doc_id", "n", "component", (F.col("component") == F.col("main")).alias("main"))


def _matrix(counts: list[bytes]) -> np.ndarray:
    """Group counts of the members of a block, as narrow as they all allow."""
    if all(len(c) == GROUPS for c in counts):
        return np.frombuffer(b"".join(counts), np.uint8).reshape(-1, GROUPS)
    return np.stack([np.frombuffer(c, np.uint8 if len(c) == GROUPS else np.int32).astype(np.int32) for c in counts])


def possible_pairs(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int, same: bool = False) -> np.ndarray:
    """Which members of two blocks may be linked: their group counts bound every intersection. In a block that meets itself
    (``same``) each two members are held against each other once."""
    out = np.zeros((len(a), len(b)), bool)
    for k in range(len(a)):
        at = np.arange(k + 1 if same else 0, len(b))
        at = at[100 * np.minimum(n_a[k], n_b[at]) >= percent * np.maximum(n_a[k], n_b[at])]  # sizes alone bound them too
        most = np.minimum(a[k], b[at]).sum(1, dtype=np.int64)
        out[k, at] = 100 * most >= percent * (n_a[k] + n_b[at] - most)
    return out


def _block_pairs(work: Workspace, members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b of the pairs of each bucket that are in different components and pass the bound of their group counts.

    Linked sets are at most one length class apart."""
    kind = members.schema["doc_id"].dataType.simpleString()
    length = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent)).cast("int")
    members = members.withColumn("length", length)
    shape = members.groupBy("key", "main", "length").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    shape = work.write(shape, "block-shape")
    dealt = members.join(shape, ["key", "main", "length"]).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    dealt = dealt.join(sets.select("doc_id", "counts"), "doc_id")
    at = ["key", "main", "length", "block"]
    blocks = work.write(dealt.groupBy(*at).agg(F.collect_list(F.struct("doc_id", "n", "component", "counts")).alias("rows")), "blocks")

    of = lambda side: shape.select("key", *(F.col(c).alias(f"{c}_{side}") for c in ("main", "length", "blocks")))
    both = of("a").filter("not main_a").join(of("b"), "key").filter("abs(length_a - length_b) <= 1")
    each = lambda side: F.explode(F.sequence(F.lit(0), F.col(f"blocks_{side}") - 1)).alias(f"block_{side}")
    both = both.select("*", each("a")).select("*", each("b"))
    both = both.filter("main_b or length_a < length_b or (length_a = length_b and block_a <= block_b)")
    both = work.write(both.select("key", "main_a", "length_a", "block_a", "main_b", "length_b", "block_b"), "block-pairs")
    held = lambda side: blocks.select("key", *(F.col(c).alias(f"{c}_{side}") for c in at[1:]), F.col("rows").alias(f"rows_{side}"))
    # a block meets itself where it lies; only other pairs are shipped
    itself = (F.col("main_a") == F.col("main_b")) & (F.col("length_a") == F.col("length_b")) & (F.col("block_a") == F.col("block_b"))
    alone = blocks.filter("not main").select(F.col("rows").alias("rows_a"), F.lit(None).cast(blocks.schema["rows"].dataType).alias("rows_b"))
    met = both.filter(~itself).join(held("a"), ["key", "main_a", "length_a", "block_a"]).join(held("b"), ["key", "main_b", "length_b", "block_b"])

    def make():
        def each(batch: pa.RecordBatch):
            for k in range(batch.num_rows):
                a, b = (batch.column(c)[k].values for c in ("rows_a", "rows_b"))
                same = b is None
                b = a if same else b
                n_a, n_b = (x.field("n").to_numpy(zero_copy_only=False) for x in (a, b))
                found = possible_pairs(*(_matrix(x.field("counts").to_pylist()) for x in (a, b)), n_a, n_b, percent, same)
                i, j = (pa.array(x) for x in np.nonzero(found))
                yield pa.RecordBatch.from_arrays([a.field("doc_id").take(i), b.field("doc_id").take(j), a.field("component").take(i), b.field("component").take(j)], ["a", "b", "c_a", "c_b"])

        return each

    found = map_batches(met.select("rows_a", "rows_b").unionByName(alone), make, f"a {kind}, b {kind}, c_a {kind}, c_b {kind}").filter("c_a <> c_b")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _verify(work: Workspace, pairs: DataFrame, sets: DataFrame, percent: int, bands: int, name: str) -> DataFrame:
    """a, b, shared (size of the intersection) and linked, by the full sets, of the pairs that are not estimated far below the similarity."""
    least = percent / 100 - DEVIATIONS * math.sqrt(0.25 / (bands * ROWS_IN_BAND))

    def make():
        def each(batch: pa.RecordBatch):
            if not batch.num_rows:
                return
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in ("regs_a", "regs_b"))
            n_a, n_b = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("n_a", "n_b"))
            yield batch.select(["a", "b"]).filter(pa.array(estimate(a, b, n_a, n_b) >= least))

        return each

    kind = pairs.schema["a"].dataType.simpleString()
    slim = sets.select("doc_id", "n", "regs")
    side = lambda s: slim.select(F.col("doc_id").alias(s), F.col("n").alias(f"n_{s}"), F.col("regs").alias(f"regs_{s}"))
    near = work.write(map_batches(pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "regs_a", "regs_b"), make, f"a {kind}, b {kind}"), f"{name}-near")
    full = lambda s: sets.select(F.col("doc_id").alias(s), F.col("shingles").alias(f"set_{s}"))
    both = near.join(full("a"), "a").join(full("b"), "b")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - shared
    return work.write(both.select("a", "b", shared.alias("shared"), (100 * shared >= percent * union).alias("linked")), f"{name}-verified")


def near_duplicates(docs: DataFrame, words: Callable[[bytes | None], list[bytes]], shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, one row for each row of ``docs``.

    Documents are linked if 100 * |A & B| >= percent * |A | B|; component_id is the least doc_id that links reach."""
    bands = bands_for(percent / 100)
    work, scratch = (Workspace(docs.sparkSession, name) for name in ("near-dedup", "near-dedup-scratch"))
    sketches = work.write(sketch(docs, words, shingle, bands), "sketches")
    some = sketches.filter("n > 0 and doc_id is not null")
    classes = work.write(some.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("n").alias("n"), F.count("*").alias("copies")), "classes")

    keyed = classes.select("rep", "n", F.explode("bands").alias("key"))
    shared = scratch.write(keyed.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1").select("key"), "shared-keys")
    members = scratch.write(keyed.join(shared, "key").select("key", F.col("rep").alias("doc_id"), "n"), "members")
    candidates = scratch.write(members.select("doc_id").distinct(), "candidates")
    sets = scratch.write(_sets(docs.join(candidates, "doc_id", "left_semi"), words, shingle, bands), "sets")

    elements = sets.select("doc_id", F.explode("shingles").alias("h"))
    alone = elements.groupBy("h").agg(F.count("*").alias("owners"), F.first("doc_id").alias("doc_id")).filter("owners = 1")
    private = alone.groupBy("doc_id").agg(F.count("*").alias("private"))
    bound = sets.select("doc_id", "n").join(private, "doc_id", "left").select("doc_id", (F.col("n") - F.coalesce("private", F.lit(0))).alias("common"))
    bound = scratch.write(bound, "bound")
    open_ = members.join(bound, "doc_id").filter(100 * F.col("common") >= percent * F.col("n"))
    open_ = scratch.write(open_, "open-members")

    # the centre holds the most that others have, less what only it has
    best = F.min(F.struct((F.col("n") - 2 * F.col("common")).alias("rank"), "doc_id", "n", "common")).alias("c")
    centre = open_.groupBy("key").agg(best, F.count("*").alias("members")).filter("members > 1")
    centre = scratch.write(centre.select("key", F.col("c.doc_id").alias("centre"), F.col("c.n").alias("n_c"), F.col("c.common").alias("common_c")), "centres")
    first = open_.join(centre, "key").filter(F.col("doc_id") != F.col("centre")).filter(_possible(F.col("n"), F.col("n_c"), F.least("common", "common_c"), percent))
    first = scratch.write(first.select(F.least("centre", "doc_id").alias("a"), F.greatest("centre", "doc_id").alias("b")).distinct(), "first-pairs")
    met = _verify(scratch, first, sets, percent, bands, "first")
    links = met.filter("linked").select("a", "b")

    group = components(scratch, links, "first-components")
    labelled = open_.join(group.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    labelled = scratch.write(labelled, "labelled")
    split = scratch.write(labelled.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most")).filter("least <> most").select("key"), "split-keys")
    left = labelled.join(split, "key").join(centre.select("key", "centre"), "key", "left").filter("doc_id <> centre")
    left = scratch.write(left.select("key", "doc_id", "n", "common", "component"), "left")
    reachable = scratch.write(_reachable(scratch, left, percent), "reachable")
    rest = scratch.write(_block_pairs(scratch, reachable, sets, percent).join(first, ["a", "b"], "left_anti"), "rest-pairs")
    links = links.unionByName(_verify(scratch, rest, sets, percent, bands, "rest").filter("linked").select("a", "b"))
    # one document may have several texts: its classes belong together
    ids = some.select("doc_id", "h1", "h2").distinct()
    reps = classes.select("h1", "h2", "rep")
    several = ids.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    own = ids.join(several, "doc_id", "left_semi").join(reps, ["h1", "h2"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    group = components(work, links.unionByName(own), "components")
    delete_path(docs.sparkSession, scratch.path)

    # classes of one document need no join: their representative is the document itself
    copied = classes.filter("copies > 1").select("h1", "h2", "rep")
    out = sketches.select("doc_id", "n", "h1", "h2").join(copied, ["h1", "h2"], "left")
    out = out.withColumn("rep", F.when((F.col("n") == 0) | F.col("doc_id").isNull() | F.col("rep").isNull(), F.col("doc_id")).otherwise(F.col("rep")))
    out = out.join(group.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component_id", F.coalesce("component", "rep"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


#: Ids that are sent to every task at most; beyond it Spark joins them with the texts.
MAX_SENT_IDS = 2_000_000


def deduplicated(docs: DataFrame, words: Callable[[bytes | None], list[bytes]], shingle: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of near-duplicates, that of the least doc_id; columns stay as they are.

    Of several rows with one doc_id the one whose text and other columns have the least hash stays. Rows without a doc_id
    all stay."""
    work = Workspace(docs.sparkSession, "deduplicated")
    judged = near_duplicates(docs, words, shingle, percent).filter(F.col("doc_id").isNotNull())
    per_id = work.write(judged.groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("rows")), "ids")
    # texts stay where they are as long as the ids that are no plain row fit into every task
    other = per_id.filter("not kept or rows > 1")
    small = other.count() <= MAX_SENT_IDS
    sent = F.broadcast if small else lambda ids: ids
    plain = docs.join(sent(other.select("doc_id")), "doc_id", "left_anti")  # rows without an id are among them
    columns = [F.col(f"`{c}`") for c in docs.columns]
    hashed = [c for c, f in zip(columns, docs.schema.fields, strict=True) if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    row = F.min_by(F.struct(*columns), F.struct(F.xxhash64("text"), F.xxhash64(*hashed))).alias("row")
    several = docs.join(sent(other.filter("kept").select("doc_id")), "doc_id", "left_semi").groupBy("doc_id").agg(row).select("row.*")
    return plain.select(*columns).unionByName(several.select(*columns))
