"""Trigram search and distinct sketches."""

import random

import pytest
from pyspark.sql import functions as F

from trackengine.operators import search_index, sketches
from trackengine.sources import scratch


def test_search_equals_contains(spark, tmp_path):
    draw = random.Random(5)
    alphabet = "abcä% _\\漢"
    texts = [(k, "".join(draw.choice(alphabet) for _ in range(draw.randrange(0, 14)))) for k in range(800)] + [(900, "aaaa"), (901, "needle in hay"), (None, "aaaa"), (902, None), (903, "")]
    index = search_index.TrigramIndex.build(spark.createDataFrame(texts, "k long, t string"), f"file://{tmp_path}/i", "k", "t")
    known = [t for _, t in texts if t]
    sought = ["", "a", "ab", "aaa", "aaaa", "needle", "needles", "zzz", "%__", "_a", "漢漢", "ä% "] + [t[a : a + n] for t in draw.sample(known, 38) for a, n in [(draw.randrange(len(t)), draw.randrange(1, 7))]]
    assert len(set(sought)) >= 40
    got = sorted(map(tuple, index.find(sought).collect()))
    assert got == sorted((s, k) for s in set(sought) for k, t in texts if k is not None and t is not None and s in t)
    long = [s for s in set(sought) if len(s) >= 3]
    found = index.candidates(long)
    hits = sum(s in t for s in long for k, t in texts if k is not None and t)
    assert hits <= found.count() < hits * 1.2 + 20 < len(long) * 800 / 10  # texts that are looked into
    plan = index._read("postings", ["aaa"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [folder" in plan.replace("isnotnull(folder#", "folder#") or "folder#" in plan.split("PartitionFilters: [")[1][:80]
    assert "PushedFilters: [IsNotNull(gram)" in plan or "gram" in plan.split("PushedFilters: [")[1][:80]


def test_search_in_no_texts(spark, tmp_path):
    index = search_index.TrigramIndex.build(spark.createDataFrame([(1, "abc")], "k long, t string"), f"file://{tmp_path}/i", "k", "t")
    assert index.find(["xyz", "ab" * 3]).collect() == [] and index.find([]).collect() == []


def test_sketches_of_partitions(spark, tmp_path):
    path, columns = f"file://{tmp_path}/s", ["id", "few"]
    rows = spark.range(30_000).selectExpr("id", "id % 100 as few", "cast(2000 + id % 3 as int) as year", "if(id % 7 = 0, null, id) as some")
    sketches.add(spark, path, rows.filter("year < 2002"), "year", columns)
    before = {n: scratch.names_in(spark, f"{path}/{n}") for n in scratch.names_in(spark, path) if n.startswith("of=")}
    sketches.add(spark, path, rows.filter("year = 2002"), "year", columns)  # reads and writes this year only
    after = {n: scratch.names_in(spark, f"{path}/{n}") for n in scratch.names_in(spark, path) if n.startswith("of=")}
    assert sorted(after) == ["of=2000", "of=2001", "of=2002"] and all(after[n] == before[n] for n in before)
    for years, n in ((None, 30_000), ([2000, 2002], 20_000), ([2001], 10_000)):
        (r,) = sketches.distinct_counts(spark, path, columns, years).collect()
        assert r["rows"] == n and abs(r["id"] - n) <= n * sketches.relative_error() and abs(r["few"] - 100) <= 2
    # a partition that is written again counts once
    sketches.add(spark, path, rows.filter("year = 2001 and id < 300"), "year", columns)
    assert sketches.distinct_counts(spark, path, columns).first()["rows"] == 20_100
    sketches.forget(spark, path, 2001)
    assert sketches.distinct_counts(spark, path, columns).first()["rows"] == 20_000
    gate = {r["column"]: (r["exact"], r["within"]) for r in sketches.count_gate(sketches.distinct_counts(spark, path, columns), sketches.exact_counts(rows.filter("year <> 2001"), columns), columns).collect()}
    assert gate == {"id": (20_000, True), "few": (100, True)}
    wrong = sketches.distinct_counts(spark, path, columns, [2000])
    assert not sketches.count_gate(wrong, sketches.exact_counts(rows, columns), columns).filter("column = 'id'").first()["within"]
    assert sketches.sketch(rows, "year", ["some"]).count() == 3
    assert sketches.distinct_counts(spark, path, columns, [1990]).first()["rows"] == 0


@pytest.mark.parametrize("text", ["", "ab", "abc", "aaaa", "漢字漢字"])
def test_trigrams(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(search_index.trigrams(F.col("t")).alias("g")).first()["g"]
    assert sorted(got) == sorted({text[k : k + 3] for k in range(len(text) - 2)})


def made_numbers(spark, n):
    return spark.range(n).selectExpr("id as k", "concat('lps ', id * 7919 % 100003, ' ', id) as t")


def test_many_sought_make_no_row_for_each_posting(spark, tmp_path):
    """3,000 texts are sought in 9,000: the join of postings with sought texts had a row for each pair that shares a trigram."""
    rows = made_numbers(spark, 9_000)
    index = search_index.TrigramIndex.build(rows, f"file://{tmp_path}/i", "k", "t")
    assert spark.read.parquet(f"{index.path}/postings").count() < 30 * 1_200  # a trigram and block, where a text had some 14
    sought = [r["s"] for r in rows.filter("k % 3 = 1").selectExpr("substr(t, 4, 7) as s").collect()]
    texts = [tuple(r) for r in rows.collect()]
    want = sorted((s, k) for s in set(sought) for k, t in texts if s in t)
    got = index.find(spark.createDataFrame([(s,) for s in sought], "any string"))
    assert sorted(map(tuple, got.collect())) == want == sorted(map(tuple, index.find(sought).collect()))


def test_small_blocks_and_pieces(spark, tmp_path, monkeypatch):
    """Texts of a block in several pieces, more different characters than one number holds, and more trigrams than are named."""
    import pyarrow as pa

    texts = ["", "ab", "abc", "aaaa", "漢字漢字", "x😀y😀y", "", "abc", "字漢字漢"]
    want = {(t[k : k + 3], j) for j, t in enumerate(texts) for k in range(len(t) - 2)}
    for size, most in ((1 << 30, 2**63 - 1), (1, 2**63 - 1), (1 << 30, 3_000)):
        monkeypatch.setattr(search_index, "BYTES", size)
        monkeypatch.setattr(search_index, "MOST", most)
        batch = pa.RecordBatch.from_arrays([pa.array(range(65_530, 65_539)), pa.array(texts)], ["row", "text"])
        out = [r for b in search_index._postings(iter([batch])) for r in b.to_pylist()]
        got = [(r["gram"], (r["block"] << 16) + int.from_bytes(r["places"][k : k + 2], "little") - 65_530) for r in out for k in range(0, len(r["places"]), 2)]
        assert len(got) == len(set(got)) and set(got) == want
    monkeypatch.setattr(search_index, "FEW", 2)
    index = search_index.TrigramIndex.build(spark.createDataFrame(list(enumerate(texts)), "k long, t string"), f"file://{tmp_path}/i", "k", "t")
    sought = ["abc", "aaa", "字漢字", "😀y", "b", "", "xyz", "字漢字漢"]
    assert sorted(map(tuple, index.find(sought).collect())) == sorted((s, k) for s in sought for k, t in enumerate(texts) if s in t)
