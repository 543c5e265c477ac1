"""Near-duplicate vectors against all pairs."""

import math
from collections import Counter

import duckdb
import numpy as np
import pytest

from trackengine.llm import embedding_dedup, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, label int, node string, key int"


def brute_force(rows, cosine=0.9):
    """(vec_id, n_links, component_id, kept) for (vec_id, vector) rows."""
    usable = []
    for k, (i, v) in enumerate(rows):
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.array(v, float) / max(abs(x) for x in v)
            usable.append((k, x / np.sqrt(x @ x)))
    linked = {k: [j for j, y in usable if j != k and len(y) == len(x) and x @ y >= cosine] for k, x in usable}
    out, root = [], {}
    for k in linked:
        if k not in root:
            seen, todo = {k}, [k]
            while todo:
                todo += (new := set(linked[todo.pop()]) - seen)
                seen |= new
            root |= dict.fromkeys(seen, min(rows[j][0] for j in seen))
    for k, (i, _) in enumerate(rows):
        component = root.get(k, i)
        out.append((i, len(linked.get(k, [])), component, i is None or component == i))
    return out


def near(rng, x, cosine):
    z = rng.normal(size=len(x))
    z -= (z @ x) * x / (x @ x)
    z *= np.sqrt((x @ x) / (z @ z))
    return cosine * x + math.sqrt(1 - cosine**2) * z


def made(rng, n, size):
    """Strangers, pairs of all similarities, tight and loose groups, and a chain."""
    out = [rng.normal(size=size) for _ in range(n)]
    out += [near(rng, out[k], rng.uniform(0.86, 0.99)) for k in range(0, n, 8)]
    for spread, many in ((0.995, 150), (0.97, 60), (0.955, 40)):
        centre = rng.normal(size=size)
        out += [near(rng, centre, spread) * rng.uniform(0.1, 9) for _ in range(many)]
    out.append(rng.normal(size=size))
    for _ in range(12):
        out.append(near(rng, out[-1], 0.93))
    return [v.tolist() for v in out]


ODD = [None, [], [0.0] * 8, [1.0] * 7 + [None], [math.nan] + [1.0] * 7, [math.inf] + [0.0] * 7, [1e-300] * 8, [1e300] * 8, [-1.0] * 8, [1.0, -0.0] * 4, [2.0, 0.0] * 4, [3.0], [5.0], [-3.0], [1.0] * 16]


@pytest.mark.parametrize(("shard", "most"), [(500, 6_000), (40, 6_000), (40, 130)])
def test_all_links_are_found(spark, monkeypatch, shard, most):
    monkeypatch.setattr(embedding_dedup, "SHARD", shard)
    monkeypatch.setattr(embedding_dedup, "MAX_SHARD", most)
    rng = np.random.default_rng(shard)
    vectors = made(rng, 300, 8) + [v for v in ODD for _ in range(2)]
    vectors += vectors[:20] + [vectors[5]] * 40  # copies
    ids = list(range(100, 100 + len(vectors)))
    rng.shuffle(ids)
    rows = [(None if k % 97 == 0 else int(i), v) for k, (i, v) in enumerate(zip(ids, vectors, strict=True))]
    rows += rows[1:9]  # the same rows again
    frame = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], SCHEMA).repartition(5)
    out = embedding_dedup.near_duplicates(frame)
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    got, want = Counter(map(tuple, out.collect())), Counter(brute_force(rows))
    assert got == want


def test_many_shards_lose_few_links(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "SHARD", 60)
    rng = np.random.default_rng(9)
    vectors = made(rng, 1_500, 64)
    rows = list(enumerate(vectors))
    frame = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], SCHEMA)
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_duplicates(frame).collect()}
    want = {i: n for i, n, _, _ in brute_force(rows)}
    assert all(got[i] <= want[i] for i in want)
    assert sum(got.values()) >= 0.97 * sum(want.values())


def test_audit_widens_the_search(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "SHARD", 20)
    rng = np.random.default_rng(2)
    vectors = [rng.normal(size=16) for _ in range(400)]
    vectors += [near(rng, v, 0.905) for v in vectors]
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)]
    frame = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], SCHEMA)
    tried, linked = [], embedding_dedup._linked
    monkeypatch.setattr(embedding_dedup, "_linked", lambda *a: tried.append(a[5:7]) or linked(*a))
    out = embedding_dedup.near_duplicates(frame, recall=0.999, overlap=1, hops=1).collect()
    assert len(tried) > 1 and tried[1] == (2, 2)
    want = sum(n for _, n, _, _ in brute_force(rows))
    assert 0.99 * want <= sum(r["n_links"] for r in out) <= want


def test_graph_reaches_every_vector():
    rng = np.random.default_rng(6)
    for x in (np.array(made(rng, 90, 12)), np.tile(rng.normal(size=12), (200, 1)) + rng.normal(size=(200, 12)) * 1e-9, rng.normal(size=(2, 3)), rng.normal(size=(1, 3))):
        x = x / np.linalg.norm(x, axis=1)[:, None]
        a, b = embedding_dedup.pruned_graph(x)
        seen, todo = {embedding_dedup.medoid(x)}, [embedding_dedup.medoid(x)]
        while todo:
            todo += (new := set(b[a == todo.pop()].tolist()) - seen)
            seen |= new
        assert seen == set(range(len(x)))
        assert len(a) <= len(x) * (2 * embedding_dedup.DEGREE + 1) + len(x)


def test_bundles_hold_near_vectors():
    x = np.array(made(np.random.default_rng(7), 200, 10))
    x /= np.linalg.norm(x, axis=1)[:, None]
    of = embedding_dedup.leaders(x, math.acos(0.9) / 2)
    assert (embedding_dedup.angles(x, x[of]) <= math.acos(0.9) / 2 + 1e-9).all() and (of[of] == of).all()
    assert (np.bincount(of) > 100).any()


def test_empty_table_and_nothing_usable(spark):
    frame = spark.createDataFrame([(1, None, 1, "x", 2), (None, [1.0], 1, "x", 2)], SCHEMA)
    assert embedding_dedup.near_duplicates(frame.limit(0)).collect() == []
    assert sorted(map(str, map(tuple, embedding_dedup.near_duplicates(frame).collect()))) == ["(1, 0, 1, True)", "(None, 0, None, True)"]


def test_query_matches_sql(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = list(enumerate([np.float32(v).tolist() for v in made(rng, 120, 64)] + [v for v in ODD if v]))
    spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    for place in (SF, str(tmp_path)):
        con.sql(f"create or replace view embeddings as select * from '{place}/embeddings.parquet{'' if place == SF else '/*.parquet'}'")
        sql = con.sql(queries.oracle_sql()["op12_embedding_duplicates"])
        query = queries.op12_embedding_duplicates(spark, place)
        assert query.columns == sql.columns
        assert sorted(map(tuple, query.collect())) == sorted(sql.fetchall())
