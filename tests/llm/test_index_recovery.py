"""The fingerprint index after deliveries that fail, at the same time, or very many."""

import random

import pytest
from pyspark.sql.readwriter import DataFrameWriter

from test_llm import brute_removed, shared_passages
from trackengine.llm import common, substring_dedup

KIND = "doc_id long, text string"


def removed(index):
    return sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in index.result().collect())


def wanted(rows):
    return sorted((i, *x) for (i, _), x in zip(rows, brute_removed([t for _, t in rows]), strict=True))


class Lost(Exception):
    pass


def failing(monkeypatch, at):
    """The ``at``-th table that is written fails, before or after its files are there by turns. Returns the count."""
    written = [0]
    for name in ("parquet", "saveAsTable", "text"):

        def write(self, *a, real=getattr(DataFrameWriter, name), **b):
            written[0] += 1
            if written[0] == at and at % 2:
                raise Lost
            real(self, *a, **b)
            if written[0] == at:
                raise Lost

        monkeypatch.setattr(DataFrameWriter, name, write)
    return written


def test_a_failed_delivery_changes_nothing(spark, tmp_path):
    """Fails at each of the writes of a delivery, then delivers again on the same object or a reopened one."""
    rows = shared_passages(24)
    first, second = rows[:14], [*rows[14:], (90, rows[1][1])]
    path = f"file://{tmp_path}/index"
    substring_dedup.FingerprintIndex.create(spark, path, "bigint", buckets=2).deliver(spark.createDataFrame(first, KIND))
    index, at = substring_dedup.FingerprintIndex.open(spark, path), 0

    def files():
        return {name: common.names_in(spark, f"{path}/{name}") for name in ("", "copies", "prints", "windows", "marks", "documents")}

    before = files()
    while True:
        at += 1
        with pytest.MonkeyPatch.context() as patch:
            failing(patch, at)
            try:
                index.deliver(spark.createDataFrame(second, KIND))
                break
            except Lost:
                assert files() == before
        if at == 3:
            assert removed(index) == wanted(first)
        if at % 3 == 0:
            index = substring_dedup.FingerprintIndex.open(spark, path)
    assert at > 9  # each of the writes has failed once
    assert removed(index) == wanted([*first, *second]) == removed(substring_dedup.FingerprintIndex.open(spark, path))
    assert all(len(names) <= 2 for name, names in files().items() if name) and not [n for n in files()[""] if n.startswith("claim")]


def test_unrelated_documents_delivered_again_stay(spark, tmp_path, monkeypatch):
    draw = random.Random(1)
    rows = [(k, " ".join(f"{draw.random()}" for _ in range(60))) for k in range(20)]
    index = substring_dedup.FingerprintIndex.create(spark, f"file://{tmp_path}/index", "bigint", buckets=2)
    with monkeypatch.context() as patch:
        patch.setattr(index.prints.__class__, "met", lambda *_: (_ for _ in ()).throw(Lost()))
        with pytest.raises(Lost):
            index.deliver(spark.createDataFrame(rows, KIND))
    index.deliver(spark.createDataFrame(rows, KIND))
    assert [r["n_removed"] for r in index.result().collect()] == [0] * 20


def test_of_two_writers_one_is_refused(spark, tmp_path, monkeypatch):
    path, rows = f"file://{tmp_path}/index", shared_passages(12)
    index = substring_dedup.FingerprintIndex.create(spark, path, "bigint", buckets=2)
    other, refused = substring_dedup.FingerprintIndex.open(spark, path), []
    inner = substring_dedup.find_fingerprints

    def meanwhile(*a):
        with pytest.raises(RuntimeError, match="claim"):
            other.deliver(spark.createDataFrame(rows, KIND))
        refused.append(True)
        return inner(*a)

    with monkeypatch.context() as patch:
        patch.setattr(substring_dedup, "find_fingerprints", meanwhile)
        index.deliver(spark.createDataFrame(rows[:6], KIND))
    assert refused == [True]
    other.deliver(spark.createDataFrame(rows[6:], KIND))  # knows of the first one's delivery
    assert removed(other) == wanted(rows)
    # a driver that was lost leaves its claim and tables
    assert common.create_file(spark, other._claim())
    other._write_table(other.documents()[0])
    lost = substring_dedup.FingerprintIndex.open(spark, path)
    with pytest.raises(RuntimeError, match="recover"):
        lost.deliver(spark.createDataFrame(rows[:1], KIND))
    lost.recover()
    assert len(common.names_in(spark, f"{path}/documents")) == 2
    lost.deliver(spark.createDataFrame([(77, rows[1][1])], KIND))
    assert removed(lost) == wanted([*rows, (77, rows[1][1])])


def test_many_deliveries_make_few_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(substring_dedup, "FAN", 3)
    path, rows = f"file://{tmp_path}/index", shared_passages(20)
    index = substring_dedup.FingerprintIndex.create(spark, path, "bigint", buckets=1)
    for k, row in enumerate(rows):
        index.deliver(spark.createDataFrame([row], KIND))
        assert len(index.tables) <= 6 and len(common.names_in(spark, f"{path}/documents")) == len(index.tables)
        assert [t[1:] for t in index.tables][-1][1] == k
    assert len(index.documents()) == len(index.tables) < 7
    assert removed(index) == wanted(rows)
    assert [r["doc_id"] for r in index.result([4]).collect()] == [4]
