"""Which rows near-dedup keeps, whichever way their ids are joined."""

import random

import numpy as np
import pytest

from trackengine.llm import near_dedup
from trackengine.llm.common import lower_words


@pytest.mark.parametrize("most", [0, 1_000])
def test_one_row_of_an_id_stays(spark, monkeypatch, most):
    monkeypatch.setattr(near_dedup, "MAX_SENT_IDS", most)
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(5, text, 1), (3, text, 2), (3, "other words altogether here", 3), (3, "other words altogether here", 3), (7, "own words of seven", 4), (None, text, 5), (None, text, 5), (9, None, 6), (9, None, 7), (8, text + " x", 8)]
    out = near_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(3), lower_words)
    got = sorted((str(r["doc_id"]), r["n"]) for r in out.collect())
    assert [i for i, _ in got] == ["3", "7", "9", "None", "None"]
    assert ("7", 4) in got and ("None", 5) in got and dict(got)["9"] in (6, 7)
    again = near_dedup.deduplicated(spark.createDataFrame(rows[::-1], "doc_id long, text string, n int"), lower_words)
    assert sorted((str(r["doc_id"]), r["n"]) for r in again.collect()) == got


def test_blocks_of_a_bucket_meet_each_other_and_themselves(spark, monkeypatch):
    """Pages of one template, dealt into many small blocks, against all pairs."""
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 32)
    draw = random.Random(7)
    rows = [(k, " ".join(f"s{j}w{i}" for j in range(120) if draw.random() < 0.9 for i in range(4))) for k in range(240)]
    sets = {i: {tuple(w[k : k + 3]) for k in range(len(w) - 2)} for i, t in rows for w in [t.split()]}
    label = {i: i for i in sets}
    linked = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in linked:
            label[a] = label[b] = min(label[a], label[b])
    assert 1 < len(set(label.values())) < 240
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), lower_words, 3, 85).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == label


def test_a_block_meets_itself_once():
    draw = np.random.default_rng(2)
    m, n = draw.integers(0, 3, (40, near_dedup.GROUPS)).astype(np.uint8), None
    n = m.sum(1).astype(np.int64)
    whole, once = (near_dedup.possible_pairs(m, m, n, n, 45, same) for same in (False, True))
    assert (np.triu(whole, 1) == once).all() and once.any()
