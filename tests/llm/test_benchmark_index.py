"""The broadcast index of a benchmark against plain comparison of words, and its size."""

from __future__ import annotations

import pickle
import random

import numpy as np
import pytest

from trackengine.llm import decontaminate


def plain(items, window, doc):
    """Whether each word is hit, and the items that occur."""
    hit, found = [False] * len(doc), set()
    for item, words in items:
        size = min(window, len(words))
        for k in range(len(words) - size + 1 if words else 0):
            for p in range(len(doc) - size + 1):
                if doc[p : p + size] == words[k : k + size]:
                    found.add(item)
                    hit[p : p + size] = [True] * size
    return hit, sorted(found)


@pytest.mark.parametrize("candidates", [1, 5, decontaminate.CANDIDATES])
def test_index_equals_plain_comparison(candidates, monkeypatch):
    monkeypatch.setattr(decontaminate, "CANDIDATES", candidates)
    r = random.Random(candidates)
    for _ in range(120):
        vocabulary, window = [b"w%d" % k for k in range(r.choice([2, 4, 30]))], r.choice([1, 2, 3, 4, 5, 7, 10])
        items = [(f"i{r.randrange(8)}", r.choices(vocabulary, k=r.randrange(18))) for _ in range(r.randrange(8))]
        index = decontaminate.Index(items, window)
        index.order({s: np.array([r.randrange(4) for _ in index.keys[s]], np.int64) for s in index.sizes})
        index = pickle.loads(pickle.dumps(index))
        docs = [r.choices([*vocabulary, b"other"], k=r.randrange(40)) for _ in range(5)] + [[w for _, words in items for w in words]]
        for doc in docs:
            spans, found = index.hits(doc)
            hit = [any(s["start"] <= k < s["end"] for s in spans) for k in range(len(doc))]
            assert (hit, found) == plain(items, window, doc)
            assert all(a["end"] < b["start"] for a, b in zip(spans, spans[1:], strict=False))


def test_a_window_is_found_by_its_rarest_shingle():
    words = [b"a", b"b", b"c", b"d", b"e"]
    index = decontaminate.Index([("x", words)], 10)
    frequency = np.full(3, 9, np.int64)
    frequency[np.searchsorted(index.keys[3], decontaminate._shingles(index.numbers(words), 3, index.base)[1])] = 2
    index.order({3: frequency})
    assert index.prefix_offset[3].tolist() == [1]


def test_index_of_the_largest_benchmark_is_small():
    items = [(f"item-{k}", [b"word%d" % (100 * k + n) for n in range(100)]) for k in range(5000)]  # 500,000 words, none twice
    index = decontaminate.Index(items, 10)
    index.order({s: np.zeros(len(index.keys[s]), np.int64) for s in index.sizes})
    assert len(index.start) == 5000 * 91
    arrays = [index.words, index.start, index.length, index.owner, index.owner_at]
    arrays += [a[3] for a in (index.prefix_keys, index.prefix_at, index.prefix_window, index.prefix_offset)]
    assert sum(a.nbytes for a in arrays) < 40_000_000 and len(pickle.dumps(index)) < 40_000_000
    spans, found = index.hits([b"other", *items[7][1][20:40], b"other", *items[9][1][:9]])
    assert spans == [{"start": 1, "end": 21}] and found == ["item-7"]


def test_a_passage_of_many_items_repeated_in_one_document():
    same = [b"s%d" % k for k in range(10)]
    items = [(f"i{k:03}", [b"own%d" % k, *same, b"end%d" % k]) for k in range(300)]
    index = decontaminate.Index(items, 10)
    index.order({s: np.zeros(len(index.keys[s]), np.int64) for s in index.sizes})
    spans, found = index.hits([*same, b"x"] * 50)
    assert len(spans) == 50 and found == [i for i, _ in items]
