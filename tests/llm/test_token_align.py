"""Token alignment against a brute-force version that knows neither matrices nor groups of equal ids."""

import functools
import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from trackengine.llm import common, queries, token_align

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = [None, "", " ", "\n", "a", "  a  b  ", "x ▁ y", "▁", "<|endoftext|> and <s> </s> <unk> <0x41>", "漢字 日本 ☃☃ 😀 é", "ab\x00c​﻿", "ﬁ ǆ İ", "z" * 5_000, "a b " * 3_000, "aab" * 2_000, "same text twice", "same text twice"]


@functools.cache
def byte_of():
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def spelled_a(whole, k):
    table = byte_of()
    return bytes(table[c] for c in whole.id_to_token(k))


def spelled_b(whole, k):
    piece = whole.id_to_piece(k)
    return bytes([int(piece[3:5], 16)]) if whole.is_byte(k) else piece.replace("▁", " ").encode()


def brute_force(texts):
    a_whole, b_whole = Tokenizer.from_file(queries.BYTE_BPE), SentencePieceProcessor(model_file=queries.PIECE_BPE)
    a_whole.encode_special_tokens = True
    groups, held = [], defaultdict(set)
    for d, text in enumerate(texts):
        groups.append([])
        if not text:
            continue
        a, b = a_whole.encode(" " + text, add_special_tokens=False).ids, b_whole.encode(text)
        cut = []
        for ids, spell, whole in ((a, spelled_a, a_whole), (b, spelled_b, b_whole)):
            ends, at, joined = [], 0, b""
            for k in ids:
                joined += spell(whole, k)
                ends.append(len(joined))
            cut.append((ids, ends, joined))
        if any(c[2] != f" {text}".encode() for c in cut):
            continue
        at = [0, 0]
        for end in sorted(set(cut[0][1]) & set(cut[1][1])):
            group = []
            for side in (0, 1):
                group.append([])
                while at[side] < len(cut[side][0]) and cut[side][1][at[side]] <= end:
                    group[side].append(cut[side][0][at[side]])
                    at[side] += 1
            groups[d].append(group)
            for x in set(group[0]):
                for y in set(group[1]):
                    held[x, y].add(d)
    best = defaultdict(int)
    for (x, _), docs in held.items():
        best[x] = max(best[x], len(docs))
    out = []
    for found in groups:
        links = [(x, y) for g in found for x in g[0] for y in g[1]]
        written = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in found)
        row = [sum(len(g[0]) for g in found), sum(len(g[1]) for g in found), len(found), len(links)]
        row += [sum(len(held[p]) == best[p[0]] for p in links), sum(len(held[p]) for p in links)]
        out.append((*row, hashlib.sha256(written.encode()).hexdigest() if written else ""))
    return out


@pytest.fixture(scope="module")
def aligner():
    return token_align.Aligner.load(queries.BYTE_BPE, queries.PIECE_BPE)


def test_query_matches_brute_force(spark):
    docs = common.table(spark, SF, "documents").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op11_token_alignment(spark, SF).select(COLUMNS).collect()}
    assert got == {d["doc_id"]: want for d, want in zip(docs, brute_force([d["text"] for d in docs]), strict=True)}


@pytest.mark.parametrize("head", [0, 40, 10_000_000])
def test_odd_texts_and_rare_pairs(spark, aligner, head):
    rows = [(None if k == 3 else k % 14, t, "x", k, [k]) for k, t in enumerate(ODD)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_a string, row int, pairs array<int>").repartition(3)
    out = token_align.align(frame, aligner, head=head)
    assert out.columns == COLUMNS
    want = [((None if k == 3 else k % 14), *w) for k, w in enumerate(brute_force(ODD))]
    assert Counter(map(tuple, out.collect())) == Counter(want)
    assert [w for w in want if w[4] == 0 and w[-1] == ""], "texts without tokens"


def test_empty_table(spark, aligner):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert token_align.align(empty, aligner).collect() == [] and token_align.alignments(empty, aligner).collect() == []


def test_row_products_match_dense_ones():
    rng = np.random.default_rng(5)
    for block in (1, 7, 1000):
        left, right = rng.integers(0, 3, (13, 9)), rng.integers(0, 3, (9, 11))
        left[4] = 0

        def rows(dense):
            r, c = np.nonzero(dense)
            return token_align.Csr(np.searchsorted(r, np.arange(len(dense) + 1)), c, dense[r, c])

        got = np.zeros((13, 11), int)
        for r, c, v in token_align.gustavson(rows(left), rows(right), 11, block):
            got[r, c] += v
        assert (got == left @ right).all()


def test_overlaps_and_groups_of_alignments(spark, aligner):
    ready = aligner.ready()
    rows = [r for r in token_align.alignments(spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string"), aligner).collect()]
    assert len(rows) == len(ODD)
    for r in rows:
        want = set()
        a_at = np.cumsum([0, *(len(ready.a.bytes[k]) for k in r["a_ids"])])
        b_at = np.cumsum([0, *(len(ready.b.bytes[k]) for k in r["b_ids"])])
        j = 0
        for i in range(len(r["a_ids"])):
            while j and b_at[j] > a_at[i]:
                j -= 1
            while j < len(r["b_ids"]) and b_at[j] < a_at[i + 1]:
                if (n := min(a_at[i + 1], b_at[j + 1]) - max(a_at[i], b_at[j])) > 0:
                    want.add((i, j, n))
                    assert r["a_groups"][i] == r["b_groups"][j]
                j += 1
            j = min(j, len(r["b_ids"]) - 1)
        assert {tuple(o) for o in r["overlaps"]} == want


def test_ranks_give_the_ids_of_the_library(aligner):
    a = aligner.ready().a
    assert a.fast is not None
    for begin in range(1, 0x110000, 20_011):
        text = "".join(f" a{chr(c)}b 1{chr(c)}2  {chr(c)}'s" for c in range(begin, min(begin + 700, 0x110000)) if not 0xD800 <= c < 0xE000)
        assert a.encode(text) == a.whole.encode(text, add_special_tokens=False).ids
