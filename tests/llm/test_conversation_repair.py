"""Conversation repair against the cheapest of all edit sequences, and against SQL."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from trackengine.llm import conversation_repair, queries

SF = "/root/testdata/sf0.001"
SOUND = re.compile(r"(s?(ua)+)?")
WHITE = " \t\n\x0b\x0c\r"


def faults(rows):
    """First faults of (role, text) rows."""
    out, seen = [], set()
    for role, text in rows:
        bare = text.strip(WHITE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(rows, kinds):
    """Best-first search over (cost, edits): no states of the pattern, no survivors. Returns cost, edits, repaired rows."""
    heap = [(0, "", 0, ())]
    found, limit = None, None
    while heap:
        cost, edits, at, out = heapq.heappop(heap)
        if limit is not None and cost > limit:
            break
        initials = "".join(r[:1] or "?" for r, _ in out)  # an empty role is none
        if at == len(rows) and SOUND.fullmatch(initials):
            if found is None or (cost, edits) < found[:2]:
                found, limit = (cost, edits, out), cost
            continue
        if not any(SOUND.fullmatch(initials + end) for end in ("", "a", "ua")) or edits.endswith("III"):
            continue
        for role in ("user", "assistant"):
            heapq.heappush(heap, (cost + 2, edits + "I", at, (*out, (role, ""))))
        if at < len(rows):
            role, text = rows[at]
            heapq.heappush(heap, (cost + 3, edits + "D", at + 1, out))
            if kinds[at] not in ("blank", "duplicate"):
                more = kinds[at] == "truncated"
                heapq.heappush(heap, (cost + more, edits + "K", at + 1, (*out, (role, text))))
                for new in ("user", "assistant"):
                    heapq.heappush(heap, (cost + more + 2, edits + "R", at + 1, (*out, (new, text))))
    return found


def streamed(rows, kinds):
    out = []
    r = conversation_repair.Repairer(lambda edit, role, row: out.append((edit, role, row)))
    for (role, text), kind in zip(rows, kinds, strict=True):
        r.add((None, role, text, kind), role[:1], kind in ("blank", "duplicate"), kind == "truncated")
    r.end()
    return "".join(e for e, _, _ in out), tuple((role, row[2] if row else "") for e, role, row in out if e != "D"), r


def test_every_short_conversation():
    roles, kinds = ["system", "user", "assistant", "tool"], [None, "truncated", "blank"]
    picks = [(r, k) for r in roles for k in kinds]
    cases = [[]] + [[a] for a in picks] + [[a, b] for a in picks for b in picks]
    rng = random.Random(3)
    cases += [[rng.choice(picks[:9]) if rng.random() < 0.9 else rng.choice(picks) for _ in range(rng.randint(3, 5))] for _ in range(150)]
    for case in cases:
        rows, faulty = [(r, f"t{k}") for k, (r, _) in enumerate(case)], [k for _, k in case]
        cost, edits, out = cheapest(rows, faulty)
        assert streamed(rows, faulty)[:2] == (edits, out), case


def whole_strings(rows, kinds):
    """Cost and edits by states that carry their whole edits: slow on long conversations, but simple."""
    best = {"": (0, "")}  # by last initial
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}

    def with_insertions(states):
        out = dict(states)
        for _ in range(2):
            for s, (c, t) in list(out.items()):
                n = "a" if s == "u" else "u"
                out[n] = min(out.get(n, (10**9, "")), (c + 2, t + "I"))
        return out

    for (role, _), kind in zip(rows, kinds, strict=True):
        new = {}
        for s, (c, t) in with_insertions(best).items():
            ways = [(s, c + 3, "D")]
            if kind not in ("blank", "duplicate"):
                for n in follow[s]:
                    keep = role[:1] == n
                    if keep or n != "s":
                        ways.append((n, c + (kind == "truncated") + (0 if keep else 2), "K" if keep else "R"))
            for n, cost, e in ways:
                new[n] = min(new.get(n, (10**9, "")), (cost, t + e))
        best = new
    return min(v for s, v in with_insertions(best).items() if s in ("", "a"))


def test_long_conversations_and_bounded_memory():
    rng = random.Random(4)
    for _ in range(60):
        rows = [(rng.choice(["system", "user", "assistant", "user", "assistant", "x"]), str(k)) for k in range(rng.randint(50, 120))]
        kinds = [rng.choice([None, None, None, "truncated", "blank", "duplicate"]) for _ in rows]
        assert streamed(rows, kinds)[0] == whole_strings(rows, kinds)[1]
    # ties that stay open as long as the conversation
    rows = [("assistant", str(k)) for k in range(300)]
    assert streamed(rows, [None] * 300)[0] == whole_strings(rows, [None] * 300)[1]
    # sound turns with faults in between: what is open stays short
    most, r = 0, conversation_repair.Repairer(lambda *_: None)
    for k in range(20_000):
        kind = "blank" if k % 7 == 3 else "truncated" if k % 5 == 1 else None
        role = "user" if rng.random() < 0.5 else "assistant"
        r.add((k, role, "", kind), role[:1], kind == "blank", kind == "truncated")
        most = max(most, len(r.rows))
    r.end()
    assert most < 200 and not r.rows


ROWS = [
    (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes!"), (1, 1, "assistant", "Yes!"), (1, None, "system", "Be good."),
    (2, 0, "assistant", "no end"), (2, 4, "tool", "{}"), (2, 5, None, None), (2, 9, "user", ""),
    (3, None, "user", "What?"), (3, None, None, "x."), (None, 1, "user", "lost."), (None, 1, "user", "lost."),
    (4, 2, "unknown", "kept."), (4, 3, "admin", "kept."), (5, 1, "user", " \t\n"), (6, 0, "", "no role."), (6, 1, "user", "Zwölf 漢字.   "),
]


def rebuilt(rows):
    """The query's rows by plain Python, from rows before damage."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        convs[conv] += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv, found in convs.items():
        found.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        plain, turns = [x[1:] for x in found], [x[0] for x in found if x[0] is not None]
        kinds = faults(plain)
        cost, edits, repaired = cheapest(plain, kinds)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(plain, plain[1:], strict=False))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, edits, digest)
    return out


def test_query_matches_brute_force_and_sql(spark, tmp_path):
    real = spark.read.parquet(f"{SF}/conversations.parquet")
    odd = spark.createDataFrame([(c if c is None else 1000 + 17 * k * 10 + c, t, r, x) for k in range(12) for c, t, r, x in ROWS], "conv_id long, turn long, role string, text string").distinct()
    more = odd.unionByName(odd.filter("conv_id % 3 = 0"))  # repeated rows
    real.select("conv_id", "turn", "role", "text").unionByName(more).selectExpr("conv_id", "turn", "role", "text", "1.5 as cost", "'q' as edit", "turn as place").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    rows = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    query = queries.op13_conversation_repair(spark, str(tmp_path))
    got = {r["conv_id"]: tuple(r)[1:] for r in query.collect()}
    want = rebuilt(rows)
    assert {c: (got[c], want[c]) for c in want if got.get(c) != want[c]} == {} and got.keys() == want.keys()
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet' where conv_id is not null")
    sql = con.sql(queries.oracle_sql()["op13_conversation_repair"])
    assert sql.columns == query.columns
    assert {r[0]: r[1:] for r in sql.fetchall()} == {c: r for c, r in got.items() if c is not None}


def test_operator_keeps_its_rows(spark):
    frame = spark.createDataFrame([(c, t, r, x, 1) for c, t, r, x in ROWS], "conv_id long, turn long, role string, text string, edit int")
    edits = conversation_repair.repair(frame).collect()
    by = defaultdict(list)
    for e in edits:
        assert e["place"] == len(by[e["conv_id"]])
        by[e["conv_id"]].append(e)
    assert sum(e["edit"] != "I" for e in edits) == len(ROWS)
    turns = conversation_repair.repaired(frame).orderBy("conv_id", "turn").collect()
    for conv in by:
        assert SOUND.fullmatch("".join(t["role"][:1] or "?" for t in turns if t["conv_id"] == conv))
    assert [t["turn"] for t in turns if t["conv_id"] == 1] == list(range(sum(t["conv_id"] == 1 for t in turns)))
    assert conversation_repair.repair(frame.limit(0)).collect() == []
    assert conversation_repair.audited(conversation_repair.repair(frame.limit(0))).collect() == []


@pytest.mark.parametrize("rows", [1, 3])
def test_small_batches(spark, rows):
    frame = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    want = sorted(map(str, conversation_repair.audited(conversation_repair.repair(frame)).collect()))
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        assert sorted(map(str, conversation_repair.audited(conversation_repair.repair(frame)).collect())) == want
    finally:
        spark.conf.set(name, before)
