import hashlib
import heapq
import itertools
import re
import zlib

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from pairsift.llm import turns as C
from pairsift.llm.queries import op11_conversation_repair

from .data import FOLDER, SMALL, have_tables

GOOD = re.compile("(s?(ua)+)?")
BLANK = re.compile(r"[^\x20\x09-\x0D]")


def edits(rows):
    """Cheapest (cost, audit, turns) of [(role, text, fault)] over every string of edits."""
    best = None
    ways = []
    for role, text, fault in rows:
        one = [(4, "D", None)]
        if fault not in ("blank", "duplicate"):
            extra = 3 * (fault == "truncated")
            one.append((extra, "K", (role, text)))
            one += [(3 + extra, "R", (r, text)) for r in ("user", "assistant")]
        ways.append(one)
    gaps = [[()] + [(r,) for r in ("user", "assistant")] + [("user", "assistant")] for _ in range(len(rows) + 1)]
    for chosen in itertools.product(*ways):
        for put in itertools.product(*gaps):
            cost, audit, out = 0, "", []
            for k in range(len(rows) + 1):
                for r in put[k]:
                    cost, audit = cost + 3, audit + "I"
                    out.append((r, ""))
                if k < len(rows):
                    cost, audit = cost + chosen[k][0], audit + chosen[k][1]
                    if chosen[k][2]:
                        out.append(chosen[k][2])
            if (best is None or (cost, audit) < best[:2]) and GOOD.fullmatch("".join(r[:1] or "?" for r, _ in out)):
                best = (cost, audit, out)
    return best


def search(rows):
    """The same by best-first search over (cost, audit), for longer conversations."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, last, out = heapq.heappop(heap)
        if i > len(rows):
            return cost, audit, list(out)
        if (i, last) in done:
            continue
        done.add((i, last))
        if i == len(rows) and last in ("", "a"):
            heapq.heappush(heap, (cost, audit, i + 1, last, out))
        put = ("assistant", "") if last == "u" else ("user", "")
        heapq.heappush(heap, (cost + 3, audit + "I", i, put[0][0], (*out, put)))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, last, out))
            if fault not in ("blank", "duplicate"):
                for new, price, letter in ((role, 0, "K"), ("user", 3, "R"), ("assistant", 3, "R")):
                    head = new[:1]
                    if last + head in ("s", "u", "su", "ua", "au") and head:
                        heapq.heappush(heap, (cost + price + 3 * (fault == "truncated"), audit + letter, i + 1, head, (*out, (new, text))))
    return None


def plain(rows):
    """Report of [(turn, role, text)] in order."""
    seen, marked = set(), []
    for _, role, text in rows:
        last = BLANK.findall(text)
        fault = "blank" if not last else "duplicate" if (role, text) in seen else "" if last[-1] in ".!?" else "truncated"
        seen.add((role, text))
        marked.append((role, text, fault))
    turns = [t for t, _, _ in rows if t is not None]
    heads = [r[:1] for r, _, _ in marked]
    cost, audit, out = search(marked)
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        *[sum(f == k for _, _, f in marked) for k in ("blank", "duplicate", "truncated")],
        sum(a + b not in ("su", "ua", "au") for a, b in zip(heads, heads[1:])),
        cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest(),
    )


ROLE = st.sampled_from(["user", "assistant", "system", "tool", ""])
FAULT = st.sampled_from(["", "", "blank", "duplicate", "truncated"])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(ROLE, FAULT), max_size=3))
def test_cheapest_edits(rows):
    audit = C.Audit()
    for role, fault in rows:
        audit.add(role[:1], fault)
    want = edits([(r, "x", f) for r, f in rows])
    assert audit.finish() == want[:2] and search([(r, "x", f) for r, f in rows])[:2] == want[:2]


def test_spilled_backpointers(monkeypatch):
    def run():
        audit = C.Audit()
        for i in range(1000):
            audit.add("sua"[i * i % 3], ["", "blank", "truncated", ""][i * 7 % 4])
        return audit.finish()

    whole = run()
    monkeypatch.setattr(C, "SPOOL", 64)
    monkeypatch.setattr(C, "BLOCK", 40)
    assert run() == whole


def brute_damage(rows):
    """{conv: rows after damage, in order} of [(conv, turn, role, text)]."""
    out = {}
    for conv, turn, role, text in rows:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        mine = out.setdefault(conv, [])
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            mine += [(turn, "user" if kind == 4 else role, text)] * (1 + (kind == 3))
    return {c: sorted(m, key=lambda r: (r[0] is not None, r[0] or 0)) for c, m in out.items()}


ODD = [
    (None, 0, "user", "Hi."), (None, None, "assistant", "Yes."), (2, None, None, None), (3, 5, "user", ""), (3, 9, "user", "long " * 50_000 + "."),
    (3, 7, "tool", "x!"), (4, 2, "", "y?"), (4, 1, "system", "go."), (5, 1, "user", "A."), (5, 2, "user", "A."), (5, 3, "assistant", "B"),
]


@pytest.mark.parametrize("batch", [1, 1024])
def test_odd_rows(spark, batch):
    made = spark.createDataFrame(ODD, "conv_id long, turn long, role string, text string").withColumns(
        {"present": F.lit(0), "h1": F.lit(1), "cost": F.lit("x")})
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    got = {r.conv_id: tuple(r)[1:] for r in C.structure(C.damaged(made), present="present").collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1024)
    assert got == {c: plain(m) for c, m in brute_damage(ODD).items()}
    assert C.structure(C.damaged(made.limit(0)), present="present").count() == 0


def test_repaired_rows(spark):
    rows = [(1, 0, "user", "a."), (1, 1, "user", "b."), (2, 0, "system", "s."), (4, 0, "user", "a."), (4, 1, "user", "b."), (4, 2, "assistant", "c.")]
    made = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = C.audits(made)
    got = [tuple(r) for r in C.repaired(made, found).orderBy("conv_id", "place").collect()]
    assert {r.conv_id: (r.cost, r.audit) for r in found.collect()} == {1: (3, "KR"), 2: (4, "D"), 4: (3, "KIKK")}
    assert got == [
        (1, 0, 0, "user", "a.", "K"), (1, 1, 1, "assistant", "b.", "R"), (4, 0, 0, "user", "a.", "K"),
        (4, 1, None, "assistant", "", "I"), (4, 2, 1, "user", "b.", "K"), (4, 3, 2, "assistant", "c.", "K"),
    ]


def test_giant_conversation(spark):
    made = spark.range(60_000).selectExpr(
        "7 AS conv_id", "id AS turn", "IF(id % 2 = 0, 'user', 'assistant') AS role", "concat('t', id, '.') AS text"
    ).repartition(6)
    got = C.structure(made).collect()
    want = "\n".join(f"{'assistant' if i % 2 else 'user'}:t{i}." for i in range(60_000))
    assert len(got) == 1 and got[0].audit == "K" * 60_000 and got[0].repaired_sha256 == hashlib.sha256(want.encode()).hexdigest()


def test_one_shuffle_before_the_stream(spark):
    made = spark.createDataFrame(ODD, "conv_id long, turn long, role string, text string")
    text = C.audits(made)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1


@pytest.mark.skipif(not have_tables(), reason="no tables")
@pytest.mark.parametrize("folder", [FOLDER, SMALL])
def test_query(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = brute_damage(rows)
    got = {r.conv_id: tuple(r)[1:] for r in op11_conversation_repair(spark, folder).collect()}
    assert got.keys() == {r[0] for r in rows}
    assert all(got[c] == plain(m) for c, m in want.items())
