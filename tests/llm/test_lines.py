import random

import pytest

from pairsift.llm import lines
from pairsift.llm.queries import ORACLE_SQL, op9_line_dedup

from ..compare import compare, connect
from .data import FOLDER, SMALL, have_tables, odd_documents


def brute(docs):
    """docs: [(doc_id, text)] in order, ids distinct."""
    seen, out = [], {}
    for d, text in docs:
        kept = []
        for line in text.split("\n"):
            s = set(line.lower().split())
            if not s or not any(9 * len(s & o) >= 4 * (len(s) + len(o)) for o in seen):
                kept.append(line)
            if s:
                seen.append(s)
        out[d] = "\n".join(kept)
    return out


def test_near_lines_and_crowds(spark):
    rng = random.Random(9)
    base = [" ".join(f"w{rng.randrange(60 if i % 2 else 5000)}" for _ in range(rng.randrange(1, 40))) for i in range(30)]
    docs = []
    for d in range(150):
        out = []
        for _ in range(rng.randrange(1, 6)):
            words = base[rng.randrange(30)].split()
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = f"w{rng.randrange(6000)}"
            out.append(" ".join(words) if rng.random() < 0.9 else " " * rng.randrange(3))
        docs.append((d, "\n".join(out)))
    crowd = "one two three four five six seven eight nine ten eleven twelve".split()
    for d in range(200, 320):  # a chain and a crowd: each differs from the base in up to two words
        words = list(crowd)
        words[d % 12], words[(d // 2) % 12] = f"x{d}", f"y{d % 7}"
        docs.append((d, " ".join(words)))
    got = lines.deduplicate(spark.createDataFrame(docs, "doc_id long, text string"), removed="lost").collect()
    want = brute(docs)
    assert {r.doc_id: r.text for r in got} == want
    texts = dict(docs)
    assert all(r.lost == len(texts[r.doc_id].split("\n")) - (len(r.text.split("\n")) if r.text or "\n" in r.text else 0) or r.text == "" for r in got)


def test_odd_rows(spark):
    docs = odd_documents(spark)
    got = lines.deduplicate(docs)
    assert got.columns == docs.columns and got.count() == docs.count()
    by = {}
    for r in got.collect():
        by.setdefault(r.doc_id, []).append(r.text)
    same = "the of and to in is that a be it"
    assert by[1] == [same, same] and by[10] == [""] and by[2] == [None] and by[3] == [""] and by[4] == [" \n\t "]
    assert len(by[5][0]) > 300_000 and by[6] == [""] and by[None] == ["der die und das ist nicht ein auf sich"]
    assert lines.deduplicate(docs.limit(0)).count() == 0


REPEATED = [(1, "alpha beta gamma delta eps"), (5, "alpha beta gamma delta eps"), (5, "wholly other words stand here"),
            (None, "alpha beta gamma delta eps"), (None, "nothing like the others at all")]


def test_rows_of_one_id_keep_their_own_lines(spark):
    docs = spark.createDataFrame(REPEATED, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in lines.deduplicate(docs).collect()), key=str)
    # A row without an id comes first.
    gone = {1, 5}
    assert got == sorted(((d, "" if d in gone and t.startswith("alpha") else t) for d, t in REPEATED), key=str)


def test_similar_lines_at_one_place(spark):
    """Neither of two rows of one doc_id comes first; a later line is still removed."""
    texts = [f"a b c d e f g h i {x}" for x in "jkl"]
    docs = spark.createDataFrame([(1, texts[0]), (1, texts[1]), (2, texts[2])], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in lines.deduplicate(docs).collect()) == [(1, texts[0]), (1, texts[1]), (2, "")]


@pytest.mark.skipif(not have_tables(), reason="no tables")
@pytest.mark.parametrize("folder", [FOLDER, SMALL])
def test_query(spark, folder):
    assert compare(op9_line_dedup(spark, folder), connect(folder), ORACLE_SQL["op9_line_dedup"]) is None


def test_native(spark):
    """No Python runs on the executors."""
    plan = lines.deduplicate(odd_documents(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_crowds_among_common_words(spark, monkeypatch):
    """A group of near lines is settled by its own earliest lines, and long lines that share
    a few words are told apart, before pairs are listed."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    base = [rng.choice(words) + str(i % 3) for i in range(70)]
    docs = [(i, " ".join(rng.choice(words) + str(rng.randrange(3)) for _ in range(8))) for i in range(200)]
    for i in range(300):
        near = list(base)
        for at in rng.sample(range(70), 3):
            near[at] = rng.choice(words) + str(rng.randrange(3))
        docs.append((1000 + i, " ".join(near)))
    docs += [(2000 + i, " ".join([f"r{i % 3}", *(f"v{rng.randrange(40000)}" for _ in range(160))])) for i in range(90)]
    listed = []

    def staged(df, name="stage", made=lines.staged):
        out = made(df, name)
        if name == "pairs":
            listed.append(out.count())
        return out

    monkeypatch.setattr(lines, "staged", staged)
    got = lines.deduplicate(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r.doc_id: r.text for r in got.collect()} == brute(docs)
    assert listed[0] < 6000, listed


def test_crowd_whose_edits_are_rare_words(spark, monkeypatch):
    """A member of a crowd is first compared with one other line, and few pairs are listed then."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(f"w{rng.randrange(60)}" for _ in range(10))) for i in range(300)]
    for i in range(700):
        near = list(base)
        for at in rng.sample(range(60), 3):
            near[at] = f"x{rng.randrange(100000)}"
        docs.append((1000 + i, " ".join(near)))
    listed = {}

    def staged(df, name="stage", made=lines.staged):
        out = made(df, name)
        if name in ("crowd", "pairs"):
            listed[name] = out.count()
        return out

    monkeypatch.setattr(lines, "staged", staged)
    got = lines.deduplicate(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r.doc_id: r.text for r in got.collect()} == brute(docs)
    assert listed["crowd"] <= len(docs) and listed["pairs"] < 5000, listed
