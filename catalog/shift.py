"""Distribution-shift and correlation queries."""

from pyspark.sql import functions as F

from pairsift.operators import shift as S

from .base import register, sql
from .metrics import AP

COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def ks(col: str, rows: str, a: str, b: str) -> str:
    return f"""(SELECT max(abs(ua / na - ub / nb)) FROM (SELECT sum(a) OVER w * 1e0 AS ua, sum(b) OVER w * 1e0 AS ub, sum(a) OVER () AS na, sum(b) OVER () AS nb
        FROM (SELECT {col} AS v, count(*) FILTER ({a}) AS a, count(*) FILTER ({b}) AS b FROM {rows} GROUP BY 1) WINDOW w AS (ORDER BY v)))"""


def smd(col: str, rows: str, a: str, b: str) -> str:
    return f"""(SELECT coalesce((avg({col}) FILTER ({a}) - avg({col}) FILTER ({b})) / nullif(sqrt((var_pop({col}) FILTER ({a}) + var_pop({col}) FILTER ({b})) / 2), 0), 0) FROM {rows})"""


@register("d01_smd", sql("", " UNION ALL ".join(f"SELECT '{c}' AS feature, {smd(c, 'lineitem', chr(39).join(['l_returnflag = ', 'A', '']), chr(39).join(['l_returnflag = ', 'R', '']))} AS smd" for c in COLS), "smd"))
def d01(t):
    return S.smd(t.raw["lineitem"], "l_returnflag", "A", "R", COLS)


@register("d02_ks_statistic", sql("", " UNION ALL ".join(f"""SELECT '{c}' AS feature, {ks(c, 'lineitem', "l_linestatus = 'O'", "l_linestatus = 'F'")} AS ks""" for c in COLS), "ks"))
def d02(t):
    return S.ks_statistic(t.raw["lineitem"], "l_linestatus", "O", "F", COLS)


@register("d02_ks_by_event", sql("", f"""SELECT 'value' AS feature, {ks("value", "events", "event_type = 'click'", "event_type = 'purchase'")} AS ks""", "ks"))
def d02_events(t):
    return S.ks_statistic(t.raw["events"], "event_type", "click", "purchase", ["value"])


def RHO(x: str, y: str, rows: str) -> str:
    return f"""SELECT corr(rx, ry) AS rho FROM (SELECT rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2e0 AS rx,
        rank() OVER (ORDER BY {y}) + (count(*) OVER (PARTITION BY {y}) - 1) / 2e0 AS ry FROM {rows})"""


@register("d03_spearman", sql("", RHO("l_quantity", "l_extendedprice", "lineitem"), "rho"))
def d03(t):
    return S.spearman(t.raw["lineitem"], "l_quantity", "l_extendedprice")


PAIRS3 = [("score", "coarse"), ("score", "label"), ("coarse", "label")]


@register("d04_spearman_matrix", sql("scored", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, rho FROM ({RHO(a, b, 'scored')})" for a, b in PAIRS3), "rho"))
def d04(t):
    return S.spearman_matrix(t.scored, ["score", "coarse", "label"])


UNI = {"n_chars": "n_chars", "toxic": "toxic", "one": "1"}


def uni(c: str) -> str:
    rows = "(SELECT *, 1 AS one FROM scored)"
    return f"""SELECT '{c}' AS feature, CASE WHEN (SELECT min({c}) = max({c}) FROM {rows}) THEN (SELECT avg(label) FROM scored)
        ELSE greatest((SELECT ap FROM ({AP(rows, "label", c, "doc_id")})), (SELECT ap FROM ({AP(rows, "label", f"-({c})", "doc_id")}))) END AS univariate_ap"""


@register("d05_univariate_ap", sql("scored", " UNION ALL ".join(uni(c) for c in UNI), "univariate_ap"))
def d05(t):
    return S.univariate_ap(t.scored.withColumn("one", F.lit(1)), "label", ["n_chars", "toxic", "one"], "doc_id")


GROUP = """CASE WHEN l.doc_id IS NULL THEN CASE WHEN source IN ('src0', 'src1', 'src2', 'src3', 'src4') THEN 'evaluation' ELSE 'unlabeled' END
    WHEN quality = 1 THEN 'positive' ELSE 'negative' END"""
DOCS = f"(SELECT d.doc_id, quality AS label, n_chars, strlen(text) AS bytes, least(n_chars / 10000e0, 1) AS risk, {GROUP} AS grp FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"
G = {g: f"grp = '{g}'" for g in S.SHIFT_GROUPS}


def groups(t):
    d = t.raw["documents"].select("doc_id", "source", "n_chars", F.octet_length("text").alias("bytes"), F.least(F.col("n_chars") / 10000.0, F.lit(1.0)).alias("risk"))
    y = t.raw["labels"].select("doc_id", F.col("quality").alias("label"))
    both = d.join(y, "doc_id", "left")
    ev = F.col("source").isin("src0", "src1", "src2", "src3", "src4")
    return {
        "positive": both.where("label = 1"), "negative": both.where("label = 0"),
        "unlabeled": both.where(F.col("label").isNull() & ~ev), "evaluation": both.where(F.col("label").isNull() & ev),
    }


SHIFT_COLS = ["n_chars", "bytes"]
AUDIT = " UNION ALL ".join(f"""SELECT '{c}' AS feature, {", ".join(f"(SELECT avg({c}) FILTER ({w}) FROM docs) AS mean_{g}" for g, w in G.items())},
    {", ".join(f"{smd(c, 'docs', G[a], G[b])} AS smd_{a}_{b}" for a, b in S.SHIFT_PAIRS)},
    {", ".join(f"{ks(c, 'docs', G[a], G[b])} AS ks_{a}_{b}" for a, b in S.SHIFT_PAIRS[1:])},
    greatest((SELECT ap FROM ({AP("(SELECT * FROM docs WHERE label IS NOT NULL)", "label", c, "doc_id")})), (SELECT ap FROM ({AP("(SELECT * FROM docs WHERE label IS NOT NULL)", "label", f"-{c}", "doc_id")}))) AS univariate_ap,
    (SELECT rho FROM ({RHO(c, "risk", "(SELECT * FROM docs WHERE grp = 'evaluation')")})) AS risk_spearman""" for c in SHIFT_COLS)
AUDIT_COLS = [*[f"mean_{g}" for g in G], *[f"smd_{a}_{b}" for a, b in S.SHIFT_PAIRS], *[f"ks_{a}_{b}" for a, b in S.SHIFT_PAIRS[1:]], "univariate_ap", "risk_spearman"]


@register("d06_shift_audit", sql("", f"SELECT * FROM (WITH docs AS {DOCS} {AUDIT})", " ".join(AUDIT_COLS)))
def d06(t):
    return S.shift_audit(groups(t), SHIFT_COLS, "doc_id", "risk")


@register("d07_ks_change", sql("", f"""
    SELECT feature, (a - b) / greatest(a, 1e-12) AS relative, a - b AS absolute FROM ({" UNION ALL ".join(
        f'''SELECT '{c}' AS feature, {ks(c, 'lineitem', "l_linestatus = 'O'", "l_linestatus = 'F'")} AS a, {ks(c, 'lineitem', "l_returnflag = 'A'", "l_returnflag = 'R'")} AS b''' for c in COLS)})""", "relative absolute"))
def d07(t):
    a = S.ks_statistic(t.raw["lineitem"], "l_linestatus", "O", "F", COLS).withColumnRenamed("ks", "a")
    b = S.ks_statistic(t.raw["lineitem"], "l_returnflag", "A", "R", COLS).withColumnRenamed("ks", "b")
    rel, absolute = S.ks_change("a", "b")
    return a.join(b, "feature").select("feature", rel.alias("relative"), absolute.alias("absolute"))
