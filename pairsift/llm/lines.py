"""Line dedup by an exact set-similarity join, in DataFrame functions alone.

A text's lines end at \\n. A line's tokens are its distinct words, lower-cased and split at
white space; its place is (doc_id, line number). A line is removed if some line at an
earlier place, itself removed or not, has a Jaccard similarity of at least 0.8 with it.
Blank lines resemble nothing and stay.

1. Words are counted in 65,536 hash buckets, whatever the data. A token's code is its
   bucket's rank by count, then the rest of its hash, so codes in order are rare first and
   as distinct as the 64-bit hash.
2. Lines with equal token sets are one class, at its earliest place; later ones go.
3. Two sets of n and m tokens with similarity 0.8 share a token among the first
   floor(n / 5) + 1 and floor(m / 5) + 1, for the smaller set floor(n / 9) + 1 (prefix filter);
   sizes differ by a fifth at most (length filter); after their first common token enough
   tokens must be left (positional filter); and a parity sketch of 64 slots, for long lines
   (which fill 64, whatever they hold) of 128, bounds the difference of the sets from below.
4. Crowds: classes of about the same size that agree in two of four tokens, picked by hash
   from the whole line, form a crowd; there are four such pairs. Each class is first compared with one earlier class,
   the nearest by sketch of the earliest and of those just before it in its crowds. That
   settles most members of a large group. Only classes still unsettled then look for an
   earlier match among all classes.
5. Candidates are compared by parity sketches of 256 slots; what is left on their full token
   sets, read again from the text.

A null doc_id counts as the smallest. Rows that repeat a doc_id have the same places, which
are not earlier than each other; they are told apart by a hash of their texts, so each row
loses its own lines only, and equal rows lose the same. Null and empty texts stay as they
are; a text that loses all lines becomes empty. Further columns pass unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from .common import discard, staged

BUCKETS = 1 << 16
#: Parts of a crowd, each with its own first class.
SHARES = 8
#: Pairs of picked tokens, each naming crowds.
CROWDS = ((0, 1), (2, 3), (0, 2), (1, 3))
#: Classes of a crowd that each class meets beside the earliest one.
AGO = 2
#: Lines of more tokens have a sketch of 128 slots, others of 64.
LONG = 48
#: Bits of the filters that spare lines a shuffle; fixed, and followed by an exact join.
FILTER_BITS = 1 << 22
_SPACES = "\t\n\x0b\x0c\r"
_NO_ID = -(1 << 63)


def _plain(text: Column, spaces: str) -> Column:
    """Lower-cased, with blanks for `spaces`; done on whole texts, not line by line."""
    text = F.lower(text)
    for space in spaces:
        text = F.replace(text, F.lit(space), F.lit(" "))
    return text


def _words(line: Column) -> Column:
    """Words of a line of a plain text. A plain blank needs no regular expression."""
    return F.array_remove(F.split(line, " "), "")


def _bucket(token: Column) -> Column:
    return F.shiftrightunsigned(token, 48)


def token_ranks(docs: DataFrame) -> DataFrame:
    """One row, one array: the rank by count of every hash bucket, from -32768."""
    words = docs.select(F.explode(F.split(_plain(F.col("text"), _SPACES), " ")).alias("w")).where("w != ''")
    counts = words.groupBy(_bucket(F.xxhash64("w")).alias("bucket")).count()
    every = docs.sparkSession.range(BUCKETS).toDF("bucket").join(counts, "bucket", "left").select(
        "bucket", F.coalesce("count", F.lit(0)).alias("n")
    )
    # The number of buckets is fixed, so this last part is of a fixed size.
    ordered = every.agg(F.sort_array(F.collect_list(F.struct("n", "bucket"))).alias("s")).select(F.posexplode("s").alias("rank", "s"))
    return staged(
        ordered.agg(F.sort_array(F.collect_list(F.struct(F.col("s.bucket").alias("b"), (F.col("rank") - BUCKETS // 2).alias("r")))).alias("s"))
        .select(F.transform("s", lambda x: x["r"].cast("long")).alias("ranks")), "ranks",
    )


def _hashes(line: Column) -> Column:
    """Hashes of a line's distinct tokens."""
    return F.array_distinct(F.transform(_words(line), lambda w: F.xxhash64(w)))


def _codes(hashes: Column, ranks: Column) -> Column:
    """Sorted codes of a line's distinct tokens, rare ones first."""

    def code(h: Column) -> Column:
        return F.shiftleft(F.get(ranks, _bucket(h).cast("int")), 48).bitwiseOR(h.bitwiseAND((1 << 48) - 1))

    return F.sort_array(F.transform(hashes, code))


def _picks(hashes: Column) -> Column:
    """Four tokens that similar lines likely share: least and greatest hash of either half of
    them. Rare tokens would not do, as those are what edits bring in."""
    halves = [F.filter(hashes, lambda h: h.bitwiseAND(1) == i) for i in range(2)]
    picked = [f(half) for half in halves for f in (F.array_min, F.array_max)]
    return F.array(*[F.when(p.isNotNull(), F.hash(p)) for p in picked])


def _bit(number: Column) -> Column:
    """The long with the one bit that the number's last six bits name."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), number.bitwiseAND(63).cast("int"))


def _parity(codes: Column) -> Column:
    """How many codes fall into each of 64 slots, modulo two."""
    return F.aggregate(codes, F.lit(0).cast("long"), lambda a, c: a.bitwiseXOR(_bit(c)))


def _places(docs: DataFrame) -> DataFrame:
    """d, t, l, line of every line, lower-cased and with plain blanks only."""
    return docs.select("d", "t", F.posexplode(F.split(_plain(F.col("text"), _SPACES.replace("\n", "")), "\n")).alias("l", "line"))


def _coded(places: DataFrame, ranks: DataFrame) -> DataFrame:
    """d, t, l, hashes, codes. The ranks come from a scalar subquery, which is evaluated once."""
    # Hashes first, codes from them: a lambda would hash a word at every mention.
    hashed = places.select("d", "t", "l", _hashes(F.col("line")).alias("hashes"), ranks.scalar().alias("ranks"))
    return hashed.select("d", "t", "l", "hashes", _codes(F.col("hashes"), F.col("ranks")).alias("codes"))


def _filter_of(keys: DataFrame) -> DataFrame:
    """One row, one array of longs: a bit for every hash of (d, l) in `keys`."""
    slot = F.pmod(F.xxhash64("d", "l"), F.lit(FILTER_BITS))
    words = keys.select(slot.alias("s")).groupBy(F.shiftright("s", 6).alias("w")).agg(
        F.bit_or(_bit(F.col("s"))).alias("bits")
    )
    every = keys.sparkSession.range(FILTER_BITS // 64).toDF("w").join(words, "w", "left").select("w", F.coalesce("bits", F.lit(0)).alias("bits"))
    return staged(
        every.agg(F.sort_array(F.collect_list(F.struct("w", "bits"))).alias("s")).select(F.transform("s", lambda x: x["bits"]).alias("bits")), "filter"
    )


def _maybe(bits: Column) -> Column:
    """Whether (d, l) may be in the filter."""
    slot = F.pmod(F.xxhash64("d", "l"), F.lit(FILTER_BITS))
    word = F.get(bits, F.shiftright(slot, 6).cast("int"))
    return F.getbit(word, slot.bitwiseAND(63).cast("int")) == 1


def line_sets(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every line with tokens (d, t, l, k1, k2, n, parity, high, picks, prefix), and the rank table.

    `parity` is a sketch of 64 slots, `high` that of a long line's tokens in the upper half of 128."""
    ranks = token_ranks(docs)
    # Not a filter on the codes: pushed below them, it would compute every line's codes twice.
    written = F.btrim("line") != ""
    made = _coded(_places(docs).where(written), ranks)
    n = F.size("codes")
    lines = made.select(
        "d", "t", "l", F.xxhash64("codes").alias("k1"), F.xxhash64(F.lit(1), "codes").alias("k2"), n.alias("n"),
        _parity(F.col("codes")).alias("parity"),
        F.when(n > LONG, _parity(F.filter("codes", lambda c: c.bitwiseAND(64) != 0))).otherwise(F.lit(0).cast("long")).alias("high"),
        _picks(F.col("hashes")).alias("picks"),
        F.transform(F.slice("codes", 1, (n / 5).cast("int") + 1), lambda c: F.hash(c)).alias("prefix"),
    )
    return staged(lines, "lines"), ranks


#: What an index row of a class holds beside its token: its place, meta (n, place in the prefix, open) and sketch.
_ROW = ("d", "l", "t", "meta", "parity", "high")


def _index(classes: DataFrame, tokens: Column) -> DataFrame:
    """tok and _ROW: a row per class and token."""
    meta = F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.shiftleft(F.col("e.i").cast("long"), 1)).bitwiseOR(F.col("open").cast("long"))
    rows = classes.select("d", "l", "t", "n", "open", "parity", "high", F.explode(tokens).alias("e"))
    return rows.select(F.col("e.tok").alias("tok"), "d", "l", "t", meta.alias("meta"), "parity", "high")


def _numbered(prefix: str) -> Column:
    return F.transform(prefix, lambda t, i: F.struct(t.alias("tok"), i.alias("i")))


def _size(side: str) -> Column:
    return F.shiftright(F.col(f"{side}meta"), 32)


def _order(side: str) -> Column:
    """Number of prefix tokens before this one."""
    return F.shiftright(F.col(f"{side}meta"), 1).bitwiseAND((1 << 31) - 1)


def _open(side: str) -> Column:
    return F.col(f"{side}meta").bitwiseAND(1) == 1


def _before(x: str, y: str) -> Column:
    """Classes at one place, of rows that repeat a doc_id, are not earlier than each other."""
    return F.expr(f"{x}d < {y}d OR ({x}d = {y}d AND {x}l < {y}l)")


def _apart(x: str, y: str) -> Column:
    """Least number of tokens in which two classes differ, by their sketches."""
    whole, high = (F.col(f"{x}{c}").bitwiseXOR(F.col(f"{y}{c}")) for c in ("parity", "high"))
    fine = F.bit_count(high) + F.bit_count(whole.bitwiseXOR(high))
    return F.when(F.least(_size(x), _size(y)) > LONG, fine).otherwise(F.bit_count(whole))


def _near(x: str, y: str) -> Column:
    """The length, positional and parity filters for index rows of two classes."""
    n = {s: _size(s) for s in (x, y)}
    left = {s: n[s] - _order(s) for s in (x, y)}
    total = n[x] + n[y]
    return (
        (5 * F.least(n[x], n[y]) >= 4 * F.greatest(n[x], n[y]))
        & (9 * F.least(left[x], left[y]) >= 4 * total)
        & (9 * _apart(x, y) <= total)
    )


def _crowd_pairs(classes: DataFrame) -> DataFrame:
    """Each class with one earlier class, that of least difference by the sketches among the
    earliest of its crowds and the last AGO before it, in the same one of SHARES parts; so no
    crowd stays in one task. A crowd shares two picks and the size up to a half; one token
    alone is shared by too many others."""
    size = F.floor(F.log("n") / F.log(F.lit(1.5)))
    part = F.pmod(F.xxhash64("d", "l", "t"), F.lit(SHARES))

    def key(a: int, b: int) -> Column:
        x, y = F.get("picks", F.lit(a)), F.get("picks", F.lit(b))
        named = F.struct(F.xxhash64(F.lit(a), F.lit(b), size, part, x, y).alias("tok"), F.lit(0).alias("i"))
        return F.when(x.isNotNull() & y.isNotNull(), named)

    keys = [key(a, b) for a, b in CROWDS]
    ordered = W.partitionBy("tok").orderBy("d", "l", "t")
    own = F.struct(*_ROW)
    met = _index(classes, F.array_compact(F.array(*keys))).select(
        *[F.col(c).alias(f"y{c}") for c in _ROW], F.first(own).over(ordered).alias("x0"), *[F.lag(own, i).over(ordered).alias(f"x{i}") for i in range(1, AGO + 1)]
    )
    # The first of a crowd, hence every class without one, has nobody before it.
    met = met.where("x1 IS NOT NULL")
    for i in range(AGO + 1):
        met = met.select("*", *[F.col(f"x{i}.{c}").alias(f"x{i}{c}") for c in _ROW])
    found = [
        F.when(_before(f"x{i}", "y") & _near(f"x{i}", "y"), F.struct(_apart(f"x{i}", "y").alias("apart"), *[F.col(f"x{i}{c}").alias(f"{c}x") for c in "dtl"]))
        for i in range(AGO + 1)
    ]
    best = met.select(*[F.col(f"y{c}").alias(f"{c}y") for c in "dtl"], F.least(*found).alias("x")).where("x IS NOT NULL")
    return best.groupBy("dy", "ty", "ly").agg(F.min("x").alias("x")).select("x.dx", "x.tx", "x.lx", "dy", "ty", "ly")


def _all_pairs(classes: DataFrame) -> DataFrame:
    """Open classes with every earlier class that the filters leave.

    The smaller class of a pair shares a token among its first floor(n / 9) + 1 already, so
    only the larger one is looked up by all tokens of its prefix.
    """
    rows = _index(classes, _numbered("prefix"))
    small, large = (rows.select("tok", *[F.col(c).alias(f"{s}{c}") for c in _ROW]) for s in "sb")
    place = {s: F.struct(*[F.col(f"{s}{c}").alias(c) for c in "dtl"]) for s in "sb"}
    first = _before("s", "b")
    # The lesser size is the small one's; as a filter on `small` alone it would cost a second shuffle.
    early = 9 * _order("s") <= F.least(_size("s"), _size("b"))
    met = small.join(large, "tok").where(
        early & (_size("s") <= _size("b")) & ((first & _open("b")) | ((_size("s") < _size("b")) & _before("b", "s") & _open("s"))) & _near("s", "b")
    )
    pairs = met.select(F.when(first, place["s"]).otherwise(place["b"]).alias("x"), F.when(first, place["b"]).otherwise(place["s"]).alias("y"))
    return pairs.select(*[F.col(f"{s}.{c}").alias(f"{c}{s}") for s in "xy" for c in "dtl"]).distinct()


def _sketch(codes: Column) -> list[Column]:
    """Four longs: how many codes fall into each of 256 slots, modulo two."""
    zero = F.lit(0).cast("long")

    def part(i: int) -> Column:
        def add(a: Column, c: Column) -> Column:
            return a.bitwiseXOR(F.when(F.shiftright(c, 12).bitwiseAND(3) == i, _bit(F.shiftright(c, 6))).otherwise(zero))

        return F.aggregate(codes, zero, add)

    return [part(i) for i in range(4)]


def _verified(docs: DataFrame, ranks: DataFrame, pairs: DataFrame) -> DataFrame:
    """d, t, l of the later lines of the pairs whose token sets are similar.

    The lines of the pairs are coded again, once. Pairs first fetch sketches of 256 slots,
    whose difference bounds that of the sets from below also for long lines; only what is
    left fetches the token codes. `pairs` is a written table; it is removed.
    """
    ends = pairs.select(F.col("dx").alias("d"), F.col("lx").alias("l")).union(pairs.select("dy", "ly")).distinct()
    wanted = _filter_of(ends)
    key = ["d", "t", "l"]
    coded = _coded(_places(docs).where(_maybe(wanted.scalar())), ranks)
    found = staged(coded.select(*key, "codes", F.size("codes").alias("n"), *[x.alias(f"s{i}") for i, x in enumerate(_sketch(F.col("codes")))]), "coded")

    def fetched(rows: DataFrame, cols: list[str]) -> DataFrame:
        for s in "xy":
            side = found.select(*[F.col(c).alias(f"{c}{s}") for c in [*key, *cols]])
            rows = rows.join(side, [f"{c}{s}" for c in key])
        return rows

    apart = sum(F.bit_count(F.col(f"s{i}x").bitwiseXOR(F.col(f"s{i}y"))) for i in range(4))
    near = fetched(pairs, ["n", "s0", "s1", "s2", "s3"]).where(9 * apart <= F.col("nx") + F.col("ny"))
    near = staged(near.select(*[f"{c}{s}" for s in "xy" for c in key]), "near")
    both = fetched(near, ["codes"])
    common = F.size(F.array_intersect("codesx", "codesy"))
    similar = both.where(9 * common >= 4 * (F.size("codesx") + F.size("codesy")))
    late = staged(similar.select(F.col("dy").alias("d"), F.col("ty").alias("t"), F.col("ly").alias("l")).distinct(), "late")
    for spent in (pairs, wanted, found, near):
        discard(spent)
    return late


def removed_lines(docs: DataFrame) -> DataFrame:
    """Lines (d, t, l) to remove; `docs` has d (long, never null), t (hash of the text) and text."""
    lines, ranks = line_sets(docs)
    classes = staged(
        lines.groupBy("k1", "k2").agg(
            F.min(F.struct("d", "l", "t")).alias("first"), *[F.first(c).alias(c) for c in ("n", "parity", "high", "picks", "prefix")]
        ).select("k1", "k2", "first.d", "first.t", "first.l", "n", "parity", "high", "picks", "prefix"), "classes",
    )
    at_first = classes.withColumn("open", F.lit(1))
    settled = _verified(docs, ranks, staged(_crowd_pairs(at_first), "crowd"))
    marked = settled.withColumn("gone", F.lit(1))
    opened = classes.join(marked, ["d", "t", "l"], "left").withColumn("open", F.coalesce(1 - F.col("gone"), F.lit(1))).drop("gone")
    more = _verified(docs, ranks, staged(_all_pairs(opened), "pairs"))
    gone = settled.union(more)
    # A line goes with its class, or because its class begins earlier.
    doomed = classes.join(gone, ["d", "t", "l"], "left_semi").select("k1", "k2", F.lit(True).alias("all"))
    owner = classes.select("k1", "k2", F.col("d").alias("fd"), F.col("l").alias("fl")).join(doomed, ["k1", "k2"], "left")
    late = (F.col("d") > F.col("fd")) | ((F.col("d") == F.col("fd")) & (F.col("l") > F.col("fl")))
    found = lines.select("d", "t", "l", "k1", "k2").join(owner, ["k1", "k2"]).where(late | F.col("all").isNotNull())
    found = staged(found.select("d", "t", "l").distinct(), "removed")
    for spent in (lines, ranks, classes, settled, more):
        discard(spent)
    return found


def _row_key(doc_id: str, text: str) -> list[Column]:
    """d, t: rows equal in both have the same id and text."""
    return [F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(_NO_ID)).alias("d"), F.xxhash64(F.col(f"`{text}`")).alias("t")]


def _with_removed(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    named = docs.select(*_row_key(doc_id, text), F.col(text).alias("text")).where("text IS NOT NULL")
    gone = removed_lines(named)
    return named, staged(gone.groupBy("d", "t").agg(F.sort_array(F.collect_set("l")).alias("gone")), "gone")


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", removed: str | None = None) -> DataFrame:
    """`docs`, all columns, with the removed lines taken out of `text`.

    `removed` names a column to add: how many lines the text lost.
    """
    _, gone = _with_removed(docs, doc_id, text)
    # Documents that lose nothing pass by the join.
    marks = _filter_of(gone.select("d", F.lit(0).alias("l")))
    columns = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, columns)], *_row_key(doc_id, text), F.lit(0).alias("l"))
    maybe = _maybe(marks.scalar())
    body = columns[docs.columns.index(text)]
    hit = plain.where(maybe).join(gone, ["d", "t"], "left")
    kept = F.filter(F.split(body, "\n"), lambda line, i: ~F.array_contains(F.col("gone"), i))
    cut = hit.withColumn(body, F.when(F.col("gone").isNull(), F.col(body)).otherwise(F.array_join(kept, "\n")))
    lost = F.when(F.col(body).isNotNull(), F.coalesce(F.size("gone"), F.lit(0))).otherwise(F.lit(0))
    out = [F.col(n).alias(c) for c, n in zip(docs.columns, columns) if c != removed]
    add = lambda frame, n: frame.select(*out, *([n.cast("long").alias(removed)] if removed else []))
    return add(cut, lost).unionByName(add(plain.where(~maybe), F.lit(0)))
