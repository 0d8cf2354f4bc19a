"""Joins and pair construction."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..functions.game import card_strength, orient, pair_key, pair_measures, pair_signals
from ..scale import dealt, group_sizes, large_groups, largest_group, numbered, ordered_scan
from ..session import ensure_checkpoint_dir
from ..schema import ACTION_MEASURES, BASELINE_MEASURES, FAMILIES, PAIR_MEASURES, SAME_COLUMNS, SIGNALS
from .agg import baselines
from .quality import duplicate_keys, require_empty
from .windows import progress

# Groups up to this size list their own member pairs (at most (n-1)/2 rows per member);
# larger groups are probed with the requested pairs instead.
SMALL_GROUP = 16
# Unjudged rows of a pair that one key of pairwise_preferences holds.
SALT_ROWS = 100_000
# Members of one block of a large group; two blocks meet in one key.
PAIR_BLOCK = 512
# Members of a block, and groups compared at a time, where all members are compared.
MEET_BLOCK = 1024
# Groups of a member that one list holds.
MEET_LIST = 8192


def player_hands(seats: DataFrame, hands: DataFrame, action_features: DataFrame, limit=None) -> DataFrame:
    """One row per (hand, player): seat, hand, actions in blinds, strength, progress, baselines."""
    timed = progress(
        hands.select("hand_id", "phase", "table_id", "started_at", "big_blind", "final_pot"),
        ["table_id", "phase"], [F.col("started_at"), F.col("hand_id")], limit=limit,
    )
    joined = seats.join(timed, "hand_id", "left").join(action_features, ["hand_id", "player_id"], "left")
    blind = F.nullif(F.col("big_blind").cast("double"), F.lit(0.0))
    num = lambda c: F.col(c).cast("string").try_cast("double")
    wide = joined.na.fill(0, ACTION_MEASURES).withColumns({
        "stack_bb": num("starting_stack") / blind,
        "contribution_bb": num("total_contribution") / blind,
        "net_bb": num("net_chips") / blind,
        "pot_bb": num("final_pot") / blind,
        "hole_strength": card_strength("hole_card_1", "hole_card_2"),
    })
    # A player's seats bound the size of a (phase, player) group.
    largest = largest_group(seats, ["player_id"])
    return baselines(wide, ["phase", "player_id"], BASELINE_MEASURES, largest=largest, limit=limit)


def _requested(pairs: DataFrame) -> DataFrame:
    return orient(pairs.select("pair_id", "player_1", "player_2"), "player_1", "player_2")


def check_unique_pairs(pairs: DataFrame) -> None:
    keyed = pairs.select(pair_key("player_1", "player_2").alias("pair_key"))
    require_empty(duplicate_keys(keyed, ["pair_key"]), "a pair is requested more than once")


def _members_of(want: DataFrame, member: str) -> DataFrame:
    return want.select(F.explode(F.array("low", "high")).alias(member)).distinct()


def _list_pairs(rows: DataFrame, group: str, member: str, carry: list[str], count: int) -> DataFrame:
    """Member pairs (low < high) of groups known to be small, from one pass over `count` rows at most."""
    packed = dealt(rows.where(F.col(group).isNotNull()), [group], count).groupBy(group).agg(F.collect_list(F.struct(F.col(member), *carry)).alias("__m"))
    first = packed.select(group, "__m", F.explode("__m").alias("__a"))
    both = first.select(
        group, "__a", F.explode(F.filter("__m", lambda x: x[member] > F.col(f"__a.{member}"))).alias("__b")
    )
    return both.select(
        group, F.col(f"__a.{member}").alias("low"), F.col(f"__b.{member}").alias("high"),
        *[F.col(f"__a.{c}").alias(f"{c}_1") for c in carry], *[F.col(f"__b.{c}").alias(f"{c}_2") for c in carry],
    )


def met_id(low: str = "low", high: str = "high"):
    """The id of a pair that nobody named: its two members in order."""
    return F.concat_ws("-", low, high)


def _list_all(rows: DataFrame, big: DataFrame | None, group: str, member: str, carry: list[str], count: int,
              block: int | None = None, limit=None) -> DataFrame:
    """Member pairs of every group, one row for each group they share; `big` names large groups."""
    if big is None:
        return _list_pairs(rows, group, member, carry, count)
    few = _list_pairs(rows.join(big, group, "left_anti"), group, member, carry, count)
    crowds = rows.join(big, group, "left_semi")
    return few.unionByName(block_pairs(crowds, group, member, carry, block or PAIR_BLOCK, limit))


def _match(seats: DataFrame, pairs: DataFrame | None, group: str, member: str, carry: list[str], small_group: int,
           project=None, roster: DataFrame | None = None, prefilter: bool = True) -> DataFrame:
    """Requested pairs with each group they share: `carry` of the lower id as `_1`, higher as `_2`.

    `project` reduces the carried columns before the pair lookup. `roster` is a cheaper
    frame with at least the same group memberships, used for the size check only. Without
    `pairs`, every pair that met is meant; then nothing is looked up and no pair is shuffled.
    """
    project = project or (lambda d: d)
    rows = seats.select(group, member, *carry)
    roster = roster if roster is not None else seats
    largest, count = group_sizes(roster, [group])
    big = large_groups(roster, [group], small_group, largest)
    if pairs is None:
        met = project(_list_all(rows, big, group, member, carry, count))
        return met.select("*", F.col("low").alias("player_1"), F.col("high").alias("player_2"), met_id().alias("pair_id"))
    want = _requested(pairs)
    if prefilter:
        rows = rows.join(_members_of(want, member), member, "left_semi")
    small = rows if big is None else rows.join(big, group, "left_anti")
    result = project(_list_pairs(small, group, member, carry, count)).join(want, ["low", "high"])
    if big is None:
        return result

    # Large groups: start from the requested pair's rarer member, then look up the other.
    rest = rows.join(big, group, "left_semi")
    half = lambda name, i: rest.select(
        group, F.col(member).alias(name), *[F.col(c).alias(f"{c}_{i}") for c in carry])
    seen = rest.groupBy(member).agg(F.count(F.lit(1)).alias("n"))
    sized = (
        want.select("low", "high").distinct()
        .join(seen.select(F.col(member).alias("low"), F.col("n").alias("n_low")), "low")
        .join(seen.select(F.col(member).alias("high"), F.col("n").alias("n_high")), "high")
    )
    by_low = sized.where("n_low <= n_high").join(half("low", 1), "low").join(half("high", 2), [group, "high"])
    by_high = sized.where("n_low > n_high").join(half("high", 2), "high").join(half("low", 1), [group, "low"])
    probed = by_low.unionByName(by_high).drop("n_low", "n_high")
    return result.unionByName(project(probed).join(want, ["low", "high"]))


def co_membership(seats: DataFrame, pairs: DataFrame | None = None, group: str = "hand_id", member: str = "player_id",
                  small_group: int = SMALL_GROUP, check: bool = True, prefilter: bool = True,
                  carry: list[str] | tuple = ()) -> DataFrame:
    """Groups in which both members of a requested pair take part; of every pair without `pairs`.

    `carry` are columns of `seats` to take along from both members, suffixed `_1` and `_2`.
    """
    if check and pairs is not None:
        check_unique_pairs(pairs)
    matched = _match(seats, pairs, group, member, list(carry), small_group, prefilter=prefilter)
    turned = F.col("player_1") != F.col("low")
    side = lambda c, i: F.when(turned, F.col(f"{c}_{3 - i}")).otherwise(F.col(f"{c}_{i}")).alias(f"{c}_{i}")
    return matched.select("pair_id", group, "player_1", "player_2", *[side(c, i) for i in (1, 2) for c in carry])


def attach_sides(membership: DataFrame, measures: DataFrame, cols: list[str],
                 group: str = "hand_id", member: str = "player_id") -> DataFrame:
    """Measures of both members, suffixed `_1` and `_2`."""
    out = membership
    for i in (1, 2):
        one = measures.select(
            F.col(group), F.col(member).alias(f"player_{i}"), *[F.col(c).alias(f"{c}_{i}") for c in cols]
        )
        out = out.join(one, [group, f"player_{i}"], "left")
    return out


# What the pair measures read of a side. Each pair row lists both sides, so
# nothing else is carried.
SIDE_COLUMNS = [
    "table_id", "phase_progress", "pot_bb", "contribution_bb", "net_bb", "folded", "went_to_showdown", "hole_strength",
    "aggressive_actions", "calls", "checks", "raises", "folds",
    "base_aggressive_actions", "base_calls", "base_checks",
]


def pair_hands(players: DataFrame, pairs: DataFrame | None, phase: str, small_group: int = SMALL_GROUP,
               check: bool = True, extra: list[str] | None = None, roster: DataFrame | None = None,
               prefilter: bool = True) -> DataFrame:
    """Pair-hand table: shared group, both sides' measures combined, and the three signals.

    Without `pairs` it holds every pair that met, named by `met_id`.

    The measures are computed while the pairs of a group are listed, so only they reach the
    pair lookup, not the two sides. `extra` columns are constant in a group or taken from
    the lower id.
    """
    if check and pairs is not None:
        check_unique_pairs(pairs)
    extra = extra or []

    def measured(rows):
        wide = rows.withColumns(pair_measures())
        return wide.select(
            "hand_id", "low", "high", F.col("table_id_1").alias("table_id"),
            F.col("phase_progress_1").alias("phase_progress"),
            *[F.col(f"{c}_1").alias(c) for c in extra], *PAIR_MEASURES,
        )

    rows = players.where(F.col("phase") == phase)
    out = _match(rows, pairs, "hand_id", "player_id", [*SIDE_COLUMNS, *extra], small_group,
                 measured, roster, prefilter)
    # Sides were taken in id order; turn the two flows to the request's order.
    turned = F.col("player_1") != F.col("low")
    a, b = F.col("transfer_1_to_2_bb"), F.col("transfer_2_to_1_bb")
    out = out.withColumns({
        "transfer_1_to_2_bb": F.when(turned, b).otherwise(a),
        "transfer_2_to_1_bb": F.when(turned, a).otherwise(b),
        **pair_signals(),
    })
    return out.select(
        "pair_id", "hand_id", "player_1", "player_2", "table_id", "phase_progress", *extra,
        *PAIR_MEASURES, *SIGNALS,
    )


def block_pairs(rows: DataFrame, group: str, member: str, carry: list[str] | tuple = (), block: int = PAIR_BLOCK,
                limit=None) -> DataFrame:
    """Member pairs (low < high) of groups of any size, from a triangle of blocks.

    `rows` holds each (group, member) once. A group's members are numbered in order and cut
    into blocks; every pair of blocks is a key of its own, so no key has more than 2 * block
    rows or block ** 2 pairs, and one group's pairs spread over all tasks. A member is sent
    once for every block of its group, and once more.
    """
    placed = ordered_scan(
        rows.select(group, member, *carry), [F.col(member)], [group],
        sums={"__place": F.lit(1)}, totals={"__members": F.lit(1)}, limit=limit,
    )
    cut = placed.withColumns({
        "__b": F.floor((F.col("__place") - 1) / block).cast("int"), "__last": F.floor((F.col("__members") - 1) / block).cast("int"),
    })

    # A fixed number: few rows make many pairs, so tasks must not be merged by their input.
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def side(name: str, i: int, first, last, at: str, other: str) -> DataFrame:
        return cut.select(
            group, F.col(member).alias(name), *[F.col(c).alias(f"{c}_{i}") for c in carry],
            F.col("__b").alias(at), F.explode(F.sequence(first, last)).alias(other),
        ).repartition(tasks, group, "__i", "__j")

    low = side("low", 1, F.col("__b"), F.col("__last"), "__i", "__j")
    high = side("high", 2, F.lit(0), F.col("__b"), "__j", "__i")
    met = low.join(high, [group, "__i", "__j"]).where(F.col("low") < F.col("high"))
    return met.select(group, "low", "high", *[f"{c}_{i}" for i in (1, 2) for c in carry])


def met_pairs(seats: DataFrame, pool: str | None = None, min_shared: int = 1, group: str = "hand_id",
              member: str = "player_id", small_group: int = SMALL_GROUP, limit=None, block: int = PAIR_BLOCK) -> DataFrame:
    """Every member pair that shares at least `min_shared` groups, with the count.

    Small groups list their pairs, larger ones deal them out by blocks, and the counts
    combine before the shuffle. When larger groups exist and several shared groups are
    asked for, pairs are found from each member's groups in order of size, leaving out its
    last `min_shared - 1` (two members with t common groups share one outside their t - 1
    largest), and the candidates are then counted exactly.
    """
    part = [pool] if pool else []
    rows = seats.select(group, member, *part).dropDuplicates([group, member])
    largest, count = group_sizes(seats, [group])
    big = large_groups(seats, [group], small_group, largest)

    def listed(of: DataFrame, carry: list[str]) -> DataFrame:
        """Pairs of every group of `of`, one row for each group they share."""
        return _list_all(of, big, group, member, carry, count, block, limit)

    def counted(shared: DataFrame) -> DataFrame:
        """Shared groups of each pair, and the least pool of those groups."""
        counts = shared.groupBy("low", "high").agg(
            F.count(F.lit(1)).alias("shared_hands"), *[F.min(f"{p}_1").alias(p) for p in part]
        )
        return counts.where(F.col("shared_hands") >= min_shared).select("low", "high", "shared_hands", *part)

    if big is None or min_shared == 1:
        return counted(listed(rows, part))

    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("__size"))
    ranked = ordered_scan(
        rows.select(group, member).join(sizes, group), [F.col("__size").desc(), F.col(group).desc()], [member],
        sums={"__from_last": F.lit(1)}, limit=limit,
    )
    kept = ranked.where(F.col("__from_last") >= min_shared).select(group, member)
    found = listed(kept, []).select("low", "high").distinct()
    asked = found.select(
        F.col("low").alias("player_1"), F.col("high").alias("player_2"), pair_key("low", "high").alias("pair_id")
    )
    shared = _match(rows, asked, group, member, part, small_group, prefilter=False)
    return counted(shared)


def _meet(block: int):
    """Function of a key of two blocks of members: the pairs that share a group, and what is known of them."""

    def run(sides: pa.Table, known: pa.Table) -> pa.Table:
        sides, known = sides.combine_chunks(), known.combine_chunks()
        first = (sides if sides.num_rows else known).slice(0, 1)
        i, j = first["__i"][0].as_py(), first["__j"][0].as_py()
        late = sides["__late"].to_numpy(zero_copy_only=False).astype(bool)
        at = sides["__place"].to_numpy() - np.where(late, j, i) * block
        lists = sides["__groups"].combine_chunks()
        groups = lists.flatten().dictionary_encode().indices.to_numpy()
        owner = np.repeat(np.arange(len(at)), pc.list_value_length(lists).to_numpy())
        n = int(groups.max()) + 1 if len(groups) else 0
        both = (np.bincount(groups[~late[owner]], minlength=n) > 0) & (np.bincount(groups[late[owner]], minlength=n) > 0)
        code = np.cumsum(both) - 1
        keep = both[groups]
        groups, owner = code[groups[keep]], owner[keep]
        met = np.zeros((block, block), bool)
        # Chunks of groups bound the memory; a product of two 0/1 matrices counts shared groups.
        order = np.argsort(groups, kind="stable")
        groups, owner = groups[order], owner[order]
        for start in range(0, int(both.sum()), block):
            a, b = np.searchsorted(groups, (start, start + block))
            g, o = groups[a:b] - start, owner[a:b]
            half = np.zeros((2, block, int(g.max()) + 1), np.float32)
            half[late[o].astype(int), at[o], g] = 1
            met |= half[0] @ half[1].T > 0
        if i == j:
            met = np.triu(met, 1)
        low, high = np.nonzero(met)
        row = np.zeros((2, block), np.int64)
        row[late.astype(int), at] = np.arange(len(at))
        rows = row[0][low], row[1][high]
        place = known["__low"].to_numpy() % block * block + known["__high"].to_numpy() % block
        order = np.argsort(place)
        wanted = low * block + high
        found = np.searchsorted(place[order], wanted)
        hit = np.zeros(len(wanted), bool)
        if len(place):
            found = np.minimum(found, len(place) - 1)
            hit = place[order][found] == wanted
        value = np.zeros(len(wanted))
        value[hit] = known["value"].to_numpy()[order][found[hit]]
        member, extra = sides["__member"], sides["__x"]
        return pa.table({
            "low": member.take(rows[0]), "high": member.take(rows[1]), "value": pa.array(value, mask=~hit),
            "x_1": extra.take(rows[0]), "x_2": extra.take(rows[1]),
        })

    return run


def _met_by_blocks(rows: DataFrame, members: DataFrame, known: DataFrame, group: str, member: str, block: int, limit) -> DataFrame:
    """`met_with_values` by comparing all members, two blocks of them in a key."""
    spark = rows.sparkSession
    count = members.count()
    last = F.lit((count - 1) // block)
    placed = numbered(members, [F.col(member)], name="__n", limit=limit).select(member, "x", (F.col("__n") - 1).alias("__place"))
    parts = -(-largest_group(rows, [member]) // MEET_LIST)
    part = F.pmod(F.xxhash64(group), F.lit(parts))
    lists = rows.groupBy(member, part.alias("__part")).agg(F.collect_list(group).alias("__groups")).join(placed, member)
    own = F.floor(F.col("__place") / block)

    def side(late: bool) -> DataFrame:
        other = F.explode(F.sequence(F.lit(0).cast("long"), own) if late else F.sequence(own, last.cast("long")))
        blocks = (other.alias("__i"), own.alias("__j")) if late else (own.alias("__i"), other.alias("__j"))
        return lists.select(*blocks, F.lit(late).alias("__late"), "__place", F.col(member).alias("__member"), F.col("x").alias("__x"), "__groups")

    # A fixed number: few rows make many pairs, so tasks must not be merged by their input.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    end = lambda s: placed.select(F.col(member).alias(s), F.col("__place").alias(f"__{s}"))
    named = known.join(end("low"), "low").join(end("high"), "high").select(
        F.floor(F.col("__low") / block).alias("__i"), F.floor(F.col("__high") / block).alias("__j"), "__low", "__high", "value")
    sides, named = (d.repartition(tasks, "__i", "__j").groupBy("__i", "__j") for d in (side(False).unionByName(side(True)), named))
    kind = rows.schema[member].dataType.simpleString()
    return sides.cogroup(named).applyInArrow(_meet(block), f"low {kind}, high {kind}, value double, x_1 double, x_2 double")


def met_with_values(seats: DataFrame, known: DataFrame, x: DataFrame | None = None, group: str = "hand_id", member: str = "player_id",
                    block: int = MEET_BLOCK, dense: bool | None = None, limit=None) -> DataFrame:
    """Every member pair (low < high) that shares a group, once, beside what is known of it.

    `known` holds (low, high, value) of some pairs, each once; the others have no value. `x`
    holds (member, x), a number of a member, which comes along as `x_1` and `x_2`.

    Members that meet again and again would be listed once for every group: then all members
    are compared instead, two blocks of them in a key, by products of membership matrices,
    and no pair is shuffled. A member's groups are sent once for every block. That is done
    (`dense`) where the groups list more pairs than the members have. Else the pairs of
    the groups are listed, and combined before their shuffle.
    """
    ensure_checkpoint_dir(seats.sparkSession)
    rows = seats.select(group, member).where(F.col(group).isNotNull() & F.col(member).isNotNull()).distinct().checkpoint()
    members = rows.select(member).distinct()
    members = (members.withColumn("x", F.lit(None).cast("double")) if x is None else members.join(x.select(member, "x"), member, "left")).checkpoint()
    if dense is None:
        n = members.count()
        size = F.col("count").cast("double")
        listed = rows.groupBy(group).count().agg(F.sum(size * (size - 1))).first()[0] or 0
        dense = listed > n * (n - 1)
    if dense:
        return _met_by_blocks(rows, members, known, group, member, block, limit)
    wide = rows.join(members, member)
    largest, count = group_sizes(rows, [group])
    big = large_groups(rows, [group], SMALL_GROUP, largest)
    listed = _list_all(wide, big, group, member, ["x"], count, limit=limit).select(
        "low", "high", F.lit(None).cast("double").alias("value"), "x_1", "x_2", F.lit(1).alias("met"))
    told = known.select("low", "high", "value", *[F.lit(None).cast("double").alias(c) for c in ("x_1", "x_2")], F.lit(0).alias("met"))
    every = listed.unionByName(told).groupBy("low", "high").agg(*[F.max(c).alias(c) for c in ("value", "x_1", "x_2", "met")])
    return every.where("met = 1").drop("met")


def pool_pairs(members: DataFrame, pool: str, shared: DataFrame | None = None, *, max_members: int,
               member: str = "player_id", prefix: str = "PU", limit=None) -> DataFrame:
    """All member pairs of each pool, a synthetic id, and the shared-group count (0 when none).

    A pool is a closed table of fixed size, so its pairs are bounded; a pool above
    `max_members` is an error. For open pools use `met_pairs`, which lists the pairs that
    share a group.
    """
    seen = members.select(pool, member).distinct()
    require_empty(
        seen.groupBy(pool).count().where(F.col("count") > max_members),
        f"pools with more than {max_members} members",
    )
    left = seen.select(pool, F.col(member).alias("player_1"))
    right = seen.select(pool, F.col(member).alias("player_2"))
    out = left.join(right, pool).where(F.col("player_1") < F.col("player_2"))
    out = numbered(out, [F.col(pool), F.col("player_1"), F.col("player_2")], name="__n", limit=limit)
    out = out.withColumn("pair_id", F.concat(F.lit(prefix), F.format_string("%07d", F.col("__n") - 1)))
    if shared is None:
        return out.drop("__n")
    counts = shared.select(
        F.col("low").alias("player_1"), F.col("high").alias("player_2"), "shared_hands"
    )
    return (
        out.drop("__n").join(counts, ["player_1", "player_2"], "left").na.fill(0, ["shared_hands"])
        .select("pair_id", "player_1", "player_2", pool, "shared_hands")
    )


def unlabelled_pairs(all_pairs: DataFrame, known: DataFrame, min_shared: int) -> DataFrame:
    """Sufficiently exposed pairs that carry no label."""
    key = pair_key("player_1", "player_2")
    return (
        all_pairs.where(F.col("shared_hands") >= min_shared).withColumn("__k", key)
        .join(known.select(key.alias("__k")), "__k", "left_anti").drop("__k")
        .withColumns({"label_status": F.lit("unlabeled"), "training_role": F.lit("unlabeled")})
    )


def compare_sides(pairs: DataFrame, dim: DataFrame, gap_cols: dict[str, str], same_cols: list[str],
                  key: str = "player_id") -> DataFrame:
    """Profile of both members: absolute gaps and equality flags (unknown counts as unequal)."""
    need = [*gap_cols, *same_cols]
    out = pairs
    for i in (1, 2):
        one = dim.select(F.col(key).alias(f"player_{i}"), *[F.col(c).alias(f"{c}_{i}") for c in need])
        out = out.join(one, f"player_{i}", "left")
    out = out.withColumns({
        **{name: F.abs(F.col(f"{c}_1") - F.col(f"{c}_2")) for c, name in gap_cols.items()},
        **{
            f"same_{c}": F.coalesce(F.col(f"{c}_1") == F.col(f"{c}_2"), F.lit(False)).cast("int")
            for c in same_cols
        },
    })
    return out.drop(*[f"{c}_{i}" for c in same_cols for i in (1, 2)])


def compare_players(pairs: DataFrame, players: DataFrame) -> DataFrame:
    return compare_sides(pairs, players, {"account_age_days": "account_age_gap"}, SAME_COLUMNS)


def flag_members(df: DataFrame, keys_df: DataFrame, keys: list[str], name: str = "is_member") -> DataFrame:
    marked = keys_df.select(*keys).distinct().withColumn(name, F.lit(1))
    return df.join(marked, keys, "left").na.fill(0, [name])


def map_pairs(a: DataFrame, b: DataFrame, check: bool = True) -> DataFrame:
    """Pair ids of two universes matched on their unordered members."""
    left = orient(a.select(F.col("pair_id").alias("pair_id_a"), "player_1", "player_2"), "player_1", "player_2")
    right = orient(b.select(F.col("pair_id").alias("pair_id_b"), "player_1", "player_2"), "player_1", "player_2")
    out = left.select("pair_id_a", "low", "high").join(
        right.select("pair_id_b", "low", "high"), ["low", "high"], "left"
    )
    if check:  # by the members alone: the ids are sent once, for the result
        known = right.where("pair_id_b IS NOT NULL").select("low", "high")
        require_empty(left.select("low", "high").join(known, ["low", "high"], "left_anti"), "pairs without a counterpart")
    return out.select("pair_id_a", "pair_id_b")


def directed_to_pair(pairs: DataFrame, edges: DataFrame, how: str = "sum", src: str = "src",
                     dst: str = "dst", w: str = "w", name: str = "value") -> DataFrame:
    """Edge weights in both directions (0 when absent), added or the smaller one taken."""
    out = pairs.select("pair_id", "player_1", "player_2")
    for col, a, b in (("__f", "player_1", "player_2"), ("__r", "player_2", "player_1")):
        one = edges.select(F.col(src).alias(a), F.col(dst).alias(b), F.col(w).alias(col))
        out = out.join(one, ["player_1", "player_2"], "left").na.fill(0, [col])
    f, r = F.col("__f"), F.col("__r")
    return out.select("pair_id", (f + r if how == "sum" else F.least(f, r)).alias(name))


def paired_delta(a: DataFrame, b: DataFrame, keys: list[str], col: str, check: bool = True) -> DataFrame:
    """a - b per query; a query held by one side only is an error."""
    both = a.select(*keys, F.col(col).alias("__a")).join(
        b.select(*keys, F.col(col).alias("__b")), keys, "full_outer"
    )
    if check:
        require_empty(both.where("__a IS NULL OR __b IS NULL"), "methods cover different queries")
    return both.select(*keys, (F.col("__a") - F.col("__b")).alias("delta"))


def pairwise_preferences(df: DataFrame, pair: str, relevant: str, cols: list[str],
                         orders: str = "both", salt_rows: int = SALT_ROWS) -> DataFrame:
    """Evidence minus unjudged differences inside each pair, weights summing to 1 per pair.

    Evidence rows are few per pair (ranked slots), so rows grow with the unjudged side. Its
    rows are dealt out by a salt, so that no key holds much more than `salt_rows` of a pair;
    evidence, with the weight from the counted sizes, goes to every salt. `both` emits each
    difference and its mirror image; `one` emits a single, alternating orientation of each,
    which has the same logistic loss at half the rows.
    """
    flag = F.col(relevant).cast("int") == 1
    ensure_checkpoint_dir(df.sparkSession)
    sizes = df.groupBy(pair).agg(
        F.count_if(flag).alias("__e"), F.count_if(~flag).alias("__u")
    ).where("__e > 0 AND __u > 0").checkpoint()
    salts = max(1, -(-(sizes.agg(F.max("__u")).first()[0] or 0) // salt_rows))
    every = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("__salt")
    e = df.where(flag).select(pair, *[F.col(c).alias(f"{c}__e") for c in cols]).join(sizes, pair).select("*", every)
    # The salt is a function of the row, so a task that runs again deals it out alike.
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(salts)).cast("int").alias("__salt")
    u = df.where(~flag).select(pair, salt, *[F.col(c).alias(f"{c}__u") for c in cols])
    d = e.join(u, [pair, "__salt"])
    w = F.lit(1.0) / (F.col("__e") * F.col("__u"))
    diff = lambda s: [(s * (F.col(f"{c}__e") - F.col(f"{c}__u"))).alias(c) for c in cols]
    if orders == "both":
        sides = F.explode(F.array(F.lit(1), F.lit(0))).alias("target")
        d = d.select("*", sides)
        return d.select(pair, "target", (w / 2).alias("weight"), *diff(F.when(F.col("target") == 1, 1.0).otherwise(-1.0)))
    hashed = F.pmod(F.xxhash64(*[F.col(f"{c}__{t}") for c in cols for t in "eu"]), F.lit(2)).cast("int")
    d = d.withColumn("target", hashed)
    return d.select(pair, "target", w.alias("weight"), *diff(F.when(F.col("target") == 1, 1.0).otherwise(-1.0)))


def preference_summary(df: DataFrame, pair: str, relevant: str) -> DataFrame:
    """Per pair: candidates, evidence, unjudged and preference counts, zero-preference pairs kept."""
    flag = F.col(relevant).cast("int") == 1
    base = df.groupBy(pair).agg(
        F.count(F.lit(1)).alias("candidate_hands"),
        F.count_if(flag).alias("evidence_hands"),
        F.count_if(~flag).alias("unjudged_hands"),
    )
    prefs = F.col("evidence_hands") * F.col("unjudged_hands")
    return base.withColumns({
        "preference_pairs": prefs,
        "symmetric_rows": 2 * prefs,
        "total_symmetric_weight": F.when(prefs > 0, 1.0).otherwise(0.0),
    })


def assemble(base: DataFrame, *features: DataFrame, key: str | list[str] = "pair_id", check: bool = False) -> DataFrame:
    """One-to-one inner joins of feature tables.

    `check` reads each table once: joins of tables that repeat no key repeat none.
    """
    keys = [key] if isinstance(key, str) else list(key)
    if check:
        for i, table in enumerate((base, *features)):
            require_empty(duplicate_keys(table, keys), f"table {i} repeats {keys}")
    return reduce(lambda out, f: out.join(f, keys), features, base)
