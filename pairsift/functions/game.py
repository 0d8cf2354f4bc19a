"""Expressions over cards, actions and pair measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..scale import as_col
from .scalars import clip, flag, log1p0, num0, safe_ratio, strict_least

# Card ranks.
RANKS = {
    "2": 2, "3": 3, "4": 4, "5": 5, "6": 6, "7": 7, "8": 8, "9": 9, "10": 10,
    "T": 10, "J": 11, "Q": 12, "K": 13, "A": 14,
}


def pair_key(a, b) -> Column:
    """Order-free key of two ids: smaller id, unit separator, larger id."""
    a, b = as_col(a).cast("string"), as_col(b).cast("string")
    return F.when(a.isNotNull() & b.isNotNull(), F.concat_ws("\x1f", F.least(a, b), F.greatest(a, b)))


def orient(df: DataFrame, a: str, b: str, low: str = "low", high: str = "high") -> DataFrame:
    """Add the two ids in sorted order."""
    return df.withColumns({low: F.least(F.col(a), F.col(b)), high: F.greatest(F.col(a), F.col(b))})


def _rank(card: Column) -> Column:
    lookup = F.create_map(*[F.lit(x) for kv in RANKS.items() for x in kv])
    token = F.left(card, F.length(card) - 1)
    return F.coalesce(F.try_element_at(lookup, token), F.lit(0))


def card_strength(c1, c2) -> Column:
    """High rank, plus 7 for a pair, 1.5 for one suit, up to 1 for closeness."""
    c1 = F.upper(F.coalesce(as_col(c1), F.lit("")))
    c2 = F.upper(F.coalesce(as_col(c2), F.lit("")))
    r1, r2 = _rank(c1), _rank(c2)
    return (
        F.greatest(r1, r2)
        + F.when(r1 == r2, 7.0).otherwise(0.0)
        + F.when(F.right(c1, F.lit(1)) == F.right(c2, F.lit(1)), 1.5).otherwise(0.0)
        + F.greatest(F.lit(0), F.lit(4) - F.abs(r1 - r2)) / F.lit(4.0)
    ).cast("double")


def is_aggressive(action, amount, to_call) -> Column:
    action = F.lower(as_col(action))
    return action.isin("bet", "raise") | ((action == "all_in") & (num0(amount) > num0(to_call)))


def action_flags(action="action", street="street", amount="amount", to_call="to_call") -> dict[str, Column]:
    """0/1 columns per event: kind of action and pressure."""
    a, s = F.lower(as_col(action)), F.lower(as_col(street))
    return {
        "aggressive_actions": flag(is_aggressive(action, amount, to_call)),
        "raises": flag(a == "raise"),
        "bets": flag(a == "bet"),
        "calls": flag(a == "call"),
        "checks": flag(a == "check"),
        "folds": flag(a == "fold"),
        "all_ins": flag(a == "all_in"),
        "postflop_checks": flag((s != "preflop") & (a == "check")),
        "facing_pressure": flag(num0(to_call) > 0),
    }


def action_code(action="action", aggressive="is_aggressive", ratio="amount_pot_ratio") -> Column:
    """0 fold, 1 check, 2 call or passive all-in, 3 small and 4 large aggression, else NULL."""
    a, agg = F.lower(as_col(action)), F.coalesce(as_col(aggressive), F.lit(False))
    return (
        F.when(a == "fold", 0)
        .when(a == "check", 1)
        .when((a == "call") | ((a == "all_in") & ~agg), 2)
        .when(agg & (F.coalesce(as_col(ratio), F.lit(0.0)) < 0.5), 3)
        .when(agg, 4)
    )


def state_code(street="street", to_call_bb="to_call_bb", active="players_active") -> Column:
    """Street, price and table-size bins in one small integer."""
    s = (
        F.when(as_col(street) == "preflop", 0)
        .when(as_col(street) == "flop", 1)
        .when(as_col(street) == "turn", 2)
        .otherwise(3)
    )
    t = as_col(to_call_bb)
    price = F.when(t <= 0, 0).when(t <= 1, 1).when(t <= 4, 2).otherwise(3)
    n = as_col(active)
    crowd = F.when(n <= 2, 0).when(n <= 4, 1).otherwise(2)
    return s * 12 + price * 3 + crowd


def pair_measures() -> dict[str, Column]:
    """Pair-hand measures from columns suffixed `_1` and `_2`; a missing side gives NULL."""
    c = F.col
    both = lambda name: c(f"{name}_1") + c(f"{name}_2")
    loss_1 = strict_least(clip(-c("net_bb_1"), 0.0), clip("net_bb_2", 0.0))
    loss_2 = strict_least(clip(-c("net_bb_2"), 0.0), clip("net_bb_1", 0.0))
    aggression = both("aggressive_actions")
    passive = both("calls") + both("checks")
    expected_aggression = both("base_aggressive_actions")
    expected_passive = both("base_calls") + both("base_checks")
    f1, f2 = F.coalesce(c("folded_1"), F.lit(False)), F.coalesce(c("folded_2"), F.lit(False))
    contribution = both("contribution_bb")
    return {
        "pair_contribution_bb": contribution,
        "contribution_gap_bb": F.abs(c("contribution_bb_1") - c("contribution_bb_2")),
        "net_gap_bb": F.abs(c("net_bb_1") - c("net_bb_2")),
        "max_win_bb": clip(F.greatest("net_bb_1", "net_bb_2"), 0.0),
        "max_loss_bb": clip(-F.least("net_bb_1", "net_bb_2"), 0.0),
        "transfer_1_to_2_bb": loss_1,
        "transfer_2_to_1_bb": loss_2,
        "transfer_any_bb": F.greatest(loss_1, loss_2),
        "both_showdown": flag(c("went_to_showdown_1") & c("went_to_showdown_2")),
        "one_folded": flag(f1 != f2),
        "pair_aggression": aggression,
        "pair_passive": passive,
        "expected_aggression": expected_aggression,
        "expected_passive": expected_passive,
        "aggression_residual": aggression - expected_aggression,
        "passive_residual": passive - expected_passive,
        "pair_pot_share": contribution / (c("pot_bb_1") + F.lit(1e-3)),
        "pair_raises": both("raises"),
        "pair_folds": both("folds"),
        "max_hole_strength": F.greatest("hole_strength_1", "hole_strength_2"),
    }


def pair_signals() -> dict[str, Column]:
    """The three suspicion signals from the pair measures."""
    c = F.col
    directed = log1p0("transfer_any_bb") + 0.25 * log1p0("net_gap_bb") + 0.15 * c("both_showdown")
    soft = (
        log1p0("pair_passive") + 0.65 * c("both_showdown") - 0.55 * log1p0("pair_aggression")
        + 0.35 * c("passive_residual") - 0.45 * c("aggression_residual")
    )
    isolation = (
        log1p0("pair_aggression") + 0.35 * log1p0("pair_contribution_bb")
        + 0.25 * clip("pair_pot_share", 0.0, 1.0) - 0.20 * c("both_showdown")
    )
    return {"directed_signal": directed, "soft_signal": soft, "isolation_signal": isolation}


def route_score(family, mapping: dict[str, str], default: bool = True) -> Column:
    """Signal chosen by predicted family; else the largest signal, or NULL when strict."""
    fam = as_col(family)
    chain = F.when(F.lit(False), F.lit(None).cast("double"))
    for name, column in mapping.items():
        chain = chain.when(fam == name, F.col(column))
    return chain.otherwise(F.greatest(*mapping.values())) if default else chain


def event_ratio(amount="amount", pot="pot_before", blind="big_blind") -> Column:
    """Bet size against the pot, at least one blind, bounded to 0..20."""
    b = F.nullif(as_col(blind).cast("double"), F.lit(0.0))
    base = F.when(b.isNotNull(), F.greatest(num0(pot), b))
    return safe_ratio(num0(amount), base, 0.0, 0.0, 20.0)
