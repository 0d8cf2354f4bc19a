"""Small input tables with planted behaviour."""

from pyspark.sql import functions as F

SEATS = ("hand_id string, player_id string, seat_no int, hole_card_1 string, hole_card_2 string, starting_stack double, "
         "total_contribution double, net_chips double, folded boolean, went_to_showdown boolean, won_share double")
HANDS = "hand_id string, phase string, table_id string, started_at int, big_blind double, final_pot double"
ACTIONS = ("hand_id string, player_id string, street string, action string, amount double, to_call double, "
           "pot_before double, action_no int, players_active int")
PLAYERS = ("player_id string, account_age_days int, experience_hands_bucket string, preferred_stake string, "
           "region_bucket string, client_family string")


def two_hands(spark):
    """Two hands of six players; p1 loses 40 to p2 in the first."""
    ps = [f"p{i}" for i in range(1, 7)]
    net = {("h1", "p1"): -40.0, ("h1", "p2"): 40.0}
    return {
        "players": spark.createDataFrame([(p, 10 * i, "b", "s", "r", "c") for i, p in enumerate(ps)], PLAYERS),
        "hands": spark.createDataFrame([(h, "development", "t1", i, 2.0, 80.0) for i, h in enumerate(("h1", "h2"))], HANDS),
        "seats": spark.createDataFrame(
            [(h, p, i, "Ah", "Kh", 200.0, 10.0, net.get((h, p), 0.0), False, p in ("p1", "p2"), 0.0)
             for h in ("h1", "h2") for i, p in enumerate(ps)], SEATS),
        "actions": spark.createDataFrame(
            [(h, p, "preflop", "call", 2.0, 2.0, 3.0, i, 6) for h in ("h1", "h2") for i, p in enumerate(ps)], ACTIONS),
        "pairs": spark.createDataFrame([("pair", "p2", "p1", 2)], "pair_id string, player_1 string, player_2 string, shared_hands int"),
    }


def six_pools(spark, pools: int = 6):
    """Pools of six players with development and evaluation hands, labels and evidence."""
    families = ["directed_transfer", "soft_play", "coordinated_isolation"]
    players, hands, seats, actions, labels, evidence, evaluation = [], [], [], [], [], [], []
    for g in range(pools):
        ps = [f"g{g}p{i}" for i in range(6)]
        players += [(p, 100 + i, "b", "s", "r", "c") for i, p in enumerate(ps)]
        for n in range(7):
            h, phase = f"g{g}h{n}", "development" if n < 4 else "evaluation"
            hands.append((h, phase, f"t{g}", n, 2.0, 60.0))
            for i, p in enumerate(ps):
                net = (-20.0 - n if i == 0 else 20.0 + n if i == 1 else 0.0) if n % 2 == 0 else float(i - 3)
                seats.append((h, p, i, "Ah", "10d", 200.0, 10.0 + i, net, i > 3, i < 2, 0.0))
                actions.append((h, p, "flop", "raise" if i % 2 else "call", 4.0 + i, 2.0, 10.0, i, 6))
        labels += [(f"g{g}pos", ps[0], ps[1], 1, families[g % 3], "confirmed_target"),
                   (f"g{g}neg", ps[2], ps[3], 0, "none", "confirmed_negative")]
        evidence.append((f"g{g}pos", f"g{g}h0", families[g % 3], 1))
        evaluation.append((f"g{g}eval", ps[0], ps[1], 3))
    return {
        "players": spark.createDataFrame(players, PLAYERS), "hands": spark.createDataFrame(hands, HANDS),
        "seats": spark.createDataFrame(seats, SEATS), "actions": spark.createDataFrame(actions, ACTIONS),
        "development_labels": spark.createDataFrame(
            labels, "pair_id string, player_1 string, player_2 string, label int, behavior_family string, label_status string"),
        "development_evidence": spark.createDataFrame(evidence, "pair_id string, hand_id string, behavior_family string, evidence_rank int"),
        "evaluation_pairs": spark.createDataFrame(evaluation, "pair_id string, player_1 string, player_2 string, shared_hands int"),
    }


def skewed_seats(spark, n: int = 300):
    """One hand holds a third of all seats and one player sits in every hand."""
    crowd = [("big", f"m{i:03d}") for i in range(n)]
    rest = [(f"h{i:03d}", p) for i in range(n // 3) for p in ("hot", f"m{i:03d}", f"m{(i * 7 + 1) % n:03d}", f"m{(i + 1) % n:03d}")]
    return spark.createDataFrame(sorted(set(crowd + rest)), "hand_id string, player_id string")


def brute_counts(seats):
    """Shared-hand counts by enumeration on the driver, for small fixtures."""
    from collections import Counter, defaultdict
    from itertools import combinations

    groups = defaultdict(set)
    for h, p in seats.select("hand_id", "player_id").collect():
        groups[h].add(p)
    return Counter(pair for members in groups.values() for pair in combinations(sorted(members), 2))


__all__ = ["two_hands", "six_pools", "skewed_seats", "brute_counts", "F"]
