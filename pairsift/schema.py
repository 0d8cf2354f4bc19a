"""Fixed column names and label values of the input tables."""

# Required input columns per table.
REQUIRED_COLUMNS = {
    "players": [
        "player_id", "account_age_days", "experience_hands_bucket",
        "preferred_stake", "region_bucket", "client_family",
    ],
    "hands": ["hand_id", "phase", "table_id", "started_at", "big_blind", "final_pot"],
    "seats": [
        "hand_id", "player_id", "seat_no", "hole_card_1", "hole_card_2", "starting_stack",
        "total_contribution", "net_chips", "folded", "went_to_showdown", "won_share",
    ],
    "actions": [
        "hand_id", "action_no", "street", "player_id", "action",
        "amount", "to_call", "pot_before", "players_active",
    ],
    "development_labels": ["pair_id", "player_1", "player_2", "label", "behavior_family"],
    "development_evidence": ["pair_id", "hand_id"],
    "evaluation_pairs": ["pair_id", "player_1", "player_2", "shared_hands"],
    "sample_submission": [
        "pair_id", "risk_score", "predicted_behavior",
        "evidence_hand_1", "evidence_hand_2", "evidence_hand_3",
        "evidence_hand_4", "evidence_hand_5",
    ],
}

# Slot columns, label values and the empty-slot sentinel.
EVIDENCE_SLOTS = [f"evidence_hand_{i}" for i in range(1, 6)]
FAMILIES = ["directed_transfer", "soft_play", "coordinated_isolation"]
ALLOWED_BEHAVIORS = ["none", *FAMILIES, "other_coordination"]
NO_EVIDENCE = "NO_EVIDENCE"
FAMILY_SIGNALS = {
    "directed_transfer": "directed_signal",
    "soft_play": "soft_signal",
    "coordinated_isolation": "isolation_signal",
}

# Per (hand, player) action measures.
ACTION_SUMS = [
    "n_actions", "aggressive_actions", "raises", "bets", "calls", "checks", "folds",
    "all_ins", "postflop_checks", "facing_pressure", "amount_bb_sum", "to_call_bb_sum",
]
ACTION_MAXIMA = ["amount_bb_max", "to_call_bb_max", "amount_pot_ratio_max"]
ACTION_MEASURES = ACTION_SUMS + ACTION_MAXIMA

# Measures averaged into a player's baseline.
BASELINE_MEASURES = [
    "aggressive_actions", "calls", "checks", "folds",
    "facing_pressure", "contribution_bb", "net_bb",
]

# The 20 pair-hand measures used for evidence ranking, and the 3 signals.
PAIR_MEASURES = [
    "pair_contribution_bb", "contribution_gap_bb", "net_gap_bb", "max_win_bb", "max_loss_bb",
    "transfer_1_to_2_bb", "transfer_2_to_1_bb", "transfer_any_bb", "both_showdown",
    "one_folded", "pair_aggression", "pair_passive", "expected_aggression",
    "expected_passive", "aggression_residual", "passive_residual", "pair_pot_share",
    "pair_raises", "pair_folds", "max_hole_strength",
]
SIGNALS = ["directed_signal", "soft_signal", "isolation_signal"]
SUMMARY_FIELDS = ["phase_progress", *PAIR_MEASURES, *SIGNALS]

# Per pair-hand response counts.
INTERACTION_COUNTS = [
    "true_hu_actions", "true_hu_checks", "true_hu_calls", "true_hu_aggression",
    "p1_hu_passive", "p2_hu_passive",
    "partner_folds_to_pair", "partner_calls_to_pair", "partner_raises_to_pair",
    "outsider_folds_to_pair", "outsider_calls_to_pair", "outsider_raises_to_pair",
]

# Profile columns compared between the two players of a pair.
SAME_COLUMNS = ["experience_hands_bucket", "preferred_stake", "region_bucket", "client_family"]
