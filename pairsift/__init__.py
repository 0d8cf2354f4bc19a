"""Pair-interaction analytics on Spark: DataFrame operators over group, member and event logs."""
