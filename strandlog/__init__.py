"""Keyed-log analytics as composable DataFrame operators on Spark."""
