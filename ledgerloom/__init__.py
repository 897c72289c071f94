"""Spark jobs for marketplace event logs: decode, features, backtests, evidence, streams."""
