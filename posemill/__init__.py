"""Pose time-series analytics as composable DataFrame operations."""
