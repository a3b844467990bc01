"""Operators from table to table: windows, joins, statistics, agreement, sampling, clustering and learning."""
