"""Relational operators over snapshots, outcomes, markets and draws; all take and return DataFrames."""
