"""Micro-batch ingestion of snapshots."""
