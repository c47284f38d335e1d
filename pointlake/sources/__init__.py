"""Stored collections: commits, checkpoints, snapshots, exchange files."""
