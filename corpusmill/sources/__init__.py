"""Scans: repository trees, snapshots, the chunk store and object paths."""
