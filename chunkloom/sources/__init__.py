"""Readers and writers for snapshots, diffs, feeds, deliveries and versioned tables."""
