"""Readers of snapshots, archives and metadata, and report sinks."""
