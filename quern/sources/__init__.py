"""Where documents and records are kept: Parquet snapshots published by a commit log."""
