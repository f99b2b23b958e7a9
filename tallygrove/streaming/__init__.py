"""The incremental run on a stream."""
