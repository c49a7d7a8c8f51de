"""Event folding and incremental processing, as batch plans and as Structured Streaming twins."""
