"""Following tables that grow: the incremental operators behind Structured Streaming."""
