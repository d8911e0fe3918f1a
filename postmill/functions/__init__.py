"""Row-level rules as Column expressions."""
