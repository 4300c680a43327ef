"""Training-data operators over `documents`-like tables (ten operators and their queries)."""
