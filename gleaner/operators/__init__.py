"""Index building, lexical and semantic search, synonyms, workloads."""
