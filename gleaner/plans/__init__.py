"""The query language: lexer, parser, tree rewrites, and compilation to columns."""
