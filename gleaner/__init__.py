"""gleaner: full-text and vector search over document tables, expressed as Spark plans."""

__version__ = "0.1.0"
