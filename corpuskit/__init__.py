"""corpuskit: Spark jobs that turn a corpus of scientific documents into queryable tables."""

__version__ = "0.1.0"
