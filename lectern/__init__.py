"""lectern: book-to-audio text ETL as declarative Spark plans."""

__version__ = "0.1.0"
