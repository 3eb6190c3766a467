"""sievework: curation of labelled corpora as lazy Spark DataFrame operators."""

__version__ = "0.1.0"
