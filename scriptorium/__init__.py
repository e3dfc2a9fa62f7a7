"""A PySpark-native analytics engine for corpora of research papers kept as markdown."""

__version__ = "0.1.0"
