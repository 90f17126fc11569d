"""corvida: an evidence-archive analytics engine on plain PySpark."""

__version__ = "0.1.0"
