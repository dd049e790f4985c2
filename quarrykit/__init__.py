"""quarrykit: content-inventory and training-data jobs for PySpark."""

__version__ = "0.3.0"
