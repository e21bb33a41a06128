"""eventide: how text events move time series, as PySpark DataFrame jobs."""

__version__ = "0.1.0"
