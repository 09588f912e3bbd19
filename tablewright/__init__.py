"""Profile, clean, reshape and prepare tables of any size with PySpark."""

__version__ = "0.1.0"
