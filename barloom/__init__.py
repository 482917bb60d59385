"""barloom: market-panel analytics written as Spark DataFrame programs."""

__version__ = "0.1.0"
