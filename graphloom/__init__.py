"""graphloom: community detection by statistical inference, expressed as Spark plans."""

__version__ = "0.1.0"
