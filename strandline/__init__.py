"""strandline: local-ancestry and conditional-SFS analytics as Spark DataFrame plans."""

__version__ = "0.1.0"
