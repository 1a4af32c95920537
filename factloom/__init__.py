"""factloom: fact verification and consolidation as Spark DataFrame plans."""

__version__ = "0.1.0"
