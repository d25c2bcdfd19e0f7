"""recordloom: literature-data operators as Spark DataFrame transformations."""

from recordloom.session import tune

__all__ = ["tune"]
