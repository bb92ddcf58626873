"""All queries over the driver's tables; importing the modules lists them."""

from vellumspark.plans import codecs, files, queries, scalars
from vellumspark.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "codecs", "files", "queries", "scalars"]
