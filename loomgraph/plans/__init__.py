"""All registered queries of the library (without the llm subpackage)."""

from loomgraph.plans import graphs, networks, texts  # noqa: F401  they register
from loomgraph.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
