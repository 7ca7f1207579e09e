"""All registered queries of the library with their SQL."""

from loomgraph.queries import graphs, processes, records, relational, surfaces
from loomgraph.queries.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "graphs", "processes", "records", "relational", "surfaces"]
