"""weftgraph: architecture-graph analytics and data processing, planned by Spark."""

__version__ = "0.1.0"
