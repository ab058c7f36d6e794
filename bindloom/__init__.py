"""bindloom: a PySpark-native engine for name-linked property graphs.

Definitions (nodes) and references (edges) are DataFrames; every operator is a
lazy DataFrame-to-DataFrame function that leaves join choice, pruning, pushdown
and skew handling to Catalyst and AQE.
"""

__version__ = "0.1.0"
