"""tablewright: a Spark-native table-quality and feature-preparation engine.

Profiles a table in a constant number of passes, plans and applies
deterministic cleaning under named strategies, gates every result with
independent checks, splits train/test exactly without leakage, trains
boosted trees on Spark ML and compares strategies with a naive baseline.
Everything is DataFrame expressions; see README.md for the layout.
"""

__version__ = "0.1.0"
