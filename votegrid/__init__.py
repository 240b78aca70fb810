"""votegrid: nearest-neighbour risk scoring and corpus preparation on Spark.

Sub-packages
------------
functions   column expressions: timestamps, feature lanes, distances
sources     readers, writers and validation of requests, references, indexes
operators   top-k, votes, inverted-file and product-quantised search, training
plans       configuration presets, planner, fixtures, query catalogue
streaming   the scoring plan over unbounded input
llm         training-data operators (stands alone; nothing here imports it)
"""

__version__ = "0.1.0"
