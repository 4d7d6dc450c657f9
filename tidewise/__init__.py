"""tidewise: Spark-native analytics for regional, seasonal demand statistics.

Layout
------
functions/  Column -> Column building blocks (parsing, exact ratios, labels)
sources/    staging CSV scan/write, clean-table sinks, dimensions, test bindings
operators/  DataFrame -> DataFrame analytics operators (pivots, shares, seasonality,
            comparison, evolution, capacity, data quality)
plans/      composed jobs: ETL, the eleven analytical queries, measures, page datasets
streaming/  incremental (Structured Streaming) load of newly arriving extracts
"""

__version__ = "0.1.0"
