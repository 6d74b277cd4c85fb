"""webmine: crawl-data jobs on Spark.

``functions`` holds Column expressions and fixed values, ``sources`` the readers and sinks, ``operators`` the
DataFrame -> DataFrame jobs, ``streaming`` the Structured Streaming variants and ``plans`` the registered queries,
their DuckDB oracles and the derived test views.
"""

__version__ = "0.1.0"
