"""flowlake: traffic and event-table analytics on Spark DataFrames."""

__version__ = "0.1.0"
