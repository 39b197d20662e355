"""tidemark: selective reads, certified top-k, paired measurements and data
profiling on Spark DataFrames."""

__version__ = "0.1.0"
