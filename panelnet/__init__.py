"""Entity typing and tracking on temporal similarity networks, expressed in Spark DataFrames."""
