"""A PySpark-native engine for repository analytics: relations, operators and reports as DataFrames."""
