"""lakeward: multi-tenant table analytics written on Spark DataFrames."""
