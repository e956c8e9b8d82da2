"""tessera: Spark-native analytics operators as functions from DataFrames to DataFrames."""
