"""A Spark-native analytics engine for tabular, series and materials-science data."""
