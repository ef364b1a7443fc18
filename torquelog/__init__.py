"""PySpark-native analytics for free-text service and maintenance records."""
