"""A PySpark-native engine for cleaning, joining, retrieving, scoring and modelling visit records."""
