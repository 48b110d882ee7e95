"""A PySpark-native engine for curating and analysing labelled speech and text corpora."""
