"""PySpark-native land-change analytics over gridded and point observations."""
