"""reelbase: a PySpark-native analytics engine for media-library catalogues."""
