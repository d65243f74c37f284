"""Tidewheel: a PySpark-native analytics engine over time-stamped tables."""
