"""Spark-native analytics over tables of boxes, run-length masks, planes, texts and review events."""
