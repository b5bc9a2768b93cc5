"""Spark-native augmentation of labelled volumes."""
