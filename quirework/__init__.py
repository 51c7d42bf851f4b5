"""Spark-native page segmentation, text-pattern analytics and corpus operators."""
