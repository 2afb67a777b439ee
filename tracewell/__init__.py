"""Spark-native selection of training signal from language-model traces."""
