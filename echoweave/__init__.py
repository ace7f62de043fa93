"""Spark-native building, sampling and validation of statistical models of radar target measurements."""
