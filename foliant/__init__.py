"""Foliant: Spark-native document analytics (sources, TOC and section analysis, spoken-text
normalisation, dialogue timelines, job streams). Every operator maps DataFrames to DataFrames."""

__version__ = "0.1.0"
