"""Curation, profiling and retrieval of question/answer corpora on Apache Spark."""
