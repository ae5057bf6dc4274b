"""Bibliographic analytics over whole corpora, written as Spark DataFrame operators."""
