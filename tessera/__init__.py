"""Traceable knowledge from document corpora, as Spark DataFrame operators."""
