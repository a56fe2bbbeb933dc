"""Fragmenta: a Spark-first engine for provenance-tracked document corpora."""
