"""Tidemark: early-warning analytics over dated, linked and attributed records, built on Spark."""
