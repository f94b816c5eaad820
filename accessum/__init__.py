"""Chromatin-accessibility analytics on PySpark: interval algebra, quality control, counts, peaks, topics, markers."""
