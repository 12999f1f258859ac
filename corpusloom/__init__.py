"""Spark-first analytics for catalogues of works in many versions, retrieval over them, and their evaluation."""
