"""Scalar expressions (Column -> Column) built from Spark built-ins."""
