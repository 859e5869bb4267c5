"""stockline: stock and sales analytics as Spark DataFrame operators.

Tables in, DataFrames out. See README.md for the operator inventory.
"""

__version__ = "0.1.0"
