"""loomwright: product analytics on PySpark DataFrames.

Everything is declared as DataFrame or SQL plans; Python runs only where the built-in functions cannot say it.
"""

__version__ = "0.1.0"
