"""Text-classification data engine on PySpark DataFrames.

Every operator takes and returns DataFrames (or builds Columns) and leaves the
physical plan to Catalyst.  See README.md for the map of modules.
"""

__version__ = "0.1.0"
