"""vellum: document analytics with uncertainty, expressed as Spark DataFrame operators.

Every operator takes and returns Spark DataFrames (or Columns) keyed by an explicit
document id, so the heavy work runs as distributed scans, joins, aggregates and windows.
"""

__version__ = "0.1.0"
