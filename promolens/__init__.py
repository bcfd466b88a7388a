"""promolens: campaign performance analytics as Spark DataFrame jobs.

Layout:
  sources/    raw table schemas, readers, the test-table mapping
  functions/  exact rounding, ratios, percentiles, shared expressions
  operators/  the metric, mart and data-quality builders
  plans/      query registry, DuckDB oracle SQL, join helpers
  llm/        operators for training-data pipelines (optional; nothing else imports it)
"""

__version__ = "0.1.0"
