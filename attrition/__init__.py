"""attrition — customer-attrition analytics as Spark DataFrame operators.

Every operator takes and returns a ``pyspark.sql.DataFrame`` (or a small
driver-side object such as a fitted model) and keeps the heavy work inside
Catalyst: one wide aggregation instead of one job per column, unpivot +
groupBy instead of per-variable loops, and a two-phase prefix sum instead
of a single-task global window.
"""

from attrition.session import get_spark, scratch_path  # noqa: F401

__version__ = "0.1.0"
