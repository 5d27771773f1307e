"""tarmac: airline on-time performance analytics as Spark DataFrame operators.

Every public operator is a function ``DataFrame(s) -> DataFrame`` built from
``pyspark.sql.functions`` so Catalyst plans, prunes and pushes it down.
"""

__version__ = "0.1.0"
