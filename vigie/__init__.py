"""vigie: area-by-day indicator analytics on PySpark.

Every public operator is either ``Column -> Column`` (``vigie.functions``)
or ``DataFrame -> DataFrame`` (``vigie.operators``, ``vigie.plans``) and is
built from native Spark expressions, so Catalyst sees one lazy plan.
"""

__version__ = "0.1.0"
