"""flowlens: network-flow attack analytics as Spark DataFrame operators.

Every operator is a ``DataFrame -> DataFrame`` function (usable with ``df.transform``)
built on Spark SQL, Spark ML and Structured Streaming primitives.
"""

__version__ = "0.1.0"
