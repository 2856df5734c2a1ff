"""tessera: a PySpark-native text-analytics engine.

Every operator is a ``DataFrame -> DataFrame`` function (or a ``Column -> Column``
expression) so that Catalyst sees one declarative plan; Arrow-batched Python is used
only where sequence dynamic programming, seeded sampling or numeric fitting cannot be
expressed relationally.
"""
