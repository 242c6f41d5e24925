"""Collects queries under their names, with the SQL that must give the same rows."""

from txrisk.catalog.sql import with_views
from txrisk.catalog.views import Views

QUERIES = {}
ORACLES = {}


def query(name, sql=None):
    """Registers a function of :class:`Views`; ``sql`` may name any shared SQL view."""

    def register(function):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: function(Views(spark, folder))
        if sql:
            ORACLES[name] = with_views(sql)
        return function

    return register


def rounded(df, *columns, digits=6):
    """Computed doubles, rounded so that engines agree on the last digits."""
    from pyspark.sql import functions as F

    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})
