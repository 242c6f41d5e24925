"""Tables stored in buckets by their id, so that joins and regroupings by it need no shuffle.

Rows are dealt to buckets by the hash that Spark shuffles with, one file a bucket, sorted by id. Two
tables with the same number of buckets join bucket by bucket, and grouping by the id stays inside
a bucket; the one shuffle is paid when the table is stored. The layout is known to the session's
catalog: :func:`store_bucketed` enters it, and :func:`open_bucketed` enters a stored table again in
another session.
"""

import uuid


def store_bucketed(df, path, key, buckets, name=None):
    """Overwrites ``path`` with the rows in buckets and returns the table as a DataFrame.

    ``buckets`` is best a multiple of the cluster's cores and keeps a bucket of all columns in memory;
    ids should be unique or nearly so, as all rows of an id share a bucket.
    """
    name = name or f"bucketed_{uuid.uuid4().hex}"
    writer = df.repartition(buckets, key).write.mode("overwrite").format("parquet")
    writer.option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    return df.sparkSession.table(name)


def open_bucketed(spark, path, schema, key, buckets, name=None):
    """A table stored by :func:`store_bucketed`, also by an earlier session, with its buckets known."""
    name = name or f"bucketed_{uuid.uuid4().hex}"
    place = path.replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE `{name}` ({schema.toDDL()}) USING parquet "
        f"CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{place}'"
    )
    return spark.table(name)
