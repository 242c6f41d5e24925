"""Where stream records come from and where alerts go.

Kafka is one kind of endpoint; folders of files are another, and need no connector.
"""

from pyspark.sql import functions as F

from txrisk.settings import STREAM_TRIGGER


def kafka_source(spark, servers, topic, group=None, **options):
    """Message values as text, from the earliest offset on; Kafka partitions become tasks."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
    )
    if group:
        reader = reader.option("kafka.group.id", group)
    return reader.options(**options).load().select(F.col("value").cast("string").alias("value"))


def text_source(spark, path, **options):
    """One record per line in the files of a folder, as they arrive."""
    return spark.readStream.options(**options).text(path).select("value")


def table_source(spark, path, schema, **options):
    """Parquet files of a folder, as they arrive."""
    return spark.readStream.schema(schema).options(**options).parquet(path)


def _started(writer, checkpoint, once):
    writer = writer.option("checkpointLocation", checkpoint).outputMode("append")
    trigger = {"availableNow": True} if once else {"processingTime": STREAM_TRIGGER}
    return writer.trigger(**trigger).start()


def to_kafka(alerts, servers, topic, checkpoint, once=False):
    """Alert text keyed by transaction id, at least once; consumers can upsert by key."""
    keyed = alerts.select(F.col("transactionId").alias("key"), F.col("value"))
    writer = (
        keyed.writeStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
    )
    return _started(writer, checkpoint, once)


def send(messages, servers, topic):
    """One batch of (transactionId, value) to a topic, keyed by the id."""
    keyed = messages.select(F.col("transactionId").alias("key"), "value")
    writer = keyed.write.format("kafka").option("kafka.bootstrap.servers", servers)
    writer.option("topic", topic).save()


def to_table(stream, path, checkpoint, once=False, *partition_columns):
    """Parquet files with exactly-once commits."""
    writer = stream.writeStream.format("parquet").option("path", path)
    if partition_columns:
        writer = writer.partitionBy(*partition_columns)
    return _started(writer, checkpoint, once)


def to_batches(stream, write, checkpoint, once=False):
    """Hands every micro-batch to ``write(batch, number)``."""
    return _started(stream.writeStream.foreachBatch(write), checkpoint, once)
