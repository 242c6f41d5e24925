"""Which columns the files of a folder really have, from their footers."""

import sys

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

register_pickle_by_value(sys.modules[__name__])

FOOTERS = "path STRING, rows BIGINT, column STRING, type STRING"


def _opened(path):
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" not in path:
        return pyarrow.fs.LocalFileSystem().open_input_file(path)
    system, inner = pyarrow.fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def _footers(batches):
    for batch in batches:
        lines = []
        for path in batch.column(0).to_pylist():
            with _opened(path) as file:
                footer = pyarrow.parquet.ParquetFile(file)
                rows, leaves = footer.metadata.num_rows, footer.schema
                # Spark's older timestamps have no zone in the file but are instants all the same.
                instants = {c.path for c in map(leaves.column, range(len(leaves.names))) if c.physical_type == "INT96"}
                for field in footer.schema_arrow:
                    kind = "timestamp" if field.name in instants else from_arrow_type(field.type, True).simpleString()
                    lines.append((path, rows, field.name, kind))
        columns = list(zip(*lines)) if lines else [[], [], [], []]
        kinds = (pa.string(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(c), kind) for c, kind in zip(columns, kinds)], names=["path", "rows", "column", "type"]
        )


def file_columns(spark, folder):
    """(path, rows, column, type): a row for each column of each Parquet file below a folder.

    Tasks read footers only. Partition columns, which are in the path, have the type ``partition``.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
        .load(folder).select("path")
    )
    stored = files.mapInArrow(_footers, FOOTERS)
    from_path = stored.select("path", "rows").distinct().select(
        "path", "rows", F.explode(F.regexp_extract_all("path", F.lit("/([^/=]+)=[^/]*(?=/)"), 1)).alias("column"),
        F.lit("partition").alias("type"),
    )
    return stored.unionByName(from_path)


def layout_problems(columns, required):
    """(path, rows, column, problem): what each file lacks, or has in another type.

    ``required`` maps columns to types, or to None where any type will do. A partition column's type
    is not checked, as its files don't hold it.
    """
    found = columns.groupBy("path", "rows").agg(F.map_from_entries(F.collect_set(F.struct("column", "type"))).alias("has"))
    wanted = F.array(*(
        F.struct(F.lit(c).alias("column"), F.lit(t).cast("string").alias("type")) for c, t in required.items()
    ))
    checked = found.select("path", "rows", "has", F.inline(wanted))
    own = F.try_element_at("has", F.col("column"))
    problem = F.when(own.isNull(), "missing").when(
        F.col("type").isNotNull() & ~own.isin("partition") & (own != F.col("type")), F.concat(F.lit("is "), own)
    )
    return checked.select("path", "rows", "column", problem.alias("problem")).where(F.col("problem").isNotNull())


def require_layout(spark, folder, required):
    """Raises if a file below the folder lacks a column or has another type; names up to ten."""
    problems = layout_problems(file_columns(spark, folder), required).limit(10).collect()
    if problems:
        raise ValueError("; ".join(f"{r['path']}: {r['column']} {r['problem']}" for r in problems))
    return folder
