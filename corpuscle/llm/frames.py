"""Small helpers on DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str) -> Column:
    """A column by its name, whatever characters that has."""
    return F.col("`" + name.replace("`", "``") + "`")


def named(columns: list[str]) -> Column:
    """The columns as one struct."""
    return F.struct(*map(col, columns))


def unpack(column: str, fields: list[str]) -> list[Column]:
    return [F.col(column).getField(c).alias(c) for c in fields]


def free_name(columns: list[str], wanted: str) -> str:
    """``wanted``, or the same with underscores until no column has it (Spark ignores case)."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


ROWS_PER_BATCH = 500
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def map_texts(source: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` over documents.  Batches count rows, not bytes, and 10,000 documents would be hundreds of megabytes on both sides of the pipe:
    the session's limit is lowered to ``ROWS_PER_BATCH`` if it is above."""
    conf = source.sparkSession.conf
    if not 0 < int(conf.get(_BATCH_SETTING)) <= ROWS_PER_BATCH:
        conf.set(_BATCH_SETTING, str(ROWS_PER_BATCH))
    return source.mapInArrow(run, schema)


def row_schema(source: DataFrame, rest: str) -> T.StructType:
    """Schema of column ``row`` of the source, followed by the columns in ``rest`` (DDL)."""
    return T.StructType([T.StructField("row", source.schema["row"].dataType), *T.StructType.fromDDL(rest).fields])
