"""Reading tables: CSV or Parquet, one file or many, and the preparation of the time column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path, schema: T.StructType | str | None = None, strict: bool = False) -> DataFrame:
    """CSV with a header. Types come from ``schema``; without one from every value, which costs a pass.

    Large inputs should have a schema. With ``strict`` a value that does not fit it is an
    error when the rows are read, not a missing value.
    """
    reader = spark.read.option("header", True).option("mode", "FAILFAST" if strict else "PERMISSIVE")
    if schema is not None:
        return reader.schema(schema).csv(path)
    return reader.option("inferSchema", True).option("samplingRatio", 1.0).csv(path)


def _csv_files(spark: SparkSession, pattern: str) -> list[str]:
    """Files below everything that a path or pattern names, in order; hidden ones and marks are left out."""
    root = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found, out = list(system.globStatus(root) or []), []
    if not found:
        raise FileNotFoundError(f"nothing is named {pattern}")
    while found:
        status = found.pop()
        if status.getPath().getName().startswith(("_", ".")):
            continue
        if status.isDirectory():
            found += list(system.listStatus(status.getPath()))
        elif status.getLen():
            out.append(status.getPath().toString())
    return sorted(out)


def _first_line(spark: SparkSession, path: str) -> str:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        lines = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
        return (lines.readLine() or "").removeprefix("\ufeff")
    finally:
        stream.close()


def read_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """CSV or Parquet, decided by the file name."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    return read_csv(spark, path, schema)


def read_many(spark: SparkSession, paths: list[str], as_text: tuple[str, ...] = (),
              schema: T.StructType | str | None = None) -> DataFrame:
    """Several CSV files or patterns as one table, united by the names in their headers.

    The files may differ in their columns and in the order of them, so the first line of each is
    looked at, and files with the same header are one scan. ``as_text`` names label columns
    which stay text even when a file holds digits. A schema gives the types by name; columns
    that a file lacks are missing there.
    """
    by_header: dict[str, list[str]] = {}
    for path in dict.fromkeys(f for p in paths for f in _csv_files(spark, p)):
        by_header.setdefault(_first_line(spark, path), []).append(path)
    if not by_header:
        raise ValueError(f"only empty files below {paths}")
    fields = {}
    if schema is not None:
        parsed = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
        fields = {f.name: f.dataType for f in parsed.fields}

    def part(files):
        if not fields:
            df = read_csv(spark, files)
        else:
            names = spark.read.option("header", True).csv(files[:1]).columns
            df = read_csv(spark, files, T.StructType([T.StructField(n, fields.get(n, T.StringType())) for n in names]))
            df = df.select(*[n for n in names if n in fields])
        return df.withColumns({n: F.col(n).cast("string") for n in as_text if n in df.columns})

    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), map(part, by_header.values()))


def head_sample(df: DataFrame, rows: int, order: tuple[str, ...] = ()) -> DataFrame:
    """The first rows: in file order, or repeatably in the given order."""
    return (df.orderBy(*order) if order else df).limit(rows)


def require_columns(df: DataFrame, *columns: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}; the table has {df.columns}")
    return df


def parse_time(df: DataFrame, time: str, pattern: str | None = None) -> DataFrame:
    """Turn a text, date or zoned time column into a plain timestamp; bad text becomes NULL."""
    require_columns(df, time)
    kind = df.schema[time].dataType
    if isinstance(kind, T.TimestampNTZType):
        return df
    if isinstance(kind, T.StringType):
        parsed = F.try_to_timestamp(F.col(time), F.lit(pattern)) if pattern \
            else F.try_to_timestamp(F.col(time))
        return df.withColumn(time, parsed.cast("timestamp_ntz"))
    return df.withColumn(time, F.col(time).cast("timestamp_ntz"))


def time_first(df: DataFrame, time: str) -> DataFrame:
    return df.select(time, *[c for c in df.columns if c != time])


def nan_to_null(df: DataFrame) -> DataFrame:
    """One marker for missing values: NaN >= 0 is true in Spark, NULL >= 0 is not."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*[
        F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns
    ])


def load_series(spark: SparkSession, path: str, time: str, schema=None) -> DataFrame:
    """Read, check, parse and put time first. The order is left to the sinks and windows that need it."""
    df = parse_time(read_table(spark, path, schema), time)
    return nan_to_null(time_first(df, time))
