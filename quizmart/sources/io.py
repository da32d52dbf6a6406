"""

* COPY text (A1/A2) — tab separated, ``\\N`` = NULL, ``t``/``f`` booleans, backslash escapes,
  ``\\.`` end marker. Parsed with ``spark.read.text`` + column expressions: the CSV reader cannot
  express it (it turns empty strings into NULL and leaves ``\\t`` undecoded).
* JSON documents (A3, A5, A6), physical layout (A7), event feeds as table or stream (A8).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quizmart.operators.nested import CATALOGUE_PAGE
from quizmart.operators.scan import input_partitions
from quizmart.functions.scalars import size_pretty

# Fixed values of the COPY text format.
COPY_NULL = "\\N"
COPY_END = "\\."
COPY_ESCAPES = [("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r"), ("\b", "\\b"), ("\f", "\\f"), ("\v", "\\v")]
COPY_HEADER = r"^COPY [^\t]+ \([^\t]*\) FROM stdin;$"  # first line of a block in a dump


def _unescape(c: Column) -> Column:
    """Decodes escapes in one pass: the pieces between escaped backslashes hold no other backslash
    pairs, so each is decoded by itself."""
    def piece(x: Column) -> Column:
        for raw, esc in COPY_ESCAPES:
            x = F.replace(x, F.lit(esc), F.lit(raw))
        return x

    return F.array_join(F.transform(F.split(c, r"\\\\", -1), piece), "\\")


def _escape(c: Column) -> Column:
    out = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for raw, esc in COPY_ESCAPES:
        out = F.replace(out, F.lit(raw), F.lit(esc))
    return out


def _from_text(c: Column, dt: T.DataType) -> Column:
    if isinstance(dt, T.StringType):
        return _unescape(c)
    if isinstance(dt, T.BooleanType):
        return F.when(c == "t", True).when(c == "f", False)
    if isinstance(dt, T.TimestampNTZType):
        return F.try_to_timestamp(c).cast("timestamp_ntz")
    return c.try_cast(dt)


def read_copy_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A1: every data line of a COPY text file or of a dump's COPY block (its header line, end mark
    and empty lines around them are no data) as ``schema`` columns, ``__line`` and ``__reason``:
    ``field_count`` or ``bad_value(column)`` for lines that do not fit, else NULL."""
    value = F.col("value")
    lines = spark.read.text(path).filter((value != COPY_END) & ~value.rlike(COPY_HEADER))
    if len(schema.fields) > 1:
        lines = lines.filter(value != "")
    parts = F.split(value, "\t", -1)
    reason = F.when(F.size(parts) != len(schema.fields), F.lit("field_count"))
    cols = []
    for i, f in enumerate(schema.fields):
        raw = F.get(parts, F.lit(i))
        parsed = _from_text(raw, f.dataType)
        given = raw.isNotNull() & (raw != COPY_NULL)
        cols.append(F.when(given, parsed).alias(f.name))
        reason = reason.when(given & parsed.isNull(), F.lit(f"bad_value({f.name})"))
    return lines.select(*cols, value.alias("__line"), reason.alias("__reason"))


def read_copy_text(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A1: the lines that fit ``schema`` (explicit types, no inference). The others are in
    :func:`read_copy_quarantine`."""
    return read_copy_lines(spark, path, schema).filter(F.col("__reason").isNull()).drop("__line", "__reason")


def read_copy_quarantine(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A1: (line, reason) of the lines that do not fit ``schema``."""
    bad = read_copy_lines(spark, path, schema).filter(F.col("__reason").isNotNull())
    return bad.select(F.col("__line").alias("line"), F.col("__reason").alias("reason"))


def _to_text(c: Column, dt: T.DataType) -> Column:
    if isinstance(dt, T.StringType):
        return _escape(c)
    if isinstance(dt, T.BooleanType):
        return F.when(c, "t").when(~c, "f")  # NULL stays NULL (→ \N)
    if isinstance(dt, (T.TimestampNTZType, T.TimestampType)):
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss[.SSSSSS]")
    return c.cast("string")


def copy_text_lines(df: DataFrame) -> DataFrame:
    """A2 (lines): each row as one COPY text line."""
    fields = [F.coalesce(_to_text(F.col(f.name), f.dataType), F.lit(COPY_NULL)) for f in df.schema.fields]
    return df.select(F.concat_ws("\t", *fields).alias("value"))


def write_copy_text(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A2: write ``df`` as COPY text files (one line per row; the reader ignores ``\\.``)."""
    copy_text_lines(df).write.mode(mode).text(path)


def read_catalogue_json(spark: SparkSession, path: str, schema: T.StructType = CATALOGUE_PAGE,
                        multiline: bool = False) -> DataFrame:
    """A3: catalogue documents (shape B pages, or any given schema) — declared schema, no
    inference; ``multiline=True`` for one pretty-printed document per file."""
    return spark.read.schema(schema).option("multiLine", multiline).option("mode", "PERMISSIVE").json(path)


def write_json_snapshot(df: DataFrame, path: str, compression: str = "none") -> None:
    """Persist the full state as JSON lines (overwrite, like the page's localStorage save).
    ``compression``: a codec of Spark's text files; a file of gzip is read whole by one task."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path, compression=compression)


def with_fallback(primary: DataFrame, fallback: DataFrame, keys: list[str]) -> DataFrame:
    """A4: primary rows, plus fallback rows whose key is absent from primary."""
    return primary.unionByName(fallback.join(primary.select(*keys), keys, "left_anti"))


def parse_json_column(df: DataFrame, col: str, schema: T.DataType | str, out: str = "parsed") -> DataFrame:
    """A5: JSON text → struct; malformed text gives NULL fields (PERMISSIVE), never an error."""
    return df.withColumn(out, F.from_json(F.col(col), schema, {"mode": "PERMISSIVE"}))


def write_layout(df: DataFrame, path: str, partition_by: list[str], sort_by: list[str],
                 mode: str = "overwrite", bytes_per_task: int = 256 << 20) -> None:
    """Physical layout from the reference's composite access paths — partition directories by
    ``partition_by`` (pruned on read) and rows sorted by ``sort_by`` inside each file (Parquet
    min/max statistics then skip row groups for range predicates).

    Tasks are ranges of (partition columns, sort columns), so a value that holds most rows is
    written by many tasks; an overwrite replaces the whole table, also directories that have no
    rows any more."""
    order = [F.col(c) for c in [*partition_by, *sort_by]]
    n = max(input_partitions(df, bytes_per_task), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    (df.repartitionByRange(n, *order).sortWithinPartitions(*order)
     .write.mode(mode).option("partitionOverwriteMode", "static").partitionBy(*partition_by).parquet(path))


def write_bucketed(df: DataFrame, table: str, path: str, keys: list[str], buckets: int, sort_by: list[str] | None = None,
                   files_per_bucket: int = 4) -> DataFrame:
    """The composite access paths as a bucketed table at ``path``: joins and aggregates on ``keys``
    (or on more columns) read it bucket by bucket, without a shuffle. Every bucket is written by
    ``files_per_bucket`` tasks, so that a hot key's bucket is not written by one. Size ``buckets`` so
    that one fits a task; a hot key makes its bucket larger, then add a key column."""
    rest = [F.col(c) for c, kind in df.dtypes if c not in keys and not kind.startswith("map")]
    place = F.pmod(F.hash(*keys), F.lit(buckets))
    part = F.pmod(F.xxhash64(*rest), F.lit(files_per_bucket)) if rest else F.lit(0)
    w = df.repartition(buckets, place, part).write.mode("overwrite").format("parquet").bucketBy(buckets, *keys).sortBy(*(sort_by or keys))
    w.option("path", path).saveAsTable(table)
    return df.sparkSession.table(table)


EVENT_SCHEMA = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
                             T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
                             T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def read_events(spark: SparkSession, path: str, streaming: bool = False,
                schema: T.StructType = EVENT_SCHEMA, max_files_per_trigger: int | None = None) -> DataFrame:
    """The event feed as a table or as a stream (declared schema). For streams ``ts`` is cast
    to TIMESTAMP, which watermarks require."""
    if not streaming:
        return spark.read.schema(schema).parquet(path)
    r = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def table_profile(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Rows per table (exact), data bytes on disk, a readable size and the rank by size
    (biggest first, then by name).

    Row counts read no column data, file sizes come from ``binaryFile`` metadata; each is one union
    and one aggregate over all tables.
    """
    rows, files = None, None
    for name, path in paths.items():
        t = F.lit(name).alias("table_name")
        r, f = spark.read.parquet(path).select(t), spark.read.format("binaryFile").load(path).select(t, "length")
        rows, files = (r, f) if rows is None else (rows.unionAll(r), files.unionAll(f))
    counts = rows.groupBy("table_name").agg(F.count(F.lit(1)).alias("row_count"))
    sizes = files.groupBy("table_name").agg(F.sum("length").alias("data_bytes"))
    out = sizes.join(counts, "table_name", "left").withColumn("row_count", F.coalesce("row_count", F.lit(0).cast("bigint")))
    # as many rows as tables: one small window
    w = Window.orderBy(F.desc("data_bytes"), "table_name")
    return (out.withColumn("table_size", size_pretty(F.col("data_bytes"))).withColumn("size_rank", F.row_number().over(w))
            .select("table_name", "row_count", "data_bytes", "table_size", "size_rank").orderBy("size_rank"))
