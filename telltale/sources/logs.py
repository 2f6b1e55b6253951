"""Reading process streams, event logs and labeled datasets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telltale.functions.scalars import coerce_metrics
from telltale.schemas import ENGINEERED, METRICS, PROCESS_STREAM
from telltale.session import broadcast_if_small, use_utc

BATCH_BYTES = 256 << 20  # what a micro-batch reads at most, a single file aside


def parse_timestamp(text: Column) -> Column:
    """UTC timestamp; unreadable text becomes null."""
    return F.try_to_timestamp(text)


def drop_unparsed(df: DataFrame, column: str = "timestamp") -> DataFrame:
    return df.dropna(subset=[column])


def scan_process_stream(spark: SparkSession, path, by_folder: bool = False, **options) -> DataFrame:
    """Snapshots of one or many sessions from CSV, schema fixed, rows without a readable time dropped.

    ``seq`` is added when the files carry none: file by name, then place in the file. It only breaks
    ties between samples of the same process and time. With ``by_folder`` the session is the folder of the
    file, so one scan reads any number of them (``landing/*/snapshots.csv``).
    """
    use_utc(spark)
    schema = T.StructType(PROCESS_STREAM.fields)
    if options.pop("with_seq", False):
        schema = T.StructType([T.StructField("seq", T.LongType())] + PROCESS_STREAM.fields)
    df = spark.read.schema(schema).options(header=True, mode="PERMISSIVE", **options).csv(path)
    if by_folder:
        df = df.select("*", "_metadata", folder_name().alias("_folder")).withColumn("session_id", F.col("_folder")).drop("_folder")
    if "seq" not in schema.names:
        df = in_file_order(df)
    return drop_unparsed(df.drop("_metadata"))


def in_file_order(df: DataFrame) -> DataFrame:
    """Add ``seq``, which orders rows by file name and place in the file, however the files are split.

    The reader numbers rows within a task's split; blocks of one file follow each other by their start.
    Ranks of (file, block) come from one row a block, so no row is sorted.
    """
    numbered = df.withColumns({"_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start"),
                               "_row": F.monotonically_increasing_id()})
    blocks = (numbered.groupBy("_file", "_block").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n")))
    # one row a block: its rank needs them in one place
    upto = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.withColumn("_start", F.coalesce(F.sum("_n").over(upto), F.lit(0))).drop("_n")
    return (numbered.join(broadcast_if_small(starts), ["_file", "_block"])
            .withColumn("seq", F.col("_start") + F.col("_row") - F.col("_first")).drop("_file", "_block", "_row", "_first", "_start"))


def parse_event_lines(lines: DataFrame, *keep: str) -> DataFrame:
    """``ts,event_type,detail,…`` lines: the rest stays one text; short or undated lines drop."""
    parts = F.split(F.trim("value"), ",", 3)
    return (lines.select(*keep, parts.alias("_p")).where(F.size("_p") >= 2)
            .select(*keep, parse_timestamp(F.col("_p")[0]).alias("timestamp"), F.col("_p")[1].alias("event_type"),
                    F.coalesce(F.try_element_at("_p", F.lit(3)), F.lit("")).alias("details"))
            .where(F.col("timestamp").isNotNull()))


def scan_event_log(spark: SparkSession, path, session_id: str | None = None, by_folder: bool = False) -> DataFrame:
    """Event log files with ``seq`` in order of file name and line; ``by_folder`` names the session after the file's folder."""
    use_utc(spark)
    lines = spark.read.text(path)
    if by_folder:
        lines = lines.select("*", "_metadata", folder_name().alias("session_id"))
    out = parse_event_lines(in_file_order(lines), "seq", *["session_id"] * by_folder)
    return out if session_id is None else out.withColumn("session_id", F.lit(session_id))


def scan_labeled(spark: SparkSession, path, fmt: str = "parquet", columns=tuple(METRICS + ENGINEERED)) -> DataFrame:
    """A labeled dataset with the named columns numeric; unreadable or absent ones are 0."""
    use_utc(spark)
    reader = spark.read.option("header", True) if fmt == "csv" else spark.read
    return coerce_metrics(reader.format(fmt).load(path), columns)


def folder_name(below: str | None = None) -> Column:
    """Name of the folder that a row's file lies in, or of the one just below ``below`` (a raw URI path)."""
    path = F.col("_metadata.file_path")  # a URI: other than plain characters are escaped
    if below is None:
        name = F.element_at(F.split(path, "/"), -2)
    else:
        name = F.substring_index(F.expr(f"substring(_metadata.file_path, instr(_metadata.file_path, '{below}') + {len(below)})"), "/", 1)
    return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))


def scan_sessions(spark: SparkSession, root: str, names: list[str] | None = None, fmt: str = "parquet", **options) -> DataFrame:
    """Datasets of several sessions under ``root``, absent ones skipped, each row tagged with its folder.

    All folders are one scan, and the tag comes from the file's path; columns that only some sessions have are null in the
    others. Only folders that spell other columns in their names (``name=value``), or CSV files with
    another header, are a scan of their own. Without ``names`` every folder under ``root`` is a session.
    """
    use_utc(spark)
    fs = spark._jvm.org.apache.hadoop.fs
    top = fs.Path(root)
    files = top.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    there = {f.getPath().getName() for f in files.listStatus(top) if f.isDirectory() and f.getPath().getName()[0] not in "._"}
    alike: dict[tuple, list[str]] = {}
    for name in dict.fromkeys(sorted(there) if names is None else names):
        if name in there:
            spelled = name.split("=")[0] if "=" in name else ""
            alike.setdefault((spelled, _header(spark, files, fs.Path(top, name)) if fmt == "csv" else ""), []).append(name)
    if not alike:
        raise FileNotFoundError(f"no session of {names} under {root}")
    below = files.makeQualified(top).toUri().getRawPath().rstrip("/").replace("'", "\\'") + "/"
    settings = {"header": True, "basePath": root, **({"mergeSchema": True} if fmt == "parquet" else {}), **options}
    frames = []
    for some in alike.values():
        df = spark.read.options(**settings).format(fmt).load([f"{root}/{n}" for n in some])
        frames.append(df if "session" in df.columns else df.withColumn("session", folder_name(below)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def _header(spark: SparkSession, files, folder) -> str:
    """First line of the first data file of a folder."""
    listed = files.listFiles(folder, True)
    while listed.hasNext():
        at = listed.next()
        if at.getLen() and at.getPath().getName()[0] not in "._":
            stream = files.open(at.getPath())
            try:
                return spark._jvm.java.io.BufferedReader(spark._jvm.java.io.InputStreamReader(stream, "UTF-8")).readLine()
            finally:
                stream.close()
    return ""


def stream_process_snapshots(spark: SparkSession, path: str, fmt: str = "csv", batch_bytes: int = BATCH_BYTES,
                             schema: T.StructType = PROCESS_STREAM) -> DataFrame:
    """Snapshots that an agent lands as files, as a stream, oldest files first.

    ``batch_bytes`` bounds a micro-batch, and with it what one process can hold in a task.
    """
    use_utc(spark)
    reader = spark.readStream.schema(schema).option("header", True).option("maxBytesPerTrigger", batch_bytes)
    return reader.format(fmt).load(path)
