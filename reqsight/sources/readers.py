"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from reqsight.functions.text import py_strip, split_first
from reqsight.schema import REQUEST_LOG_COLUMNS, SAMPLES

LINE_SEP = ": "


def parse_lines(df: DataFrame, src: str, line_no: str, line: str, skip: int = 2) -> DataFrame:
    """Core of S1 on a table of lines: drop each source's first ``skip`` lines,
    strip white space as Python does, drop blanks, split on the first ``": "``.

    ``line_no`` is the 0-based position of the line in its source.
    Columns: ``src, line_no, row_key, title, payload``; ``row_key`` is the md5 of
    (src, title, payload), a stable identity for hash draws (equal lines get equal keys).
    """
    s = py_strip(F.col(line))
    parsed = (df.filter(F.col(line_no) >= skip)
              .select(F.col(src).alias("src"), F.col(line_no).cast("bigint").alias("line_no"),
                      s.alias("_s"))
              .filter(F.col("_s") != F.lit(""))
              .select("src", "line_no",
                      F.coalesce(split_first(F.col("_s"), LINE_SEP)[0], F.lit("")).alias("title"),
                      split_first(F.col("_s"), LINE_SEP)[1].alias("payload")))
    key = F.md5(F.concat_ws("\x1f", F.col("src").cast("string"), "title", "payload"))
    return parsed.select("src", "line_no", key.alias("row_key"), "title", "payload")


def text_lines(df: DataFrame, src: str, text: str) -> DataFrame:
    """Explode a text column into (src, line_no, line)."""
    return df.select(F.col(src).alias("src"), F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))


def read_labelled_lines(spark: SparkSession, paths, skip: int = 2) -> DataFrame:
    """Labelled line files -> ``src, row_key, title, payload``; ``src`` is the file's name without its
    folder, so moving the files changes no key.

    Lines are numbered without a global sort: within a scan partition the rows of one file block are
    consecutive, so ``monotonically_increasing_id`` minus the smallest id of the file's first block (one
    partial aggregate row per file) is the line number inside the first block, which holds the header
    lines. Later blocks are never joined; whether the small table is broadcast is left to Spark.
    """
    raw = (spark.read.text(paths)
           .select("value", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_name").alias("src"),
                   F.col("_metadata.file_block_start").alias("_blk"),
                   F.monotonically_increasing_id().alias("_mid")))
    first = raw.filter(F.col("_blk") == 0)
    starts = first.groupBy("_path").agg(F.min("_mid").alias("_m0"))
    head = first.join(starts, "_path").withColumn("_line", F.col("_mid") - F.col("_m0")).drop("_m0")
    rest = raw.filter(F.col("_blk") > 0).withColumn("_line", F.lit(skip).cast("bigint"))
    out = parse_lines(head.unionByName(rest), "src", "_line", "value", skip)
    return out.drop("line_no")


def read_request_log(spark: SparkSession, path: str, columns=REQUEST_LOG_COLUMNS,
                     sep: str = ";") -> DataFrame:
    """All-string CSV with any header, read by name; ``columns`` come first, further columns follow.

    The names are taken from the header (all files of one call share it); a listed column that the header
    lacks is NULL, rows with too many fields are skipped, short rows get NULLs.
    """
    header = spark.read.option("header", True).option("sep", sep).csv(path).columns  # reads one line
    extra = "_extra"
    while extra in header:
        extra += "_"
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*header, extra]])
    df = (spark.read.option("header", True).option("sep", sep).option("mode", "PERMISSIVE")
          .option("enforceSchema", True).schema(schema).csv(path))
    df = df.filter(F.col(f"`{extra}`").isNull())
    named = [F.col(f"`{c}`") if c in header else F.lit(None).cast("string").alias(c) for c in columns]
    return df.select(*named, *[F.col(f"`{c}`") for c in header if c not in columns])


def read_samples(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """S3: a samples dataset ``text, label_str, label`` (parquet, or CSV with a header)."""
    if fmt == "csv":
        return spark.read.option("header", True).option("escape", '"').option("multiLine", True) \
            .schema(SAMPLES).csv(path)
    return spark.read.parquet(path)


def drop_null_samples(df: DataFrame) -> DataFrame:
    """S3: drop rows with any NULL (``dropna``), as the character-model training path does."""
    return df.na.drop("any")


def write_samples(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                  partition_by: str | None = "label_str") -> None:
    """Write a dataset; parquet partitioned by class by default, or CSV with a header."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(partition_by)
    if fmt == "csv":
        w.option("header", True).option("escape", '"').csv(path)
    else:
        w.parquet(path)


def request_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet",
                   max_files_per_trigger: int | None = None, **options) -> DataFrame:
    """Requests as a streaming table (files by default; Kafka etc. through ``fmt``/options)."""
    r = spark.readStream.format(fmt)
    if fmt != "kafka":
        r = r.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    for k, v in options.items():
        r = r.option(k, v)
    return r.load(path)
