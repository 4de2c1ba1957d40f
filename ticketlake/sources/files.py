"""File sources and sinks.

Readers declare their schema (no inference pass over the data); writers go through
``DataFrameWriter`` so every file is written by the executors in parallel, with the
job-commit protocol making a rerun after a lost executor safe.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketlake.functions.scalar import strip
from ticketlake.sources.records import JsonObjects, Lines, QuotedLines, read_records

# ---- fixed values (must equal the reference's for right results) --------------------
# Label replacement applied when loading a ticket CSV (experiments' loader).
LOAD_LABEL_REPLACE = {"Critical": "High"}
# ---------------------------------------------------------------------------------------


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the Hadoop FileSystem of the path (works on any cluster FS)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).exists(p)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV with header and quoted multi-line fields; one large file is read by many tasks.
    Without a schema every column is a string (no inference scan); typed columns come from
    ``try_cast`` downstream.  Rows are those of Spark's reader of whole files: lines that
    end with CR LF are normalised, blank lines skipped, broken fields null."""
    if schema is None:
        names = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).columns
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    text = F.col("text")
    crlf = F.endswith(text, F.lit("\r\n"))
    plain = F.when(crlf, F.replace(text, F.lit("\r\n"), F.lit("\n"))).otherwise(text)
    rows = (read_records(spark, path, QuotedLines()).where("not (block = 0 and place = 1)")  # the header
            .select(F.regexp_replace(plain, r"\n\z", "").alias("text")).where("text <> ''"))
    return rows.select(F.from_csv("text", _ddl(schema), {"escape": '"'}).alias("row")).select("row.*")


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema.fields)


def load_ticket_csv(spark: SparkSession, path: str, text_col: str, label_col: str | None = None) -> DataFrame:
    """Ticket CSV -> (text, label); a missing column is an error; null text is
    kept null (T2 default); Critical -> High on the label."""
    df = read_csv(spark, path)
    for c in [text_col] + ([label_col] if label_col else []):
        if c not in df.columns:
            raise ValueError(f"Column {c!r} not in CSV columns {df.columns}")
    cols = [F.col(f"`{text_col}`").cast("string").alias("text")]
    if label_col:
        lab = F.col(f"`{label_col}`").cast("string")
        for k, v in LOAD_LABEL_REPLACE.items():
            lab = F.when(lab == k, F.lit(v)).otherwise(lab)
        cols.append(lab.alias("label"))
    return df.select(*cols)


def labelled_dataset(df: DataFrame, label_col: str, names: Sequence[str] | None) -> DataFrame:
    """Class index -> class name when the index is in range, else its string."""
    if not names:
        return df.withColumn(label_col, F.col(label_col).cast("string"))
    arr = F.array(*[F.lit(n) for n in names])
    i = F.col(label_col).cast("int")
    return df.withColumn(label_col, F.when((i >= 0) & (i < len(names)), F.element_at(arr, i + 1))
                         .otherwise(F.col(label_col).cast("string")))


def question_lines(spark: SparkSession, path: str, strip_commas: bool = True) -> DataFrame:
    """One question per line, trimmed, blanks dropped.  With ``strip_commas`` a
    trailing comma is removed and lines left empty are dropped too (T24)."""
    t = strip("value")
    if strip_commas:
        t = strip(F.regexp_replace(t, r",+$", ""))
    return (spark.read.text(path).select(t.alias("question"), F.monotonically_increasing_id().alias("line_id"))
            .filter(F.col("question") != ""))


def read_json_records(spark: SparkSession, path: str, schema: T.StructType | None = None,
                      multi_line: bool = True) -> DataFrame:
    """JSON files each holding one object or an array of objects (``multi_line``; one
    large file is read by many tasks), or JSON-lines files (one object per line, as Spark
    writes them).  Elements of an array that aren't objects are no records.  Without a
    schema it is inferred from all records: numbers with a fraction are doubles, fields
    of several types strings."""
    if not multi_line:
        r = spark.read.schema(schema) if schema is not None else spark.read
        return r.json(path)
    records = (read_records(spark, path, JsonObjects())
               .select(F.regexp_replace("text", r"^[\s,\[]+", "").alias("text")).where(F.startswith("text", F.lit("{"))))
    if schema is None:
        found = records.select(F.schema_of_variant_agg(F.try_parse_json("text")).alias("s")).first()["s"]
        given = found if (found or "").startswith("OBJECT<") else "OBJECT<>"  # no record can be parsed
        for kind, ours in ((r"\bOBJECT<", "STRUCT<"), (r"\bDECIMAL\(\d+,\s*\d+\)", "DOUBLE"), (r"(: |<)(VOID|VARIANT)\b", r"\1STRING")):
            given = re.sub(kind, ours, given)
        if given == "STRUCT<>":
            return records.where("false").select()
        return records.select(F.from_json("text", given).alias("row")).select("row.*")
    return records.select(F.from_json("text", schema).alias("row")).select("row.*")


def with_provenance(df: DataFrame, source: str) -> DataFrame:
    """``import_timestamp`` and ``import_source`` on every imported row."""
    return df.withColumns({"import_timestamp": F.current_timestamp(), "import_source": F.lit(source)})


def append_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Append to a Parquet table (optionally partitioned)."""
    w = df.write.mode("append")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with header; nested columns rendered as JSON text first.  Quotes are
    doubled (RFC 4180), every field quoted, so multi-line texts read back intact."""
    cols: list[Column] = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            cols.append(F.to_json(F.col(f"`{f.name}`")).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    (df.select(*cols).write.mode("overwrite").option("header", True)
     .option("escape", '"').option("quoteAll", True).csv(path))


def save_json(df: DataFrame, path: str) -> None:
    """A summary table as JSON lines, as many files as it has partitions."""
    df.write.mode("overwrite").json(path)


def execution_log_rows(df: DataFrame) -> DataFrame:
    """One chat-run row (gpt3_*, bert_* columns) -> two log rows, one per model."""
    base = [c for c in ("user_id", "timestamp", "query") if c in df.columns]
    s = F.inline(F.array(
        F.struct(F.lit("gpt-3").alias("model"), F.col("gpt3_response").alias("response"),
                 F.col("gpt3_score").cast("double").alias("score"),
                 F.col("gpt3_time").cast("double").alias("execution_time")),
        F.struct(F.lit("bert").alias("model"), F.col("bert_response").alias("response"),
                 F.col("bert_score").cast("double").alias("score"),
                 F.col("bert_time").cast("double").alias("execution_time")),
    ))
    return df.select(*base, s)


# ---- fixed values (must equal the reference's for right results) --------------------
# An interaction's line in the service log: time, level, then these fields in order.  The
# question, answer and model version follow on lines of their own.
LOG_PREFIX = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}),(\d{3}) - ([A-Z]+) - "
LOG_FIELDS = ["user_id", "intent", "priority", "sentiment", "thumbs_up", "thumbs_down", "fallback", "response_time"]
# ---------------------------------------------------------------------------------------


# log_error's line: time, level, then user and exception.
LOG_ERROR = r"user_id=([^\n]*?) \| Exception type=([^\n:]*): (.*)"


def _log_times() -> list[Column]:
    return [F.to_timestamp_ntz(F.concat("_time", F.lit("."), "_ms"), F.lit("yyyy-MM-dd HH:mm:ss.SSS")).alias("timestamp"), F.col("level")]


def _log_groups(spark: SparkSession, path: str, pattern: str, names: Sequence[str]) -> DataFrame:
    record = F.regexp_replace("text", r"\n\z", "")
    return (read_records(spark, path, Lines(LOG_PREFIX)).select(record.alias("record")).filter(F.col("record").rlike(pattern))
            .select(*[F.regexp_extract("record", pattern, i + 1).alias(g) for i, g in enumerate(names)]))


def read_service_log(spark: SparkSession, path: str) -> DataFrame:
    """The interactions of the service's text log: time, level, all fields, question,
    answer and model version.

    A record begins at a line with the log's prefix and ends before the next one, wherever
    the file is split; of those only interactions count.  The question ends at the first
    line that begins with ``A: ``, the answer before the last ``model_version`` line, so both
    may have line feeds.  A python None reads as null; so do question, answer and version
    of a record that was cut off."""
    pattern = (r"(?s)" + LOG_PREFIX + r" \| ".join(f"{name}=([^\\n]*?)" for name in LOG_FIELDS[:-1]) + rf" \| {LOG_FIELDS[-1]}=([0-9.]+)s"
               + r"(?:\nQ: (.*?)\nA: (.*)\nmodel_version=([^\n]*)|\n.*)?\z")
    rows = _log_groups(spark, path, pattern, ["_time", "_ms", "level", *LOG_FIELDS, "question", "answer", "model_version"])

    def text(name: str) -> Column:
        return F.when(F.col(name) != "None", F.col(name))

    def flag(name: str) -> Column:
        return F.when(F.col(name) != "None", F.col(name) == "True")

    def said(name: str) -> Column:
        return F.when((F.col("model_version") != "") & (F.col(name) != "None"), F.col(name)).alias(name)

    return rows.select(
        *_log_times(), text("user_id").alias("user_id"), text("intent").alias("intent_tag"), text("priority").alias("priority"),
        text("sentiment").alias("sentiment"), flag("thumbs_up").alias("thumbs_up"), flag("thumbs_down").alias("thumbs_down"),
        flag("fallback").alias("is_fallback"), F.col("response_time").try_cast("double").alias("response_time"),
        said("question"), said("answer"), said("model_version"))


def read_service_errors(spark: SparkSession, path: str) -> DataFrame:
    """The errors of the same log: time, level, user, exception type and message, which
    may have line feeds."""
    rows = _log_groups(spark, path, r"(?s)" + LOG_PREFIX + LOG_ERROR + r"\z", ["_time", "_ms", "level", "user_id", "error_type", "error_msg"])
    return rows.select(*_log_times(), F.when(F.col("user_id") != "None", F.col("user_id")).alias("user_id"), "error_type", "error_msg")


def write_service_log(interactions: DataFrame, path: str, model_version: str) -> None:
    """S16, the other way: each interaction as the service logs it, four lines."""
    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("None"))

    def flag(name: str) -> Column:
        return F.when(F.col(name), "True").when(~F.col(name), "False").otherwise("None")

    fields = F.format_string(
        " | ".join(f"{name}=%s" for name in LOG_FIELDS[:-1]) + f" | {LOG_FIELDS[-1]}=%.3fs",
        shown("user_id"), shown("intent_tag"), shown("priority"), shown("sentiment"), flag("thumbs_up"), flag("thumbs_down"),
        flag("is_fallback"), F.col("response_time").cast("double"))
    interactions.select(F.concat(
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss,SSS"), F.lit(" - INFO - "), fields,
        F.lit("\nQ: "), shown("question"), F.lit("\nA: "), shown("answer"), F.lit(f"\nmodel_version={model_version}")).alias("value")
    ).write.mode("overwrite").text(path)


def line_count(text: Column) -> Column:
    """Lines as ``readlines`` counts them: newlines, plus one for a last unterminated line."""
    nl = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return (nl + F.when((text == "") | F.endswith(text, F.lit("\n")), 0).otherwise(1)).cast("bigint")


def file_inventory(spark: SparkSession, root: str, ignore_dirs: Sequence[str] = ()) -> DataFrame:
    """Path, size in KB and line count of every file under ``root``, skipping
    ignored directories.  ``binaryFile`` lists and reads files on the executors."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    for d in ignore_dirs:  # a predicate on the path alone: skipped files are never opened
        df = df.filter(~F.col("path").contains(f"/{d}/"))
    text = F.decode(F.col("content"), "UTF-8")
    return df.select(
        "path",
        (F.col("length") / 1024.0).alias("size_kb"),
        line_count(text).alias("n_lines"),
    )
