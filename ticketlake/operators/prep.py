"""Ticket preparation: schema detection, raw -> canonical projection, label
normalisation, hygiene, required fields, ragged log unions (P1-P7, P13-P17, F1-F3,
W3, U1, U3, S2, S3).

Column *names* are metadata: mapping them (P1) is a driver-side look at
``df.columns``; every *value* operation is a Spark expression.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketlake.functions.scalar import (
    coerce_double, coerce_timestamp, normalise_priority, normalise_sentiment, rating_to_sentiment, strip,
)

# ---- fixed values (must equal the reference's for right results) --------------------
# Canonical ticket fields and their synonyms, in the reference's order.
CANON = {
    "description": ["ticket description", "description", "issue description", "problem description",
                    "message", "body", "details"],
    "priority": ["ticket priority", "priority", "urgency", "severity"],
    "satisfaction": ["customer satisfaction rating", "csat", "satisfaction", "rating", "customer rating"],
    "channel": ["ticket channel", "channel", "contact channel", "source", "communication channel"],
    "status": ["ticket status", "status", "state"],
    "id": ["ticket id", "id", "case id", "request id"],
}
REQUIRED_CANON = ["description", "priority", "sentiment"]
# Columns each import type must carry.
IMPORT_FORMATS = {
    "faq": ["question", "answer"],
    "default_messages": ["type", "message"],
    "knowledge": ["title", "content"],
}
# Label values the evaluation filter drops (after strip; "unknown" in any case).
DROPPED_LABELS = ["", "unknown"]
# ---------------------------------------------------------------------------------------

# Ways in which a column can be named after a field, best first.
NAMED_EXACTLY, NAMED_PARTLY = 0, 1


def name_matches(columns: Sequence[str]) -> list[tuple[str, int, int]]:
    """Every (field, rank of the match, column position) that holds: the column's name
    (lower case, single blanks) is one of the field's synonyms, or contains one or is
    contained in one.  An empty name is contained in every synonym (T23)."""
    names = [" ".join(c.lower().split()) for c in columns]
    found = []
    for field, synonyms in CANON.items():
        known = frozenset(synonyms)
        for position, name in enumerate(names):
            if name in known:
                found.append((field, NAMED_EXACTLY, position))
            elif any(name in word or word in name for word in known):
                found.append((field, NAMED_PARTLY, position))
    return found


def detect_schema(columns: Sequence[str]) -> dict[str, str | None]:
    """Canonical field -> the column that names it best (leftmost of equals), or
    None."""
    best: dict[str, str | None] = dict.fromkeys(CANON)
    for field, _, position in sorted(name_matches(columns), reverse=True):
        best[field] = columns[position]  # worst first: the last assignment is the best match
    return best


def detect_format(df: DataFrame, data_type: str) -> bool:
    """Does the frame carry the columns of the import type?"""
    return set(IMPORT_FORMATS[data_type]) <= set(df.columns)


def import_records(df: DataFrame, data_type: str, source: str) -> DataFrame:
    """Rows of one import type (FAQ, default messages, knowledge): exactly its
    columns as text, with provenance (S8).  A frame of another shape is refused."""
    from ticketlake.sources.files import with_provenance

    if not detect_format(df, data_type):
        raise ValueError(f"{data_type} needs columns {IMPORT_FORMATS[data_type]}, found {df.columns}")
    return with_provenance(df.select(*[F.col(c).cast("string").alias(c) for c in IMPORT_FORMATS[data_type]]), source)


def from_raw(df: DataFrame, *, compat_nan_text: bool = False) -> DataFrame:
    """Raw ticket table -> (ticket_id if there is one, description, priority,
    sentiment), stripped, rows with a null in a required field dropped.

    A field that no column names is an error.  ``compat_nan_text`` reads a null text as
    the string 'nan' (T2)."""
    column = detect_schema(df.columns)
    absent = sorted(f for f in ("description", "priority", "satisfaction") if column[f] is None)
    if absent:
        raise ValueError(f"no column for {', '.join(absent)} among {', '.join(df.columns)}")

    def own(field: str) -> Column:
        return F.col("`" + column[field].replace("`", "``") + "`")

    def words(field: str) -> Column:
        text = own(field).cast("string")
        return strip(F.coalesce(text, F.lit("nan")) if compat_nan_text else text)

    projected = {"description": words("description"), "priority": words("priority"),
                 "sentiment": rating_to_sentiment(own("satisfaction"))}
    if column["id"] is not None:
        projected = {"ticket_id": own("id"), **projected}
    return required_fields(df.select(*[c.alias(name) for name, c in projected.items()]), REQUIRED_CANON)


def load_preprocessed_or_raw(spark: SparkSession, pre_path: str | None, raw_path: str | None,
                             schema: T.StructType | None = None) -> tuple[DataFrame, str]:
    """The prepared table if it exists, else the raw one put into its form; with a
    tag naming which (``preprocessed:<path>`` or ``raw:<path>``).  The files are looked
    for through their Hadoop file system, so any cluster store works."""
    from ticketlake.sources.files import path_exists, read_csv

    def prepared(path: str) -> DataFrame:
        df = read_csv(spark, path, schema=schema)
        lacking = set(REQUIRED_CANON) - set(df.columns)
        if lacking:
            raise ValueError(f"prepared table {path} lacks {', '.join(sorted(lacking))}")
        return required_fields(df, REQUIRED_CANON)

    readers = {"preprocessed": (pre_path, prepared), "raw": (raw_path, lambda path: from_raw(read_csv(spark, path)))}
    for tag, (path, read) in readers.items():
        if path and path_exists(spark, path):
            return read(path), f"{tag}:{path}"
    raise FileNotFoundError(f"neither {pre_path} nor {raw_path} exists")


def training_frame(df: DataFrame, label_col: str) -> DataFrame:
    """S3: rename description -> text when there is no text column, then drop rows
    missing text or label."""
    if "text" not in df.columns and "description" in df.columns:
        df = df.withColumnRenamed("description", "text")
    return required_fields(df, ["text", label_col])


def normalise_labels(df: DataFrame, priority_col: str = "priority", sentiment_col: str | None = "sentiment") -> DataFrame:
    """Critical -> High on priority; sentiment trimmed and lower-cased."""
    cols = {priority_col: normalise_priority(priority_col)}
    if sentiment_col and sentiment_col in df.columns:
        cols[sentiment_col] = normalise_sentiment(sentiment_col)
    return df.withColumns(cols)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Keep the first row of each key group in a given order (``dropDuplicates``
    keeps an arbitrary one).  ``row_number() = 1`` is planned with a WindowGroupLimit
    before and after the shuffle, so each task ships one row per key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def basic_hygiene(df: DataFrame, text_col: str = "description", min_len: int = 10,
                  dedup: bool = True, order: Sequence[Column | str] = ()) -> DataFrame:
    """P5 + W3: drop texts shorter than ``min_len`` characters, then keep the first row
    of every duplicate text.  A table has no order of its own, so "first" needs ``order``."""
    out = df.filter(F.length(F.col(text_col)) >= min_len)
    if dedup:
        if not order:
            raise ValueError("keeping the first of equal texts needs an order")
        out = keep_first(out, [text_col], list(order))
    return out


def required_fields(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop rows with a null in any required column."""
    return df.dropna(subset=list(cols))


def label_filter(df: DataFrame, label_col: str) -> DataFrame:
    """Drop blank labels and any case of 'unknown' (after strip)."""
    lab = F.lower(strip(F.col(label_col).cast("string")))
    return df.filter(F.col(label_col).isNotNull() & ~lab.isin(*DROPPED_LABELS))


def fill_text(df: DataFrame, text_col: str, value: str = "") -> DataFrame:
    """Null text -> ``value`` (the reference's order gives 'nan', see T2)."""
    return df.withColumn(text_col, F.coalesce(F.col(text_col).cast("string"), F.lit(value)))


def required_pair(df: DataFrame, a: str, b: str) -> tuple[DataFrame, DataFrame]:
    """Rows with both fields non-empty go in; the others go to a reject table
    with the reason."""
    ok = (F.coalesce(F.length(strip(F.col(a))), F.lit(0)) > 0) & \
         (F.coalesce(F.length(strip(F.col(b))), F.lit(0)) > 0)
    good = df.filter(ok)
    bad = df.filter(~ok).withColumn("reject_reason", F.lit(f"{a} and {b} are required"))
    return good, bad


def is_numeric_or_bool(df: DataFrame, col: str) -> bool:
    """Schema check before aggregating a rating / correctness column."""
    t = df.schema[col].dataType
    return isinstance(t, (T.NumericType, T.BooleanType))


def numeric_means(df: DataFrame, group: str) -> DataFrame:
    """The mean of every numeric or boolean column per group; the other columns cannot
    be averaged and are left out."""
    means = [F.avg(F.col(c).cast("double")).alias(f"mean_{c}") for c in df.columns
             if c != group and is_numeric_or_bool(df, c)]
    return df.groupBy(group).agg(*means)


def union_ragged(parts: Sequence[DataFrame], numeric_cols: Sequence[str] = (),
                 time_cols: Sequence[str] = (), id_cols: Sequence[str] = ()) -> DataFrame:
    """U1 + P13-P15: union by name, columns missing on one side become null; ids as
    strings, listed numerics coerced (bad -> null), listed times coerced."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    cols = {}
    for c in id_cols:
        if c in out.columns:
            cols[c] = F.col(c).cast("string")
    for c in numeric_cols:
        if c in out.columns:
            cols[c] = coerce_double(c)
    for c in time_cols:
        if c in out.columns:
            cols[c] = coerce_timestamp(c)
    return out.withColumns(cols) if cols else out


def select_logs(logs: dict[str, DataFrame], log_type: str | None = None, **casts) -> DataFrame:
    """U1 with a choice: the union of all logs, or the one named ``log_type``; every row
    says which log it is from.  An unknown name is an error."""
    if log_type is not None and log_type not in logs:
        raise ValueError(f"unknown log {log_type!r}, there are {sorted(logs)}")
    names = sorted(logs) if log_type is None else [log_type]
    return union_ragged([logs[n].withColumn("log_type", F.lit(n)) for n in names], **casts)
