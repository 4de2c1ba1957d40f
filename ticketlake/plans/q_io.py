"""Driver queries: file sources and sinks as round trips.

Each query writes data derived from the given tables through a sink of the library
into a fresh folder under the shared checkpoint folder, reads it back through the
matching source, and returns what came back, so the oracle checks both directions."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ticketlake.operators import prep
from ticketlake.plans.registry import query
from ticketlake.session import checkpoint_dir
from ticketlake.sources import files
from ticketlake.sources.tables import interactions, table


def _folder(spark, name: str) -> str:
    return os.path.join(checkpoint_dir(spark), "io", f"{name}-{uuid.uuid4().hex[:12]}")


@query("ticket_csv_roundtrip", sql="""
SELECT text, CASE WHEN lang = 'fr' THEN 'High' ELSE lang END AS label FROM documents""")
def ticket_csv_roundtrip(spark, sf_dir):
    """S10 -> S1 -> S3: documents exported as a headed CSV (multi-line quoted texts,
    'fr' written as the label 'Critical'), loaded as a ticket CSV (Critical -> High),
    then shaped as a training frame."""
    path = _folder(spark, "tickets_csv")
    d = table(spark, sf_dir, "documents").select(
        F.col("text").alias("Ticket Description"),
        F.when(F.col("lang") == "fr", F.lit("Critical")).otherwise(F.col("lang")).alias("Ticket Priority"))
    files.export_csv(d, path)
    t = files.load_ticket_csv(spark, path, "Ticket Description", "Ticket Priority")
    return prep.training_frame(t.withColumnRenamed("text", "description"), "label").select("text", "label")


@query("faq_json_import", sql="""
SELECT item_id, text AS question, 'benchmark-import' AS import_source FROM benchmark
WHERE length(trim(text)) > 0""")
def faq_json_import(spark, sf_dir):
    """S6 -> P16 -> S7/S8: benchmark passages written as JSON lines, read back as an FAQ
    import (question / answer pairs must both be non-empty), stamped with provenance
    and appended to an FAQ table, which is read back."""
    src, faq_dir = _folder(spark, "faq_json"), _folder(spark, "faq_table")
    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("question"),
                                                 F.concat(F.lit("answer "), F.col("item_id").cast("string")).alias("answer"))
    b.write.mode("overwrite").json(src)
    imp = files.read_json_records(spark, src, b.schema, multi_line=False)
    if not prep.detect_format(imp, "faq"):
        raise ValueError(f"not an FAQ import: {imp.columns}")
    good, _rejects = prep.required_pair(imp, "question", "answer")
    files.append_table(files.with_provenance(good, "benchmark-import"), faq_dir)
    return spark.read.parquet(faq_dir).select("item_id", "question", "import_source")


@query("service_log_roundtrip", sql="""
SELECT date_trunc('millisecond', ts) AS timestamp, 'INFO' AS level, CAST(user_id AS VARCHAR) AS user_id,
       event_type AS intent_tag, 'low' AS priority, 'neutral' AS sentiment, event_type = 'purchase' AS thumbs_up,
       event_type = 'error' AS thumbs_down, event_type = 'signup' AS is_fallback, round(value, 3) AS response_time
FROM events""")
def service_log_roundtrip(spark, sf_dir):
    """The interaction log written as the service logs it (prefix, all fields, then
    question, answer and version lines) and parsed back.  The questions look like log
    fields, which must not mislead the reader."""
    path = _folder(spark, "service_log")
    i = interactions(spark, sf_dir).withColumns({
        "priority": F.lit("low"), "sentiment": F.lit("neutral"),
        "question": F.lit("why | intent=wrong | response_time=1.000s"), "answer": F.lit("user_id=0 | intent=wrong")})
    files.write_service_log(i, path, "v1")
    return files.read_service_log(spark, path).drop("question", "answer", "model_version")


@query("service_log_records", sql="""
SELECT CAST(doc_id AS VARCHAR) AS user_id, text AS question, concat_ws(chr(10), source, lang, text) AS answer,
       'gpt-3.5-turbo' AS model_version, round(n_chars / 1000.0, 3) AS response_time FROM documents""")
def service_log_records(spark, sf_dir):
    """Whole records of the service log.  Every document is logged as a question, and
    with two more lines as its answer, so the records run over many lines; they are read
    back with question, answer and model version, wherever the files are split."""
    path = _folder(spark, "service_records")
    d = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("user_id"), F.lit("greet").alias("intent_tag"), F.lit("low").alias("priority"), F.lit("neutral").alias("sentiment"),
        F.lit(True).alias("thumbs_up"), F.lit(False).alias("thumbs_down"), F.lit(False).alias("is_fallback"),
        (F.col("n_chars") / 1000).alias("response_time"), F.to_timestamp_ntz(F.lit("2024-05-01 10:11:12.345")).alias("timestamp"),
        F.col("text").alias("question"), F.concat_ws("\n", "source", "lang", "text").alias("answer"))
    files.write_service_log(d, path, "gpt-3.5-turbo")
    return files.read_service_log(spark, path).select("user_id", "question", "answer", "model_version", "response_time")


def _json_array(batches):
    """The objects of a task as one array: a first object without an id, then one a line."""
    import pyarrow as pa
    import pyarrow.compute as pc

    begun = False
    for batch in batches:
        if not begun:
            yield pa.RecordBatch.from_arrays([pa.array(['[{"doc_id": null}'])], names=["value"])
            begun = True
        yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(",\n", batch.column(0), "")], names=["value"])
    if begun:
        yield pa.RecordBatch.from_arrays([pa.array(["]"])], names=["value"])


@query("json_array_import", sql="""
SELECT doc_id, text, lang, source, n_chars FROM documents""")
def json_array_import(spark, sf_dir):
    """Documents as arrays of objects, the form of an exported file, read back by many
    tasks.  Every writer's file is one array over many lines; the reader splits it at any
    byte."""
    path = _folder(spark, "json_array")
    d = table(spark, sf_dir, "documents")
    d.select(F.to_json(F.struct("*")).alias("value")).mapInArrow(_json_array, "value string").write.text(path)
    return files.read_json_records(spark, path, d.schema).where("doc_id is not null")


@query("default_message_import", sql="""
SELECT role AS type, text AS message, 'turns' AS import_source FROM conversations""")
def default_message_import(spark, sf_dir):
    """S6 -> S7: turns written as JSON and imported as default messages."""
    src = _folder(spark, "messages_json")
    table(spark, sf_dir, "conversations").select("conv_id", F.col("role").alias("type"), F.col("text").alias("message")).write.json(src)
    imported = prep.import_records(files.read_json_records(spark, src, multi_line=False), "default_messages", "turns")
    return imported.drop("import_timestamp")


@query("knowledge_import", sql="""
SELECT url AS title, html AS content, 'pages' AS import_source FROM pages""")
def knowledge_import(spark, sf_dir):
    """S6 -> S7: pages written as JSON and imported as knowledge articles."""
    src = _folder(spark, "knowledge_json")
    table(spark, sf_dir, "pages").select(F.col("url").alias("title"), F.col("html").alias("content")).write.json(src)
    imported = prep.import_records(files.read_json_records(spark, src, multi_line=False), "knowledge", "pages")
    return imported.drop("import_timestamp")


@query("summary_json", sql="""
SELECT event_type, count(*)::BIGINT AS n, avg(value) AS mean_value FROM events GROUP BY 1""")
def summary_json(spark, sf_dir):
    """A summary per event type saved as JSON lines and read back."""
    path = _folder(spark, "summary_json")
    e = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))
    files.save_json(e, path)
    return files.read_json_records(spark, path, e.schema, multi_line=False)


@query("event_tables", sql="""
SELECT event_type AS kind, CAST(ts AS DATE) AS day, count(*)::BIGINT AS n, sum(value) AS total FROM events
GROUP BY 1, 2""")
def event_tables(spark, sf_dir):
    """Events appended to one table, a partition per kind and day, read back."""
    path = _folder(spark, "event_tables")
    e = table(spark, sf_dir, "events").select("*", F.col("event_type").alias("kind"), F.to_date("ts").alias("day"))
    files.append_table(e, path, partition_by=["kind", "day"])
    return spark.read.parquet(path).groupBy("kind", "day").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("execution_log", sql="""
SELECT item_id AS user_id, 'gpt-3' AS model, text AS response, length(text)::DOUBLE AS score,
       item_id / 10.0 AS execution_time, 'simulation' AS execution_type FROM benchmark
UNION ALL
SELECT item_id, 'bert', lower(text), length(trim(text))::DOUBLE, item_id / 20.0, 'simulation' FROM benchmark""")
def execution_log(spark, sf_dir):
    """S13 + S14: one chat-run row per benchmark question (both models' answers, scores
    and times) becomes two log rows, appended to a log table partitioned by execution
    type and read back."""
    path = _folder(spark, "exec_log")
    b = table(spark, sf_dir, "benchmark")
    run = b.select(F.col("item_id").alias("user_id"),
                   F.col("text").alias("gpt3_response"), F.length("text").alias("gpt3_score"),
                   (F.col("item_id") / 10.0).alias("gpt3_time"),
                   F.lower("text").alias("bert_response"), F.length(F.trim("text")).alias("bert_score"),
                   (F.col("item_id") / 20.0).alias("bert_time"))
    logs = files.execution_log_rows(run).withColumn("execution_type", F.lit("simulation"))
    files.append_table(logs, path, partition_by=["execution_type"])
    return spark.read.parquet(path)


@query("question_file", sql="""
SELECT q AS question FROM (
  SELECT trim(regexp_replace(trim(replace(text, chr(10), ' ')), ',+$', '')) AS q FROM conversations
  WHERE role = 'user') WHERE q <> ''""")
def question_file(spark, sf_dir):
    """User turns written one per line (a turn's inner newlines become spaces),
    read back as a question list: trimmed, trailing commas dropped, blanks skipped."""
    path = _folder(spark, "questions")
    c = table(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    c.select(F.regexp_replace("text", "\n", " ").alias("value")).write.mode("overwrite").text(path)
    return files.question_lines(spark, path).select("question")


@query("raw_or_prepared", sql="""
SELECT CAST(d.doc_id AS VARCHAR) AS ticket_id, trim(d.text) AS description,
       trim(CASE o.o_orderpriority WHEN '1-URGENT' THEN 'Critical' WHEN '2-HIGH' THEN 'High'
            WHEN '3-MEDIUM' THEN 'Medium' WHEN '4-NOT SPECIFIED' THEN 'Unknown' WHEN '5-LOW' THEN 'Low' END)
         AS priority,
       CASE WHEN e.value / 100 <= 2 THEN 'negative' WHEN e.value / 100 >= 4 THEN 'positive' ELSE 'neutral' END
         AS sentiment,
       'raw' AS source
FROM documents d JOIN orders o ON o.o_orderkey = d.doc_id JOIN events e ON e.event_id = d.doc_id""")
def raw_or_prepared(spark, sf_dir):
    """S2 + P1 + P3: no prepared table exists, so the raw ticket CSV (reference column
    names) is detected, projected and converted; the source used is reported."""
    from ticketlake.plans.q_prep import _raw_tickets

    raw = _folder(spark, "raw_tickets")
    files.export_csv(_raw_tickets(spark, sf_dir), raw)
    df, source = prep.load_preprocessed_or_raw(spark, _folder(spark, "missing_prepared"), raw)
    return df.withColumn("source", F.lit(source.split(":", 1)[0]))
