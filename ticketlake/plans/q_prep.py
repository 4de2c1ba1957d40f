"""Driver queries: ticket preparation, hygiene, ragged unions, rule tagging (step 3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketlake.functions import text as tx
from ticketlake.functions.scalar import export_time, keyword_priority, normalise_name, rating_to_sentiment, session_id
from ticketlake.operators import prep
from ticketlake.plans.registry import query
from ticketlake.sources.tables import qa_messages, table

# ---- fixed values of the test mapping (FIXTURES.md §2) -------------------------------
# orders.o_orderpriority -> raw ticket priority label
ORDER_PRIORITY_LABELS = {
    "1-URGENT": "Critical", "2-HIGH": "High", "3-MEDIUM": "Medium",
    "4-NOT SPECIFIED": "Unknown", "5-LOW": "Low",
}
# ---------------------------------------------------------------------------------------

_PRIO_CASE = ("CASE o_orderpriority " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in ORDER_PRIORITY_LABELS.items()) + " END")

_SENT_CASE = """CASE WHEN {x} IS NULL OR isnan({x}) THEN 'neutral' WHEN {x} <= 2 THEN 'negative'
  WHEN {x} >= 4 THEN 'positive' ELSE 'neutral' END"""


def _order_priority(col="o_orderpriority"):
    m = F.create_map(*[F.lit(x) for kv in ORDER_PRIORITY_LABELS.items() for x in kv])
    return m[F.col(col)]


@query("rating_sentiment", sql=f"""
SELECT {_SENT_CASE.format(x='value / 100')} AS sentiment, count(*)::BIGINT AS n
FROM events GROUP BY 1""")
def rating_sentiment(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return ev.groupBy(rating_to_sentiment(F.col("value") / 100).alias("sentiment")).agg(
        F.count(F.lit(1)).alias("n"))


def _raw_tickets(spark, sf_dir):
    """A raw ticket table with the reference's CSV column names, made of test tables."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("Ticket ID"),
                                                 F.col("text").alias("Ticket Description"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("Ticket ID"),
                                              _order_priority().alias("Ticket Priority"))
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("Ticket ID"),
                                              (F.col("value") / 100).alias("Customer Satisfaction Rating"))
    return d.join(o, "Ticket ID").join(e, "Ticket ID")


@query("ticket_prep", sql=f"""
WITH raw AS (
  SELECT d.doc_id AS ticket_id, trim(d.text) AS description, trim({_PRIO_CASE}) AS priority,
         {_SENT_CASE.format(x='e.value / 100')} AS sentiment
  FROM documents d JOIN orders o ON o.o_orderkey = d.doc_id JOIN events e ON e.event_id = d.doc_id),
norm AS (
  SELECT ticket_id, description, CASE WHEN priority = 'Critical' THEN 'High' ELSE priority END AS priority,
         lower(trim(sentiment)) AS sentiment
  FROM raw WHERE description IS NOT NULL AND priority IS NOT NULL AND sentiment IS NOT NULL),
lab AS (SELECT * FROM norm WHERE lower(trim(priority)) NOT IN ('', 'unknown') AND length(description) >= 10)
SELECT ticket_id, description, priority, sentiment FROM (
  SELECT *, row_number() OVER (PARTITION BY description ORDER BY ticket_id) AS rn FROM lab) WHERE rn = 1""")
def ticket_prep(spark, sf_dir):
    """P1 -> P3 -> P4 -> F2 -> P6 -> P5 -> W3: the whole preparation chain."""
    t = prep.from_raw(_raw_tickets(spark, sf_dir))
    t = prep.normalise_labels(t)
    t = prep.label_filter(t, "priority")
    return prep.basic_hygiene(t, "description", 10, True, order=["ticket_id"])


@query("normalise_labels", sql=f"""
SELECT o_orderkey, CASE WHEN p = 'Critical' THEN 'High' ELSE p END AS priority
FROM (SELECT o_orderkey, {_PRIO_CASE} AS p FROM orders)
WHERE p IS NOT NULL AND lower(trim(p)) NOT IN ('', 'unknown')""")
def normalise_labels(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", _order_priority().alias("priority"))
    return prep.label_filter(prep.normalise_labels(o, "priority", None), "priority")


@query("hygiene_dedup", sql="""
SELECT doc_id, lang, n_chars FROM (
  SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents
  WHERE length(text) >= 10) WHERE rn = 1""")
def hygiene_dedup(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return prep.basic_hygiene(d, "text", 10, True, order=["doc_id"]).select("doc_id", "lang", "n_chars")


@query("required_fields", sql="""
WITH t AS (SELECT conv_id, turn, role, text,
             lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nr,
             lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nt
           FROM conversations WHERE role <> 'system')
SELECT conv_id AS session_id, turn AS msg_pos FROM t
WHERE role = 'user' AND text IS NOT NULL AND nr = 'assistant' AND nt IS NOT NULL""")
def required_fields(spark, sf_dir):
    m = qa_messages(spark, sf_dir)
    return prep.required_fields(m, ["question", "answer"]).select("session_id", "msg_pos")


@query("union_ragged", sql="""
SELECT CAST(NULL AS VARCHAR) AS user_id, 'train_models' AS event, 'file_' || event_id AS file,
       'success' AS status, CAST(NULL AS VARCHAR) AS model, CAST(NULL AS DOUBLE) AS score,
       ts AS "timestamp", 'train' AS log_source
FROM events WHERE event_type = 'signup'
UNION ALL
SELECT CAST(o_custkey AS VARCHAR), NULL, NULL, NULL, o_orderstatus,
       TRY_CAST(CASE WHEN o_orderstatus = 'P' THEN 'bad' ELSE CAST(o_totalprice AS VARCHAR) END AS DOUBLE),
       o_orderdate, 'simulation'
FROM orders""")
def union_ragged(spark, sf_dir):
    """Train-event and test-result logs with different columns, one table; ids to
    strings (P13), the score text coerced (P14: 'bad' -> null), times coerced (P15)."""
    ev = table(spark, sf_dir, "events").filter(F.col("event_type") == "signup")
    train = ev.select(F.lit("train_models").alias("event"),
                      F.concat(F.lit("file_"), F.col("event_id").cast("string")).alias("file"),
                      F.lit("success").alias("status"), F.col("ts").alias("timestamp"),
                      F.lit("train").alias("log_source"))
    o = table(spark, sf_dir, "orders")
    tests = o.select(F.col("o_custkey").alias("user_id"), F.col("o_orderstatus").alias("model"),
                     F.when(F.col("o_orderstatus") == "P", F.lit("bad"))
                     .otherwise(F.col("o_totalprice").cast("string")).alias("score"),
                     F.col("o_orderdate").alias("timestamp"), F.lit("simulation").alias("log_source"))
    return prep.union_ragged([train, tests], numeric_cols=["score"], time_cols=["timestamp"],
                             id_cols=["user_id"])


@query("keyword_priority", sql="""
SELECT doc_id, CASE WHEN text IS NULL OR text = '' THEN 'low'
  WHEN contains(lower(text), 'urgent') OR contains(lower(text), 'asap') OR contains(lower(text), 'critical') THEN 'high'
  WHEN contains(lower(text), 'how to') OR contains(lower(text), 'can you explain') THEN 'low' END AS rule_priority
FROM documents""")
def keyword_priority_q(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", keyword_priority("text").alias("rule_priority"))


def _role_sql(tbl: str, id_col: str, text_col: str) -> str:
    arms = []
    for role, kws in tx.ROLE_KEYWORDS.items():
        cond = " OR ".join(f"contains(lower({text_col}), '{k.lower()}')" for k in kws)
        arms.append(f"SELECT {id_col}, '{role}' AS role FROM {tbl} WHERE {cond}")
    hits = " UNION ALL ".join(arms)
    return f"""
WITH h AS ({hits})
SELECT * FROM h
UNION ALL
SELECT {id_col}, '{tx.NO_ROLE}' FROM {tbl} WHERE {id_col} NOT IN (SELECT {id_col} FROM h)"""


@query("role_tags", sql=_role_sql("pages", "page_id", "html"))
def role_tags(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.explode(tx.role_tags("html")).alias("role"))


@query("role_tags_docs", sql=_role_sql("documents", "doc_id", "text"))
def role_tags_docs(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.explode(tx.role_tags("text")).alias("role"))


@query("overlength", sql="""
SELECT source, count(*)::BIGINT AS n_docs,
       count(*) FILTER (WHERE len(regexp_extract_all(text, '[\\p{L}\\p{M}\\p{N}_]{2,}')) > 512)::BIGINT AS n_over,
       max(len(regexp_extract_all(text, '[\\p{L}\\p{M}\\p{N}_]{2,}')))::BIGINT AS max_tokens
FROM documents GROUP BY source""")
def overlength(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", tx.token_count("text").alias("n_tok"))
    return d.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.count_if(F.col("n_tok") > 512).alias("n_over"),
        F.max("n_tok").cast("bigint").alias("max_tokens"),
    )


@query("faq_import_counts", sql="""
WITH t AS (SELECT conv_id, turn, role, text,
             lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nr,
             lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nt
           FROM conversations WHERE role <> 'system'),
m AS (SELECT text AS question, CASE WHEN nr = 'assistant' THEN nt END AS answer FROM t WHERE role = 'user')
SELECT coalesce(length(trim(question)), 0) > 0 AND coalesce(length(trim(answer)), 0) > 0 AS accepted,
       count(*)::BIGINT AS n
FROM m GROUP BY 1""")
def faq_import_counts(spark, sf_dir):
    """P16 + S7/S8: question/answer pairs imported into the FAQ table; the rows without
    both fields go to the reject side.  Counted here per side."""
    m = qa_messages(spark, sf_dir)
    good, bad = prep.required_pair(m, "question", "answer")
    return (good.select(F.lit(True).alias("accepted"))
            .unionByName(bad.select(F.lit(False).alias("accepted")))
            .groupBy("accepted").agg(F.count(F.lit(1)).alias("n")))


@query("page_inventory", sql="""
SELECT page_id, strlen(html) / 1024.0 AS size_kb,
       (length(html) - length(replace(html, chr(10), ''))
        + CASE WHEN html = '' OR suffix(html, chr(10)) THEN 0 ELSE 1 END)::BIGINT AS n_lines
FROM pages""")
def page_inventory(spark, sf_dir):
    """S17 on stored pages: size in KB (UTF-8 bytes / 1024) and line count of each
    page's html (the same columns ``files.file_inventory`` gives for files on disk)."""
    from ticketlake.sources.files import line_count

    p = table(spark, sf_dir, "pages")
    return p.select("page_id", (F.octet_length("html") / 1024.0).alias("size_kb"),
                    line_count(F.col("html")).alias("n_lines"))


@query("fill_text", sql="""
SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END, '') AS note FROM orders""")
def fill_text(spark, sf_dir):
    """A text column with nulls (orders in status P have no note) filled with ''."""
    note = F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("note")
    return prep.fill_text(table(spark, sf_dir, "orders").select("o_orderkey", note), "note")


_SPACE = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


@query("normalised_names", sql=f"""
SELECT conv_id, turn, trim(regexp_replace(lower(text), '{_SPACE}', ' ', 'g'), ' ') AS name FROM conversations""")
def normalised_names(spark, sf_dir):
    """texts as names: stripped, lower case, runs of white space as one blank."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", normalise_name("text").alias("name"))


@query("session_ids", sql="""
SELECT event_id, strftime(ts, '%Y%m%d%H%M%S') || '-' || substr(sha256(CAST(event_id AS VARCHAR)), 1, 8) AS session_id
FROM events""")
def session_ids(spark, sf_dir):
    """a session id for every event."""
    return table(spark, sf_dir, "events").select("event_id", session_id("ts", "event_id").alias("session_id"))


@query("export_times", sql="""
SELECT event_id, coalesce(strftime(CASE WHEN event_type <> 'error' THEN ts END, '%Y-%m-%d %H:%M:%S'), 'unknown') AS shown
FROM events""")
def export_times(spark, sf_dir):
    """times as an export shows them; an error event has none."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", export_time(F.when(F.col("event_type") != "error", F.col("ts"))).alias("shown"))


_LOG_SQL = """
SELECT CAST(o_custkey AS VARCHAR) AS user_id, o_orderstatus AS model,
       TRY_CAST(CASE WHEN o_orderstatus = 'P' THEN 'bad' ELSE CAST(o_totalprice AS VARCHAR) END AS DOUBLE) AS score,
       o_orderdate AS "timestamp", 'simulation' AS log_type
FROM orders"""


@query("selected_logs", sql=_LOG_SQL)
def selected_logs(spark, sf_dir):
    """U1 with a choice: of the train and test-result logs only the latter."""
    train = table(spark, sf_dir, "events").filter(F.col("event_type") == "signup").select(
        F.lit("train_models").alias("event"), F.col("ts").alias("timestamp"))
    o = table(spark, sf_dir, "orders")
    price = F.when(F.col("o_orderstatus") == "P", F.lit("bad")).otherwise(F.col("o_totalprice").cast("string"))
    tests = o.select(F.col("o_custkey").alias("user_id"), F.col("o_orderstatus").alias("model"), price.alias("score"),
                     F.col("o_orderdate").alias("timestamp"))
    return prep.select_logs({"train": train, "simulation": tests}, "simulation",
                            numeric_cols=["score"], time_cols=["timestamp"], id_cols=["user_id"])


@query("numeric_means", sql="""
SELECT l_returnflag, avg(l_orderkey) AS mean_l_orderkey, avg(l_partkey) AS mean_l_partkey, avg(l_suppkey) AS mean_l_suppkey,
       avg(l_quantity) AS mean_l_quantity, avg(l_extendedprice) AS mean_l_extendedprice
FROM lineitem GROUP BY 1""")
def numeric_means(spark, sf_dir):
    """Of a line item's columns, names and dates among them, the numeric ones averaged."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_returnflag", "l_linestatus", "l_shipdate", "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return prep.numeric_means(li, "l_returnflag")
