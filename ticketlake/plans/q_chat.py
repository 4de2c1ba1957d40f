"""Driver queries: conversations, sessions, users, change-sets (step 4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketlake.operators import chat
from ticketlake.plans.registry import query
from ticketlake.sources.tables import qa_messages, table

# Q/A pairs from role rows, as SQL (the oracle's own lead() formulation).
_QA = """
  SELECT conv_id AS session_id, turn AS msg_pos, text AS question,
         CASE WHEN nr = 'assistant' THEN nt END AS answer,
         CASE WHEN nr = 'assistant' THEN nturn END AS answer_turn
  FROM (SELECT conv_id, turn, role, text,
               lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nr,
               lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nt,
               lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS nturn
        FROM conversations WHERE role <> 'system') t
  WHERE role = 'user'"""

# Questions are stamped at 2024-01-01 00:00:00 + 2 s per turn (derived, deterministic).
_Q_TIME_SQL = "TIMESTAMP '2024-01-01 00:00:00' + to_seconds(msg_pos * 2)"


def _q_time():
    return F.timestamp_add("SECOND", F.col("msg_pos") * 2, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))


@query("qa_pairs", sql=f"SELECT session_id, msg_pos, question, answer, answer_turn FROM ({_QA}) q")
def qa_pairs(spark, sf_dir):
    return qa_messages(spark, sf_dir)


@query("message_view", sql="""
SELECT conv_id AS session_id, turn AS msg_pos,
  CASE WHEN role = 'user' AND text <> '' THEN 'User' WHEN role = 'assistant' AND text <> '' THEN 'Bot'
       ELSE 'Unknown' END AS sender,
  CASE WHEN role IN ('user', 'assistant') AND text <> '' THEN text ELSE coalesce(text, '') END AS display_text,
  '' AS feedback
FROM conversations""")
def message_view(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    msgs = c.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("msg_pos"),
                    F.when(F.col("role") == "user", F.col("text")).alias("question"),
                    F.when(F.col("role") == "assistant", F.col("text")).alias("answer"),
                    F.col("text"))
    return chat.message_view(msgs).select("session_id", "msg_pos", "sender", "display_text", "feedback")


@query("session_rollup", sql=f"""
SELECT session_id, count(*)::BIGINT AS n_messages, count(answer)::BIGINT AS n_answered,
       min(msg_pos) AS first_pos, max(msg_pos) AS last_pos, arg_min(question, msg_pos) AS first_question,
       min({_Q_TIME_SQL}) AS start_time, max({_Q_TIME_SQL}) AS last_updated
FROM ({_QA}) q GROUP BY session_id""")
def session_rollup(spark, sf_dir):
    m = qa_messages(spark, sf_dir).withColumn("q_time", _q_time())
    return chat.session_rollup(m, ts_col="q_time")


@query("session_merge", sql="""
SELECT o_custkey AS session_id, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS user_id,
       min(o_orderdate) AS start_time, max(o_orderdate) AS last_updated
FROM orders GROUP BY o_custkey""")
def session_merge(spark, sf_dir):
    """M1 upsert: sessions built from the orders before 1996 are merged with the
    messages (orders) from 1996 on; the merge must equal one rollup over all rows."""
    o = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("user_id"),
        F.col("o_orderdate").alias("ts"))
    cut = F.lit("1996-01-01").cast("timestamp_ntz")
    old = o.filter(F.col("ts") < cut).groupBy("session_id").agg(
        F.min_by("user_id", F.struct("ts", "user_id")).alias("user_id"), F.min("ts").alias("start_time"),
        F.max("ts").alias("last_updated"))
    return chat.merge_sessions(old, o.filter(F.col("ts") >= cut), "ts", "user_id")


@query("session_topic", sql=f"""
WITH q AS ({_QA}),
f AS (SELECT session_id, arg_min(question, msg_pos) AS fq FROM q GROUP BY session_id)
SELECT session_id,
  array_to_string(list_filter(string_split_regex(lower(coalesce(fq, '')), '[ \\t\\n\\x0B\\f\\r]+'),
                              lambda x: x <> '')[1:3], ', ') AS topic
FROM f""")
def session_topic(spark, sf_dir):
    """A10 without tags: the first three words of the session's first question."""
    m = qa_messages(spark, sf_dir).withColumn("intent_tag", F.lit(None).cast("string"))
    return chat.session_topic(m)


@query("session_topic_tags", sql="""
WITH c AS (SELECT user_id AS session_id, event_type, count(*) AS n, min(event_id) AS first
           FROM events GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY n DESC, first) AS rn FROM c)
SELECT session_id, event_type AS topic FROM r WHERE rn = 1""")
def session_topic_tags(spark, sf_dir):
    """A10 with tags: events as messages of the user's session, event type as the tag."""
    ev = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_id"), F.col("event_id").alias("msg_pos"),
        F.col("event_type").alias("intent_tag"), F.lit(None).cast("string").alias("question"))
    return chat.session_topic(ev)


@query("session_search", sql=f"""
SELECT DISTINCT s.session_id FROM (SELECT DISTINCT conv_id AS session_id FROM conversations) s
WHERE s.session_id IN (SELECT session_id FROM ({_QA}) q
                       WHERE regexp_matches(question, '(?i)anan') OR regexp_matches(answer, '(?i)anan'))""")
def session_search(spark, sf_dir):
    sessions = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id")).distinct()
    return chat.session_search(sessions, qa_messages(spark, sf_dir), "anan")


@query("latest_per_user", sql="""
SELECT o_custkey, o_orderkey, o_orderdate FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey) AS rn
  FROM orders) WHERE rn = 1""")
def latest_per_user(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return chat.latest_per_key(o, "o_custkey", "o_orderdate", "o_orderkey")


@query("sessions_of_user", sql="""
SELECT c.c_name, o.o_orderkey, o.o_orderdate,
       row_number() OVER (PARTITION BY o.o_custkey ORDER BY o.o_orderdate DESC NULLS LAST, o.o_orderkey) AS idx
FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey""")
def sessions_of_user(spark, sf_dir):
    """Each user's sessions newest first, numbered from 1."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    j = o.join(c, "o_custkey")
    return chat.numbered_newest_first(j, "o_custkey", "o_orderdate", "o_orderkey").drop("o_custkey")


@query("user_upsert", sql="""
SELECT user_id AS email, min(ts) AS first_seen, max(ts) AS last_active FROM events GROUP BY user_id""")
def user_upsert(spark, sf_dir):
    """A users table from the first half of January, upserted with the rest of
    the activity; the result must equal one aggregate over all activity."""
    ev = table(spark, sf_dir, "events").select(F.col("user_id").alias("email"), "ts")
    cut = F.lit("2024-01-15").cast("timestamp_ntz")
    users = ev.filter(F.col("ts") < cut).groupBy("email").agg(
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_active"))
    return chat.upsert_users(users, ev.filter(F.col("ts") >= cut), "email", "ts")


@query("pending_messages", sql=f"""
SELECT session_id, msg_pos,
  CASE WHEN (epoch_us(TIMESTAMP '2024-01-01 00:00:20') - epoch_us({_Q_TIME_SQL})) / 1e6 < 5
       THEN 'thinking' ELSE 'still looking' END AS status
FROM ({_QA}) q WHERE answer IS NULL""")
def pending_messages(spark, sf_dir):
    m = qa_messages(spark, sf_dir).withColumn("q_time", _q_time())
    as_of = F.lit("2024-01-01 00:00:20").cast("timestamp_ntz")
    return chat.pending_messages(m, "q_time", as_of).select("session_id", "msg_pos", "status")


# Change-set from lineitem: line 1 of an order updates its total price to that line's
# extended price, line 2 with return flag 'R' deletes the order, line 3 updates it
# again; per order the highest line number wins.
@query("apply_changes", sql="""
WITH ch AS (
  SELECT l_orderkey AS o_orderkey, l_linenumber AS seq,
         CASE WHEN l_linenumber = 2 THEN 'delete' ELSE 'update' END AS op,
         l_extendedprice AS o_totalprice
  FROM lineitem WHERE l_linenumber IN (1, 3) OR (l_linenumber = 2 AND l_returnflag = 'R')),
upd AS (SELECT o_orderkey, max(o_totalprice) AS price FROM (
          SELECT *, max(seq) OVER (PARTITION BY o_orderkey) AS top FROM ch WHERE op = 'update' AND o_totalprice IS NOT NULL)
        WHERE seq = top GROUP BY 1)
SELECT o.o_orderkey, o.o_custkey, o.o_orderstatus, coalesce(u.price, o.o_totalprice) AS o_totalprice,
       o.o_orderdate, o.o_orderpriority
FROM orders o LEFT JOIN upd u ON u.o_orderkey = o.o_orderkey
WHERE o.o_orderkey NOT IN (SELECT o_orderkey FROM ch WHERE op = 'delete')""")
def apply_changes(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    ch = li.filter(F.col("l_linenumber").isin(1, 3) | ((F.col("l_linenumber") == 2) & (F.col("l_returnflag") == "R")))
    ch = ch.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("seq"),
                   F.when(F.col("l_linenumber") == 2, F.lit("delete")).otherwise(F.lit("update")).alias("op"),
                   F.col("l_extendedprice").alias("o_totalprice"))
    return chat.apply_changes(table(spark, sf_dir, "orders"), ch, "o_orderkey", "seq", ["o_totalprice"])


@query("apply_answers", sql=f"""
SELECT session_id, msg_pos, question, answer FROM ({_QA}) q
UNION ALL
SELECT conv_id, turn, NULL, text FROM conversations c
WHERE role = 'assistant' AND NOT EXISTS (
  SELECT 1 FROM ({_QA}) q WHERE q.session_id = c.conv_id AND q.answer_turn = c.turn)""")
def apply_answers(spark, sf_dir):
    """M2 + M3: pending questions (answer null) receive the assistant turns as updates
    keyed by the message they answer; an assistant turn that answers no question is
    appended as a message of its own."""
    m = qa_messages(spark, sf_dir)
    pending = m.select("session_id", "msg_pos", "question", F.lit(None).cast("string").alias("answer"))
    answered = m.filter(F.col("answer_turn").isNotNull())
    upd = answered.select("session_id", "msg_pos", "answer")
    conv = table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant")
    orphan = conv.join(answered.select(F.col("session_id").alias("conv_id"), F.col("answer_turn").alias("turn")),
                       ["conv_id", "turn"], "left_anti")
    upd = upd.unionByName(orphan.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("msg_pos"),
                                        F.col("text").alias("answer")))
    return chat.apply_message_updates(pending, upd, ["answer"])


@query("ticket_resolution", sql="""
SELECT o.o_orderkey, c.c_name,
  CASE WHEN o.o_orderkey IS NULL THEN 'invalid ticket' WHEN c.c_custkey IS NULL THEN 'user not found'
       ELSE 'ok' END AS status
FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey""")
def ticket_resolution(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    out = chat.resolve_tickets(o, table(spark, sf_dir, "customer"), "o_custkey", "c_custkey", ["c_name"])
    return out.select("o_orderkey", "c_name", "status")


@query("session_topic_all", sql=f"""
WITH q AS ({_QA}),
f AS (SELECT session_id, arg_min(question, msg_pos) AS fq FROM q GROUP BY session_id)
SELECT c.c_custkey AS session_id, CASE WHEN f.session_id IS NULL THEN 'No topic' ELSE
  array_to_string(list_filter(string_split_regex(lower(coalesce(fq, '')), '[ \\t\\n\\x0B\\f\\r]+'),
                              lambda x: x <> '')[1:3], ', ') END AS topic
FROM customer c LEFT JOIN f ON f.session_id = c.c_custkey""")
def session_topic_all(spark, sf_dir):
    """A10 over a session table (customers' own sessions): those without a message have
    'No topic'."""
    m = qa_messages(spark, sf_dir).withColumn("intent_tag", F.lit(None).cast("string"))
    sessions = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session_id"))
    return chat.session_topic(m, sessions=sessions)


@query("delete_rows", sql="""
SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT coalesce(o_orderstatus = 'F', false)""")
def delete_rows(spark, sf_dir):
    """M5: the rows that a delete by filter leaves."""
    o = table(spark, sf_dir, "orders")
    return chat.delete_where(o, F.col("o_orderstatus") == "F")[0].select("o_orderkey", "o_orderstatus")


@query("delete_counts", sql="""
SELECT count(*) FILTER (WHERE NOT coalesce(o_orderstatus = 'F', false))::BIGINT AS n_kept,
       count(*) FILTER (WHERE coalesce(o_orderstatus = 'F', false))::BIGINT AS n_deleted
FROM orders""")
def delete_counts(spark, sf_dir):
    """M5: delete by filter, with the count of deleted rows (one pass)."""
    o = table(spark, sf_dir, "orders")
    pred = F.col("o_orderstatus") == "F"
    _, n_deleted = chat.delete_where(o, pred)
    return o.agg(F.count_if(~F.coalesce(pred, F.lit(False))).alias("n_kept"), n_deleted.alias("n_deleted"))


@query("sessions_newest_first", sql="""
SELECT o_orderkey AS session_id, o_custkey AS user_id, o_orderdate AS start_time FROM orders
ORDER BY o_orderdate DESC NULLS LAST, o_orderkey""")
def sessions_newest_first(spark, sf_dir):
    """O5 + S9: every session, newest first: a projected scan and a global sort
    (range-partitioned, no single-task sort)."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id"),
                                              F.col("o_custkey").alias("user_id"),
                                              F.col("o_orderdate").alias("start_time"))
    return o.orderBy(F.col("start_time").desc_nulls_last(), F.col("session_id"))


@query("run_progress", sql="""
SELECT event_id, event_type, n AS idx, CAST(floor(n / total * 100) AS INTEGER) AS progress
FROM (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS n, count(*) OVER () AS total FROM events)""")
def run_progress(spark, sf_dir):
    """The events in time order, numbered from 1, with the percentage done."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    return chat.numbered_with_progress(e, ["ts", "event_id"]).drop("ts")


def _line_sessions(spark, sf_dir):
    """Documents as nested sessions, a message per line, and one update for each labelled
    document: the line numbered by its two labels becomes 'edited'."""
    lines = F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("content"), F.length(x).alias("size")))
    sessions = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("session_id"), lines.alias("messages"))
    updates = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("session_id"), (F.col("quality") + 5 * F.col("toxic")).alias("index"), F.lit("edited").alias("value"))
    return sessions, updates


@query("nested_updates", sql="""
SELECT d.doc_id AS session_id, len(string_split(text, chr(10)))::INTEGER AS n_messages,
       array_to_string(list_transform(string_split(text, chr(10)),
         lambda x, i: CASE WHEN i - 1 = l.quality + 5 * l.toxic THEN 'edited' ELSE x END), chr(10)) AS text
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def nested_updates(spark, sf_dir):
    """M2 nested: the sessions after the updates."""
    out, _ = chat.update_nested_messages(*_line_sessions(spark, sf_dir), "content")
    return out.select("session_id", F.size("messages").alias("n_messages"),
                      F.array_join(F.col("messages.content"), "\n").alias("text"))


@query("nested_update_rejects", sql="""
SELECT l.doc_id AS session_id, quality + 5 * toxic AS index, 'edited' AS value,
       CASE WHEN d.doc_id IS NULL THEN 'session not found' ELSE 'message not found' END AS reject_reason
FROM labels l LEFT JOIN documents d USING (doc_id)
WHERE d.doc_id IS NULL OR quality + 5 * toxic >= len(string_split(d.text, chr(10)))""")
def nested_update_rejects(spark, sf_dir):
    """M2 nested: the updates whose message does not exist."""
    _, rejects = chat.update_nested_messages(*_line_sessions(spark, sf_dir), "content")
    return rejects
