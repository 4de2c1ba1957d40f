"""Conversation operators on the flat ``messages`` table (P8, P9, A10, J6, J9, J11, W2,
W4, M1-M5, F11).

The canonical form is flat: one row per message keyed by (session_id, msg_pos).  A
session never becomes one array row, so a session holding a third of all messages
still spreads over tasks: every operator here is a keyed aggregate, a window with a
bounded output per key (row_number = 1), or an equi join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketlake.functions.scalar import pending_status
from ticketlake.session import materialize

# ---- fixed values (must equal the reference's for right results) --------------------
SENDER_USER, SENDER_BOT, SENDER_UNKNOWN = "User", "Bot", "Unknown"
FEEDBACK_POSITIVE, FEEDBACK_NEGATIVE, FEEDBACK_NONE = "positive", "negative", ""
NO_TOPIC = "No topic"
TOPIC_WORDS = 3
TOPIC_JOIN = ", "
USER_NOT_FOUND, INVALID_TICKET, RESOLVED = "user not found", "invalid ticket", "ok"
NO_SESSION, NO_MESSAGE = "session not found", "message not found"
# ---------------------------------------------------------------------------------------


def _nonempty(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def message_view(messages: DataFrame) -> DataFrame:
    """Sender User / Bot / Unknown and its text, feedback positive / negative / ''."""
    q, a = F.col("question"), F.col("answer")
    other = F.col("text") if "text" in messages.columns else F.lit("")
    up = F.coalesce(F.col("thumbs_up"), F.lit(False)) if "thumbs_up" in messages.columns else F.lit(False)
    down = F.coalesce(F.col("thumbs_down"), F.lit(False)) if "thumbs_down" in messages.columns else F.lit(False)
    return messages.withColumns({
        "sender": F.when(_nonempty(q), F.lit(SENDER_USER)).when(_nonempty(a), F.lit(SENDER_BOT))
        .otherwise(F.lit(SENDER_UNKNOWN)),
        "display_text": F.when(_nonempty(q), q).when(_nonempty(a), a).otherwise(F.coalesce(other, F.lit(""))),
        "feedback": F.when(up, F.lit(FEEDBACK_POSITIVE)).when(down, F.lit(FEEDBACK_NEGATIVE))
        .otherwise(F.lit(FEEDBACK_NONE)),
    })


def session_rollup(messages: DataFrame, ts_col: str | None = None, user_col: str | None = None) -> DataFrame:
    """M1 (read side): one row per session from its messages: counts, first question,
    first / last position (and time and user when given).  A keyed aggregate with
    partial aggregation: no session's messages are ever gathered in one place."""
    aggs = [
        F.count(F.lit(1)).alias("n_messages"),
        F.count_if(F.col("answer").isNotNull()).alias("n_answered"),
        F.min("msg_pos").alias("first_pos"),
        F.max("msg_pos").alias("last_pos"),
        F.min_by("question", "msg_pos").alias("first_question"),
    ]
    if ts_col:
        aggs += [F.min(ts_col).alias("start_time"), F.max(ts_col).alias("last_updated")]
    if user_col:
        aggs.append(F.min_by(user_col, ts_col or "msg_pos").alias("user_id"))
    return messages.groupBy("session_id").agg(*aggs)


def merge_sessions(old: DataFrame, new_msgs: DataFrame, ts_col: str, user_col: str) -> DataFrame:
    """M1 upsert: sessions of new messages merged into the session table by a full outer
    join: start time and user kept from the old row (set-on-insert), last_updated is the
    later of both.  The user of a new session is the earliest message's (ties: lowest)."""
    n = new_msgs.groupBy("session_id").agg(
        F.min(ts_col).alias("n_start"), F.max(ts_col).alias("n_last"),
        F.min_by(user_col, F.struct(ts_col, user_col)).alias("n_user"))
    j = old.join(n, "session_id", "full_outer")
    return j.select(
        "session_id",
        F.coalesce("user_id", "n_user").alias("user_id"),
        F.coalesce("start_time", "n_start").alias("start_time"),
        F.greatest("last_updated", "n_last").alias("last_updated"),
    )


def session_topic(messages: DataFrame, tag_col: str = "intent_tag", order_col: str = "msg_pos",
                  sessions: DataFrame | None = None) -> DataFrame:
    """A10: most frequent tag of the session, ties to the tag met first (T26); without
    tags the first three words of the first question joined by ', '; 'No topic' for a
    session of ``sessions`` (session_id) that has no message.

    Two keyed aggregates and one row_number = 1 window, all partitioned by session;
    the fallback text is a min_by, so nothing per session is collected.
    """
    tags = (messages.filter(_nonempty(F.col(tag_col)))
            .groupBy("session_id", tag_col)
            .agg(F.count(F.lit(1)).alias("_n"), F.min(order_col).alias("_first")))
    w = Window.partitionBy("session_id").orderBy(F.col("_n").desc(), F.col("_first").asc())
    best = (tags.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1")
            .select("session_id", F.col(tag_col).alias("_tag")))
    first_q = messages.groupBy("session_id").agg(
        F.min_by(F.col("question"), F.col(order_col)).alias("_q"))
    words = F.filter(F.split(F.lower(F.coalesce(F.col("_q").cast("string"), F.lit(""))),
                             r"[ \t\n\x0B\f\r]+"), lambda x: x != "")
    fallback = F.array_join(F.slice(words, 1, TOPIC_WORDS), TOPIC_JOIN)
    topics = first_q.join(best, "session_id", "left").select(
        "session_id", F.coalesce(F.col("_tag"), fallback).alias("topic"))
    if sessions is None:
        return topics
    return sessions.select("session_id").distinct().join(topics, "session_id", "left").select(
        "session_id", F.coalesce("topic", F.lit(NO_TOPIC)).alias("topic"))


def session_search(sessions: DataFrame, messages: DataFrame, pattern: str,
                   user_col: str = "user_id") -> DataFrame:
    """Sessions whose user id, or any question or answer, matches ``pattern``
    (case-insensitive regex).  On flat messages: a semi join back to the sessions."""
    rx = "(?i)" + pattern
    hit_msgs = messages.filter(F.col("question").rlike(rx) | F.col("answer").rlike(rx)).select("session_id")
    by_msg = sessions.join(hit_msgs, "session_id", "left_semi")
    if user_col in sessions.columns:
        by_user = sessions.filter(F.col(user_col).cast("string").rlike(rx))
        return by_user.unionByName(by_msg).distinct()
    return by_msg


def latest_per_key(df: DataFrame, key: str, ts_col: str, tie_col: str) -> DataFrame:
    """Newest row per key; row_number = 1 becomes a WindowGroupLimit on both sides
    of the shuffle (each task ships one row per key)."""
    w = Window.partitionBy(key).orderBy(F.col(ts_col).desc_nulls_last(), F.col(tie_col).asc())
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def sorted_ranges(df: DataFrame, *order: Column | str) -> DataFrame:
    """The rows sorted over the whole table and written once, with the number of the range
    each lies in (``_range``, in the order of the ranges).  A key with a third of all rows
    fills many ranges, as long as ``order`` tells its rows apart."""
    return materialize(df.orderBy(*order).withColumn("_range", F.spark_partition_id()))


def numbered(df: DataFrame, key: str, order: Sequence[Column], name: str = "idx") -> DataFrame:
    """Number each key's rows from 1 in the given order (a null key is a key).

    A row's number is its place among the key's rows of its sorted range plus the key's
    rows in the ranges before, so a key with a third of all rows is never one task."""
    ranges = sorted_ranges(df, F.col(key), *order)
    sizes = ranges.groupBy(F.col(key).alias("_key"), F.col("_range").alias("_r")).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_key", "_r", (F.sum("_n").over(Window.partitionBy("_key").orderBy("_r")) - F.col("_n")).alias("_before"))
    here = F.row_number().over(Window.partitionBy("_range", key).orderBy(*order))
    return (ranges.withColumn("_here", here)
            .join(before, (F.col("_range") == F.col("_r")) & F.col(key).eqNullSafe(F.col("_key")))
            .withColumn(name, F.col("_before") + F.col("_here")).drop("_range", "_here", "_key", "_r", "_before"))


def numbered_newest_first(df: DataFrame, key: str, ts_col: str, tie_col: str, name: str = "idx") -> DataFrame:
    """Each key's rows numbered from 1, newest first."""
    return numbered(df, key, [F.col(ts_col).desc_nulls_last(), F.col(tie_col).asc()], name)


def with_previous(df: DataFrame, key: str, order_cols: Sequence[str], col: str, name: str = "_prev") -> DataFrame:
    """``lag`` of ``col`` over the key's rows (a null key is a key) in the order of the given
    columns, by sorted ranges: the key's first row of a range takes the last one of the
    key's range before."""
    ranges = sorted_ranges(df, key, *order_cols)
    w = Window.partitionBy("_range", key).orderBy(*order_cols)
    tails = ranges.groupBy(F.col(key).alias("_key"), F.col("_range").alias("_r")).agg(
        F.max_by(F.struct(F.col(col).alias("v")), F.struct(*order_cols)).alias("_tail"))
    carried = tails.select("_key", "_r", F.lag("_tail").over(Window.partitionBy("_key").orderBy("_r")).alias("_carried"))
    return (ranges.withColumns({"_inner": F.lag(col).over(w), "_head": F.row_number().over(w) == 1})
            .join(carried, (F.col("_range") == F.col("_r")) & F.col(key).eqNullSafe(F.col("_key")))
            .withColumn(name, F.when(F.col("_head"), F.col("_carried.v")).otherwise(F.col("_inner")))
            .drop("_range", "_inner", "_head", "_key", "_r", "_carried"))


def numbered_with_progress(df: DataFrame, order_cols: Sequence[str]) -> DataFrame:
    """The rows numbered from 1 over the whole table (``idx``) in the order of the given
    unique columns, with the percentage done after each (``progress``, cut to an integer).

    The table is sorted by ranges; a row's number is its place in its range plus the sizes
    of the ranges before it, so no task ever holds more than one range."""
    ranges = sorted_ranges(df, *order_cols)
    sizes = ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"),
                          F.sum("_n").over(Window.partitionBy()).alias("_all"))  # one row per range
    idx = F.col("_before") + F.row_number().over(Window.partitionBy("_range").orderBy(*order_cols))
    return (ranges.join(before, "_range").withColumn("idx", idx)
            .withColumn("progress", F.floor(F.col("idx") / F.col("_all") * 100).cast("int"))
            .drop("_range", "_before", "_all"))


def upsert_users(users: DataFrame, activity: DataFrame, key: str = "email", ts_col: str = "ts") -> DataFrame:
    """Insert unseen users, touch last_active of known ones.  The activity is first
    reduced to one row per user, then one full outer join on the key."""
    a = activity.groupBy(key).agg(F.min(ts_col).alias("_first"), F.max(ts_col).alias("_last"))
    j = users.join(a, key, "full_outer")
    return j.select(key,
                    F.coalesce("first_seen", "_first").alias("first_seen"),
                    F.greatest("last_active", "_last").alias("last_active"))


def resolve_tickets(tickets: DataFrame, users: DataFrame, ticket_key: str, user_key: str,
                    user_cols: Sequence[str]) -> DataFrame:
    """Ticket -> user; 'invalid ticket' without a key, 'user not found' when the key
    has no user row, else 'ok'.  One left equi join (AQE broadcasts the user side only
    when its measured size is under the threshold)."""
    u = users.select(F.col(user_key).alias("_uk"), *user_cols)
    j = tickets.join(u, tickets[ticket_key] == u["_uk"], "left")
    status = (F.when(F.col(ticket_key).isNull(), F.lit(INVALID_TICKET))
              .when(F.col("_uk").isNull(), F.lit(USER_NOT_FOUND)).otherwise(F.lit(RESOLVED)))
    return j.withColumn("status", status).drop("_uk")


def pending_messages(messages: DataFrame, time_col: str, as_of) -> DataFrame:
    """messages still without an answer, with seconds waited and a status."""
    p = messages.filter(F.col("answer").isNull())
    return p.withColumn("status", pending_status(F.col(time_col), as_of))


def apply_changes(table: DataFrame, changes: DataFrame, key: str, order_col: str,
                  value_cols: Sequence[str]) -> DataFrame:
    """M4: change rows (op in 'update' | 'delete', key, order, new values) applied one
    after the other.

    A deleted key is gone for good: a later update of it hits nothing.  Every column
    keeps its last non-null update, so partial updates add up; unknown keys are ignored;
    of updates with equal order the larger value counts.  One aggregate per key with partials on the map side (a key with very many changes
    is no hot task), then one left join."""
    def last(c: str) -> Column:
        return F.max_by(c, F.when((F.col("op") == "update") & F.col(c).isNotNull(), F.struct(order_col, c)))

    net = changes.groupBy(F.col(key).alias("_key")).agg(
        F.max(F.col("op") == "delete").alias("_gone"), *[last(c).alias(f"_new_{c}") for c in value_cols])
    j = table.join(net, table[key] == net["_key"], "left").filter(~F.coalesce("_gone", F.lit(False)))
    return j.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in value_cols else F.col(c) for c in table.columns])


def apply_message_updates(messages: DataFrame, updates: DataFrame, value_cols: Sequence[str]) -> DataFrame:
    """M2 + M3 on flat messages: updates keyed by (session_id, msg_pos) overwrite the
    given fields of their message; an update whose message does not exist is appended
    as a new message (the reference pushes it)."""
    keys = ["session_id", "msg_pos"]
    u = updates.select(*keys, *[F.col(c).alias(f"_u_{c}") for c in value_cols])
    j = messages.join(u, keys, "full_outer")
    return j.select(*keys, *[
        F.coalesce(F.col(f"_u_{c}"), F.col(c)).alias(c) if c in value_cols else F.col(c)
        for c in messages.columns if c not in keys
    ])


def update_nested_messages(sessions: DataFrame, updates: DataFrame, field: str) -> tuple[DataFrame, DataFrame]:
    """M2 on the nested session form (session_id, messages: array of structs): ``updates``
    (session_id, index, value) set ``field`` of message ``index``, counted from 0.

    Returns the sessions, all of them, and the updates that hit nothing (unknown session,
    index null or out of range) with a reason.  Of several updates of one message the
    largest value counts.  A session's updates become one map, which is no larger than its
    own array of messages."""
    sizes = sessions.select(F.col("session_id").alias("_sid"), F.size("messages").alias("_n"))
    j = updates.join(sizes, F.col("session_id") == F.col("_sid"), "left")
    hits = F.coalesce((F.col("index") >= 0) & (F.col("index") < F.col("_n")), F.lit(False))
    reason = F.when(F.col("_sid").isNull(), F.lit(NO_SESSION)).otherwise(F.lit(NO_MESSAGE))
    rejects = j.filter(~hits).select("session_id", "index", "value", reason.alias("reject_reason"))
    net = j.filter(hits).groupBy("session_id", F.col("index").cast("int").alias("_i")).agg(F.max("value").alias("_v"))
    per_session = net.groupBy(F.col("session_id").alias("_sid")).agg(
        F.map_from_entries(F.collect_list(F.struct("_i", "_v"))).alias("_new"))

    def changed(m: Column, i: Column) -> Column:
        return F.when(F.map_contains_key("_new", i), m.withField(field, F.col("_new")[i])).otherwise(m)

    out = sessions.join(per_session, F.col("session_id") == F.col("_sid"), "left")
    messages = F.when(F.col("_new").isNull(), F.col("messages")).otherwise(F.transform("messages", changed))
    return out.withColumn("messages", messages).drop("_sid", "_new"), rejects


def delete_where(df: DataFrame, predicate: Column) -> tuple[DataFrame, Column]:
    """M5: rows kept after a delete-by-filter, and the expression counting deletions."""
    return df.filter(~F.coalesce(predicate, F.lit(False))), F.count_if(F.coalesce(predicate, F.lit(False)))
