"""Column expressions: all JVM-side, inside whole-stage codegen.

Each function takes and returns ``Column`` objects, so it composes into any select,
filter or aggregate without a Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values (must equal the reference's for right results) --------------------
# Rating thresholds: <= 2 negative, >= 4 positive, otherwise neutral.
NEGATIVE_MAX = 2.0
POSITIVE_MIN = 4.0
# Priority keyword rules, checked in this order on the lower-cased text.
HIGH_PRIORITY_WORDS = ["urgent", "asap", "critical"]
LOW_PRIORITY_PHRASES = ["how to", "can you explain"]
# Cosine: epsilon added to the product of the norms; L2 normalisation epsilon.
COSINE_EPS = 1e-8
L2_EPS = 1e-12
# Session-id format: yyyyMMddHHmmss-xxxxxxxx (8 hex characters).
SESSION_TIME_FORMAT = "yyyyMMddHHmmss"
# Export time format and the text shown for a value that is not a time.
EXPORT_TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"
NOT_A_TIME = "unknown"
# Pending-answer status: below 5 seconds "thinking", otherwise "still looking".
THINKING_SECONDS = 5
# White space that the reference's strip() removes.
WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
              "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
# ---------------------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rating_to_sentiment(v) -> Column:
    """F1 with trap T1: null or NaN rating -> 'neutral'; unparsable text -> null.

    ``try_cast`` keeps ANSI mode from raising (T3); NaN must be caught *before* the
    comparisons because Spark orders NaN above every number.
    """
    v = _c(v)
    x = v.try_cast("double")
    unparsable = v.isNotNull() & x.isNull()
    return (
        F.when(unparsable, F.lit(None).cast("string"))
        .when(x.isNull() | F.isnan(x), F.lit("neutral"))
        .when(x <= NEGATIVE_MAX, F.lit("negative"))
        .when(x >= POSITIVE_MIN, F.lit("positive"))
        .otherwise(F.lit("neutral"))
    )


def normalise_priority(p) -> Column:
    """'Critical' -> 'High' (exact value, as a replace); other labels unchanged."""
    p = _c(p)
    return F.when(p == "Critical", F.lit("High")).otherwise(p)


def strip(c) -> Column:
    """White space of any kind off both ends (``trim`` alone takes blanks only)."""
    return F.btrim(_c(c), F.lit(WHITESPACE))


def normalise_sentiment(s) -> Column:
    """sentiment label stripped and lower-cased."""
    return F.lower(strip(s))


def normalise_name(s) -> Column:
    """F3 on values: strip, lower, collapse runs of whitespace to one space."""
    return F.regexp_replace(F.lower(strip(s)), "[" + WHITESPACE + "]+", " ")


def dot(a, b) -> Column:
    """Dot product of two numeric arrays, accumulated in double."""
    return F.aggregate(
        F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def norm2(a) -> Column:
    """Euclidean norm of a numeric array, in double."""
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a, b) -> Column:
    """Dot / (|a||b| + 1e-8)."""
    return dot(a, b) / (norm2(a) * norm2(b) + F.lit(COSINE_EPS))


def l2_normalise(a) -> Column:
    """x / (|x| + 1e-12), element-wise, result array<double>."""
    a = _c(a)
    n = norm2(a)
    return F.transform(a, lambda x: x.cast("double") / (n + F.lit(L2_EPS)))


def session_id(ts, key) -> Column:
    """``yyyyMMddHHmmss-xxxxxxxx``; the 8 hex characters are the start of sha2(key).

    The reference draws a random UUID; a hash of the key makes the id deterministic
    and identical on re-runs after an executor loss.
    """
    return F.concat(
        F.date_format(_c(ts), SESSION_TIME_FORMAT),
        F.lit("-"),
        F.substring(F.sha2(_c(key).cast("string"), 256), 1, 8),
    )


def keyword_priority(text) -> Column:
    """F8 rule part: empty -> 'low'; urgent/asap/critical -> 'high';
    'how to' / 'can you explain' -> 'low'; else null (left to the model)."""
    t = _c(text)
    low = F.lower(t)
    high = None
    for w in HIGH_PRIORITY_WORDS:
        c = F.contains(low, F.lit(w))
        high = c if high is None else (high | c)
    low_rule = None
    for w in LOW_PRIORITY_PHRASES:
        c = F.contains(low, F.lit(w))
        low_rule = c if low_rule is None else (low_rule | c)
    return (
        F.when(t.isNull() | (t == ""), F.lit("low"))
        .when(high, F.lit("high"))
        .when(low_rule, F.lit("low"))
        .otherwise(F.lit(None).cast("string"))
    )


def export_time(ts) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` or 'unknown' when the value is not a time."""
    return F.coalesce(F.date_format(_c(ts), EXPORT_TIME_FORMAT), F.lit(NOT_A_TIME))


def coerce_timestamp(v) -> Column:
    """Timestamp coercion, bad -> null (no exception under ANSI).  The result is
    TIMESTAMP_NTZ holding the same wall-clock time (parse and render use one zone)."""
    v = _c(v)
    return F.try_to_timestamp(v.cast("string")).cast("timestamp_ntz")


def coerce_double(v) -> Column:
    """Numeric coercion, bad -> null."""
    return _c(v).try_cast("double")


def safe_ratio(num, den, default: float = 0.0) -> Column:
    """num / den, ``default`` when the denominator is 0 or null."""
    return F.coalesce(F.try_divide(_c(num).cast("double"), _c(den).cast("double")), F.lit(default))


def pending_status(question_time, as_of) -> Column:
    """'thinking' below 5 s since the question, else 'still looking'."""
    secs = (F.unix_micros(_c(as_of).cast("timestamp")) - F.unix_micros(_c(question_time).cast("timestamp"))) / 1e6
    return F.when(secs < THINKING_SECONDS, F.lit("thinking")).otherwise(F.lit("still looking"))
