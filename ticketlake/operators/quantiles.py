"""Exact quantiles without gathering a group.

Spark's exact ``percentile`` aggregate keeps a map of every distinct value of a group
in one task — with a group holding a third of 100 TB that does not fit.  Here the
rank of every wanted order statistic is located by *selection over value buckets*:

1. per group: how many values are -inf, finite, +inf and NaN, and the finite min and
   max (one aggregate).  The order is -inf < finite < +inf < NaN, so ranks that fall on
   one of the special values are answered at once;
2. the ranks still open share a few disjoint value intervals [lo, hi]; the rows of an
   interval are counted per bucket (a keyed aggregate, once per interval whatever the
   number of ranks in it), a prefix sum finds the bucket holding each rank, and the
   interval shrinks to that bucket's actual min / max.  Buckets have equal width on a
   logarithmic scale while the interval spans magnitudes or signs, then on the plain one,
   so six levels of 4,096 buckets separate any two doubles;
3. a rank is answered when its interval holds one distinct value, or few enough rows
   (``max_local``) to number them in a window bounded by that size.

The smallest and the largest value of an interval never share a bucket, so every level
removes rows from every open interval and the loop ends with every rank answered, for
any value range and any ``max_local``; a rank left open raises.  Each level is one pass
over the rows still inside some interval; the state between levels is a small table,
checkpointed.  The interpolation matches ``percentile`` / DuckDB ``quantile_cont``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketlake.session import materialize

BUCKETS = 4096
MAX_LOCAL = 100_000

_NAN, _INF = float("nan"), float("inf")


def exact_quantiles(df: DataFrame, value_col: str, groups: Sequence[str], probs: Sequence[float], *,
                    buckets: int = BUCKETS, max_local: int = MAX_LOCAL) -> DataFrame:
    """(groups..., q0, q1, ... in the order of ``probs``) with linearly interpolated exact
    quantiles.  Nulls are ignored, a null group key is a group, NaN is the largest value
    (a quantile that touches one is NaN)."""
    # one struct key: equal structs match although a field is null, and no group at all
    # is one constant key, so every join below stays an equi join
    key = F.struct(*groups) if groups else F.struct(F.lit(0).alias("_all"))
    base = df.select(key.alias("_g"), F.col(value_col).cast("double").alias("_v")).where("_v is not null")
    finite = ~F.isnan("_v") & (F.abs(F.col("_v")) != _INF)
    value = F.when(finite, F.col("_v"))
    stats = base.groupBy("_g").agg(
        F.count("*").alias("_n"), F.count_if(F.col("_v") == -_INF).alias("_low"), F.count_if(finite).alias("_fin"),
        F.count_if(F.col("_v") == _INF).alias("_high"), F.min(value).alias("_mn"), F.max(value).alias("_mx"))
    want = stats.select("*", F.inline(F.array(*[
        F.struct(F.lit(i).alias("_qi"), (F.lit(float(p)) * (F.col("_n") - 1)).alias("_pos")) for i, p in enumerate(probs)])))
    want = materialize(want.withColumns({
        "_r0": F.floor("_pos").cast("long"), "_r1": F.least(F.floor("_pos") + 1, F.col("_n") - 1).cast("long")}))

    ranks = want.select("_g", "_low", "_fin", "_high", "_mn", "_mx", F.explode(F.array("_r0", "_r1")).alias("_r")).distinct()
    special = (F.when(F.col("_r") < F.col("_low"), F.lit(-_INF))
               .when(F.col("_r") < F.col("_low") + F.col("_fin"), F.when(F.col("_mn") == F.col("_mx"), F.col("_mn")))
               .when(F.col("_r") < F.col("_low") + F.col("_fin") + F.col("_high"), F.lit(_INF)).otherwise(F.lit(_NAN)))
    state = materialize(ranks.select(
        "_g", "_r", F.col("_mn").alias("_lo"), F.col("_mx").alias("_hi"), F.col("_low").cast("long").alias("_before"), special.alias("_val")))
    base = base.where(finite)
    while True:
        still = state.where("_val is null")
        if still.isEmpty():
            break
        state = materialize(state.where("_val is not null").unionByName(_shrink(base, still, buckets, max_local)))
    vals = state.select("_g", "_r", "_val")
    v0 = vals.select("_g", F.col("_r").alias("_r0"), F.col("_val").alias("_v0"))
    v1 = vals.select("_g", F.col("_r").alias("_r1"), F.col("_val").alias("_v1"))
    part = F.col("_pos") - F.col("_r0")
    # a whole rank takes the value itself: inf - inf must not make a NaN of it
    q = want.join(v0, ["_g", "_r0"]).join(v1, ["_g", "_r1"]).select("_g", "_qi", F.when(
        (part == 0) | (F.col("_v0") == F.col("_v1")), F.col("_v0")).otherwise(
        F.col("_v0") + part * (F.col("_v1") - F.col("_v0"))).alias("_q"))
    out = q.groupBy("_g").pivot("_qi", list(range(len(probs)))).agg(F.first("_q"))
    return out.select(*[F.col("_g")[c].alias(c) for c in groups], *[F.col(str(i)).alias(f"q{i}") for i in range(len(probs))])


def _scale(c: str) -> Column:
    """A monotone logarithmic image of all finite doubles in about -1,456 .. 1,456."""
    return F.when(F.col(c) == 0, F.lit(0.0)).otherwise(F.signum(c) * (F.log(F.abs(F.col(c))) + 746))


def _shrink(base: DataFrame, still: DataFrame, buckets: int, max_local: int) -> DataFrame:
    """One level: the open ranks with smaller intervals, or answered."""
    interval = ["_g", "_lo", "_hi", "_before"]
    rows = base.join(still.select(*interval).distinct(), "_g").where("_v between _lo and _hi")
    span = _scale("_hi") - _scale("_lo")
    place = F.when(span > 1, (_scale("_v") - _scale("_lo")) / span).otherwise(
        (F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    bucket = F.least(F.floor(place * buckets), F.lit(buckets - 1)).cast("int")
    per = rows.groupBy(*interval, bucket.alias("_b")).agg(
        F.count("*").alias("_c"), F.min("_v").alias("_bmin"), F.max("_v").alias("_bmax"))
    running = Window.partitionBy(*interval).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per = per.withColumn("_from", F.col("_before") + F.sum("_c").over(running) - F.col("_c"))
    hit = still.select("_r", *interval).join(per, interval).where("_from <= _r and _r < _from + _c").select(
        "_g", "_r", F.col("_bmin").alias("_lo"), F.col("_bmax").alias("_hi"), F.col("_from").alias("_before"), "_c")
    hit = materialize(hit)
    done = hit.where("_lo = _hi").withColumn("_val", F.col("_lo"))
    few = hit.where((F.col("_lo") < F.col("_hi")) & (F.col("_c") <= max_local))
    numbered = (
        base.join(few.select(*interval).distinct(), "_g").where("_v between _lo and _hi")
        .withColumn("_k", F.col("_before") + F.row_number().over(Window.partitionBy(*interval).orderBy("_v")) - 1))
    ranked = few.join(numbered.select(*interval, F.col("_k").alias("_r"), F.col("_v").alias("_val")), [*interval, "_r"])
    rest = hit.where((F.col("_lo") < F.col("_hi")) & (F.col("_c") > max_local)).withColumn("_val", F.lit(None).cast("double"))
    columns = ["_g", "_r", "_lo", "_hi", "_before", "_val"]
    out = materialize(done.select(*columns).unionByName(ranked.select(*columns)).unionByName(rest.select(*columns)))
    if out.count() != still.count():
        raise RuntimeError("a rank was lost while its interval shrank")
    return out
