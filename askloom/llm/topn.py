"""Top N items within every group by simultaneous bisection of per-group cutoffs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, IntegralType, NullType

from askloom.session import cut


def _meet(rows: DataFrame, groups: DataFrame, hot_rows: float) -> DataFrame:
    """rows join groups on g. Groups of more than `hot_rows` rows are few (all rows / hot_rows) and go by broadcast."""
    hot = groups.where(F.col("size") > hot_rows)
    cold = rows.join(F.broadcast(hot.select("g")), "g", "left_anti").join(groups.where(F.col("size") <= hot_rows), "g")
    return rows.join(F.broadcast(hot), "g").unionByName(cold)


def _bisect(rows: DataFrame, groups: DataFrame, bits: int, hot_rows: float) -> DataFrame:
    """Per group the `need`-th largest code, as (g, cutoff, above); `above` rows have larger codes.

    rows: (g, code, w), w rows carry that code. groups: (g, size, need, lo, hi) with at least `need` rows each.
    All groups are bisected at once: a round adds up w per group and interval, 2**bits intervals between a group's
    bounds, and goes on in the interval that holds the need-th row. bits=1 is plain halving.
    """
    ways = 1 << bits
    state = groups.withColumn("above", F.lit(0).cast("long"))
    found = None
    while True:
        state = cut(state)
        ended = state.where("lo = hi").select("g", F.col("lo").alias("cutoff"), "above")
        found = ended if found is None else found.unionByName(ended)
        active = state.where("lo < hi")
        if active.isEmpty():
            return found
        counted = (
            _meet(rows, active, hot_rows)
            .where("code between lo and hi")
            .withColumn("cell", F.expr(f"(code - lo) div ((hi - lo) div {ways} + 1)"))
            .groupBy("g", "size", "need", "lo", "hi", "above", "cell")
            .agg(F.sum("w").alias("w"))
        )
        # at most 2**bits cells come together for a group, however many rows it has
        cells = counted.groupBy("g", "size", "need", "lo", "hi", "above").agg(
            F.sort_array(F.collect_list(F.struct((-F.col("cell")).alias("k"), F.col("w").alias("w")))).alias("cells")
        )
        here = F.struct(F.col("above").alias("above"), F.lit(None).cast("long").alias("cell"))
        walked = F.aggregate(
            "cells",
            here,
            lambda s, c: F.when(s["cell"].isNotNull(), s)
            .when(s["above"] + c["w"] >= F.col("need"), F.struct(s["above"].alias("above"), (-c["k"]).alias("cell")))
            .otherwise(F.struct((s["above"] + c["w"]).alias("above"), s["cell"].alias("cell"))),
        )
        step = F.expr(f"(hi - lo) div {ways} + 1")
        start = F.col("lo") + F.col("s.cell") * step
        state = cells.withColumn("s", walked).select(
            "g", "size", "need", start.alias("lo"), F.least("hi", start + step - 1).alias("hi"), F.col("s.above").alias("above")
        )


def top_n(df: DataFrame, group: str, score: str, ident: str, n: int, bits: int = 8, hot_share: float = 0.001) -> DataFrame:
    """(group_key, item_id, score): the `n` rows of highest `score` in every group.

    `score` is of an integer type or a decimal of at most 18 digits; a floating type raises TypeError, since its codes
    would lose fractions: cast it to a decimal. Ties go to the smaller `ident` (an integer); a null score ranks below
    every other. Rows with a null group or
    ident leave, equal (group, score, ident) rows count once, groups of at most n rows come out whole, an empty
    table gives an empty result; columns other than the three named are not read.

    No group is ever sorted or gathered. Cutoffs on the order-preserving code (score, then ident reversed) are
    bisected for all groups at once from counts that every partition adds up before the shuffle: first over
    (group, score) counts, then by ident among the rows tied at a cutoff. Groups with more than `hot_share` of all
    rows, of which there are at most 1/hot_share, meet their cutoffs by broadcast.
    """
    kind = df.select(F.col(score).alias("s")).schema["s"].dataType
    digits = kind.scale if isinstance(kind, DecimalType) else 0
    if not isinstance(kind, (IntegralType, DecimalType, NullType)) or (digits and kind.precision > 18):
        raise TypeError(f"{score} is {kind.simpleString()}, not an integer or a decimal of at most 18 digits")
    code = (F.col(score) * F.lit(10**digits)).cast("long") if digits else F.col(score).cast("long")
    rows = df.select(F.col(group).alias("g"), F.col(ident).cast("long").alias("i"), code.alias("s"))
    rows = cut(rows.where("g is not null and i is not null").dropDuplicates(["g", "s", "i"]))
    total, least = rows.agg(F.count("*"), F.min("s")).first()
    hot_rows = max(1.0, total * hot_share)
    null_code = (0 if least is None else least) - 1
    coded = rows.select("g", "i", F.coalesce("s", F.lit(null_code)).alias("code"))

    by_score = cut(coded.groupBy("g", "code").agg(F.count("*").alias("w")))
    groups = by_score.groupBy("g").agg(F.sum("w").alias("size"), F.min("code").alias("lo"), F.max("code").alias("hi"))
    groups = cut(groups)
    large = groups.where(F.col("size") > n).withColumn("need", F.lit(n).cast("long"))
    scores = _bisect(by_score, large, bits, hot_rows)

    tied = by_score.withColumnRenamed("code", "cutoff").join(scores, ["g", "cutoff"]).withColumn("need", n - F.col("above"))
    tied = cut(tied.join(groups.select("g", "size"), "g"))
    open_ = tied.where(F.col("w") > F.col("need"))
    ties = _meet(coded, open_.select("g", "size", "cutoff"), hot_rows).where("code = cutoff").select("g", (-F.col("i")).alias("code"), F.lit(1).cast("long").alias("w"))
    ties = cut(ties)
    bounds = ties.groupBy("g").agg(F.min("code").alias("lo"), F.max("code").alias("hi")).join(open_.select("g", "size", "need"), "g")
    idents = _bisect(ties, bounds, bits, hot_rows).select("g", (-F.col("cutoff")).alias("last"))

    limits = tied.select("g", "size", "cutoff").join(idents, "g", "left")
    whole = groups.where(F.col("size") <= n).select("g", "size", F.col("lo").alias("cutoff"), F.lit(None).cast("long").alias("last"))
    limits = cut(limits.unionByName(whole))
    kept = _meet(coded, limits, hot_rows).where("code > cutoff or (code = cutoff and (last is null or i <= last))")
    value = F.when(F.col("code") != null_code, F.col("code"))
    return kept.select(F.col("g").alias("group_key"), F.col("i").alias("item_id"), (value / F.lit(10**digits)).cast(kind).alias("score") if digits else value.alias("score"))
