"""Mixing sources to target weights: pivotal dependent rounding of fractional copies."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askloom.session import cut

_ROW = "id long, source string, tokens long, copies long, fraction double, node long"
_COLUMNS = ["id", "source", "tokens", "copies", "fraction", "node"]


def _draws(ids, seed: int):
    """One number in [0, 1) for each id, from a 64-bit finalizer on id and seed."""
    x = np.asarray(ids, dtype=np.int64).view(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)


def _pivot(rows: Iterable[tuple]) -> Iterator[tuple]:
    """Rows (id, source, tokens, copies, fraction, draw) of any sources, out without the draw; all leave integral
    (fraction None) but one at most per source. Two fractions trade mass so that the tokens they stand for stay the
    same in sum, and so that each keeps its value on average, until one of them is 0 or 1."""
    held: dict = {}
    for ident, source, size, copies, p, draw in rows:
        if p is None or p != p:
            yield ident, source, size, copies, None
            continue
        other = held.pop(source, None)
        if other is None:
            held[source] = (ident, source, size, copies, p)
            continue
        _, _, size2, copies2, p2 = other
        up, down = min(size * (1 - p), size2 * p2), min(size * p, size2 * (1 - p2))
        shift = up if draw * (up + down) < down else -down
        p, p2 = p + shift / size, p2 - shift / size2
        left = None
        for i, n, c, f in ((ident, size, copies, p), (other[0], size2, copies2, p2)):
            if f < 1e-9:
                yield i, source, n, c, None
            elif f > 1 - 1e-9:
                yield i, source, n, c + 1, None
            else:
                left = (i, source, n, c, f)
        if left is not None:
            held[source] = left
    yield from held.values()


def _rounded(rows: DataFrame, rate: dict[str, float], seed: int, fan_in: int) -> DataFrame:
    """(id, source, tokens, copies) with copies > 0: every source's records rounded from rate[source] copies each."""

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        node = TaskContext.get().partitionId()

        def stream():
            for b in batches:
                r = b["source"].map(rate).fillna(0.0).to_numpy(float)
                whole = np.floor(r + 1e-9)
                f = r - whole
                draws = _draws(b["id"], seed)
                for i, s, n, c, p, d in zip(b["id"].tolist(), b["source"].tolist(), b["tokens"].tolist(), whole.astype(int).tolist(), f.tolist(), draws.tolist()):
                    yield i, s, n, c, p if p > 1e-9 else None, d

        rounded = _pivot(stream())
        while chunk := list(islice(rounded, 20_000)):
            yield pd.DataFrame([(*row, node) for row in chunk], columns=_COLUMNS)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tokens", "id"], ascending=[False, True])
        node = int(pdf["node"].iloc[0]) // fan_in
        pdf["node"] = _draws(pdf["id"], seed + 1 + node)
        return pd.DataFrame([(*r, node) for r in _pivot(pdf[_COLUMNS].itertuples(index=False, name=None))], columns=_COLUMNS)

    state = cut(rows.mapInPandas(first, _ROW))
    done, nodes = state.where("fraction is null"), rows.rdd.getNumPartitions()
    rest = state.where("fraction is not null")
    while nodes > 1:  # one left-over per node and source
        state = cut(rest.groupBy("source", F.expr(f"node div {fan_in}")).applyInPandas(merge, _ROW))
        done, rest = done.unionByName(state.where("fraction is null")), state.where("fraction is not null")
        nodes = -(-nodes // fan_in)
    coin = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_003)) / 1_000_003.0
    rest = rest.withColumn("copies", F.col("copies") + (coin < F.col("fraction")).cast("long"))
    return done.unionByName(rest).where("copies > 0").select("id", "source", "tokens", "copies")


def _cuts(mass: dict[int, int], swing: float, enough: float) -> list[int]:
    """Sizes at which a source's records are split into levels, falling. mass[k]: tokens of records of 2**k to 2**(k+1).

    The last left-over of a level is a toss that may miss by one record's size. Records below a cut make up for it, so
    their tokens times `swing`, how far their rate can move, should hold at least half of that; the cut is the lowest
    one that does, or a quarter of the size where none does. No level is needed below a possible miss of `enough`."""
    miss, cuts = 2 << max(mass), []
    while miss > enough:
        below = {k: sum(n for j, n in mass.items() if j < k) for k in range(1, miss.bit_length() - 1)}
        fit = [k for k, n in below.items() if 2 * swing * n >= miss] or [k for k, n in below.items() if n and 4 << k >= miss]
        if not fit:
            break
        miss = 1 << fit[0]
        cuts.append(miss)
    return cuts


def mix(
    df: DataFrame,
    key: str,
    source: str,
    size: str,
    targets: dict[str, tuple[float, int]],
    total: float | None = None,
    seed: int = 7,
    fan_in: int = 64,
    tolerance: float = 1e-5,
) -> tuple[DataFrame, DataFrame]:
    """((id, source, tokens, copies) of all used rows, (source, target_share, planned_tokens, tokens, actual_share,
    records, most_copies) of all targets).

    targets: source -> (share, most copies of one record). Sources compare trimmed and in lower case. Without `total`
    the mix is the largest in which every source that has any tokens reaches its share within its cap; with `total`,
    a source gets its share of that total or, if it is too small, all its copies. A source without records gets
    nothing and says so in actual_share; the others keep their proportions. Null, unlisted sources and records
    without tokens are not used. Records with a null key leave; an empty table gives no rows and shares of 0.

    A source's records each get planned/available copies: the whole part to all, the fraction rounded by pivotal
    sampling that keeps the source's tokens: first inside every partition in one pass, larger records first, then the
    one left-over per partition and source up a reduction tree of `fan_in`. The last left-over of a source is a coin
    toss of one record's size. Where that is more than `tolerance` of the source's plan, its small records are rounded
    after the large ones and make up for the toss (see _cuts); at scale no record is that large and one pass does all.
    The driver gets one row per source, level and power of two of sizes.
    """
    name = F.lower(F.trim(F.col(source)))
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), name.alias("source"), F.col(size).cast("long").alias("tokens"))
    rows = cut(rows.where(F.col("source").isin(*targets) & (F.col("tokens") > 0)).sortWithinPartitions("source", F.desc("tokens"), "id"))
    sizes = rows.groupBy("source", F.floor(F.log2("tokens") + 1e-9).cast("int").alias("k")).agg(F.sum("tokens").alias("n")).collect()
    mass = {s: {r["k"]: r["n"] for r in sizes if r["source"] == s} for s in targets}
    have = {s: sum(m.values()) for s, m in mass.items()}
    room = {s: have[s] * cap for s, (share, cap) in targets.items()}
    present = [s for s, (share, cap) in targets.items() if share > 0 and room[s] > 0]
    if total is None:
        total = min((room[s] / targets[s][0] for s in present), default=0.0)
    plan = {s: min(targets[s][0] * total, room[s]) if s in present else 0.0 for s in targets}
    swing = {s: min(plan[s] / have[s], targets[s][1] - plan[s] / have[s]) for s in present}
    cuts = {s: _cuts(mass[s], swing[s], tolerance * plan[s]) for s in present}
    level = F.coalesce(*[F.when(F.col("source") == s, sum((F.col("tokens") < x).cast("int") for x in c)) for s, c in cuts.items() if c], F.lit(0))
    rows = rows.withColumn("level", level)
    split = {(r["source"], r["level"]): r["n"] for r in rows.groupBy("source", "level").agg(F.sum("tokens").alias("n")).collect()}

    used, reached = None, dict.fromkeys(targets, 0)
    for level in sorted({k for _, k in split}):
        rest = {s: sum(n for (t, k), n in split.items() if t == s and k >= level) for s in present}
        rate = {s: min(max((plan[s] - reached[s]) / n, 0.0), float(targets[s][1])) for s, n in rest.items() if n}
        got = cut(_rounded(rows.where(F.col("level") == level).drop("level"), rate, seed, fan_in))
        for r in got.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("n")).collect():
            reached[r["source"]] += r["n"]
        used = got if used is None else used.unionByName(got)
    if used is None:
        used = df.sparkSession.createDataFrame([], "id long, source string, tokens long, copies long")
    known = df.sparkSession.createDataFrame(
        [(s, float(share), float(plan[s])) for s, (share, _) in targets.items()], "source string, target_share double, planned_tokens double"
    )
    got = used.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("records"), F.max("copies").alias("most_copies"))
    report = known.join(got, "source", "left").na.fill(0, ["tokens", "records", "most_copies"])
    report = report.withColumn("actual_share", F.col("tokens") / F.lit(float(max(sum(reached.values()), 1))))
    return used, report.select("source", "target_share", "planned_tokens", "tokens", "actual_share", "records", "most_copies")
