"""Filling fixed-capacity containers: sum-of-squares online packing over a level array."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askloom.session import cut


def sum_of_squares(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Window number of each item, in order. Every item fits (0 <= size <= capacity).

    level[h] is the number of open windows filled to h. An item of size s goes to the level h, or to a new window,
    that makes the sum of level**2 over partly filled levels smallest; among equals to the fullest. Closing a
    window takes it out of the sum. Items of size 0 go to window 0.
    """
    level = np.zeros(capacity + 1, dtype=np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    out, made, never = np.zeros(len(sizes), dtype=np.int64), 0, np.iinfo(np.int64).max
    for k, s in enumerate(sizes.tolist()):
        if s == 0:
            made = max(made, 1) if made else made
            continue
        best, at = (2 * level[s] + 1 if s < capacity else 0), 0
        if s < capacity:
            have = level[1 : capacity - s + 1]
            cost = np.where(have > 0, 2 * (level[1 + s : capacity + 1] - have) + 2, never)
            if have[-1] > 0:
                cost[-1] = 1 - 2 * have[-1]
            h = capacity - s - int(np.argmin(cost[::-1]))
            if cost[h - 1] <= best:
                at = h
        if at:
            w = open_at[at].pop()
            level[at] -= 1
        else:
            w, made = made, made + 1
        out[k] = w
        if at + s < capacity:
            level[at + s] += 1
            open_at[at + s].append(w)
    return out


def pack(sizes: DataFrame, key: str, size: str, capacities: dict[int, int], windows_per_shard: int = 4096) -> DataFrame:
    """(plan_id, window_id, id, piece, tokens): every item of `sizes` in windows of every plan's capacity.

    An item stays whole unless it exceeds the capacity; then it is cut into full pieces, each a window of its own,
    and a last piece which is packed like an item; pieces count from 0. Null sizes count as 0, negative ones too;
    items of size 0 lie in a window of their shard. Rows with a null key leave; equal keys are separate items. An
    empty table or no plan gives an empty result; other columns are not read. Windows never exceed their capacity.

    Items are dealt to shards by hash, enough that a shard fills about `windows_per_shard` windows, and each shard is
    packed by itself, online: items come in the order of a hash of their id, whatever their sizes, and none is moved
    later. At most a few windows of a shard stay half empty, a fixed small part. A shard's rows are numbers only and
    bounded, so no task grows with the input. `capacities` (plan -> capacity) is configuration.
    """
    items = sizes.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.greatest(F.lit(0), F.coalesce(F.col(size).cast("long"), F.lit(0))).alias("n"))
    items = cut(items)
    total, count = items.agg(F.sum("n"), F.count("*")).first()
    kind = dict(items.dtypes)["id"]
    schema = f"plan_id int, window_id long, id {kind}, piece int, tokens long"
    if not capacities:
        return items.sparkSession.createDataFrame([], schema)
    plans = F.array(
        *[
            F.struct(
                F.lit(int(p)).alias("plan_id"),
                F.lit(int(c)).alias("capacity"),
                F.lit(max(1, -(-int(total or 0) // (int(c) * windows_per_shard)), -(-int(count) // 1_000_000))).alias("shards"),
            )
            for p, c in capacities.items()
        ]
    )
    dealt = items.select("id", "n", F.explode(plans).alias("p")).select("id", "n", "p.*")
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("id"), F.col("shards")).cast("int")).withColumn("turn", F.xxhash64(F.lit(1), "id"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["turn", "id"], kind="stable")
        c, plan, shard = int(pdf["capacity"].iloc[0]), int(pdf["plan_id"].iloc[0]), int(pdf["shard"].iloc[0])
        n = pdf["n"].to_numpy()
        full = np.where(n > c, (n - 1) // c, 0)  # full pieces that are split off
        window = sum_of_squares(n - full * c, c)
        parts = [pd.DataFrame({"id": pdf["id"].to_numpy(), "piece": full, "tokens": n - full * c, "window_id": window})]
        if full.any():
            at = np.repeat(np.arange(len(n)), full)
            piece = np.arange(len(at)) - np.repeat(np.cumsum(full) - full, full)
            parts.append(pd.DataFrame({"id": pdf["id"].to_numpy()[at], "piece": piece, "tokens": c, "window_id": window.max() + 1 + np.arange(len(at))}))
        out = pd.concat(parts, ignore_index=True)
        out["plan_id"], out["window_id"] = plan, out["window_id"] + (shard << 32)
        return out[["plan_id", "window_id", "id", "piece", "tokens"]]

    return dealt.groupBy("plan_id", "capacity", "shard").applyInPandas(run, schema)
