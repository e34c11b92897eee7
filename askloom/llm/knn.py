"""Most similar vectors for every vector: randomly rotated one-bit codes with error bounds, then reranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from askloom.session import cut


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix; made once and sent, since libraries may differ in the last digit."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def encode(unit: np.ndarray, rot: np.ndarray) -> np.ndarray:
    """Bytes of unit vectors, a row each: packed sign bits, the rotated vector in 8-bit levels for its part as query,
    and two float scalars: the factor <vector, sign code>, which corrects the estimate <o, q> ~ <code, q> / factor,
    and the scale of the levels."""
    r = unit @ rot
    bits = r > 0
    factor = np.abs(r).sum(1) / np.sqrt(r.shape[1])
    scale = np.maximum(np.abs(r).max(1, keepdims=True), 1e-12)
    levels = np.round(r / scale * 127).astype(np.int8)
    scalars = np.ascontiguousarray(np.stack([factor, scale[:, 0]], 1).astype(np.float32))
    return np.concatenate([np.packbits(bits, axis=1), levels.view(np.uint8), scalars.view(np.uint8)], axis=1)


def train_lists(sample: np.ndarray, lists: int, rounds: int, seed: int) -> np.ndarray:
    """Unit centroids of spherical k-means on the sample; empty lists start again from a random member."""
    rng = np.random.default_rng(seed)
    centre = sample[rng.permutation(len(sample))[:lists]].copy()
    for _ in range(rounds):
        near = np.concatenate([np.argmax(sample[i : i + 4096] @ centre.T, 1) for i in range(0, len(sample), 4096)])
        total = np.zeros_like(centre)
        np.add.at(total, near, sample)
        norm = np.linalg.norm(total, axis=1)
        gone = norm < 1e-9
        total[gone] = sample[rng.integers(0, len(sample), gone.sum())]
        centre = total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-12)
    return centre.astype(np.float32)


def _candidates(raw: np.ndarray, ids: np.ndarray, data: np.ndarray, query: np.ndarray, dim: int, k: int, floor: float, epsilon: float) -> np.ndarray:
    """Distinct (smaller id, larger id) pairs of a query and a data row which may be among the query's k best.

    raw: one row of bytes per vector: sign bits, query levels, scalars. The estimate's error is at most
    epsilon * sqrt((1 - f^2) / f^2 / (dim - 1)) but for rare cases, f the data vector's factor. A pair stays if its
    upper bound reaches both `floor` and the k-th best lower bound of its query among these data.
    """
    width = -(-dim // 8)
    scalar = np.ascontiguousarray(raw[:, width + dim :]).view(np.float32)
    signs = (np.unpackbits(raw[data, :width], axis=1, count=dim).astype(np.float32) * 2 - 1) / np.sqrt(dim)
    levels = raw[query, width : width + dim].view(np.int8).astype(np.float32) * (scalar[query, 1:2] / 127)
    f = scalar[data, 0]
    error = epsilon * np.sqrt(np.maximum(1 - f * f, 0) / np.maximum(f * f, 1e-9) / max(dim - 1, 1)) + 1e-3
    found = [np.zeros((0, 2), ids.dtype)]
    for i in range(0, len(query), 1024):
        own = ids[query[i : i + 1024]]
        est = (levels[i : i + 1024] @ signs.T) / f
        est[own[:, None] == ids[data][None, :]] = -9
        limit = np.full(len(est), floor, np.float32)
        if len(data) > k:
            limit = np.maximum(limit, np.partition(est - error, -k, axis=1)[:, -k])
        a, b = np.nonzero(est + error >= limit[:, None])
        pair = np.stack([own[a], ids[data[b]]], 1)
        found.append(np.sort(pair[pair[:, 0] != pair[:, 1]], axis=1))
    return np.unique(np.concatenate(found), axis=0)


def _decoded(raw: np.ndarray, dim: int) -> np.ndarray:
    """The rotated unit vectors that codes hold in 8-bit levels."""
    width = -(-dim // 8)
    scale = np.ascontiguousarray(raw[:, width + dim :]).view(np.float32)[:, 1:2]
    return raw[:, width : width + dim].view(np.int8).astype(np.float32) * (scale / 127)


def _bytes(col: pa.Array | pa.ChunkedArray, rows: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(rows, -1)


def _split(filed: DataFrame, dim: int, largest: int, parts: int, twice: int, sample_per_list: int, seed: int, most_sent: int = 100_000) -> DataFrame:
    """(list, id, code) with lists above `largest` rows split by k-means of their own, again and again.

    A list becomes at most `parts` lists of about an eighth of `largest`; a row goes to the `twice` nearest of them.
    Centroids are fitted on about sample_per_list rows a part, which every list draws by hash, in a task for each list;
    rows meet them in shards, so no task grows with a list. What no longer falls apart is left as it is.
    """
    before = None
    while True:
        counts = cut(filed.groupBy("list").agg(F.count("*").alias("n")).where(F.col("n") > largest))
        many, top = counts.agg(F.count("*"), F.max("n")).first()
        if not many or (before is not None and top > 0.8 * before):
            return filed
        before = top
        big = counts.withColumn("parts", F.least(F.lit(parts), F.ceil(F.col("n") * 8 / largest)).cast("int"))
        joined = filed.join(F.broadcast(big) if many <= most_sent else big, "list", "left")
        rows, rest = joined.where("parts is not null"), joined.where("parts is null").select("list", "id", "code")
        drawn = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) * F.col("n") < F.col("parts") * F.lit(sample_per_list * (1 << 30))

        def train(t: pa.Table) -> pa.Table:
            sample = _decoded(_bytes(t["code"], len(t)), dim)
            centre = train_lists(sample, min(t["parts"][0].as_py(), len(sample)), 5, seed)
            return pa.table({"list": t["list"].slice(0, 1), "centre": pa.array([centre.tobytes()], pa.binary())})

        def assign(t: pa.Table, c: pa.Table) -> pa.Table:
            name = t["list"].slice(0, 0)
            if not len(t) or not len(c):
                return pa.table({"list": name, "id": t["id"].slice(0, 0) if len(t) else name, "code": pa.array([], pa.binary())})
            centre = np.frombuffer(c["centre"][0].as_py(), np.float32).reshape(-1, dim)
            near = min(twice, len(centre))
            at = np.argpartition(-(_decoded(_bytes(t["code"], len(t)), dim) @ centre.T), near - 1, axis=1)[:, :near]
            take = pa.array(np.repeat(np.arange(len(t)), near))
            base = (t["list"][0].as_py() + 1) * parts
            return pa.table({"list": base + at.ravel().astype(np.int64), "id": t["id"].take(take), "code": t["code"].take(take)})

        centres = cut(rows.where(drawn).select("list", "parts", "code").groupBy("list").applyInArrow(train, "list long, centre binary"))
        shards = F.ceil(F.col("n") / largest).cast("int")
        dealt = rows.select("list", F.pmod(F.xxhash64("id", F.lit(seed + 1)), shards).cast("int").alias("shard"), "id", "code")
        sent = centres.join(big, "list").select("list", F.explode(F.sequence(F.lit(0), shards - 1)).alias("shard"), "centre")
        split = dealt.groupBy("list", "shard").cogroup(sent.groupBy("list", "shard")).applyInArrow(assign, "list long, id long, code binary")
        filed = cut(rest.unionByName(split))


def most_similar(
    df: DataFrame,
    key: str,
    vector: str,
    k: int = 5,
    floor: float = -1.0,
    dim: int | None = None,
    per_list: int = 256,
    most_lists: int = 8192,
    sample_per_list: int = 16,
    spread: int = 8,
    epsilon: float = 2.4,
    tile: int = 8192,
    largest: int = 65_536,
    seed: int = 11,
) -> DataFrame:
    """(id, other, sim): for every usable vector its k most similar others, similarity at least `floor`.

    Similarity is the cosine in double precision, rounded to 6 decimals; equal ones by smaller id. Null, empty,
    all-zero and non-finite vectors, vectors with null entries or entries of 1e150 and more, whose squares overflow, and
    vectors of another length than `dim` (by default the most common length) take no part, nor do rows with a null key; keys are unique. Fewer than k others at
    `floor` give fewer rows; an empty table gives none. Other columns are not read.

    Equal vectors are one class: the search runs over classes, and members get their class's rows, so a value that
    fills a third of the table costs one vector. Each class is filed in its `spread` nearest of about n/per_list
    lists (k-means on at most sample_per_list * lists vectors, lists at most `most_lists`: a bounded sample; all vectors
    are filed). Lists above `largest` rows, as beyond most_lists * largest / spread vectors all are, are split by k-means
    of their own until they are below it (see _split), so that the work grows with the number of vectors. Inside a list one-bit codes of randomly rotated vectors give estimates and error bounds; only
    pairs which may be among the k best are reranked with exact cosines. Lists above `tile` rows are compared in
    blocks, every row against every block, by several tasks.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).where("id is not null and v is not null")
    if dim is None:
        sizes = rows.where(F.size("v") > 0).groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
        dim = sizes["d"] if sizes else 1
    usable = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e150)) & F.exists("v", lambda x: x != 0)
    rows = rows.where((F.size("v") == dim) & usable)
    same = [F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(seed), "v").alias("h2")]
    members = cut(rows.select("id", *same))
    counts = members.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("members"))
    members = cut(members.join(counts.where("members > 1"), ["h1", "h2"], "left").select("id", F.coalesce("rep", "id").alias("rep"), F.coalesce("members", F.lit(1)).alias("members")))
    classes = cut(rows.join(members.where("id = rep").select("id"), "id").withColumnRenamed("id", "rep"))
    n = classes.count()
    if n == 0:
        return spark.createDataFrame([], "id long, other long, sim double")
    lists = int(min(most_lists, max(1, n // per_list)))
    want = min(n, max(2048, lists * sample_per_list))
    sample = classes.orderBy(F.xxhash64("rep", F.lit(seed)), "rep").limit(want).select("v").toPandas()["v"]
    unit = np.array(sample.tolist(), dtype=np.float64)
    unit = (unit / np.linalg.norm(unit, axis=1, keepdims=True)).astype(np.float32)
    shared = spark.sparkContext.broadcast((train_lists(unit, lists, 6, seed), rotation(dim, seed)))
    spread = min(spread, lists)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, rot = shared.value
        for batch in batches:
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            if not len(v):
                continue
            u = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
            blob = encode(u, rot)
            near = np.argpartition(-(u @ c.T), spread - 1, axis=1)[:, :spread]
            take = pa.array(np.repeat(np.arange(len(u)), spread))
            packed = pa.array([b.tobytes() for b in blob], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int64)), batch.column(0).take(take), packed.take(take)], ["list", "id", "code"])

    filed = cut(classes.select("rep", "v").mapInArrow(file, "list long, id long, code binary"))
    filed = _split(filed, dim, largest, 1024, 2, sample_per_list, seed)
    large = cut(filed.groupBy("list").count().where(F.col("count") > tile).select("list", F.ceil(F.col("count") / tile).cast("int").alias("blocks")))
    placed = filed.join(F.broadcast(large) if large.count() <= 100_000 else large, "list", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    # as data a row of a large list stays in its block, as query it meets every (block, own block) of the list
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    data = placed.select("list", own.alias("block"), F.explode(every).alias("from"), "id", "code", F.lit(True).alias("is_data"))
    query = placed.where("blocks > 1").select("list", F.explode(every).alias("block"), own.alias("from"), "id", "code", F.lit(False).alias("is_data"))

    def compare(group: pa.Table) -> pa.Table:
        ids, is_data = group.column("id").to_numpy(), group.column("is_data").to_numpy()
        raw = np.frombuffer(b"".join(group.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
        of_data, of_query = np.flatnonzero(is_data), np.flatnonzero(~is_data)
        if not len(of_query):
            of_query = of_data
        pairs = _candidates(raw, ids, of_data, of_query, dim, k, floor, epsilon)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    pairs = data.unionByName(query).groupBy("list", "block", "from").applyInArrow(compare, "a long, b long").distinct()
    one = pairs.join(classes.select(F.col("rep").alias("a"), F.col("v").alias("va")), "a")
    both = one.join(classes.select(F.col("rep").alias("b"), F.col("v").alias("vb")), "b").select("a", "b", "va", "vb")

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim) for c in (2, 3))
            dot = np.einsum("ij,ij->i", x, y) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.round(dot, 6), pa.float64())], ["a", "b", "sim"])

    sims = cut(both.mapInArrow(rerank, "a long, b long, sim double").where(F.col("sim") >= floor))
    return _members_too(members, sims, k, floor)


def _members_too(members: DataFrame, sims: DataFrame, k: int, floor: float) -> DataFrame:
    """From links of class representatives to the k best of every member. A class's k + 1 smallest ids stand for it:
    no member needs more of them. Window group limits cut each class down before rows move."""
    by_id = Window.partitionBy("rep").orderBy("id")
    heads = members.where("members > 1").withColumn("at", F.row_number().over(by_id)).where(F.col("at") <= k + 1).select("rep", "id")
    heads = cut(heads.unionByName(members.where("members = 1").select("rep", "id")))
    links = sims.select(F.col("a").alias("rep"), F.col("b").alias("to"), "sim").unionByName(sims.select(F.col("b").alias("rep"), F.col("a").alias("to"), "sim"))
    links = links.withColumn("at", F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("sim"), "to"))).where(F.col("at") <= k + 1)
    others = links.join(heads.select(F.col("rep").alias("to"), F.col("id").alias("other")), "to").select("rep", "other", "sim")
    twins = members.where("members > 1 and id = rep").select("rep").join(heads, "rep").select("rep", F.col("id").alias("other"), F.lit(1.0).alias("sim"))
    best = others.unionByName(twins.where(F.lit(1.0) >= floor))
    best = best.withColumn("at", F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("sim"), "other"))).where(F.col("at") <= k + 1)
    best = cut(best.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct((-F.col("sim")).alias("neg"), "other"))).alias("best")))
    # at most 10,000 classes are large; their short lists go to the members, not the other way round
    hot = max(10_000, members.count() // 10_000)
    large = F.broadcast(members.where((F.col("members") > hot) & (F.col("id") == F.col("rep"))).select("rep").join(best, "rep"))
    got = members.where(F.col("members") > hot).join(large, "rep").unionByName(members.where(F.col("members") <= hot).join(best, "rep"))
    mine = F.slice(F.filter("best", lambda x: x["other"] != F.col("id")), 1, k)
    return got.select("id", F.explode(mine).alias("x")).select("id", F.col("x.other").alias("other"), (-F.col("x.neg")).alias("sim"))
