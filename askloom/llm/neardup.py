"""Near-duplicate records with small edits: a forest of signature trees over token bags.

Each record becomes a bag of words. Records meet in trees, one tree per anchor. Anchors are bands of minwise hashes over
the bag, whose chance to be shared depends on the similarity of two bags alone, not on their order nor on how many
records there are. A tree holds the records of its anchor; nodes carry OR- and AND-combined token bitmaps and ranges of
sizes, and a dual traversal drops node pairs by their maximum possible overlap. What is left is compared exactly.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askloom.session import cut

WORD = re.compile(r"[^\W_]+")
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|</?(?:p|br|hr|a|b|i|u|em|strong|code|pre|kbd|tt|ul|ol|li|h[1-6]|blockquote|div|span|table|tr|td|th|img|sub|sup|del|math|source|syntaxhighlight|nowiki)\b[^<>]*>",
    re.I | re.S,
)
_TARGET = re.compile(r"(?<=\])\([^()\s]*\)|\\href\{[^{}]*\}|\[\[https?://[^|\[\]\s]*\||\[https?://\S+(?=\s[^\]\n]*\])|\{\{mono\|")
_COMMAND = re.compile(r"\\(?:begin|end)\{\w+\*?\}(?:\{\w+\})?|\\(?:textbf|texttt|textit|emph|item|(?:sub)*section)\b\*?|^(?:```|~~~)\w*", re.M)


def visible_words(title: str | None, body: str | None) -> list[str]:
    """Lower-case words of title and visible body: tags, link targets and markup commands go, code stays."""
    body = body or ""
    if body.lstrip()[:4] == "&lt;" and not _TAG.search(body):
        body = html.unescape(body)
    if "<" in body:
        body = _TAG.sub(" ", body)
    if "[" in body or "\\" in body or "{{" in body:
        body = _TARGET.sub(" ", body)
    if "\\" in body or "```" in body or "~~~" in body:
        body = _COMMAND.sub(" ", body)
    if "&" in body:
        body = html.unescape(body)
    return WORD.findall(f"{title or ''}\n{body}".lower())


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_ids(docs: list[list[str]], cache: dict) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, record of every word) of a batch."""
    if len(cache) > 2_000_000:
        cache.clear()
    flat = []
    for words in docs:
        for w in words:
            h = cache.get(w)
            if h is None:
                h = cache[w] = xxhash.xxh64_intdigest(w)
            flat.append(h)
    return np.array(flat, dtype=np.uint64), np.repeat(np.arange(len(docs)), [len(w) for w in docs])


def _rank(doc: np.ndarray) -> np.ndarray:
    """Position within runs of equal values."""
    start = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, int)
    return np.arange(len(doc)) - np.repeat(start, np.diff(np.r_[start, len(doc)]))


def _bags(h, doc, n):
    """Per record of a batch: bag (sorted uint32), size."""
    order = np.lexsort((h, doc))
    hs, ds = h[order], doc[order]
    new = np.r_[True, (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])] if len(hs) else np.zeros(0, bool)
    occurrence = _rank(np.cumsum(new))
    items = (_mix(hs + occurrence.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    order = np.lexsort((items, ds))
    return items[order], np.bincount(doc, minlength=n)


def _bitmaps(items: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
    """Per record of a batch: which of `width` bits its items set."""
    bitmap = np.zeros((len(sizes), width), dtype=bool)
    bitmap[np.repeat(np.arange(len(sizes)), sizes), items % width] = True
    return np.packbits(bitmap, axis=1)


def _width(mean: float) -> int:
    """Bits for bags of `mean` items: the power of two from 4 an item on, so that what two bags of one vocabulary set in
    common by chance stays far below what alike ones share."""
    return min(max(256, 1 << math.ceil(math.log2(max(4 * mean, 1)))), 8192)


def _bands(items: np.ndarray, sizes: np.ndarray, bands: range, rows: int) -> np.ndarray:
    """(records, bands) anchors over bags of at least one item: each joins `rows` minwise hashes, so two bags of
    similarity s share a given one with chance s ** rows."""
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    keys = _mix(np.arange(2 * bands.stop * rows, dtype=np.uint64) + np.uint64(1)).astype(np.uint32)
    out = np.empty((len(sizes), len(bands)), dtype=np.uint64)
    for b in bands:
        anchor = np.full(len(sizes), b + 1, dtype=np.uint64)
        for r in range(b * rows, (b + 1) * rows):
            x = (items ^ keys[2 * r]) * (keys[2 * r + 1] | np.uint32(1))
            x = (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            anchor = _mix(anchor * np.uint64(3) + np.minimum.reduceat(x, starts))
        out[:, b - bands.start] = anchor
    return out.view(np.int64)


def _numbered(bags: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Items of all bags in one sorted array, each under the number of its bag, and the sizes of the bags."""
    sizes = np.array([len(b) // 4 for b in bags])
    return np.repeat(np.arange(len(bags), dtype=np.uint64) << np.uint64(32), sizes) | np.frombuffer(b"".join(bags), np.uint32), sizes


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(axis=1, dtype=np.int32)


def _possible(common, alone_i, alone_j, low_i, high_i, low_j, high_j, excess, threshold) -> np.ndarray:
    """Which node pairs can hold a pair of records of similarity >= threshold.

    Shared items number at most the `common` OR bits plus the items beyond one per bit (`excess`), and at most a record's
    size less the bits all of its node have and none of the other has (`alone`). Size ranges bound the rest.
    """
    shared = np.minimum(common + excess, np.minimum(high_i - alone_i, high_j - alone_j))
    shared = np.minimum(shared, np.minimum(high_i, high_j))
    # shared / (a + b - shared) grows with shared and falls with a and b; a, b >= shared
    rest = np.maximum(low_i, shared) + np.maximum(low_j, shared) - shared
    return shared >= threshold * np.maximum(rest, 1)


def forest_pairs(
    group: np.ndarray, bits: np.ndarray, size: np.ndarray, order: np.ndarray, side: np.ndarray | None, threshold: float, fan: int = 8, chunk: int = 65_536
) -> np.ndarray:
    """Index pairs that survive the dual traversal of signature trees, one tree for every value of `group`.

    `group` is sorted. All trees are built and walked together, level by level: a node covers up to `fan` nodes of the
    level below, of one tree, in the order of (`side`, `order`); a tree is walked from the level at which one node covers
    it. With `side`, only pairs of different sides come out.
    """
    n = len(group)
    by = np.lexsort((order, group)) if side is None else np.lexsort((order, side, group))
    bit, count = bits[by], _popcount(bits[by])
    level = dict(tree=group[by], o=bit, a=bit, ones=count, lo=size[by], hi=size[by], ex=size[by] - count)
    levels, roots = [], []
    while n:
        tree = level["tree"]
        new = np.r_[True, tree[1:] != tree[:-1]]
        single = new & np.r_[new[1:], True]
        levels.append(level)
        roots.append(np.flatnonzero(single))
        rest = np.flatnonzero(~single)
        if not len(rest):
            break
        at = rest[_rank(tree[rest]) % fan == 0]
        # nodes of one tree lie together, so the children of a node end where the next one of its tree, or its tree, ends
        ends = np.flatnonzero(np.r_[new[1:], True]) + 1
        tree_end = np.repeat(ends, np.diff(np.r_[0, ends]))
        children = np.minimum(at + fan, tree_end[at]) - at
        starts = np.repeat(at - np.r_[0, np.cumsum(children)[:-1]], children) + np.arange(children.sum())
        cuts = np.r_[0, np.cumsum(children)[:-1]]
        v = {k: level[k][starts] for k in ("o", "a", "lo", "hi", "ex")}
        level = dict(
            tree=tree[at],
            first=at,
            children=children,
            o=np.bitwise_or.reduceat(v["o"], cuts),
            a=np.bitwise_and.reduceat(v["a"], cuts),
            lo=np.minimum.reduceat(v["lo"], cuts),
            hi=np.maximum.reduceat(v["hi"], cuts),
            ex=np.maximum.reduceat(v["ex"], cuts),
        )
    stack, found = [(k, r, r) for k, r in enumerate(roots) if k and len(r)], []
    while stack:
        k, i, j = stack.pop()
        if len(i) > chunk:
            stack += [(k, i[s : s + chunk], j[s : s + chunk]) for s in range(0, len(i), chunk)]
            continue
        v = levels[k]
        common = _popcount(v["o"][i] & v["o"][j])
        if k:
            alone_i, alone_j = _popcount(v["a"][i] & ~v["o"][j]), _popcount(v["a"][j] & ~v["o"][i])
        else:  # a record has its OR bits and AND bits alike
            alone_i, alone_j = v["ones"][i] - common, v["ones"][j] - common
        ok = _possible(common, alone_i, alone_j, v["lo"][i], v["hi"][i], v["lo"][j], v["hi"][j], np.minimum(v["ex"][i], v["ex"][j]), threshold)
        i, j = i[ok], j[ok]
        if not k:
            found.append(np.stack([i, j], 1))
            continue
        ni, nj = v["children"][i], v["children"][j]
        many = ni * nj
        pair = np.repeat(np.arange(len(i)), many)
        step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        ci, cj = v["first"][i][pair] + step // nj[pair], v["first"][j][pair] + step % nj[pair]
        keep = (ci < cj) if k == 1 else (ci <= cj)
        if keep.any():
            stack.append((k - 1, ci[keep], cj[keep]))
    pairs = by[np.concatenate(found or [np.zeros((0, 2), int)])]
    return pairs if side is None else pairs[side[pairs[:, 0]] != side[pairs[:, 1]]]


def near_duplicates(
    df: DataFrame, key: str, title: str | None, body: str, threshold: float, tile: int = 4096, expand: int | None = 4096, bands: int = 64, rows: int = 4, most_sent: int = 100_000,
    most_copies: int = 1_000_000, round_rows: int = 500_000, most_rounds: int = 8,
) -> DataFrame:
    """(id_a, id_b, kind), id_a < id_b: pairs of records whose bags of words have shared / all of at least `threshold`.

    Words count as often as they occur. Records with a null key or null body leave, a null title is empty; records
    without words have no similarity and no pairs; keys are unique integers; other columns are not read. An empty
    table gives no pairs. Records with equal bags are one class: classes are compared by representative. Links are
    written out for all members, as kind `pair`, while a class pair has at most `expand` of them; beyond, as one link of
    the representatives of kind `classes` plus kind `member` from a representative to each member, so no link between
    different texts is lost and groups of copies, however large, cost one row a member. With `expand` None every pair
    is written out, however many.

    Which records meet is decided by `bands` anchors, which join `rows` minwise hashes of the bag each: whatever the
    order of the words and however large the group, a pair of similarity s is missed by all with chance
    (1 - s ** rows) ** bands, which is 0.0008 at 0.57, 0.0001 at 0.6 and 0.000001 at 0.66. Trees of more than `tile`
    records are split into blocks, each pair of blocks a task of its own: nothing is capped. Which trees those are is
    counted on a sixteenth of the records, as that decides only how the work is split. The anchors of such trees are
    broadcast while they are at most `most_sent`, else joined, and so are up to `most_copies` copies, which join no tree.

    All anchors are walked, but not all at once: in up to `most_rounds` rounds of equally many bands, of `round_rows` rows
    at least, and a round's shuffle is freed before the next begins. So disk holds the bags, one round and the pairs found.
    """
    texts = df.where(F.col(key).isNotNull() & F.col(body).isNotNull())
    texts = texts.select(F.col(key).cast("long").alias("id"), (F.col(title) if title else F.lit("")).alias("t"), F.col(body).alias("b"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            docs = [visible_words(t, b) for t, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            h, doc = _word_ids(docs, cache)
            items, sizes = _bags(h, doc, len(docs))
            ends = np.cumsum(sizes)
            bags = [items[e - n : e].tobytes() for e, n in zip(ends, sizes)]
            digest = [xxhash.xxh128_digest(b) for b in bags]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(digest, pa.binary()), pa.array(sizes.astype(np.int32)), pa.array(bags, pa.binary())], ["id", "digest", "size", "bag"]
            )

    described = cut(texts.mapInArrow(describe, "id long, digest binary, size int, bag binary").where("size > 0"), free=True)
    n_records, mean = described.agg(F.count("*"), F.avg("size")).first()
    width = _width(mean or 0)
    classes = described.groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("members"))
    repeated = cut(described.select("id", "digest").join(classes.where("members > 1"), "digest").select("id", "rep", "members"), free=True)
    copies = repeated.where("id <> rep").select("id")
    reps = described.join(F.broadcast(copies) if copies.count() <= most_copies else copies, "id", "left_anti").select("id", "size", "bag")

    def routed(records: DataFrame, of: range) -> DataFrame:
        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                items, sizes = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32), batch.column(1).to_numpy()
                joined = _bands(items, sizes, of, rows)
                offsets = pa.array(np.arange(0, joined.size + 1, len(of), dtype=np.int32))
                bits = pa.array([b.tobytes() for b in _bitmaps(items, sizes, width)], pa.binary())
                least = pa.array(items[np.r_[0, np.cumsum(sizes)[:-1]]].astype(np.int64))
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], bits, least, pa.ListArray.from_arrays(offsets, pa.array(joined.ravel()))], ["id", "size", "bits", "least", "anchors"])

        chosen = records.mapInArrow(choose, "id long, size int, bits binary, least long, anchors array<long>")
        return chosen.select(F.posexplode("anchors").alias("band", "anchor"), "id", "size", "bits", "least")

    some = min(16, max(1, tile // 256))
    sample = reps.where(F.pmod(F.xxhash64("id", F.lit(some)), F.lit(some)) == 0)
    load = routed(sample, range(bands)).groupBy("band", "anchor").agg((F.count("*") * some).alias("n"))
    crowded = cut(load.where(F.col("n") > tile).select("band", "anchor", F.ceil(F.col("n") / tile).cast("int").alias("blocks")), free=True)
    tasks_of = {r["band"]: (r["many"], r["tasks"]) for r in crowded.groupBy("band").agg(F.count("*").alias("many"), F.sum(F.col("blocks") * (F.col("blocks") + 1) / 2).alias("tasks")).collect()}

    def words(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(col.to_pylist()), np.uint64).reshape(-1, width // 64)

    def pairs_of(t: pa.Table) -> pa.RecordBatch:
        anchor = t["anchor"].to_numpy()
        start = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        length = np.diff(np.r_[start, len(anchor)])
        t = t.filter(pa.array(np.repeat(length > 1, length)))
        tree = np.repeat(np.arange((length > 1).sum()), length[length > 1])
        ids = t["id"].to_numpy()
        p = forest_pairs(tree, words(t["bits"]), t["size"].to_numpy(), t["least"].to_numpy(), None, threshold)
        p = np.unique(np.sort(ids[p], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], ["a", "b"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:  # sorted by anchor; the last anchor of a batch may go on in the next
            if not batch.num_rows:
                continue
            last = batch.column(0)[-1].as_py()
            if held and held[-1].column(0)[-1].as_py() == last and batch.column(0)[0].as_py() == last:
                held.append(batch)
                continue
            t = pa.Table.from_batches([*held, batch])
            keep = int(np.searchsorted(t["anchor"].to_numpy(), last))
            if keep:
                yield pairs_of(t.slice(0, keep))
            held = t.slice(keep).combine_chunks().to_batches()
        if held:
            yield pairs_of(pa.Table.from_batches(held))

    def meet(t: pa.Table) -> pa.Table:
        ids, size, bits, least = t["id"].to_numpy(), t["size"].to_numpy(), words(t["bits"]), t["least"].to_numpy()
        x, y = t["x"][0].as_py(), t["y"][0].as_py()
        if x == y:
            _, at = np.unique(ids, return_index=True)
            p = at[forest_pairs(np.zeros(len(at), int), bits[at], size[at], least[at], None, threshold)]
        else:
            p = forest_pairs(np.zeros(len(ids), int), bits, size, least, (t["own"].to_numpy() == y).astype(int), threshold)
        p = np.unique(np.sort(ids[p], axis=1), axis=0)
        return pa.table({"a": p[:, 0], "b": p[:, 1]})

    def walked(of: range) -> DataFrame:
        many, tasks = (sum(tasks_of.get(b, (0, 0))[k] for b in of) for k in (0, 1))
        rows_of = routed(reps, of).drop("band")
        usual = rows_of
        if many:
            # crowded anchors have their rows meet block by block
            here = crowded.where(F.col("band").between(of.start, of.stop - 1)).select("anchor", "blocks")
            placed = rows_of.join(F.broadcast(here) if many <= most_sent else here, "anchor", "left")
            usual = placed.where("blocks is null").select("anchor", "id", "size", "bits", "least")
        met = usual.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(walk, "a long, b long")
        if many:
            own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
            every = F.sequence(F.lit(0), F.col("blocks") - 1)
            blocks = placed.where("blocks is not null").select("anchor", own.alias("own"), F.explode(every).alias("other"), "id", "size", "bits", "least")
            blocks = blocks.select("anchor", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "id", "size", "bits", "least")
            # few bytes, but much to compare: as many tasks as there are pairs of blocks, which Spark does not join
            apart = blocks.repartition(int(min(tasks, 10_000)), "anchor", "x", "y")
            met = met.unionByName(apart.groupBy("anchor", "x", "y").applyInArrow(meet, "a long, b long"))
        return cut(met, free=True)

    rounds = min(most_rounds, bands, max(1, math.ceil(n_records * bands / round_rows)))
    step = math.ceil(bands / rounds)
    met = reduce(DataFrame.unionByName, [walked(range(b, min(b + step, bands))) for b in range(0, bands, step)])
    bag = described.select("id", "bag")
    both = met.distinct().join(bag.select(F.col("id").alias("a"), F.col("bag").alias("x")), "a").join(bag.select(F.col("id").alias("b"), F.col("bag").alias("y")), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            (x, nx), (y, ny) = (_numbered(batch.column(c).to_pylist()) for c in (2, 3))
            first = np.r_[True, y[1:] != y[:-1]]
            at = np.minimum(np.searchsorted(x, y), len(x) - 1)
            shared = np.bincount((y[first & (x[at] == y)] >> np.uint64(32)).astype(np.int64), minlength=len(nx))
            yield batch.select([0, 1]).filter(pa.array(shared >= threshold * (nx + ny - shared)))

    links = cut(both.select("a", "b", "x", "y").mapInArrow(verify, "a long, b long"), free=True)
    return _all_members(links, repeated, expand)


def _all_members(links: DataFrame, repeated: DataFrame, expand: int | None) -> DataFrame:
    """Links of representatives and the classes of copies (id, rep, members) as pairs of records."""
    expand = (1 << 63) - 1 if expand is None else expand
    sizes = repeated.where("id = rep").select("rep", "members")
    p = links.join(sizes.select(F.col("rep").alias("a"), F.col("members").alias("na")), "a", "left")
    p = p.join(sizes.select(F.col("rep").alias("b"), F.col("members").alias("nb")), "b", "left")
    p = p.withColumn("all", F.coalesce("na", F.lit(1)) * F.coalesce("nb", F.lit(1)))
    plain = p.where((F.col("all") == 1) | (F.col("all") > expand)).select("a", "b", F.when(F.col("all") == 1, "pair").otherwise("classes").alias("kind"))
    wide = p.where((F.col("all") > 1) & (F.col("all") <= expand)).select("a", "b")
    few = repeated.where(F.col("members") <= expand)
    wide = wide.join(few.select(F.col("rep").alias("a"), F.col("id").alias("ia")), "a", "left").join(few.select(F.col("rep").alias("b"), F.col("id").alias("ib")), "b", "left")
    wide = wide.select(F.coalesce("ia", "a").alias("a"), F.coalesce("ib", "b").alias("b"))
    small = repeated.where(F.col("members") * F.col("members") <= expand).select("rep", "id")
    inner = small.join(small.withColumnRenamed("id", "id2"), "rep").where("id < id2").select(F.col("id").alias("a"), F.col("id2").alias("b"))
    star = repeated.where((F.col("members") * F.col("members") > expand) & (F.col("id") != F.col("rep"))).select(F.col("rep").alias("a"), F.col("id").alias("b"))
    pairs = wide.unionByName(inner).withColumn("kind", F.lit("pair"))
    out = plain.unionByName(pairs).unionByName(star.withColumn("kind", F.lit("member")))
    return out.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"), "kind")
