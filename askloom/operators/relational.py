"""Selections, semi-joins and aggregations over posts, comments, tags and links.

Every join is declared; sides are never collected and pasted as literals, so one id or a billion take the same path.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tag_filter(tags: Column, any_of: Sequence[str], none_of: Sequence[str] = ()) -> Column:
    """Case-insensitive containment; null tags are dropped by `where`, as in SQL."""
    wanted = reduce(lambda a, b: a | b, [tags.ilike(f"%{t}%") for t in any_of])
    return reduce(lambda a, b: a & b, [~tags.ilike(f"%{t}%") for t in none_of], wanted)


def all_of(conditions: Sequence[str]) -> Column:
    """A conjunction of SQL conditions; the postfix `NOT NULL` is understood as `IS NOT NULL`."""
    import re

    fixed = [re.sub(r"(?<!is )\bnot null\b", "IS NOT NULL", c, flags=re.I) for c in conditions]
    return reduce(lambda a, b: a & b, [F.expr(c) for c in fixed], F.lit(True))


def semi(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """Rows of df whose `column` is among the first column of ids."""
    key = ids.columns[0]
    return df.join(ids.select(F.col(key).alias("_id")), F.col(column) == F.col("_id"), "left_semi")


def both_ends(edges: DataFrame, src: str, dst: str, ids: DataFrame) -> DataFrame:
    return semi(semi(edges, src, ids), dst, ids)


def degrees(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(id, degree): how often a post is an end of a link."""
    ends = edges.select(F.col(src).alias("id")).unionAll(edges.select(F.col(dst).alias("id")))
    return ends.where("id is not null").groupBy("id").agg(F.count("*").alias("degree"))


def symmetric(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(src, dst): both directions of every link, once."""
    one = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst"))
    return one.unionAll(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src is not null and dst is not null").distinct()


def link_lookup(edges: DataFrame, src: str, dst: str, ids: DataFrame, least: int) -> DataFrame:
    """Symmetric links among `ids`, whose ends lie on at least `least` links."""
    inside = both_ends(edges, src, dst, ids)
    busy = degrees(inside, src, dst).where(F.col("degree") >= least).select("id")
    return symmetric(both_ends(inside, src, dst, busy), src, dst)


def greedy_pairs(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """Links in (src, dst) order of which the source was not seen before, as source or target of a kept link.

    A link is kept or dropped by those before it alone, and only those that touch it count. The fixed point is
    reached in rounds: a link with no undecided earlier link at its source is decided. No ordered fold on one task.
    """
    from askloom.session import cut

    links = edges.select(F.col(src).alias("s"), F.col(dst).alias("d")).where("s is not null and d is not null").distinct()
    links = cut(links)
    kept, undecided = links.limit(0), links
    while not undecided.isEmpty():
        # the smallest undecided link that touches a node, seen from that node
        touch = undecided.select(F.col("s").alias("n"), "s", "d").unionAll(undecided.where("s <> d").select(F.col("d").alias("n"), "s", "d"))
        first = touch.groupBy("n").agg(F.min(F.struct("s", "d")).alias("f")).select("n", "f.*")
        now = cut(undecided.join(first.where("n = s").select("s", "d"), ["s", "d"], "left_semi"))
        kept = kept.unionAll(now)
        seen = now.select(F.col("s").alias("n")).unionAll(now.select(F.col("d").alias("n"))).distinct()
        later = undecided.join(now, ["s", "d"], "left_anti")
        undecided = cut(later.join(seen.select(F.col("n").alias("s")), "s", "left_anti"))
    return kept


def inverted_index(df: DataFrame, key: str, tag: str) -> DataFrame:
    """(tag, ids): the sorted ids of every tag. A list is as long as its tag is frequent; see postings for scale."""
    return df.groupBy(tag).agg(F.sort_array(F.collect_set(key)).alias("ids"))


def postings(df: DataFrame, key: str, tag: str, width: int = 1 << 20) -> DataFrame:
    """(tag, block, ids): an inverted index in blocks of `width` consecutive ids, so the list of a tag which a third
    of all posts carry is many short rows, built by many tasks."""
    rows = df.select(F.col(tag).alias("tag"), F.expr(f"`{key}` div {width}").alias("block"), F.col(key).alias("id"))
    return rows.groupBy("tag", "block").agg(F.sort_array(F.collect_set("id")).alias("ids"))


def top_tags(ranked: DataFrame, rank: str, tags: str, n: int = 8) -> DataFrame:
    """The n most frequent tags of a ranked list; ties go to the tag that appears first."""
    each = ranked.select(rank, F.posexplode(tags).alias("pos", "tag"))
    return each.groupBy("tag").agg(F.count("*").alias("n"), F.min(F.struct(rank, "pos")).alias("first")).orderBy(F.desc("n"), "first").limit(n).select("tag", "n")


def snippet_index(answers: DataFrame, parent: str, ident: str, score: str, snippets: str, base: str) -> DataFrame:
    """(parent, SnippetCount, Snippets): snippet blocks of a question's answers, best answer first."""
    from askloom.functions.text import snippet_block

    with_code = answers.where(F.size(snippets) > 0)
    block = F.struct((-F.coalesce(F.col(score).cast("long"), F.lit(-(1 << 40)))).alias("k"), F.col(ident).alias("i"), snippet_block(F.col(ident), F.coalesce(F.col(score), F.lit(0)), F.col(snippets), base).alias("b"))
    got = with_code.groupBy(parent).agg(F.sum(F.size(snippets)).alias("SnippetCount"), F.sort_array(F.collect_list(block)).alias("bs"))
    return got.select(parent, "SnippetCount", F.array_join(F.transform("bs", lambda x: x["b"]), "<_post_>").alias("Snippets"))


def rank_words(tokens: DataFrame, doc: str, pos: str, token: str) -> DataFrame:
    """(token, n, rank): dictionary by frequency, ranks from 1, ties by first appearance.

    The rank is global; counting per range first keeps the ordering off a single task: counts are range-partitioned,
    numbered inside, and shifted by the sizes of the ranges before.
    """
    counts = tokens.groupBy(token).agg(F.count("*").alias("n"), F.min(F.struct(doc, pos)).alias("first"))
    return number_rows(counts, [F.desc("n"), F.col("first")]).select(F.col(token).alias("token"), "n", F.col("row").alias("rank"))


def number_rows(df: DataFrame, order: list[Column]) -> DataFrame:
    """Adds `row`, 1.. in the given order, without a global window: sort by range, number inside partitions, shift."""
    from askloom.session import cut

    ranged = cut(df.sort(*order).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id()))
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_m").alias("_lo"))
    # one row per partition
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return ranged.join(F.broadcast(sizes), "_p").withColumn("row", F.col("_m") - F.col("_lo") + F.col("_before") + 1).drop("_p", "_m", "_n", "_lo", "_before")
