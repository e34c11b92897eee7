"""Readers: archive dumps, line files, labels, word vectors, CoNLL, Brown paths, name lists, SQLite, JSON."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from askloom.operators.relational import number_rows


def xml_dump(spark: SparkSession, path: str, columns: Mapping[str, str], row_tag: str = "row") -> DataFrame:
    """`<row a="..."/>` elements as typed rows. Every attribute is read as text and cast here: a typed schema would
    fail the whole job on one bad number. A row with a malformed integer is dropped, a missing attribute is null, an
    unknown one is ignored."""
    raw = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    df = spark.read.format("xml").option("rowTag", row_tag).option("attributePrefix", "").schema(raw).load(path)
    cast = {c: F.expr(f"try_cast(`{c}` as {kind})") for c, kind in columns.items()}
    bad = F.lit(False)
    for c, kind in columns.items():
        if kind in ("int", "long", "bigint"):
            bad = bad | (F.col(c).isNotNull() & cast[c].isNull())
    present = F.coalesce(*[F.col(c) for c in columns]).isNotNull()
    return df.where(present & ~bad).select(*(v.alias(c) for c, v in cast.items()))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line): stripped lines of a file or folder."""
    return spark.read.text(path).select(F.trim("value").alias("line"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(pos, line) in file order, positions from 0 without a global sort task."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_s"), F.monotonically_increasing_id().alias("_m"))
    return number_rows(lines, [F.col("_f"), F.col("_s"), F.col("_m")]).select((F.col("row") - 1).alias("pos"), F.col("value").alias("line"))


def labels(spark: SparkSession, path: str, mode: str = "int") -> DataFrame:
    """(pos, label): integers by position; mode `bool` negates, so 1 (unclean) means drop."""
    if mode not in ("int", "bool"):
        raise ValueError(f"unknown mode {mode!r}")
    value = F.expr("try_cast(trim(line) as int)")
    return numbered_lines(spark, path).select("pos", (value if mode == "int" else ~value.cast("boolean")).alias("label"))


def word_vectors(spark: SparkSession, path: str, unknown: bool = False) -> DataFrame:
    """(token, vec) of a text file with a header `n dim`; with `unknown`, the mean of all is added as <unk>."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\d+ \d+\s*$"))
    parts = F.split(F.trim("value"), " ", 2)
    table = lines.where(F.trim("value") != "").select(parts[0].alias("token"), F.split(parts[1], " ").cast("array<float>").alias("vec"))
    if not unknown:
        return table
    first = table.first()
    dim = len(first["vec"]) if first else 0
    mean = table.agg(F.array(*[F.avg(F.get("vec", i)).cast("float") for i in range(dim)]).alias("vec"))
    return table.unionByName(mean.select(F.lit("<unk>").alias("token"), "vec"))


def conll(spark: SparkSession, path: str, fields: tuple[str, ...] = ("token", "entity"), sep: str = " ") -> DataFrame:
    """(sent, items array<struct>): a blank line ends a sentence. A line with too few fields raises when it is read.

    A sentence is a record of the text source, which ends at an empty line, so a file of any size is read in splits and
    sentences do not depend on where they lie; blank lines of white space are cut afterwards.
    """
    rows = spark.read.option("lineSep", "\n\n").text(path)
    at = [F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("s"), F.monotonically_increasing_id().alias("m")]
    blocks = rows.select(*at, F.posexplode(F.split("value", r"\n[ \t]*\n")).alias("p", "block")).where(F.trim("block") != "").where(F.col("block").rlike(r"\S"))
    lines = F.filter(F.split("block", "\n"), lambda x: F.trim(x) != "")

    def item(line):
        parts = F.split(line, sep)
        fits = F.when(F.size(parts) >= len(fields), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("too few fields: "), line)).cast("boolean"))
        return F.struct(*[F.when(fits, parts[i]).alias(n) for i, n in enumerate(fields)])

    return number_rows(blocks, [F.col(c) for c in ("f", "s", "m", "p")]).select((F.col("row") - 1).alias("sent"), F.transform(lines, item).alias("items"))


def conll_columns(spark: SparkSession, path: str, token: int = 3, label: int = 0) -> DataFrame:
    """(pos, token, label): two columns of annotated lines; blank lines stay as nulls and still end sentences."""
    parts = F.split(F.trim("line"), r"\s+")
    return numbered_lines(spark, path).select("pos", F.get(parts, token).alias("token"), F.when(F.trim("line") != "", F.get(parts, label)).alias("label"))


def sentence_ids(lines: DataFrame) -> DataFrame:
    """Adds `sent`, the blank lines before, to (doc, pos, line)."""
    w = Window.partitionBy("doc").orderBy("pos")
    return lines.withColumn("sent", F.sum(F.when(F.trim("line") == "", 1).otherwise(0)).over(w))


def brown_paths(spark: SparkSession, path: str) -> DataFrame:
    """(token, path, n) of a tab file `bits token count`."""
    rows = spark.read.csv(path, sep="\t", schema="path string, token string, n long", quote="")
    return rows.select("token", "path", "n")


def gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """(name): distinct lower-case lines."""
    return text_lines(spark, path).select(F.lower("line").alias("name")).where("name <> ''").distinct()


def json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def parameter_log(lines: DataFrame) -> DataFrame:
    """(section, pos, values): rows under `#header` lines of a results file, by a running count of headers.

    A results file is a log of one search, so its lines are ordered in one place.
    """
    w = Window.partitionBy("doc").orderBy("pos")
    at = lines.withColumn("section", F.sum(F.when(F.col("line").startswith("#"), 1).otherwise(0)).over(w))
    return at.where(~F.col("line").startswith("#") & (F.trim("line") != "")).select("doc", "section", "pos", F.split(F.trim("line"), r"\s+").alias("values"))


class _Slice(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class SqliteSource(DataSource):
    """format("sqlite"): a query or table of an SQLite file on a folder all executors see; options path, query and
    slices. With slices > 1 a table is read by ranges of its rowid, several tasks at once."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> T.StructType:
        kinds = {"INTEGER": T.LongType(), "INT": T.LongType(), "REAL": T.DoubleType()}
        with sqlite3.connect(self.options["path"]) as con:
            if table := self.options.get("table"):
                info = con.execute(f'PRAGMA table_info("{table}")').fetchall()
                return T.StructType([T.StructField(r[1], kinds.get(r[2].upper(), T.StringType())) for r in info])
            cursor = con.execute(self.options["query"])
            first = cursor.fetchone() or [None] * len(cursor.description)
            found = {int: T.LongType(), float: T.DoubleType()}
            return T.StructType([T.StructField(d[0], found.get(type(v), T.StringType())) for d, v in zip(cursor.description, first)])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _SqliteReader(self.options, schema)


class _SqliteReader(DataSourceReader):
    def __init__(self, options: Mapping[str, str], schema: T.StructType):
        self.options, self.fields = dict(options), [f.dataType.typeName() for f in schema.fields]

    def partitions(self) -> list[InputPartition]:
        slices, table = int(self.options.get("slices", "1")), self.options.get("table")
        if not table or slices < 2:
            return [_Slice(0, -1)]
        with sqlite3.connect(self.options["path"]) as con:
            low, high = con.execute(f'SELECT coalesce(min(rowid), 0), coalesce(max(rowid), 0) FROM "{table}"').fetchone()
        step = (high - low) // slices + 1
        return [_Slice(low + i * step, low + (i + 1) * step) for i in range(slices)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        assert isinstance(partition, _Slice)
        with sqlite3.connect(self.options["path"]) as con:
            if table := self.options.get("table"):
                where = "" if partition.high < partition.low else f" WHERE rowid >= {partition.low} AND rowid < {partition.high}"
                cursor = con.execute(f'SELECT * FROM "{table}"{where}')
            else:
                cursor = con.execute(self.options["query"])
            for row in cursor:
                yield tuple(str(v) if k == "string" and v is not None and not isinstance(v, str) else v for v, k in zip(row, self.fields))


def sqlite(spark: SparkSession, path: str, query: str | None = None, table: str | None = None, slices: int = 1) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    options = {"path": path, "slices": str(slices)} | ({"query": query} if query else {"table": table or ""})
    return spark.read.format("sqlite").options(**options).load()
