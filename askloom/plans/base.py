"""How plan modules name their queries and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askloom.session import once, once_wide, ready, table

#: Short names for the tables with repeated rows counted once, in SQL.
VIEWS = {
    "q": "SELECT DISTINCT ON (Id) * FROM questions WHERE Id IS NOT NULL ORDER BY Id",
    "a": "SELECT DISTINCT ON (Id) * FROM answers WHERE Id IS NOT NULL ORDER BY Id",
    "c": "SELECT DISTINCT ON (Id) * FROM comments WHERE Id IS NOT NULL ORDER BY Id, Score DESC NULLS LAST",
    "u": "SELECT DISTINCT ON (Id) * FROM users WHERE Id IS NOT NULL ORDER BY Id",
    "l": "SELECT DISTINCT ON (Id) * FROM postlinks WHERE Id IS NOT NULL ORDER BY Id",
    "v": "SELECT DISTINCT ON (PostId) * FROM vectors WHERE PostId IS NOT NULL ORDER BY PostId",
    "d": "SELECT * FROM documents",
    "e": "SELECT * FROM embeddings",
    "tag": r"SELECT Id, unnest(list_distinct(regexp_extract_all(lower(Tags), '[a-z0-9][a-z0-9.#+-]*'))) AS tag FROM q WHERE Tags IS NOT NULL",
}


def code_parts_sql(text: str) -> str:
    """SQL of what a parser reads as non-empty <code> elements: attributes, inner tags and entities, open to the end."""
    x = r"regexp_replace(x, '</?[a-zA-Z][^<>]*>', '', 'g')"
    for entity, char in (("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "chr(34)"), ("&#39;", "chr(39)"), ("&apos;", "chr(39)"), ("&nbsp;", "chr(160)"), ("&amp;", "'&'")):
        x = f"replace({x}, '{entity}', {char})"
    found = rf"regexp_extract_all({text}, '(?is)<code\b[^<>]*>(.*?)(?:</code\s*>|\z)', 1)"
    return f"list_filter(list_transform({found}, lambda x: trim({x}, ' ' || chr(9) || chr(10) || chr(13) || chr(160))), lambda x: x <> '')"


class Tables:
    """The test tables of one folder; q, a, c, u, l and v count repeated rows once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = ready(spark), sf_dir

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.dir, name)

    def _posts(self, name: str, cols: tuple[str, ...]) -> DataFrame:
        rows = self.raw(name).select("Id", *cols)
        return once_wide(rows) if {"Body", "Snippets"} & set(cols) else once(rows)

    def q(self, *cols: str) -> DataFrame:
        return self._posts("questions", cols)

    def a(self, *cols: str) -> DataFrame:
        return self._posts("answers", cols)

    def c(self, *cols: str) -> DataFrame:
        """Comments; of the copies of a row the one with the highest score."""
        rest = [x for x in cols if x != "Score"]
        df = self.raw("comments").where("Id is not null").select("Id", "Score", *rest)
        return df.groupBy("Id").agg(F.max("Score").alias("Score"), *(F.first(x).alias(x) for x in rest))

    def l(self, *cols: str) -> DataFrame:  # noqa: E743
        return once(self.raw("postlinks").select("Id", *cols))

    def v(self, *cols: str) -> DataFrame:
        return once(self.raw("vectors").select("PostId", *cols), "PostId")

    def tags(self) -> DataFrame:
        """(Id, tag): lower-case tags of a question, each once, read with the pattern which SQL can read as well."""
        words = F.array_distinct(F.regexp_extract_all(F.lower("Tags"), F.lit("([a-z0-9][a-z0-9.#+-]*)"), F.lit(1)))
        return self.q("Tags").select("Id", F.explode(words).alias("tag"))


class Part:
    """QUERIES and SQL of one module, filled by the decorator."""

    def __init__(self) -> None:
        self.QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.SQL: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None, views: str = "") -> Callable:
        """Registers f(tables) under `name`; `views` lists the short names which `sql` uses, besides q for tag."""

        def keep(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
            self.QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
            if sql:
                names = views.split()
                if "tag" in names and "q" not in names:
                    names.insert(0, "q")
                names.sort(key=lambda n: n == "tag")
                head = ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
                text = sql.strip()
                if head:
                    text = f"WITH {head}, {text[5:]}" if text.upper().startswith("WITH ") else f"WITH {head} {text}"
                self.SQL[name] = text
            return f

        return keep
