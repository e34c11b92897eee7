"""`python -m askloom.cli PARAMS.json {corpus,index,search} [--text T] [--tags A,B] [--results N]
[--models tfidf,words] [--fields Title,Body] [--weights 0.6,0.4]`. A search reads the index that `index` saved."""

from __future__ import annotations

import argparse

from askloom import jobs
from askloom.operators.retrieval import SearchEngine
from askloom.session import get_spark


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="askloom")
    p.add_argument("params", help="JSON file of parameters")
    p.add_argument("step", choices=["corpus", "index", "search"])
    p.add_argument("--text", default="", help="what to search for")
    p.add_argument("--tags", default="", help="comma-separated; a post needs one of them")
    p.add_argument("--results", type=int, default=20)
    p.add_argument("--models", default="", help="comma-separated; of those in the index, all by default; two make a hybrid")
    p.add_argument("--fields", default="", help="comma-separated; of those in the index, all by default")
    p.add_argument("--weights", default="", help="comma-separated, one for each of --fields, with a sum of 1")
    a = p.parse_args(args)
    config = jobs.Config.read(a.params)
    spark = get_spark()
    if a.step == "corpus":
        print(jobs.corpus(spark, config).count(), "lines")
        return
    if a.step == "index":
        engine = jobs.index(spark, config)
        print(", ".join(f"{name}: {' '.join(fields)}" for name, (_, fields) in engine.spaces.items()))
        return
    models, fields = ([x for x in v.split(",") if x] or None for v in (a.models, a.fields))
    engine = SearchEngine.load(spark, f"{config.out}/index", models, fields)
    weights = dict(zip(fields or [], map(float, a.weights.split(",")), strict=True)) if a.weights else None
    engine.search(a.text, a.tags, a.results, weights).orderBy("rank").show(a.results, truncate=60)


if __name__ == "__main__":
    main()
