"""Steps of the analysis from the command line: python -m panelweave STEP --input TABLE --output TABLE ...

Tables are Parquet, or CSV for reading where the name ends so. Every step adds to its output with --append, and then leaves
out keys that are there; extract and tokenize take a slice or a batch, so that a long run can be made in parts.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from .functions import fixed_values as fixed
from .operators import audit, evaluate, features, passages, tokenizers, tokens
from .sources import collect
from .sources.scratch import written
from .sources.tables import dealt, pending

LEXICONS = {"esg": fixed.SIGNAL_PRESERVE, "g": fixed.GOVERNANCE_PROTECT, "bp": fixed.BOILERPLATE_NOUNS}
CONFIGS = {c.name: c for c in tokens.GRID}


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path) if path.endswith(".csv") else spark.read.parquet(path)


def todo(spark: SparkSession, a: argparse.Namespace, keys: Sequence[str]) -> DataFrame:
    """The input without what the output has, if it is added to; the first --batch of it."""
    rows = read(spark, a.input)
    batch = getattr(a, "batch", None)
    if a.append and _exists(spark, a.output):
        return pending(rows, spark.read.parquet(a.output), keys, batch=batch)
    return rows if batch is None else rows.orderBy(*keys).limit(batch)


def save(rows: DataFrame, a: argparse.Namespace) -> None:
    rows.write.mode("append" if a.append else "overwrite").parquet(a.output)


def tokenizer(a: argparse.Namespace) -> dict:
    return {"tokenizer": tokenizers.named(*a.tokenizer.split(","))} if a.tokenizer else {}


def run_extract(spark: SparkSession, a: argparse.Namespace) -> None:
    patterns = {p.split("=", 1)[0]: p.split("=", 1)[1].split("|") for p in a.section}
    seeds = dict(s.split("=", 1) for s in a.seed)
    passages.run_stage(read(spark, a.input), a.output, a.keys, a.text, patterns, a.stop, seeds, start=a.row_start, end=a.row_end, append=a.append, least_seeds=a.min_seed)


def run_tokenize(spark: SparkSession, a: argparse.Namespace) -> None:
    done = todo(spark, a, a.keys)
    save(tokens.tokenize(dealt(done) if not a.append and a.batch is None else done, a.keys, a.text, CONFIGS[a.exp], tokens.WordLists(), **tokenizer(a)), a)


def run_audit(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = read(spark, a.input)
    save(audit.audit(audit.frequencies(rows), rows.count(), audit.Rules(), a.top_n), a)


def run_classify(spark: SparkSession, a: argparse.Namespace) -> None:
    rules = audit.Rules()
    rows = written(read(spark, a.input), "audited")
    n = audit.infer_n_docs(rows).first()["n_docs"]
    classified = written(audit.classify(rows, rules).join(audit.reasons(rows, rules, n), "token"), "classified")
    save(classified, a)
    if a.export_stopwords:
        audit.stop_word_export(classified, []).write.mode("overwrite").parquet(a.export_stopwords)


def run_features(spark: SparkSession, a: argparse.Namespace) -> None:
    save(features.lexicon_ratios(todo(spark, a, a.keys), a.keys, LEXICONS), a)


def run_evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    grid, lists = [CONFIGS[e] for e in a.exps], tokens.WordLists()
    save(evaluate.report(tokens.grid_rows(dealt(read(spark, a.input)), a.text, grid, lists, **tokenizer(a)), grid, lists, LEXICONS, a.top_n), a)


def run_collect(spark: SparkSession, a: argparse.Namespace) -> None:
    excluded = read(spark, a.exclude) if a.exclude else None
    n = collect.collect(read(spark, a.input), a.keys[0], a.folder, a.output, a.suffix, excluded, a.retry, a.most, a.batch)
    print(f"{n} keys tried")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="panelweave", description=__doc__.split("\n")[0])
    steps = out.add_subparsers(dest="step", required=True)

    def step(name: str, run, *, keys: bool = True, text: bool = False, models: bool = False) -> argparse.ArgumentParser:
        p = steps.add_parser(name)
        p.set_defaults(run=run)
        p.add_argument("--input", required=True)
        p.add_argument("--output", required=True)
        p.add_argument("--append", action="store_true")
        if keys:
            p.add_argument("--keys", nargs="+", default=["doc_id"])
        if text:
            p.add_argument("--text", default="text")
        if models:
            p.add_argument("--tokenizer", help="names, the first that the workers have; without, runs of letters")
        return p

    p = step("extract", run_extract, text=True)
    p.add_argument("--section", nargs="+", required=True, help="name=pattern|pattern")
    p.add_argument("--seed", nargs="+", required=True, help="term=category")
    p.add_argument("--stop", nargs="*", default=[])
    p.add_argument("--min_seed", type=int, default=1)
    p.add_argument("--row_start", type=int, default=0)
    p.add_argument("--row_end", type=int)
    p = step("tokenize", run_tokenize, text=True, models=True)
    p.add_argument("--exp", required=True, choices=[*CONFIGS])
    p.add_argument("--batch", type=int)
    p = step("audit", run_audit, keys=False)
    p.add_argument("--top_n", type=int, default=500)
    p = step("classify", run_classify, keys=False)
    p.add_argument("--export_stopwords")
    step("features", run_features)
    p = step("evaluate", run_evaluate, keys=False, text=True, models=True)
    p.add_argument("--exps", nargs="+", default=["exp_B", "exp_E", "exp_F"], choices=[*CONFIGS])
    p.add_argument("--top_n", type=int, default=30)
    p = step("collect", run_collect)
    p.add_argument("--folder", required=True)
    p.add_argument("--suffix", default="")
    p.add_argument("--exclude")
    p.add_argument("--retry", nargs="*", default=[collect.FAILED], choices=[collect.FAILED, collect.MISSING])
    p.add_argument("--most", type=int, default=3)
    p.add_argument("--batch", type=int)
    return out


def main(arguments: Sequence[str] | None = None) -> None:
    a = parser().parse_args(arguments)
    a.run(SparkSession.builder.getOrCreate(), a)


if __name__ == "__main__":
    main()
