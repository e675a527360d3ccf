"""Tokenizers by name, for those that are Python models: one model per worker, texts in Arrow batches, another where one can't be made.

`named("kiwi", "okt", "letters")` goes wherever a tokenizer does, as any function from a text column to an array column.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

Model = Callable[[str], Sequence[str]]
Factory = Callable[[], Model]
#: Parts of speech that the morphological tokenizers keep: nouns.
NOUNS = ("NNG", "NNP", "Noun")


def letters() -> Model:
    """Runs of two letters or more in lower case, as text.words()."""
    import regex

    found = regex.compile(r"\p{L}{2,}").findall
    return lambda text: found(text.lower())


def kiwi() -> Model:
    from kiwipiepy import Kiwi

    model = Kiwi()
    return lambda text: [t.form for t in model.tokenize(text) if t.tag in NOUNS]


def okt() -> Model:
    from konlpy.tag import Okt

    model = Okt()
    return lambda text: [word for word, tag in model.pos(text) if tag in NOUNS]


#: Texts whose tokens are held as Python strings at once.
TEXTS = 64
FACTORIES: dict[str, Factory] = {"letters": letters, "kiwi": kiwi, "okt": okt}
_MADE: dict[tuple[str, ...], tuple[str, Model]] = {}


def register(name: str, factory: Factory) -> None:
    """A factory of one's own: called once in each worker; an ImportError says that the worker lacks what it needs."""
    FACTORIES[name] = factory


def chain(names: Sequence[str]) -> tuple[tuple[str, Factory], ...]:
    unknown = [n for n in names if n.lower() not in FACTORIES]
    if unknown or not names:
        raise ValueError(f"unknown tokenizer {', '.join(unknown) or '(none)'}; known: {', '.join(sorted(FACTORIES))}")
    return tuple((n.lower(), FACTORIES[n.lower()]) for n in names)


def made(factories: tuple[tuple[str, Factory], ...]) -> tuple[str, Model]:
    """Name and model of the first that this worker can make; an ImportError that names all reasons if it can make none."""
    key = tuple(f"{name}:{id(f) if name not in FACTORIES else ''}" for name, f in factories)
    if key not in _MADE:
        reasons = []
        for name, factory in factories:
            try:
                _MADE[key] = (name, factory())
                break
            except ImportError as e:
                reasons.append(f"{name}: {e}")
        else:
            raise ImportError("no tokenizer can be made (" + "; ".join(reasons) + ")")
    return _MADE[key]


def named(*names: str) -> Callable[[Column], Column]:
    """The tokenizer of this name, or the next of these where a worker lacks it. A null text has no tokens."""
    factories = chain(names)

    @F.arrow_udf("array<string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = made(factories)[1]
        for batch in batches:
            # tokens are Python strings for a few texts at a time only
            parts = (batch.slice(at, TEXTS).to_pylist() for at in range(0, len(batch), TEXTS))
            lists = [pa.array([[] if text is None else [*model(text)] for text in part], pa.list_(pa.string())) for part in parts]
            yield pa.concat_arrays(lists) if lists else pa.array([], pa.list_(pa.string()))

    return run


def taken(spark: SparkSession, *names: str, tasks: int | None = None) -> list[str]:
    """Which of these the workers take: more than one name if they differ, and then results do."""
    factories = chain(names)

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"name": [made(factories)[0]] * min(1, len(f))})

    n = tasks or spark.sparkContext.defaultParallelism
    return sorted(r["name"] for r in spark.range(n, numPartitions=n).mapInPandas(ask, "name string").distinct().collect())

