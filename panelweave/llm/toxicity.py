"""Toxicity by gradient-boosted trees over dense features of whole texts, with isotonic calibration.

The features are rates: words of an insult lexicon, words and stems learned from labelled texts,
their nearness to second-person words, capitals, punctuation, and ways of writing around a filter
(digits or symbols for letters, letters apart, letters repeated). The trees are fitted in numpy on a
bounded sample of labelled rows, `sample` per class, taken by a hash of the id; the learned words, too,
are those of the sample. Two thirds of it grow the trees and one third calibrates, weighted
back to the share of each class among all labelled rows.

Defined results: a null or empty text has all rates 0 and gets the score of that; repeated rows get
the same score; columns of docs stay, but ones named toxic_score or toxic_predicted are replaced;
without labelled rows of both classes the score is the share of class 1, or 0.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, materialize, small_batches, texts

INSULTS = frozenset("idiot idiots moron morons stupid loser losers trash scum pathetic worthless disgusting clown clowns dumb fool fools garbage filth creep freak imbecile vermin coward jerk retard hate ugly shut kill die".split())
SECOND_PERSON = frozenset("you your yours youre yourself u ur tu te toi ton vous votre vos du dich dir dein deine ihr euch usted ustedes tus tuyo vosotros".split())
WORD = re.compile(r"[^\W\d_]+")
CAPITALS = re.compile(r"\b[A-Z]{3,}\b")
MARKS = re.compile(r"[!?]+")
MASKED = re.compile(r"\b[A-Za-z]*(?:[A-Za-z][0-9@$*!|]+[A-Za-z])[A-Za-z0-9@$*!|]*")
APART = re.compile(r"\b(?:[A-Za-z][.\-_* ]){3,}[A-Za-z]\b")
LONG_DRAWN = re.compile(r"([A-Za-z])\1{2,}")
UNMASK = str.maketrans("013457@$!|", "oieastasil")
NEAR = 6
FEATURES = ("log_words", "insults", "insult_rate", "insult_kinds", "learned", "learned_rate", "learned_kinds", "second_person_rate", "near_second_person", "capital_share", "capital_words", "exclamations", "mark_runs", "masked_rate", "masked_insults", "apart", "drawn_rate")


STEMS = (4, 5, 6)


class Kinds(dict):
    """1 insult, 2 learned word or stem ("stem*"), 4 second person, 0 other; words are kept as they come, up to `most`."""

    def __init__(self, learned: frozenset[str], most: int = 300_000) -> None:
        self.learned, self.most = learned, most

    def __missing__(self, word: str) -> int:
        own = word in self.learned or any(len(word) >= k and word[:k] + "*" in self.learned for k in STEMS)
        kind = (word in INSULTS) + 2 * own + 4 * (word in SECOND_PERSON)
        if len(self) < self.most:
            self[word] = kind
        return kind


def features(text: str, kinds: Kinds) -> list[float]:
    """The dense features of one text, in the order of FEATURES."""
    low = text.lower()
    words = WORD.findall(low)
    n = max(1, len(words))
    marked = [(k, x) for k, x in enumerate(map(kinds.__getitem__, words)) if x]
    hits, own, people = ([k for k, x in marked if x & bit] for bit in (1, 2, 4))
    near = 0
    for k in {*hits, *own} if people else ():
        at = np.searchsorted(people, k)
        near += any(abs(people[j] - k) <= NEAR for j in (at - 1, at) if 0 <= j < len(people))
    masked = MASKED.findall(text)
    plain = [x.lower().translate(UNMASK) for x in masked]
    letters = sum(map(len, words))
    capitals = sum(map(str.isupper, text)) if text != low else 0
    marks = MARKS.findall(text)
    return [
        np.log1p(len(words)), len(hits), 100 * len(hits) / n, len({words[k] for k in hits}), len(own), 100 * len(own) / n, len({words[k] for k in own}), 100 * len(people) / n, near,
        capitals / max(1, letters), 100 * len(CAPITALS.findall(text)) / n, 100 * sum(x.count("!") for x in marks) / n, sum(len(x) > 1 for x in marks),
        100 * len(masked) / n, sum(kinds[x] & 3 > 0 for x in plain), len(APART.findall(text)), 100 * len(LONG_DRAWN.findall(text)) / n,
    ]


@dataclass
class Model:
    """Boosted trees as flat arrays, calibration steps, and the learned words."""

    learned: frozenset[str] = frozenset()
    base: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)  # feature, threshold, leaf values of a full tree
    steps: np.ndarray = field(default_factory=lambda: np.zeros(1))
    levels: np.ndarray = field(default_factory=lambda: np.zeros(1))

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for feature, threshold, leaves in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(int(np.log2(len(leaves)))):
                at = 2 * at + 1 + (x[np.arange(len(x)), feature[at]] > threshold[at])
            out += leaves[at - len(feature)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.margin(x), self.steps, self.levels)


def grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int, ridge: float, cuts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A full tree of that depth: each node splits where the second-order gain is largest, or sends all to the left."""
    nodes = 2**depth - 1
    feature, threshold = np.zeros(nodes, dtype=np.int64), np.full(nodes, np.inf)
    at = np.zeros(len(x), dtype=np.int64)
    for node in range(nodes):
        rows = np.flatnonzero(at == node)
        best = 1e-6
        g, h = grad[rows].sum(), hess[rows].sum()
        for k in range(x.shape[1]) if len(rows) >= 10 else ():
            bins = np.searchsorted(cuts[k], x[rows, k], side="left")
            gl = np.cumsum(np.bincount(bins, grad[rows], len(cuts[k]) + 1))[:-1]
            hl = np.cumsum(np.bincount(bins, hess[rows], len(cuts[k]) + 1))[:-1]
            gain = np.where((hl > 1) & (h - hl > 1), gl**2 / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g**2 / (h + ridge), 0)
            if len(gain) and gain.max() > best:
                best = gain.max()
                feature[node], threshold[node] = k, cuts[k][gain.argmax()]
        at[rows] = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
    leaves = at - nodes
    g, h = np.bincount(leaves, grad, nodes + 1), np.bincount(leaves, hess, nodes + 1)
    return feature, threshold, -g / (h + ridge)


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, ridge: float = 1.0) -> Model:
    """Log-loss boosting with up to 32 cuts per feature."""
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Model(base=float(np.log(p / (1 - p))))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, 33)[1:-1], method="lower")) for c in x.T]
    cuts = [c[c < v.max()] for c, v in zip(cuts, x.T, strict=True)]
    margin = np.full(len(y), model.base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        feature, threshold, leaves = grow(x, p - y, np.maximum(p * (1 - p), 1e-4), depth, ridge, cuts)
        model.trees.append((feature, threshold, rate * leaves))
        one = Model(trees=model.trees[-1:])
        margin += one.margin(x)
    return model


def isotonic(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising steps of least squared error, by pooling neighbours that fall; scores between steps are interpolated."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # sum of weight * y, weight, first and last margin
    for m, t, w in zip(margin[order], y[order], weight[order], strict=True):
        blocks.append([t * w, w, m, m])
        while len(blocks) > 1 and (blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1] or blocks[-2][3] == blocks[-1][2]):
            s, w2, _, last = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += w2
            blocks[-1][3] = last
    steps = np.array([x for b in blocks for x in (b[2], b[3])])
    levels = np.array([x for b in blocks for x in (b[0] / b[1],) * 2])
    return steps, levels


def _stems(words: Column, k: int) -> Column:
    """The first k letters of the words that have as many, and an asterisk."""
    return F.transform(F.filter(words, lambda w: F.length(w) >= k), lambda w: F.concat(F.substring(w, 1, k), F.lit("*")))


def _learned_words(sample: DataFrame, most: int, least_docs: int = 5) -> frozenset[str]:
    """Words, and stems as "stem*", that texts of class 1 hold far more often than those of class 0; at most `most`."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"(\p{L}{3,})"), 1))
    stems = [_stems(words, k) for k in STEMS]
    words = sample.select("toxic", F.explode(F.array_distinct(F.concat(words, *stems))).alias("w"))
    counts = words.groupBy("w").agg(F.sum("toxic").alias("pos"), F.sum(1 - F.col("toxic")).alias("neg"))
    n = sample.agg(F.sum("toxic").alias("pos"), F.sum(1 - F.col("toxic")).alias("neg")).first()
    odds = F.log((F.col("pos") + 0.5) / (n["pos"] + 1) / ((F.col("neg") + 0.5) / (n["neg"] + 1)))
    # besides rarity a word must be common among texts of class 1
    strong = counts.where((F.col("pos") >= max(least_docs, 0.03 * n["pos"])) & (odds > 2.0)).orderBy(odds.desc(), F.col("pos").desc(), "w").limit(most)
    return frozenset(r["w"] for r in strong.collect())


def train(docs: DataFrame, labels: DataFrame, allowed: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 2000, most_words: int = 100) -> Model:
    """A model of up to `sample` labelled rows of each class whose id `allowed` admits."""
    rows = labels.where(allowed) if allowed is not None else labels
    rows = rows.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("toxic")).where("toxic in (0, 1) and __id is not null").groupBy("__id").agg(F.max("toxic").alias("toxic"))
    shares = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(shares) < 2:
        return Model(levels=np.array([1.0 if 1 in shares else 0.0]))
    chosen = None
    for k in (0, 1):
        part = rows.where(F.col("toxic") == k).orderBy(F.xxhash64("__id"), "__id").limit(sample)
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(F.broadcast(materialize(chosen, "chosen")), "__id")
    chosen = materialize(chosen.dropDuplicates(["__id"]), "sample")
    # the third that calibrates takes no part in choosing words
    third = F.pmod(F.xxhash64(F.lit("calibration"), F.col("__id")), F.lit(3)) == 0
    learned = _learned_words(chosen.where(~third), most_words)
    table = chosen.select("__id", "toxic", "text").mapInArrow(lambda b: _feature_rows(b, learned), f"__id {dict(chosen.dtypes)['__id']}, toxic int, f array<double>")
    got = sorted(table.select(F.xxhash64("__id").alias("h"), "toxic", "f", third.alias("third")).collect())
    x, y = np.array([r["f"] for r in got]), np.array([r["toxic"] for r in got], dtype=float)
    calibrates = np.array([r["third"] for r in got], dtype=bool)
    if len({*y[~calibrates]}) < 2 or len({*y[calibrates]}) < 2:
        calibrates = np.zeros(len(y), bool)
    model = boost(x[~calibrates], y[~calibrates])
    part = calibrates if calibrates.any() else ~calibrates
    weight = np.where(y == 1, shares[1] / max(1, (y == 1).sum()), shares[0] / max(1, (y == 0).sum()))
    model.steps, model.levels = isotonic(model.margin(x[part]), y[part], weight[part])
    model.learned = learned
    return model


def _feature_rows(batches: Iterable[pa.RecordBatch], learned: frozenset[str]) -> Iterator[pa.RecordBatch]:
    kinds = Kinds(learned)
    for batch in small_batches(batches):
        rows = [features(t.decode(), kinds) for t in texts(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("__id"), batch.column("toxic"), pa.array(rows, pa.list_(pa.float64()))], names=["__id", "toxic", "f"])


def score(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """docs with toxic_score (0 to 1) and toxic_predicted (1 from the threshold on)."""
    bound_batches(docs.sparkSession)
    docs = docs.drop("toxic_score", "toxic_predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField("toxic_score", T.DoubleType()), T.StructField("toxic_predicted", T.IntegerType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        kinds = Kinds(own.learned)
        for batch in small_batches(batches):
            x = np.array([features(t.decode(), kinds) for t in texts(batch.column(text_col))]).reshape(batch.num_rows, len(FEATURES))
            s = own.score(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=[*batch.schema.names, "toxic_score", "toxic_predicted"])

    return docs.mapInArrow(run, schema)
