"""Language of whole texts: a bidirectional gated recurrent network over bytes, trained here in numpy.

Two recurrent passes, one from each side, read the bytes of a window; from both states every
position gets a probability of each language, and a document's probabilities are the means over
all its positions. Texts are read in windows of `core` bytes with `margin` bytes more on either side, whose states
warm up but aren't counted, so every byte of a text is labelled once and thousands of windows run
as one matrix product. Training is back-propagation through time with Adam, on a bounded sample:
`per_language` documents of each language, and at most four stretches of
each, all taken by a hash of the id.

Defined results: a null text, or one without letters, is `und` with the score 0; so is every text if
no labelled row could be learned from; repeated rows get the same result; columns of docs stay, but
ones named lang_pred or lang_score are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, materialize, small_batches, texts

STRETCH = 256
PAD = 0x20


@dataclass
class Model:
    """table (2, 256, 3h): what a byte adds to the gates; u (2, 3h, h), bias (2, h); out (2, languages, h), offset (languages)."""

    languages: list[str]
    table: np.ndarray
    u: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    offset: np.ndarray

    def weights(self) -> list[np.ndarray]:
        return [self.table, self.u, self.bias, self.out, self.offset]


def new_model(languages: list[str], hidden: int, rng: np.random.Generator) -> Model:
    normal = lambda scale, *shape: (rng.standard_normal(shape) * scale).astype(np.float32)
    return Model(languages, normal(0.3, 2, 256, 3 * hidden), normal(hidden**-0.5, 2, 3 * hidden, hidden), normal(0.0, 2, hidden), normal(0.3, 2, len(languages), hidden), normal(0.0, len(languages)))


def sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def both_ways(x: np.ndarray) -> np.ndarray:
    """Bytes (steps, windows) in the order that each direction reads them: (2, steps, windows)."""
    return np.stack([x, x[::-1]])


def gate_inputs(model: Model, x: np.ndarray) -> np.ndarray:
    """(2, 3h, steps, windows)."""
    return np.stack([np.take(np.ascontiguousarray(table.T), own, axis=1) for table, own in zip(model.table, both_ways(x), strict=True)])


def states(model: Model, x: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """States of both directions after each step, (steps, 2, h, windows); keep gets what back-propagation needs."""
    steps, n = x.shape
    h = model.u.shape[2]
    given = gate_inputs(model, x)
    out = np.empty((steps, 2, h, n), np.float32)
    state = np.zeros((2, h, n), np.float32)
    pre, change = np.empty((2, 3 * h, n), np.float32), np.empty((2, h, n), np.float32)
    bias = model.bias[:, :, None]
    for t in range(steps):
        np.matmul(model.u, state, out=pre)
        gates, inner = pre[:, : 2 * h], pre[:, 2 * h :]
        gates += given[:, : 2 * h, t]
        sigmoid(gates)
        z, r = gates[:, :h], gates[:, h:]
        inner += bias
        if keep is not None:
            keep[t] = (state, z.copy(), r.copy(), inner.copy())
        inner *= r
        inner += given[:, 2 * h :, t]
        new = np.tanh(inner, out=inner)
        if keep is not None:
            keep[t] += (new.copy(),)
        np.subtract(state, new, out=change)
        change *= z
        state = np.add(change, new, out=out[t])
    return out


def probabilities(model: Model, s: np.ndarray) -> np.ndarray:
    """(steps, languages, windows), each position by the states of both sides."""
    y = np.matmul(model.out[0], s[:, 0]) + np.matmul(model.out[1], s[::-1, 1]) + model.offset[:, None]
    y -= y.max(axis=1, keepdims=True)
    np.exp(y, out=y)
    y /= y.sum(axis=1, keepdims=True)
    return y


def gradients(model: Model, x: np.ndarray, mask: np.ndarray, label: np.ndarray) -> tuple[list[np.ndarray], float]:
    """Of the mean cross-entropy over all positions in mask, by back-propagation through time."""
    steps, n = x.shape
    h = model.u.shape[2]
    keep: dict = {}
    s = states(model, x, keep)
    p = probabilities(model, s)
    total = max(1.0, float(mask.sum()))
    picked = p[:, label, np.arange(n)]
    loss = float(-(np.log(np.maximum(picked, 1e-9)) * mask).sum() / total)
    p[:, label, np.arange(n)] -= 1
    p *= (mask / total)[:, None]
    back = s[::-1, 1]
    d_out = np.stack([np.einsum("tlb,thb->lh", p, s[:, 0]), np.einsum("tlb,thb->lh", p, back)])
    d_states = np.stack([np.matmul(model.out[0].T, p), np.matmul(model.out[1].T, p)[::-1]], axis=1)
    d_table, d_u, d_bias = (np.zeros_like(w) for w in (model.table, model.u, model.bias))
    two = both_ways(x)
    running = np.zeros((2, h, n), np.float32)
    for t in range(steps - 1, -1, -1):
        before, z, r, inner, new = keep[t]
        d = d_states[t] + running
        d_new = d * (1 - z) * (1 - new * new)
        d_z = d * (before - new) * z * (1 - z)
        d_r = d_new * inner * r * (1 - r)
        d_given = np.concatenate([d_z, d_r, d_new], axis=1)
        d_pre = np.concatenate([d_z, d_r, d_new * r], axis=1)
        d_u += np.matmul(d_pre, before.transpose(0, 2, 1))
        d_bias += (d_new * r).sum(axis=2)
        for k in (0, 1):
            np.add.at(d_table[k], two[k, t], d_given[k].T)
        running = d * z + np.matmul(model.u.transpose(0, 2, 1), d_pre)
    return [d_table, d_u, d_bias, d_out, p.sum(axis=(0, 2))], loss


def fit(stretches: list[bytes], labels: list[str], hidden: int = 8, steps: int = 64, batch: int = 128, rounds: int = 260, rate: float = 0.01, seed: int = 7) -> Model | None:
    """A model of labelled stretches of text; None without any."""
    languages = sorted({*labels})
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    model = new_model(languages, hidden, rng)
    of = np.array([languages.index(k) for k in labels])
    groups = [np.flatnonzero(of == k) for k in range(len(languages))]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in model.weights()]
    for i in range(1, rounds + 1):
        # all languages alike, however many documents they have
        rows = [rng.choice(groups[k]) for k in rng.integers(len(groups), size=batch)]
        x, mask = np.full((steps, batch), PAD, np.uint8), np.zeros((steps, batch), np.float32)
        for b, k in enumerate(rows):
            own = np.frombuffer(stretches[k], np.uint8)
            at = int(rng.integers(max(1, len(own) - steps + 1)))
            part = own[at : at + steps]
            x[: len(part), b], mask[: len(part), b] = part, 1
        found, _ = gradients(model, x, mask, of[rows])
        norm = np.sqrt(sum(float((g * g).sum()) for g in found))
        step = rate * min(1.0, 2 * (1 - i / (rounds + 1)))
        for w, g, (m, v) in zip(model.weights(), found, moments, strict=True):
            g = g * min(1.0, 1.0 / max(norm, 1e-9))
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= (step * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)).astype(np.float32)
    return model


def pooled(model: Model, rows: list[bytes], core: int = 192, margin: int = 16, at_once: int = 1024) -> np.ndarray:
    """Mean probabilities of each text over all its bytes: (texts, languages)."""
    lengths = np.array([len(x) for x in rows])
    span = core + 2 * margin
    wide = [np.frombuffer(bytes([PAD]) * margin + x + bytes([PAD]) * (core + margin), np.uint8) for x in rows]
    owner = np.repeat(np.arange(len(rows)), -(-lengths // core))
    first = np.concatenate([np.arange(0, n, core) for n in lengths]) if len(rows) else np.empty(0, int)
    sums = np.zeros((len(rows), len(model.languages)))
    place = np.arange(core)[:, None]
    for a in range(0, len(owner), at_once):
        who, at = owner[a : a + at_once], first[a : a + at_once]
        x = np.stack([wide[d][k : k + span] for d, k in zip(who, at, strict=True)], axis=1)
        s = states(model, x)
        p = probabilities(model, s)[margin : margin + core]
        inside = place < (lengths[who] - at)
        np.add.at(sums, who, np.einsum("tlb,tb->bl", p, inside.astype(np.float32)))
    return sums / np.maximum(lengths, 1)[:, None]


def train(docs: DataFrame, allowed: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 300, most_rows: int = 60_000, **how) -> Model | None:
    """A model of the labelled rows that `allowed` admits: up to `per_language` of each label, and about `most_rows` of all (4 of each label at least)."""
    rows = docs.where(allowed) if allowed is not None else docs
    rows = rows.where(F.col(lang_col).isNotNull() & (F.length(text_col) > 0))
    counts = materialize(rows.groupBy(F.col(lang_col).alias("__of")).agg(F.count(F.lit(1)).alias("__n")), "labels")
    take = max(4, min(per_language, most_rows // max(1, counts.count())))
    h = F.xxhash64(F.lit("language sample"), F.col(id_col))
    ids = rows.select(F.col(id_col).alias("__id"), F.col(lang_col).alias("__lang"), h.alias("h")).join(counts, F.col("__lang") == F.col("__of"))
    # a few times what is taken meets in a window, however frequent the label
    ids = ids.where((F.pmod("h", F.lit(1 << 40)) / float(1 << 40)) * F.col("__n") < 4 * take + 40)
    ids = ids.withColumn("k", F.row_number().over(Window.partitionBy("__lang").orderBy("h", "__id"))).where(F.col("k") <= take).select("__id", "__lang")
    parts = [F.substring(F.col(text_col), (F.pmod(F.xxhash64(F.lit(k), F.col(id_col)), F.greatest(F.lit(1), F.length(text_col) - STRETCH)) + 1).cast("int"), F.lit(STRETCH)) for k in range(4)]
    chosen = rows.join(F.broadcast(ids), (rows[id_col] == F.col("__id")) & (rows[lang_col] == F.col("__lang")))
    got = sorted({(r["__lang"], x) for r in chosen.select("__lang", F.array(*parts).alias("x")).collect() for x in r["x"]})
    return fit([x.encode() for _, x in got], [k for k, _ in got], **how)


def predict(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and lang_score, the mean probability of that language over all bytes."""
    bound_batches(docs.sparkSession)
    docs = docs.drop("lang_pred", "lang_score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in small_batches(batches, 4 << 20):
            rows = [*texts(batch.column(text_col))]
            known = np.array([own is not None and any(map(str.isalpha, x.decode())) for x in rows], dtype=bool)
            names, scores = np.full(len(rows), "und", dtype=object), np.zeros(len(rows))
            if known.any():
                p = pooled(own, [rows[k] for k in np.flatnonzero(known)])
                names[known] = np.array(own.languages, dtype=object)[p.argmax(axis=1)]
                scores[known] = np.clip(p.max(axis=1), 0, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names.tolist(), pa.string()), pa.array(scores)], names=[*batch.schema.names, "lang_pred", "lang_score"])

    return docs.mapInArrow(run, schema)
