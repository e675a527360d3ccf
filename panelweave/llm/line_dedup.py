"""Lines that many documents share, found with a once-seen and a twice-seen Bloom filter.

A line's key is the line without white space at both ends, A-Z in lower case. Each task sets the
bits of its keys in a filter of keys seen, and in a second filter the bits of keys that an earlier
document of the task had. Two tasks' filters merge as counters that stop at two: a bit is in the
merged second filter if it is in either one's, or in the first filter of both. So a key of two
documents always passes the second filter, and nearly all others don't. Only keys that pass are
counted: each task sends a key once with the number of its documents that have it and the first of
these, so a key that all documents have is as cheap as any; the counts are exact.

The filters grow with the number of lines up to `most_bits` each (2 ** 28: 32 MB), which bounds the broadcast. Beyond
some 100 million lines more keys pass and more is shuffled; the result is the same. The repeated
keys are broadcast only up to `most_broadcast` bytes, else joined.

Defined results: null text is one empty line; empty keys (fewer than min_chars code points) are
kept; equal rows are documents of their own in the counts; other columns pass through unchanged;
an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, materialize, small_batches, texts

SEGMENT = 1 << 16
PROBES = 3


def line_keys(text: bytes, min_chars: int) -> list[bytes]:
    """Keys of all lines, b"" for lines that no rule touches. ASCII white space and A-Z are all that bytes methods strip and lower."""
    keys = [x.strip().lower() for x in text.split(b"\n")]
    return keys if min_chars <= 1 else [k if len(k) >= min_chars and len(k.decode()) >= min_chars else b"" for k in keys]


def places(keys: Iterable[bytes], bits: int) -> np.ndarray:
    """The bits of each key, a row each."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), dtype=np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return (h[:, None] + step[:, None] * np.arange(PROBES, dtype=np.uint64)) & np.uint64(bits - 1)


def has(filter_: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((filter_[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


def put(filter_: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(filter_, (at >> np.uint64(3)).ravel(), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8)).ravel())


def twice_seen(docs: DataFrame, text_col: str, min_chars: int, most_bits: int) -> tuple[np.ndarray, int]:
    """The merged second filter, and its number of bits."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = docs.agg(F.sum(F.regexp_count(text, F.lit("\n")) + 1)).first()[0] or 0
    bits = min(most_bits, 1 << max(SEGMENT.bit_length() + 2, int(16 * lines).bit_length()))

    def fill(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in small_batches(batches):
            keys = [k for t in texts(batch.column(0)) for k in {*line_keys(t, min_chars)} if k]
            if keys:
                for at in (lambda x: (x[i : i + 512] for i in range(0, len(x), 512)))(places(keys, bits)):
                    # within a slice, equal keys count as seen too
                    _, first, back = np.unique(at[:, 0] ^ (at[:, 1] << np.uint64(32)), return_index=True, return_inverse=True)
                    again = np.arange(len(at)) != first[back]
                    put(twice, at[again | has(once, at)])
                    put(once, at)
        for k in range(0, bits // 8, SEGMENT):
            a, b = once[k : k + SEGMENT], twice[k : k + SEGMENT]
            if a.any():
                yield pa.RecordBatch.from_arrays([pa.array([k // SEGMENT]), pa.array([zlib.compress(a.tobytes(), 1)]), pa.array([zlib.compress(b.tobytes(), 1)])], names=["k", "once", "twice"])

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in small_batches(batches):
            for k, a, b in zip(batch.column("k").to_pylist(), batch.column("once"), batch.column("twice"), strict=True):
                once, twice = own.setdefault(k, (np.zeros(SEGMENT, np.uint8), np.zeros(SEGMENT, np.uint8)))
                a, b = (np.frombuffer(zlib.decompress(x.as_buffer()), np.uint8) for x in (a, b))
                twice[: len(a)] |= b | (once[: len(a)] & a)
                once[: len(a)] |= a
        for k, (_, twice) in own.items():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([twice.tobytes()])], names=["k", "twice"])

    # compressed here: a few MB of shuffled parts, which a task reads at a time, would be tens of MB of nearly empty filters else
    parts = docs.select(text_col).mapInArrow(fill, "k bigint, once binary, twice binary").repartition("k")
    out = np.zeros(bits // 8, np.uint8)
    for r in parts.mapInArrow(merge, "k bigint, twice binary").collect():  # most_bits at most, in one job
        out[r["k"] * SEGMENT : (r["k"] + 1) * SEGMENT] = np.frombuffer(r["twice"], np.uint8)[: len(out) - r["k"] * SEGMENT]
    return out, bits


def repeated_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, most_bits: int = 1 << 28) -> DataFrame:
    """key, n_docs, first_doc of keys that min_docs documents or more have, as a written table."""
    sc = docs.sparkSession.sparkContext
    id_type = docs.schema[id_col].dataType
    filter_, bits = twice_seen(docs, text_col, min_chars, most_bits)
    shared = sc.broadcast(filter_)

    def suspects(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, list] = {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([*seen], pa.binary()), pa.array([x[0] for x in seen.values()], pa.int64()), pa.array([x[1] for x in seen.values()], ids.type)], names=["key", "n", "first_doc"])
            seen.clear()
            return out

        for batch in small_batches(batches):
            ids = batch.column(0)
            owners, keys = [], []
            for doc, t in zip(ids.to_pylist(), texts(batch.column(1)), strict=True):
                own = {*line_keys(t, min_chars)} - {b""}
                keys.extend(own)
                owners.extend([doc] * len(own))
            if keys:
                for k in np.flatnonzero(has(shared.value, places(keys, bits))).tolist():
                    x = seen.setdefault(keys[k], [0, owners[k]])
                    x[0] += 1
                    if owners[k] is not None and (x[1] is None or owners[k] < x[1]):
                        x[1] = owners[k]
            if len(seen) > 100_000:
                yield flush()
        if seen:
            yield flush()

    found = docs.select(id_col, text_col).mapInArrow(suspects, f"key binary, n bigint, first_doc {id_type.simpleString()}")
    counts = found.groupBy("key").agg(F.sum("n").alias("n_docs"), F.min("first_doc").alias("first_doc"))
    return materialize(counts.where(F.col("n_docs") >= min_docs), "repeated")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, keep: str = "first", most_bits: int = 1 << 28, most_broadcast: int = 32 << 20) -> DataFrame:
    """docs with the repeated lines out of the text, and n_lines (before) and n_dropped.

    keep: "first" leaves a repeated line at its first place in the document of the smallest id that has it,
    "none" leaves it nowhere. Columns of docs named n_lines or n_dropped are replaced.
    """
    if keep not in ("first", "none"):
        raise ValueError(f"keep must be 'first' or 'none', not {keep!r}")
    sc = docs.sparkSession.sparkContext
    bound_batches(docs.sparkSession)
    docs = docs.drop("n_lines", "n_dropped")
    repeated = repeated_keys(docs, id_col, text_col, min_docs, min_chars, most_bits)
    size = repeated.agg(F.sum(F.length("key") + F.lit(120))).first()[0] or 0
    schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    schema[text_col].nullable = True
    if size <= most_broadcast:
        everywhere = sc.broadcast({bytes(r[0]): r[1] for r in repeated.select("key", "first_doc").collect()})
        return docs.mapInArrow(lambda batches: _drop(batches, id_col, text_col, min_chars, keep, schema.names, lambda batch: (everywhere.value,) * batch.num_rows), schema)
    # too many keys: each document gets those of its own lines that are repeated
    pairs = materialize(docs.select(id_col, text_col).mapInArrow(lambda batches: _own_keys(batches, min_chars), f"__id {docs.schema[id_col].dataType.simpleString()}, key binary"), "pairs")
    own = pairs.join(repeated.select("key", "first_doc"), "key").groupBy("__id").agg(F.collect_list(F.struct("key", "first_doc")).alias("__keys"))
    joined = docs.join(own, docs[id_col].eqNullSafe(own["__id"]), "left").drop("__id")

    def own_maps(batch: pa.RecordBatch) -> Iterator[dict]:
        return ({x["key"]: x["first_doc"] for x in row or ()} for row in batch.column("__keys").to_pylist())

    return joined.mapInArrow(lambda batches: _drop(batches, id_col, text_col, min_chars, keep, schema.names, own_maps), schema)


def _own_keys(batches: Iterable[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        rows, keys = [], []
        for k, t in enumerate(texts(batch.column(1))):
            own = {*line_keys(t, min_chars)} - {b""}
            rows.extend([k] * len(own))
            keys.extend(own)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(keys, pa.binary())], names=["__id", "key"])


def _drop(batches: Iterable[pa.RecordBatch], id_col: str, text_col: str, min_chars: int, keep: str, names: list[str], maps: Callable) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        kept, lines, dropped = [], [], []
        for doc, text, repeated in zip(batch.column(id_col).to_pylist(), texts(batch.column(text_col)), maps(batch), strict=True):
            raw, keys = text.split(b"\n"), line_keys(text, min_chars)
            out, had = [], set()
            for line, key in zip(raw, keys, strict=True):
                if key and key in repeated and (keep == "none" or repeated[key] != doc or key in had):
                    continue
                had.add(key)
                out.append(line)
            kept.append(b"\n".join(out))
            lines.append(len(raw))
            dropped.append(len(raw) - len(out))
        by_name = {n: batch.column(n) for n in names if n in batch.schema.names}
        by_name |= {text_col: pa.array(kept, pa.binary()).cast(pa.string()), "n_lines": pa.array(lines, pa.int64()), "n_dropped": pa.array(dropped, pa.int64())}
        yield pa.RecordBatch.from_arrays([by_name[n] for n in names], names=names)
