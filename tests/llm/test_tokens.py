"""Token store and packing: exact round trips."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from panelweave.llm import packing, token_store, tokens
from panelweave.llm.common import scratch_path

TEXTS = [None, "", " ", "Hello, world.\nNext line.", "two  spaces and\ttab", "trailing space \nline", "déjà vu où; ça? «x»", "it's we'll 12 345 3.14", "<|endoftext|> is a token", "a <|endoftext|>, b<|endoftext|>.\nc\n<|endoftext|>d", "x  <|endoftext|> \n y", "<|endoftext|", "<|ENDOFTEXT|>", "a\n\nb\n", " nbsp em", "x" * 300, "word " * 3000, "日本語 テキスト。", "A.B,C;D !! (ok)", "\x1c odd \x85 y", "é combining", "don't.'s 's"]
SCHEMA = "doc_id long, text string, ids string, n_tokens string"


def reference():
    t = Tokenizer.from_file(public_tokenizers.path(tokens.VOCABULARY))
    return lambda x: np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], dtype="<u4")


def table(spark):
    rows = [(k * 3 % 50, t, "clash", None) for k, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows + [(None, "no id", "", ""), rows[3]], SCHEMA), rows


def test_encoder_is_exact():
    encode, own = reference(), tokens.Encoder(tokens.read_vocabulary())
    for _ in range(2):  # cold and warm
        for t in TEXTS:
            assert own.encode((t or "").encode()).tolist() == encode(t)[:-1].tolist(), t


def test_store_round_trip(spark):
    docs, rows = table(spark)
    path = scratch_path(spark, "tokens")
    token_store.write(docs, path)
    stored = token_store.read(spark, path)
    encode = reference()
    by_id = defaultdict(list)
    for i, t in [(r[0], r[1]) for r in rows] + [(None, "no id"), (rows[3][0], rows[3][1])]:
        by_id[i].append(encode(t))
    got = token_store.with_starts(token_store.checksums(stored), stored).orderBy("row_no").collect()
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x))
    at = 0
    for r in got:
        assert r["start"] == at
        assert (r["n_tokens"], r["ids_crc32"]) in [(len(x), zlib.crc32(x.tobytes())) for x in by_id[r["doc_id"]]]
        at += r["n_tokens"]
    one = token_store.read(spark, path, [9])
    assert [np.array(r["ids"]).tolist() for r in one.collect()] == [x.tolist() for x in by_id[9]]
    assert "In(doc_id" in one._jdf.queryExecution().toString() or "EqualTo(doc_id" in one._jdf.queryExecution().toString()


def test_store_of_nothing(spark):
    path = scratch_path(spark, "none")
    token_store.write(table(spark)[0].where("doc_id = -1"), path)
    stored = spark.read.schema("row_no long, doc_id long, n_tokens int, ids array<int>").orc(path)
    assert token_store.with_starts(token_store.checksums(stored), stored).count() == 0


def test_pieces_and_sequences(spark):
    docs, rows = table(spark)
    pieces, places = packing.pack(docs, capacity=64)
    got = pieces.join(places, "piece_id").collect()
    encode = reference()
    want = sorted(encode(t).tobytes() for t in [r[1] for r in rows] + ["no id", rows[3][1]])
    by_start, whole = sorted(got, key=lambda r: r["piece_id"]), []
    for r in by_start:
        if r["piece"] == 0:
            whole.append(b"")
            assert r["start"] == 0
        else:
            assert r["length"] == 64 and r["start"] == len(whole[-1]) // 4
        whole[-1] += bytes(r["ids"])
    assert sorted(whole) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 64
    packed = packing.sequences(pieces, places).collect()
    assert sum(r["length"] for r in packed) == sum(r["length"] for r in got)
    assert all(len(r["ids"]) == 4 * r["length"] for r in packed)


def test_groups_are_packed_level_by_level(spark):
    rng = np.random.default_rng(5)
    lengths = rng.integers(1, 1024, 4000)
    pieces = spark.createDataFrame([(i, int(n)) for i, n in enumerate(lengths)], "piece_id long, length int")
    got = packing.place(pieces, 1024, group_pieces=500).join(pieces, "piece_id").collect()
    assert len(got) == 4000
    fill = defaultdict(int)
    for r in got:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 1024
    assert len(fill) <= 1.02 * lengths.sum() / 1024


def test_long_pieces_stay_in_their_groups(spark, monkeypatch):
    """Lengths of which no two fit together are packed once, in groups of the size asked for."""
    written = []
    real = packing.materialize
    monkeypatch.setattr(packing, "materialize", lambda df, name: written.append(real(df, name)) or written[-1])
    pieces = spark.range(6000).selectExpr("id as piece_id", "cast(600 as int) as length")
    got = packing.place(pieces, 1024, group_pieces=500).collect()
    assert len({r["sequence_id"] for r in got}) == 6000 and {r["offset"] for r in got} == {0}
    assert len(written) == 1
    assert max(r["count"] for r in written[0].groupBy("g").count().collect()) < 1000


def test_packing_of_nothing(spark):
    pieces, places = packing.pack(table(spark)[0].where("doc_id = -1"))
    assert pieces.count() == places.count() == 0
