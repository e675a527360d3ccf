"""WARC archives: round trips, revisits, the format's frames, lookups, and files that no index names."""

import glob
import hashlib
import io
import struct
from collections import Counter

import pytest
import zstandard

from panelweave.llm import warc

SHARED = "<p>the same page</p>" * 100
ROWS = [(i, f"http://a.example/{i}", f"<html><body><h1>page {i}</h1>" + f"<p>word {i * 7 % 13} and more text</p>" * (20 + i % 60) + "</body></html>") for i in range(200)]
ROWS += [(300 + i, f"http://b.example/{i}?q=a b%20\r\nX: y", SHARED) for i in range(40)]
ROWS += [(400, None, None), (401, "http://c.example/é", ""), (402, "u", "short"), (403, "u", "short"), (None, "http://d.example/", SHARED), (None, None, "no id" * 300), (None, None, "no id" * 300), (339, "http://b.example/39", SHARED), (500, "http://long.example/", "é" * 3_000_000)]
SCHEMA = "page_id long, url string, html string"


def want(rows):
    out = Counter()
    for i, _, h in rows:
        raw = (h or "").encode()
        others = [j for j, _, x in rows if (x or "").encode() == raw and j is not None]
        again = len(raw) >= 1000 and bool(others) and (i is None or i < max(others))
        out[i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", max(others) if again else None] += 1
    return out


COLUMNS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('warc')}/store"
    pages = spark.createDataFrame([(*r, "clash", 0) for r in ROWS], f"{SCHEMA}, record_type string, salt int").repartition(3)
    warc.write(pages, path, archive_bytes=20_000)
    return path


def test_round_trip(spark, store):
    rows = warc.read(spark, store).collect()
    assert Counter(tuple(r[c] for c in COLUMNS) for r in rows) == want(ROWS)
    assert Counter((r["page_id"], r["url"], r["html"]) for r in rows if r["record_type"] == "response" and r["page_id"] is not None) <= Counter((i, u, h or "") for i, u, h in ROWS)
    assert Counter(r["url"] for r in rows) == Counter(u for _, u, _ in ROWS)


def test_frames(store):
    """A skippable frame with the dictionary leads each archive; then every record is a frame of its own, and needs the dictionary."""
    archives = glob.glob(store.removeprefix("file://") + "/archives/*.warc.zst")
    assert len(archives) > 1
    for path in archives:
        data = open(path, "rb").read()
        magic, size = struct.unpack("<II", data[:8])
        assert magic == 0x184D2A5D
        known = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8 : 8 + size]))
        rest, records = data[8 + size :], 0
        while rest:
            one = zstandard.ZstdDecompressor(dict_data=known).decompressobj()
            record = one.decompress(rest)
            assert one.eof and record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
            assert len(list(warc.parsed(io.BytesIO(record)))) == 1
            rest, records = one.unused_data, records + 1
        assert records and known.dict_id()
        with pytest.raises(zstandard.ZstdError):
            zstandard.ZstdDecompressor().decompress(data[8 + size :], max_output_size=1 << 24)


def test_dictionary_pays(spark, store, tmp_path):
    size = lambda at: sum(len(open(f, "rb").read()) for f in glob.glob(at.removeprefix("file://") + "/archives/*"))
    one, none = f"file://{tmp_path}/one", f"file://{tmp_path}/none"
    pages = spark.createDataFrame(ROWS[:200], SCHEMA)
    warc.write(pages.coalesce(1), one)
    warc.write(pages.coalesce(1), none, sample=0)
    assert size(one) < size(none)
    assert Counter(tuple(r[c] for c in COLUMNS) for r in warc.read(spark, none).collect()) == want(ROWS[:200])


def test_lookup(spark, store):
    got = {r["page_id"]: r for r in warc.lookup(spark, store, [5, 301, 339, 500, 9999]).collect()}
    assert set(got) == {5, 301, 339, 500}
    assert got[5]["html"] == ROWS[5][2] and got[301]["refers_to"] == 339 and got[301]["html"] is None and got[500]["payload_bytes"] == 6_000_000


def test_unnamed_files_dont_count(spark, store):
    """What a lost task left is in no index, so it is not read."""
    folder = store.removeprefix("file://") + "/archives"
    with open(f"{folder}/000000-999-lost.warc.zst", "wb") as f:
        f.write(b"half a record")
    assert warc.read(spark, store).count() == len(ROWS)


def test_a_changed_archive_is_noticed(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    warc.write(spark.createDataFrame(ROWS[:40], SCHEMA).coalesce(1), path, sample=0)
    (archive,) = glob.glob(f"{tmp_path}/store/archives/*")
    plain = zstandard.ZstdDecompressor().stream_reader(open(archive, "rb"), read_across_frames=True).read()
    with open(archive, "wb") as f:
        f.write(zstandard.ZstdCompressor().compress(plain.replace(b"page 7<", b"page 8<")))
    with pytest.raises(Exception, match="not the one that was archived"):
        warc.read(spark, path).collect()


def test_other_ids_and_empty(spark, tmp_path):
    rows = [("a:1\r\nX", "u", "p" * 2000), ("b", None, "p" * 2000), ("", "u", "q")]
    warc.write(spark.createDataFrame(rows, "page_id string, url string, html string"), f"file://{tmp_path}/s")
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.read(spark, f"file://{tmp_path}/s").collect()}
    assert got == {"a:1\r\nX": ("revisit", "b"), "b": ("response", None), "": ("response", None)}
    warc.write(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/none")
    assert warc.read(spark, f"file://{tmp_path}/none").count() == 0 and warc.lookup(spark, f"file://{tmp_path}/none", [1]).count() == 0
