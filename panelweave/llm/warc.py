"""WARC archives of pages, each record a Zstandard frame of its own under one dictionary in a leading skippable frame.

A write is one pass over the pages: payloads of `min_bytes` or more that several pages share are found
by their SHA-256 (of these the greatest id is the response, the others revisit it), a bounded sample
of the records themselves trains the dictionary, and every task writes archives of its own. A record is
compressed alone, so the index that a write leaves (a Parquet row per record: id, archive, offset,
length) lets a lookup decompress one frame; a scan streams archives and needs no index but their names.

An archive counts once its task's index rows are committed. A lost or repeated task leaves files
that no row names, and its next try writes under other names, so nothing is read twice or half.

Pages meet the groups of equal payloads by digest and a salt of their id, so a payload that a third of
the pages share is spread over tasks; the groups have a row per salt that occurs.

Defined results: a null html is an empty payload and reads back as empty; a null id is written without its header, revisits any other
id of its group, and is a response where its group has none; rows that share the greatest id of a
group are all responses; a null url has no header, and control characters, blanks and % in one are
escaped; where too few records for a dictionary exist, archives have none; other columns aren't
written; a record is held in memory as a whole; an empty table leaves an empty index and no archive.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterable, Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, small_batches

#: Magic numbers of the skippable frame that holds a dictionary, and of a compressed frame.
DICTIONARY_FRAME, ZSTD_FRAME = 0x184D2A5D, 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SALTS = 1024
#: A dictionary needs so many records at least.
LEAST_SAMPLE = 16
#: A scan has a task per archive, up to so many.
MOST_TASKS = 100_000
INDEX = "page_id {id}, archive string, offset bigint, length bigint"


def marked(pages: DataFrame, min_bytes: int = 1000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, html, and refers_to: for a page whose payload a greater id has too, the greatest such id."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    digest = F.when(F.octet_length("html") >= min_bytes, F.unhex(F.sha2("html", 256)))
    rows = rows.withColumn("digest", digest).withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    by_salt = rows.where("digest is not null").groupBy("digest", "salt").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n"))
    groups = by_salt.groupBy("digest").agg(F.max("last").alias("last"), F.sum("n").alias("n"), F.collect_list("salt").alias("salts")).where("n > 1 and last is not null")
    # hashed, for a row of the groups is a hundredth of a page: pages needn't be sorted
    joined = rows.join(groups.select("digest", F.explode("salts").alias("salt"), "last").hint("shuffle_hash"), ["digest", "salt"], "left")
    again = F.col("last").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("last")))
    return joined.select("page_id", "url", F.when(~again, F.col("html")).alias("html"), F.octet_length("html").cast("bigint").alias("payload_bytes"), F.when(again, F.col("last")).alias("refers_to"), F.when(again, F.sha1("html")).alias("sha1"))


def record_id(page_id: object, sha1: str, kind: str = "response") -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind}:{page_id}:{sha1}').urn}>"


def record(page_id: object, url: str | None, payload: bytes | None, payload_bytes: int, refers_to: object, sha1: str | None, date: str) -> bytes:
    """One WARC record; without a payload, a revisit of refers_to."""
    kind = "response" if payload is not None else "revisit"
    sha1 = hashlib.sha1(payload).hexdigest() if payload is not None else sha1
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    fields = [("WARC-Type", kind), ("WARC-Record-ID", record_id(page_id, sha1, kind if kind == "response" else f"{kind}:{url}")), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="!#$&'()*+,/:;=?@[]~")))
    fields += [("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode()), ("Content-Type", "application/http; msgtype=response")]
    if page_id is not None:
        fields.append(("X-Page-Id", quote(str(page_id))))
    if kind == "revisit":
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, sha1)), ("X-Refers-To-Page-Id", quote(str(refers_to)))]
    fields.append(("Content-Length", str(len(head) + len(payload or b""))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + head + (payload or b"") + b"\r\n\r\n"


def records(batch: pa.RecordBatch, date: str) -> Iterator[tuple[object, bytes]]:
    """Id and record of each row of marked()."""
    html = batch.column("html").cast(pa.large_binary())
    columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "payload_bytes", "refers_to", "sha1")]
    for i, (page_id, url, n, refers_to, sha1) in enumerate(zip(*columns, strict=True)):
        yield page_id, record(page_id, url, html[i].as_py(), n, refers_to, sha1, date)


def dictionary(pages: DataFrame, date: str, sample: int, sample_bytes: int, size: int) -> bytes:
    """A Zstandard dictionary of records of the pages with the `sample` least hashes, at most sample_bytes of each; b"" for too few."""
    if not sample or not (n := pages.count()):
        return b""
    # hashes below this are some more than the sample, whatever the number of tasks, each of which would send as many otherwise
    below = min(2.0, 2.4 * sample / n) * 2**62
    order = F.abs(F.shiftright(F.xxhash64("page_id", "url"), 1))
    picked = pages.select("page_id", "url", F.coalesce("html", F.lit("")).substr(1, sample_bytes).alias("html"), order.alias("order")).where(F.col("order") <= F.lit(below))
    # the driver holds sample * sample_bytes bytes at most
    picked = picked.orderBy("order", "page_id", "url").limit(sample)
    rows = [record(r["page_id"], r["url"], p := r["html"].encode()[:sample_bytes], len(p), None, None, date) for r in picked.collect()]
    if len(rows) < LEAST_SAMPLE:
        return b""
    try:
        return zstandard.train_dictionary(min(size, sum(map(len, rows)) // 8), rows).as_bytes()
    except zstandard.ZstdError:  # the records have too little in common, or too little at all
        return b""


def leading_frame(dictionary: bytes) -> bytes:
    """The skippable frame of an archive: its dictionary, compressed."""
    packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
    return struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed


def stored_dictionary(file: io.IOBase) -> zstandard.ZstdCompressionDict | None:
    """The dictionary at the start of an archive; the file is left behind it, or at 0 where there is none."""
    head = file.read(8)
    if len(head) < 8 or (frame := struct.unpack("<II", head))[0] != DICTIONARY_FRAME:
        file.seek(0)
        return None
    held = file.read(frame[1])
    if struct.unpack_from("<I", held)[0] == ZSTD_FRAME:
        held = zstandard.ZstdDecompressor().decompress(held)
    return zstandard.ZstdCompressionDict(held)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address that driver and executors share, and the path in it."""
    return fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")


def write(pages: DataFrame, path: str, min_bytes: int = 1000, date: str = "1970-01-01T00:00:00Z", level: int = 3, archive_bytes: int = 256 << 20, sample: int = 1000, sample_bytes: int = 16 << 10, dictionary_bytes: int = 64 << 10, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Writes archives of about archive_bytes at most under path/archives, and their index under path/index.

    The dictionary is learned from at most `sample` records and `sample_bytes` of each; every page is written whole.
    """
    spark = pages.sparkSession
    bound_batches(spark)
    named = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    trained = spark.sparkContext.broadcast(dictionary(named, date, sample, sample_bytes, dictionary_bytes))
    folder = f"{path.rstrip('/')}/archives"
    schema = INDEX.format(id=named.schema["page_id"].dataType.simpleString())

    def archive(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = opened(folder)
        known = zstandard.ZstdCompressionDict(trained.value) if trained.value else None
        if known:
            known.precompute_compress(level)
        lead = leading_frame(trained.value) if trained.value else b""
        compressor = zstandard.ZstdCompressor(level=level, dict_data=known)
        task = TaskContext.get()
        out, name, offset = None, "", 0
        try:
            for batch in small_batches(batches):
                ids, names, offsets, lengths = [], [], [], []
                for page_id, raw in records(batch, date):
                    if out is not None and offset >= archive_bytes:
                        out.close()
                        out = None
                    if out is None:
                        store.create_dir(at, recursive=True)
                        name = f"{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:12]}.warc.zst"
                        out = store.open_output_stream(f"{at}/{name}", compression=None)
                        out.write(lead)
                        offset = len(lead)
                    frame = compressor.compress(raw)
                    out.write(frame)
                    ids.append(page_id)
                    names.append(name)
                    offsets.append(offset)
                    lengths.append(len(frame))
                    offset += len(frame)
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field("page_id").type), pa.array(names, pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], names=["page_id", "archive", "offset", "length"])
        finally:
            # the rows of an archive are committed when the task ends, and so after this
            if out is not None:
                out.close()

    marked(named, min_bytes).mapInArrow(archive, schema).write.parquet(f"{path.rstrip('/')}/index")


def parsed(file: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields and block of each record of a decompressed archive."""
    while first := file.readline():
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no record where one should begin: {first[:40]!r}")
        fields = {}
        while (line := file.readline().rstrip(b"\r\n")):
            k, _, v = line.decode().partition(":")
            fields[k.lower()] = v.strip()
        block = file.read(n := int(fields["content-length"]))
        if len(block) < n or file.read(4) != b"\r\n\r\n":
            raise ValueError("a record ends early")
        yield fields, block


def page_of(fields: dict[str, str], block: bytes) -> dict:
    """What a record says of its page; a response's digest is that of its bytes, and has to be the one it names."""
    head, _, payload = block.partition(b"\r\n\r\n")
    said = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    length = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    kind = fields["warc-type"]
    plain = lambda k: unquote(fields[k]) if k in fields else None
    if kind == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != said):
        raise ValueError(f"the payload of {fields['warc-record-id']} is not the one that was archived")
    return {
        "page_id": plain("x-page-id"),
        "url": plain("warc-target-uri"),
        "record_type": kind,
        "payload_bytes": length,
        "payload_digest": said,
        "refers_to": plain("x-refers-to-page-id"),
        "html": payload if kind == "response" else None,
    }


def _decoded(rows: list[dict], fields: pa.Schema) -> pa.RecordBatch:
    as_text = pa.schema([pa.field(f.name, pa.string() if f.name in ("page_id", "refers_to") else pa.binary() if f.name == "html" else f.type) for f in fields])
    batch = pa.RecordBatch.from_pylist(rows, as_text)
    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.columns, fields, strict=True)], schema=fields)


def _pages(index: DataFrame) -> tuple[str, pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    of_id = index.schema["page_id"].dataType
    kinds = {"page_id": of_id, "url": StringType(), "record_type": StringType(), "payload_bytes": LongType(), "payload_digest": StringType(), "refers_to": of_id, "html": StringType()}
    schema = StructType([StructField(k, v) for k, v in kinds.items()])
    return schema, to_arrow_schema(schema)


def read(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, record_type, payload_bytes, payload_digest, refers_to and html (null for revisits) of every record, streamed from the archives.

    Each archive has to hold as many records as its index names.
    """
    index = spark.read.parquet(f"{path.rstrip('/')}/index")
    folder = f"{path.rstrip('/')}/archives"
    schema, fields = _pages(index)
    archives = index.groupBy("archive").agg(F.count(F.lit(1)).alias("n"))
    archives = archives.repartition(min(max(archives.count(), 1), MOST_TASKS))

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = opened(folder)
        for batch in batches:
            for name, n in zip(batch.column("archive").to_pylist(), batch.column("n").to_pylist(), strict=True):
                with store.open_input_file(f"{at}/{name}") as file:
                    unpacked = zstandard.ZstdDecompressor(dict_data=stored_dictionary(file)).stream_reader(file, read_across_frames=True)
                    rows, held, found = [], 0, 0
                    for fields_of, block in parsed(io.BufferedReader(unpacked, 1 << 18)):
                        rows.append(page_of(fields_of, block))
                        held, found = held + len(block), found + 1
                        if held > 4 << 20:
                            yield _decoded(rows, fields)
                            rows, held = [], 0
                    if found != n:
                        raise ValueError(f"{name} holds {found} records of {n}")
                    yield _decoded(rows, fields)

    return archives.mapInArrow(scan, schema)


def lookup(spark: SparkSession, path: str, page_ids: list) -> DataFrame:
    """The columns of read() for these pages: of each archive its dictionary, and one frame per record."""
    index = spark.read.parquet(f"{path.rstrip('/')}/index").where(F.col("page_id").isin(page_ids))
    folder = f"{path.rstrip('/')}/archives"
    schema, fields = _pages(index)

    def fetch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = opened(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(f"{at}/{row['archive']}") as file:
                    unpack = zstandard.ZstdDecompressor(dict_data=stored_dictionary(file))
                    file.seek(row["offset"])
                    raw = unpack.decompress(file.read(row["length"]))
                yield _decoded([page_of(*next(parsed(io.BytesIO(raw))))], fields)

    return index.mapInArrow(fetch, schema)
