"""Filing archives: ZIP files with markup in several encodings, read with the binaryFile source."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

ENCODINGS = ("utf-8", "euc-kr", "cp949")
#: Of a member, unpacked: what a task holds at once.
MOST_BYTES = 1 << 28
SCHEMA = "path string, member string, text string, reason string"


def decode(data: bytes) -> str:
    for name in ENCODINGS:
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", errors="ignore")


def main_member(names: dict[str, int], rcept_no: str | None = None) -> str | None:
    """The main document of an archive: the one named after the filing, else the largest."""
    markup = {n: size for n, size in names.items() if n.lower().endswith(".xml")}
    if not markup:
        return None
    if rcept_no and f"{rcept_no}.xml" in markup:
        return f"{rcept_no}.xml"
    if rcept_no and (plain := [n for n in markup if "_" not in n]):
        return plain[0]
    return max(markup, key=lambda n: (markup[n], n))


def open_archive(data: bytes, rcept_no: str | None = None, least: int = 0) -> tuple[str | None, str | None, str | None]:
    """Member, text and, where there is no text, the reason."""
    if len(data) < least:
        return None, None, "TOO_SMALL"
    if data[:2] != b"PK":
        return None, None, "NOT_AN_ARCHIVE"
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            sizes = {i.filename: i.file_size for i in z.infolist()}
            member = main_member(sizes, rcept_no)
            if not member:
                return None, None, "NO_MARKUP"
            if sizes[member] > MOST_BYTES:
                return None, None, "TOO_LARGE"
            return member, decode(z.read(member)), None
    except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError, OSError):
        return None, None, "BAD_ARCHIVE"


def read_archives(spark: SparkSession, path: str, least: int = 0, by_name: bool = False) -> DataFrame:
    """path, member, text, reason of each archive in a folder; failures are rows with a reason.

    by_name: the document named after the archive, or else one without an underscore, comes before the largest.
    """

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(p, *open_archive(bytes(c), p.rsplit("/", 1)[-1].removesuffix(".zip") if by_name else None, least)) for p, c in zip(frame["path"], frame["content"], strict=True)]
            yield pd.DataFrame(rows, columns=["path", "member", "text", "reason"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path)
    return files.select("path", "content").mapInPandas(run, SCHEMA)
