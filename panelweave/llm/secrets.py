"""Secrets in whole texts: patterns for the plain kinds, structure for keys and signed tokens.

Three kinds are found by pattern alone: an assignment to a password-like name, an access key id,
and a long run of hex digits. Others are reported only when their content confirms them: a base64
or hex run is decoded and must parse, to its last byte and with every nested length right, as a
private key (DER shapes of PKCS#1, PKCS#8, SEC1, DSA and encrypted PKCS#8, or the length-prefixed
OpenSSH container), or as the text of a PEM block, in either base64 alphabet; a PEM block must hold one, or the whole cipher
blocks of a legacy encrypted one. Runs may be wrapped over lines, indented or quoted ones too, amid other lines of their kind: a key may begin
each line, and ends at a line's end where its own lengths say; a signed token must have a JSON header that names its
algorithm, and a JSON payload.

Spans count code points, end exclusive. Defined results: a null or empty text has none; a very long text is scanned whole, in linear time;
repeated rows have the same ones; spans that begin together are in the order of KINDS; columns of docs stay, but one named `spans` is replaced;
an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import bound_batches, small_batches, texts

KINDS = ("assign", "access", "hex", "jwt", "pem", "der", "ssh")
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
SIGNED = re.compile(r"(?<![A-Za-z0-9_-])ey[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]*")
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}PRIVATE KEY)-----")
#: A run of base64 of either alphabet; full lines may follow each other, and a last short one.
LINE = "[A-Za-z0-9+/_-]"
#: Between two lines of a run, which may be quoted or indented.
BREAK = r"""["',\\\x20\t]{0,8}\r?\n[\x20\t"'>|#]{0,40}"""
BASE64 = re.compile(rf"(?<!{LINE}){LINE}{{44,}}(?:=?=?{BREAK}{LINE}{{44,}})*(?:=?=?{BREAK}{LINE}{{1,76}})?={{0,2}}")
LONG_HEX = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{80,}")
HEX_LINES = re.compile(rf"(?<![0-9A-Fa-f])[0-9A-Fa-f]{{32,}}(?:{BREAK}[0-9A-Fa-f]{{32,}})*{BREAK}[0-9A-Fa-f]+")
LETTERS, PADDING, DIGITS = re.compile(rf"{LINE}+"), re.compile("={0,2}"), re.compile("[0-9A-Fa-f]+")
#: Bytes of a key amid other lines, at most; a run that is a key as a whole may be longer.
LONGEST = 1 << 16
ENCRYPTED = re.compile(r"\s*Proc-Type:\s*4,ENCRYPTED\s+DEK-Info:\s*[A-Z0-9-]+,[0-9A-Fa-f]+\s")
INTEGER, OCTETS, OID, SEQUENCE = 0x02, 0x04, 0x06, 0x30


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """Tags and contents of the values that make up data to the last byte; None where a length doesn't fit."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, n, at = data[at], data[at + 1], at + 2
        if n >= 0x80:
            width = n & 0x7F
            if not 1 <= width <= 4 or at + width > len(data):
                return None
            n = int.from_bytes(data[at : at + width], "big")
            if n < 0x80 or n >> 8 * (width - 1) == 0:
                return None  # DER asks for the shortest form
            at += width
        if at + n > len(data):
            return None
        out.append((tag, data[at : at + n]))
        at += n
    return out


def is_private_der(data: bytes) -> bool:
    """Whether data is one DER value with the shape of a private key."""
    outer = der_items(data)
    if not outer or len(outer) != 1 or outer[0][0] != SEQUENCE:
        return False
    parts = der_items(outer[0][1])
    if not parts or any(t == INTEGER and not v for t, v in parts):
        return False
    tags = [t for t, _ in parts]
    inner = lambda k: der_items(parts[k][1]) or [(0, b"")]
    if tags in ([INTEGER] * 9, [INTEGER] * 6):  # PKCS#1, DSA
        return int.from_bytes(parts[0][1], "big") in (0, 1) and all(int.from_bytes(v, "big") > 0 for _, v in parts[1:])
    if tags[:3] == [INTEGER, SEQUENCE, OCTETS]:  # PKCS#8
        return inner(1)[0][0] == OID and len(parts[2][1]) > 0
    if tags[:2] == [INTEGER, OCTETS]:  # SEC1
        return parts[0][1] == b"\x01" and len(parts[1][1]) >= 16 and all(t in (0xA0, 0xA1) and der_items(v) for t, v in parts[2:])
    return tags == [SEQUENCE, OCTETS] and inner(0)[0][0] == OID and len(parts[1][1]) >= 16  # encrypted PKCS#8


def is_openssh(data: bytes) -> bool:
    """Whether data is the OpenSSH private key container, to its last byte."""
    return bool(data) and openssh_end(data) == len(data)


def openssh_end(data: bytes) -> int:
    """Where the OpenSSH private key container that begins data ends: a magic word, then strings with their lengths before them; 0 if none does."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return 0
    at = len(magic)

    def string() -> bytes | None:
        nonlocal at
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + n > len(data):
            return None
        at += 4 + n
        return data[at - n : at]

    if any(string() is None for _ in range(3)):  # cipher, key derivation, its options
        return 0
    keys, at = int.from_bytes(data[at : at + 4], "big"), at + 4
    return at if 1 <= keys <= 16 and all(string() for _ in range(keys + 1)) else 0


def decoded(run: str) -> bytes | None:
    """Bytes of a base64 run, of either alphabet, with or without padding."""
    run = run.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(run + "=" * (-len(run) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def is_signed_token(run: str) -> bool:
    """Whether the first part is a JSON header with its algorithm and the second one JSON too."""
    try:
        header, payload = (json.loads(decoded(x) or b"") for x in run.split(".")[:2])
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str) and isinstance(payload, dict)


def key_kind(data: bytes | None) -> str | None:
    if not data:
        return None
    if data.lstrip()[:11] == b"-----BEGIN ":
        return "pem" if any(good for _, _, good in pem_blocks(data.decode("latin-1"))) else None
    return "der" if is_private_der(data) else "ssh" if is_openssh(data) else None


def key_length(data: bytes) -> int:
    """Bytes that a key which begins data takes by its own lengths; 0 if none can begin so."""
    if data[:1] == bytes([SEQUENCE]) and len(data) > 6:
        width = data[1] & 0x7F if data[1] >= 0x80 else 0
        n = 2 + width + (int.from_bytes(data[2 : 2 + width], "big") if width else data[1])
        return n if width <= 4 and n <= len(data) else 0
    if data[:11] == b"-----BEGIN ":
        following = data.find(b"-----BEGIN ", 11)  # the block ends before it
        text = data[: following if following > 0 else len(data)].decode("latin-1")
        end = next((b for _, b, good in pem_blocks(text) if good), 0)
        return end + len(text[end : end + 2]) - len(text[end : end + 2].lstrip("\r\n")) if end else 0
    return openssh_end(data)


def pem_blocks(text: str) -> list[tuple[int, int, bool]]:
    """Start, end of each block, and whether a key is in it. A block ends before the next one begins, so each part is read once."""
    begins, out = [*PEM.finditer(text)], []
    for k, m in enumerate(begins):
        end = f"-----END {m[1]}-----"
        limit = begins[k + 1].start() if k + 1 < len(begins) else len(text)
        at = text.find(end, m.end(), limit)
        if at >= 0:
            body = text[m.end() : at].replace("\\n", "\n")
            sealed = ENCRYPTED.match(body)
            data = decoded("".join((body[sealed.end() :] if sealed else body).split()))
            # a legacy encrypted key has no shape, but whole blocks of its cipher
            good = bool(data) and len(data) >= 32 and len(data) % 8 == 0 if sealed else key_kind(data) is not None
            out.append((m.start(), at + len(end), good))
    return out


def line_keys(lines: list[re.Match[str]], decode: Callable[[str], bytes | None], unit: tuple[int, int]) -> Iterator[tuple[str, int, int]]:
    """Keys (kind, start, end) that begin one of these lines and end at the end of one; `unit` is how many characters hold how many bytes."""
    chars, size = unit
    joined, starts, done = "".join(m[0] for m in lines), [0], 0
    for m in lines:
        starts.append(starts[-1] + len(m[0]))
    for k, m in enumerate(lines):
        head = decode(joined[starts[k] : starts[k] + 32]) or b""
        if starts[k] < done or not (head[:1] == bytes([SEQUENCE]) or head.startswith((b"openssh-key", b"-----BEGIN "))):
            continue
        window = joined[starts[k] : starts[k] + LONGEST // size * chars]
        data = decode(window[: len(window) // chars * chars]) if len(window) % chars == 1 else decode(window)
        n = key_length(data or b"")
        end = starts[k] + -(-n * chars // size)
        last = bisect_right(starts, end) - 1
        # whole characters, up to the end of a line
        if n and starts[last] == end and (kind := key_kind((data or b"")[:n])):
            done = end
            yield kind, m.start(), lines[last - 1].end()


def base64_keys(text: str) -> Iterator[tuple[str, int, int]]:
    """Keys in runs of base64: of all lines of a run, without its last one, or of any lines that follow each other."""
    for m in BASE64.finditer(text):
        lines = [*LETTERS.finditer(text, m.start(), m.end())]
        for part in (lines, lines[:-1]):
            if part and (kind := key_kind(decoded("".join(x[0] for x in part)))):
                end = part[-1].end()
                yield kind, m.start(), end + len(PADDING.match(text, end)[0])
                break
        else:
            for kind, a, b in line_keys(lines, decoded, (4, 3)):
                yield kind, a, b + len(PADDING.match(text, b)[0])


def hex_bytes(run: str) -> bytes:
    return bytes.fromhex(run[: len(run) // 2 * 2])


def hex_keys(text: str) -> Iterator[tuple[str, int, int]]:
    """Keys in runs of hex digits; of an odd run, without its last or its first digit; of lines that follow each other."""
    found = []
    for m in LONG_HEX.finditer(text):
        run = m[0]
        for a, b in [(0, len(run))] if len(run) % 2 == 0 else [(0, len(run) - 1), (1, len(run))]:
            if kind := key_kind(bytes.fromhex(run[a:b])):
                found.append((kind, m.start() + a, m.start() + b))
                break
    for m in HEX_LINES.finditer(text):
        found += line_keys([*DIGITS.finditer(text, m.start(), m.end())], hex_bytes, (2, 1))
    yield from dict.fromkeys(found)


def spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all secrets, by start and then by the order of KINDS."""
    found: list[tuple[str, int, int]] = []
    low = text.lower()
    if any(x in low for x in NAMES):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    if "ey" in text:
        found += [("jwt", *m.span()) for m in SIGNED.finditer(text) if is_signed_token(m[0])]
    blocks = pem_blocks(text) if "-----BEGIN" in text else []
    found += [("pem", a, b) for a, b, good in blocks if good]
    starts = [a for a, _, _ in blocks]
    for kind, a, b in [*base64_keys(text), *hex_keys(text)]:
        at = bisect_right(starts, a) - 1
        if at < 0 or a >= blocks[at][1]:
            found.append((kind, a, b))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the column spans: an array of (kind, start, end)."""
    bound_batches(docs.sparkSession)
    docs = docs.drop("spans")
    kind = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([*docs.schema.fields, T.StructField("spans", T.ArrayType(kind))])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            rows = [[{"kind": k, "start": a, "end": b} for k, a, b in spans(t.decode())] for t in texts(batch.column(text_col))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, arrow)], names=[*batch.schema.names, "spans"])

    return docs.mapInArrow(run, schema)
