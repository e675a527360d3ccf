"""Token ids of whole texts, by a public byte-level BPE vocabulary of the tokenizers library.

A byte-level BPE never merges over the place before a space that a non-space follows, nor over
the places around a newline between two non-spaces. So a text is cut there, and the ids of each
word are kept by word: each distinct word is encoded once per worker. A text that has such a place
in doubt (two spaces, a space before a newline) is encoded as a whole.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator
from operator import attrgetter
from typing import TYPE_CHECKING

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from .common import KEPT, small_batches, texts

if TYPE_CHECKING:
    from pyspark import Broadcast

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
ID = np.dtype("<u4")
ID_OF = attrgetter("id")
#: They end a run of letters, and no contraction begins with them.
CLOSING = b".,;:!?)"


def _byte_characters() -> dict[int, str]:
    """The visible character by which a byte-level vocabulary writes each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class _InDoubt(Exception):
    """A cut beside this word could change the ids."""


class _Words(dict):
    """Ids, packed, of words that follow `before`; words are UTF-8."""

    def __init__(self, encoder: Encoder, before: bytes) -> None:
        self.encoder, self.before = encoder, before
        self.shown_before = before.decode("latin-1").translate(encoder.shown)

    def __missing__(self, word: bytes) -> bytes:
        own = self.encoder
        if word.isalpha():
            ids = own.piece(self.shown_before + word.decode())
        elif b"\n" in word:
            head, *rest = word.split(b"\n")
            parts = [x.decode() for x in (head, *rest)]
            if not all(parts) or any(x[0].isspace() or x[-1].isspace() for x in parts):
                raise _InDoubt
            return b"".join([self[head], *(own.newline + own.at_start[x] for x in rest)])
        else:
            letters = word.rstrip(CLOSING)
            text = letters.decode()
            if letters != word and text.isalpha():
                # closing marks after letters are a piece of their own
                ids = self[letters] + own.at_start[word[len(letters) :]]
            elif text.isalpha():
                ids = own.piece(self.shown_before + letters.decode("latin-1").translate(own.shown))
            elif not word or (text or word.decode())[0].isspace():
                raise _InDoubt
            else:
                ids = own.pack(own.whole((self.before + word).decode()))
        if len(self) < own.most and len(word) <= 48:
            self[word] = ids
        return ids


class Encoder:
    """Ids of texts, given as UTF-8, as the library gives them: a special token's name in a text is that token.

    most: words kept at most, of each kind, at about 160 bytes a word; the first ones stay, which the frequent ones are among.
    """

    def __init__(self, vocabulary: str, most: int = 700_000) -> None:
        self.tokenizer, self.most = Tokenizer.from_str(vocabulary), most
        # names with letters only, or spaces, would be cut apart below
        self.cuttable = all(not x.content.isalpha() and not any(map(str.isspace, x.content)) and not (x.lstrip or x.rstrip) for x in self.tokenizer.get_added_tokens_decoder().values())
        self.model, self.shown = self.tokenizer.model, _byte_characters()
        self.tokenize = self.model.tokenize
        self.packed, self.kind = (np.dtype("<u2"), "H") if self.tokenizer.get_vocab_size() <= 1 << 16 else (ID, "I")
        self.at_start, self.after_space = _Words(self, b""), _Words(self, b" ")
        self.newline = self.pack(self.whole("\n"))

    def pack(self, ids: list[int]) -> bytes:
        return np.array(ids, dtype=self.packed).tobytes()

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def piece(self, shown: str) -> bytes:
        """Ids of a run of letters with or without a space before it, in the vocabulary's characters."""
        return array(self.kind, map(ID_OF, self.tokenize(shown))).tobytes()

    def encode(self, text: bytes) -> np.ndarray:
        if not text:
            return np.empty(0, dtype=ID)
        first, *rest = text.split(b" ")
        try:
            if not self.cuttable:
                raise _InDoubt
            packed = self.at_start[first] + b"".join(map(self.after_space.__getitem__, rest))
        except _InDoubt:
            packed = self.pack(self.whole(text.decode()))
        return np.frombuffer(packed, dtype=self.packed).astype(ID)


def read_vocabulary(path: str | None = None) -> str:
    """The vocabulary file's content, from public_tokenizers unless a path is given; under 2 MB, so it can be broadcast."""
    with open(path or public_tokenizers.path(VOCABULARY), encoding="utf-8") as f:
        return f.read()


def encoder_of(vocabulary: str) -> Encoder:
    """The worker's encoder; its words stay for the worker's next tasks, if these encode too."""
    if KEPT.get("encoder", (None,))[0] != vocabulary:
        KEPT["encoder"] = vocabulary, Encoder(vocabulary)
    return KEPT["encoder"][1]


def encoded(batches: Iterable[pa.RecordBatch], vocabulary: Broadcast, text_col: str, end_id: int = END_ID) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Batches with the ids of each row's text, and end_id after them."""
    encoder = encoder_of(vocabulary.value)
    end = np.array([end_id], dtype=ID)
    for batch in small_batches(batches, keeps="encoder"):
        yield batch, [np.concatenate([encoder.encode(t), end]) for t in texts(batch.column(text_col))]
