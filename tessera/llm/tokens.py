"""Whole-text encoding with the tokenizers library, a word at a time from a cache.

Both supported vocabularies split a text into pieces before merging, and merge each piece
on its own. So a piece's ids can be looked up; the library is asked only for pieces not
met yet. Texts with characters outside a checked range, and texts that hold a string the
vocabulary has as an added token, go through the library whole.
"""

from __future__ import annotations

import ctypes
import os
import re
import sys
from array import array
from collections.abc import Callable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa

#: Characters for which the patterns below cut exactly where the library does.
_PLAIN = "\u0000-ſ‐-‧‰-›€"
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ſ"
_NUMBERS = "0-9²³¹¼-¾"
_SPACES = "\t-\r \u0085 "
_CONTRACTIONS = "'(?:[stmd]|re|ve|ll)"

#: How each vocabulary's file cuts texts: (pattern, lower-cased first). Fixed by the files.
CUTS = {
    "byte_bpe_50k.json": (
        rf"{_CONTRACTIONS}| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^{_SPACES}{_LETTERS}{_NUMBERS}]+"
        rf"|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+",
        False,
    ),
    "word_bpe_49k.json": (rf"{_CONTRACTIONS}|[{_LETTERS}]+|[{_NUMBERS}]|[^{_SPACES}{_LETTERS}{_NUMBERS}]+", True),
}
#: Pieces a worker remembers (about 200 bytes each), and how many times as many it may then meet
#: without finding them before it starts over.
CACHE = 500_000
PATIENCE = 4
LONGEST = 64


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder(dict):
    """Text -> ids as little-endian bytes of `dtype`, without special tokens."""

    def __init__(self, path: str, dtype: str = "<u4"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.dtype = np.dtype(dtype)
        native = sys.byteorder == "little" and self.dtype.kind == "u"
        self.code = {2: "H", 4: "I"}.get(self.dtype.itemsize) if native else None
        pattern, self.lower = CUTS.get(os.path.basename(path), (None, False))
        self.cut = pattern and re.compile(pattern).findall
        self.late = 0
        self.odd = re.compile(f"[^{_PLAIN}]").search
        # strings that the library takes as one id wherever they stand in a text
        added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.added = [t.lower() if self.lower else t for t in added]

    def _bytes(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes() if self.code else np.array(ids, self.dtype).tobytes()

    def whole(self, text: str) -> bytes:
        return self._bytes(self.library.encode(text, add_special_tokens=False).ids)

    def _met(self, pieces: list[str], found: list[bytes | None]) -> list[bytes]:
        """`found` with what the cache lacks, which the library encodes in one call."""
        new = list({p for p, v in zip(pieces, found) if v is None})
        got = dict(zip(new, (self._bytes(e.ids) for e in self.library.encode_batch_fast(new, add_special_tokens=False))))
        out = [got[p] if v is None else v for p, v in zip(pieces, found)]
        if len(self) + len(got) > CACHE:
            # pieces met early are mostly the common ones
            self.late += len(got)
            if self.late <= PATIENCE * CACHE:
                return out
            self.clear()
            self.late = 0
        self.update((p, v) for p, v in got.items() if len(p) <= LONGEST)
        return out

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.cut is None or not text.isascii() and self.odd(text):
            return self.whole(text)
        plain = text.lower() if self.lower else text
        if any(t in plain for t in self.added):
            return self.whole(text)
        pieces = self.cut(plain)
        found = list(map(self.get, pieces))
        try:
            return b"".join(found)
        except TypeError:  # a piece is not in the cache yet
            return b"".join(self._met(pieces, found))


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, dtype: str = "<u4") -> Encoder:
    """The worker's encoder for a vocabulary file; it outlives tasks."""
    key = (path, dtype)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(path, dtype)
    return _ENCODERS[key]


def forget() -> None:
    """Drop the worker's encoder: other operators' tasks run in the same worker."""
    _ENCODERS.clear()


def trim() -> None:
    """Give what the worker has freed back to the machine."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable[[Iterator], Iterator], encodes: bool = False) -> Callable[[Iterator], Iterator]:
    """`run` for a task's batches in a worker that outlives the task: an encoder that an earlier operator
    left there goes first, unless this one `encodes`, and freed memory is not held on to."""

    def task(batches: Iterator) -> Iterator:
        if not encodes:
            forget()
        try:
            yield from run(batches)
        finally:
            trim()

    return task
