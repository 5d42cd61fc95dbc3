"""Token ids of whole texts, exactly as the tokenizers library gives them, piece by piece.

The word tokenizer drops white space and never joins anything across it or across its own cut
into pieces, so a text is the sequence of its pieces. Text of plain Latin letters is cut by one
pattern, any other word goes to the library whole. Pieces are kept with their ids in a cache of
bounded size.
"""

from __future__ import annotations

import ctypes
import json
import os
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

from gridlore.llm.store import worker_cache

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of pieces and ids in each of the two generations of a worker's cache, about.
CACHE_BYTES = 40 << 20
#: Longer pieces are not kept.
CACHE_PIECE = 64
#: Bytes of text handled at once, and after which freed memory is given back.
SLICE_BYTES, GIVE_BACK_BYTES = 1_000_000, 4_000_000
#: Characters of a text that are cut into pieces at once.
STRETCH = 1 << 20

#: Characters that need no normalisation but lower case, and on which all agree what is a letter.
SAFE = re.compile("[\x00-\x7fÀ-ÖØ-öø-ÿ«»–—“”‘’…]*")
#: The cut of the pre-tokenizer on such characters in lower case, and in its own words. Fixed values.
CUT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^ \t-\ra-zß-öø-ÿ0-9]+")
CUT_HERE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SHOWN = re.compile("[!-~]+")


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + rest.index(b)) for b in range(256)]


LETTERS = byte_letters()  # of the bytes 0 to 255


def cuts_plainly(spec: dict) -> bool:
    """Whether a tokenizers file cuts texts as CUT does, special strings apart."""
    cuts = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
    return (cuts[0].get("pattern") == {"Regex": CUT_HERE} and cuts[0].get("invert") is True
            and all(a["content"].startswith("<|") for a in spec["added_tokens"]))


def pieces_of(text: str, plain: bool) -> Iterator[list[str]]:
    """The pieces of a text, those of some words at a time, cut at blanks only; words that are
    not plain stay whole."""
    for blank in "\t\r\n":
        text = text.replace(blank, " ")
    start = 0
    while start < len(text):
        stop = text.find(" ", start + STRETCH) if len(text) - start > STRETCH else -1
        stop = len(text) if stop < 0 else stop
        some = text[start:stop]
        start = stop + 1
        if plain and "<|" not in some and SAFE.fullmatch(some):
            yield CUT.findall(some.lower())
        else:
            out = []
            for word in some.split(" "):
                if plain and "<|" not in word and SAFE.fullmatch(word):
                    out += CUT.findall(word.lower())
                elif word:
                    out.append(word)
            yield out


def is_one_piece(piece: str) -> bool:
    """Whether a text is a piece of CUT, already in normal form."""
    return bool(CUT.fullmatch(piece) and SAFE.fullmatch(piece) and piece == piece.lower())


def lettered(piece: str) -> str:
    """A piece in the letters of a byte-level vocabulary."""
    return piece if _SHOWN.fullmatch(piece) else "".join([LETTERS[b] for b in piece.encode()])


class _Ids(dict):
    """piece -> its ids as bytes."""

    def __init__(self, whole, plain: bool):
        super().__init__()
        self.whole, self.model, self.plain, self.held, self.older = whole, whole.model, plain, 0, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            if self.plain and is_one_piece(piece):
                found = [t.id for t in self.model.tokenize(lettered(piece))]
            else:
                found = self.whole.encode(piece, add_special_tokens=False).ids
            ids = array("I", found).tobytes()
        if len(piece) <= CACHE_PIECE:
            if self.held > CACHE_BYTES:
                self.older = dict(self)
                self.clear()
                self.held = 0
            self[piece] = ids
            self.held += 180 + len(piece) + len(ids)
        return ids


class WordEncoder:
    """Ids of many texts for a tokenizers file that works word by word."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            self.plain = cuts_plainly(json.load(f))
        self.ids = _Ids(Tokenizer.from_file(path), self.plain)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, text ends): ids of text i lie between ends[i-1] and ends[i]."""
        of = self.ids.__getitem__
        found = [b"".join([b"".join(map(of, some)) for some in pieces_of(t or "", self.plain)]) for t in texts.to_pylist()]
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found))) // 4
        return np.frombuffer(b"".join(found), np.uint32), ends


def word_encoder(path: str) -> WordEncoder:
    cache = worker_cache().setdefault("word_encoders", {})
    if path not in cache:
        cache[path] = WordEncoder(path)
    return cache[path]


def give_back() -> None:
    """Hands freed memory to the machine; a worker would keep it through all later tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only where the C library has it
    if trim:
        trim(0)


def text_slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text, one row at least; what the
    caller freed is given back after every few."""
    size = pc.cumulative_sum(pc.fill_null(pc.binary_length(batch.column(column)), 0).cast(pa.int64()))
    size, start, given = size.to_numpy(zero_copy_only=False), 0, 0
    while start < batch.num_rows:
        done = size[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(size, done + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
        if size[stop - 1] - given > GIVE_BACK_BYTES or start == batch.num_rows:
            given = size[stop - 1]
            give_back()
