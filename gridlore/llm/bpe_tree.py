"""Byte-pair encoding by a segment tree over the ranks of adjacent pairs, and decoding.

The leaves of the tree are the pairs of neighbouring symbols of a word: the rank of their merge
and their place, or nothing. A node holds the smaller of its two children, so the root is the
leftmost merge of lowest rank. A merge changes three leaves, each a path to the root, so a word
of n letters takes n log n steps, however long it is. Short words are merged many at a time, their
trees as the rows of one array.

White space never joins anything, so texts are encoded piece by piece, as the pre-tokenizer cuts
them. Text of plain Latin letters is cut by one pattern, any other word by the library. Short
pieces are kept in a cache of bounded size.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from gridlore.llm.store import worker_cache
from gridlore.llm.tokens import LETTERS, cuts_plainly, is_one_piece, lettered, pieces_of, text_slices

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of pieces, ids and letters in each of the two generations of a worker's cache, about.
CACHE_BYTES = 64 << 20
#: Longer pieces are not kept.
CACHE_PIECE = 64
#: Pieces that are held.
HELD = 500_000
#: Letters (bytes) of words that are merged together, and words of one array.
SHORT, ROWS = 64, 16_384

_NO_PAIR = 1 << 62
_PLACE, _PLACES = 32, (1 << 32) - 1
_ID = 24


class Merges:
    """Vocabulary and merges of a tokenizers file whose model is byte-pair encoding.

    Normalisation and the cut into words are the library's; the merges are done here.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        odd = [k for k in ("unk_token", "continuing_subword_prefix", "dropout") if model.get(k)]
        if model["type"] != "BPE" or odd or model.get("byte_fallback") or model.get("ignore_merges") or spec.get("post_processor"):
            raise ValueError(f"{path}: only plain byte-pair encoding can be encoded here")
        if spec["decoder"] is not None or any(a["single_word"] or a["lstrip"] or a["rstrip"] or a["normalized"] for a in spec["added_tokens"]):
            raise ValueError(f"{path}: a decoder or special tokens that take blanks are not known here")
        self.whole = Tokenizer.from_file(path)
        self.vocab = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (self.vocab | self.added).items()}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        #: whether texts of plain letters may be cut by our own pattern
        self.plain = cuts_plainly(spec)
        #: two ids side by side in one number -> rank, shifted; id of the merged symbol
        self.ranks, self.made = {}, {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ", 1)
            key = self.vocab[a] << _ID | self.vocab[b]
            self.ranks[key], self.made[key] = rank << _PLACE, self.vocab[a + b]
        self.sorted_pairs = np.array(sorted(self.ranks), np.int64)
        self.sorted_ranks = np.array([self.ranks[k] for k in self.sorted_pairs.tolist()], np.int64)
        self.sorted_made = np.array([self.made[k] for k in self.sorted_pairs.tolist()], np.int64)
        self.letters = np.array([self.vocab.get(c, -1) for c in LETTERS], np.int64)
        self.last_letters = np.array([self.vocab.get(c + self.suffix, -1) for c in LETTERS], np.int64)
        self.all_letters = (self.letters >= 0).all() and (self.last_letters >= 0).all() and len(self.ranks) > 0

    def merge(self, word: str) -> list[int]:
        """Ids of one word of the pre-tokenizer, the last letter with the word's end."""
        vocab, ranks, made = self.vocab, self.ranks, self.made
        ids = [vocab[c] for c in [*word[:-1], word[-1:] + self.suffix] if c in vocab]  # letters without a symbol vanish
        n = len(ids)
        if n < 2:
            return ids
        size = 1 << (n - 2).bit_length()
        tree = [_NO_PAIR] * (2 * size)
        left = ids[0]
        for i in range(1, n):
            right = ids[i]
            rank = ranks.get(left << _ID | right)
            if rank is not None:
                tree[size + i - 1] = rank | i - 1
            left = right
        for node in range(size + n - 2 >> 1, 0, -1):
            a, b = tree[2 * node], tree[2 * node + 1]
            tree[node] = a if a < b else b
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while tree[1] != _NO_PAIR:
            at = tree[1] & _PLACES
            gone = after[at]
            new = ids[at] = made[ids[at] << _ID | ids[gone]]
            ids[gone] = -1
            right, left = after[gone], before[at]
            after[at] = right
            changed = []
            if right < n:
                before[right] = at
                changed.append((gone, _NO_PAIR))
                rank = ranks.get(new << _ID | ids[right])
                changed.append((at, _NO_PAIR if rank is None else rank | at))
            else:
                changed.append((at, _NO_PAIR))
            if left >= 0:
                rank = ranks.get(ids[left] << _ID | new)
                changed.append((left, _NO_PAIR if rank is None else rank | left))
            for node, value in changed:
                node += size
                if tree[node] == value:
                    continue
                tree[node] = value
                while node > 1:
                    other = tree[node ^ 1]
                    if other < value:
                        value = other
                    node >>= 1
                    if tree[node] == value:
                        break
                    tree[node] = value
        return [i for i in ids if i >= 0]

    def merge_many(self, words: list[bytes]) -> list[list[int]]:
        """Ids of many short words, given as bytes, each as ``merge`` gives them."""
        out: list[list[int]] = [[]] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        for bits in range(SHORT.bit_length()):
            size = 1 << bits  # leaves, for words of up to size + 1 letters
            rows = np.flatnonzero((lengths <= size + 1) & ((lengths > size // 2 + 1) | (bits == 0)))
            for start in range(0, len(rows), ROWS):
                some = rows[start:start + ROWS]
                for at, ids in zip(some.tolist(), self._merged([words[i] for i in some.tolist()], lengths[some], size)):
                    out[at] = ids
        return out

    def _rank(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The leaves of pairs of ids that stand at ``at``."""
        key = left << _ID | right
        place = np.minimum(np.searchsorted(self.sorted_pairs, key), len(self.sorted_pairs) - 1)
        known = (self.sorted_pairs[place] == key) & (left >= 0) & (right >= 0)
        return np.where(known, self.sorted_ranks[place] | at, _NO_PAIR)

    def _merged(self, words: list[bytes], lengths: np.ndarray, size: int) -> list[list[int]]:
        n = len(words)
        ids = np.full((n, size + 2), -1, np.int64)
        row = np.repeat(np.arange(n), lengths)
        column = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        letters = np.frombuffer(b"".join(words), np.uint8)
        ids[row, column] = np.where(column == lengths[row] - 1, self.last_letters[letters], self.letters[letters])
        tree = np.full((n, 2 * size), _NO_PAIR, np.int64)
        tree[:, size:] = self._rank(ids[:, :size], ids[:, 1:size + 1], np.arange(size))
        level = size
        while level > 1:
            tree[:, level // 2:level] = np.minimum(tree[:, level:2 * level:2], tree[:, level + 1:2 * level:2])
            level //= 2
        after = np.tile(np.arange(1, size + 3), (n, 1))
        before = after - 2
        live = np.arange(n)
        while len(live := live[tree[live, 1] != _NO_PAIR]):
            at = tree[live, 1] & _PLACES
            gone = after[live, at]
            key = ids[live, at] << _ID | ids[live, gone]
            new = self.sorted_made[np.searchsorted(self.sorted_pairs, key)]
            ids[live, at], ids[live, gone] = new, -1
            right, left = after[live, gone], before[live, at]
            after[live, at], before[live, right] = right, at
            first = np.maximum(left, 0)
            nodes = [np.where(gone < size, gone, at) + size, at + size, np.where(left >= 0, left, at) + size]
            tree[live, nodes[0]] = _NO_PAIR
            tree[live, nodes[1]] = self._rank(new, ids[live, right], at)
            tree[live, nodes[2]] = np.where(left >= 0, self._rank(ids[live, first], new, first), tree[live, nodes[2]])
            for _ in range(size.bit_length() - 1):
                nodes = [node >> 1 for node in nodes]
                for node in nodes:
                    tree[live, node] = np.minimum(tree[live, 2 * node], tree[live, 2 * node + 1])
        kept = ids >= 0
        flat, ends = ids[kept].tolist(), np.cumsum(kept.sum(axis=1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def cut(self, text: str) -> list[str | int]:
        """The pieces of a text: byte letters for ``merge``, and ids of special strings."""
        out = []
        for k, part in enumerate(self.special.split(text) if self.special else [text]):
            if k % 2:
                out.append(self.added[part])
            elif part:
                out += [w for w, _ in self.whole.pre_tokenizer.pre_tokenize_str(self.whole.normalizer.normalize_str(part))]
        return out

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one word or piece of a word without blanks."""
        if self.plain and is_one_piece(piece):
            return self.merge(lettered(piece))
        return [i for w in self.cut(piece) for i in ([w] if isinstance(w, int) else self.merge(w))]


class Pieces(dict):
    """piece -> (number of ids, ids in decimal, tokens), both joined by one blank."""

    def __init__(self, merges: Merges):
        super().__init__()
        self.merges, self.held, self.older = merges, 0, {}

    def __missing__(self, piece: str) -> tuple[int, str, str]:
        found = self.older.get(piece)
        return self._put(piece, self.merges.encode_piece(piece)) if found is None else self._hold(piece, found)

    def _put(self, piece: str, ids: list[int]) -> tuple[int, str, str]:
        return self._hold(piece, (len(ids), " ".join(map(str, ids)), " ".join([self.merges.tokens[i] for i in ids])))

    def _hold(self, piece: str, found: tuple[int, str, str]) -> tuple[int, str, str]:
        if len(piece) <= CACHE_PIECE:
            if self.held > CACHE_BYTES:
                self.older = dict(self)
                self.clear()
                self.held = 0
            self[piece] = found
            self.held += 260 + len(piece) + len(found[1]) + len(found[2])
        return found

    def learn(self, pieces: Iterable[str]) -> None:
        """Encodes the words among pieces that are not held yet, many at a time."""
        new = [p for p in pieces if p not in self and p not in self.older and len(p) <= SHORT // 2 and is_one_piece(p)]
        if self.merges.plain and self.merges.all_letters:
            for piece, ids in zip(new, self.merges.merge_many([p.encode() for p in new])):
                self._put(piece, ids)


class _Digest:
    def __init__(self):
        self.n, self.ids, self.tokens = 0, hashlib.sha256(), hashlib.sha256()

    def update(self, pieces: Pieces, some: list[str]) -> None:
        found = [f for f in map(pieces.__getitem__, some) if f[0]]
        if found:
            lead = b" " if self.n else b""
            for digest, parts in zip((self.ids, self.tokens), list(zip(*found))[1:]):
                digest.update(lead + " ".join(parts).encode())
            self.n += sum([f[0] for f in found])


def digests(pieces: Pieces, texts: list[str]) -> list[tuple[int, str, str]]:
    """Per text: number of ids, SHA-256 of the ids in decimal, SHA-256 of the decoded text."""
    out = [_Digest() for _ in texts]
    held: list[tuple[_Digest, list[str]]] = []

    def flush() -> None:
        pieces.learn(set().union(*[some for _, some in held]))
        for digest, some in held:
            digest.update(pieces, some)
        held.clear()

    size = 0
    for digest, text in zip(out, texts):
        for some in pieces_of(text, pieces.merges.plain):
            held.append((digest, some))
            size += len(some)
            if size > HELD:
                flush()
                size = 0
    flush()
    return [(d.n, d.ids.hexdigest(), d.tokens.hexdigest()) for d in out]


def encode(merges: Merges, text: str | None) -> list[int]:
    """Ids of a text, as the library gives them without added special tokens."""
    return [i for some in pieces_of(text or "", merges.plain) for p in some for i in merges.encode_piece(p)]


def decode(merges: Merges, ids: list[int]) -> str:
    """The text of ids, special tokens kept: the tokens joined by a blank; unknown ids vanish."""
    return " ".join([merges.tokens[i] for i in ids if i in merges.tokens])


def _cached(path: str) -> Pieces:
    cache = worker_cache().setdefault("bpe_pieces", {})
    if path not in cache:
        cache[path] = Pieces(Merges(path))
    return cache[path]


def encode_documents(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, decoded with ``with_ids``).

    Every row of ``docs`` gives one, in the partition where it is: no shuffle. Null texts are
    empty, an empty text has no ids and the hashes of nothing; repeated and null ids stay as
    they are; an empty table gives none; other columns are not read. A text is held once, its
    ids and tokens for a million letters at a time, or for one word where that is longer
    (``with_ids`` holds them all).
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        pieces = _cached(path)
        for batch in batches:
            for part in text_slices(batch, "t"):
                texts = [t or "" for t in part.column("t").to_pylist()]
                rows = digests(pieces, texts)
                cols = [part.column("d"), pa.array([r[0] for r in rows], pa.int64()),
                        pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())]
                names = ["d", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    ids = [encode(pieces.merges, t) for t in texts]
                    cols += [pa.array(ids, pa.list_(pa.int32())), pa.array([decode(pieces.merges, i) for i in ids], pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(cols, names)

    more = ", ids array<int>, decoded string" if with_ids else ""
    out = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).mapInArrow(
        run, f"d {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string{more}")
    return out.withColumnRenamed("d", "doc_id")
