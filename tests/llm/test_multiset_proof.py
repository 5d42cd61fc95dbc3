"""Fingerprints and likeness of op7 recomputed in plain Python."""

import hashlib
import math
import struct

import pyarrow.parquet as pq
import xxhash

from gridlore.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
LOW = (1 << 32) - 1


def xx(*values):
    """The 64-bit hash of several values, each seeding the next; None is passed over."""
    h = 42
    for v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(struct.pack("<i", v) if isinstance(v, int) else v.encode(), h)
    return h


def lanes(text):
    exact, pairs, wide = [0] * 8, 0, [0] * 64
    for line in text.split("\n"):
        for j in range(4):
            h = xx(j, line)
            exact[2 * j] += h & LOW
            exact[2 * j + 1] += h >> 32
        words = line.split(" ")
        for a, b in zip(words, [*words[1:], None]):
            h = xx(a, b)
            pairs += 1
            for j in range(32):
                wide[2 * j] += h >> j & 1
                wide[2 * j + 1] += h >> (j + 32) & 1
    return [e & LOW for e in exact], pairs & LOW, wide


def printed(one):
    return "-".join("".join(f"{x:08x}" for x in part) for part in (one[0], [one[1]], one[2]))


def likeness(a, b):
    if a == b:
        return 1.0
    x, y = ([2 * w - s[1] for w in s[2]] for s in (a, b))
    size = math.sqrt(sum(v * v for v in x) * sum(v * v for v in y))
    return min(1.0, max(0.0, sum(p * q for p, q in zip(x, y)) / size)) if size else 0.0


def test_fingerprints_and_likeness(spark):
    t = pq.read_table(f"{FOLDER}/documents.parquet")
    docs = sorted(zip(t.column("doc_id").to_pylist(), (x or "" for x in t.column("text").to_pylist())))
    got = {r.doc_id: r for r in QUERIES["op7_multiset_hash"](spark, FOLDER).collect()}
    for (d, text), (_, after) in zip(docs, docs[1:] + docs[:1]):
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        own, changed, other = lanes(text), lanes(edited), lanes(after)
        r = got[d]
        assert r.fingerprint == printed(own) and r.edited_fingerprint == printed(changed)
        assert abs(r.near_edited - likeness(own, changed)) < 1e-9 and abs(r.near_next - likeness(own, other)) < 1e-9
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
