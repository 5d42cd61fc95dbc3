"""Every operator's query on the smallest tables against a brute-force version."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from compare import compare, duck
from gridlore.llm.queries import ORACLE, QUERIES, vocabulary

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    t = pq.read_table(f"{FOLDER}/documents.parquet")
    return sorted(zip(t.column("doc_id").to_pylist(), t.column("text").to_pylist(), t.column("lang").to_pylist()))


@pytest.fixture(scope="module")
def encoded(docs):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    return {d: whole.encode(t or "", add_special_tokens=False).ids for d, t, _ in docs}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, name):
    problem, rows, _ = compare(spark, duck(FOLDER), name, QUERIES[name], ORACLE[name], FOLDER)
    assert problem is None, problem
    assert rows


def test_op2(spark, encoded):
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in QUERIES["op2_pack_sequences"](spark, FOLDER).collect():
        pieces[r.doc_id].append(r)
        bins[r.sequence_id].append(r)
    for d, ids in encoded.items():
        at, ids = 0, [*ids, 2]
        for r in sorted(pieces[d], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), crc(ids[at:at + r.length]))
            at += r.length
        assert at == len(ids)
    total = 0
    for rows in bins.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
        total += at
    assert total / (4096 * len(bins)) > 0.97


def test_op3(spark, encoded):
    rows = sorted(QUERIES["op3_rank_stream"](spark, FOLDER).collect(), key=lambda r: r.doc_id)
    start = 0
    for r, (d, ids) in zip(rows, sorted(encoded.items()), strict=True):
        assert tuple(r) == (d, start, len(ids) + 1, crc([*ids, 1]))
        start += len(ids) + 1


def test_op4(spark, docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op4_token_counts"](spark, FOLDER).collect()}
    for d, t, _ in docs:
        n = len(model.encode(t or ""))
        assert got[d] == (len((t or "").encode()), n, n > 4096)


def test_op6(spark, docs):
    got = {r.doc_id: r for r in QUERIES["op6_language_filters"](spark, FOLDER).collect()}
    right = total = 0
    for d, t, lang in docs:
        r = got[d]
        assert r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0)
        assert 0 <= r.score <= 1
        if r.held_out:
            total, right = total + 1, right + (r.lang_pred == lang)
    assert total and right / total > 0.95


def test_op7(spark, docs):
    got = {r.doc_id: r for r in QUERIES["op7_multiset_hash"](spark, FOLDER).collect()}
    assert len(got) == len(docs)
    by_text, near = {}, []
    for (d, t, _), (_, after, _) in zip(docs, docs[1:] + docs[:1]):
        t, after, r = t or "", after or "", got[d]
        half = len(t) // 2
        edited = t[:len(t) - half] + after[:half]
        assert r.n_chars == len(t)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert by_text.setdefault(t, r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        near.append((r.near_edited, r.near_next))
    assert len(set(by_text.values())) == len({tuple(sorted(t.split("\n"))) for t in by_text})
    assert np.mean([a > b for a, b in near]) > 0.9


def brute_secrets(t):
    out = []
    kinds = (("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12),
             ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18), ("hex", re.compile("[0-9a-f]+"), 0, 16))
    for k, (name, pattern, group, least) in enumerate(kinds):
        out += [(m.start(), k, f"{name}:{m.start()}:{m.end()}") for m in pattern.finditer(t) if len(m[group]) >= least]
    return [x[2] for x in sorted(out)]


def test_op9(spark, docs):
    got = {r.doc_id: r for r in QUERIES["op9_secret_links"](spark, FOLDER).collect()}
    for d, t, _ in docs:
        want, r = brute_secrets(t or ""), got[d]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(w.startswith(k) for w in want) for k in ("assign", "access", "hex")]
        assert set(want) <= set(r.spans.split(","))


def test_op10(spark):
    t = pq.read_table(f"{FOLDER}/embeddings.parquet")
    ids = t.column("vec_id").to_numpy()
    x = np.array(t.column("embedding").to_pylist(), dtype=float)
    got = defaultdict(list)
    for r in sorted(QUERIES["op10_prefix_forest"](spark, FOLDER).collect(), key=lambda r: r.rank):
        got[r.query_id].append((r.vec_id, r.score))
    assert sorted(got) == sorted(i for i in ids.tolist() if i % 100 == 0)
    hits = 0
    for q, found in got.items():
        dist = np.sqrt(((x - x[ids == q]) ** 2).sum(axis=1))
        dist[ids == q] = np.inf
        true = ids[np.lexsort((ids, dist))][:10].tolist()
        hits += len(set(true) & {v for v, _ in found})
        for v, s in found:
            assert abs(s - dist[ids == v][0]) < 1e-12
        assert found == sorted(found, key=lambda f: (f[1], f[0]))
    assert hits >= 0.9 * 10 * len(got)
