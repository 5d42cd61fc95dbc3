"""Conversation repair, hard negatives and merges by segment tree against plain versions."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gridlore.llm import bpe_tree, triangle_negatives, turn_align
from gridlore.llm.queries import QUERIES, vocabulary

FOLDER = "/root/testdata/sf0.001"
WORDS = vocabulary("word_bpe_49k.json")


# conversations

def shortest(marks):
    """Cheapest, then least audit by a search over (row, grammar state)."""
    steps = {"B": {"s": "S", "u": "U"}, "S": {"u": "U"}, "U": {"a": "A"}, "A": {"u": "U"}}
    best, heap = {}, [(0, "", 0, "B")]
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in best:
            continue
        best[i, state] = cost, audit
        for letter, to in steps[state].items():
            if letter != "s":
                heapq.heappush(heap, (cost + 2, audit + "I", i, to))
        if i < len(marks):
            mark = marks[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state))
            for letter, to in steps[state].items() if mark != "x" else ():
                if mark.lower() == letter:
                    heapq.heappush(heap, (cost + mark.isupper(), audit + "K", i + 1, to))
                elif letter != "s":
                    heapq.heappush(heap, (cost + 2 + mark.isupper(), audit + "R", i + 1, to))
    return min(best[len(marks), s] for s in "BA")


def plain_repair(rows, conv, crc):
    """The contract's row of one conversation; ``rows`` in order."""
    out = []
    for turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if crc else 19
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    seen, marks, n = set(), "", defaultdict(int)
    for turn, role, text in out:
        shown = re.findall(r"[^\x20\x09-\x0D]", text)
        first = role[:1] if role[:1] in ("u", "a", "s") else "o"
        if not shown:
            n["blank"] += 1
            marks += "x"
        elif (role, text) in seen:
            n["duplicate"] += 1
            marks += "x"
        elif shown[-1] not in ".!?":
            n["truncated"] += 1
            marks += first.upper()
        else:
            marks += first
        seen.add((role, text))
    cost, audit = shortest(marks)
    kept, rest = [], iter(out)
    for edit in audit:
        if edit == "D":
            next(rest)
            continue
        speaker = "user" if sum(k[:1] != "s" for k in kept) % 2 == 0 else "assistant"
        if edit == "I":
            kept.append(f"{speaker}:")
        else:
            _, role, text = next(rest)
            kept.append(f"{role if edit == 'K' else speaker}:{text}")
    turns = [t for t, _, _ in out if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(out, out[1:]))
    return (conv, gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit,
            hashlib.sha256("\n".join(kept).encode()).hexdigest())


def test_op11(spark):
    for folder in (FOLDER, "/root/testdata/sf0.01"):
        t = pq.read_table(f"{folder}/conversations.parquet").to_pylist()
        convs = defaultdict(list)
        for r in sorted(t, key=lambda r: r["turn"]):
            convs[r["conv_id"]].append((r["turn"], r["role"], r["text"]))
        want = sorted(plain_repair(rows, c, True) for c, rows in convs.items())
        assert sorted(map(tuple, QUERIES["op11_turn_align"](spark, folder).collect())) == want
        assert len({w[7] for w in want}) > 5


@pytest.mark.parametrize("block", [1, 3, 32])
def test_blocks_and_segments_equal_a_search(block, monkeypatch):
    monkeypatch.setattr(turn_align, "BLOCK", block)
    rnd = random.Random(block)
    for _ in range(400):
        marks = "".join(rnd.choice("uasoUASOxxuaua") for _ in range(rnd.randint(0, 12)))
        parts = [turn_align._Segment(), turn_align._Segment()]
        cut = rnd.randint(0, len(marks))
        for i, m in enumerate(marks):
            parts[i >= cut].add(i, m.lower(), m, 1, m == "x", False, m.isupper())
        whole = turn_align._Segment()
        for p in parts:
            p.parts, p.marks = [(1, p.matrix())], []
            whole.append(p)
        cost, audit = whole.result()
        assert (cost, audit.replace("C", "D")) == shortest(marks)
        cost, audit = turn_align.repaired(marks)
        assert (cost, audit.replace("C", "D")) == shortest(marks)


KIND = "conv_id long, turn long, role string, text string, n int, c string, digest int, audit string"


def test_conversations_over_many_ranges(spark):
    rnd = random.Random(2)
    rows = []
    for conv, n in ((0, 700), (1, 3), (None, 40), (2, 1), (3, 150)):
        for turn in range(n):
            role = rnd.choice(["user", "assistant"]) if rnd.random() < 0.2 else ("user", "assistant")[turn % 2]
            text = rnd.choice(["ok.", "", " \n", "yes!", f"half {turn}"]) if rnd.random() < 0.3 else f"words {turn}."
            rows.append((conv, turn, rnd.choice([role] * 9 + [None, "tool", ""]), text if rnd.random() < 0.95 else None))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        table = spark.createDataFrame([(*r, 1, "x", 2, "K") for r in rows], KIND)
        for crc, made in ((True, turn_align.damaged(table)), (False, turn_align.undamaged(table))):
            got = {r.conv_id: tuple(r) for r in turn_align.repair(made).collect()}
            for conv in (0, 1, None, 2, 3):
                assert got[conv] == plain_repair([r[1:] for r in rows if r[0] == conv], conv, crc)
            assert len(got) == 5
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_odd_conversations(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    long = "x" * 300_000
    rows = [(gone, 0, "user", "a."), (5000, None, "user", "b."), (5001, 1, "user", long), (5001, 1, "user", long), (5001, 2, "assistant", "c."),
            (5002, None, None, None)] + [(5003, 7, "user", "same.")] * 100
    table = spark.createDataFrame([(*r, 1, "x", 2, "K") for r in rows], KIND)
    got = {r.conv_id: r for r in turn_align.repair(turn_align.undamaged(table)).collect()}
    assert got[5001].audit == "KDK" and got[5001].truncated == 1 and got[5001].duplicate == 1 and got[5001].cost == 4
    assert got[5002].audit == "D" and got[5002].blank == 1 and (got[5000].audit, got[5000].cost) == ("KI", 2)
    assert got[5003].duplicate == 99 and got[5003].illegal == 99 and got[5003].audit == "K" + "D" * 99 + "I"
    got = {r.conv_id: r for r in turn_align.repair(turn_align.damaged(table)).collect()}
    assert tuple(got[gone]) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert turn_align.repair(turn_align.damaged(table.limit(0))).count() == 0


# hard negatives

def plain_mining(rows, anchors, k=5):
    """Entries (id, label, vector) without repeats; all pairs."""
    rows = sorted(set(rows))
    out = []
    for a in rows:
        if not anchors(a[0]):
            continue
        near = sorted((-sum(x * y for x, y in zip(a[2], b[2])), b[0], i) for i, b in enumerate(rows) if b != a and len(b[2]) == len(a[2]))
        for s, p, _ in [x for x in near if rows[x[2]][1] == a[1]][:k]:
            fits = [x for x in near if rows[x[2]][1] != a[1] and 80 * -s <= 100 * -x[0] <= 100 * -s]
            out += [(a[0], p, n + 1, i, -s, -t) for n, (t, i, _) in enumerate(fits[:k])]
    return sorted(out)


def mined(spark, rows, **more):
    df = spark.createDataFrame([(i, lab, [float(x) for x in v], 1, "b") for i, lab, v in rows],
                               "vec_id long, label long, v array<double>, bucket int, cell string")
    return sorted(map(tuple, triangle_negatives.mine(df, F.col("vec_id") % 10 == 0, **more).collect()))


def test_mining_equals_all_pairs(spark, monkeypatch):
    rnd = random.Random(6)
    rows = [(i, rnd.randint(0, 3), tuple(rnd.randint(-9, 9) for _ in range(4))) for i in range(300)]
    rows += [(1000 + i, 1, (3, 3, 3, 3)) for i in range(120)] + [(2000 + i, 2, (3, 3, 3, 3)) for i in range(60)]  # ties and copies
    rows += [(i, 2, (0, 0, 0, 0)) for i in (4001, 4010)] + rows[:7] + [(20, 0, (1, 2, 3, 4)), (20, 0, (4, 3, 2, 1))]
    want = plain_mining(rows, lambda i: i % 10 == 0)
    assert want and mined(spark, rows) == want
    monkeypatch.setattr(triangle_negatives, "STRIP", 8)
    assert mined(spark, rows, group=40, part=5) == want


def test_windows_spare_work():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 8)) * 100
    v = np.floor(np.repeat(centres, 256, axis=0) + rng.normal(size=(5120, 8)))
    refs = triangle_negatives.References(v, 16)
    angles = refs.angles(v)
    strips = triangle_negatives.Strips(v, angles)
    least, top = strips.bounds(v[:64], angles[:64])
    exact = triangle_negatives.scores(v[:64], strips.vectors)
    for k, at in enumerate(strips.starts):
        part = exact[:, at:at + triangle_negatives.STRIP]
        assert (part.min(axis=1) >= least[:, k]).all() and (part.max(axis=1) <= top[:, k]).all()
    best = np.sort(exact, axis=1)[:, -5]
    assert (top >= best[:, None]).mean() < 0.5  # most strips are not scored


def test_exact_scores_beyond_doubles():
    a, b = np.array([[2.0 ** 30, 1.0]]), np.array([[2.0 ** 30, 1.0], [-2.0 ** 30, 3.0]])
    assert triangle_negatives.scores(a, b).tolist() == [[2 ** 60 + 1, -(2 ** 60) + 3]]


def test_who_takes_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 0.5]), (1, 1, [1.0, 0.25]), (2, 2, [0.8, 0.5]), (3, None, [1.0, 1.0]), (4, 2, None), (5, 2, [nan, 1.0]),
            (6, 2, [inf, 1.0]), (7, 2, [None, 1.0]), (8, 2, []), (9, 2, [1e30, 1.0]), (None, 2, [1.0, 1.0]), (11, 2, [1.0])]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    whole = triangle_negatives.whole_parts(table)
    assert sorted(r.vec_id for r in whole.collect()) == [0, 1, 2, 11]
    got = triangle_negatives.mine(whole, F.col("vec_id") == 0).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 2, 256 * 256 + 64 * 128, 204 * 256 + 128 * 128)]
    assert triangle_negatives.mine(whole.limit(0), F.col("vec_id") == 0).count() == 0


# merges

@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDS)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_op13(spark, library):
    t = pq.read_table(f"{FOLDER}/documents.parquet")
    want = {}
    for d, text in zip(t.column("doc_id").to_pylist(), t.column("text").to_pylist()):
        ids = library.encode(text or "", add_special_tokens=False).ids
        want[d] = (d, len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False)))
    assert {r.doc_id: tuple(r) for r in QUERIES["op13_bpe_tree"](spark, FOLDER).collect()} == want


def test_merges_equal_the_library(library):
    merges = bpe_tree.Merges(WORDS)
    rnd = random.Random(4)
    parts = ["a", "th", "ing", " ", "  ", "\t", "\n", "\x0b", "\x1c", "\x85", "\xa0", "é", "é", "̈", "Σ", "ß", "ẞ", "İ", "ÿ", "×", "÷", "µ", "²",
             "<|endoftext|>", "<|startoftext|>", "<|", "|>", "<|ENDOFTEXT|>", "'s", "'LL", "'", "12", "٣", "中文", "😀", "👩‍👩‍👧", "...", "!?", "​", "　", "ﬁ",
             "Ⅷ", "\x00", "_", "-", "“", "…", "x" * 60]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) for _ in range(3000)]
    texts += ["x" * 20_000, "abc" * 9_000, "é" * 3_000, "😀" * 500, "word " * 300_000]
    pieces = bpe_tree.Pieces(merges)
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert bpe_tree.encode(merges, text) == ids
        assert bpe_tree.decode(merges, ids) == decoded
        assert bpe_tree.digests(pieces, [text])[0] == (len(ids), digest(" ".join(map(str, ids))), digest(decoded))


def test_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(bpe_tree, "CACHE_BYTES", 2000)
    small = bpe_tree.Pieces(bpe_tree.Merges(WORDS))
    text = " ".join("abcdefghij"[i % 10] + "klmnopqrst"[i // 7 % 10] + "uvwxyz" * (i % 3) for i in range(2000))
    found = bpe_tree.digests(small, [text])
    monkeypatch.undo()
    big = bpe_tree.Pieces(small.merges)
    assert found == bpe_tree.digests(big, [text])
    assert len(small) < 30 < len(big)


def test_documents_of_all_kinds(spark):
    rows = [(1, None, "a", 1), (2, "", "b", 2), (3, " \n", None, 3), (3, "one two", "c", None), (None, "one two", "d", 4), (4, "y" * 50_000, "e", 5)]
    table = spark.createDataFrame(rows, "doc_id long, text string, d string, t int")
    got = bpe_tree.encode_documents(table, WORDS, with_ids=True).collect()
    assert len(got) == 6 and sum(r.n_tokens == 0 for r in got) == 3
    two = [r for r in got if r.n_tokens == 2]
    assert len(two) == 2 and two[0].decoded == "one</w> two</w>" and two[0].ids == two[1].ids
    assert all(r.decoded_sha256 == digest(r.decoded) for r in got)
    assert bpe_tree.encode_documents(table.limit(0), WORDS).count() == 0
