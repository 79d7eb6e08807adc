"""Prefix trie, tokenizer alignment and top-k search against brute force, and their edge cases."""

import hashlib
import math
import random
import zlib
from bisect import bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronoweft.llm import alignment, prefix_trie, top_inner
from chronoweft.llm.common import stretches

TURNS = "conv_id bigint, turn int, role string, text string, lang string, words int, path string"


def conversations():
    """Copies, shared first turns, ties, nulls, a long one and one without turns left."""
    rng = random.Random(3)
    rows = [(None, 0, "user", "no id")]
    for c in range(0, 130):
        if c % 20 == 0 and c % 40:
            continue  # its twenty has no first conversation
        for t in range(rng.choice([1, 1, 2, 3, 5])):
            rows.append((c, t, rng.choice(["user", "assistant", None]),
                         rng.choice(["a b", "a  b\tc", "", None, "ünï x"])))
    rows += [(c, t, "user", "same words") for c in range(200, 260) for t in range(3)]
    rows += [(300, t, "user", f"long {t}") for t in range(400)]
    rows += [(301, None, "user", "null turn"), (301, 0, "user", "b"), (301, 0, "user", "a"),
             (301, 0, "user", "a"), (320, 0, "user", "x")]
    rng.shuffle(rows)
    return [(*r, None, 1, "p") for r in rows]


def brute_trie(rows):
    own = {}
    for c, t, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    paths = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        paths[c] = own.get(c - c % 20, [])[:h] + own[c][h:]
    members, ends = {}, {}
    for c, p in sorted(paths.items()):
        ends.setdefault(tuple(p), []).append(c)
        for d in range(len(p) + 1):
            members.setdefault(tuple(p[:d]), []).append(c)
    out = set()
    below = {p: [q for q in members if q[:len(p)] == p] for p in members}
    parents = Counter(p[:-1] for p in members if p)

    def cost(p):
        return (len(members[p]) - 1) * len(p[-1][1].split()) if p else 0

    for p, m in members.items():
        out.add((m[0], len(p), members[p[:-1]][0] if p else None, len(m), parents[p],
                 sum(parents[q] == 0 for q in below[p]), sum(map(cost, below[p])),
                 hashlib.sha256(",".join(map(str, ends.get(p, []))).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("nodes, rows", [(1 << 16, 1 << 14), (7, 3), (40, 1000)])
def test_trie_equals_brute_force(spark, nodes, rows):
    given = conversations()
    df = spark.createDataFrame(given, TURNS)
    got = prefix_trie.trie(prefix_trie.rebuilt(df), nodes, rows).collect()
    assert {tuple(r) for r in got} == brute_trie(given)
    assert len(got) == len(brute_trie(given))


def test_trie_of_nothing(spark):
    assert prefix_trie.trie(prefix_trie.rebuilt(spark.createDataFrame([], TURNS))).count() == 0


def test_findclose_and_parents():
    rng = np.random.default_rng(5)
    for n in (1, 2, 40, 5000):
        depth = [0]
        for _ in range(n - 1):
            depth.append(int(rng.integers(1, depth[-1] + 2)))
        parens = prefix_trie.Parens.of_depths(np.array(depth))
        stack, close, parent = [], {}, {}
        for at, bit in enumerate(parens.bits.tolist()):
            if bit:
                parent[at] = stack[-1] if stack else None
                stack.append(at)
            else:
                close[stack.pop()] = at
        assert parens.findclose().tolist() == [close[p] for p in parens.open.tolist()]
        opens = parens.open.tolist()
        assert [None if p < 0 else opens[p] for p in parens.parents().tolist()] == [
            parent[p] for p in opens]


@pytest.fixture(scope="module")
def paths():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute_pair(tool, text):
    if not text:
        return None
    raw = (" " + text).encode()
    a, b = tool.a.encode(" " + text, add_special_tokens=False).ids, tool.b.encode(text)
    own_a, own_b = [tool.bytes_a[i] for i in a], [tool.bytes_b[i] for i in b]
    if b"".join(own_a) != raw or b"".join(own_b) != raw:
        return None
    end_a, end_b = np.cumsum([*map(len, own_a)]).tolist(), np.cumsum([*map(len, own_b)]).tolist()
    links = []
    for i, x in enumerate(a):
        j = bisect_right(end_b, end_a[i - 1] if i else 0)
        while j < len(b) and (end_b[j - 1] if j else 0) < end_a[i]:
            links.append((x, b[j]))
            j += 1
    groups, p, q = [], 0, 0
    for c in sorted(set(end_a) & set(end_b)):
        i, j = bisect_right(end_a, c), bisect_right(end_b, c)
        groups.append(f"{','.join(map(str, a[p:i]))}|{','.join(map(str, b[q:j]))}")
        p, q = i, j
    return len(a), len(b), groups, links


def texts():
    rng = random.Random(2)
    alphabet = [*" \n  \t\r<>|ab1é漢🙂 \x1c's.", "<|endoftext|>", "</s>", "<0x0A>", "word", "  ", "▁"]
    out = ["".join(rng.choices(alphabet, k=rng.randint(1, 60))) for _ in range(600)]
    return [*out, None, "", "x", " ", "\n", "x <|endoftext|> y", "twice over", "twice over",
            "한국어와 日本語 ẅ" * 3000, "z" * 30000, " leading", "trailing \n "]


def test_alignment_equals_brute_force(spark, paths, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_CHARS", 2000)
    rows = [(k, t, 1, "p") for k, t in enumerate(texts())] + [(None, "null id", 1, "p"),
                                                               (2**53 + 1, "wide id", 1, "p")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, block int, pair string")
    found, pairs = alignment.align(df, *paths)
    got = {(r.doc_id): tuple(r)[1:] for r in found.collect()}
    tool = alignment.Aligner(*paths)
    made = {r[0]: brute_pair(tool, r[1]) for r in rows}
    total, best = Counter(), {}
    for m in made.values():
        total.update(set(m[3]) if m else [])
    for (a, _), n in total.items():
        best[a] = max(best.get(a, 0), n)
    want = {}
    for k, m in made.items():
        want[k] = (0, 0, 0, 0, 0, 0, "") if m is None else (
            m[0], m[1], len(m[2]), len(m[3]), sum(total[x] == best[x[0]] for x in m[3]),
            sum(total[x] for x in m[3]), hashlib.sha256(";".join(m[2]).encode()).hexdigest())
    assert got == want
    assert {(r.a, r.b): (r.total, r.best) for r in pairs.collect()} == {
        x: (n, n == best[x[0]]) for x, n in total.items()}
    assert alignment.align(df.limit(0), *paths)[0].count() == 0


@pytest.mark.parametrize("memo", [20, 300_000])
def test_batches_of_texts_are_aligned_at_once(paths, monkeypatch, memo):
    monkeypatch.setattr(alignment, "MEMO", memo)
    monkeypatch.setattr(alignment, "TOGETHER", 64)
    tool, calls = alignment.Aligner(*paths), []
    encode = tool._encode
    monkeypatch.setattr(tool, "_encode", lambda parts: calls.append(len(parts)) or encode(parts))
    given = [t for t in texts() if t]
    given += [" ".join(f"w{i}x{k}" for k in range(20)) for i in range(100)]
    for at in (*range(0, len(given), 300), 600):
        some = given[at:at + 300]
        calls.clear()
        counts, digests, pairs = tool.documents(pa.array(some))
        for text, n, digest, linked in zip(some, counts, digests, pairs, strict=True):
            a, b, groups, links = brute_pair(tool, text) or (0, 0, [], [])
            assert n == [a, b, len(groups), len(links)]
            assert digest == (hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
            assert Counter(linked.tolist()) == Counter(x << alignment.B_BITS | y for x, y in links)
    short = max(len(p) for p in tool.young)
    assert short <= alignment.MEMO_BYTES and all(
        len(p) > alignment.MEMO_BYTES for p in stretches(pa.array([" " + t for t in some]))[0]
        if p not in tool.young)
    assert tool.documents(pa.array([], pa.string())) == ([], [], [])
    assert memo == 20 or len(calls) < 20  # the last batch was seen before: only long stretches are new


def test_cuts_of_shared_characters():
    begins, ends = np.array([0, 3, 3, 3, 6]), np.array([3, 3, 3, 6, 7])
    assert alignment.cuts(begins, ends, np.array([3, 1, 1, 1, 1])).tolist() == [3, 4, 5, 6, 7]
    begins, ends = np.array([0, 1, 1, 4]), np.array([4, 4, 4, 5])
    assert alignment.cuts(begins, ends, np.array([2, 1, 1, 1])).tolist() == [2, 3, 4, 5]


VECTORS = "vec_id bigint, embedding array<double>, label int, score int, tag string"


def brute_top(rows, top=5):
    good = [(k, [math.floor(256 * x) for x in v]) for k, v, *_ in rows if k is not None and
            v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for at, (k, q) in enumerate(good):
        if k % 50 == 0:
            scored = sorted((-max(-2**63, min(2**63 - 1, sum(a * b for a, b in zip(q, x)))), i)
                            for n, (i, x) in enumerate(good) if n != at and len(x) == len(q))
            out.update((k, r + 1, i, -s) for r, (s, i) in enumerate(scored[:top]))
    return out


@pytest.mark.parametrize("shard, group, block", [(4096, 32, 16384), (16, 2, 5)])
def test_top_inner_equals_brute_force(spark, shard, group, block):
    rng = np.random.default_rng(4)
    rows = [(k, rng.normal(size=8).round(1).tolist()) for k in range(400)]
    rows += [(k, [1.0] * 8) for k in range(400, 440)]  # ties
    rows += [(450, None), (500, [None] * 8), (550, [math.nan] * 8), (600, [math.inf] * 8), (650, []),
             (651, []), (700, [1.0, 2.0]), (None, [1.0] * 8), (50, [1.0] * 8), (50, [1.0] * 8),
             (2**53 + 1, [0.5] * 8), (750, [-0.3] * 8), (800, [1e9] * 8), (801, [1e18] * 8)]
    df = spark.createDataFrame([(*r, 1, 2, "t") for r in rows], VECTORS)
    found = top_inner.top_inner(df, F.col("vec_id") % 50 == 0, 5, shard, group, block)
    got = Counter(tuple(r) for r in found.collect())
    assert got == brute_top(rows)
    assert top_inner.top_inner(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_bounds_hold_the_score():
    rng = np.random.default_rng(6)
    x, q = np.floor(rng.normal(size=(300, 16)) * 256), rng.normal(size=(20, 16))
    order = np.argsort(-x, axis=0, kind="stable")
    lists = top_inner.Lists(order, np.take_along_axis(x, order, 0))
    assert (lists.rows() == x).all()
    for k in (1, 100, 150, 280, 300):
        low, high = top_inner.bounds(lists, q.astype(np.float32), k)
        score = q @ x.T * lists.scale
        assert (low <= score).all() and (score <= high).all()
