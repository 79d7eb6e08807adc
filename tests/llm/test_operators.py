"""Dealt operators on nulls, empties, repeats and clashing columns, and against brute force."""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronoweft.llm import (
    decontamination, embeddings, licenses, lm, minhash, packing, pii, quotes, tokens, toxicity,
)
from chronoweft.llm.common import stretches

BASE = " ".join(f"word{i}" for i in range(60))
ROWS = [
    (1, BASE, "en", "a"), (2, BASE, "en", "a"), (3, BASE + " more", None, "a"), (4, None, "en", None),
    (5, "", "en", "b"), (6, "mail bob@example.com or 10.0.0.1 under the MIT License", "en", "b"),
    (6, "mail bob@example.com or 10.0.0.1 under the MIT License", "en", "b"),
    (None, "no id here", "en", "b"),
]
SCHEMA = "doc_id bigint, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).selectExpr("*", "1 as n", "2 as word", "3 as band")


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 900, dtype=np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 2**63, 100, dtype=np.uint64)])
    for items in (a[:1], a[:5], a):
        assert (minhash.sketch(items) > 0).all()
    assert abs((minhash.sketch(a) == minhash.sketch(b)).mean() - 0.8) < 0.15


def test_near_duplicates(docs, none):
    got = {r.doc_id: r for r in minhash.near_duplicates(docs).collect()}
    assert got[3].component_id == 1 and not got[2].kept and got[1].kept
    assert got[4].n_shingles == 0 and got[4].kept and got[5].component_id == 5
    assert minhash.near_duplicates(none).count() == 0


def test_packing(docs, none):
    rows = packing.best_fit(docs, capacity=50).collect()
    assert sum(r.n_words for r in rows) == 60 + 60 + 61 + 8 + 8 + 3
    bins = packing.pack_block([5, 5, 4, 1], ["a", "a", "b", "b"], [1, 2, 3, 3], 10)
    assert bins[0] != bins[1] and bins[2] != bins[3]
    assert packing.best_fit(none).count() == 0


def test_personal_data(docs, none):
    rows = pii.find(docs).collect()
    assert len(rows) == len(ROWS)
    found = [r for r in rows if r.doc_id == 6]
    assert [(s.start, s.stop) for s in found[0]["_email"]] == [(5, 20)]
    assert [s.hit for s in found[0]["_ip"]] == ["10.0.0.1"]
    assert any("<email>" in (r.text or "") for r in pii.sanitise(docs).collect())
    assert pii.find(none).count() == 0


def test_licences(docs, none):
    rows = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert "mit" in {h.label for h in rows[6]["_found"]} and rows[4]["_found"] == []
    assert licenses.scan(none).count() == 0 and len(licenses.rules()) > 200


def test_every_licence_rule_reaches_its_text(spark):
    """The shortest text of every rule, whatever else it holds."""
    def shortest(pattern):
        pattern = pattern.replace("[sc]", "s").replace("[12][0-9]{3}", "1999")
        while "(?:" in pattern:
            pattern = re.sub(r"\(\?:[^()]*\)\?", "", pattern)
            pattern = re.sub(r"\(\?:([^()|]*)[^()]*\)(?!\?)", r"\1", pattern)
        return pattern

    texts = [(i, shortest(p), label) for i, (_, p, label, _) in enumerate(licenses.rules())]
    texts += [(1000 + i, text, label) for i, (text, label) in enumerate([
        ("Released under MIT.", "mit"), ("available under GPL v3", "gpl"),
        ("distributed under Apache 2.0", "apache"), ("Published under the terms of BSD 3-clause", "bsd")])]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string, want string")
    for r in licenses.scan(docs).collect():
        assert r.want in {h.label for h in r["_found"]}, r.text


def test_toxicity_finds_the_sentence(spark):
    rows = [(i, "calm words here. " + ("you idiot there. " if i % 2 else "fine day now. ") + f"end {i}")
            for i in range(80)]
    docs = spark.createDataFrame(rows + [(900, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id bigint, toxic int")
    weights = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, weights).collect()}
    assert got[1].score > 0.7 > got[2].score and got[1].worst_sentence == 1 and got[900].score == 0
    assert toxicity.keep_clean(docs, weights).count() == 41
    assert toxicity.score(docs.limit(0), toxicity.train(docs, labels.limit(0))).count() == 0


def test_decontamination(spark, docs, none):
    item = "Anna bought 12 apples and 7 pears at the market for 30 euros on a cold day"
    changed = item.replace("12", "15").replace("30", "44")
    rows = spark.createDataFrame([(1, "Intro words. " + changed + ". Outro.", 0), (2, "clean text", 0),
                                  (3, None, 0), (None, item, 0)], "doc_id bigint, text string, share int")
    bench = spark.createDataFrame([(7, item), (8, None), (9, "")], "item_id bigint, text string")
    assert [(r.doc_id, r.item_id) for r in decontamination.matches(rows, bench).collect()] == [(1, 7)]
    assert decontamination.clean(rows, bench).count() == 3
    assert decontamination.clean(none, bench.limit(0)).count() == 0


def _matched(spark, texts, item):
    rows = spark.createDataFrame(texts, "doc_id bigint, text string")
    bench = spark.createDataFrame([(7, item)], "item_id bigint, text string")
    return sorted(r.doc_id for r in decontamination.matches(rows, bench).collect())


def test_decontamination_by_occurrence(spark):
    item = "Anna bought 12 apples and 7 pears at the market for 30 euros on a cold day"
    other = item.replace("12", "15").replace("7", "9").replace("30", "44")
    fill = " ".join(f"filler{i}" for i in range(40))
    torn = item.replace("7 pears", "8 pears").replace("30 euros", "12 euros").replace("12 apples", "30 apples")
    texts = [
        (1, f"{item}. {other}."), (2, f"{other}. {fill} {item}"),  # a worksheet holds item and variant
        (3, f"{fill} {item}. {fill} and 99 pears at the market"),  # one slot window elsewhere
        (4, item.replace("cold day", "day")),  # a word left out
        (5, item[:40] + " " + fill), (6, fill), (8, torn),
        (9, f"{item[:37]}. {fill} {fill} {item[23:]}"),  # in parts, far from each other
        (10, item), (10, other + " " + fill), (10, fill)]  # texts of one id
    assert _matched(spark, texts, item) == [1, 2, 3, 4, 8, 9, 10]
    twice = "He has 5 red pens in a box, he has 8 red pens in a bag"  # templates that repeat in the item
    assert _matched(spark, [(1, fill + " " + twice), (2, fill)], twice) == [1]


def _typed(text, reading):
    """Brute force of Templates."""
    out, begins, counted = [], True, False
    for raw in text.split():
        low = decontamination._EDGE.sub("", raw).lower()
        if low:
            number = bool(decontamination._NUMBER.fullmatch(low))
            upper = decontamination._EDGE.sub("", raw)[0].isupper()
            named = upper and (reading == 1 or (reading == 0 and not begins))
            out.append("<number>" if number else "<unit>" if counted and low in decontamination.UNITS
                       else "<name>" if named else low)
            counted, begins = number, raw[-1] in ".!?:"
        else:
            begins = begins or raw[-1] in ".!?:"
    return out


def test_decontamination_readings(spark):
    item = ("Tom has 5 red apples and two pears. Tom buys 3 more apples from the shop. "
            "Jill eats 2 of the apples for lunch. Tom gives the rest to an aunt.")
    names = item.replace("Tom", "Lena").replace("Jill", "Omar").replace("5", "9")
    texts = [(1, names), (2, "Intro here. " + names + " Outro."), (3, item.upper()), (4, item.lower()),
             (5, item.upper().replace("5", "9")), (6, " ".join(["TEN BIG WORDS STAND HERE"] * 20)),
             (7, "He has many other things and no fruit. " * 5), (8, "Intro: and " + item)]
    assert _matched(spark, texts, item) == [1, 2, 3, 4, 5, 8]
    for short in ("Hello World", "ANNA BOB CARL DORA EMIL FAY", "The Cat"):
        assert _matched(spark, [(1, "Big Dog"), (2, "SOME OTHER WORDS IN CAPITALS. Grey Cat"),
                                (3, "so " + short.lower())], short) == [3]
    template = decontamination.Templates()
    for text in (item, names.upper(), "- 5 km. ... Ann's 7 % :: (Bob) min 3 min\nÉva! ?", "... !", ""):
        ids, kinds = template(text)
        for reading in range(3):
            assert [decontamination.KINDS[k] or template.low[i] for i, k in zip(
                ids.tolist(), kinds[reading].tolist())] == _typed(text, reading)


def test_index_round_trip(spark, docs, none, tmp_path):
    keys = np.unique(np.random.default_rng(2).integers(-2**62, 2**62, 3000))
    assert sorted(tokens.build_index(keys)[1].tolist()) == list(range(len(keys)))
    public = pytest.importorskip("public_tokenizers")
    for name, rows in (("a", docs), ("b", none)):
        path = f"file:{tmp_path}/{name}"
        tokens.write_ids(rows, path, public.path("byte_bpe_50k.json"))
        got = tokens.read_ids(spark, path).orderBy("start").collect()
        assert len(got) == rows.count()
        assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))


def test_ids_equal_a_fresh_encoding(spark, tmp_path):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    bits = [*"ab1.'s \n\t\r", "  ", "\u00a0", "\u3000", "\u00e9", "\U0001f600", "\x1c", "\x85",
            "<|endoftext|>", "\u4e2d", "x" * 70]
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(bits, n)) for n in rng.integers(0, 40, 1500)]
    texts += ["x <|endoftext|> y", "", None, "word " * 40_000]
    made = tokens.Encoder(public.path("byte_bpe_50k.json")).documents([t or "" for t in texts])
    for text, raw in zip(texts, made):
        assert np.frombuffer(raw, "<u4").tolist() == model.encode(
            text or "", add_special_tokens=False).ids
    big = 2**53 + 1
    rows = [(i, t) for i, t in enumerate(texts)] + [(big, "one"), (None, "two"), (None, "three")]
    rows += [(7, f"copy {i % 3}") for i in range(300)]
    path = f"file:{tmp_path}/ids"
    tokens.write_ids(spark.createDataFrame(rows, "doc_id bigint, text string"), path,
                     public.path("byte_bpe_50k.json"), shard_docs=50)
    got = tokens.read_ids(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, *sorted(i for i, _ in rows if i is not None)]
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got[:-1]]]).tolist()
    want = {}
    for i, t in rows:
        ids = np.array([*model.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        want.setdefault(i, []).append(ids)
    have = {}
    for r in got:
        assert r.ids_crc32 == zlib.crc32(r.ids) and r.n_tokens == len(r.ids) // 4
        have.setdefault(r.doc_id, []).append(bytes(r.ids))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    assert sorted(map(bytes, tokens.lookup(spark, path, 7))) == sorted(want[7])
    assert tokens.lookup(spark, path, big) == want[big]
    assert tokens.lookup(spark, path, 10**6) == []


def test_stretches_equal_a_pattern():
    between = re.compile(r"(?<=\S)(?=[ \n]\S)")
    bits = [*"ab.  \n\t\r", "\u00a0", "\u1680", "\u2003", "\u3000", "\u00e9", "\u20ac", "\x1c", "\x85", "\u4e2d"]
    rng = np.random.default_rng(8)
    texts = ["".join(rng.choice(bits, n)) for n in rng.integers(0, 30, 3000)]
    parts, codes, edges = stretches(pa.array(["out", *texts, "out"]).slice(1, len(texts)))
    assert len(set(parts)) == len(parts)
    for text, a, b in zip(texts, edges, edges[1:]):
        assert [parts[k].decode() for k in codes[a:b]] == [p for p in between.split(text) if p]
    assert stretches(pa.array(["", ""]))[2].tolist() == [0, 0, 0]


def test_stretches_are_encoded_side_by_side():
    public = pytest.importorskip("public_tokenizers")
    tool = tokens.Encoder(public.path("byte_bpe_50k.json"))
    model, given = tool.model, []

    class Spy:
        def __getattr__(self, name):
            def call(texts, **how):
                given.extend(texts)
                return getattr(model, name)(texts, **how)
            return call

    tool.model = Spy()
    texts = [" ".join(f"w{i}x{k}" for k in range(20)) for i in range(500)] + ["a <|endoftext|> b"]
    made = tool.documents(texts)
    assert len(given) <= len(texts) + 10  # 10003 different stretches, the first of a text alone
    tool.documents(texts)
    assert len(given) <= len(texts) + 10
    for text, raw in zip(texts, made):
        assert np.frombuffer(raw, "<u4").tolist() == model.encode(text, add_special_tokens=False).ids


def test_vectors(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(600, 16))
    v[300:] = v[:300] + rng.normal(size=(300, 16)) * 0.08
    rows = [(i, x.tolist(), 1) for i, x in enumerate(v)]
    rows += [(700, None, 1), (701, [0.0] * 16, 1), (702, v[0].tolist(), None), (703, v[0].tolist(), 1),
             (704, [float("nan")] * 16, 1)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    got = {r.vec_id: r for r in embeddings.near_vectors(table, shard_rows=200).collect()}
    w = np.concatenate([v, v[:1]])
    u = w / np.linalg.norm(w, axis=1)[:, None]
    links = (u @ u.T >= 0.93).sum(axis=1) - 1
    have = sum(got[i].n_links for i in [*range(600), 703])
    assert have >= 0.98 * links.sum() and have <= links.sum() and got[703].component_id == 0
    assert all(got[i].n_links == 0 and got[i].kept for i in (700, 701, 702, 704))


def test_vectors_of_a_dense_place_are_walked_together(monkeypatch):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(3000, 24))
    v[:900] = v[0] + rng.normal(size=(900, 24)) * 0.02
    v[900:1300] = v[900] + rng.normal(size=(400, 24)) * 0.25
    u = (v / np.linalg.norm(v, axis=1)[:, None]).astype(np.float32)[rng.permutation(3000)]
    graph, widths = embeddings.Graph.build(u), []
    search = embeddings.Graph.search
    monkeypatch.setattr(embeddings.Graph, "search", lambda self, q, width: (
        widths.append(width), search(self, q, width))[1])
    found = [(i, j) for row, node, _ in embeddings.within(graph, u, 0.93)
             for i, j in zip(row.tolist(), node.tolist())]
    true = u @ u.T >= 0.93
    assert max(widths) == embeddings.BEAM  # no beam as wide as the place
    assert len(set(found)) == len(found) >= 0.995 * true.sum() and all(true[p] for p in found)


def test_vector_links_between_shards_count_at_both_ends(spark):
    rng = np.random.default_rng(6)
    v = np.repeat(rng.normal(size=(40, 16)), 12, axis=0) + rng.normal(size=(480, 16)) * 0.01
    rows = [(i, x.tolist(), 1) for i, x in enumerate(v)] + [(480 + i, v[i].tolist(), 1) for i in range(5)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    got = {r.vec_id: r for r in embeddings.near_vectors(table, shard_rows=100, block_rows=30).collect()}
    w = np.concatenate([v, v[:5]])
    u = w / np.linalg.norm(w, axis=1)[:, None]
    links = (u @ u.T >= 0.93).sum(axis=1) - 1
    assert [got[i].n_links for i in range(485)] == links.tolist()
    assert all(got[i].component_id == i // 12 * 12 for i in range(480))


def test_forward_is_exact():
    rng = np.random.default_rng(4)
    start, move, emit = (rng.dirichlet(np.ones(n), size=m) for n, m in ((3, 1), (3, 3), (6, 3)))
    seq = rng.integers(0, 6, 37)
    a = start[0] * emit[:, seq[0]]
    for c in seq[1:]:
        a = (a @ move) * emit[:, c]
    got = lm.log10_likelihood([seq.astype(np.int32)], start[0], move, emit, length=8)
    assert abs(got[0] - np.log10(a.sum())) < 1e-9
    seg, _ = lm.segments([seq.astype(np.int32)], 64)
    first, moves, shown = lm.expected(seg, start[0], move, emit)
    assert abs(first.sum() - 1) < 1e-9 and abs(moves.sum() - 36) < 1e-9 and abs(shown.sum() - 37) < 1e-9


def test_language_model_edges(docs):
    rows = lm.score(docs, rounds=1).collect()
    assert len(rows) == len(ROWS) and all(r.score < 0 for r in rows)


def lm_words(text):
    folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", folded)


def test_language_model_splits_every_text_once(spark):
    texts = ["Ab\x0bAB\x1cx \u00e9", " a  b ", "", None, "\u00c9\u00a0A b\r\nB", "w " * 700 + "end", "held"]
    rows = [(2**53 + 1 + i, t) for i, t in enumerate(texts)] + [(None, "a b")] * 2
    read = spark.sparkContext.accumulator(0)

    def pass_on(text):
        read.add(1)
        return text

    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn(
        "text", F.udf(pass_on, "string").asNondeterministic()("text"))
    got = lm.score(docs, rounds=2).collect()
    assert read.value == len(rows)
    words = {i: lm_words(t) for i, t in rows}
    out = {i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    n = Counter(w for i, t in rows if not out[i] for w in [*lm_words(t), ""])
    total, kinds = sum(n.values()), len(n)
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    for r in got:
        have = [*words[r.doc_id], ""]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (
            out[r.doc_id], len(have), sum(w in n for w in have), total)
        assert r.base_score == pytest.approx(
            sum(np.log10((n[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in have), rel=1e-12)
        assert r.score < 0


def test_quotes(spark):
    rows = [(1, 0, "user", "Hello there\nsecond line"), (1, 1, "assistant", "> hello  there\nhi"),
            (1, 2, "user", "> hi\n>> hello there\nthanks"), (1, 3, "user", None),
            (None, None, None, "> hi")]
    got = {r.turn: r for r in quotes.link(spark.createDataFrame(
        rows, "conv_id bigint, turn bigint, role string, text string")).collect()}
    assert [got[i].parent_turn for i in range(4)] == [None, 0, 1, None]
    assert [got[i].root_turn for i in range(4)] == [0, 0, 0, 3] and got[2].depth == 2
    assert got[2].text == "thanks" and got[None].n_quoted == 1


def test_quoted_passages(spark):
    long = "the boat leaves the old harbour at nine in the morning and returns before dark"
    rows = [
        (1, 0, f"Thanks\n{long}"), (1, 1, "thanks\nsomething else"),
        (1, 2, "> thanks\n> " + long + "\nfine"),  # a common line and a long passage
        (1, 3, ">> " + long[:30] + "\n>>" + long[30:] + "\nnested only, and wrapped"),
        (1, 4, "> returns before dark\nwhen?"),  # part of a line
        (1, 5, "> when?\n>> returns before dark\n>>> thanks\nat ten"),
        (1, 6, "> nobody ever said such words here"), (1, 7, "thanks"), (1, 8, "> thanks")]
    messages = spark.createDataFrame(rows, "conv_id bigint, turn bigint, text string").selectExpr(
        "*", "'user' as role")
    got = {r.turn: r.parent_turn for r in quotes.link(messages).collect()}
    own = {t: [w for level, lines in quotes.passages(x) if level == 0 for v in lines for w in v]
           for _, t, x in rows}

    def shared(at, level, source):  # brute force: words of the longest quoted run that the source said
        n = 0
        for depth, lines in quotes.passages(dict((t, x) for _, t, x in rows)[at]):
            asked = [w for v in lines for w in v]
            for size in range(1, len(asked) + 1) if depth == level else ():
                for i in range(len(asked) - size + 1):
                    if any(own[source][k:k + size] == asked[i:i + size] for k in range(len(own[source]))):
                        n = max(n, size)
        return n

    assert got == {0: None, 1: None, 2: 0, 3: 0, 4: 0, 5: 4, 6: None, 7: None, 8: 7}
    links = {(r["at"], r["level"]): r["source"] for r in quotes.sources(messages).collect()}
    assert links == {(2, 1): 0, (3, 2): 0, (4, 1): 0, (5, 1): 4, (5, 2): 0, (5, 3): 1, (8, 1): 7}
    for (at, level), source in links.items():
        assert shared(at, level, source) == max(shared(at, level, t) for t in range(at))


def test_windows_of_documents_side_by_side():
    import numpy as np
    import pandas as pd

    from chronoweft.llm import decontamination as dc

    texts = ["The tank holds 40 liters of water and 3 fish.", None, "", "two words", "x " * 9, "Ann met Bob in Rome " * 3]
    frame = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})
    every = np.ones(dc.FILTER_BITS, np.uint8)
    template, salt = dc.Templates(), dc.mix(np.arange(1, dc.READINGS, dtype=np.uint64))
    rows = list(zip(frame["doc_id"], frame["text"]))
    apart = [r for row in rows for r in dc._hits(template, [row], every, salt, (2, 5))]
    assert sorted(apart) == sorted(dc._hits(template, rows, every, salt, (2, 5)))
    assert len([r for r in apart if r[0] == 4 and r[2] == 2]) == 8 + 5 and {r[0] for r in apart} == {0, 3, 4, 5}
