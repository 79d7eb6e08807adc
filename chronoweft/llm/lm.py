"""Hidden Markov language model: Baum-Welch over partitions, exact scaled forward scores."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweft.llm.common import query, table
from chronoweft.session import materialise

STATES, CLASSES, SEGMENT, ROUNDS = 4, 4096, 128, 4
SCORED, SIDE_BY_SIDE, RESCALE, BLOCK_BYTES = 512, 1024, 8, 1 << 24
SMOOTH = 0.1
BLOCKS = ("block bigint, doc_id array<bigint>, learn array<boolean>, sizes array<bigint>, codes binary, "
          "kinds binary, word array<bigint>, class array<int>, seen array<bigint>")


def held(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 10 == 0, F.lit(False))


class Tokens:
    """Tokens of some texts, the end of each included: codes into the distinct words (the end is the last
    code), tokens per text, hash and class of every distinct word."""

    def __init__(self, texts: pa.Array, classes: int):
        split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
        coded = split.flatten().dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        words = coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
        n = split.value_lengths().to_numpy(zero_copy_only=False)
        if b"" in words:  # what a blank at an edge leaves
            none = words.index(b"")
            del words[none]
            real = code != none
            edges = np.concatenate([[0], np.cumsum(n)])
            n = np.diff(np.concatenate([[0], np.cumsum(real)])[edges])
            code = code[real]
            code -= code > none
        self.sizes = (n + 1).astype(np.int64)
        ends = np.cumsum(self.sizes) - 1
        self.codes = np.full(int(self.sizes.sum()), len(words), "<u4")
        inner = np.ones(len(self.codes), bool)
        inner[ends] = False
        self.codes[inner] = code
        self.hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        self.classes = np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) % np.uint32(classes)


def _pack(values: np.ndarray, kind: str) -> bytes:
    return pa.compress(values.astype(kind).tobytes(), codec="zstd", asbytes=True)


def _unpack(raw: bytes, n: int, kind: str) -> np.ndarray:
    kind = np.dtype(kind)
    return np.frombuffer(pa.decompress(raw, n * kind.itemsize, codec="zstd", asbytes=True), kind)


def pieces(flat: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of sequences that follow each other in ``flat``, as rows padded with -1, and their number
    per sequence."""
    n = -(-sizes // length)
    last = np.cumsum(n)
    sized = np.full(int(n.sum()), length, np.int64)
    some = n > 0
    sized[last[some] - 1] = sizes[some] - length * (n[some] - 1)
    out = np.full((len(sized), length), -1, np.int32)
    out[np.arange(length) < sized[:, None]] = flat
    return out, n


def segments(seqs: list[np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of all sequences as rows padded with -1, and the number of pieces per sequence."""
    flat = np.concatenate(seqs) if len(seqs) else np.empty(0, np.int32)
    return pieces(flat, np.array([len(s) for s in seqs], np.int64), length)


def _longest_first(seg: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Some rows at a time, longest first: their places, their tokens by step (padding -1), and how many
    reach each step; those come first."""
    sizes = (seg >= 0).sum(axis=1)
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]
    for at in range(0, len(order), SIDE_BY_SIDE):
        rows = order[at:at + SIDE_BY_SIDE]
        steps = int(sizes[rows[0]])
        reach = np.searchsorted(-sizes[rows], -np.arange(steps), "left")
        yield rows, np.ascontiguousarray(seg[rows, :steps].T), reach


def expected(seg: np.ndarray, start, move, emit) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts of first states, moves and emissions over padded pieces.

    Pieces are walked side by side with states as rows. Emissions of a class are divided by their
    largest, which cancels, so that sums need a new scale every ``RESCALE`` steps only.
    """
    k, classes = emit.shape
    first, moves, shown = np.zeros(k), np.zeros((k, k)), np.zeros((k, classes))
    table_ = emit / np.maximum(emit.max(axis=0), 1e-300)
    ahead_of = np.ascontiguousarray(move.T)
    for _, part, reach in _longest_first(seg):
        steps, width = part.shape
        reach = reach.tolist()
        seen = np.where(part < 0, classes, part)
        b = np.empty((steps, k, width))
        for s in range(k):
            b[:, s] = np.append(table_[s], 0.0)[seen]
        alpha, scale = np.zeros_like(b), {}
        np.multiply(start[:, None], b[0], out=alpha[0])
        for t in range(1, steps):
            m = reach[t]
            now = alpha[t, :, :m]
            np.multiply(ahead_of @ alpha[t - 1, :, :m], b[t, :, :m], out=now)
            if t % RESCALE == 0:
                scale[t] = np.maximum(now.sum(axis=0), 1e-300)
                now /= scale[t]
        beta = np.empty((k, width))
        done = 0
        for t in range(steps - 1, -1, -1):
            m = reach[t]
            if m > done:  # pieces that end here
                beta[:, done:m] = 1 / np.maximum(alpha[t, :, done:m].sum(axis=0), 1e-300)
                done = m
            now = beta[:, :m]
            if t:
                ahead = b[t, :, :m] * now
                if t in scale:
                    ahead /= scale[t]
                moves += alpha[t - 1, :, :m] @ ahead.T
            alpha[t, :, :m] *= now
            if t:
                np.matmul(move, ahead, out=now)
        first += alpha[0].sum(axis=1)
        seen = seen.ravel()
        for s in range(k):
            shown[s] += np.bincount(seen, alpha[:, s].ravel(), minlength=classes + 1)[:classes]
    return first, moves * move, shown


def log10_likelihood(seqs: list[np.ndarray], start, move, emit, length: int = SEGMENT) -> np.ndarray:
    """Exact log10 P of every class sequence."""
    return _log10_likelihood(*segments(seqs, length), start, move, emit)


def _log10_likelihood(seg: np.ndarray, n: np.ndarray, start, move, emit) -> np.ndarray:
    """Exact log10 P of every sequence, given its pieces.

    The forward recursion is a product of matrices. The first piece of a sequence is a row of numbers
    from ``start`` on; later pieces are multiplied out side by side and chained per sequence.
    """
    k, top = len(start), np.maximum(emit.max(axis=0), 1e-300)
    table_, log_top = np.append(emit / top, np.zeros((k, 1)), axis=1), np.append(np.log10(top), 0.0)
    ahead_of = np.ascontiguousarray(move.T)

    def walk(rows: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """State sums after each of the rows (states, begins, rows) from every column of ``begin``, before
        a further move, and the log10 of what they were divided by."""
        wide = begin.shape[1]
        out, logs = np.empty((k, wide, len(rows))), np.zeros(len(rows))
        for places, part, reach in _longest_first(seg[rows]):
            steps, width = part.shape
            lost = log_top[part].sum(axis=0)
            now = np.repeat(begin[:, :, None], width, axis=2)
            for t, m in enumerate(reach.tolist()):
                if t:
                    live = np.ascontiguousarray(now[:, :, :m]).reshape(k, wide * m)
                    live = (ahead_of @ live).reshape(k, wide, m)
                else:
                    live = now[:, :, :m]
                live = live * table_[:, None, part[t, :m]]
                if t % RESCALE == RESCALE - 1:
                    total = np.maximum(live.sum(axis=(0, 1)), 1e-300)
                    live /= total
                    lost[:m] += np.log10(total)
                now[:, :, :m] = live
            out[:, :, places], logs[places] = now, lost
        return out, logs

    used = np.flatnonzero(n > 0)
    heads = (np.cumsum(n) - n)[used]
    first, log_first = walk(heads, np.asarray(start)[:, None])
    total = np.maximum(first[:, 0].sum(axis=0), 1e-300)
    out = np.zeros(len(n))
    out[used] = np.log10(total) + log_first
    v = np.zeros((k, len(n)))
    v[:, used] = first[:, 0] / total
    later = np.setdiff1d(np.arange(len(seg)), heads)
    if len(later):
        whole, logs = walk(later, ahead_of)  # a move comes before the first token of a later piece
        owner = np.repeat(np.arange(len(n)), n)[later].tolist()
        for i, at in enumerate(owner):
            after = whole[:, :, i] @ v[:, at]
            total = max(after.sum(), 1e-300)
            out[at] += np.log10(total) + logs[i]
            v[:, at] = after / total
    return out


def blocks_of(classes: int):
    """Texts as blocks of codes; a block is one row and holds some ``BLOCK_BYTES`` of texts at most, or
    one Arrow batch."""
    def close(seq: int, held_: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held_).combine_chunks()
        made = Tokens(rows["text"].combine_chunks(), classes)
        learn = rows["learn"].to_numpy()
        seen = np.bincount(made.codes[np.repeat(learn, made.sizes)],
                           minlength=len(made.hashes) + 1)[:-1]
        block = TaskContext.get().partitionId() << 32 | seq
        cells = [[block], [rows["doc_id"].to_pylist()], [learn.tolist()], [made.sizes],
                 [_pack(made.codes, "<u4")], [_pack(made.classes, "<u4")], [made.hashes.view(np.int64)],
                 [made.classes.astype(np.int32)], [seen]]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary(),
                 pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, kinds)],
                                          names=[f.split(" ")[0] for f in BLOCKS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, held_, size = 0, [], 0
        for batch in batches:
            if held_ and size + batch.nbytes > BLOCK_BYTES:
                yield close(seq, held_)
                seq, held_, size = seq + 1, [], 0
            if batch.num_rows:
                held_.append(batch)
                size += batch.nbytes
        if held_:
            yield close(seq, held_)
    return run


def _sequences(sizes: np.ndarray, codes: bytes, kinds: bytes, words: int,
               classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of a block, and their classes."""
    code = _unpack(codes, int(sizes.sum()), "<u4")
    of = np.append(_unpack(kinds, words, "<u4"), classes).astype(np.int32)
    return code, of[code]


def train(blocks: DataFrame, base: np.ndarray, states: int = STATES, classes: int = CLASSES,
          rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch over every text of ``blocks`` to learn from: each round adds up expected counts of all
    partitions.

    Training sequences are pieces of ``SEGMENT`` tokens. The parameters have a fixed size, states x
    (classes + states + 1) numbers, whatever the vocabulary.
    """
    share = (base + SMOOTH) / (base + SMOOTH).sum()
    draw = np.random.default_rng(11).exponential(size=(states, classes + 1)) + 0.05
    emit = share * draw
    emit /= emit.sum(axis=1, keepdims=True)
    move = np.full((states, states), 0.04 / max(states - 1, 1))
    np.fill_diagonal(move, 0.96 if states > 1 else 1.0)
    start = np.full(states, 1 / states)
    for _ in range(rounds):
        def run(batches: Iterator[pa.RecordBatch], start=start, move=move, emit=emit):
            sums = None
            for b in batches:
                for i in range(b.num_rows):
                    learn, sizes, codes, kinds, words = (c[i] for c in b.columns)
                    learn, sizes = (x.values.to_numpy(zero_copy_only=False) for x in (learn, sizes))
                    _, seq = _sequences(sizes, codes.as_py(), kinds.as_py(), words.as_py(), classes)
                    seg = pieces(seq[np.repeat(learn, sizes)], sizes[learn], SEGMENT)[0]
                    got = np.concatenate([x.ravel() for x in expected(seg, start, move, emit)])
                    sums = got if sums is None else sums + got
            if sums is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums))), pa.array(sums)],
                                                 names=["at", "x"])

        sums = np.zeros(states + states * states + states * (classes + 1))
        for at, x in blocks.select("learn", "sizes", "codes", "kinds", F.size("word").alias("words")).mapInArrow(
                run, "at bigint, x double").groupBy("at").agg(F.sum("x").alias("x")).collect():
            sums[at] = x
        first, moves = sums[:states], sums[states:states + states * states]
        shown = sums[states + states * states:].reshape(states, -1)
        start = (first + 1) / (first + 1).sum()
        move = moves.reshape(states, states) + 1
        move /= move.sum(axis=1, keepdims=True)
        emit = shown + 0.5 * share * len(share) * 0.01 + 1e-6
        emit /= emit.sum(axis=1, keepdims=True)
    return start, move, emit


def score(docs: DataFrame, states: int = STATES, classes: int = CLASSES,
          rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score per row of ``docs``.

    The model learns from rows that are not held out. P(text) = forward likelihood of the hash classes
    times P(word | class) with the smoothed training counts of all words. Every text is split once: its
    tokens are codes into the distinct words of its block of texts, and counts reach a block by a join of
    its distinct words; words with over 1/2000 of all tokens (2000 at most) are broadcast. Null and empty
    texts are one end token; a null doc_id is never held out; repeated rows are scored each.
    """
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    blocks = materialise(rows.select("doc_id", (~held()).alias("learn"), "text").mapInArrow(
        blocks_of(classes), BLOCKS), "blocks")
    seen = blocks.select(F.explode(F.arrays_zip("word", "class", "seen")).alias("x")).select("x.*")
    counts = materialise(seen.filter("seen > 0").groupBy("word").agg(
        F.first("class").alias("class"), F.sum("seen").alias("n")), "counts")
    per_class = counts.groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v"))
    size, kinds = np.zeros(classes + 1), np.zeros(classes + 1)
    for c, n, v in per_class.collect():  # at most one row per class
        size[c], kinds[c] = n, v
    ends = blocks.agg(F.sum(F.size(F.filter("learn", lambda x: x)))).first()[0] or 0
    size[classes], kinds[classes] = ends, min(ends, 1)
    start, move, emit = train(blocks, size, states, classes, rounds)
    tokens, distinct = int(size.sum()), int(kinds.sum())

    asked = blocks.select("block", F.posexplode("word").alias("at", "word"))
    common = F.broadcast(counts.filter(F.col("n") * 2000 > tokens).select("word", "n"))
    known = asked.join(common, "word").select("block", "at", "n").union(
        asked.join(common, "word", "left_anti").join(counts.filter(
            F.col("n") * 2000 <= tokens), "word").select("block", "at", "n")).withColumnRenamed("block", "of")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        made = []
        at, n = (right[c].to_numpy() for c in ("at", "n"))
        for row in left.to_pylist():
            sizes = np.array(row["sizes"], np.int64)
            code, seq = _sequences(sizes, row["codes"], row["kinds"], row["words"], classes)
            of = np.append(_unpack(row["kinds"], row["words"], "<u4"), classes)
            c = np.zeros(row["words"] + 1)
            c[at], c[-1] = n, ends
            base = np.log10((c + SMOOTH) / (tokens + SMOOTH * (distinct + 1)))
            inside = np.log10((c + SMOOTH) / (size[of] + SMOOTH * (kinds[of] + 1)))
            inside[-1] = 0.0  # the end is the only word of its class
            begins = np.cumsum(sizes) - sizes
            forward = _log10_likelihood(*pieces(seq, sizes, SCORED), start, move, emit)
            made.append(pa.table({
                "doc_id": pa.array(row["doc_id"], pa.int64()), "n_tokens": sizes,
                "n_known": np.add.reduceat((c > 0).astype(np.int64)[code], begins),
                "base_score": np.add.reduceat(base[code], begins),
                "score": forward + np.add.reduceat(inside[code], begins)}))
        return pa.concat_tables(made) if made else pa.schema(
            [(c, t) for c, t in (("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                                 ("base_score", pa.float64()), ("score", pa.float64()))]).empty_table()

    coded = blocks.select("block", "doc_id", "sizes", "codes", "kinds", F.size("word").alias("words"))
    scored = coded.groupBy("block").cogroup(known.groupBy("of")).applyInArrow(
        run, "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double")
    return scored.select("doc_id", held().alias("held_out"), "n_tokens", "n_known",
                         F.lit(tokens).cast("bigint").alias("train_tokens"), "base_score", "score")


@query("op3_lm")
def op3(spark, sf_dir):
    return score(table(spark, sf_dir, "documents"))
