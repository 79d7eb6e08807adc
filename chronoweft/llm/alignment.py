"""Alignment of two tokenizers over one byte string: common cuts, linked tokens, corpus-wide counts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweft.llm.common import joined, query, stretches, table
from chronoweft.session import materialise

BLOCK_CHARS, BLOCK_DOCS = 1 << 22, 1 << 13
MEMO, MEMO_BYTES, TOGETHER, TEXTS = 300_000, 64, 2048, 512
B_BITS = 15
BLOCKS = ("block bigint, doc_id array<string>, n_a array<bigint>, n_b array<bigint>, "
          "n_groups array<bigint>, n_links array<bigint>, groups array<string>, stops array<bigint>, "
          "codes binary, times binary, pair array<int>, docs array<int>")
UNEQUAL = (b"", bytes(32), b"")


def _byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


def cuts(begins: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """End of every token in bytes.

    A span (in bytes) that moves on and does not reach into the next one is a clean cut. Tokens that
    share a character, or fall back to its bytes, have overlapping or empty spans: there the decoded
    size says where the token ends.
    """
    clean = np.append(begins[1:] >= ends[:-1], True) & (ends > np.append(0, ends[:-1]))
    run = np.cumsum(sizes)
    last = np.maximum.accumulate(np.where(clean, np.arange(len(ends)), -1))
    return np.where(last < 0, run, ends[last] + run - run[last])


class Aligner:
    """Both tokenizers, and a memo of two generations from stretches of text to their alignment.

    Texts are cut at a blank or line feed between two visible characters: no token of either vocabulary
    reaches over it. An entry has bytes only: groups, each with a semicolon behind it; tokens of A, tokens
    of B, groups, links; pairs. ``UNEQUAL`` stands for a stretch whose bytes differ.
    """

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        alphabet = _byte_alphabet()
        vocabulary = self.a.get_vocab()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            if all(c in alphabet for c in token):
                self.bytes_a[k] = bytes(alphabet[c] for c in token)
        self.bytes_b = []
        for k in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(k)
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(k)
                                else piece.replace("▁", " ").encode())
        self.sizes_a, self.sizes_b = (np.array(list(map(len, x))) for x in (self.bytes_a, self.bytes_b))
        self.said = list(map(str, range(max(len(self.bytes_a), len(self.bytes_b)))))
        self.young: dict[bytes, tuple[bytes, bytes, bytes]] = {}
        self.old: dict[bytes, tuple[bytes, bytes, bytes]] = {}

    def _encode(self, parts: list[bytes]) -> list[tuple[bytes, bytes, bytes]]:
        """Alignment of every part; all are encoded as one text, whose cuts hold the parts apart."""
        raw = b"".join(parts)
        text = raw.decode()
        coded = self.a.encode(text, add_special_tokens=False)
        ids_a = coded.ids
        a = np.array(ids_a)
        spans = np.fromiter(chain.from_iterable(coded.offsets), np.int64, 2 * len(a)).reshape(-1, 2)
        if len(raw) != len(text):
            lead = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
            spans = np.append(np.flatnonzero(lead), len(raw))[spans]
        # the blank that B adds is the first byte here, or stands before a line feed and goes
        own = text[0] == " "
        pieces = self.b.encode(text[own:], return_type="proto", num_threads=1).pieces[not own:]
        ids_b = [x.id for x in pieces]
        b = np.array(ids_b, np.int64)
        begins, ends = (np.array(x, np.int64) + own for x in (
            [x.begin for x in pieces], [x.end for x in pieces]))
        if own and len(begins):
            begins[0] = 0
        if (b"".join(map(self.bytes_a.__getitem__, ids_a)) != raw
                or b"".join(map(self.bytes_b.__getitem__, ids_b)) != raw):
            half = len(parts) // 2
            return self._encode(parts[:half]) + self._encode(parts[half:]) if half else [UNEQUAL]
        ends_a = cuts(spans[:, 0], spans[:, 1], self.sizes_a[a])
        ends_b = cuts(begins, ends, self.sizes_b[b])
        stops = np.cumsum(list(map(len, parts)))
        # between two neighbouring cuts of either lie exactly one token of A and one of B
        at_a, at_b = np.zeros(len(raw) + 1, bool), np.zeros(len(raw) + 1, bool)
        at_a[ends_a], at_b[ends_b] = True, True
        every, both = np.flatnonzero(at_a | at_b), np.flatnonzero(at_a & at_b)
        pair = (a[np.searchsorted(ends_a, every)] << B_BITS) | b[np.searchsorted(ends_b, every)]
        pairs = pair.astype("<u4").tobytes()
        to_a = np.searchsorted(ends_a, both, "right").tolist()
        to_b = np.searchsorted(ends_b, both, "right").tolist()
        text_a, text_b = ([*map(self.said.__getitem__, x)] for x in (ids_a, ids_b))
        groups = [f"{text_a[i] if k - i == 1 else ','.join(text_a[i:k])}|"
                  f"{text_b[j] if m - j == 1 else ','.join(text_b[j:m])};"
                  for i, k, j, m in zip([0, *to_a], to_a, [0, *to_b], to_b)]
        n = np.stack([np.searchsorted(x, stops, "right") for x in (ends_a, ends_b, both, every)], axis=1)
        counts = np.diff(n, axis=0, prepend=0).astype("<i8").tobytes()
        to_g, to_l = n[:, 2].tolist(), (4 * n[:, 3]).tolist()
        return [("".join(groups[g:h]).encode(), counts[at:at + 32], pairs[i:k]) for at, g, h, i, k in zip(
            range(0, 32 * len(parts), 32), [0, *to_g], to_g, [0, *to_l], to_l)]

    def _entries(self, parts: list[bytes]) -> list[tuple[bytes, bytes, bytes]]:
        """Entries of distinct ``parts``; short ones stay in the younger generation."""
        if len(self.young) > MEMO:
            self.old, self.young = self.young, {}
        out = list(map(self.young.get, parts))
        missing = []
        for i, found in enumerate(out):
            if found is not None:
                continue
            p = parts[i]
            out[i] = found = self.old.get(p)
            if found is not None:
                self.young[p] = found
                continue
            text = p.decode()
            if len(p) <= MEMO_BYTES and len(text) > 1 and not text[1].isspace() and not text[-1].isspace():
                missing.append(i)
                continue
            # white space at an edge would run into a neighbour's
            out[i] = self._encode([p])[0]
            if len(p) <= MEMO_BYTES:
                self.young[p] = out[i]
        for at in range(0, len(missing), TOGETHER):
            some = missing[at:at + TOGETHER]
            for i, found in zip(some, self._encode([parts[i] for i in some])):
                out[i] = self.young[parts[i]] = found
        return out

    def documents(self, texts: pa.Array) -> tuple[list[list[int]], list[str], list[np.ndarray]]:
        """Of texts that are not empty: tokens of A, of B, groups and links (a row each), digest of the
        groups, pairs; zeros and nothing where bytes differ."""
        if len(texts) == 0:
            return [], [], []
        blank = pa.scalar(" ", texts.type)
        parts, codes, edges = stretches(pc.binary_join_element_wise(blank, texts, pa.scalar("", texts.type)))
        groups, counts, pairs = zip(*self._entries(parts))
        counts = np.frombuffer(b"".join(counts), "<i8").reshape(-1, 4)[codes]
        equal = np.logical_and.reduceat(counts[:, 0] > 0, edges[:-1])
        counts = np.add.reduceat(counts, edges[:-1], axis=0) * equal[:, None]
        said, to = joined(list(groups), codes, edges)
        digests = [hashlib.sha256(said[i:k - 1]).hexdigest() if e else ""
                   for e, i, k in zip(equal.tolist(), to.tolist(), to[1:].tolist())]
        linked, to = joined(list(pairs), codes, edges)
        linked = np.frombuffer(linked, "<u4")
        return counts.tolist(), digests, [linked[i:k] if e else linked[:0] for e, i, k in zip(
            equal.tolist(), (to // 4).tolist(), (to[1:] // 4).tolist())]


@lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def _blocks(path_a: str, path_b: str):
    def close(seq: int, rows: list[tuple], own: list[np.ndarray]) -> pa.RecordBatch:
        """Links of a block: per document and distinct pair, its place in the block's list of pairs."""
        sizes = [len(x) for x in own]
        doc = np.repeat(np.arange(len(own), dtype=np.uint64), sizes)
        every = np.concatenate(own) if own else np.empty(0, np.uint32)
        pair, code = np.unique(every, return_inverse=True)
        entry, times = np.unique(doc << np.uint64(32) | code.astype(np.uint64), return_counts=True)
        code = (entry & np.uint64(0xFFFFFFFF)).astype("<u4")
        stops = np.searchsorted(entry >> np.uint64(32), np.arange(len(own)), side="right")
        block = TaskContext.get().partitionId() << 32 | seq
        ids, n_a, n_b, n_groups, n_links, digest = map(list, zip(*rows))
        cells = [block, ids, n_a, n_b, n_groups, n_links, digest, stops.tolist(), code.tobytes(),
                 np.minimum(times, 2**32 - 1).astype("<u4").tobytes(), pair.astype(np.int32),
                 np.bincount(code, minlength=len(pair)).astype(np.int32)]
        big, small = pa.list_(pa.int64()), pa.list_(pa.int32())
        text = pa.list_(pa.string())
        types = [pa.int64(), text, big, big, big, big, text, big, pa.binary(),
                 pa.binary(), small, small]
        return pa.RecordBatch.from_arrays(
            [pa.array([c], t) for c, t in zip(cells, types)],
            names=[f.split(" ")[0] for f in BLOCKS.split(", ")])

    def aligned(tool: Aligner, batch: pa.RecordBatch):
        """(doc_id, length of the text, counts, digest, pairs), some documents at a time."""
        for at in range(0, batch.num_rows, TEXTS):
            some = batch.slice(at, TEXTS)
            texts = pc.fill_null(some.column(1), "")
            size = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
            found = zip(*tool.documents(texts.filter(pa.array(size > 0))))
            for key, n in zip(some.column(0).to_pylist(), size.tolist()):
                yield key, n, *(next(found) if n else ((0, 0, 0, 0), "", np.empty(0, "<u4")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = aligner(path_a, path_b)
        seq, chars, rows, own = 0, 0, [], []
        for batch in batches:
            for key, size, counts, digest, pairs in aligned(tool, batch):
                rows.append((key, *counts, digest))
                own.append(pairs)
                chars += size
                if chars >= BLOCK_CHARS or len(rows) >= BLOCK_DOCS:
                    yield close(seq, rows, own)
                    seq, chars, rows, own = seq + 1, 0, [], []
        if rows:
            yield close(seq, rows, own)
    return run


def _sums(blocks, totals):
    import pandas as pd

    if len(blocks) == 0:
        return pd.DataFrame(columns=[f.split(" ")[0] for f in RESULT.split(", ")])
    row = blocks.iloc[0]
    total, best = np.zeros(len(row["pair"]), np.int64), np.zeros(len(row["pair"]), np.int64)
    at = np.searchsorted(row["pair"], totals["pair"].to_numpy())
    total[at], best[at] = totals["total"].to_numpy(), totals["best"].to_numpy()
    code, times = np.frombuffer(row["codes"], "<u4"), np.frombuffer(row["times"], "<u4")
    stops = np.concatenate([[0], row["stops"]]).astype(np.int64)

    def per_document(values: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(values)])[stops])

    times = times.astype(np.int64)
    return pd.DataFrame({
        **{c: row[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")},
        "n_best": per_document(times * best[code]), "count_sum": per_document(times * total[code]),
        "groups_sha256": row["groups"]})


RESULT = ("doc_id string, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, "
          "count_sum bigint, groups_sha256 string")


def align(docs: DataFrame, path_a: str, path_b: str) -> tuple[DataFrame, DataFrame]:
    """Alignment per row of ``docs`` (doc_id, text), and the corpus-wide pairs (a, b, total, best).

    Tokenizer A reads blank + text, B the text (it adds the blank). ``total`` is the number of rows that
    hold the pair linked, ``best`` marks the largest total of an A id, ties included. Rows are kept one
    by one: repeated rows and repeated or null ids count each. Texts that are null, empty or not
    restored by both vocabularies have zeros and an empty digest. Other columns are ignored; long texts
    are aligned whole. Totals are summed per block of documents before anything is shuffled, and every
    block gets back only the totals of its own pairs.
    """
    # ids travel as text: a bigint beside a null would pass through a float
    rows = docs.select(F.col("doc_id").cast("bigint").cast("string").alias("doc_id"), "text")
    blocks = materialise(rows.mapInArrow(_blocks(path_a, path_b), BLOCKS), "alignment")
    own = blocks.select("block", F.explode(F.arrays_zip("pair", "docs")).alias("x")).select(
        "block", "x.pair", "x.docs")
    total = own.groupBy("pair").agg(F.sum("docs").alias("total"))
    pairs = total.withColumn("a", F.shiftright("pair", B_BITS)).withColumn(
        "best", F.col("total") == F.max("total").over(Window.partitionBy("a")))
    pairs = materialise(pairs, "pair-totals")
    back = own.select("block", "pair").join(
        pairs.select("pair", "total", "best"), "pair").withColumnRenamed("block", "of")
    result = blocks.groupBy("block").cogroup(back.groupBy("of")).applyInPandas(_sums, RESULT)
    result = result.withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return result, pairs.select("a", F.expr(f"pair & {(1 << B_BITS) - 1}").alias("b"), "total", "best")


@query("op12_alignment")
def op12(spark, sf_dir):
    import public_tokenizers

    found, _ = align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                     public_tokenizers.path("piece_bpe_32k.model"))
    return found
