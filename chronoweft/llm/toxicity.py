"""Toxicity by multiple-instance learning: sentences combined by noisy-or."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweft.llm.common import LOWER, UPPER, fold_bytes, query, table

FEATURES = 1 << 18
PREFIX = 5
SAMPLE_ROWS = 6000
THRESHOLD = 0.7
MAX_SENTENCE = 40
BITS, CHUNK = 19, 64
_CUT = bytes.maketrans((UPPER + ".!?\n\r\t\v\f").encode(), (LOWER + "\n\n\n\n\n   ").encode())
_TRIM = re.compile(r"[^\w]+")


def _feature(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % FEATURES + 1 if word else 0


class Sentences:
    """Feature ids of every sentence of a text, with a bounded memo of words.

    A word gives its own feature and one of its first letters, so that forms of a stem share evidence.
    The memo holds both as one number: feature + 1 in the lower ``BITS``, that of the stem above; 0 is none.
    """

    def __init__(self, limit: int = 400_000):
        self.memo: dict[str, int] = {}
        self.limit = limit

    def _add(self, word: str) -> None:
        bare = _TRIM.sub("", word)
        stem = bare[:PREFIX] + "*" if len(bare) >= PREFIX else ""
        self.memo[word] = _feature(bare) | _feature(stem) << BITS

    def arrays(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text of every sentence, and (sentence, feature) of every distinct pair, in order."""
        if len(self.memo) > self.limit:
            self.memo.clear()
        words, lengths, owner = [], [], []
        for i, text in enumerate(texts):
            for part in fold_bytes(text or "", _CUT).split("\n"):
                found = [w for w in part.split(" ") if w]
                words += found
                for at in range(0, len(found), MAX_SENTENCE):
                    lengths.append(min(MAX_SENTENCE, len(found) - at))
                    owner.append(i)
        for word in set(words).difference(self.memo):
            self._add(word)
        packed = np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))
        place = np.repeat(np.arange(len(lengths)), lengths) << BITS
        low = (1 << BITS) - 1
        pairs = np.concatenate([place | packed & low, place | packed >> BITS])
        pairs = np.sort(pairs[pairs & low > 0])
        pairs = pairs[np.diff(pairs, prepend=-1) != 0]
        begins = np.diff(pairs >> BITS, prepend=-1) != 0
        kept = (pairs >> BITS)[begins]
        return np.array(owner, np.int64)[kept], np.cumsum(begins) - 1, (pairs & low) - 1

    def flat(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Features per sentence and all features in sentence order."""
        owner, sentence, feature = self.arrays([text])
        return np.bincount(sentence, minlength=len(owner)), feature


def fit(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rounds: int = 300, rate: float = 0.15,
        decay: float = 1e-5, least_share: float = 0.005) -> np.ndarray:
    """Sentence weights (last entry: bias) by gradient ascent on P(doc) = 1 - prod(1 - p_sentence).

    A bag is the lengths of its sentences and their features, one after the other. Features of fewer than
    ``least_share`` of the bags, or of fewer than three, keep weight 0. One class alone, or no bag, gives a constant.
    """
    w = np.zeros(FEATURES + 1)
    w[-1] = -6.0
    y = np.asarray(labels, float)
    if len(y) == 0 or y.min() == y.max():
        return w
    seen, hits = np.zeros(FEATURES + 1, np.int64), np.zeros(FEATURES + 1, np.int64)
    for (_, features), positive in zip(bags, y > 0):
        own = np.unique(features)
        seen[own] += 1
        hits[own] += positive
    live = seen >= max(3, least_share * len(bags))
    doc, sent, feat, n = [], [], [], 0
    for at, (lengths, features) in enumerate(bags):
        kept = live[features]
        doc.append(np.full(len(lengths), at))
        sent.append((np.repeat(np.arange(len(lengths)), lengths) + n)[kept])
        feat.append(features[kept].astype(np.int64))
        n += len(lengths)
    doc, sent, feat = np.concatenate(doc), np.concatenate(sent), np.concatenate(feat)
    prior = y.mean()
    lift = np.log((hits + 20 * prior) / (seen + 20) / prior)
    w[:-1] = np.where(live, np.clip(lift, -1, 3), 0)[:-1]
    m, v = np.zeros_like(w), np.zeros_like(w)
    for i in range(1, rounds + 1):
        z = np.bincount(sent, w[feat], minlength=len(doc)) + w[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        log_none = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(bags))
        none = np.exp(log_none)
        pull = np.where(y > 0, -none / np.maximum(1 - none, 1e-6), 1.0)
        dz = pull[doc] * p / len(bags)
        g = np.bincount(feat, dz[sent], minlength=FEATURES + 1)
        g += decay * w
        g[-1] = dz.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
    return w


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Weights from at most ``sample_rows`` labelled documents, half of them toxic where possible.

    Rows are taken in the order of a hash of the id; null labels and ids are left out.
    """
    known = labels.filter("doc_id is not null and toxic in (0, 1)").select("doc_id", "toxic")
    part = []
    for value in (1, 0):
        part.append(known.filter(F.col("toxic") == value).orderBy(
            F.crc32(F.concat(F.lit("mil"), F.col("doc_id").cast("string")).cast("binary")),
            "doc_id").limit(sample_rows // 2))
    picked = part[0].union(part[1])

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Flat arrays as bytes: a list of lists would cost the driver many times their size."""
        read = Sentences()
        for b in batches:
            flat = [read.flat(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("toxic"),
                 *[pa.array([x[k].astype("<i4").tobytes() for x in flat], pa.binary()) for k in (0, 1)]],
                names=["doc_id", "toxic", "lengths", "features"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(
        F.broadcast(picked.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                                  F.col("toxic").cast("int").alias("toxic"))), "doc_id").mapInArrow(
        bags, "doc_id bigint, toxic int, lengths binary, features binary").collect()
    rows.sort(key=lambda r: (r[0], len(r[2]), r[2], r[3]))
    return fit([(np.frombuffer(r[2], "<i4"), np.frombuffer(r[3], "<i4")) for r in rows],
               np.array([r[1] for r in rows]))


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, score, worst_sentence (0 based, null without words), worst_score per row of ``docs``.

    A text without words gets the score of no offending sentence, 0. Scores use the text alone.
    """
    w = weights.astype(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Sentences()
        for b in batches:
            total, worst, best = noisy_or(read, b.column("text").to_pylist(), w)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(total), pa.array(worst, pa.int64()), pa.array(best)],
                names=["doc_id", "score", "worst_sentence", "worst_score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        run, "doc_id bigint, score double, worst_sentence bigint, worst_score double")


def keep_clean(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text scores below ``threshold``, scored in place."""
    w = weights.astype(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Sentences()
        for b in batches:
            yield b.filter(pa.array(noisy_or(read, b.column("text").to_pylist(), w)[0] < threshold))

    return docs.mapInArrow(run, docs.schema)


def noisy_or(read: Sentences, texts: list[str | None],
             w: np.ndarray) -> tuple[np.ndarray, list[int | None], np.ndarray]:
    """Score of every text, its worst sentence and that sentence's score."""
    total, best, worst = np.zeros(len(texts)), np.zeros(len(texts)), [None] * len(texts)
    for at in range(0, len(texts), CHUNK):
        part = texts[at:at + CHUNK]
        owner, sentence, feature = read.arrays(part)
        z = np.bincount(sentence, w[feature], minlength=len(owner)) + w[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        none = np.bincount(owner, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(part))
        total[at:at + len(part)] = 0.0 - np.expm1(none)
        ends = np.searchsorted(owner, np.arange(len(part) + 1))
        for i in np.unique(owner).tolist():
            mine = p[ends[i]:ends[i + 1]]
            worst[at + i] = int(mine.argmax())
            best[at + i] = mine[worst[at + i]]
    return total, worst, best


def fold(c: str = "doc_id"):
    return F.crc32(F.col(c).cast("string").cast("binary")) % 3


@query("op9_toxicity")
def op9(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    known = table(spark, sf_dir, "labels").filter(fold() != 1)
    out = score(docs, train(docs, known))
    return out.select("doc_id", (F.coalesce(fold(), F.lit(0)) == 1).alias("held_out"), "score",
                      (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
                      "worst_sentence", "worst_score")
