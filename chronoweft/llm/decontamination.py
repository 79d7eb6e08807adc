"""Benchmark decontamination by template canonicalisation."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweft.llm.common import hot_join, mix, query, table, windows
from chronoweft.session import materialise

WIDTH, PERCENT, SLOT_PERCENT = 5, 80, 80
FILTER_BITS = 1 << 23
GROUP = 32
UNITS = frozenset(
    "mm cm m km g kg mg t ml l s ms h min sec hours hour minutes minute seconds second days day weeks "
    "week months month years year meters meter metres metre kilometers kilometres miles mile feet foot "
    "inches inch pounds pound ounces ounce grams gram kilograms liters litres dollars dollar euros euro "
    "cents cent percent degrees degree mph kmh kph usd eur gbp".split())
_EDGE = re.compile(r"^[^\w]+|[^\w%]+$")
_NUMBER = re.compile(r"[+-]?[\d][\d.,:/]*%?")


KINDS = ("", "<number>", "<unit>", "<name>")
READINGS = 3
LITERALS = 2


class Templates:
    """Words of a text with typed places, in three readings.

    A number is typed in every reading, and so is a unit, a unit word right after a number. Reading 0 types a
    capitalised word that does not begin a sentence as a name, reading 1 any capitalised word, reading 2
    none: there words count whatever their case. What a raw word says by itself is kept in a bounded memo.
    """

    def __init__(self, limit: int = 400_000):
        self.limit = limit
        self._clear()
        self.kinds = np.array([xxhash.xxh3_64_intdigest(k) for k in KINDS], np.uint64)

    def _clear(self) -> None:
        self.memo: dict[str, int] = {}
        self.low: list[str] = []
        self.hash, self.says = np.empty(1024, np.uint64), np.empty(1024, np.uint8)

    def _look(self, raw: str) -> int:
        word = _EDGE.sub("", raw)
        low = word.lower()
        at = self.memo[raw] = len(self.low)
        self.low.append(low)
        if at == len(self.hash):
            self.hash, self.says = (np.concatenate([x, np.empty_like(x)]) for x in (self.hash, self.says))
        self.hash[at] = xxhash.xxh3_64_intdigest(low.encode("utf-8", "surrogatepass"))
        self.says[at] = (bool(low) | bool(_NUMBER.fullmatch(word)) << 1 | (low in UNITS) << 2
                         | word[:1].isupper() << 3 | (raw[-1] in ".!?:") << 4)
        return at

    def room(self) -> None:
        """Drop the memo if it is full; numbers given out before are void then."""
        if len(self.memo) > self.limit:
            self._clear()

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words (see ``low``) and, per reading, the kind of each place (see KINDS)."""
        memo, look = self.memo, self._look
        ids = np.array([memo[r] if r in memo else look(r) for r in (text or "").split()], np.int64)
        says = self.says[ids]
        at = np.flatnonzero(says & 1)
        ids, word = ids[at], says[at]
        if not len(at):
            return ids, np.zeros((READINGS, 0), np.uint8)
        # a sentence ends at the word before, or at a mark between the two
        ends = np.concatenate([[0], np.cumsum(says >> 4 & 1)])
        begins = np.concatenate([[True], ends[at[1:]] > ends[at[:-1]]])
        number, upper = word & 2 > 0, word & 8 > 0
        unit = np.concatenate([[False], number[:-1]]) & (word & 4 > 0)
        plain = np.where(number, 1, np.where(unit, 2, 0)).astype(np.uint8)
        name = (plain == 0) & upper
        return ids, np.stack([np.where(n, np.uint8(3), plain) for n in (
            name & ~begins, name, np.zeros_like(name))])

    def windows(self, ids: np.ndarray, kinds: np.ndarray, width: int) -> np.ndarray:
        """Hash of every window of a row of ``__call__``."""
        return windows(np.where(kinds > 0, self.kinds[kinds], self.hash[ids]), width)

    def slots(self, ids: np.ndarray, kinds: np.ndarray) -> list[str]:
        return [self.low[i] for i in ids[kinds > 0].tolist()]


FOUND = "id bigint, copy bigint, reading int, length int, at int, window bigint, bare boolean, slots array<string>"


def _hits(template: Templates, some: list[tuple], bits: np.ndarray, salt: np.ndarray,
          sizes: tuple[int, ...]) -> list[tuple]:
    """Rows FOUND of some documents: windows in the filter, hashed side by side for all of them."""
    read = [template(text) for _, text in some]
    lengths = np.array([len(ids) for ids, _ in read])
    ids, kinds = np.concatenate([r[0] for r in read]), np.concatenate([r[1] for r in read], axis=1)
    doc, begins = np.repeat(np.arange(len(some)), lengths), np.cumsum(lengths) - lengths
    copies, out = {}, []
    for reading in range(READINGS):
        for size in sizes:
            if len(ids) < size:
                continue
            w = template.windows(ids, kinds[reading], size)
            if reading:
                w = w ^ salt[reading - 1]
            at = np.flatnonzero(bits[(w & np.uint64(FILTER_BITS - 1)).astype(np.int64)])
            for i in at[doc[at] == doc[at + size - 1]].tolist():
                kind = kinds[reading, i:i + size]
                if reading == 1 and (kind == 0).sum() < LITERALS:
                    continue
                d = int(doc[i])
                key, text = some[d]
                if d not in copies:
                    copies[d] = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - 2**63
                out.append((key, copies[d], reading, int(lengths[d]), i - int(begins[d]),
                            int(w[i]) - 2**63, False, template.slots(ids[i:i + size], kind)))
    return out


def _emit(id_col: str, width: int, mask: np.ndarray | None, sizes: tuple[int, ...]):
    """Rows FOUND: ``copy`` tells texts of one id apart, ``length`` and ``at`` are counted in words.

    Items (no ``mask``) give all windows; a window of reading 1 is bare with fewer than
    ``LITERALS`` words of its own, counts in the size of the item and meets nothing.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        template = Templates()
        salt = mix(np.arange(1, READINGS, dtype=np.uint64))
        bits = None if mask is None else np.unpackbits(mask)
        names = [c.split()[0] for c in FOUND.split(", ")]
        for batch in batches:
            out = []
            rows = list(zip(batch[id_col], batch["text"]))
            if bits is not None:
                for at in range(0, len(rows), GROUP):
                    template.room()
                    out += _hits(template, rows[at:at + GROUP], bits, salt, sizes)
                rows = []
            for key, text in rows:
                template.room()
                ids, kinds = template(text)
                if not len(ids):
                    continue
                copy = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - 2**63
                for reading in range(READINGS):
                    kind = kinds[reading]
                    w = template.windows(ids, kind, width)
                    if reading:
                        w = w ^ salt[reading - 1]
                    size = min(width, len(ids))
                    for i in range(len(w)):
                        bare = reading == 1 and (kind[i:i + size] == 0).sum() < LITERALS
                        out.append((key, copy, reading, len(ids), i, int(w[i]) - 2**63, bare,
                                    template.slots(ids[i:i + size], kind[i:i + size])))
            if out:  # empty lists have no type
                yield pd.DataFrame(out, columns=names)
    return run


def matches(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH,
            percent: int = PERCENT, slot_percent: int = SLOT_PERCENT) -> DataFrame:
    """doc_id, item_id, share, consistent: items whose templates stand in a document.

    An item matches when one of its occurrences passes in one of the readings of ``Templates``: at least ``percent`` of its distinct windows of
    ``width`` template words are there, and at least ``slot_percent`` of its slot values always meet one and
    the same value there. An occurrence is what lies on one offset of item against document, what lies within
    one item length of offsets (two grids, half a length apart; a place of the item counts at its best
    supported offset), or the whole document (an item in scattered parts). In reading 1 windows of fewer than
    two words that are not typed count as not found: a row of names tells nothing. The figures are those of the
    passing occurrence with the largest share. Items shorter than the window match as a whole; null, empty or
    blank items match nothing, null and empty texts contain nothing; repeated rows of a document or item give
    one row per pair of ids, and different texts of one id are occurrences of their own.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").filter(
        "item_id is not null and text is not null")
    wanted = materialise(items.mapInPandas(
        _emit("item_id", width, None, ()), FOUND).withColumnsRenamed(
        {"id": "item_id", "copy": "item_copy"}).distinct(), "item-windows")
    short = items.mapInPandas(_lengths, "n int").filter(f"n < {width} and n > 0").distinct()
    sizes = tuple(sorted({width} | {r[0] for r in short.collect()}))
    # a filter of fixed size (one bit per window hash, 1 MB), whatever the benchmark holds
    spots = wanted.filter("not bare").select(F.expr(
        f"pmod(window, {FILTER_BITS})").alias("spot"))
    mask = np.zeros(FILTER_BITS, np.uint8)
    mask[[r[0] for r in spots.distinct().collect()]] = 1
    mask = np.packbits(mask)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter(
        "doc_id is not null")
    found = materialise(rows.mapInPandas(
        _emit("doc_id", width, mask, sizes), FOUND).drop("length", "reading", "bare").withColumnsRenamed(
        {"id": "doc_id", "at": "doc_at", "slots": "doc_slots"}), "doc-windows")
    grouped = wanted.filter("not bare").groupBy("window").agg(F.collect_list(F.struct(
        "item_id", "item_copy", "reading", "length", "at", "slots")).alias("items"))
    counts = found.groupBy("window").agg(F.count(F.lit(1)).alias("n"))
    hits = hot_join(found, grouped, "window", counts, "inner").select(
        "doc_id", "copy", "doc_at", "window", "doc_slots", F.inline("items"))
    item = ["item_id", "item_copy", "reading"]
    size = wanted.groupBy(*item).agg(F.countDistinct("window").alias("size"))
    # no occurrence has more windows of an item than its document has
    whole = materialise(hits.groupBy("doc_id", *item).agg(F.countDistinct("window").alias("both")).join(
        size, item).filter(F.col("both") * 100 >= F.col("size") * percent).drop("both"), "shares")
    pair = ["doc_id", *item]
    near = hits.join(whole, pair).withColumn("offset", F.col("doc_at") - F.col("at"))
    near = near.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*pair, "copy", "offset")))
    cell = F.floor(F.col("offset") / F.col("length"))
    half = F.floor(F.col("offset") / F.col("length") + 0.5)
    everywhere = F.struct(F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("text"),
                          F.lit(0).cast("bigint").alias("cell"))
    near = near.withColumn("occurrence", F.explode(F.array(everywhere, *[
        F.struct(F.lit(k).alias("kind"), F.col("copy").alias("text"), c.cast("bigint").alias("cell"))
        for k, c in ((1, F.col("offset")), (2, cell), (3, half))])))
    one = [*pair, "occurrence"]
    support = F.struct("n", "offset")
    near = materialise(near.withColumn("best", F.max(support).over(Window.partitionBy(*one, "at"))).filter(
        (F.col("occurrence.kind") == 0) | (F.col("best") == support)).select(
        *one, "size", "window", "slots", "doc_slots"), "occurrences")
    share = near.groupBy(*one).agg(
        F.countDistinct("window").alias("both"), F.first("size").alias("size")).filter(
        F.col("both") * 100 >= F.col("size") * percent).withColumn("share", F.col("both") / F.col("size"))
    steady = near.select(*one, F.explode(F.arrays_zip("slots", "doc_slots")).alias("z")).groupBy(
        *one, F.col("z.slots").alias("value")).agg(
        (F.min("z.doc_slots") == F.max("z.doc_slots")).alias("same")).groupBy(*one).agg(
        F.avg(F.col("same").cast("int")).alias("consistent"))
    passed = share.join(steady, one, "left").withColumn(
        "consistent", F.coalesce("consistent", F.lit(1.0))).filter(
        F.col("consistent") * 100 >= slot_percent)
    return passed.groupBy("doc_id", "item_id").agg(
        F.max(F.struct("share", "consistent")).alias("best")).select(
        "doc_id", "item_id", "best.share", "best.consistent")


def _lengths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    template = Templates()
    for batch in batches:
        template.room()
        yield pd.DataFrame({"n": [len(template(t)[0]) for t in batch["text"]]}).astype("int32")


def clean(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    """The rows of ``docs`` whose document matches no benchmark item; rows without id stay."""
    bad = matches(docs, benchmark, **params).select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)


@query("op6_decontamination")
def op6(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    bad = materialise(matches(docs, table(spark, sf_dir, "benchmark")), "matches").groupBy(
        "doc_id").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    return docs.select("doc_id").join(bad, "doc_id", "left").select(
        "doc_id", F.coalesce(F.size("items") > 0, F.lit(False)).alias("contaminated"),
        F.coalesce("items", F.expr("cast(array() as array<bigint>)")).alias("item_ids"))
