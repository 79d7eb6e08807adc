"""Quotation linking: conversations in reply order, without quoted text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweft.llm.common import WordHash, ascii_lower, query, table, windows, words_of
from chronoweft.session import materialise

MARK = r"^(?:[\x20\t]?>)+"
WIDTH = 5


def _lines(text: Column) -> Column:
    """Array of (level, body): quote marks in front of a line, and the line without them."""
    def one(line: Column) -> Column:
        mark = F.regexp_extract(line, MARK, 0)
        return F.struct(F.length(F.regexp_replace(mark, "[^>]", "")).alias("level"),
                        F.regexp_replace(line, MARK + r"[\x20]?", "").alias("body"))
    return F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n", -1), one)


def _norm(body: Column) -> Column:
    return F.trim(F.regexp_replace(ascii_lower(body), r"[\x20\x09-\x0D]+", " "))


def passages(text: str) -> list[tuple[int, list[list[str]]]]:
    """(level, words per line) of every run of lines of one level, in order; blank lines break no run."""
    out: list[tuple[int, list[list[str]]]] = []
    for line in re.split(r"\r?\n", text):
        mark = re.match(MARK, line)
        level = mark[0].count(">") if mark else 0
        words = words_of(line[mark.end():] if mark else line)
        if words and out and out[-1][0] == level:
            out[-1][1].append(words)
        elif words:
            out.append((level, [words]))
    return out


def _windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(conv_id, at, said, level, hashes): equal lines and windows of ``WIDTH`` words; own text (level 0) has
    all shorter windows too, which a quote of fewer words meets."""
    hashes = WordHash()
    for batch in batches:
        out = []
        for conv, at, text in zip(batch["conv_id"], batch["at"], batch["text"]):
            levels: dict[int, set[int]] = {}
            for level, lines in passages(text):
                found = levels.setdefault(level, set())
                found.update(xxhash.xxh3_64_intdigest(" ".join(x).encode("utf-8", "surrogatepass"), 1)
                             for x in lines)
                h = hashes([w for x in lines for w in x])
                for size in range(1, min(WIDTH, len(h)) + 1) if level == 0 else (WIDTH,):
                    found.update(windows(h, size).tolist())
            said = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - 2**63
            out += [(conv, at, said, level, [x - 2**63 for x in found]) for level, found in levels.items()]
        if out:  # empty lists have no type
            yield pd.DataFrame(out, columns=["conv_id", "at", "said", "level", "hashes"])


def sources(messages: DataFrame) -> DataFrame:
    """conv_id, at, level, source, shared: the turn that each level of quotes of turn ``at`` repeats.

    It is the earlier turn of the conversation whose own text shares most lines and word windows with the
    passages of that level, the latest on ties. Equal texts are counted once; pairs are made of the
    different texts of a conversation that share a line or window.
    """
    rows = messages.filter("conv_id is not null and turn is not null and text is not null").select(
        "conv_id", F.col("turn").alias("at"), "text")
    asking = rows.filter(F.regexp_like("text", F.lit("(?m)" + MARK))).select("conv_id").distinct()
    kinds = dict(rows.dtypes)
    found = materialise(rows.join(asking, "conv_id", "left_semi").mapInPandas(
        _windows, f"conv_id {kinds['conv_id']}, at {kinds['at']}, said bigint, level int, "
        "hashes array<bigint>"), "windows")
    texts = found.dropDuplicates(["conv_id", "said", "level"]).select(
        "conv_id", "said", "level", F.explode("hashes").alias("hash"))
    own = texts.filter("level = 0").drop("level")
    pairs = materialise(texts.filter("level > 0").withColumnRenamed("said", "asks").join(
        own, ["conv_id", "hash"]).groupBy("conv_id", "asks", "level", "said").agg(
        F.count(F.lit(1)).alias("shared")), "pairs")
    key = ["conv_id", "asks", "level", "said"]
    said = pairs.join(found.filter("level = 0").select("conv_id", "said", "at"), ["conv_id", "said"])
    asks = pairs.join(found.filter("level > 0").select(
        "conv_id", F.col("said").alias("asks"), "level", "at"), ["conv_id", "asks", "level"])
    cols = [*key, "shared", "at"]
    both = said.select(*cols, F.lit(False).alias("quotes")).unionByName(
        asks.select(*cols, F.lit(True).alias("quotes")))
    before = Window.partitionBy(*key).orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    return both.withColumn("source", F.max(F.when(~F.col("quotes"), F.col("at"))).over(before)).filter(
        "quotes and source is not null").groupBy("conv_id", "at", "level").agg(
        F.max(F.struct("shared", "source")).alias("best")).select(
        "conv_id", "at", "level", "best.source", "best.shared")


def link(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, parent_turn, root_turn, depth, n_quoted, text per message.

    Lines behind ``>`` marks are quotes of that level; lines of one level in a row are a passage, and every
    level is linked to the turn that said it (``sources``). The parent is that of the lowest level which
    repeats a known turn (deeper levels are what the parent quoted); a message that quotes
    nothing known has no parent and begins a thread. (root_turn, depth, turn) is the reply order: a message
    never stands before its parent. ``text`` has the own lines only. Null and empty texts quote nothing; rows
    without conversation or turn are their own thread; rows with one (conv_id, turn) are linked alike.
    """
    rows = messages.select("conv_id", "turn", "role", "text", _lines(F.col("text")).alias("lines"))
    own = F.filter("lines", lambda x: x["level"] == 0)
    rows = rows.select(
        "conv_id", "turn", "role",
        F.trim(F.array_join(F.transform(own, lambda x: x["body"]), "\n")).alias("text"),
        F.array_distinct(F.transform(F.filter(
            "lines", lambda x: (x["level"] == 1) & (_norm(x["body"]) != "")),
            lambda x: F.xxhash64(_norm(x["body"])))).alias("quoted"))
    rows = materialise(rows, "messages")
    parents = sources(messages).groupBy("conv_id", "at").agg(
        F.min(F.struct("level", "source"))["source"].alias("parent_turn"))
    tree = materialise(rows.select("conv_id", "turn").distinct().join(
        parents.withColumnRenamed("at", "turn"), ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "parent_turn", F.coalesce("parent_turn", "turn").alias("root_turn"),
        F.when(F.col("parent_turn").isNull(), 0).otherwise(1).cast("bigint").alias("depth")), "tree")
    while True:  # pointers double: the number of rounds is the logarithm of the longest chain
        up = tree.select("conv_id", F.col("turn").alias("root_turn"),
                         F.col("root_turn").alias("next"), F.col("depth").alias("more"))
        open_ = tree.join(up, ["conv_id", "root_turn"], "left")
        if open_.filter("next <> root_turn").limit(1).count() == 0:
            break
        tree = materialise(open_.select(
            "conv_id", "turn", "parent_turn", F.coalesce("next", "root_turn").alias("root_turn"),
            (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "tree")
    same = rows["conv_id"].eqNullSafe(tree["conv_id"]) & rows["turn"].eqNullSafe(tree["turn"])
    return rows.join(tree, same, "left").select(
        rows["conv_id"], rows["turn"], "role", "parent_turn", "root_turn", "depth",
        F.size("quoted").cast("bigint").alias("n_quoted"), "text")


@query("op2_quotes")
def op2(spark, sf_dir):
    return link(table(spark, sf_dir, "conversations"))
