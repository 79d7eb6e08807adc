"""Personal data: checked spans, and terms that disclose them; DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweft.llm.common import ascii_lower, hot_join, query, table
from chronoweft.llm.spans import spans
from chronoweft.session import materialise

# The patterns of the contract, written so that no run of characters is tried twice and no group
# recurses: a match may begin only where its first run begins, or where the last match ended.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9-]"
             r"(?:(?!\.(?![A-Za-z0-9-]))[A-Za-z0-9.-])*",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:(?![\x20-](?![0-9]))[0-9\x20-])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = list(PATTERNS)
TERM = r"[a-z\x{80}-\x{10FFFF}]{4,}"
MIN_DOCS, MIN_SHARE, MIN_BITS = 3, 0.9, 3.0


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(c: Column) -> Column:
    digits = F.split(F.reverse(_digits(c)), "(?!^)(?!$)")
    parts = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        (d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")))
    return F.aggregate(parts, F.lit(0), lambda a, b: a + b) % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), lambda p: p.cast("double") <= 255)
    if kind == "card":
        n = F.length(_digits(hit))
        return F.when(n.between(13, 19), _luhn(hit)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(hit)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    return F.filter(spans(text, F.lit(PATTERNS[kind])), lambda s: _valid(kind, s["hit"]))


def _joined(kind: str, array: Column) -> Column:
    return F.transform(array, lambda s: F.concat(
        F.lit(kind + ":"), s["start"].cast("string"), F.lit(":"), s["stop"].cast("string")))


def _entity(kind: str, hit: Column) -> Column:
    plain = ascii_lower(hit) if kind == "email" else hit if kind == "ip" else _digits(hit)
    return F.xxhash64(F.lit(kind), plain)


def _entity_of(kind: str):
    return lambda s: _entity(kind, s["hit"])


def _replacement_of(kind: str):
    return lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"),
                              F.lit("" if kind == "term" else f"<{kind}>").alias("by"))


def find(docs: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE,
         min_bits: float = MIN_BITS) -> DataFrame:
    """All columns of ``docs`` plus ``_email _ip _card _phone _term``: arrays of (start, stop, hit).

    A term t (four letters or more) discloses an entity e of its document when both stand together in
    at least ``min_docs`` documents, P(e | t) >= ``min_share`` and the gain log2(P(e | t) / P(e)) is at
    least ``min_bits``; frequencies are document counts over the whole corpus. Null and empty texts have
    no spans. Repeated rows count as documents of their own. Columns beginning with an underscore
    that clash are replaced in the result.
    """
    names = docs.columns
    rows = docs.withColumn("_row", F.xxhash64("doc_id", "text"))
    text = F.coalesce(F.col("text"), F.lit(""))
    for kind in KINDS:
        rows = rows.withColumn("_" + kind, base_spans(text, kind))
    rows = rows.withColumn("_who", F.array_distinct(F.concat(*[
        F.transform("_" + k, _entity_of(k)) for k in KINDS])))
    held = materialise(rows.filter(F.size("_who") > 0).select("_row", "text", "_who"), "held")
    total = docs.count()
    known = held.select(F.explode("_who").alias("who")).groupBy("who").agg(
        F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_docs)
    known = materialise(known, "entities")

    def terms(t: Column) -> Column:
        return F.array_distinct(F.regexp_extract_all(ascii_lower(t), F.lit(TERM), F.lit(0)))

    pairs = held.select("_row", "text", F.explode("_who").alias("who")).join(known, "who")
    joint = pairs.select("who", "n", F.explode(terms(F.col("text"))).alias("term")).groupBy(
        "term", "who").agg(F.count(F.lit(1)).alias("both"), F.first("n").alias("n_who")).filter(
        F.col("both") >= min_docs)
    joint = materialise(joint, "joint")
    wanted = joint.select("term").distinct()
    every = docs.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(
        F.count(F.lit(1)).alias("n_term"))
    freq = every.join(wanted, "term", "left_semi")
    share = F.col("both") / F.col("n_term")
    telling = materialise(joint.join(freq, "term").filter(
        (share >= min_share) & (F.log2(share * total / F.col("n_who")) >= min_bits)).select(
        "who", "term"), "telling")
    by_who = telling.groupBy("who").agg(F.collect_set("term").alias("tell"))
    mine = held.select("_row", "text", F.explode("_who").alias("who"))
    counts = mine.groupBy("who").agg(F.count(F.lit(1)).alias("n"))
    low = ascii_lower(F.col("text"))
    found = hot_join(mine, by_who, "who", counts, "inner").select(
        "_row", F.array_intersect(terms(F.col("text")), F.col("tell")).alias("tell"))
    found = found.groupBy("_row").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("tell")))).alias("tell"))
    out = rows.drop("_who").join(found, "_row", "left")
    exact = F.concat(F.lit(r"(?<![a-z\x{80}-\x{10FFFF}])(?:"), F.array_join("tell", "|"),
                     F.lit(r")(?![a-z\x{80}-\x{10FFFF}])"))
    none = F.expr("cast(array() as array<struct<start:int,stop:int,hit:string>>)")
    marks = F.when(F.size("tell") > 0, spans(low, exact)).otherwise(none)
    out = out.withColumn("_term", marks)
    clear = F.filter("_term", lambda t: ~reduce(lambda a, b: a | b, [
        F.exists("_" + k, lambda b: (b["start"] < t["stop"]) & (t["start"] < b["stop"]))
        for k in KINDS]))
    return out.withColumn("_term", clear).select(
        *[c for c in names if not c.startswith("_") or c not in out.columns],
        *["_" + k for k in KINDS], "_term")


def sanitise(docs: DataFrame, **params) -> DataFrame:
    """The columns of ``docs`` with spans generalised to their kind and disclosing terms removed."""
    found = find(docs, **params)
    text = F.coalesce(F.col("text"), F.lit(""))
    every = F.concat(*[F.transform("_" + k, _replacement_of(k)) for k in [*KINDS, "term"]])
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    # overlapping spans are one cut; the earliest names it
    cut = F.aggregate(
        F.array_sort(every), start,
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["stop"]).alias("at"),
            F.when(s["start"] >= acc["at"], F.concat(
                acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), s["by"]))
            .otherwise(acc["out"]).alias("out")),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    clean = F.when(F.size(every) > 0, cut).otherwise(F.col("text"))
    return found.withColumn("text", clean).select(*docs.columns)


@query("op5_pii")
def op5(spark, sf_dir):
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.concat(*[_joined(k, F.col("_" + k)) for k in KINDS])
    return found.select(
        "doc_id", *[F.size("_" + k).cast("bigint").alias("n_" + k) for k in KINDS],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, _joined("term", F.col("_term"))), ",").alias("spans"))
