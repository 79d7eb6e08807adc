"""Licence detection by ordered signature rules; DataFrame functions only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweft.llm.common import ascii_lower, query, table
from chronoweft.llm.spans import spans

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# label, names (patterns over normalised words), version pattern
FAMILIES = [
    ("mit", ["mit", "expat", "x11"], ""),
    ("apache", ["apache", "apache software", "asl"], r"(?: (?:version|v))?(?: [12](?: [01])?)?"),
    ("gpl", ["gpl", "gnu gpl", "gnu general public"], r"(?: (?:version|v))?(?: v?[123])?"),
    ("lgpl", ["lgpl", "gnu lgpl", "lesser general public", "library general public"],
     r"(?: (?:version|v))?(?: [23](?: [01])?)?"),
    ("agpl", ["agpl", "gnu agpl", "affero general public"], r"(?: (?:version|v))?(?: 3)?"),
    ("bsd", ["bsd", "new bsd", "modified bsd", "simplified bsd"], r"(?: [0234] clause)?"),
    ("mpl", ["mpl", "mozilla public"], r"(?: (?:version|v))?(?: [12](?: [01])?)?"),
    ("epl", ["epl", "eclipse public"], r"(?: (?:version|v))?(?: [12](?: 0)?)?"),
    ("cddl", ["cddl", "common development and distribution"], r"(?: 1 [01])?"),
    ("isc", ["isc", "internet systems consortium"], ""),
    ("zlib", ["zlib", "zlib libpng"], ""),
    ("boost", ["boost", "boost software", "bsl"], r"(?: 1 0)?"),
    ("unlicense", ["unlicense"], ""),
    ("artistic", ["artistic", "perl artistic"], r"(?: [12] 0)?"),
    ("python", ["python", "python software foundation", "psf"], r"(?: 2)?"),
    ("ofl", ["ofl", "open font"], r"(?: 1 [01])?"),
    ("cc0", ["cc0", "creative commons zero"], r"(?: 1 0)?"),
    ("cc-by", ["cc by", "creative commons attribution"], r"(?: [1234] [05])?"),
    ("cc-by-sa", ["cc by sa", "creative commons attribution sharealike",
                  "creative commons attribution share alike"], r"(?: [1234] [05])?"),
    ("cc-by-nc", ["cc by nc", "creative commons attribution noncommercial"], r"(?: [1234] [05])?"),
    ("wtfpl", ["wtfpl", "do what the fuck you want to public"], ""),
    ("eupl", ["eupl", "european union public"], r"(?: 1 [012])?"),
    ("ms-pl", ["ms pl", "microsoft public"], ""),
    ("postgresql", ["postgresql"], ""),
    ("openssl", ["openssl"], ""),
]
# how a name is used, priority: a declaration beats a reference, a reference a bare mention
USES = [
    ("spdx license identifier {name}{version}", 95),
    ("licensed under (?:the )?(?:terms of (?:the )?)?{name}{version}(?: licen[sc]e)?", 90),
    ("(?:released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?"
     "{name}{version}(?: licen[sc]e)?", 85),
    ("{name} licen[sc]e{version}", 70),
    ("licen[sc]e {name}{version}", 60),
    ("{name}{version} licensed", 55),
]
# notices that name no licence: pattern, label, priority
NOTICES = [
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 80),
    ("redistribution and use in source and binary forms", "bsd", 80),
    ("permission to use copy modify and or distribute this software for any purpose", "isc", 80),
    ("this program is free software you can redistribute it", "gpl", 75),
    ("released into the public domain", "public-domain", 65),
    ("dedicated to the public domain", "public-domain", 65),
    ("all rights reserved", "proprietary", 30),
    ("copyright (?:c )?[12][0-9]{3}", "copyright", 20),
]


def rules() -> list[tuple[str, str, str, int]]:
    """(keyword, pattern, label, priority) of every rule, highest priority first."""
    out = [(name.split(" ")[0], use.format(name=name, version=version), label, priority)
           for label, names, version in FAMILIES for name in names for use, priority in USES]
    out += [(p.split(" ")[0], p, label, priority) for p, label, priority in NOTICES]
    return sorted(out, key=lambda r: (-r[3], r[2], r[1]))


# what stands, after a blank, wherever a rule matches: a piece of every use, the longest word of every notice
GATE = " (?:" + "|".join([
    "licen[sc]e", *[f"{how} under" for how in ("released", "distributed", "available", "published")],
    *dict.fromkeys(max(re.findall("(?<![^ ])[a-z]+(?![^ ])", p), key=len) for p, _, _ in NOTICES)]) + ")"


def _words(text: Column) -> Column:
    """Words of a text, one blank around each."""
    return F.concat(F.lit(" "), F.array_join(
        F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0)), " "), F.lit(" "))


def _blanks(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def _first(n: Column) -> Column:
    at = [F.instr(n, f" {p} ") for p in BASE]
    return F.least(*[F.when(a > 0, a) for a in at])


def scan(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` plus ``_n``, ``_base``, ``_found``.

    ``_n``: the normalised words; ``_base``: number of base phrases; ``_found``: detections
    (label, priority, start, stop in characters of ``_n``) after suppression. A detection is suppressed
    when another of higher priority, or of equal priority and longer, contains it. Null and empty texts
    give no words and no detection; repeated rows are scanned each. A clash with ``_n``, ``_base`` or
    ``_found`` is overwritten.
    """
    out = docs.withColumn("_n", _words(F.col("text")))
    phrases = "|".join(BASE)
    out = out.withColumn("_base", F.when(F.col("_n").contains(" license "), F.regexp_count(
        "_n", F.lit(f"(?<= )(?:{phrases})(?= )"))).otherwise(0))
    table_ = F.array(*[F.struct(
        F.lit(" " + k).alias("k"), F.lit(f"(?<= ){p}(?= )").alias("p"), F.lit(l).alias("l"),
        F.lit(w).alias("w")) for k, p, l, w in rules()])
    live = F.filter(table_, lambda r: F.contains(F.col("_n"), r["k"]))
    hits = F.flatten(F.transform(live, lambda r: F.transform(
        spans(F.col("_n"), r["p"]), lambda s: F.struct(
            r["l"].alias("label"), r["w"].alias("priority"), s["start"].alias("start"),
            s["stop"].alias("stop")))))
    none = F.expr("cast(array() as array<struct<label:string,priority:int,start:int,stop:int>>)")
    out = out.withColumn("_hits", F.when(F.regexp_like("_n", F.lit(GATE)), hits).otherwise(none))
    rest = F.filter("_hits", lambda h: ~F.exists("_hits", lambda o: (
        (o["start"] <= h["start"]) & (o["stop"] >= h["stop"]) & (
            (o["priority"] > h["priority"]) | ((o["priority"] == h["priority"]) & (
                o["stop"] - o["start"] > h["stop"] - h["start"]))))))
    return out.withColumn("_found", rest).drop("_hits")


@query("op8_licenses")
def op8(spark, sf_dir):
    rows = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = F.col("_n")
    first = _first(n)
    back = F.reverse(n)
    # the last place, seen from the end of the text
    ends = [F.when(F.instr(back, f" {p} "[::-1]) > 0,
                   F.length(n) - (F.instr(back, f" {p} "[::-1]) + len(p))) for p in BASE]
    last = F.greatest(*ends)
    base = F.filter(F.array(*[F.when(n.contains(f" {p} "), F.lit(v)) for p, v in BASE.items()]),
                    lambda x: x.isNotNull())
    labels = F.array_sort(F.array_distinct(F.concat(base, F.transform(
        "_found", lambda h: h["label"]))))
    top = F.greatest(F.coalesce(F.array_max(F.transform("_found", lambda h: h["priority"])),
                                F.lit(0)), F.when(F.col("_base") > 0, 70).otherwise(0))
    any_ = F.col("_base") > 0
    return rows.select(
        "doc_id", F.greatest(_blanks(n) - F.when(n == "  ", 2).otherwise(1), F.lit(0)).cast(
            "bigint").alias("n_words"),
        F.col("_base").cast("bigint").alias("n_base"),
        F.when(any_, _blanks(F.substring(n, F.lit(1), first)) - 1).cast("bigint")
        .alias("first_word"),
        F.when(any_, _blanks(F.substring(n, F.lit(1), last)) - 1).cast("bigint").alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"), (top / 100.0).alias("score"))
