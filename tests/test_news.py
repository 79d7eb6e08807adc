"""Text and URL rules, snapshots, versions, groups, coverage, audits and streams."""

import gzip
import json
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronoweft.functions import text as tx
from chronoweft.functions.urls import canonical_text, canonical_url
from chronoweft.operators import audits as au
from chronoweft.operators import coverage as cv
from chronoweft.operators import news as nw
from chronoweft.operators import sentiment as sn
from chronoweft.operators.dedup import causal_groups
from chronoweft.operators.quality import ContractViolation
from chronoweft.sources import snapshots as sp
from chronoweft.streaming.news_stream import (
    NewsStore, SnapshotNormaliser, rebuild_differences, run_available,
)


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v"))).first()[0]


URLS = {
    "HTTPS://Example.COM:443/a/../bitcoin?utm_source=x&b=2&a=1#fragment":
        "https://example.com/bitcoin?a=1&b=2",
    "http://a.example": "http://a.example/",
    "http://a.example:8080/x//y/./z/": "http://a.example:8080/x/y/z/",
    "https://a.example/%7euser/%2f?q=%41&Q=b%20c": "https://a.example/~user/%2F?Q=b%20c&q=A",
    "https://a.example/?b&a=1=2": "https://a.example/?a=1%3D2&b=",
    "https://a.example/café": "https://a.example/caf%C3%A9",
    "https://a.example:0443/p?FBCLID=1": "https://a.example/p",
    "https://user:pw@a.example/": None, "ftp://a.example/": None, "https://a.example/%zz": None,
    "/relative": None, "https://a.example/a\tb": None, "https://a.example:99999/": None,
}


def test_canonical_urls(spark):
    df = spark.createDataFrame(list(URLS.items()), "u string, want string")
    for r in df.withColumn("got", canonical_url(F.col("u"))).collect():
        assert r.got == r.want, r.u


def test_plain_and_unusual_rules_agree(spark):
    rng = random.Random(4)
    pieces = ["a", "B", "1", "-", "/", "//", "/.", "?", "&", "=", "x=1", "utm_id=3", ":80", "#f",
              ".", "%41", "(", "~", "é"]
    urls = [rng.choice(["http", "HTTPS"]) + "://h" + rng.choice(["", ".Example.org"])
            + "".join(rng.choice(pieces) for _ in range(rng.randint(0, 9))) for _ in range(600)]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    for r in df.withColumn("got", canonical_url(F.col("u"))).collect():
        assert r.got == canonical_text(r.u), r.u


def test_text_rules(spark):
    assert one(spark, " Café  x\x00\n y ", tx.normalize_title) == "Café x y"
    assert one(spark, " ENGLISH\n", tx.language_code) == "en"
    assert one(spark, "German", tx.language_code) is None
    assert one(spark, "Straße", tx.casefold) == "strasse"
    for title, hit in [("Bitcoin up", True), ("BTC City mall", False), ("BTC City and BTC", True),
                       ("bitcoins", False), ("on Satoshi Nakamoto.", True)]:
        assert one(spark, title, tx.selects_title) is hit
    assert one(spark, "https://u:p@H.example:81/p?api%5Fkey=1&x=2#f", tx.redact_url) == \
        "https://h.example:81/p?api%5Fkey=REDACTED&x=2"


def test_plain_unicode_stays_out_of_python(spark, monkeypatch):
    def refuse(values: pd.Series) -> pd.Series:
        assert values.isna().all(), "sent to Python"
        return values

    for name in ("_compose", "_fold", "_compose_fold"):
        monkeypatch.setattr(tx, name, F.pandas_udf(refuse, "string"), raising=False)
    text = "\u00a0Größe  für\n\u2009CAFÉ – Москва\x00 "
    assert one(spark, text, tx.normalize_title) == "Größe für CAFÉ – Москва"
    assert one(spark, text, tx.casefold) == text.casefold()
    assert one(spark, "\tFrançais\n", lambda c: tx.language_code(c, {"français": "fr"})) == "fr"


def test_characters_kept_from_python_need_none_of_its_rules(spark):
    import re
    import unicodedata

    points = [chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    second = {unicodedata.decomposition(c).split()[1] for c in points
              if re.fullmatch(r"[0-9A-F]+ [0-9A-F]+", unicodedata.decomposition(c))}

    def inside(ranges):
        form = re.sub(r"\\x\{(\w+)\}", lambda m: re.escape(chr(int(m[1], 16))), ranges)
        return [c for c in points if re.match(f"[{form}]", c)]

    composed, folded = inside(tx.COMPOSED), inside(tx.FOLDED)
    assert set(folded) <= set(composed) and len(composed) > 30_000
    jamo = {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)}
    assert not [c for c in composed if unicodedata.normalize("NFC", c) != c or unicodedata.combining(c)
                or f"{ord(c):04X}" in second or ord(c) in jamo]
    rows = spark.createDataFrame([(c,) for c in folded], "v string").select(
        "v", tx.casefold(F.col("v")).alias("x")).collect()
    assert not [r["v"] for r in rows if r["x"] != r["v"].casefold()]


def test_title_runs_of_white_space(spark):
    rng, chars = random.Random(5), "ab é\u0301  \t\n\x1c\x85\u2000\u3000\x00"
    texts = ["".join(rng.choices(chars, k=12)) for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts], "v string").select(
        "v", tx.normalize_title(F.col("v")).alias("x")).collect()
    import re
    import unicodedata
    space = "[ \t-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
    for r in rows:
        text = unicodedata.normalize("NFC", r["v"]).replace("\x00", "")
        assert r["x"] == re.sub(space, " ", text).strip(" ")


def test_first_versions_of_candidates_and_of_versions(spark):
    from datetime import datetime
    rows = [(a, f"v{v}", datetime(2024, 1, 1, 0, m), f"T{v}", "en")
            for a, v, m in [("a", 1, 5), ("a", 2, 3), ("a", 2, 9), ("b", 3, 1), ("b", 4, 1)]]
    table = spark.createDataFrame(
        rows, "article_id string, version_fingerprint string, first_seen timestamp, title string, language string")
    firsts = table.groupBy("article_id", "version_fingerprint").agg(
        F.min("first_seen").alias("first_seen"), F.first("title").alias("title"),
        F.first("language").alias("language"))
    want = sorted(map(tuple, nw.initial_versions(firsts).collect()))
    assert want == sorted(map(tuple, nw.initial_versions(table).collect()))
    from chronoweft.functions import identity as idy
    digests = {t: one(spark, t, lambda c: idy.dedup_fingerprint(c, F.lit("en"))) for t in ("T2", "T3")}
    assert [w[2] for w in want] == [digests["T2"], digests["T3"]]



def snapshot_line(n, title="Bitcoin rises", lang="English"):
    return json.dumps({
        "fromUrl": f"https://a.example/{n}", "fromTitle": title, "fromLang": lang,
        "fromDate": "20260101000000", "toUrl": f"https://b.example/{n}", "toTitle": title.upper(),
        "toLang": lang, "toDate": None, "similarity": 0.9})


def write(folder, minute, lines=None, raw=None):
    path = folder / f"{minute}.jsonl.gz"
    path.write_bytes(raw if raw is not None else gzip.compress("".join(
        x + "\n" for x in lines).encode()))


def published(minute):
    return minute + F.expr("INTERVAL 31 SECONDS")


def observations(spark, folder):
    parsed = sp.read_snapshot_files(spark, f"file:{folder}")
    p = published(sp.minute_of_path(F.col("path")))
    receipts = sp.receipts(parsed, ingested_at=p, published_at=p)
    return receipts, sp.endpoint_observations(parsed, receipts).withColumn(
        "rights_ok", F.lit(True))


def test_bad_files_stand_next_to_good_ones(spark, tmp_path):
    write(tmp_path, "20260101010000", [snapshot_line(1)])
    write(tmp_path, "20260101010100", [])
    write(tmp_path, "20260101010200", raw=b"not gzip")
    write(tmp_path, "20260101010300", [snapshot_line(1), "{"])
    write(tmp_path, "20260101010400", [snapshot_line(1), ""])
    write(tmp_path, "20260101010500", ['{"a": NaN}'])
    write(tmp_path, "20260101010600", raw=gzip.compress(b"\xff\xfe"))
    write(tmp_path, "20260101010700", ["[1]"])
    receipts, obs = observations(spark, tmp_path)
    got = {r.filename_timestamp[14:16]: (r.state, r.error_code, r.json_line_count)
           for r in receipts.collect()}
    assert got == {
        "00": ("complete", None, 1), "01": ("complete", None, 0),
        "02": ("invalid", "invalid_gzip", None), "03": ("invalid", "invalid_json", None),
        "04": ("invalid", "invalid_jsonl", None), "05": ("invalid", "malformed_snapshot", None),
        "06": ("invalid", "invalid_utf8", None), "07": ("invalid", "malformed_snapshot", None)}
    assert obs.count() == 2
    assert au.snapshot_violations(receipts, obs).count() == 0
    broken = obs.filter("side = 'from'")
    assert au.snapshot_violations(receipts, broken).first().check == "observation_count"


def test_versions_revisions_and_repeats(spark, tmp_path):
    write(tmp_path, "20260101010000", [snapshot_line(1)])
    write(tmp_path, "20260101010100", [json.dumps({
        "fromUrl": "https://a.example/1", "fromTitle": "Bitcoin falls", "fromLang": "English",
        "toUrl": "https://b.example/1", "toTitle": "BITCOIN RISES", "toLang": "English"})])
    _, obs = observations(spark, tmp_path)
    batch = nw.normalise(obs)
    articles = batch["articles"].toPandas()
    assert len(articles) == 3 and articles.article_id.nunique() == 2
    assert articles.duplicate_group_id.nunique() == 1
    assert batch["links"].filter("reused_existing_version").count() == 1
    assert au.article_violations(batch["articles"]).count() == 0
    assert au.state_violations(batch["articles"], batch["links"], batch["exclusions"],
                               batch["groups"]).count() == 0


def test_exclusion_precedence(spark, tmp_path):
    bad = {"fromUrl": 5, "fromTitle": " ", "fromLang": "German", "fromDate": 3,
           "toUrl": "https://b.example/1", "toTitle": "weather", "toLang": "English"}
    write(tmp_path, "20260101010000", [json.dumps(bad)])
    _, obs = observations(spark, tmp_path)
    out = {r.provider_observation_id[-4:]: r for r in nw.normalise(obs)["exclusions"].collect()}
    assert out["from"].reason == "invalid_timestamp"
    reasons = [x.split(":")[0] for x in out["from"].diagnostic.split("; ")]
    assert reasons == ["invalid_timestamp", "invalid_url_or_identifier",
                       "missing_title_and_content", "unsupported_language"]
    assert out["d:to" if "d:to" in out else "0:to"].reason == "asset_mismatch"


def test_causal_groups_match_brute_force(spark):
    rng = random.Random(9)
    hour = 3_600_000_000
    rows = [(rng.choice("xy"), f"a{i:04d}", rng.randrange(0, 2000) * hour) for i in range(400)]
    want = {}
    for f in "xy":
        anchor = None
        for t, a in sorted((t, a) for k, a, t in rows if k == f):
            if anchor is None or t - anchor[0] > 72 * hour:
                anchor = (t, a)
            want[a] = anchor[1]
    df = spark.createDataFrame(rows, "dedup_fingerprint string, article_id string, t long").select(
        "dedup_fingerprint", "article_id", F.timestamp_micros("t").alias("first_seen_at"))
    got = {r.article_id: r.anchor_article_id for r in causal_groups(df).collect()}
    assert got == want
    # the same in two batches
    cut = F.timestamp_micros(F.lit(1000 * hour))
    first = causal_groups(df.filter(F.col("first_seen_at") < cut)).cache()
    known = first.select("dedup_fingerprint", "anchor_article_id",
                         "anchor_first_seen_at").distinct()
    second = causal_groups(df.filter(F.col("first_seen_at") >= cut), known)
    both = {r.article_id: r.anchor_article_id
            for r in first.select("article_id", "anchor_article_id").union(
                second.select("article_id", "anchor_article_id")).collect()}
    assert both == want


def test_coverage_case(spark):
    plan = cv.retrieval_plan(spark, "2026-01-01 01:00:00", "2026-01-01 01:04:00")
    snaps = spark.createDataFrame(
        [("2026-01-01 01:00:00", "complete", None, 1), ("2026-01-01 01:01:00", "complete", None, 0),
         ("2026-01-01 01:03:00", "invalid", "invalid_gzip", None)],
        "m string, state string, error_code string, json_line_count long").withColumn(
        "minute", F.col("m").cast("timestamp"))
    none = spark.createDataFrame([], "minute timestamp, disposition string")
    states = cv.interval_states(plan, snaps, none, F.lit("2026-01-02").cast("timestamp"))
    gaps = cv.gap_ranges(states.filter("state = 'gap'"))
    r = cv.coverage_report(states, gaps).first()
    assert (r.expected_due_intervals, r.complete_intervals, r.zero_line_intervals,
            r.unresolved_intervals, r.gap_intervals, r.retrieval_rate) == (4, 2, 1, 2, 0, 0.5)
    with pytest.raises(Exception, match="retrieval plan"):
        cv.retrieval_plan(spark, "2026-01-01", "2026-02-01").count()


def test_publication_needs_terminal_coverage(spark, tmp_path):
    write(tmp_path, "20260101010000", [snapshot_line(1)])
    _, obs = observations(spark, tmp_path)
    batch = nw.normalise(obs)

    def report(n):
        return spark.createDataFrame([(0, n)], "pending_intervals long, unresolved_intervals long")

    root = f"file:{tmp_path}/out"
    with pytest.raises(ContractViolation):
        nw.publish(batch, report(1), root, "b1")
    nw.publish(batch, report(0), root, "b1")
    assert spark.read.parquet(f"{root}/articles").count() == 2
    with pytest.raises(Exception, match="exists"):
        nw.publish(batch, report(0), root, "b1")


ATTEMPTS = ("id int, attempt_number int, s int, http_status int, error_kind string, "
            "retry_after_seconds double, retry_disposition string")


def attempts(spark, rows):
    base = 1_800_000_000
    return spark.createDataFrame(rows, ATTEMPTS).withColumns({
        "attempted_at": F.timestamp_seconds(F.col("s") + base),
        "due_at": F.timestamp_seconds(F.lit(base)),
        "terminal_at": F.timestamp_seconds(F.lit(base + 60))})


def test_retry_log(spark):
    good = [(1, 1, 0, 500, None, None, "retry"), (1, 2, 2, 500, None, None, "retry"),
            (1, 3, 6, 500, None, None, "gap"), (2, 1, 0, 404, None, None, "gap")]
    assert au.attempt_violations(attempts(spark, good), ["id"]).count() == 0
    bad = [(1, 1, 0, 500, None, None, "retry"), (1, 2, 1, 500, None, None, "gap"),
           (2, 1, 0, 404, None, None, "gap"), (2, 2, 9, 404, None, None, "gap"),
           (3, 1, -5, 429, None, 9.0, "retry"), (4, 1, 0, 500, "invalid_gzip", None, "gap")]
    got = {(r.id, r.check) for r in au.attempt_violations(attempts(spark, bad), ["id"]).collect()}
    assert {(1, "delay_too_short"), (1, "disposition"), (1, "not_exhausted"),
            (2, "continues_after_terminal"), (3, "before_due"), (3, "not_terminal"),
            (4, "outside_policy")} <= got


def test_revisions_never_flow_backward(spark):
    def at(h):
        return pd.Timestamp("2026-01-01") + pd.Timedelta(hours=h)

    versions = spark.createDataFrame(pd.DataFrame([
        {"group_id": "g", "group_first_seen": at(0), "version_first_seen": at(0), "source": "s",
         "state": "succeeded", "sentiment": 1.0, "relevance": 1.0},
        {"group_id": "g", "group_first_seen": at(0), "version_first_seen": at(5), "source": "s",
         "state": "succeeded", "sentiment": -1.0, "relevance": 1.0}]))
    decisions = spark.createDataFrame(pd.DataFrame({"decision_at": [
        at(-1), at(0), at(4), at(5), at(6), at(23.9), at(24)]}))
    rows = sn.news_features(decisions, versions).orderBy("decision_at").collect()
    assert [r.sentiment_mean_24h for r in rows] == [0, 1, 1, -1, -1, -1, 0]
    assert [r.news_count_24h for r in rows] == [0, 1, 1, 1, 1, 1, 0]
    assert [r.news_count_6h for r in rows] == [0, 1, 1, 1, 0, 0, 0]
    assert rows[-1].hours_since_latest_article == 24.0 and rows[-1].news_missing_24h == 1


def _versions(spark, rows):
    start = pd.Timestamp("2026-01-01")
    return spark.createDataFrame(pd.DataFrame([{
        "group_id": g, "group_first_seen": start + pd.Timedelta(first, "s"),
        "version_first_seen": start + pd.Timedelta(at, "s"), "source": source,
        "state": "succeeded", "sentiment": float(score), "relevance": float(weight),
    } for g, first, at, source, score, weight in rows]))


def test_every_revision_inside_a_minute_counts(spark):
    versions = _versions(spark, [("g", 0, 0, "s", 1, 1), ("g", 0, 20, "s", -1, 1),
                                 ("g", 0, 40, "s", 0.5, 1)])
    at = [pd.Timestamp("2026-01-01") + pd.Timedelta(n, "s") for n in (10, 30, 50)]
    rows = sn.news_features(spark.createDataFrame(pd.DataFrame({"decision_at": at})),
                            versions).orderBy("decision_at").collect()
    assert [r.sentiment_mean_24h for r in rows] == [1, -1, 0.5]


@pytest.mark.parametrize("unit", ["source", "group", "day"])
def test_spread_keeps_its_digits_with_and_without_a_unit(spark, unit):
    rng = np.random.default_rng(4)
    rows = [(f"g{i}", -i * 1800, -i * 1800, f"s{i % 5}", 1e6 + 1e-3 * rng.normal(),
             rng.uniform(0.3, 1)) for i in range(40)]
    rows.append(("null", -60, -60, None, 1e6, 0.5))
    versions = _versions(spark, rows)
    t = pd.Timestamp("2026-01-01 00:00:01")
    decisions = spark.createDataFrame(pd.DataFrame({"decision_at": [t]}))

    def spread(some):
        x, w = np.array([r[4] for r in some]), np.array([r[5] for r in some])
        centre = 1e6 + np.average(x - 1e6, weights=w)
        return np.sqrt(np.average((x - centre) ** 2, weights=w))

    got = sn.news_features(decisions, versions).first()
    assert got.source_count_24h == 5 + 1 and got.news_count_24h == 41
    assert got.sentiment_dispersion_24h == pytest.approx(spread(rows), rel=1e-6)
    name = {"source": lambda r: r[3], "group": lambda r: r[0],
            "day": lambda r: str(pd.Timestamp("2026-01-01") + pd.Timedelta(r[1], "s"))[:10]}[unit]
    for r in sn.leave_one_out(decisions, versions, unit).collect():
        rest = [x for x in rows if name(x) != r.removed]
        assert r.news_count_24h == len(rest)
        assert r.source_count_24h == len({x[3] for x in rest})
        if len(rest) > 1:
            assert r.sentiment_dispersion_24h == pytest.approx(spread(rest), rel=1e-5)


def test_contributions_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(sn, "PART_ROWS", 100, raising=False)
    at = F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("id") * 600_000_000)
    versions = spark.range(300).select(
        F.col("id").cast("string").alias("group_id"), at.alias("group_first_seen"),
        at.alias("version_first_seen"), F.lit("s").alias("source"), F.lit("succeeded").alias("state"),
        F.lit(0.5).alias("sentiment"), F.lit(0.5).alias("relevance"))
    decisions = spark.range(100).select(F.timestamp_micros(
        F.lit(1_704_067_200_000_000) + F.col("id") * 3_600_000_000).alias("decision_at"))
    rows = sn._contributions(sn.visible_versions(versions), decisions, [], "decision_at")
    sizes = [r[0] for r in rows.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert sum(sizes) == 300 * 24 and len(sizes) > 30 and max(sizes) < 1500


def test_stream_equals_batch_and_refuses_regress(spark, tmp_path):
    folder, store = tmp_path / "in", NewsStore(spark, f"file:{tmp_path}/store").create()
    folder.mkdir()
    target = SnapshotNormaliser(store, published, contiguous=True)
    for i in range(3):
        write(folder, f"2026010101{i:02d}00", [snapshot_line(i), snapshot_line(0)])
        run_available(spark, f"file:{folder}", f"file:{tmp_path}/ck", target)
    assert store.read("articles").count() == 6
    assert store.read("links").count() == 12
    assert rebuild_differences(spark, f"file:{folder}", store, published).count() == 0
    assert au.observation_accounting(
        store.read("ledger").withColumn("filename_timestamp", F.date_format(
            "minute", "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        store.read("links"), store.read("exclusions")).count() == 0
    write(folder, "20260101005900", [snapshot_line(9)])
    with pytest.raises(Exception, match="regresses"):
        run_available(spark, f"file:{folder}", f"file:{tmp_path}/ck", target)
    assert store.read("articles").count() == 6
    assert issubclass(ContractViolation, ValueError)


def test_deliveries_of_the_streamed_queries_are_few_files(spark, tmp_path):
    from chronoweft.plans import streams

    rows = [(i, f"storm and flood {i % 37}", "en", f"src{i % 3}") for i in range(600)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(
        f"{tmp_path}/documents.parquet")
    folder, store = streams.streamed_store(spark, str(tmp_path))
    assert store.read("ledger").count() == 60
    arrived = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    assert arrived.count() < 30  # one for each of the 60 minutes would stay with the driver
    assert store.commits().agg(F.sum("files")).first()[0] == 60
    again = rebuild_differences(spark, folder, store, streams.published, packed=True, **streams.OPTIONS)
    assert again.count() == 0 and store.read("articles").count() == 1200
    sp.write_snapshot_table(streams.snapshot_rows(spark, str(tmp_path)).filter("f = 59"), f"{folder}/late")
    paths = sp.read_snapshot_tables(spark, folder).filter("line_number = -1").select("path")
    assert paths.count() == paths.distinct().count() == 61


def test_rebuild_names_the_rows_that_differ(spark, tmp_path):
    folder, store = tmp_path / "in", NewsStore(spark, f"file:{tmp_path}/store").create()
    folder.mkdir()
    write(folder, "20260101010000", [snapshot_line(0)])
    run_available(spark, f"file:{folder}", f"file:{tmp_path}/ck", SnapshotNormaliser(store, published))
    rows = store.read("articles").collect()
    changed = [{**r.asDict(), "exclusion_reason": "x" if i == 0 else None} for i, r in enumerate(rows)]
    store.write("articles", 0, spark.createDataFrame(changed, store.read("articles").schema))
    found = rebuild_differences(spark, f"file:{folder}", store, published)
    assert set(found.columns) == {"article_id", "article_version_id", "row_sha256", "side"}  # no texts
    assert sorted((r.article_id, r.side) for r in found.collect()) == [
        (rows[0].article_id, "left"), (rows[0].article_id, "right")]


def test_a_batch_is_visible_only_with_its_marker(spark, tmp_path, monkeypatch):
    folder, store = tmp_path / "in", NewsStore(spark, f"file:{tmp_path}/store").create()
    folder.mkdir()
    target = SnapshotNormaliser(store, published)
    write(folder, "20260101010000", [snapshot_line(0)])
    run_available(spark, f"file:{folder}", f"file:{tmp_path}/ck", target)
    whole, done = NewsStore.write, []

    def dies(self, name, batch_id, df):
        if len(done) == 3:
            raise RuntimeError("executor gone")
        done.append(name)
        whole(self, name, batch_id, df)

    write(folder, "20260101010100", [snapshot_line(1)])
    monkeypatch.setattr(NewsStore, "write", dies)
    with pytest.raises(Exception, match="executor gone"):
        run_available(spark, f"file:{folder}", f"file:{tmp_path}/ck", target)
    assert [store.read(n).count() for n in ("articles", "links", "ledger")] == [2, 2, 1]
    monkeypatch.setattr(NewsStore, "write", whole)
    run_available(spark, f"file:{folder}", f"file:{tmp_path}/ck", target)
    assert [store.read(n).count() for n in ("articles", "links", "ledger")] == [4, 4, 2]
    # a committed batch that is handed over again is left alone; other files under its id are refused
    files = spark.read.format("binaryFile").load(f"file:{folder}/20260101010100.jsonl.gz")
    monkeypatch.setattr(NewsStore, "write", dies)
    target(files, 1)
    with pytest.raises(ContractViolation, match="other files"):
        target(spark.read.format("binaryFile").load(f"file:{folder}"), 1)


def test_batches_must_be_terminal(spark, tmp_path):
    folder, store = tmp_path / "in", NewsStore(spark, f"file:{tmp_path}/store").create()
    folder.mkdir()
    minute = pd.Timestamp("2026-01-01 01:01:00")
    none = spark.createDataFrame([], "minute timestamp, disposition string")
    proof = spark.createDataFrame([(minute.to_pydatetime(), "retry_exhausted")], none.schema)

    def run(evidence, **more):
        run_available(spark, f"file:{folder}", f"file:{tmp_path}/ck", SnapshotNormaliser(
            store, published, evidence=evidence, **more))

    early = F.lit("2026-01-01 01:05:00").cast("timestamp")
    late = F.lit("2026-01-02 00:00:00").cast("timestamp")
    write(folder, "20260101010000", [snapshot_line(0)])
    with pytest.raises(Exception, match="not due"):
        run(none, as_of=early)
    run(none, as_of=late)
    write(folder, "20260101010200", [snapshot_line(2)])
    run(none, as_of=late, record_refusals=True)
    last = store.commits().orderBy(F.desc("batch_id")).first()
    assert last.outcome == "refused" and last.reason.startswith("minutes lack")
    assert store.read("articles").count() == 2
    (folder / "again").mkdir()
    write(folder / "again", "20260101010200", [snapshot_line(2)])
    run(proof, as_of=late)
    assert store.read("articles").count() == 4
    assert sorted(r.state for r in store.read("ledger").collect()) == ["complete", "complete", "gap"]


def test_streamed_groups_after_2262(spark, tmp_path):
    from chronoweft.streaming.group_stream import grouped_stream

    hours = [0, 1, 72, 73, 200]
    for k, first in enumerate((500_000, 3_000_000, 50_000_000)):  # up to the year 7673
        spark.createDataFrame([("x", f"a{k}{i}", first + h) for i, h in enumerate(hours)],
                              "dedup_fingerprint string, article_id string, h long").selectExpr(
            "dedup_fingerprint", "article_id", "timestamp_seconds(h * 3600) as first_seen_at"
        ).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(
            "dedup_fingerprint string, article_id string, first_seen_at timestamp"
        ).parquet(str(tmp_path / "in"))
        grouped_stream(stream).writeStream.format("parquet").option(
            "path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(
            availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).selectExpr(
        "unix_seconds(first_seen_at) div 3600 as h", "anchor_article_id as a",
        "unix_seconds(anchor_first_seen_at) div 3600 as ah").collect()
    expected = {(first + h, f"a{k}{at}", first + hours[at])
                for k, first in enumerate((500_000, 3_000_000, 50_000_000))
                for h, at in zip(hours, (0, 0, 0, 3, 4), strict=True)}
    assert {tuple(r) for r in got} == expected and len(got) == 15


def test_a_delivery_is_one_batch_however_many_files(spark, tmp_path):
    from chronoweft.streaming.news_stream import run_available

    (tmp_path / "in").mkdir()
    for i in range(10_001):
        (tmp_path / "in" / f"{i}.gz").write_bytes(b"x")
    sizes = []
    run_available(spark, str(tmp_path / "in"), str(tmp_path / "ck"),
                  lambda files, batch: sizes.append(files.select("path").count()))
    assert sizes == [10_001]


def test_packed_files_parse_like_a_folder(spark, tmp_path):
    lines = spark.createDataFrame(
        [(60 * (i // 3), '{"fromUrl":"u%d","fromTitle":"é"}%s' % (i, "}" if i == 4 else ""))
         for i in range(12)], "s long, line string").selectExpr(
        "timestamp_seconds(s) as minute", "line")
    sp.write_snapshot_files(lines, str(tmp_path / "f"))
    columns = ["state", "error_code", "json_line_count", "fromUrl", "fromTitle"]
    minute = sp.minute_of_path(F.col("path")).alias("m")

    def rows(parsed):
        return sorted(map(str, parsed.select(minute, *columns).collect()))

    got = rows(sp.parse_snapshot_files(sp.pack_snapshot_files(lines)))
    assert got == rows(sp.read_snapshot_files(spark, str(tmp_path / "f"))) and len(got) == 13
