"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing names: every operator has a defined result."""

import random

import pytest
from pyspark.sql import functions as F

from voxmill.llm import ann, common, crossparse, decontam, htmltext, langid, mixing, pii, quality, simhash, urlfilter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, fp string, h long, s string, node int"
LONG = "the quick brown fox jumps over the lazy dog again " * 4000


def rows():
    t = "alpha beta gamma delta epsilon zeta eta theta"
    tail = ("x", "fp", 1, "s", 2)
    return [
        (1, t, "en", "a", len(t), *tail),
        (1, t, "en", "a", len(t), *tail),
        (2, t, "en", None, None, *tail),
        (3, None, None, None, None, *tail),
        (4, "", "en", "a", 0, *tail),
        (5, " \t\n", "en", "a", 3, *tail),
        (6, LONG, "en", "b", len(LONG), *tail),
        (None, "mot à mot, un texte français", "fr", "b", 5, *tail),
        (None, None, None, None, None, *tail),
        (8, "\U0001f600 \ud83d".encode("utf-8", "replace").decode() + " 123", None, "b", 9, *tail),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(
        [(1, "beta gamma delta epsilon zeta eta", 0), (2, None, 0), (3, "", 0), (4, "two words", 0), (None, "alpha beta gamma delta epsilon", 0), (1, "beta gamma delta epsilon zeta eta", 0)],
        "item_id long, text string, id int",
    )


def test_language(docs, none):
    model = langid.learn(docs)
    out = {(r["doc_id"], r["text"]): r for r in langid.identify(docs, model).collect()}
    assert len(langid.identify(docs, model).columns) == len(docs.columns) + 4
    assert out[3, None]["lang_pred"] == out[4, ""]["lang_pred"] == "und" and out[3, None]["lang_score"] == 0
    assert out[1, rows()[0][1]]["lang_pred"] == "en" and out[6, LONG]["lang_pred"] == "en"
    assert [r for r in out.values() if r["lang"] == "fr"][0]["lang_pred"] == "fr"
    assert langid.learn(none).langs == []
    assert langid.identify(docs, langid.learn(none)).where("lang_pred <> 'und'").isEmpty()
    assert langid.identify(none, model).isEmpty()


def test_simhash(docs, none):
    out = simhash.near_duplicates(docs).collect()
    assert len(out) == len(rows())
    by = {}
    for r in out:
        by.setdefault(r["id"], []).append(r)
    assert {r["component_id"] for r in by[1]} == {1} and by[2][0]["component_id"] == 1
    assert by[3][0]["component_id"] == by[4][0]["component_id"] == by[5][0]["component_id"] == 3 and by[4][0]["fp"] == 0
    assert simhash.near_duplicates(none).isEmpty()


def test_simhash_repeated_ids_link_their_texts(spark):
    d = spark.createDataFrame([(5, "one two three four"), (5, "other words here now"), (9, "other words here now"), (7, "one two three four")], "doc_id long, text string")
    assert {(r["id"], r["component_id"]) for r in simhash.near_duplicates(d).collect()} == {(5, 5), (9, 5), (7, 5)}


def test_simhash_stage_keeps_one_row(docs, spark):
    out = simhash.stage(spark, docs, "")
    assert out.columns == docs.columns
    ids = [r["doc_id"] for r in out.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 3, 6, 8] and ids.count(None) == 2


def test_decontamination(docs, none, items):
    out = {(r["id"], r["item_id"]): r["containment"] for r in decontam.contained(docs, items).collect()}
    assert out == {(1, 1): 1.0, (2, 1): 1.0}
    assert decontam.contained(none, items).isEmpty() and decontam.contained(docs, items.limit(0)).isEmpty()


def test_mixing(docs, none):
    out = mixing.mix(mixing.features(docs)).collect()
    assert len(out) == len(rows())
    for r in out:
        assert 0 <= r["mix_probability"] <= 1
        if not (r["text"] or "").split():
            assert r["mix_weight"] == 0 and not r["mix_sampled"]
    assert mixing.mix(mixing.features(none)).isEmpty()


def test_mixing_reaches_given_targets(spark):
    rng = random.Random(0)
    data = [(i, " ".join(["w"] * rng.randint(1, 9)), rng.choice("xy"), rng.choice(["en", "fr", None])) for i in range(200)]
    d = spark.createDataFrame(data, "doc_id long, text string, source string, lang string")
    f = mixing.mix(mixing.features(d), {"source": {"x": 3, "y": 1}, "lang": {"en": 0.5, "fr": 0.5}})
    w = {r[0]: r[1] for r in f.groupBy("source").agg(F.sum("mix_weight")).collect()}
    assert abs(w["x"] / w["y"] - 3) < 1e-6
    assert f.where("lang is null and mix_weight > 0").isEmpty()
    tokens, kept = f.where("lang is not null").agg(F.sum("mix_tokens"), F.sum(F.col("mix_tokens") * F.col("mix_probability"))).first()
    assert abs(kept / f.agg(F.sum("mix_tokens")).first()[0] - 0.5) < 1e-9 and tokens > kept


def test_mixing_keeps_columns_of_any_name(spark):
    d = spark.createDataFrame([(i, "a b c", "x", "en", "mine", i, "p", i) for i in range(9)], "doc_id long, text string, source string, lang string, rate string, p long, tokens string, mix_weight long")
    out = mixing.mix(mixing.features(d))
    assert [r["rate"] for r in out.collect()] == ["mine"] * 9 and out.columns.count("mix_weight") == 1 and out.schema["mix_weight"].dataType.typeName() == "double"


@pytest.mark.parametrize("few,literals", [(True, 256), (True, 0), (False, 0)])
def test_raking_meets_its_targets_or_warns(spark, few, literals, monkeypatch):
    monkeypatch.setattr(mixing, "fits", lambda df: few)
    monkeypatch.setattr(mixing, "LITERALS", literals)
    cells = spark.createDataFrame([(s, t, "z", float(n)) for s, t, n in [("a", "x", 50), ("a", "y", 30), ("b", "x", 20), ("b", "y", 40), ("c", "y", 9)]], "source string, lang string, topic string, tokens double")
    goal = lambda dim, shares: spark.createDataFrame(list(shares.items()), f"{dim} string, target double")
    out = mixing.rake(cells, {"source": goal("source", {"a": 0.2, "b": 0.5, "c": 0.1, "gone": 0.2}), "lang": goal("lang", {"x": 0.45, "y": 0.55})}, tolerance=1e-4, most_rounds=30)
    for dim, want in (("source", {"a": 0.25, "b": 0.625, "c": 0.125}), ("lang", {"x": 0.45, "y": 0.55})):
        for r in out.groupBy(dim).agg(F.sum("weight")).collect():
            assert abs(r[1] - want[r[0]]) < 1e-4
    with pytest.warns(UserWarning, match="can't all be met"):  # c has no x, so b and a can't give y this little
        mixing.rake(cells, {"source": goal("source", {"a": 0.1, "b": 0.1, "c": 0.8}), "lang": goal("lang", {"x": 0.9, "y": 0.1})}, most_rounds=3)


def test_topics_are_the_form_of_the_text_or_given(spark):
    texts = ["plain words of prose in a row", "Licensed under CC BY. All else is prose", "a | b | c | d", "OH!! NO!! yes", "12 of 1990 34", "", None]
    d = spark.createDataFrame([(i, t, "s", "en", f"t{i}") for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string, subject string")
    assert [r["mix_topic"] for r in mixing.features(d).orderBy("doc_id").collect()] == ["prose", "legal", "table", "noise", "figures", "none", "none"]
    assert {r["mix_topic"] for r in mixing.features(d, topic_col="subject").collect()} == {f"t{i}" for i in range(7)}


def test_reached_marginals_are_those_wanted_where_nothing_runs_out(spark):
    d = spark.createDataFrame([(i, "w w w", "xy"[i % 2], "en") for i in range(100)], "doc_id long, text string, source string, lang string")
    cells = mixing.plan(mixing.features(d), {"source": {"x": 0.6, "y": 0.4}})
    assert all(abs(r["wanted"] - r["sampled"]) < 1e-9 for r in mixing.reached(cells, "source").collect())


def test_calibration_gives_what_cells_that_run_out_cannot(spark):
    cells = spark.createDataFrame([(1.0, 100.0), (10.0, 3.0), (1000.0, 1.0), (0.0, 0.0)], "tokens double, rate double")
    c = mixing.calibrate(cells, 0.5)
    assert abs(sum(t * min(1, c * r) for t, r in ((1, 100), (10, 3), (1000, 1))) - 505.5) < 1e-6
    assert mixing.calibrate(cells.limit(0), 0.5) == 0


def test_pii(docs, none):
    out = pii.pseudonyms(docs, b"k")
    assert out.count() == len(rows()) and pii.pseudonyms(none, b"k").isEmpty()
    with pytest.raises(ValueError):
        pii.pseudonyms(docs, b"")
    same = {r["doc_id"]: r for r in out.collect()}
    assert same[6]["text"] == LONG and same[3]["text"] is None and same[3]["pii_kinds"] == []


def test_crossparse(docs, none):
    out = crossparse.entropies(docs)
    assert out.count() == len(rows()) and crossparse.entropies(none).isEmpty()
    for r in out.collect():
        assert (r["n_chars"] == 0) == (r["phrases"] == 0)


def test_quality(docs, none, spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (6, 1, 0), (3, 0, None), (None, 1, 0), (8, None, 1), (4, 0, 0)], "doc_id long, quality int, toxic int")
    s = quality.learn(docs, labels)
    out = quality.score(docs, s)
    assert out.count() == len(rows()) and out.where("quality_score is null or quality_score < 0 or quality_score > 1").isEmpty()
    assert quality.learn(docs, labels.limit(0)).prior == 0.5
    assert quality.score(none, s).isEmpty()


def test_html(spark):
    d = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, "<p>a &amp;", 3), (None, "<script>x", 4), (3, "<p>a &amp;", 3)], "page_id long, html string, text int")
    assert [r["main_text"] for r in htmltext.extract(d).orderBy("text").collect()] == ["", "", "a &", "a &", ""]
    assert htmltext.extract(d.limit(0)).isEmpty()


def test_ann(spark):
    data = [(i, [float(i % 5), 1.0, 0.5], "a") for i in range(30)] + [
        (100, None, "a"), (101, [0.0, 0.0, 0.0], "a"), (102, [float("nan"), 1.0, 1.0], "a"), (103, [None, 1.0, 1.0], "a"), (104, [float("inf"), 1.0, 1.0], "a"), (None, [1.0, 1.0, 1.0], "a"), (105, [1.0], "a"),
    ]
    v = spark.createDataFrame(data, "vec_id long, embedding array<float>, rank string")
    out = ann.search(v, v.where("vec_id % 20 = 0"), k=4).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in out if r["query_id"] == 0] == [(0, 1, 5), (0, 2, 1), (0, 3, 2), (0, 4, 3)] or {r["query_id"] for r in out} == {0, 20}
    best = sorted(((-sum(a * b for a, b in zip(data[0][1], data[j][1])), j) for j in range(1, 30)))[:4]
    assert [r["vec_id"] for r in out if r["query_id"] == 0] == [j for _, j in best]
    few = ann.search(v.where("vec_id < 3"), v.where("vec_id = 0"), k=20)
    assert {r["vec_id"] for r in few.collect()} == {1, 2}
    assert ann.search(v.limit(0), v, k=3).isEmpty()


def test_urls(spark):
    urls = ["http://a.bad.com/x", "http://BAD.com", "//bad.com:80/y", "http://u@bad.com./z", "notaurl", None, "http://good.com/bad.com", "http://other.org/p/q", "http://other.org/r"]
    d = spark.createDataFrame([(i, u, "2024-02-01", "host") for i, u in enumerate(urls)] + [(9, "http://bad.com/", None, "h"), (10, "http://bad.com/", "2024-01-01", "h"), (11, "http://bad.com/", "2024-03-01", "h")], "page_id long, url string, at string, host string")
    d = d.select("page_id", "url", F.to_date("at").alias("fetched_at"), "host")
    e = spark.createDataFrame(
        [("bad.com", None, "spam", "add", "2024-01-15"), ("bad.com", None, "spam", "add", "2024-01-20"), ("bad.com", None, "spam", "remove", "2024-03-01"), ("other.org", "/p/", None, "add", "2024-01-01"),
         (None, None, None, "add", "2024-01-01"), ("good.com", None, "x", "add", None), ("good.com", None, "y", "add", "2024-01-05"), ("good.com", None, "y", "remove", "2024-01-05")],
        "domain string, prefix string, category string, action string, day string",
    ).select("domain", "prefix", "category", "action", F.to_date("day").alias("at"))
    out = {r["page_id"]: r for r in urlfilter.filter_urls(d, e, "page_id").collect()}
    assert [out[i]["blocked"] for i in range(12)] == [True, True, True, True, False, False, False, True, False, False, False, False]
    assert out[7]["rule"] == "other.org/p/" and out[0]["url_host"] == "a.bad.com" and out[0]["host"] == "host"
    assert urlfilter.filter_urls(d.limit(0), e, "page_id").isEmpty()
    assert urlfilter.filter_urls(d, e.limit(0), "page_id").where("blocked").isEmpty()


def test_bounded_filter_keeps_all_that_is_wanted(spark):
    rng = random.Random(3)
    hashes = [rng.getrandbits(64) - (1 << 63) for _ in range(400)]
    probe = spark.createDataFrame([(i, h) for i, h in enumerate(hashes)], "id long, h long")
    wanted = spark.createDataFrame([(h,) for h in hashes[:100]], "h long")
    kept = {r["id"] for r in decontam.maybe(probe, wanted, buckets=64).collect()}
    assert kept >= set(range(100)) and len(kept) < 200
    assert decontam.maybe(probe, wanted.limit(0)).isEmpty()


def test_decontamination_without_broadcast(docs, items, monkeypatch):
    monkeypatch.setattr(decontam, "fits", lambda df: False)
    out = {(r["id"], r["item_id"]): r["containment"] for r in decontam.contained(docs, items).collect()}
    assert out == {(1, 1): 1.0, (2, 1): 1.0}


def test_hot_keys_join_like_others(spark):
    left = spark.createDataFrame([(1, i) for i in range(50)] + [(i, 0) for i in range(2, 20)] + [(None, 9)], "u long, x int")
    right = spark.createDataFrame([(1, 5, 0.7), (2, 6, 0.0001), (3, 7, 0.5), (99, 8, 0.9)], "u long, m int, share double")
    out = common.join_hot(left, right, "u", "share")
    assert sorted(tuple(r) for r in out.collect()) == sorted((u, x, {1: 5, 2: 6, 3: 7}[u]) for u, x in [(1, i) for i in range(50)] + [(2, 0), (3, 0)])


def test_components_with_hot_nodes(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    edges = [(0, i) for i in range(1, 40)] + [(50 + i, 51 + i) for i in range(9)] + [(39, 50)]
    comp = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(comp.values()) == {0} and len(comp) == 50


def test_broadcast_is_bounded_in_rows_and_bytes(spark):
    d = spark.createDataFrame([(i, "x" * 1000, [1.0] * 10, ["ab"] * 5) for i in range(50)], "id long, s string, v array<double>, t array<string>")
    assert common.fits(d, 50, 1 << 20) and not common.fits(d, 49, 1 << 20) and not common.fits(d, 50, 40_000)
    assert common.fits(d.limit(0))


def test_shared_folder_must_be_named_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError):
        common.shared_dir(Session())


def test_swept_deletes_what_was_made_within(spark):
    import os

    with common.swept(spark):
        path = common.scratch(spark, "x")
        spark.range(3).write.parquet(path)
        assert common.complete(spark, path)
        folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
        before = set(os.listdir(folder))
        common.cut(spark.range(3))
        made = set(os.listdir(folder)) - before
        assert made
    assert not common.complete(spark, path) and not made & set(os.listdir(folder))


def test_url_filters_like_brute_force(spark):
    """Many rules of a host, many changes of a rule, times at every border."""
    import datetime

    rng, day = random.Random(4), lambda n: datetime.datetime(2023, 12, 1) + datetime.timedelta(hours=n)
    names, folders = ["x.org", "a.x.org", "b.a.x.org", "y.net"], [None, "/", "/p", "/p/", "/p/q", "/w/"]
    listed = [(rng.choice(names), rng.choice(folders), rng.choice(["s", "t"]), rng.choice(["add", "remove"]), day(rng.randint(0, 3000))) for _ in range(160)]
    pages = [(i, f"http://{rng.choice(names + ['c.y.net', 'z.com'])}{rng.choice(['', '/', '/p', '/p/q/r', '/w/1', '/v'])}", day(rng.choice([rng.randint(0, 3100), e[4] and rng.randint(0, 3000)]))) for i, e in enumerate(rng.choices(listed, k=300))]
    pages += [(300 + i, f"http://{d}{f or '/'}", t) for i, (d, f, _, _, t) in enumerate(listed)]

    def on(rule, t):
        state = {}
        for d, f, c, a, at in listed:
            if (d, f or "/", c) == rule and at <= t:
                state.setdefault(at, []).append(a)
        return bool(state) and "remove" not in state[max(state)]

    def judge(url, t):
        h, p = url.removeprefix("http://").partition("/")[0], "/" + url.removeprefix("http://").partition("/")[2]
        rules = {(d, f or "/", c) for d, f, c, _, _ in listed if (h == d or h.endswith("." + d)) and p.startswith(f or "/")}
        active = sorted((r for r in rules if on(r, t)), key=lambda r: (-len(r[0]), -len(r[1]), r[2], r[0]))
        return (active[0][0] + active[0][1], active[0][2]) if active else (None, None)

    d = spark.createDataFrame(pages, "page_id long, url string, fetched_at timestamp")
    e = spark.createDataFrame(listed, "domain string, prefix string, category string, action string, at timestamp")
    out = {r["page_id"]: (r["rule"], r["category"]) for r in urlfilter.filter_urls(d, e, "page_id").collect()}
    want = {i: judge(u, t) for i, u, t in pages}
    assert out == want and sum(r is not None for r, _ in want.values()) > 100


def test_blocks_of_time_leave_no_rest(spark):
    import datetime

    rng, start = random.Random(5), datetime.datetime(1969, 12, 1)
    some = lambda: start + datetime.timedelta(seconds=rng.choice([60, 10**5, 10**9]) * rng.random())
    rows = [(i, *sorted([some(), some()]), some()) for i in range(200)]
    d = spark.createDataFrame(rows, "i long, a timestamp, b timestamp, t timestamp")
    d = d.select("i", "a", "b", "t", urlfilter.covering(F.col("a"), F.col("b")).alias("c"), urlfilter.covering(F.col("a"), F.lit(None).cast("timestamp")).alias("o"), urlfilter.blocks_of(F.col("t")).alias("x"))
    for r in d.collect():
        held, open_, of = set(map(tuple, r["c"])), set(map(tuple, r["o"])), set(map(tuple, r["x"]))
        assert len(held) == len(r["c"]) < 300
        if r["a"] <= r["t"] < r["b"]:
            assert len(held & of) == 1
        assert len(held & of) <= 1 and (len(open_ & of) == 1) >= (r["t"] >= r["a"])
