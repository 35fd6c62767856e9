"""Operators that SQL can't express, against plain versions."""

import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from voxmill.llm import crossparse, decontam, htmltext, langid, pii, quality, simhash
from voxmill.llm.common import components
from voxmill.llm.queries import ORACLE_SQL, QUERIES


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", [None, "", " \n", "One", "One TWO", "É É é x y", "a b c d e f g " * 9, "x\x0by\x0cz w"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_spark_has_the_same_hash(spark):
    assert spark.sql("SELECT xxhash64('ab c')").first()[0] % 2**64 == xxhash.xxh64_intdigest(b"ab c", 42)


def test_covering_masks_miss_no_pair():
    masks = simhash.covering_masks(3)
    assert len(masks) == 15
    rng = random.Random(2)
    for _ in range(20000):
        x = 0
        for b in rng.sample(range(64), 3):
            x |= 1 << b
        assert any(not x & m for m in masks)


def clusters(fps, radius=3):
    out, todo = {}, set(fps)
    while todo:
        seen, front = set(), [min(todo)]
        while front:
            a = front.pop()
            if a not in seen:
                seen.add(a)
                front += [b for b in todo if bin(a ^ b).count("1") <= radius]
        todo -= seen
        for x in seen:
            out[x] = min(seen)
    return out


@pytest.mark.parametrize("block", [4096, 8])
def test_links_connect_like_brute_force(spark, block):
    rng = random.Random(5)
    fps = set()
    for _ in range(12):  # chains and balls of near fingerprints, some in hot buckets
        x = rng.getrandbits(64)
        for _ in range(20):
            fps.add(x)
            y = x
            for b in rng.sample(range(64), rng.randint(1, 5)):
                y ^= 1 << b
            x = y if rng.random() < 0.7 else x
    fps |= {rng.getrandbits(64) for _ in range(50)}
    fps = sorted(fps)
    by_id = {i: f for i, f in enumerate(fps)}
    want = clusters(fps)
    nodes = spark.createDataFrame([(i, simhash._signed(f)) for i, f in by_id.items()], "node long, fp long")
    links = simhash.near_links(nodes, 3, block)
    assert all(bin(by_id[a] ^ by_id[b]).count("1") <= 3 for a, b in links.collect())
    comp = {r["node"]: r["root"] for r in components(links).collect()}
    for i, f in by_id.items():
        assert comp.get(i, i) == min(j for j, g in by_id.items() if want[g] == want[f])


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 130)] + [(7, 7), (None, 3), (200, 201)]
    comp = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(comp[i] == 0 for i in range(61)) and all(comp[i] == 100 for i in range(100, 130)) and comp[201] == 200


def test_decontamination_finds_what_brute_force_finds(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 40)))) for i in range(30)]
    docs = []
    for d in range(80):
        words = rng.choices(vocabulary, k=rng.randint(0, 80))
        if d % 2:
            part = items[rng.randrange(30)][1].split()
            k = rng.randint(0, len(part) // 3)
            words[5:5] = [w.upper() + "," for w in part[: len(part) - k]]
        docs.append((d, " ".join(words)))

    def shingles(text):
        w = re.findall(r"\w+", text.lower())
        return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    want = {(d, i) for d, t in docs for i, u in items if shingles(u) and len(shingles(t) & shingles(u)) >= 0.8 * len(shingles(u)) - 1e-9}
    got = decontam.contained(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["id"], r["item_id"]) for r in got.collect()} == want and len(want) > 10


def test_automaton_parses_like_search():
    rng = random.Random(1)
    for _ in range(150):
        ref = ["".join(rng.choices("abc", k=rng.randint(0, 12))) for _ in range(rng.randint(0, 4))]
        text, n, i = "".join(rng.choices("abcd", k=rng.randint(0, 20))), 0, 0
        while i < len(text):
            j = i + 1
            while j <= len(text) and any(text[i:j] in p for p in ref):
                j += 1
            i, n = max(i + 1, j - 1), n + 1
        assert n == crossparse.cross_phrases(text, crossparse.automaton(ref))


def test_own_phrases():
    assert crossparse.own_phrases("aaaaaa") == 3 and crossparse.own_phrases("abab") == 3 and crossparse.own_phrases("") == 0


def test_crossparse_of_a_table(spark):
    rng = random.Random(4)
    docs = [(i, "".join(rng.choices("abcd ", k=rng.randint(0, 300)))) for i in range(60)]
    out = {r["id"]: r for r in crossparse.entropies(spark.createDataFrame(docs, "doc_id long, text string"), passage=50, rate=2, shard=1000).collect()}
    shards = {r["shard"] for r in out.values()}
    assert len(out) == 60 and len(shards) > 1
    for i, t in docs:
        r = out[i]
        assert r["n_chars"] == len(t) and r["own_phrases"] == crossparse.own_phrases(t)
        if t:
            assert 0 < r["phrases"] <= len(t)
            assert math.isclose(r["relative_entropy"], r["cross_entropy"] - r["own_phrases"] * math.log2(r["own_phrases"]) / len(t))


def test_crossparse_meets_all_other_text(spark):
    rng = random.Random(6)
    docs = [(i, "".join(rng.choices("abcdé ", k=rng.randint(0, 90)))) for i in range(40)]
    docs += [(100, docs[3][1]), (101, "only here: xyz"), (102, docs[5][1] + docs[7][1]), (7, docs[9][1]), (103, "q" * 50), (103, "q" * 50)]
    out = {(r["id"], r["n_chars"], r["own_phrases"]): r for r in crossparse.entropies(spark.createDataFrame(docs, "doc_id long, text string"), passage=40, shard=200).collect()}
    size = sum(len(t) for i, t in set(docs))
    for d, text in docs:
        other, n, i = [t for e, t in docs if e != d], 0, 0
        while i < len(text):
            j = i + 1
            while j <= len(text) and any(text[i:j] in t for t in other):
                j += 1
            i, n = max(i + 1, j - 1), n + 1
        r = out[d, len(text), crossparse.own_phrases(text)]
        assert r["phrases"] == n and (not text or math.isclose(r["cross_entropy"], n * math.log2(size) / len(text)))
    assert len({r["shard"] for r in out.values()}) > 3


def test_crossparse_keeps_long_phrases_whole(spark):
    rng = random.Random(8)
    text = "".join(rng.choices("abcdefé ", k=1500))
    docs = [(1, text), (2, text), (3, text[:700] + "#" + text[701:])]
    out = {r["id"]: r["phrases"] for r in crossparse.entropies(spark.createDataFrame(docs, "doc_id long, text string"), passage=40, shard=200).collect()}
    assert out == {1: 1, 2: 1, 3: 3}


def test_crossparse_in_parts(spark):
    rng = random.Random(9)
    docs = [(i, "".join(rng.choices("abcdé ", k=rng.randint(0, 120)))) for i in range(25)]
    docs += [(30, docs[3][1]), (31, "zz" + docs[4][1] + docs[5][1]), (None, docs[6][1][:50] + "ü" + docs[6][1]), (7, docs[9][1]), (32, ""), (33, None)]
    got = crossparse.entropies(spark.createDataFrame(docs, "doc_id long, text string"), texts=500, keys=100, rounds=3).collect()

    def phrases(d, text):
        other, n, i = [t or "" for e, t in docs if e != d], 0, 0
        while i < len(text):
            j = i + 1
            while j <= len(text) and any(text[i:j] in t for t in other):
                j += 1
            i, n = max(i + 1, j - 1), n + 1
        return n

    want = sorted((str(d), len(t or ""), phrases(d, t or "")) for d, t in docs)
    assert sorted((str(r["id"]), r["n_chars"], r["phrases"]) for r in got) == want


def test_crossparse_settles_patchwork_in_few_turns(spark, monkeypatch):
    rng = random.Random(10)
    base = ["".join(rng.choices("abcdefgh ", k=900)) for _ in range(8)]
    docs = list(enumerate(base))
    for i in range(8, 16):  # passages whose starts overlap, so that one longest match leads to the next
        text = ""
        for _ in range(25):
            b, a = rng.choice(base), rng.randrange(800)
            text += b[a : a + rng.randint(40, 100)]
        docs += [(i, text), (i + 100, text[:700] + "#" + text[700:])]
    docs += [(300 + i, base[i % 2]) for i in range(20)]
    names = []
    scratch = crossparse.scratch
    monkeypatch.setattr(crossparse, "scratch", lambda s, name: names.append(name) or scratch(s, name))
    got = {r["id"]: r["phrases"] for r in crossparse.entropies(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for d, text in docs:
        other, n, i = [t for e, t in docs if e != d], 0, 0
        while i < len(text):
            j = i + 1
            while j <= len(text) and any(text[i:j] in t for t in other):
                j += 1
            i, n = max(i + 1, j - 1), n + 1
        assert got[d] == n
    assert names.count("asked") <= 3


def test_crossparse_turns_leave_what_is_settled(spark, monkeypatch):
    rng = random.Random(11)
    base = "".join(rng.choices("abcdefgh ", k=900))
    text = "x" + base[100:400] + "y" + base[500:800]
    paths = []
    scratch = crossparse.scratch
    monkeypatch.setattr(crossparse, "scratch", lambda s, name: paths.append((name, scratch(s, name))) or paths[-1][1])
    docs = spark.createDataFrame([(1, base), (2, base), (3, text)], "doc_id long, text string")
    got = {r["id"]: r["phrases"] for r in crossparse.entropies(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 4}
    # base is one phrase at once: its places are compared with, but no longer looked for
    pos = [r["pos"] for name, path in paths if name == "pins" for r in spark.read.parquet(path).collect()]
    assert pos and max(pos) - min(pos) < len(text)
    # keys are made once; what they are made of isn't kept, or read in the turns
    texts = spark.read.parquet(next(path for name, path in paths if name == "texts"))
    assert texts.where("bits is not null").isEmpty() and not texts.isEmpty()


def test_crossparse_bounds():
    rng = random.Random(12)
    for _ in range(100):
        n = rng.randint(1, 12)
        end = np.sort(np.array([rng.randint(0, 20) for _ in range(n)]))
        unknown = np.array([i for i in range(n) if rng.random() < 0.5], np.int64)
        stop = np.array([rng.randint(0, 25) for _ in unknown], np.int64)
        known = [i for i in range(n) if i not in unknown]
        want = [(max([end[k] for k in known if k < i], default=0), min([end[k] for k in known if k > i] + [z])) for i, z in zip(unknown, stop)]
        assert list(zip(*crossparse.bounds(unknown, end, stop))) == want


def test_language_accuracy_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    out = langid.op1_langid(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    held = out[out["held_out"]]
    assert (held["held_out"] == held["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    assert len(held) > 150 and (held["lang"] == held["lang_pred"]).mean() > 0.97


def test_language_filters_return_all_languages():
    grams = {f"l{i}": np.arange(i, 1000 + i, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) for i in range(20)}
    m = langid.LanguageFilters(grams, (3,), 16, 3)
    rows = list(m._rows(grams["l5"][10:11]))
    mask = m.tables[0][rows[0]] & m.tables[0][rows[1]] & m.tables[0][rows[2]]
    has = {m.langs[i] for i in range(20) if int(mask[0]) >> i & 1}
    assert has >= {f"l{i}" for i in range(16)} and len(has) < 20 and m.width == 32
    many = langid.LanguageFilters({f"l{i:03}": g for i, g in enumerate([np.arange(9, dtype=np.uint64)] * 70)}, (3,), 12, 2)
    assert len(many.tables) == 2 and len(many.shares("abc def", langid.letter_table())) == 70


def test_quality_accuracy_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    held = labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    s = quality.learn(docs, labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
    out = quality.score(docs.join(held, "doc_id"), s).select("quality", "quality_score").toPandas()
    right = (out["quality_score"] >= 0.3) == (out["quality"] == 1)
    assert right.mean() > 0.96 and right[out["quality"] == 0].mean() > 0.8


def test_feistel_is_a_permutation():
    for size in (1, 2, 10, 97, 1000):
        got = [pii.feistel(i, size, b"k", b"t") for i in range(size)]
        assert sorted(got) == list(range(size)) and [pii.feistel(y, size, b"k", b"t", True) for y in got] == list(range(size))


KEY = b"of these tests"
PERSONAL = (
    "card 4111 1111 1111 1111, ip 10.0.0.255 mail Jo.Doe+x@mail.example.com tel +1 (555) 555-0199 or (212) 555-0123 born 1990-02-28, 31/12/1999, 01.02.2003 "
    'ssn 123-45-6789 iban GB82 WEST 1234 5698 7654 32 token = "0123456789abcdef0123456789abcdef01234567"'
)


def test_pseudonyms_keep_formats_and_can_be_undone():
    new, spans = pii.pseudonymise(PERSONAL, KEY)
    kinds = [k for k, _, _ in spans]
    assert kinds == ["card", "ip", "email", "phone", "phone", "date", "date", "date", "ssn", "iban", "secret"]
    made = {k: new[a:b] for k, a, b in spans}
    assert pii.luhn(made["card"].replace(" ", "")) and made["card"][4] == " " and made["email"].endswith("@mail.example.com")
    assert re.fullmatch(r"\d\d\.\d\d\.\d{4}", made["date"]) and re.fullmatch(r"\(\d{3}\) \d{3}-\d{4}", made["phone"])
    assert re.fullmatch(r'[0-9a-f]{40}', made["secret"])
    assert pii.pseudonymise(new, KEY, inverse=True)[0] == PERSONAL
    assert pii.pseudonymise(PERSONAL, b"another")[0] != new


@pytest.mark.parametrize("text", ["1234 5678 9012 3456", "4111111111111112", "256.1.1.1", "1.2.3", "2024-13-01", "000-12-3456", "version 1.2.3.4.5", "ratio 12/34", "+999 20 1234 5678", "+1 23 45", "GB00 WEST 1234 5698 7654 32", "a@b"])
def test_what_is_not_valid_stays(text):
    assert pii.pseudonymise(text, KEY) == (text, [])


@pytest.mark.parametrize("text,kind,value", [
    ("12 4111111111111111", "card", "4111111111111111"),
    ("12 35 4111 1111 1111 1111", "card", "4111 1111 1111 1111"),
    ("4111 1111 1111 1111 123", "card", "4111 1111 1111 1111"),
    ("4111-1111-1111-1111-123-45", "card", "4111-1111-1111-1111"),
    ("BE68539007547034 EUR", "iban", "BE68539007547034"),
    ("BE68 5390 0754 7034 OK", "iban", "BE68 5390 0754 7034"),
    ("AB12 CDEF BE68 5390 0754 7034", "iban", "BE68 5390 0754 7034"),
    ("212-555-0199 12345", "phone", "212-555-0199"),
])
def test_valid_values_beside_others_are_found(text, kind, value):
    new, spans = pii.pseudonymise(f"see {text}, thanks", KEY)
    at = 4 + text.index(value)
    assert spans == [(kind, at, at + len(value))] and new[at : at + len(value)] != value
    assert new[:at] + value + new[at + len(value) :] == f"see {text}, thanks" == pii.restore(new, spans, KEY)


def test_equal_values_stay_linked():
    a, b = pii.pseudonymise("x 4111111111111111 y", KEY)[0], pii.pseudonymise("other 4111111111111111!", KEY)[0]
    assert a.split()[1] == b.split()[1].rstrip("!") != "4111111111111111"


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><div id="main-menu"><a href=/>Home</a> <a href=/b>News</a></div>
<div class="cookieNotice">We use cookies on this site.</div><div class="wrap"><div><h2>The   title</h2><p>First &lt;long&gt; paragraph of the article
with a <a href=x>link</a>, and <b>bold</b> words in it.</p><p>Second paragraph, rather long too, so that its density counts.<ul><li>one<li>two</ul></div></div>
<div><a href=1>More one</a><a href=2>More two</a></div><div class=comments><p>A reader's comment which is long enough to look like text of an article.</p></div>
<form><input value=x>Subscribe</form><script>if (a < b) { "</p>" }</script><footer>&copy; me</footer></body></html>"""


def test_html_page():
    assert htmltext.main_text(PAGE) == (
        "The title\nFirst <long> paragraph of the article with a link, and bold words in it.\nSecond paragraph, rather long too, so that its density counts.\none\ntwo"
    )


def test_html_article_in_sections():
    text = "A paragraph of the article that is long enough to be taken for text."
    parts = "".join(f"<section><h2>{h}</h2>{f'<p>{text}</p>' * n}</section>" for h, n in (("A", 3), ("B", 1)))
    page = f"<body><div class=wrap>{parts}<section><a href=1>One more to read</a></section></div></body>"
    assert htmltext.main_text(page) == "\n".join(["A", text, text, text, "B", text])


@pytest.mark.parametrize("page", ["<", "<p", "</", "<!--", "a<b", "&#x110000;&#0;", "<p>" * 3000 + "x", "<div>" * 5000 + "deep", "<table><tr><td>a<td>b", "</p></div>x", "<script>", "<![CDATA[x"])
def test_html_that_is_broken(page):
    assert isinstance(htmltext.main_text(page), str)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "events"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = QUERIES[name](spark, sf)
    r = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == sorted(df.columns)
    text = lambda rows: sorted(tuple(str(round(v, 6) + 0.0 if isinstance(v, float) else v) for v in x) for x in rows)
    assert text(df.select(*names).collect()) == text(r.fetchall())
