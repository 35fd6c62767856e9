"""Language filters against sets of n-grams."""

import zlib
from collections import Counter

import numpy as np

from voxmill.llm import langid


def grams(text, orders=(3, 5)):
    """n-grams of the lower-cased text, runs of other than letters one space."""
    out, s = [], ""
    for c in " " + text.lower() + " ":
        if c.isalpha():
            s += c
        elif not s.endswith(" "):
            s += " "
    for n in orders:
        out += [s[i : i + n] for i in range(len(s) - n + 1)]
    return out


def plain(docs, rate=0.1):
    """Exact sets in place of filters: language, corrected share."""
    held = {}
    for _, text, lang in docs:
        if lang is not None:
            held.setdefault(lang, []).append(set(grams(text or "")))
    r = {lang: {g: n / len(sets) for g, n in Counter(g for s in sets for g in s).items()} for lang, sets in held.items()}
    top = Counter()
    for rates in r.values():
        for g, x in rates.items():
            top[g] = max(top[g], x)
    keep = {lang: {g for g, x in rates.items() if x >= rate * top[g]} for lang, rates in r.items()}

    def judge(text):
        if not text or not any(c.isalpha() for c in text):
            return "und", 0.0
        all_ = grams(text)
        shares = {lang: sum(g in s for g in all_) / len(all_) for lang, s in sorted(keep.items())}
        best = max(shares, key=shares.get)
        return best, shares[best]

    return judge


def test_query_like_sets_of_n_grams(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    judge = plain([d for d in docs if zlib.crc32(str(d[0]).encode()) % 4 != 2])
    out = {r["doc_id"]: r for r in langid.op1_langid(spark, sf).collect()}
    assert len(out) == len(docs)
    for i, text, _ in docs:
        lang, share = judge(text)
        assert out[i]["lang_pred"] == lang and abs(out[i]["share"] - share) < 0.02
        assert out[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)


def test_rare_and_single_n_grams_count(spark):
    docs = [(i, "aaaa bbbb", "xx") for i in range(30)] + [(30, "qwrt", "xx"), (31, "zzzz yyyy", "yy")] + [(40 + i, "cccc dddd", "zz") for i in range(30)]
    model = langid.learn(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    letters = langid.letter_table()
    assert model.predict("qwrt", letters)[0] == "xx" and model.predict("zzzz", letters)[0] == "yy"
    assert model.predict("qwrt", letters)[2] > 0.9


def test_passages_in_another_language_stay_out(spark):
    docs = [(i, "alpha beta gamma " * 3, "xx") for i in range(40)] + [(100 + i, "uno dos tres cuatro", "yy") for i in range(40)] + [(500, "uno dos tres cuatro", "xx")]
    model = langid.learn(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    assert model.predict("uno dos", langid.letter_table())[:2] == ("yy", 1.0)


def test_what_false_positives_explain_is_not_known():
    rng = np.random.default_rng(1)
    letters = langid.letter_table()
    m = langid.LanguageFilters({"a": rng.integers(0, 1 << 62, 3000).astype(np.uint64), "b": rng.integers(0, 1 << 62, 3000).astype(np.uint64)}, (3, 5), 14, 2)
    text = " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for _ in range(300))
    assert not m.predict(text, letters)[3]
    assert not m.predict("123 !", letters)[3] and not m.predict(None, letters)[3]
