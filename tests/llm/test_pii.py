"""Pseudonyms of a table against a plain version, and where the key comes from."""

import hashlib
import random
import re

from voxmill.llm import pii


def plain_feistel(x, size, key, tweak):
    """The network by its definition, recursively."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)

    def rounds(left, right, r):
        if r == 10:
            return left << half | right
        data = bytes([r]) + tweak + b"|" + right.to_bytes((half + 7) // 8, "big")
        f = int.from_bytes(hashlib.blake2b(data, key=key, digest_size=min(64, max(8, (half + 7) // 8))).digest(), "big")
        return rounds(right, left ^ (f & ((1 << half) - 1)), r + 1)

    y = rounds(x >> half, x & ((1 << half) - 1), 0)
    return y if y < size else plain_feistel(y, size, key, tweak)


def plain_card(digits, key):
    body = digits[:-1]
    y = plain_feistel(int(body), 10 ** len(body), key, b"card/0/" + b"0" * len(body))
    made = f"{y:0{len(body)}}"
    for check in "0123456789":
        total = sum(sum(divmod(int(c) * (2 - i % 2), 10)) for i, c in enumerate(reversed(made + check), 1))
        if total % 10 == 0:
            return made + check


def with_check(body):
    return next(body + c for c in "0123456789" if sum(sum(divmod(int(x) * (2 - i % 2), 10)) for i, x in enumerate(reversed(body + c), 1)) % 10 == 0)


def test_table_like_the_plain_version(spark):
    rng, key = random.Random(9), b"another key"
    docs = []
    for i in range(60):
        words = rng.choices(["alpha", "beta", "gamma", "2024", "7"], k=20)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(20)] = with_check("".join(rng.choices("0123456789", k=15)))
        docs.append((i, ", ".join(words)))
    out = {r["doc_id"]: r for r in pii.pseudonyms(spark.createDataFrame(docs, "doc_id long, text string"), key).collect()}
    n = 0
    for i, text in docs:
        want = re.sub(r"\d{16}", lambda m: plain_card(m[0], key), text)
        assert out[i]["text"] == want
        n += len(out[i]["pii_kinds"])
        spans = list(zip(out[i]["pii_kinds"], out[i]["pii_starts"], out[i]["pii_ends"]))
        assert pii.restore(out[i]["text"], spans, key) == text
    assert n > 40


def test_key_of_the_session(spark):
    drawn = pii.session_key(spark)
    assert len(drawn) == 32 and pii.session_key(spark) == drawn
    spark.conf.set(pii.KEY_SETTING, "a secret")
    try:
        assert pii.session_key(spark) != drawn and pii.session_key(spark) == pii.session_key(spark)
    finally:
        spark.conf.unset(pii.KEY_SETTING)
    assert pii.session_key(spark) == drawn


def test_every_value_of_the_corpus_can_be_undone(spark, sf):
    before = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    key, n = pii.session_key(spark), 0
    for r in pii.op8_pii(spark, sf).collect():
        assert pii.restore(r["text"], list(zip(r["pii_kinds"], r["pii_starts"], r["pii_ends"])), key) == before[r["doc_id"]]
        n += r["n_replaced"]
    assert n > 5


def test_country_codes():
    good = ["", "+1", "+7", "+44", "+49", "+91", "+351", "+358", "+380", "+420", "+852", "+971", "+998"]
    assert all(map(pii.country_code, good)) and not any(map(pii.country_code, ["+999", "+21", "+4", "+11", "+210", "+447", "+80"]))
