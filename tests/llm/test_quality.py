"""Quality scores against a plain computation, and what bounds the fit."""

import random
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from voxmill.llm import quality


def made(n, seed=2):
    rng = random.Random(seed)
    good, bad = [f"{a}{b}ing" for a in "abcdefgh" for b in "lmnopqrs"], [f"{a}!!{b}" for a in "ABCDEFGH" for b in "XYZUVW"]
    return [(i, " ".join(rng.choices(good if i % 3 else bad, k=rng.randint(30, 400))), int(bool(i % 3))) for i in range(n)]


def test_scores_like_plain_compression(spark):
    docs = made(300)
    d = spark.createDataFrame(docs, "doc_id long, text string, quality int")
    s = quality.learn(d, d)
    out = {r["doc_id"]: r for r in quality.score(d, s).collect()}

    def size(data, dictionary):
        p = zstandard.ZstdCompressionParameters.from_level(3, source_size=4096, dict_size=len(dictionary), write_checksum=0, write_content_size=0, write_dict_id=0)
        z = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        if z:
            z.precompute_compress(compression_params=p)
        return sum(len(zstandard.ZstdCompressor(dict_data=z, compression_params=p).compress(data[a : a + 4096])) for a in range(0, len(data), 4096))

    for i, text, y in docs:
        data = text.encode()
        plain, good, bad = size(data, b""), size(data, s.good), size(data, s.bad)
        d1, n = (bad - good) / plain, len(data)
        x = np.clip([1.0, d1, (bad - good) / n * 10, min(plain / n, 1.5), np.log(plain / n + 0.02)], -5, 5)
        x = np.concatenate([x, [x[a] * x[b] for a in range(1, 5) for b in range(a, 5)]])
        assert out[i]["quality_difference"] == pytest.approx(d1, abs=1e-12)
        assert out[i]["quality_score"] == pytest.approx(1 / (1 + np.exp(-np.clip(x @ s.weights, -30, 30))), abs=1e-9)
        assert (out[i]["quality_score"] >= 0.5) == bool(y)


def test_query_learns_from_the_rest_alone(spark, tmp_path):
    docs = made(400)
    spark.createDataFrame([(i, t) for i, t, _ in docs], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    wrong = [(i, y if not held(i) else 1 - y) for i, _, y in docs]
    spark.createDataFrame(wrong, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    out = {r["doc_id"]: r for r in quality.op7_quality(spark, str(tmp_path)).collect()}
    assert all(out[i]["held_out"] == held(i) and out[i]["predicted"] == y == (out[i]["score"] >= 0.3) for i, _, y in docs)


def test_bytes_and_repeats_are_bounded(spark):
    docs = made(200)
    d = spark.createDataFrame(docs + [(i, t, y) for i, t, y in docs[:50] for _ in range(5)], "doc_id long, text string, quality int")
    seen = []
    real = quality.train
    quality.train = lambda texts, labels, **k: seen.append((texts, labels)) or real(texts, labels, **k)
    try:
        quality.learn(d, d)
        few = quality.learn(d, d, size=60_000)
    finally:
        quality.train = real
    assert len(seen[0][0]) == 200 and sum(len(t.encode()) for t in seen[1][0]) <= 60_000 and 0 < len(seen[1][0]) < 200
    assert set(seen[1][1]) == {0, 1} and few.weights is not None


def test_no_piece_is_left_out():
    texts = ["a" * 5000, None, "", "short", "b" * 4100, "x"]
    pieces = quality.pieces_of(texts)
    assert sum(p.count(b"a") for p in pieces) == 5000 and sum(p.count(b"b") for p in pieces) == 4100
    assert all(len(p) >= 8 for p in pieces) and b"short" in pieces[1] and pieces[-1].endswith(b"x")


def test_columns_of_the_same_name(spark):
    d = spark.createDataFrame([(1, "some text here", "mine", "x")], "doc_id long, text string, quality_score string, score string")
    out = quality.score(d, quality.Scorer(b"", b"", None, 0.5)).first()
    assert out["quality_score"] == 0.5 and out["score"] == "x" and out["quality_difference"] == 0


def test_difference_alone_separates(spark):
    sf = "/root/testdata/sf0.1"
    out = quality.op7_quality(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet").where(F.col("quality").isNotNull()), "doc_id").toPandas()

    def area(c):
        rank, y = out[c].rank(), out["quality"] == 1
        return (rank[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())

    print("area under the curve: score", area("score"), "difference", area("difference"))
    assert area("score") > 0.97 and area("difference") > 0.9
