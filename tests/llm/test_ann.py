"""Nearest neighbours against brute force."""

import numpy as np
import pytest

from voxmill.llm import ann


def brute(rows, queries, k):
    """Per query row: (score, id) of its k nearest, one row equal to it left out."""
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    out = []
    for qid, q in queries:
        q = np.array(q, float)
        left = np.ones(len(ids), bool)
        own = np.flatnonzero((ids == qid) & (x == q).all(axis=1))
        left[own[:1]] = False
        score = (x * q).sum(axis=1)[left]
        by = np.lexsort((ids[left], -score))[:k]
        out.append((qid, [(int(ids[left][i]), float(score[i])) for i in by]))
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, [float(a) for a in v]) for i, v in rows], "vec_id long, embedding array<double>")


def found(df):
    """Sorted lists of (id, score) per query id; repeated query rows have several."""
    got = {}
    for r in df.collect():
        got.setdefault(r["query_id"], {}).setdefault(r["rank"], []).append((r["vec_id"], r["score"]))
    return got


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_recall_at_default_settings(spark, sf):
    v = spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet")
    p = v.orderBy("vec_id").toPandas()
    x, ids = np.stack(p["embedding"]).astype(float), p["vec_id"].to_numpy()
    out = ann.op3_ann(spark, f"/root/testdata/sf{sf}").toPandas()
    hit = total = 0
    for q, g in out.groupby("query_id"):
        score = x @ x[ids == q][0]
        score[ids == q] = -np.inf
        true = ids[np.lexsort((ids, -score))[:20]]
        hit, total = hit + len(set(true) & set(g["vec_id"])), total + 20
        g = g.sort_values("rank")
        assert list(g["rank"]) == list(range(1, 21)) and (np.diff(g["score"]) <= 0).all() and q not in set(g["vec_id"])
        np.testing.assert_allclose(g["score"], [(x[ids == i][0] * x[ids == q][0]).sum() for i in g["vec_id"]], rtol=1e-12)
    assert total == 20 * (ids % 20 == 0).sum() and hit / total >= 0.9


@pytest.mark.parametrize("shard,block", [(None, None), (40, 7)])
def test_recall_over_shards(spark, shard, block):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((30, 24)) * 3
    rows = [(i, centres[i % 30] + rng.standard_normal(24)) for i in range(1500)]
    queries = rows[::20]
    v = table(spark, rows)
    got = found(ann.search(v, table(spark, queries), k=10, shard_vectors=shard, block_queries=block))
    want = brute(rows, queries, 10)
    hit = sum(len({i for i, _ in near} & {x[0] for at in got[q].values() for x in at}) for q, near in want)
    assert hit >= 0.9 * 10 * len(queries)
    assert all(sorted(got[q]) == list(range(1, 11)) for q, _ in want)


@pytest.mark.parametrize("shard,block", [(None, None), (25, 3)])
def test_all_lists_probed_is_nearly_exact_and_repeated_rows_are_rows(spark, shard, block):
    rng = np.random.default_rng(5)
    rows = [(i, rng.integers(-2, 3, 6) + 0.5) for i in range(200)]
    rows += [rows[0], rows[0], rows[40], (0, rows[3][1]), (7, rows[60][1])]
    queries = [r for r in rows if r[0] % 20 == 0]
    out = found(ann.search(table(spark, rows), table(spark, queries), k=12, probe=1.0, shard_vectors=shard, block_queries=block))
    want, hit, total = {}, 0, 0
    for q, near in brute(rows, queries, 12):
        want.setdefault(q, []).append(near)
    for q, several in want.items():
        for rank in range(12):
            expected, got = sorted(n[rank] for n in several), sorted(out[q][rank + 1])
            assert len(expected) == len(got)
            hit, total = hit + sum(a[0] == b[0] and abs(a[1] - b[1]) < 1e-9 for a, b in zip(expected, got)), total + len(got)
    assert hit == total


@pytest.mark.parametrize("norm", [1, 100, 1e4, 1e6, 1e-4])
def test_ties_of_long_and_short_vectors(norm):
    rng = np.random.default_rng(6)
    q = rng.standard_normal((1, 32))
    q *= norm / np.linalg.norm(q)
    x = np.vstack([np.repeat(q, 120, axis=0), rng.standard_normal((300, 32)) * norm / 8])
    ids = rng.permutation(len(x)) + 10
    order = rng.permutation(len(x))
    index = ann.Lists(x, 6, float(np.linalg.norm(x, axis=1).max()))
    own = ids[:120].min()
    far = np.array([np.inf])
    a, b, s = ann.scan(ids[order], x[order], index.of_vectors(x)[order], np.array([own]), q, far, np.array([-np.inf]), index, 20)
    assert list(b) == sorted(ids[:120])[1:21] and len(set(s)) == 1
    a, b, s = ann.scan(ids[order], x[order], index.of_vectors(x)[order], np.array([own]), q, far, s[-1:], index, 20)
    assert list(b) == sorted(ids[:120])[1:21]


def test_shards_hold_all_lists_and_no_more_than_wanted():
    rng = np.random.default_rng(8)
    sizes = rng.integers(0, 50, 60)
    sizes[7] = 1000
    first, pieces = ann.shards_of(rng.standard_normal((60, 5)), sizes, 120)
    load = {}
    for i in range(60):
        for p in range(pieces[i]):
            load[first[i] + p] = load.get(first[i] + p, 0) + sizes[i] / pieces[i]
    assert sorted(load) == list(range(len(load))) and max(load.values()) <= 120 and pieces[7] == 9
