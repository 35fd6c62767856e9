"""Painting against what its definition allows, voxel by voxel."""

import numpy as np
import pytest

from voxmill import catalogue
from voxmill import operators as ops


def painted(spark, sf, side, transform):
    s = catalogue.volumes(spark, sf, side)
    before = {r[0]: np.array(r[1]).reshape((side,) * 3) for r in s.df.select("sample_id", "data").collect()}
    out = transform(s)
    x = out.df.select("sample_id", "data.data" if out.specs["data"].ragged else "data")
    return [(before[r[0]], np.array(r[1]).reshape((side,) * 3)) for r in x.collect()]


def box_of(mask):
    """Where the mask is, as slices of its bounding box."""
    at = np.argwhere(mask)
    return tuple(slice(a, b + 1) for a, b in zip(at.min(axis=0), at.max(axis=0)))


def test_volumes_hold_every_value_in_order(spark, sf):
    rows = [r[0] for r in spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").select("embedding").collect()]
    flat = np.concatenate([np.array(r, float) for r in rows])
    got = catalogue.volumes(spark, sf, 16).df.orderBy("sample_id").collect()
    want = [flat[i : i + 4096] for i in range(0, len(flat), 4096)]
    assert len(got) == len(want)
    for r, w in zip(got, want):
        assert np.array_equal(np.array(r["data"]), np.resize(w, 4096))


def test_outpainting_keeps_one_block(spark, sf):
    pairs = painted(spark, sf, 36, ops.RandomOutpainting(1.0))
    assert pairs
    for x, y in pairs:
        kept = box_of(x == y)
        assert np.array_equal(x[kept], y[kept])
        assert all(36 * 5 // 7 <= s.stop - s.start <= 36 * 6 // 7 and s.start >= 3 and s.stop <= 33 for s in kept)
        rest = np.ones(x.shape, bool)
        rest[kept] = False
        assert (y[rest] >= 0).all() and (y[rest] <= 1).all() and 0.45 < y[rest].mean() < 0.55


def test_inpainting_changes_blocks_alone(spark, sf):
    pairs = painted(spark, sf, 16, ops.RandomInpainting(1))
    changed = 0
    for x, y in pairs:
        if (x == y).all():
            continue
        changed += 1
        where = box_of(x != y)
        assert (x != y)[where].all() and all(1 <= s.stop - s.start <= 4 and s.start >= 3 and s.stop <= 13 for s in where)
        assert (y[where] >= 0).all() and (y[where] <= 1).all()
    assert changed
    for x, y in painted(spark, sf, 16, ops.RandomInpainting(5)):
        assert ((x != y).sum() <= 5 * 4**3) and (y[:3] == x[:3]).all() and (y[13:] == x[13:]).all()


def test_pixel_shuffle_of_one_block(spark, sf):
    moved = 0
    for x, y in painted(spark, sf, 30, ops.LocalPixelShuffle(1)):
        if (x == y).all():
            continue
        moved += 1
        where = box_of(x != y)
        assert all(s.stop - s.start <= 3 for s in where) and np.array_equal(np.sort(x[where].ravel()), np.sort(y[where].ravel()))
    assert moved


def test_pixel_shuffle_keeps_values(spark, sf):
    for x, y in painted(spark, sf, 30, ops.LocalPixelShuffle()):
        assert np.array_equal(np.sort(x.ravel()), np.sort(y.ravel())) and (x != y).mean() > 0.2


@pytest.mark.parametrize("prob,out", [(1.0, True), (0.0, False)])
def test_in_or_outpainting_is_one_of_both(spark, sf, prob, out):
    for x, y in painted(spark, sf, 36, ops.RandomInOrOutpainting(prob)):
        assert ((x == y).mean() < 0.7) == out and ((y[:3] == x[:3]).all() != out)


def test_pretraining_changes_values_and_keeps_the_mirrored(spark, sf):
    rows = catalogue.QUERIES["pipeline_pretraining"](spark, sf).collect()
    sums = {r[0]: sum(r[1]) for r in catalogue.volumes(spark, sf, 36).df.select("sample_id", "data").collect()}
    assert len(rows) == len(sums)
    for r in rows:
        assert r["n"] == r["m"] == 36**3 and abs(r["pristine_total"] - sums[r["vec_id"]]) < 1e-5 and abs(r["total"] - r["pristine_total"]) > 1e-3


def test_segmentation_like_numpy_where_nothing_is_drawn(spark, sf):
    """The resize and the norm of the pipeline, on the values, by plain loops."""
    s = catalogue.batched(spark, sf, catalogue.VOLUME)
    s = ops.Compose(ops.ResizeNative((3, 5, 4), mode="trilinear"), ops.NormZeroMeanUnitStd())(s)
    got = {r[0]: np.array(r[1]).reshape(3, 5, 4) for r in s.df.select("sample_id", "data").collect()}
    for r in spark.read.parquet(f"{sf}/embeddings.parquet").limit(5).collect():
        x = np.array(r["embedding"], float).reshape(4, 4, 4)

        def along(x, axis, n):
            m = x.shape[axis]
            at = np.clip((np.arange(n) + 0.5) * m / n - 0.5, 0, m - 1)
            low = np.minimum(at.astype(int), m - 1)
            high, w = np.minimum(low + 1, m - 1), at - low
            shape = [n if i == axis else 1 for i in range(3)]
            return np.take(x, low, axis) * (1 - w).reshape(shape) + np.take(x, high, axis) * w.reshape(shape)

        y = along(along(along(x, 0, 3), 1, 5), 2, 4)
        np.testing.assert_allclose(got[r["vec_id"]], (y - y.mean()) / (y.std(ddof=1) + 1e-8), atol=1e-6)
