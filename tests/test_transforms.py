"""Transforms on small samples: known values, invariants, errors, and independence of partitioning."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxmill import functional as fn
from voxmill import operators as ops
from voxmill.functions import kernels
from voxmill.functions import matrix as mx
from voxmill.functions import rng
from voxmill.functions.spec import TensorSpec
from voxmill.operators.base import Samples

NINE = [float(i) for i in range(1, 10)]


@pytest.fixture(scope="module")
def nine(spark):
    df = spark.createDataFrame([(0, NINE, [0, 1, 2, 0, 1, 2, 0, 1, 2], 7), (1, NINE[::-1], [0] * 9, 8), (2, None, None, 9)], "sample_id long, data array<double>, seg array<long>, label int")
    return Samples(df, {"data": TensorSpec((1, 3, 3)), "seg": TensorSpec((1, 3, 3))})


def get(s, key="data"):
    return [r[key] for r in s.df.orderBy(s.id_col).collect()]


def first(s, key="data"):
    return get(s, key)[0]


def test_mirror(nine):
    assert first(fn.mirror(nine, 0)) == [7, 8, 9, 4, 5, 6, 1, 2, 3]
    assert first(fn.mirror(nine, 1)) == [3, 2, 1, 6, 5, 4, 9, 8, 7]
    assert first(fn.mirror(fn.mirror(nine, (0, 1)), (0, 1))) == NINE and get(fn.mirror(nine, 0))[2] is None


def test_rot90(nine):
    assert first(fn.rot90(nine, 1, (0, 1))) == [3, 6, 9, 2, 5, 8, 1, 4, 7]
    s = nine
    for _ in range(4):
        s = fn.rot90(s, 1, (0, 1))
    assert first(s) == NINE


def test_fused_chain_equals_single_steps(nine):
    steps = [ops.Mirror(0, prob=1.0), ops.Rot90((0, 1), num_rots=(1,), prob=1.0), ops.CenterCrop(2), ops.ResizeNative(4), ops.DoNothing()]
    fused = ops.Compose(*steps)
    assert len(fused.ordered(nine)) == 1
    s = nine
    for t in steps:
        s = t(s)
    assert get(fused(nine)) == get(s) and fused(nine).spec("data") == s.spec("data")


def test_resize_and_crops(nine):
    assert first(fn.resize_native(nine, 2)) == [1, 2, 4, 5]
    assert first(fn.crop(nine, (1, 1), (5, 5))) == [5, 6, 8, 9]
    assert first(fn.center_crop(nine, 1)) == [5]
    with pytest.raises(TypeError):
        fn.random_crop(nine, 3)
    with pytest.raises(ValueError):
        kernels.interpolate(np.zeros((1, 1, 3)), [2], "nearest", True)
    for mode, rank in (("linear", 1), ("bilinear", 2), ("trilinear", 3), ("bicubic", 2), ("area", 2)):
        x = np.full((2, 1, *[4] * rank), 2.5)
        np.testing.assert_allclose(kernels.interpolate(x, [7] * rank, mode), 2.5)


def test_random_crop_is_shared_by_keys(spark):
    df = spark.createDataFrame([(i, list(range(100)), list(range(100)), i // 4) for i in range(12)], "sample_id long, data array<int>, seg array<int>, b long")
    s = Samples(df, {k: TensorSpec((1, 10, 10)) for k in ("data", "seg")}, batch_col="b", seed=3)
    rows = ops.RandomCrop((3, 4), keys=("data", "seg"))(s).df.collect()
    assert all(r["data"] == r["seg"] and len(r["data"]) == 12 for r in rows)
    assert {b: len({tuple(r["data"]) for r in rows if r["b"] == b}) for b in range(3)} == {0: 1, 1: 1, 2: 1}


def test_norms(nine):
    x = np.array(NINE)
    np.testing.assert_allclose(first(ops.NormMinMax(eps=None)(nine)), (x - 1) / 8)
    np.testing.assert_allclose(first(ops.NormRange(-1, 1)(nine)), (x - 5) / 4, atol=1e-6)
    np.testing.assert_allclose(first(ops.NormZeroMeanUnitStd()(nine)), (x - 5) / x.std(ddof=1), atol=1e-6)
    np.testing.assert_allclose(first(ops.NormMeanStd(2, 4)(nine)), (x - 2) / 4)
    assert get(ops.NormMinMax()(nine))[2] is None


def test_zscore_of_one_value_is_not_a_number(spark):
    s = Samples(spark.createDataFrame([(0, [3.0])], "sample_id long, data array<double>"), {"data": TensorSpec((1, 1))})
    assert math.isnan(first(ops.NormZeroMeanUnitStd()(s))[0])


def test_intensity(nine):
    x = np.array(NINE)
    assert first(ops.Clamp(2, 7)(nine)) == list(np.clip(x, 2, 7))
    np.testing.assert_allclose(first(ops.GammaCorrection(2)(nine)), x**2)
    assert first(ops.InvertAmplitude(1.0, 10, 0)(nine)) == list(10 - x) and first(ops.InvertAmplitude(0.0)(nine)) == NINE
    with pytest.raises(ValueError):
        ops.Noise("pink")
    with pytest.raises(TypeError):
        ops.Clamp(0, 1, nonsense=3)


@pytest.mark.parametrize("kind,params,mean", [("normal", {}, 0), ("uniform", {}, 0.5), ("exponential", {"lambd": 2}, 0.5), ("bernoulli", {"p": 0.25}, 0.25), ("geometric", {"p": 0.5}, 2), ("random", {"low": 0, "high": 3}, 1)])
def test_noise_has_its_mean(spark, kind, params, mean):
    s = Samples(spark.range(40).select(F.col("id").alias("sample_id"), F.array_repeat(F.lit(0.0), 100).alias("data")), {"data": TensorSpec((1, 100))})
    values = np.concatenate(get(fn.add_noise(s, kind, **params)))
    assert abs(values.mean() - mean) < 0.1 and len(set(values)) > 1


def test_interpolation_goes_on_beyond_the_ends():
    x, y = np.array([0.0, 1, 2]), np.array([0.0, 2, 3])
    np.testing.assert_allclose(kernels.interp1d(x, y, np.array([-1, 0.5, 1, 3.0])), [-2, 1, 2, 4])
    cx, cy = kernels.bezier_curve((1 / 3, 1 / 3), (2 / 3, 2 / 3))
    np.testing.assert_allclose(cx, cy)


def test_conditions_depend_on_batches_only(spark):
    s = Samples(spark.range(200).select(F.col("id").alias("sample_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("data"), (F.col("id") / 10).cast("long").alias("b")), {"data": TensorSpec((1, 2))}, batch_col="b")
    t = ops.Compose(ops.Mirror(0, prob=0.5), ops.DropoutCompose(ops.RandomAddValue(10.0), dropout=0.5), ops.OneOf(ops.RandomScaleValue(2.0), ops.RandomScaleValue(3.0), p=0.8))
    a = get(t(s))
    assert a == get(t(s.with_df(s.df.repartition(7)))) == get(t(s.with_df(s.df.coalesce(1))))
    assert all(len({tuple(v) for v in a[i : i + 10]}) == 1 for i in range(0, 200, 10)) and len({tuple(v) for v in a}) > 4
    assert get(t(Samples(**{**s.__dict__, "epoch": 1}))) != a


def test_compose_errors():
    with pytest.raises(ValueError):
        ops.Compose()
    with pytest.raises(TypeError):
        ops.DropoutCompose(ops.DoNothing(), dropout=[0.1, 0.2])
    with pytest.raises(ValueError):
        ops.OneOf(ops.DoNothing(), weights=[1, 2])


def test_compose_shuffle_is_a_permutation_of_the_epoch(nine):
    c = ops.Compose(*[ops.RandomAddValue(float(i), name=str(i)) for i in range(6)], shuffle=True)
    orders = {tuple(t.name for t in c.ordered(Samples(nine.df, nine.specs, epoch=e))) for e in range(5)}
    assert len(orders) > 1 and all(sorted(o) == list("012345") for o in orders)


def test_plain_functions_compose(nine):
    t = ops.Compose(lambda s: fn.mirror(s, 0), ops.UDFTransform(lambda df: df.withColumn("extra", F.lit(1)), frame=True))
    assert "extra" in t(nine).df.columns


def test_labels(nine, spark):
    assert first(fn.one_hot_batch(nine), "seg") == [1, 0, 0] * 3 + [0, 1, 0] * 3 + [0, 0, 1] * 3
    back = ops.ArgMax(0)(fn.one_hot_batch(nine, 3))
    assert first(back, "seg") == [0, 1, 2] * 3 and back.spec("seg").fixed == (1, 3, 3)
    with pytest.raises(TypeError):
        ops.OneHot(keys=("data",))(nine)
    np.testing.assert_array_equal(fn.np_one_hot(np.array([0, 2, 5]), 3), [[1, 0, 0], [0, 0, 1], [0, 0, 0]])


def test_boxes_there_and_back(spark):
    seg = np.zeros((10, 10, 10), int)
    seg[1:3, 1:3, 1:3], seg[5:8, 5:8, 1:3] = 1, 2
    df = spark.createDataFrame([(0, seg.ravel().tolist(), [2, 1])], "sample_id long, seg array<long>, cls array<int>")
    s = ops.SegToBox({"seg": "boxes"})(Samples(df, {"seg": TensorSpec((1, 10, 10, 10))}))
    assert first(s, "boxes") == [[1, 1, 1, 2, 2, 2], [5, 5, 1, 7, 7, 2]]
    assert first(ops.BoxToSeg({"boxes": "again"}, (10, 10, 10))(s), "again") == seg.ravel().tolist()
    semantic = first(fn.instance_to_semantic(s, {"seg": "sem"}, "cls"), "sem")
    assert semantic == np.array([0, 2, 1])[seg.ravel()].tolist()
    gap = spark.createDataFrame([(0, [0, 2, 0, 0]), (1, [0] * 4)], "sample_id long, seg array<long>")
    assert get(ops.SegToBox({"seg": "b"})(Samples(gap, {"seg": TensorSpec((1, 2, 2))})), "b") == [[None, [0, 1, 0, 1]], []]


def test_keys(spark):
    s = Samples(spark.createDataFrame([tuple(range(11))], ["sample_id", *[f"k{i}" for i in range(10)]]))
    even = lambda k: int(k[1:]) % 2 == 0
    assert fn.filter_keys(s, even).df.columns == ["sample_id", "k0", "k2", "k4", "k6", "k8"]
    rest, gone = fn.pop_keys(s, even, return_popped=True)
    assert "k1" in rest.df.columns and "k0" not in rest.df.columns and gone.df.columns == ["sample_id", "k0", "k2", "k4", "k6", "k8"]
    with pytest.raises(KeyError):
        fn.pop_keys(s, ["nothing"])
    assert ops.FilterKeys(["k3", "nothing"])(s).df.columns == ["sample_id", "k3"]
    r = ops.RenameKeys({"k0": "k1", "k1": "z"})(s).df.first()
    assert r["z"] == 1 and "k1" not in r.asDict()
    assert ops.SeqToMap("a", "b")(ops.MapToSeq("k5", "k4")(s)).df.first().asDict() == {"sample_id": 0, "a": 6, "b": 5}
    with pytest.raises(KeyError):
        ops.Clamp(0, 1, keys=("nothing",))(s)


def test_types_and_tensor_ops(nine):
    assert first(ops.Compose(ops.RandomScaleValue(-0.5), ops.ToDtype("bigint"))(nine)) == [0, -1, -1, -2, -2, -3, -3, -4, -4]
    assert first(fn.tensor_op(nine, "sum")) == [45.0]
    assert first(fn.tensor_op(nine, "transpose", 1, 2)) == [1, 4, 7, 2, 5, 8, 3, 6, 9]
    assert first(fn.tensor_op(nine, "cumsum", 2))[:3] == [1, 3, 6]
    assert first(ops.Permute({"data": (1, 0, 2)})(nine)) == NINE and ops.Permute({"data": (1, 0, 2)})(nine).spec("data").fixed == (3, 1, 3)
    with pytest.raises(ValueError):
        fn.tensor_op(nine, "no_such_thing")
    assert ops.ToDevice("cuda")(nine) is nine


def test_matrices():
    np.testing.assert_allclose(mx.parametrize_matrix(2.0, None, [1, 3], 2, image=False), [[2, 0, 2], [0, 2, 6]])
    np.testing.assert_allclose(mx.parametrize_matrix(2.0, None, [1, 3], 2), [[0.5, 0, -1], [0, 0.5, -3]])
    np.testing.assert_allclose(mx.apply_to_point(mx.parametrize_matrix(None, [0, 0, 90], None, 3, True, False), [1, 1, 1]), [-1, 1, 1], atol=1e-12)
    m = np.arange(1, 10).reshape(3, 3)
    np.testing.assert_array_equal(mx.revert_coordinate_order(m.tolist()), [m[1, [1, 0, 2]], m[0, [1, 0, 2]], m[2]])
    square = m[:2, :2]
    h = mx.matrix_to_homogeneous(square.tolist())
    assert np.array(h).shape == (3, 3) and h[-1] == [0, 0, 1] and [r[2] for r in h] == [0, 0, 1]
    np.testing.assert_array_equal(mx.matrix_to_cartesian(h, True), square)
    assert mx.expand_scalar_param([1, 2], 3, 2).tolist() == [[1, 2]] * 3 and mx.expand_scalar_param([1, 2, 3], 3, 2).tolist() == [[1, 1], [2, 2], [3, 3]]
    with pytest.raises(ValueError):
        mx.expand_scalar_param([1, 2, 3, 4], 3, 2)
    for bad in (None, [1, 2], [[1.0]]):
        with pytest.raises(ValueError):
            mx.normalise_matrix(bad, 2)
    np.testing.assert_allclose(fn.affine_point_transform(np.array([[[0.0, 1], [1, 0]]]), np.array([[[1.0, 0, 0], [0, 5, 0]]])), [[[0, 5], [1, 0]]])


@pytest.mark.parametrize("align", [False, True])
@pytest.mark.parametrize("mode", ["bilinear", "nearest"])
@pytest.mark.parametrize("padding", ["zeros", "border", "reflection"])
def test_sampling_identity(align, mode, padding):
    for shape in ((2, 3, 5, 4), (1, 2, 3, 4, 5)):
        x = np.random.default_rng(0).random(shape)
        d = len(shape) - 2
        np.testing.assert_allclose(fn.affine_image_transform(x, np.eye(d, d + 1), align_corners=align, interpolation_mode=mode, padding_mode=padding), x, atol=1e-12)


def test_affine_sizes(spark):
    rows = [(i, np.random.default_rng(i).random(3 * 25 * 30).tolist()) for i in range(2)]
    s = Samples(spark.createDataFrame(rows, "sample_id long, data array<double>"), {"data": TensorSpec((3, 25, 30))})
    for t, size in (
        (ops.BaseAffine(), (25, 30)), (ops.Scale(5, adjust_size=True), (5, 6)), (ops.Scale([5, 3], adjust_size=True), (5, 10)), (ops.Resize((50, 90)), (50, 90)),
        (ops.Rotate([90], adjust_size=True, degree=True), (30, 25)), (ops.Translate(10, adjust_size=True), (25, 30)), (ops.Scale(5, per_sample=False), (25, 30)),
    ):
        out = t(s)
        spec = out.spec("data")
        shape = tuple(out.df.first()["data"]["shape"]) if spec.ragged else spec.fixed
        assert shape == (3, *size)


def test_stacking_keeps_options():
    t = ops.Scale(2.0, interpolation_mode="nearest", keys=("a",)) + np.eye(2)
    assert t.mode == "nearest" and t.keys == ("a",) and len(t.transforms) == 2
    assert len((mx.eye(2) + ops.Scale(2.0)).transforms) == 2


def test_smoothing(nine, spark):
    k = kernels.gaussian_kernel(2, (3, 5), (1.0, 0.5))
    assert k.shape == (2, 1, 3, 5) and abs(k[0].sum() - 1) < 1e-12
    ones = Samples(spark.createDataFrame([(0, [1.0] * 50)], "sample_id long, data array<double>"), {"data": TensorSpec((2, 5, 5))})
    np.testing.assert_allclose(first(ops.GaussianSmoothing(2, 3, 1.0, padding=1)(ones)), 1.0)
    with pytest.raises(TypeError):
        ops.GaussianSmoothing(1, 3, 1.0, dim=4)


def test_painting(spark):
    x = np.random.default_rng(1).random((2, 36, 36, 36))
    s = Samples(spark.createDataFrame([(5, x.ravel().tolist())], "sample_id long, data array<double>"), {"data": TensorSpec(x.shape)})
    y = np.array(first(ops.LocalPixelShuffle(50)(s)))
    assert (y != x.ravel()).any() and np.allclose(np.sort(y), np.sort(x.ravel()))
    z = np.array(first(ops.RandomOutpainting(1.0)(s))).reshape(x.shape)
    assert 0.2 < (z == x).mean() < 0.7
    again = np.array(first(ops.RandomOutpainting(1.0)(s.with_df(s.df.repartition(3))))).reshape(x.shape)
    assert (z == again).all()


def test_schedule():
    t = ops.SizeStepScheduler([20, 10], [16, 64, 32])
    assert [t(i) for i in (-1, 0, 9, 10, 19, 20, 99)] == [16, 16, 16, 32, 32, 64, 64]
    with pytest.raises(TypeError):
        ops.SizeStepScheduler([10], [1])
    p = ops.ProgressiveResize(t)
    assert p.increment().step == 1 and p.reset_step().step == 0


def test_parameters():
    u = rng.Draws(1, 0, 5, "p").value
    assert 2 <= rng.UniformParameter(2, 3).one(u) < 3 and rng.DiscreteParameter((1,)).draw() == 1
    assert rng.DiscreteParameter([None], True).draw((2, 2)) is None
    assert sorted(rng.DiscreteParameter([1, 2, 3]).draw(3)) == [1, 2, 3]
    with pytest.raises(ValueError):
        rng.DiscreteParameter([1, 2]).draw(3)
    with pytest.raises(ValueError):
        rng.DiscreteParameter([1, 2], weights=[1, 2])
    assert rng.combinations_all([0, 1]) == [(0,), (1,), (0, 1)]
    assert rng.reshape_list(list(range(6)), (2, 3)) == [[0, 1, 2], [3, 4, 5]]
    assert all(map(rng.check_scalar, (0.0, 1, True, np.array(1))))
    assert not any(map(rng.check_scalar, (None, "1", [1, 1], np.array([1, 2]))))
    n = [rng.NormalParameter(3, 2).one(rng.Draws(0, 0, i, "n").value) for i in range(2000)]
    assert abs(np.mean(n) - 3) < 0.2 and abs(np.std(n) - 2) < 0.2


def test_columns_draw_what_the_driver_draws(spark):
    for p in (rng.UniformParameter(-1, 4), rng.NormalParameter(0, 1), rng.DiscreteParameter([3, 5, 9], True, [1, 5, 2]), rng.DiscreteParameter([3, 5, 9])):
        got = [r[0] for r in spark.range(20).select(p.column(rng.Draws(7, 2, F.col("id"), "x"))).collect()]
        np.testing.assert_allclose(got, [p.one(rng.Draws(7, 2, i, "x").value) for i in range(20)])
