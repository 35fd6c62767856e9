"""Datasets, loader, index, streaming and the registered queries."""

import pickle

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from voxmill import catalogue
from voxmill import operators as ops
from voxmill.functions.spec import TensorSpec
from voxmill.plans.index import dense_index, shuffled_index
from voxmill.plans.loader import BatchTransformer, DataLoader, SampleTransformer, change_pseudo_batch_dim, numpy_collate
from voxmill.sources import AsyncDataset, Dataset
from voxmill.streaming import transform_batches, transform_stream


@pytest.fixture(scope="module")
def numbers(spark):
    return Dataset.of(spark, list(range(10)))


def load_one(path, scale=1):
    with open(path, "rb") as f:
        return {"data": [float(v) * scale for v in pickle.load(f)], "name": path.rsplit("/", 1)[-1]}


def load_many(path):
    return [load_one(path, k) for k in range(4)]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("samples")
    for i in range(10):
        (d / f"sample{i}.pkl").write_bytes(pickle.dumps([i, i + 1]))
    return d


def test_dataset(numbers):
    assert len(numbers) == 10 and numbers[3]["value"] == 3 and numbers[-1]["value"] == 9 and [r["value"] for r in numbers] == list(range(10))
    assert [r["value"] for r in numbers.get_subset([5, 2, 2])] == [5, 2, 2]
    for bad in (10, -11):
        with pytest.raises(IndexError):
            numbers[bad]
    with pytest.raises(IndexError):
        numbers.get_subset([3, 10])


def test_files(spark, folder):
    a = AsyncDataset(spark, folder, load_one, "data array<double>, name string", scale=3)
    assert len(a) == 10 and a[4]["name"] == "sample4.pkl" and a[4]["data"] == [12, 15]
    b = AsyncDataset(spark, list(folder.iterdir())[::-1], load_many, "data array<double>, name string", mode="EXTEND", num_workers=2)
    assert len(b) == 40 and b[7]["data"] == [3, 6] and [r["sample_id"] for r in b] == list(range(40))
    with pytest.raises(TypeError):
        AsyncDataset(spark, folder, load_one, "data array<double>", mode="other")
    with pytest.raises(AssertionError):
        AsyncDataset(spark, str(folder / "none"), load_one, "data array<double>")


def test_loader(numbers):
    batches = [list(b["value"]) for b in DataLoader(numbers, 4)]
    assert batches == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9]] and len(DataLoader(numbers, 4)) == 3
    assert [list(b["value"]) for b in DataLoader(numbers, 4, drop_last=True)] == batches[:2] and len(DataLoader(numbers, 4, drop_last=True)) == 2
    shuffled = DataLoader(numbers, 3, shuffle=True, seed=1)
    a = [v for b in shuffled for v in b["value"]]
    assert sorted(a) == list(range(10)) and a != list(range(10)) and a == [v for b in shuffled for v in b["value"]]
    assert a != [v for b in shuffled.set_epoch(1) for v in b["value"]]
    assert [list(b["value"]) for b in DataLoader(numbers, 2, sampler=[7, 7, 1])] == [[7, 7], [1]]
    assert [list(b["value"]) for b in DataLoader(numbers, batch_sampler=[[3], [2, 1]])] == [[3], [2, 1]]
    for bad in ({"batch_sampler": [[1]], "shuffle": True}, {"sampler": [1], "shuffle": True}, {"batch_size": 0}):
        with pytest.raises(ValueError):
            DataLoader(numbers, **bad)
    with pytest.warns(RuntimeWarning):
        DataLoader(numbers, gpu_transforms=ops.DoNothing())


def test_stages(spark):
    d = Dataset.of(spark, [{"data": [float(i)] * 4} for i in range(5)], "sample_id long, data array<double>", {"data": TensorSpec((1, 2, 2))})
    one = SampleTransformer(d, ops.RandomAddValue(1.0))
    assert one[2]["data"] == [3.0] * 4 and len(one) == 5
    with pytest.raises(IndexError):
        one[9]
    df = DataLoader(d, 2, sample_transforms=[ops.RandomAddValue(1.0)], batch_transforms=ops.RandomScaleValue(2.0)).batches().orderBy("batch_id")
    assert [r["data"] for r in df.collect()][1] == [[6.0] * 4, [8.0] * 4] and df.columns[:2] == ["batch_id", "batch_length"]
    assert change_pseudo_batch_dim(TensorSpec((2, 3)), True).shape == (1, 2, 3)
    with pytest.raises(ValueError):
        change_pseudo_batch_dim(TensorSpec((2, 3)), False)
    s = DataLoader(Dataset(d.df.withColumn("m", F.create_map(F.lit(1), F.lit(2)))), 2).samples()
    with pytest.raises(TypeError):
        numpy_collate(s)
    assert BatchTransformer().transformed(s) is s


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_index_doesnt_depend_on_partitions(spark, parts):
    df = spark.range(1000).select((F.col("id") * 7 - 100).alias("k")).repartition(parts)
    got = {r["k"]: r["i"] for r in dense_index(df, "k", "i").collect()}
    assert got == {i * 7 - 100: i for i in range(1000)}
    s = {r["k"]: r["i"] for r in shuffled_index(df, "k", "i", 3, 0).collect()}
    assert sorted(s.values()) == list(range(1000)) and s == {r["k"]: r["i"] for r in shuffled_index(df.coalesce(1), "k", "i", 3, 0).collect()}
    assert dense_index(df.limit(0), "k", "i").isEmpty()


def test_streams(spark, sf, tmp_path):
    source = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("sample_id"), F.col("embedding").cast("array<double>").alias("data"))
    source.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    t, specs = ops.Compose(ops.NormMinMax(), ops.Mirror(1, prob=0.5), ops.GaussianSmoothing(1, 3, 0.5, padding=1)), {"data": TensorSpec((1, 8, 8))}
    q = transform_stream(stream, t, specs).writeStream.format("memory").queryName("out").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    want = {r["sample_id"]: r["data"] for r in transform_stream(source, t, specs).collect()}
    got = {r["sample_id"]: r["data"] for r in spark.table("out").collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    seen = []
    q = transform_batches(stream, ops.ProgressiveResize(lambda step: 4), specs, lambda df, n: seen.append((n, df.count()))).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sum(c for _, c in seen) == 500


def test_plans_prune_and_push_down(spark, sf):
    df = catalogue.QUERIES["filter_keys"](spark, sf)
    plan = df.where("value > 1")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(value), GreaterThan(value,1.0)]" in plan and "event_type" not in plan.split("ReadSchema")[1]
    plan = catalogue.QUERIES["rot90_random"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.count() > 0 and set(entry_points.oracle_sql()) <= set(entry_points.queries())


FAST = ["flagship", "norm_zscore_channels", "noise_gaussian", "bezier_fixed", "rot90_random", "resize_bicubic", "random_crop", "affine_rotate_random", "gaussian_smoothing", "one_of", "seg_to_box",
        "box_to_seg", "rename_keys", "collate", "shuffle_batches", "subset", "adjusted_size", "argmax_channels", "windowed_events"]


@pytest.mark.parametrize("name", FAST)
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events embeddings".split():
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = catalogue.QUERIES[name](spark, sf)
    r = con.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == sorted(df.columns)
    text = lambda rows: sorted(tuple(f"{v:.6g}" if isinstance(v, float) else str(v) for v in x) for x in rows)
    assert text(df.select(*names).collect()) == text(r.fetchall())


def test_volumes_hold_every_value(spark, tmp_path):
    data = [(3 * i + 1, [float(64 * i + j) for j in range(64)]) for i in range(50)]  # ids with gaps
    spark.createDataFrame(data, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = catalogue.volumes(spark, str(tmp_path), 10).df.orderBy("sample_id").collect()
    assert [r["sample_id"] for r in got] == [1, 46, 94, 139] and all(len(r["data"]) == 1000 for r in got)
    assert sum((r["data"] for r in got), []) == [float(i if i < 3200 else 3000 + i % 200) for i in range(4000)]


@pytest.mark.parametrize("name,side", [("local_pixel_shuffle", 30), ("random_inpainting", 16), ("random_outpainting", 36), ("random_in_or_outpainting", 36), ("pipeline_pretraining", 36)])
def test_painting_queries_read_every_row(spark, sf, name, side):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").count()
    assert catalogue.QUERIES[name](spark, sf).count() == -(-rows * 64 // side**3)


def test_pixel_shuffle_query_keeps_the_values(spark, sf):
    got = {r["vec_id"]: r["total"] for r in catalogue.QUERIES["local_pixel_shuffle"](spark, sf).collect()}
    want = catalogue.volumes(spark, sf, 30).df.select("sample_id", F.aggregate("data", F.lit(0.0), lambda a, e: a + e)).collect()
    assert len(got) == len(want) and all(got[k] == pytest.approx(v, abs=1e-4) for k, v in want)


def test_sampler_takes_every_customer(spark, sf):
    test_sql(spark, sf, "sampler")
    assert catalogue.QUERIES["sampler"](spark, sf).count() == spark.read.parquet(f"{sf}/customer.parquet").count()


@pytest.mark.parametrize("even", [0, 50_000])
def test_dense_index_of_uneven_ids(spark, even, monkeypatch):
    from voxmill.plans import index

    monkeypatch.setattr(index, "EVEN", even)
    ids = [*range(0, 3000, 3), 10**15, -(2**63), 2**63 - 1, 7, 7, None, None]
    d = spark.createDataFrame([(i,) for i in ids], "k long")
    got = sorted(((r["i"], r["k"]) for r in index.dense_index(d, "k", "i").collect()))
    assert [i for i, _ in got] == list(range(len(ids)))
    assert [k for _, k in got] == sorted(i for i in ids if i is not None) + [None, None]
    assert index.dense_index(d.limit(0), "k", "i").isEmpty()
    assert index.dense_index(d.where("k is null"), "k", "i").count() == 2


def test_settings_without_effect_are_named(numbers):
    with pytest.warns(RuntimeWarning, match="worker_init_fn"):
        DataLoader(numbers, 2, worker_init_fn=print)


def test_norms_of_ragged_samples_keep_to_channels(spark):
    from voxmill.functions.spec import RAGGED
    from voxmill.operators.base import Samples

    rows = [(0, ([2, 1, 2], [1.0, 3.0, 10.0, 30.0])), (1, ([1, 1, 3], [5.0, 6.0, 7.0])), (2, None)]
    d = spark.createDataFrame(rows, "sample_id long, data struct<shape array<int>, data array<double>>")
    out = {r[0]: r[1] for r in ops.NormMinMax(eps=None)(Samples(d, {"data": RAGGED})).df.select("sample_id", "data").collect()}
    assert out[0]["data"] == [0.0, 1.0, 0.0, 1.0] and out[1]["data"] == [0.0, 0.5, 1.0] and out[2] is None


def test_boxes_of_gaps_nulls_and_borders(spark):
    from voxmill.operators.base import Samples

    d = spark.createDataFrame([(0, [0, 3, 0, 3, 1, 0]), (1, None), (2, [0] * 6), (3, [-1, 0, 2, 2, 0, 0])], "sample_id long, seg array<long>")
    s = ops.SegToBox({"seg": "boxes"})(Samples(d, {"seg": TensorSpec((1, 2, 3))}))
    got = {r[0]: r[1] for r in s.df.select("sample_id", "boxes").collect()}
    assert got == {0: [[1, 1, 1, 1], None, [0, 0, 1, 1]], 1: None, 2: [], 3: [None, [0, 0, 1, 2]]}
    back = ops.BoxToSeg({"boxes": "again"}, (2, 3))(s)
    assert {r[0]: r[1] for r in back.df.select("sample_id", "again").collect()} == {0: [3, 3, 0, 3, 3, 0], 1: None, 2: [0] * 6, 3: [2, 2, 2, 2, 2, 2]}


def test_transform_call_by_the_kind_of_its_input():
    from voxmill.plans.loader import default_transform_call

    assert default_transform_call({"a": 1, "b": 2}, lambda a, b: a + b) == 3
    assert default_transform_call([1, 2], lambda a, b: a - b) == -1 and default_transform_call((4,), lambda a: a) == 4
    assert default_transform_call("ab", len) == 2


def test_transformers_can_be_replaced(numbers):
    made = []

    class Own(DataLoader):
        def get_batch_transformer(self, *a, **k):
            made.append("batch")
            return super().get_batch_transformer(*a, **k)

        def get_sample_transformer(self, *a, **k):
            made.append("sample")
            return super().get_sample_transformer(*a, **k)

    assert Own(numbers, 4).batches().count() == 3 and sorted(made) == ["batch", "sample"]


def test_registered_samplers_are_drawn(spark, sf):
    from voxmill.functions.rng import UniformParameter
    from voxmill.operators.intensity import add_value

    s = catalogue.batched(spark, sf)
    t = ops.BaseTransform(add_value, name="add")
    t.register_sampler("value", UniformParameter(1, 2))
    with pytest.raises(NameError):
        t.register_sampler("value", 1)
    same = ops.BaseTransform(add_value, name="add", value=UniformParameter(1, 2))
    assert t(s).df.exceptAll(same(s).df).isEmpty()
    before = {r[0]: r[1] for r in s.df.select("sample_id", "data").collect()}
    moved = [r[1][0] - before[r[0]][0] for r in t(s).df.select("sample_id", "data").collect()]
    assert all(1 <= m <= 2 for m in moved) and len({round(m, 4) for m in moved}) > 1
