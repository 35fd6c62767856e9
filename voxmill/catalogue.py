"""The registered queries of the engine itself and their SQL.

Images are rows of ``embeddings``: 64 values as 1x8x8, 4x4x4 (channels first) or
1x4x4x4; batches are runs of 32 ids.  Results are long, (vec_id, pos, v), with
values rounded to 6 places.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import operators as ops
from .functions import kernels
from .functions import matrix as mx
from .functions.rng import DiscreteParameter, NormalParameter, UniformParameter
from .functions.spec import TensorSpec
from .operators.base import Samples
from .operators.compose import as_ragged
from .plans.index import dense_index
from .plans.loader import DataLoader
from .sources.dataset import AsyncDataset, Dataset, images
from .streaming import windowed_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
IMAGE, CHANNELS, VOLUME = (1, 8, 8), (4, 4, 4), (1, 4, 4, 4)


def batched(spark: SparkSession, sf_dir: str, shape=IMAGE) -> Samples:
    s = images(spark, sf_dir, shape)
    return replace(s, df=s.df.withColumn("batch_id", F.floor(F.col("sample_id") / 32).cast("long")), batch_col="batch_id")


def long(s: Samples, key: str = "data") -> DataFrame:
    values = F.col(f"{key}.data") if key in s.specs and s.specs[key].ragged else F.col(key)
    df = s.df.select(F.col(s.id_col).alias("vec_id"), F.posexplode(values).alias("pos", "v"))
    return df.select("vec_id", "pos", (F.round(F.col("v").cast("double"), 6) + F.lit(0.0)).alias("v"))


def on_images(name: str, make: Callable[[], Callable], sql: str | None = None, shape=IMAGE, key: str = "data") -> None:
    """Registers a transform of images, and the SQL of its long result."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return long(make()(batched(spark, sf_dir, shape)), key)

    QUERIES[name] = run
    if sql:
        ORACLE_SQL[name] = sql


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return register


X = "(SELECT vec_id, vec_id // 32 AS bid, label, unnest(embedding)::DOUBLE AS e, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)"


def each(expr: str, source: str = X) -> str:
    """SQL of a value for each element."""
    return f"SELECT vec_id, pos::INTEGER AS pos, round({expr}, 6) + 0 AS v FROM {source}"


def at(expr: str, n: int = 64, more: str = "") -> str:
    """SQL of n output positions p, from list ``x`` of values from 1."""
    return (
        f"SELECT vec_id, p::INTEGER AS pos, round({expr}, 6) + 0 AS v FROM (SELECT vec_id, vec_id // 32 AS bid, label, embedding::DOUBLE[] AS x{more} FROM embeddings), "
        f"(SELECT unnest(range({n})) AS p)"
    )


def u(scope: str, op: str, draw: int | str = 0) -> str:
    return f"(('0x' || substr(md5('0:0:' || ({scope})::VARCHAR || ':{op}:{draw}'), 1, 8))::BIGINT / 4294967296.0)"


def normal(scope: str, op: str) -> str:
    return f"sqrt(-2 * ln(greatest({u(scope, op, 0)}, 1 / 4294967296.0))) * cos(2 * pi() * {u(scope, op, 1)})"


# -- flagship

@query("flagship", f"""
SELECT bid AS batch_id, ((pos // 8) * 8 + 7 - pos % 8)::INTEGER AS pos, round(avg((e - lo) / (hi - lo + 1e-8)), 6) AS mean_value, count(*) AS n
FROM (SELECT *, min(e) OVER (PARTITION BY vec_id) AS lo, max(e) OVER (PARTITION BY vec_id) AS hi FROM {X}) GROUP BY ALL""")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ops.Compose(ops.NormMinMax(), ops.Mirror(1, prob=1.0))(batched(spark, sf_dir))
    df = s.df.select("batch_id", F.posexplode("data").alias("pos", "v"))
    return df.groupBy("batch_id", "pos").agg(F.round(F.avg("v"), 6).alias("mean_value"), F.count(F.lit(1)).alias("n"))


# -- intensity

on_images("clamp", lambda: ops.Clamp(-0.1, 0.2), each("least(0.2, greatest(-0.1, e))"))
_BY = {"sample": "PARTITION BY vec_id", "channel": "PARTITION BY vec_id, pos // 16"}
for _name, _shape, _by in (("", IMAGE, "sample"), ("_channels", CHANNELS, "channel")):
    _w = f"(SELECT *, min(e) OVER w AS lo, max(e) OVER w AS hi, avg(e) OVER w AS m, stddev_samp(e) OVER w AS sd FROM {X} WINDOW w AS ({_BY[_by]}))"
    on_images(f"norm_min_max{_name}", lambda: ops.NormMinMax(), each("(e - lo) / (hi - lo + 1e-8)", _w), _shape)
    on_images(f"norm_range{_name}", lambda: ops.NormRange(-1, 2), each("(e - lo) / (hi - lo + 1e-8) * 3 - 1", _w), _shape)
    on_images(f"norm_zscore{_name}", lambda: ops.NormZeroMeanUnitStd(), each("(e - m) / (sd + 1e-8)", _w), _shape)
on_images("norm_min_max_whole", lambda: ops.NormMinMax(per_channel=False), ORACLE_SQL["norm_min_max"], CHANNELS)
on_images("norm_mean_std", lambda: ops.NormMeanStd([0.1, 0.0, -0.1, 0.2], [1.0, 2.0, 0.5, 1.5]),
          each("(e - [0.1, 0.0, -0.1, 0.2][pos // 16 + 1]) / [1.0, 2.0, 0.5, 1.5][pos // 16 + 1]"), CHANNELS)
on_images("gamma_correction", lambda: ops.Compose(ops.TensorOp("abs"), ops.GammaCorrection(0.7)), each("pow(abs(e), 0.7)"))
on_images("gamma_random", lambda: ops.Compose(ops.TensorOp("abs"), ops.GammaCorrection(UniformParameter(0.5, 2))),
          each(f"pow(abs(e), 0.5 + {u('bid', 'GammaCorrection')} * 1.5)"))
on_images("add_value", lambda: ops.RandomAddValue(0.25), each("e + 0.25"))
on_images("scale_by_value", lambda: ops.RandomScaleValue(-3.0), each("e * -3"))
on_images("random_add_value", lambda: ops.RandomAddValue(UniformParameter(-1, 1)), each(f"e - 1 + {u('bid', 'RandomAddValue')} * 2"))
on_images("random_add_channels", lambda: ops.RandomAddValue(UniformParameter(-1, 1), per_channel=True),
          each("e - 1 + 2 * CASE pos // 16 " + " ".join(f"WHEN {c} THEN {u('bid', 'RandomAddValue', c)}" for c in range(4)) + " END"), CHANNELS)
on_images("random_scale_value", lambda: ops.RandomScaleValue(NormalParameter(1, 0.1)), each(f"e * ({normal('bid', 'RandomScaleValue')} * 0.1 + 1)"))
on_images("random_scale_discrete", lambda: ops.RandomScaleValue(DiscreteParameter([0.5, 1.0, 2.0], True, [1, 2, 1])),
          each(f"e * CASE WHEN {u('bid', 'RandomScaleValue')} * 4 < 1 THEN 0.5 WHEN {u('bid', 'RandomScaleValue')} * 4 < 3 THEN 1.0 ELSE 2.0 END"))
on_images("invert_amplitude", lambda: ops.InvertAmplitude(1.0, 1.0, -0.5), each("0.5 - e"))
on_images("invert_random", lambda: ops.InvertAmplitude(0.5), each(f"CASE WHEN {u('bid', 'InvertAmplitude:data')} < 0.5 THEN 1 - e ELSE e END"))
_SP = "vec_id || ':' || pos"
on_images("noise_gaussian", lambda: ops.GaussianNoise(0.1, 0.5), each(f"e + ({normal(_SP, 'GaussianNoise:data')} * 0.5 + 0.1)"))
on_images("noise_exponential", lambda: ops.ExponentialNoise(2.0), each(f"e - ln(1 - {u(_SP, 'ExponentialNoise:data')}) / 2"))
on_images("noise_uniform", lambda: ops.Noise("uniform_", low=-1, high=1), each(f"e + {u(_SP, 'Noise:data')} * 2 - 1"))
on_images("noise_bernoulli", lambda: ops.Noise("bernoulli", p=0.3), each(f"e + ({u(_SP, 'Noise:data')} < 0.3)::INTEGER"))
on_images("noise_cauchy", lambda: ops.Noise("cauchy", sigma=0.01), each(f"e + tan(({u(_SP, 'Noise:data')} - 0.5) * pi()) * 0.01"))
on_images("noise_log_normal", lambda: ops.Noise("log_normal", mean=0.0, std=0.5), each(f"e + exp({normal(_SP, 'Noise:data')} * 0.5)"))
on_images("noise_geometric", lambda: ops.Noise("geometric", p=0.5),
          each(f"e + floor(ln(greatest(1 - {u(_SP, 'Noise:data')}, 1 / 4294967296.0)) / ln(0.5)) + 1"))
on_images("noise_random", lambda: ops.Noise("random", low=0, high=5), each(f"e + floor({u(_SP, 'Noise:data')} * 5)"))


def _bezier_sql(p: list[str]) -> str:
    """The curve of each batch is made in SQL too; segment i serves values up to its right end, the first and last go on."""
    t = "(i / 999.0)"
    px, py = (f"3 * (1 - {t}) ** 2 * {t} * {x} + 3 * (1 - {t}) * {t} ** 2 * {y} + {t} ** 3" for x, y in ((p[0], p[2]), (p[1], p[3])))
    return f"""
WITH g AS (SELECT bid, i, {px} AS cx, {py} AS cy FROM (SELECT DISTINCT vec_id // 32 AS bid FROM embeddings), (SELECT unnest(range(1000)) AS i)),
l AS (SELECT bid, list_sort(list(cx)) AS xs, list_sort(list(cy)) AS ys FROM g GROUP BY bid),
b AS (SELECT bid, CASE WHEN j = 1 THEN -1e9 ELSE xs[j] END AS lo, xs[j] AS cx, ys[j] AS cy, xs[j + 1] AS nx, ys[j + 1] AS ny FROM l, (SELECT unnest(range(1, 1000)) AS j))
SELECT x.vec_id, x.pos::INTEGER AS pos, round(cy + (ny - cy) / (2.220446049250313e-16 + nx - cx) * (e - cx), 6) + 0 AS v
FROM (SELECT vec_id, bid, pos, e - 1e-12 AS q, e FROM {X}) x ASOF JOIN b ON x.bid = b.bid AND x.q >= b.lo"""


on_images("bezier_fixed", lambda: ops.RandomBezierTransform(points=[0.2, 0.9, 0.7, 0.1]), _bezier_sql(["0.2", "0.9", "0.7", "0.1"]))
on_images("bezier_random", lambda: ops.RandomBezierTransform(), _bezier_sql([u("bid", "RandomBezierTransform:data", d) for d in range(4)]))

# -- spatial

on_images("mirror_0", lambda: ops.Mirror(0, prob=1.0), at("x[(7 - p // 8) * 8 + p % 8 + 1]"))
on_images("mirror_1", lambda: ops.Mirror(1, prob=1.0), at("x[(p // 8) * 8 + 7 - p % 8 + 1]"))
on_images("mirror_01", lambda: ops.Mirror((0, 1), prob=1.0), at("x[64 - p]"))
on_images("mirror_random", lambda: ops.Mirror(1, prob=0.5), at(f"CASE WHEN {u('bid', 'Mirror')} < 0.5 THEN x[(p // 8) * 8 + 7 - p % 8 + 1] ELSE x[p + 1] END"))
_PAIR = f"least(floor({u('bid', 'Mirror', 1)} * 3), 2)"
_P3 = "(p // 16)", "((p // 4) % 4)", "(p % 4)"
on_images("mirror_random_pair", lambda: ops.Mirror((0, 1, 2), prob=0.5), at(
    f"CASE WHEN {u('bid', 'Mirror')} >= 0.5 THEN x[p + 1] WHEN {_PAIR} = 0 THEN x[(3 - {_P3[0]}) * 16 + (3 - {_P3[1]}) * 4 + {_P3[2]} + 1] "
    f"WHEN {_PAIR} = 1 THEN x[(3 - {_P3[0]}) * 16 + {_P3[1]} * 4 + 3 - {_P3[2]} + 1] ELSE x[{_P3[0]} * 16 + (3 - {_P3[1]}) * 4 + 3 - {_P3[2]} + 1] END"), VOLUME)
_ROT = {0: "x[p + 1]", 1: "x[(p % 8) * 8 + 7 - p // 8 + 1]", 2: "x[64 - p]", 3: "x[(7 - p % 8) * 8 + p // 8 + 1]"}
for _k in (1, 2, 3):
    on_images(f"rot90_{_k}", lambda k=_k: ops.Rot90((0, 1), num_rots=(k,), prob=1.0), at(_ROT[_k]))
on_images("rot90_random", lambda: ops.Rot90((0, 1), prob=0.75), at(
    f"CASE WHEN {u('bid', 'Rot90')} >= 0.75 THEN x[p + 1] ELSE CASE least(floor({u('bid', 'Rot90', 1)} * 4), 3) "
    + " ".join(f"WHEN {k} THEN {v}" for k, v in _ROT.items()) + " END END"))
on_images("permute", lambda: ops.Permute({"data": (2, 0, 1)}), at(f"x[{_P3[1]} * 16 + {_P3[2]} * 4 + {_P3[0]} + 1]"), CHANNELS)
on_images("crop", lambda: ops.Crop((2, 5), (4, 6)), at("x[(p // 3 + 2) * 8 + p % 3 + 5 + 1]", 12))
on_images("center_crop", lambda: ops.CenterCrop((5, 3)), at("x[(p // 3 + 2) * 8 + p % 3 + 2 + 1]", 15))
on_images("random_crop", lambda: ops.RandomCrop(4, dist=1), at(
    f"x[(p // 4 + floor({u('bid', 'RandomCrop', 0)} * 3)::INTEGER) * 8 + p % 4 + floor({u('bid', 'RandomCrop', 1)} * 3)::INTEGER + 1]", 16))
on_images("resize_nearest", lambda: ops.ResizeNative((5, 12)), at("x[floor(p // 12 * 1.6)::INTEGER * 8 + floor(p % 12 * 8 / 12.0)::INTEGER + 1]", 60))
on_images("zoom_nearest", lambda: ops.Zoom((0.75, 1.25)), at("x[least(floor(p // 10 / 0.75), 7)::INTEGER * 8 + least(floor(p % 10 / 1.25), 7)::INTEGER + 1]", 60))


def _bilinear(n_in: int, n_out: int, align: bool) -> str:
    def axis(o: str) -> tuple[str, str, str]:
        src = f"({o} * {(n_in - 1) / (n_out - 1)!r})" if align else f"greatest(0, ({o} + 0.5) * {n_in / n_out!r} - 0.5)"
        low = f"least(floor({src}), {n_in - 1})::INTEGER"
        return low, f"least({low} + 1, {n_in - 1})", f"({src} - {low})"

    (r0, r1, fr), (c0, c1, fc) = axis(f"(p // {n_out})"), axis(f"(p % {n_out})")
    v = lambda r, c: f"x[{r} * {n_in} + {c} + 1]"
    return f"(1 - {fr}) * ((1 - {fc}) * {v(r0, c0)} + {fc} * {v(r0, c1)}) + {fr} * ((1 - {fc}) * {v(r1, c0)} + {fc} * {v(r1, c1)})"


on_images("resize_bilinear", lambda: ops.ResizeNative(12, mode="bilinear"), at(_bilinear(8, 12, False), 144))
on_images("resize_bilinear_aligned", lambda: ops.ResizeNative(5, mode="bilinear", align_corners=True), at(_bilinear(8, 5, True), 25))
on_images("resize_area", lambda: ops.ResizeNative(4, mode="area"),
          at("(x[p // 4 * 16 + p % 4 * 2 + 1] + x[p // 4 * 16 + p % 4 * 2 + 2] + x[p // 4 * 16 + p % 4 * 2 + 9] + x[p // 4 * 16 + p % 4 * 2 + 10]) / 4", 16))


def _bicubic_sql() -> str:
    wr, wc = (kernels.axis_weights(8, n, "bicubic", False) for n in (6, 6))
    rows = [f"[{', '.join(repr(float(v)) for v in np.outer(wr[i], wc[j]).ravel())}]" for i in range(6) for j in range(6)]
    return at(f"list_dot_product(x, [{', '.join(rows)}][p + 1])", 36)


on_images("resize_bicubic", lambda: ops.ResizeNative(6, mode="bicubic"), _bicubic_sql())
on_images("resize_preserve_range", lambda: ops.ResizeNative(6, mode="bicubic", preserve_range=True), f"""
WITH r AS (SELECT bid, min(e) AS lo, max(e) AS hi FROM {X} GROUP BY bid), b AS ({_bicubic_sql().replace('round(', '(').replace(', 6) + 0 AS v', ') AS v')})
SELECT vec_id, pos, round(least(greatest(v, lo), hi), 6) + 0 AS v FROM b JOIN r ON vec_id // 32 = bid""")
on_images("zoom_random", lambda: ops.Zoom(UniformParameter(0.75, 1.25)), f"""
SELECT vec_id, p::INTEGER AS pos, round(embedding[least(floor((p // n) * (1 / f)), 7)::INTEGER * 8 + least(floor((p % n) * (1 / f)), 7)::INTEGER + 1]::DOUBLE, 6) + 0 AS v
FROM (SELECT *, floor(8 * f)::INTEGER AS n FROM (SELECT *, 0.75 + {u('vec_id // 32', 'Zoom')} * 0.5 AS f FROM embeddings)), (SELECT unnest(range(100)) AS p) WHERE p < n * n""")
_SCHEDULE = ops.SizeStepScheduler([2, 5], [4, 8, 16])
on_images("progressive_resize", lambda: ops.ProgressiveResize(_SCHEDULE), f"""
SELECT vec_id, p::INTEGER AS pos, round(embedding[floor((p // n) * 8.0 / n)::INTEGER * 8 + floor((p % n) * 8.0 / n)::INTEGER + 1]::DOUBLE, 6) + 0 AS v
FROM (SELECT *, CASE WHEN vec_id // 32 >= 5 THEN 16 WHEN vec_id // 32 >= 2 THEN 8 ELSE 4 END AS n FROM embeddings), (SELECT unnest(range(256)) AS p) WHERE p < n * n""")


@query("step_schedule", "SELECT DISTINCT vec_id // 32 AS batch_id, CASE WHEN vec_id // 32 >= 5 THEN 16 WHEN vec_id // 32 >= 2 THEN 8 ELSE 4 END AS size FROM embeddings")
def step_schedule(spark, sf_dir):
    s = batched(spark, sf_dir)
    return s.df.select("batch_id", _SCHEDULE.column(F.col("batch_id")).alias("size")).distinct()


# -- composition

on_images("compose_fused", lambda: ops.Compose(ops.Mirror(0, prob=1.0), ops.Rot90((0, 1), num_rots=(1,), prob=1.0), ops.CenterCrop(4)),
          at("x[(7 - (p % 4 + 2)) * 8 + 7 - (p // 4 + 2) + 1]", 16))
on_images("compose_chain", lambda: ops.Compose(ops.NormZeroMeanUnitStd(), ops.Clamp(-1, 1), ops.DoNothing(), ops.RandomScaleValue(2.0)),
          each("least(1, greatest(-1, (e - m) / (sd + 1e-8))) * 2", f"(SELECT *, avg(e) OVER w AS m, stddev_samp(e) OVER w AS sd FROM {X} WINDOW w AS ({_BY['sample']}))"))
on_images("dropout_compose", lambda: ops.DropoutCompose(ops.RandomAddValue(1.0), ops.RandomScaleValue(2.0), dropout=[0.3, 0.6]), each(
    f"(e + CASE WHEN {u('bid', 'DropoutCompose', 0)} > 0.3 THEN 1 ELSE 0 END) * CASE WHEN {u('bid', 'DropoutCompose', 1)} > 0.6 THEN 2 ELSE 1 END"))
on_images("one_of", lambda: ops.OneOf(ops.RandomAddValue(1.0), ops.RandomScaleValue(2.0), ops.Mirror(1, prob=1.0), weights=[1, 2, 1], p=0.9), at(
    f"CASE WHEN {u('bid', 'OneOf', 0)} >= 0.9 THEN x[p + 1] WHEN {u('bid', 'OneOf', 1)} < 0.25 THEN x[p + 1] + 1 WHEN {u('bid', 'OneOf', 1)} < 0.75 THEN x[p + 1] * 2 "
    "ELSE x[(p // 8) * 8 + 7 - p % 8 + 1] END"))
on_images("udf_transform", lambda: ops.BaseTransform(lambda x, k: np.tanh(x) * k, batch=True, k=UniformParameter(1, 2)),
          each(f"(exp(2 * e) - 1) / (exp(2 * e) + 1) * (1 + {u('bid', 'BaseTransform')})"))
on_images("per_channel_transform", lambda: ops.PerChannelTransform(lambda x: F.transform(x, lambda e: e / F.array_max(x)), per_channel=True),
          each("e / hi", f"(SELECT *, max(e) OVER ({_BY['channel']}) AS hi FROM {X})"), CHANNELS)
on_images("per_sample_transform", lambda: ops.PerSampleTransform(lambda x: x - np.median(x)), each("e - m", f"(SELECT *, median(e) OVER ({_BY['sample']}) AS m FROM {X})"))

# -- affine

on_images("affine_identity", lambda: ops.BaseAffine(), at("x[p + 1]"))
on_images("affine_rotate_90", lambda: ops.Rotate(90, degree=True), at(_ROT[3]))
on_images("affine_nearest_180", lambda: ops.Rotate(180, degree=True, interpolation_mode="nearest"), at(_ROT[2]))


def _sampled(theta: str, reflected: bool = False, source: str = "(SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings)") -> str:
    """Bilinear sampling of 8x8 with a matrix a, b, c, d, e2, f of SQL: zeros outside, or aligned corners and reflection."""
    grid = (lambda o: f"2 * {o} / 7.0 - 1") if reflected else (lambda o: f"(2 * {o} + 1) / 8.0 - 1")
    fold = lambda g: f"least(abs(({g} + 1) / 2 * 7) % 14, 14 - abs(({g} + 1) / 2 * 7) % 14)" if reflected else f"(({g} + 1) * 8 - 1) / 2"
    tap = lambda r, c: f"CASE WHEN {r} BETWEEN 0 AND 7 AND {c} BETWEEN 0 AND 7 THEN x[{r} * 8 + {c} + 1] ELSE 0 END"
    return f"""
WITH t AS (SELECT vec_id, x, {theta} FROM {source}),
g AS (SELECT t.*, p, {grid('(p % 8)')} AS gx, {grid('(p // 8)')} AS gy FROM t, (SELECT unnest(range(64)) AS p)),
q AS (SELECT vec_id, p, x, {fold('(a * gx + b * gy + c)')} AS sx, {fold('(d * gx + e2 * gy + f)')} AS sy FROM g),
w AS (SELECT *, floor(sx)::INTEGER AS c0, floor(sy)::INTEGER AS r0, sx - floor(sx) AS fx, sy - floor(sy) AS fy FROM q)
SELECT vec_id, p::INTEGER AS pos, round((1 - fy) * ((1 - fx) * {tap('r0', 'c0')} + fx * {tap('r0', '(c0 + 1)')})
  + fy * ((1 - fx) * {tap('(r0 + 1)', 'c0')} + fx * {tap('(r0 + 1)', '(c0 + 1)')}), 6) + 0 AS v FROM w"""


on_images("affine_bilinear", lambda: ops.Affine([[0.9, 0.2, 0.1], [-0.1, 1.1, -0.05]]), _sampled("0.9 AS a, 0.2 AS b, 0.1 AS c, -0.1 AS d, 1.1 AS e2, -0.05 AS f"))
on_images("affine_scale", lambda: ops.Scale((2.0, 0.5)), _sampled("0.5 AS a, 0.0 AS b, 0.0 AS c, 0.0 AS d, 2.0 AS e2, 0.0 AS f"))
on_images("affine_translate", lambda: ops.Translate((2, 1)), _sampled("1.0 AS a, 0.0 AS b, -0.25 AS c, 0.0 AS d, 1.0 AS e2, -0.125 AS f"))
_ANGLE = f"radians(-30 + {u('vec_id', 'Rotate:rotation')} * 60)"
on_images("affine_rotate_random", lambda: ops.Rotate(UniformParameter(-30, 30), degree=True),
          _sampled(f"cos({_ANGLE}) AS a, sin({_ANGLE}) AS b, 0.0 AS c, -sin({_ANGLE}) AS d, cos({_ANGLE}) AS e2, 0.0 AS f"))
on_images("affine_stacked", lambda: ops.Scale(2.0) + ops.Affine([[0.9, 0.2], [-0.1, 1.1]]), _sampled("0.45 AS a, 0.1 AS b, 0.0 AS c, -0.05 AS d, 0.55 AS e2, 0.0 AS f"))
on_images("affine_resize", lambda: ops.Resize(16, interpolation_mode="nearest"),
          at("x[round((2 * (p // 16) + 1) / 8.0 + 1.5)::INTEGER * 8 + round((2 * (p % 16) + 1) / 8.0 + 1.5)::INTEGER + 1]", 256))
on_images("affine_adjusted", lambda: ops.Rotate(90, degree=True, adjust_size=True), at(_ROT[3]))
on_images("affine_reflection", lambda: ops.Affine([[1.5, 0, 0], [0, 1.5, 0]], padding_mode="reflection", align_corners=True),
          _sampled("1.5 AS a, 0.0 AS b, 0.0 AS c, 0.0 AS d, 1.5 AS e2, 0.0 AS f", True))
on_images("affine_volume", lambda: ops.Rotate((0, 0, 90), degree=True), at("x[(p // 16) * 16 + (3 - p % 4) * 4 + (p // 4) % 4 + 1]"), VOLUME)
_S, _R = f"(0.8 + {u('vec_id', 'BaseAffine:scale')} * 0.4)", f"radians(-30 + {u('vec_id', 'BaseAffine:rotation')} * 60)"
_T = f"-(-0.02 + {u('vec_id', 'BaseAffine:translation')} * 0.04)"
on_images("affine_random", lambda: ops.BaseAffine(UniformParameter(0.8, 1.2), UniformParameter(-30, 30), UniformParameter(-0.02, 0.02), degree=True),
          _sampled(f"cos({_R}) / {_S} AS a, sin({_R}) / {_S} AS b, {_T} AS c, -sin({_R}) / {_S} AS d, cos({_R}) / {_S} AS e2, {_T} AS f"))

_COS, _SIN = "cos(radians(label * 36))", "sin(radians(label * 36))"


@query("affine_points", f"""
SELECT vec_id, round(2 * ({_COS} * (embedding[1]::DOUBLE + 0.5) - {_SIN} * (embedding[2]::DOUBLE - 1)), 6) + 0 AS x,
  round(3 * ({_SIN} * (embedding[1]::DOUBLE + 0.5) + {_COS} * (embedding[2]::DOUBLE - 1)), 6) + 0 AS y FROM embeddings""")
def affine_points(spark, sf_dir):
    s = images(spark, sf_dir)
    d = F.col("data")
    s = s.with_column("points", F.array(F.array(d[0].cast("double"), d[1].cast("double"))))
    m = mx.parametrize_matrix([2.0, 3.0], F.col("label") * 36, [0.5, -1.0], 2, degree=True, image=False)
    df = ops.AffinePoints(m, 2)(s).df
    return df.select(F.col("sample_id").alias("vec_id"), *[(F.round(F.col("points")[0][i], 6) + 0.0).alias(c) for i, c in enumerate("xy")])


@query("affine_matrix", f"""
SELECT vec_id, round({_COS} / 2, 6) + 0 AS m00, round({_SIN} / 3, 6) + 0 AS m01, (-0.5)::DOUBLE AS m02, round(-{_SIN} / 2, 6) + 0 AS m10, round({_COS} / 3, 6) + 0 AS m11, 1.0::DOUBLE AS m12 FROM embeddings""")
def affine_matrix(spark, sf_dir):
    m = mx.parametrize_matrix([2.0, 3.0], F.col("label") * 36, [0.5, -1.0], 2, degree=True)
    df = images(spark, sf_dir).df
    entries = [(x if not isinstance(x, float) else F.lit(x)).cast("double") for r in m for x in r]
    return df.select(F.col("sample_id").alias("vec_id"), *[(F.round(x, 6) + 0.0).alias(f"m{i // 3}{i % 3}") for i, x in enumerate(entries)])


@query("adjusted_size", f"""
WITH p AS (SELECT vec_id, vec_id // 32 AS batch_id, {_COS} * r - {_SIN} * c AS y, {_SIN} * r + {_COS} * c AS x
  FROM embeddings, (SELECT unnest([0, 0, 8, 8]) AS r, unnest([0, 8, 0, 8]) AS c)),
s AS (SELECT batch_id, vec_id, max(y) - min(y) AS h, max(x) - min(x) AS w FROM p GROUP BY ALL)
SELECT batch_id, floor(max(h) + 1e-4)::INTEGER AS height, floor(max(w) + 1e-4)::INTEGER AS width FROM s GROUP BY batch_id""")
def adjusted_size(spark, sf_dir):
    s = batched(spark, sf_dir)
    rotate = ops.BaseAffine(None, F.col("label") * 36, None, degree=True, image_transform=False, adjust_size=True)
    shape = F.col("data.shape")
    return rotate(s).df.select("batch_id", shape[1].alias("height"), shape[2].alias("width")).distinct()


# -- kernels and painting

def _gauss_taps() -> str:
    k = kernels.gaussian_kernel(1, (3, 3), (0.5, 0.5))[0, 0]
    edge = lambda v: f"(CASE WHEN {v} < 0 THEN -({v}) WHEN {v} > 7 THEN 14 - ({v}) ELSE {v} END)"
    taps = [f"{float(k[i, j])!r} * x[{edge(f'(p // 8 + {i - 1})')} * 8 + {edge(f'(p % 8 + {j - 1})')} + 1]" for i in range(3) for j in range(3)]
    return " + ".join(taps)


on_images("gaussian_smoothing", lambda: ops.GaussianSmoothing(1, 3, 0.5, padding=1), at(_gauss_taps()))


def _stride_sql() -> str:
    k = kernels.gaussian_kernel(1, (3, 3), (1.0, 1.0))[0, 0]
    row, column = "((p // 2) % 2 * 2 + {i})", "(p % 2 * 2 + {j})"
    taps = []
    for i in range(3):
        for j in range(3):
            r, c = row.format(i=i - 1), column.format(j=j - 1)
            taps.append(f"CASE WHEN {r} >= 0 AND {c} >= 0 THEN {float(k[i, j])!r} * x[p // 4 * 16 + {r} * 4 + {c} + 1] ELSE 0 END")
    return at(" + ".join(taps), 16)


on_images("gaussian_stride", lambda: ops.GaussianSmoothing(4, 3, 1.0, stride=2, padding=1, padding_mode="zero"), _stride_sql(), CHANNELS)


def volumes(spark: SparkSession, sf_dir: str, side: int) -> Samples:
    """The values of all embeddings in the order of ids, cut into volumes; each has the id that it begins in.

    A row at a border gives to both sides.  The last volume repeats its own values to be full.
    """
    n = side**3
    df = Dataset.indexed(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), "vec_id", id_col="at").df
    first = F.col("at") * 64
    df = df.withColumn("volume", F.explode(F.sequence(F.floor(first / n), F.floor((first + 63) / n))))
    start = F.greatest(F.col("volume") * n - first, F.lit(0)).cast("int")
    end = F.least((F.col("volume") + 1) * n - first, F.lit(64)).cast("int")
    part = F.slice(F.col("embedding").cast("array<double>"), start + 1, end - start)
    df = df.groupBy("volume").agg(F.array_sort(F.collect_list(F.struct("at", "vec_id", part.alias("v")))).alias("rows"))
    v = F.flatten(F.col("rows.v"))
    df = df.select(F.col("rows")[0]["vec_id"].alias("sample_id"), v.alias("v"))
    full = F.when(F.size("v") < n, F.slice(F.flatten(F.array_repeat("v", F.ceil(F.lit(n) / F.size("v")).cast("int"))), 1, n)).otherwise(F.col("v"))
    return Samples(df.select("sample_id", full.alias("data")), {"data": TensorSpec((1, side, side, side))})


def on_volumes(name: str, make: Callable[[], Callable], side: int) -> None:
    def run(spark, sf_dir):
        s = make()(volumes(spark, sf_dir, side))
        x = F.col("data.data") if s.specs["data"].ragged else F.col("data")
        return s.df.select(F.col("sample_id").alias("vec_id"), F.size(x).alias("n"), F.round(F.aggregate(x, F.lit(0.0), lambda a, e: a + e), 6).alias("total"))

    QUERIES[name] = run


on_volumes("local_pixel_shuffle", lambda: ops.LocalPixelShuffle(), 30)
#: Whatever is drawn, a volume keeps its values.
ORACLE_SQL["local_pixel_shuffle"] = f"""
WITH a AS (SELECT vec_id, e, (row_number() OVER (ORDER BY vec_id, pos) - 1)::BIGINT AS i FROM {X}),
v AS (SELECT i // 27000 AS k, min(vec_id) AS vec_id, count(*) AS c, sum(e) AS all_ FROM a GROUP BY 1)
SELECT v.vec_id, 27000 AS n, round(any_value(all_) * (27000 // any_value(c)) + coalesce(sum(e) FILTER (i % 27000 < 27000 % c), 0), 6) AS total
FROM v JOIN a ON i // 27000 = k GROUP BY v.vec_id, k"""
on_volumes("random_inpainting", lambda: ops.RandomInpainting(), 16)
on_volumes("random_outpainting", lambda: ops.RandomOutpainting(1.0), 36)
on_volumes("random_in_or_outpainting", lambda: ops.RandomInOrOutpainting(), 36)

# -- labels, types and keys


@query("one_hot", "SELECT vec_id, k::INTEGER AS pos, (label = k)::INTEGER::BIGINT AS v FROM embeddings, (SELECT unnest(range(10)) AS k)")
def one_hot(spark, sf_dir):
    s = images(spark, sf_dir)
    s = s.with_column("seg", F.array(F.col("label").cast("long")), TensorSpec((1, 1)))
    df = ops.OneHot(10)(s).df
    return df.select(F.col("sample_id").alias("vec_id"), F.posexplode("seg").alias("pos", "v"))


@query("one_hot_argmax", "SELECT vec_id, label::BIGINT AS v FROM embeddings")
def one_hot_argmax(spark, sf_dir):
    s = images(spark, sf_dir)
    s = s.with_column("seg", F.array(F.col("label").cast("long")), TensorSpec((1, 1)))
    df = ops.Compose(ops.OneHot(), ops.ArgMax(0))(s).df
    return df.select(F.col("sample_id").alias("vec_id"), F.col("seg")[0].alias("v"))


on_images("argmax_channels", lambda: ops.ArgMax(0, keys=("data",)), at(
    "(list_position(l, list_max(l)) - 1)", 16).replace("AS p)", "AS p), LATERAL (SELECT [x[p + 1], x[p + 17], x[p + 33], x[p + 49]] AS l)"), CHANNELS)
on_images("to_dtype", lambda: ops.Compose(ops.RandomScaleValue(10.0), ops.ToDtype("bigint")), each("trunc(e * 10)"))
on_images("tensor_op", lambda: ops.Compose(ops.TensorOp("mul", 2.0), ops.TensorOp("exp_"), ops.TensorOp("transpose", 1, 2)), at("exp(2 * x[(p % 8) * 8 + p // 8 + 1])"))
on_images("tensor_op_numpy", lambda: ops.TensorOp("cumsum", 2),
          each("sum(e) OVER (PARTITION BY vec_id, pos // 8 ORDER BY pos)"))
on_images("tensor_op_sum", lambda: ops.TensorOp("sum"), f"SELECT vec_id, 0 AS pos, round(sum(e), 6) + 0 AS v FROM {X} GROUP BY vec_id")


def _segmented(spark, sf_dir) -> Samples:
    s = images(spark, sf_dir)
    seg = F.transform("data", lambda e, p: F.when(e > 0.1, 1 + (p / 32).cast("long")).otherwise(F.lit(0).cast("long")))
    return s.with_column("seg", seg, TensorSpec(IMAGE))


_SEG = f"(SELECT vec_id, pos, CASE WHEN e > 0.1 THEN 1 + pos // 32 ELSE 0 END AS id FROM {X})"


@query("seg_to_box", f"""
SELECT vec_id, (id - 1)::INTEGER AS box, min(pos // 8)::DOUBLE AS r0, min(pos % 8)::DOUBLE AS c0, max(pos // 8)::DOUBLE AS r1, max(pos % 8)::DOUBLE AS c1
FROM {_SEG} WHERE id > 0 GROUP BY vec_id, id""")
def seg_to_box(spark, sf_dir):
    df = ops.SegToBox({"seg": "boxes"})(_segmented(spark, sf_dir)).df
    df = df.select(F.col("sample_id").alias("vec_id"), F.posexplode("boxes").alias("box", "b")).where("b is not null")
    return df.select("vec_id", "box", *[F.col("b")[i].alias(c) for i, c in enumerate(("r0", "c0", "r1", "c1"))])


@query("box_to_seg", """
SELECT vec_id, p::INTEGER AS pos, CASE WHEN p // 8 BETWEEN 2 AND 5 AND p % 8 BETWEEN label % 4 AND label % 4 + 2 THEN 2
  WHEN p // 8 BETWEEN 0 AND 3 AND p % 8 BETWEEN 1 AND 6 THEN 1 ELSE 0 END::BIGINT AS v FROM embeddings, (SELECT unnest(range(64)) AS p)""")
def box_to_seg(spark, sf_dir):
    s = images(spark, sf_dir)
    c = F.col("label") % 4
    s = s.with_column("boxes", F.array(F.array(*[F.lit(v) for v in (0, 1, 3, 6)]), F.array(F.lit(2), c, F.lit(5), c + 2)))
    df = ops.BoxToSeg({"boxes": "seg"}, (8, 8))(s).df
    return df.select(F.col("sample_id").alias("vec_id"), F.posexplode("seg").alias("pos", "v"))


@query("instance_to_semantic", f"""
SELECT s.vec_id, pos::INTEGER AS pos, CASE id WHEN 0 THEN 0 WHEN 1 THEN label ELSE 0 END::BIGINT AS v FROM {_SEG} s JOIN embeddings e ON s.vec_id = e.vec_id""")
def instance_to_semantic(spark, sf_dir):
    s = _segmented(spark, sf_dir)
    s = s.with_column("cls", F.array("label"))
    df = ops.InstanceToSemantic({"seg": "seg"}, "cls")(s).df
    return df.select(F.col("sample_id").alias("vec_id"), F.posexplode("seg").alias("pos", "v"))


def _events(spark, sf_dir) -> Samples:
    return Samples(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "value"), id_col="event_id")


def on_events(name: str, make: Callable[[], Callable], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: make()(_events(spark, sf_dir)).df
    ORACLE_SQL[name] = sql


on_events("rename_keys", lambda: ops.RenameKeys({"value": "score", "event_type": "value", "user_id": "score"}), "SELECT event_id, user_id AS score, event_type AS value FROM events")
on_events("filter_keys", lambda: ops.FilterKeys(["value", "nothing"]), "SELECT event_id, value FROM events")
on_events("filter_keys_predicate", lambda: ops.FilterKeys(lambda k: k.startswith("e")), "SELECT event_id, event_type FROM events")
on_events("pop_keys", lambda: ops.PopKeys(["user_id"]), "SELECT event_id, event_type, value FROM events")
on_events("map_to_seq", lambda: ops.MapToSeq("value", "user_id"), "SELECT event_id, value, user_id FROM events")
on_events("seq_to_map", lambda: ops.SeqToMap("a", "b"), "SELECT event_id, user_id AS a, event_type AS b FROM events")

# -- loading


def _orders(spark, sf_dir) -> Dataset:
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice", "o_orderstatus")
    return Dataset.indexed(df, "o_orderkey")


_ORDERS = "(SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS sample_id, o_orderkey, o_totalprice, o_orderstatus FROM orders)"
_HASHED = f"(SELECT *, row_number() OVER (ORDER BY md5('7:0:' || sample_id), sample_id) - 1 AS pos FROM {_ORDERS})"


@query("dense_index", f"SELECT sample_id, o_orderkey FROM {_ORDERS}")
def dense_index_query(spark, sf_dir):
    return _orders(spark, sf_dir).df.select("sample_id", "o_orderkey")


@query("batch_stats", f"SELECT sample_id // 64 AS batch_id, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {_ORDERS} GROUP BY 1")
def batch_stats(spark, sf_dir):
    df = DataLoader(_orders(spark, sf_dir), 64).samples().df
    return df.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("collate", f"SELECT sample_id // 64 AS batch_id, count(*) AS batch_length, string_agg(o_orderkey::VARCHAR, ',' ORDER BY sample_id) AS keys FROM {_ORDERS} GROUP BY 1")
def collate_query(spark, sf_dir):
    df = DataLoader(_orders(spark, sf_dir), 64).batches()
    return df.select("batch_id", "batch_length", F.concat_ws(",", F.col("o_orderkey").cast("array<string>")).alias("keys"))


@query("drop_last", f"SELECT sample_id // 64 AS batch_id, count(*) AS n FROM {_ORDERS} GROUP BY 1 HAVING count(*) = 64")
def drop_last(spark, sf_dir):
    return DataLoader(_orders(spark, sf_dir), 64, drop_last=True).samples().df.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"))


@query("shuffle_batches", f"SELECT pos // 32 AS batch_id, pos, o_orderkey FROM {_HASHED}")
def shuffle_batches(spark, sf_dir):
    return DataLoader(_orders(spark, sf_dir), 32, shuffle=True, seed=7).samples().df.select("batch_id", "pos", "o_orderkey")


@query("subset", f"SELECT pos AS sample_id, o_orderkey FROM {_ORDERS} o JOIN (SELECT unnest([5, 3, 3, 0, 99]) AS i, unnest(range(5)) AS pos) s ON o.sample_id = s.i")
def subset(spark, sf_dir):
    return _orders(spark, sf_dir).get_subset([5, 3, 3, 0, 99]).df.select("sample_id", "o_orderkey")


@query("sampler", f"""
SELECT pos // 8 AS batch_id, pos, o_orderkey FROM {_ORDERS} o
JOIN (SELECT c_custkey AS pos, (c_custkey * 7) % (SELECT count(*) FROM orders) AS i FROM customer) s ON o.sample_id = s.i""")
def sampler(spark, sf_dir):
    """A sample for every customer, from all orders."""
    orders = _orders(spark, sf_dir)
    key = F.col("c_custkey")
    index = spark.read.parquet(f"{sf_dir}/customer.parquet").select(key.alias("pos"), ((key * 7) % max(1, len(orders))).alias("sample"))
    return DataLoader(orders, 8, sampler=index).samples().df.select("batch_id", "pos", "o_orderkey")


@query("batch_sampler", f"SELECT b AS batch_id, pos, o_orderkey FROM {_ORDERS} o JOIN (SELECT unnest([1, 2, 3, 9]) AS i, unnest([0, 0, 1, 1]) AS b, unnest(range(4)) AS pos) s ON o.sample_id = s.i")
def batch_sampler(spark, sf_dir):
    return DataLoader(_orders(spark, sf_dir), batch_sampler=[[1, 2], [3, 9]]).samples().df.select("batch_id", "pos", "o_orderkey")


def _named(path: str) -> list[dict]:
    """The rows of a table's file, as a load function gives them."""
    key, name = ("c_custkey", "c_name") if "customer" in path else ("s_suppkey", "s_name")
    t = pq.read_table(path.removeprefix("file:"), columns=[key, name]).sort_by(key)
    return [{"key": k, "name": n} for k, n in zip(t[key].to_pylist(), t[name].to_pylist())]


@query("extend_rows", """
SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS sample_id, c_custkey AS key, c_name AS name FROM customer
UNION ALL SELECT (SELECT count(*) FROM customer) + row_number() OVER (ORDER BY s_suppkey) - 1, s_suppkey, s_name FROM supplier""")
def extend_rows(spark, sf_dir):
    """Every file gives many samples, in the order of the paths."""
    paths = [f"{sf_dir}/{t}.parquet" for t in ("supplier", "customer")]
    return AsyncDataset(spark, paths, _named, "key long, name string", mode="extend").df.select("sample_id", "key", "name")


@query("append_rows", """
SELECT 0::BIGINT AS sample_id, count(*) AS n, max(c_custkey) AS last FROM customer UNION ALL SELECT 1, count(*), max(s_suppkey) FROM supplier""")
def append_rows(spark, sf_dir):
    """Every file gives one sample."""
    paths = [f"{sf_dir}/{t}.parquet" for t in ("supplier", "customer")]
    return AsyncDataset(spark, paths, _summary, "n long, last long").df.select("sample_id", "n", "last")


def _summary(path: str) -> dict:
    rows = _named(path)
    return {"n": len(rows), "last": rows[-1]["key"] if rows else None}


@query("dense_order_numbers", "SELECT o_orderkey * o_orderkey AS k, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders")
def dense_order_numbers(spark, sf_dir):
    """Dense numbers of ids that are spread unevenly."""
    d = spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.col("o_orderkey") * F.col("o_orderkey")).alias("k"))
    return dense_index(d, "k", "i")


@query("norm_ragged_channels", f"""
SELECT vec_id, pos::INTEGER AS pos, round((e - min(e) OVER w) / (max(e) OVER w - min(e) OVER w + 1e-8), 6) + 0 AS v FROM {X} WINDOW w AS (PARTITION BY vec_id, pos // 16)""")
def norm_ragged_channels(spark, sf_dir):
    """Samples whose shapes aren't known when planning keep one range a channel."""
    s = batched(spark, sf_dir, CHANNELS)
    return long(ops.NormMinMax()(as_ragged(s, "data")))


@query("loader_transforms", f"""
SELECT (row_number() OVER (ORDER BY vec_id, pos) - 1) // 2048 AS batch_id, vec_id, pos::INTEGER AS pos, round((e - lo) / (hi - lo + 1e-8) + 0.5, 6) AS v
FROM (SELECT *, min(e) OVER w AS lo, max(e) OVER w AS hi FROM {X} WINDOW w AS ({_BY['sample']}))""")
def loader_transforms(spark, sf_dir):
    df = images(spark, sf_dir).df.withColumnRenamed("sample_id", "vec_id")
    data = Dataset.indexed(df, "vec_id", {"data": TensorSpec(IMAGE)})
    s = DataLoader(data, 32, sample_transforms=ops.NormMinMax(), batch_transforms=[ops.RandomAddValue(0.5)]).samples()
    out = s.df.select("batch_id", "vec_id", F.posexplode("data").alias("pos", "v"))
    return out.select("batch_id", "vec_id", "pos", F.round("v", 6).alias("v"))


@query("windowed_events", """
SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def windowed_events(spark, sf_dir):
    df = windowed_counts(spark.read.parquet(f"{sf_dir}/events.parquet"))
    return df.select(F.col("window.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


# -- whole pipelines

def _turned(source: str, prob: float = 0.5) -> str:
    """Lists x of the source, rotated and mirrored as the batch draws."""
    rotated = f"CASE WHEN {u('bid', 'Rot90')} >= {prob} THEN x[p + 1] ELSE CASE least(floor({u('bid', 'Rot90', 1)} * 4), 3) " + " ".join(f"WHEN {k} THEN {v}" for k, v in _ROT.items()) + " END END"
    mirrored = f"CASE WHEN {u('bid', 'Mirror')} < {prob} THEN x[64 - p] ELSE x[p + 1] END"
    for expr in (rotated, mirrored):
        source = f"(SELECT vec_id, bid, list({expr} ORDER BY p) AS x FROM {source}, (SELECT unnest(range(64)) AS p) GROUP BY vec_id, bid)"
    return source


_Z = f"(SELECT vec_id, bid, list((e - m) / (sd + 1e-8) ORDER BY pos) AS x FROM (SELECT *, avg(e) OVER w AS m, stddev_samp(e) OVER w AS sd FROM {X} WINDOW w AS ({_BY['sample']})) GROUP BY vec_id, bid)"
_HALF = f"radians({u('vec_id', 'Rotate:rotation')} * 180)"
on_images("pipeline_readme", lambda: ops.Compose(
    ops.NormZeroMeanUnitStd(), ops.Rot90((0, 1), prob=0.5), ops.Mirror((0, 1), prob=0.5), ops.Rotate(UniformParameter(0, 180), degree=True)),
    _sampled(f"cos({_HALF}) AS a, sin({_HALF}) AS b, 0.0 AS c, -sin({_HALF}) AS d, cos({_HALF}) AS e2, 0.0 AS f", source=_turned(_Z)))
_NOISY = (
    f"(SELECT vec_id, bid, list((e - lo) / (hi - lo + 1e-8) + ({normal(_SP, 'GaussianNoise:data')} * 0.01) ORDER BY pos) AS x "
    f"FROM (SELECT *, min(e) OVER w AS lo, max(e) OVER w AS hi FROM {X} WINDOW w AS ({_BY['sample']})) GROUP BY vec_id, bid)"
)
_SMOOTH = f"(SELECT vec_id, bid, list({_gauss_taps()} ORDER BY p) AS x FROM {_NOISY}, (SELECT unnest(range(64)) AS p) GROUP BY vec_id, bid)"
on_images("pipeline_classification", lambda: ops.Compose(
    ops.NormMinMax(), ops.GaussianNoise(0.0, 0.01), ops.GaussianSmoothing(1, 3, 0.5, padding=1), ops.Rot90((0, 1), prob=0.5), ops.Mirror((0, 1), prob=0.5),
    ops.BaseAffine(UniformParameter(0.8, 1.2), UniformParameter(-30, 30), UniformParameter(-0.02, 0.02), degree=True)),
    _sampled(f"cos({_R}) / {_S} AS a, sin({_R}) / {_S} AS b, {_T} AS c, -sin({_R}) / {_S} AS d, cos({_R}) / {_S} AS e2, {_T} AS f", source=_turned(_SMOOTH)))


@query("pipeline_segmentation")
def pipeline_segmentation(spark, sf_dir):
    s = batched(spark, sf_dir, VOLUME)
    s = s.with_column("label", F.transform("data", lambda e: (e > 0).cast("double")), TensorSpec(VOLUME))
    both = ("data", "label")
    s = ops.Compose(
        ops.ResizeNative((3, 5, 4), mode="trilinear"), ops.ResizeNative((3, 5, 4), keys=("label",)),
        ops.BaseAffine(UniformParameter(0.9, 1.1), UniformParameter(-10, 10), None, degree=True, keys=both), ops.NormZeroMeanUnitStd())(s)
    return long(s).withColumnRenamed("v", "data").join(long(s, "label").withColumnRenamed("v", "label"), ["vec_id", "pos"])


@query("pipeline_pretraining")
def pipeline_pretraining(spark, sf_dir):
    s = volumes(spark, sf_dir, 36)
    s = s.with_column("pristine", F.col("data"), s.spec("data"))
    s = ops.Compose(ops.Mirror((0, 1, 2), keys=("data", "pristine")), ops.RandomBezierTransform(), ops.InvertAmplitude(0.1), ops.RandomInOrOutpainting())(s)
    x = F.col("data.data") if s.specs["data"].ragged else F.col("data")
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, e: a + e), 6)
    place = lambda c: F.round(F.aggregate(F.transform(c, lambda e, i: e * (i + 1)), F.lit(0.0), lambda a, e: a + e), 4)
    return s.df.select(
        F.col("sample_id").alias("vec_id"), F.size(x).alias("n"), F.size("pristine").alias("m"), total(x).alias("total"), place(x).alias("moment"),
        total(F.col("pristine")).alias("pristine_total"), place(F.col("pristine")).alias("pristine_moment"),
    )


BENCH = ["flagship", "norm_zscore_channels", "rot90_random", "resize_bilinear", "affine_rotate_random", "gaussian_smoothing", "noise_gaussian", "dropout_compose",
         "seg_to_box", "shuffle_batches", "collate", "pipeline_classification"]
