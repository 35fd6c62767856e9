"""Quality scores from compression with good and bad dictionaries.

Two zstandard dictionaries are trained, on good and on bad labelled texts.  A
text is compressed with each; the difference of the two sizes, normalised by
the size without a dictionary, says which kind it is more like.  A logistic
model, fitted on labelled texts that the dictionaries were not trained on,
turns the difference (and how well the text compresses at all, which repetition
raises whatever the dictionary) into a calibrated probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_remainder, cut, small, table

#: Long texts are compressed in pieces of so many bytes, and sizes added up, so that all of a text meets the dictionary.
PIECE = 4096
LEVEL = 3


def pieces_of(texts: list[str | None]) -> list[bytes]:
    """The texts in pieces of PIECE bytes, short ends with the piece before them, so that none is left out."""
    out: list[bytes] = []
    for text in texts:
        data = (text or "").encode("utf-8", "surrogatepass")
        for a in range(0, len(data), PIECE):
            piece = data[a : a + PIECE]
            if len(piece) < 8 and out:
                out[-1] += b"\n" + piece
            else:
                out.append(piece)
    return out


def _params(size: int) -> zstandard.ZstdCompressionParameters:
    return zstandard.ZstdCompressionParameters.from_level(
        LEVEL, source_size=PIECE, dict_size=size, write_checksum=0, write_content_size=0, write_dict_id=0
    )


class Compressors:
    """The three compressors of a process; made once, as digesting a dictionary takes time."""

    def __init__(self, good: bytes, bad: bytes):
        self.all = [zstandard.ZstdCompressor(compression_params=_params(0))]
        for d in (good, bad):
            z = zstandard.ZstdCompressionDict(d)
            z.precompute_compress(compression_params=_params(len(d)))
            self.all.append(zstandard.ZstdCompressor(dict_data=z, compression_params=_params(len(d))))

    def features(self, text: str | None) -> list[float]:
        """Intercept, differences and ratios of compressed sizes over the whole text."""
        data = (text or "").encode("utf-8", "surrogatepass")
        sizes = np.zeros(3)
        for a in range(0, len(data), PIECE):
            piece = data[a : a + PIECE]
            sizes += [len(c.compress(piece)) for c in self.all]
        plain, good, bad = sizes
        if not plain:
            return [1.0] + [0.0] * 4
        n = len(data)
        d = (bad - good) / plain
        return [1.0, d, (bad - good) / n * 10, min(plain / n, 1.5), np.log(plain / n + 0.02)]


class Scorer:
    """Dictionaries and calibration; ``weights`` None: every text gets ``prior``."""

    def __init__(self, good: bytes, bad: bytes, weights: np.ndarray | None, prior: float):
        self.good, self.bad, self.weights, self.prior = good, bad, weights, prior

    def compressors(self) -> Compressors | None:
        return None if self.weights is None else Compressors(self.good, self.bad)

    def judge(self, text: str | None, tools: Compressors | None) -> tuple[float, float]:
        """Score and normalised difference of compressed sizes."""
        if tools is None:
            return self.prior, 0.0
        x = tools.features(text)
        return float(1 / (1 + np.exp(-np.clip(expand(np.array([x])) @ self.weights, -30, 30)))[0]), float(x[1])


def expand(x: np.ndarray) -> np.ndarray:
    """Features with squares and products, bounded."""
    y = np.clip(x, -5, 5)
    pairs = [y[:, i] * y[:, j] for i in range(1, y.shape[1]) for j in range(i, y.shape[1])]
    return np.column_stack([y, *pairs])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights by Newton's method; the ridge leaves the intercept free."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + penalty * w
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(texts: list[str], labels: np.ndarray, dict_size: int = 110_000, seed: int = 0) -> Scorer:
    """Dictionaries from half of the texts, calibration from the other half.

    A dictionary has ``dict_size`` bytes at most.  With one label only, or too
    little text for a dictionary, every text gets the share of good labels (0.5
    without labels).
    """
    if not len(labels):
        return Scorer(b"", b"", None, 0.5)
    prior = float(labels.mean())
    half = np.random.default_rng(seed).permutation(len(labels)) % 2 == 0
    dicts = []
    for kind in (1, 0):
        pieces = pieces_of([texts[i] for i in np.flatnonzero(half & (labels == kind))])
        total = sum(map(len, pieces))
        try:
            dicts.append(zstandard.train_dictionary(min(dict_size, max(256, total // 4)), pieces).as_bytes())
        except (zstandard.ZstdError, ValueError):  # too few or too small samples: they are the dictionary
            raw = b"".join(pieces)
            if not 8 <= len(raw) <= dict_size:
                return Scorer(b"", b"", None, prior)
            dicts.append(raw)
    good, bad = dicts
    tools = Compressors(good, bad)
    rest = np.flatnonzero(~half)
    x = np.array([tools.features(texts[i]) for i in rest])
    if len(set(labels[rest])) < 2:
        return Scorer(b"", b"", None, prior)
    return Scorer(good, bad, fit_logistic(expand(x), labels[rest]), prior)


def learn(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = 6000, size: int = 48 << 20
) -> Scorer:
    """Fits on about ``rows`` labelled rows at most, half of each label where there are so many, and ``size`` bytes of text.

    Rows are chosen by a hash of their id; where their texts are longer than
    ``size`` together, those first by that hash are taken, of each label half of
    the bytes.  What each label's share was taken down to is made good in the
    calibration's intercept.  Repeated labels of an id count once, different ones
    each; of an id's texts the first in order is taken.  Null labels and ids
    don't count.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)").distinct()
    counts = {r[0]: r[1] for r in known.groupBy("y").count().collect()}
    if not counts:
        return train([], np.empty(0))
    share = {y: min(1.0, rows / 2 / n) for y, n in counts.items()}
    u = F.pmod(F.xxhash64(F.lit("quality"), "id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    keep = F.lit(False)
    for y, s in share.items():
        keep = keep | ((F.col("y") == y) & (u < s))
    picked = small(cut(known.where(keep)))  # so that texts aren't shuffled for it
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    got = cut(picked.join(texts, "id").groupBy("id", "y").agg(F.min("text").alias("text")))
    sizes = got.select("id", "y", u.alias("u"), F.octet_length("text").alias("b")).toPandas().sort_values(["y", "u", "id"])
    inside = sizes[sizes.groupby("y")["b"].cumsum() <= size // 2]
    for y in counts:
        of = (sizes["y"] == y).sum()
        share[y] *= (inside["y"] == y).sum() / of if of else 1.0
    if len(inside) < len(sizes):
        last = inside.groupby("y")["u"].max()
        got = got.where(F.coalesce(F.lit(None), *[F.when((F.col("y") == int(y)) & (u <= float(v)), F.lit(True)) for y, v in last.items()], F.lit(False)))
    got = got.orderBy("id", "y").toPandas()
    scorer = train(got["text"].tolist(), got["y"].to_numpy())
    total = sum(counts.values())
    if scorer.weights is None:
        scorer.prior = counts.get(1, 0) / total
    elif len(share) == 2:
        scorer.weights[0] += np.log(share[0] / share[1])
    return scorer


def score(docs: DataFrame, scorer: Scorer, text_col: str = "text") -> DataFrame:
    """docs with quality_score and quality_difference added (replacing columns of these names).

    The difference is that of the sizes with the bad and the good dictionary,
    over the size without one.  Null texts score like empty ones.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(scorer)

    @F.pandas_udf("score double, difference double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tools = shipped.value.compressors()
        for texts in batches:
            yield pd.DataFrame([shipped.value.judge(t, tools) for t in texts], columns=["score", "difference"], dtype="float64")

    out = docs.withColumn("__q", run(F.col(text_col)))
    return out.withColumns({"quality_score": F.col("__q.score"), "quality_difference": F.col("__q.difference")}).drop("__q")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document; labels are learnt where crc32 of the id mod 5 is not 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(crc_remainder("doc_id", 5) != 0)
    out = score(docs, learn(docs, labels))
    held = F.coalesce(crc_remainder("doc_id", 5) == 0, F.lit(False))
    return out.select(
        "doc_id", held.alias("held_out"), F.col("quality_score").alias("score"),
        F.when(F.col("quality_score") >= 0.3, 1).otherwise(0).alias("predicted"), F.col("quality_difference").alias("difference"),
    )
