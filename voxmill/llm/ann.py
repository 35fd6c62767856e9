"""Approximate nearest neighbours by adaptive dimension scan.

Vectors are put in lists by their nearest centroid; a query scans the lists of
its nearest centroids.  Inner products are ranked as distances by one added
dimension that makes all vectors equally long.  In a scan, vectors are rotated
at random and laid out in column blocks.  After each block, a vector whose
partial distance, by the hypothesis test of the rotation's concentration, can't
belong to one within the best k so far is abandoned; what is left after the
last block is scored exactly on the original vectors.

Lists that are near each other make up shards, which are what tasks hold.  A
query first scans the shard of its nearest list; the k-th product found there is
its threshold in the other shards, so these hand back little.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, small, table

#: Vectors of a shard and queries of a block at most (on average); with few of them, a quarter of all, for the sake of parallel tasks.
SHARD_VECTORS, BLOCK_QUERIES = 131_072, 32_768
#: Vectors of a list, and queries, that are compared in one step.
STEP_VECTORS, STEP_QUERIES = 8192, 1024
#: Share of the true neighbours that the probed lists are to hold.
RECALL = 0.95


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): rows with an id whose vector is not null, not zero and all finite."""
    v = F.col("v")
    kind = vectors.schema[vector_col].dataType
    plain = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.FloatType, T.DoubleType))
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.select(F.col(id_col).alias("id"), (F.col(vector_col) if plain else F.col(vector_col).cast("array<double>")).alias("v")).where(
        F.col("id").isNotNull() & v.isNotNull() & ok & F.exists(v, lambda x: x != 0)
    )


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


class Lists:
    """Centroids, the rotation and the added dimension of an index."""

    def __init__(self, sample: np.ndarray, lists: int, longest: float, seed: int = 7, rounds: int = 8):
        rng = np.random.default_rng(seed)
        self.longest, dim = longest, sample.shape[1] + 1
        x = self.extend(sample)
        centres = x[rng.choice(len(x), lists, replace=False)]
        for _ in range(rounds if lists > 1 else 1):
            near = self._nearest(x, centres)
            count = np.bincount(near, minlength=lists)
            sums = np.stack([np.bincount(near, x[:, j], lists) for j in range(dim)], axis=1)
            full = count > 0
            centres = centres.copy()
            centres[full] = sums[full] / count[full, None]
            centres[~full] = x[rng.choice(len(x), int((~full).sum()))]
        self.centres = centres
        self.rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]

    def extend(self, x: np.ndarray) -> np.ndarray:
        """Adds the dimension that makes every vector ``longest`` long."""
        rest = np.sqrt(np.maximum(self.longest**2 - np.einsum("ij,ij->i", x, x), 0))
        return np.hstack([x, rest[:, None]])

    @staticmethod
    def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
        """Squared distances to the centres, less what is the same for all centres."""
        return np.einsum("ij,ij->i", centres, centres)[None, :] - 2 * x @ centres.T

    @classmethod
    def _nearest(cls, x: np.ndarray, centres: np.ndarray) -> np.ndarray:
        steps = [cls._squares(x[a : a + 4096], centres).argmin(axis=1) for a in range(0, len(x), 4096)]
        return np.concatenate(steps) if steps else np.empty(0, np.int64)

    def of_vectors(self, x: np.ndarray) -> np.ndarray:
        return self._nearest(self.extend(x), self.centres)

    def to_lists(self, q: np.ndarray, lists: np.ndarray | None = None) -> np.ndarray:
        """Of each query, how far each list (of those given) is; queries have 0 in the added dimension."""
        return self._squares(np.hstack([q, np.zeros((len(q), 1))]), self.centres if lists is None else self.centres[lists])


def probe_share(index: Lists, sample: np.ndarray, k: int, recall: float, asked: int = 256) -> float:
    """The share of lists, nearest first, that hold ``recall`` of the k nearest in the sample of some of its vectors."""
    q = sample[np.random.default_rng(3).choice(len(sample), min(asked, len(sample)), replace=False)]
    score = q @ sample.T
    top = np.argpartition(-score, min(k, len(sample) - 1), axis=1)[:, : k + 1]  # one of them may be itself
    of = index.of_vectors(sample)
    far = index.to_lists(q)
    rank = np.empty(far.shape, np.int64)
    np.put_along_axis(rank, np.argsort(far, axis=1, kind="stable"), np.arange(far.shape[1])[None, :], axis=1)
    ranks = np.sort(np.take_along_axis(rank, of[top], axis=1).ravel())
    return float((ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))))] + 1) / far.shape[1])


def shards_of(centres: np.ndarray, sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each list its first shard and the number of shards it takes.

    Lists are halved along the direction in which their centroids differ most
    until a shard has ``most`` vectors or fewer; a larger list is cut by itself.
    """
    first, pieces = np.zeros(len(sizes), np.int64), np.maximum(1, -(-sizes // most))
    todo, n = [np.arange(len(sizes))], 0
    while todo:
        part = todo.pop()
        if len(part) == 1 or sizes[part].sum() <= most:
            first[part] = n
            n += int(pieces[part].max())
            continue
        c = centres[part] - centres[part].mean(axis=0)
        along = c @ np.linalg.svd(c, full_matrices=False)[2][0]
        part = part[np.argsort(along, kind="stable")]
        total = np.cumsum(sizes[part])
        middle = int(np.clip(np.searchsorted(total, total[-1] / 2) + 1, 1, len(part) - 1))
        todo += [part[middle:], part[:middle]]
    return first, pieces


def scan(
    ids: np.ndarray, x: np.ndarray, lists: np.ndarray, q_ids: np.ndarray, q: np.ndarray, reach: np.ndarray, floor: np.ndarray,
    index: Lists, k: int, width: int = 13, eps: float = 2.1,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best k of a shard's vectors for each query, as (place of the query, id, score).

    A query scans the lists that are no further than its ``reach``; what scores
    below ``floor`` (-inf for none) isn't wanted.  Of the rows that are equal to
    the query in id and vector one is left out, as its own.

    A query without a floor gets a threshold from its nearest lists first.  Then,
    list by list, column blocks of ``width`` rotated dimensions are added up: for
    all pairs while most are in the race, and for the pairs left once few are.
    """
    order = np.argsort(lists, kind="stable")
    ids, x, lists = ids[order], x[order], lists[order]
    here, starts = np.unique(lists, return_index=True)
    bounds = np.append(starts, len(lists))
    sizes = np.diff(bounds)
    r = index.extend(x) @ index.rotation
    dim = r.shape[1]
    cuts = [(a, min(a + width, dim)) for a in range(0, dim, width)]
    columns = [np.ascontiguousarray(r[:, a:b]) for a, b in cuts]
    norms = [np.einsum("ij,ij->i", c, c) for c in columns]
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for start in range(0, len(q), STEP_QUERIES):
        end = min(start + STEP_QUERIES, len(q))
        qi, qid = q[start:end], q_ids[start:end]
        rq = np.hstack([qi, np.zeros((len(qi), 1))]) @ index.rotation
        length = np.einsum("ij,ij->i", qi, qi)
        slack = 1e-11 * (index.longest**2 + length)  # rounding grows with the vectors, not with their distance
        low = floor[start:end].copy()
        own_left = np.ones(len(qi), bool)
        held = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        fresh: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        waiting = 0

        def settle() -> None:
            """Each query's best k so far, in order, and its threshold."""
            nonlocal held, fresh, waiting
            a, b, score = (np.concatenate(z) for z in zip(held, *fresh))
            by = np.lexsort((ids[b], -score, a))
            a, b, score = a[by], b[by], score[by]
            rank = np.arange(len(a)) - np.searchsorted(a, a)
            full = rank == k - 1
            low[a[full]] = np.maximum(low[a[full]], score[full])
            best = rank < k
            held, fresh, waiting = [a[best], b[best], score[best]], [], 0

        def take(a: np.ndarray, b: np.ndarray) -> None:
            nonlocal waiting
            for s in range(0, len(a), 1 << 18):
                aa, bb = a[s : s + (1 << 18)], b[s : s + (1 << 18)]
                mine = np.flatnonzero((ids[bb] == qid[aa]) & own_left[aa])
                if len(mine):
                    mine = mine[(x[bb[mine]] == qi[aa[mine]]).all(axis=1)]
                    _, once = np.unique(aa[mine], return_index=True)
                    own_left[aa[mine[once]]] = False
                    keep = np.ones(len(aa), bool)
                    keep[mine[once]] = False
                    aa, bb = aa[keep], bb[keep]
                score = (x[bb] * qi[aa]).sum(axis=1)
                good = score >= low[aa]
                fresh.append((aa[good], bb[good], score[good]))
                waiting += int(good.sum())
                if waiting > 1 << 20:
                    settle()

        far = index.to_lists(qi, here)
        probed = far <= reach[start:end, None]
        near = np.argsort(np.where(probed, far, np.inf), axis=1, kind="stable")
        before = np.cumsum(sizes[near], axis=1) - sizes[near]
        seed = np.zeros_like(probed)
        np.put_along_axis(seed, near, before < max(4 * k, 64), axis=1)
        seed &= probed & np.isneginf(low)[:, None]
        for n in range(len(here)):
            asks = np.flatnonzero(seed[:, n])
            for v in range(bounds[n], bounds[n + 1], STEP_VECTORS) if len(asks) else ():
                w = min(v + STEP_VECTORS, bounds[n + 1])
                take(np.repeat(asks, w - v), np.tile(np.arange(v, w), len(asks)))
        settle()
        rest = probed & ~seed
        for n in np.argsort(np.where(rest, far, np.inf).min(axis=0), kind="stable").tolist() if len(qi) else []:
            asks = np.flatnonzero(rest[:, n])
            if not len(asks):
                continue
            limit = np.where(np.isneginf(low[asks]), np.inf, np.maximum(index.longest**2 + length[asks] - 2 * low[asks], 0))
            for v in range(bounds[n], bounds[n + 1], STEP_VECTORS):
                w = min(v + STEP_VECTORS, bounds[n + 1])
                part, pairs = np.zeros((len(asks), w - v)), None
                for (lo, hi), block, norm in zip(cuts, columns, norms):
                    mine = rq[asks, lo:hi]
                    bound = limit * ((1 + eps / np.sqrt(hi)) ** 2 * hi / dim if hi < dim else 1) + slack[asks]
                    if pairs is None:
                        part += norm[None, v:w] + np.einsum("ij,ij->i", mine, mine)[:, None] - 2 * mine @ block[v:w].T
                        alive = part <= bound[:, None]
                        if hi == dim or np.count_nonzero(alive) < 0.4 * alive.size:
                            pairs = np.nonzero(alive)
                            part = part[pairs]
                    else:
                        diff = block[pairs[1] + v] - mine[pairs[0]]
                        part = part + np.einsum("ij,ij->i", diff, diff)
                        keep = part <= bound[pairs[0]]
                        pairs, part = (pairs[0][keep], pairs[1][keep]), part[keep]
                    if pairs is not None and not len(part):
                        break
                take(asks[pairs[0]], pairs[1] + v)
            if waiting > 4 * k * len(qi):
                settle()
        settle()
        out.append((held[0] + start, ids[held[1]], held[2]))
    return tuple(np.concatenate(z) for z in zip(*out))


def search(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    probe: float | None = None,
    recall: float = RECALL,
    sample_rows: int = 65_536,
    most_lists: int = 4096,
    shard_vectors: int | None = None,
    block_queries: int | None = None,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products found for each query row.

    The index is fitted on at most about ``sample_rows`` vectors, chosen by a
    hash of the id, and holds all: three times the square root of their number
    of lists, of 40 vectors or more on average, and ``most_lists`` at most, beyond which
    lists get longer.  A query
    probes the share ``probe`` of the lists, by default the share that holds
    ``recall`` of the neighbours within the sample, and further ones until these
    hold more than k other vectors.  Rows that ``usable`` leaves out take no
    part; vectors whose length isn't the most frequent one can't be compared and
    take none either.  Repeated ids are candidates each, and query rows each: of
    the candidates equal to a query in id and vector one is left out as its own
    row.  Ties go to the smaller id.  No vectors: no rows.
    """
    spark = vectors.sparkSession
    v = usable(vectors, id_col, vector_col)
    facts = v.groupBy(F.size("v").alias("dim")).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))).alias("sq")
    )
    facts = facts.orderBy(F.desc("n"), "dim").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not facts:
        return spark.createDataFrame([], schema)
    dim, n, longest = facts[0]["dim"], facts[0]["n"], float(np.sqrt(facts[0]["sq"]))
    v = v.where(F.size("v") == dim)
    lists = int(max(1, min(most_lists, round(3 * n**0.5), n // 40)))
    rows = min(sample_rows, max(4096, 24 * lists))
    u = F.pmod(F.xxhash64(F.lit("ann"), "id"), F.lit(1 << 30))
    drawn = v.where(u < int(min(1.0, rows / n) * (1 << 30))).orderBy(u, "id").limit(2 * rows).select("v").toPandas()
    if not len(drawn):
        drawn = v.limit(1).select("v").toPandas()
    sample = _matrix(drawn["v"])
    lists = min(lists, max(1, len(sample) // 4))
    index = Lists(sample, lists, longest)
    share = probe_share(index, sample, k, recall) if probe is None else probe
    shipped = spark.sparkContext.broadcast(index)

    @F.pandas_udf("int")
    def assign(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(shipped.value.of_vectors(_matrix(s)) if len(s) else [], dtype="int32")

    held = cut(v.withColumn("list", assign("v")))
    sizes = np.zeros(lists, np.int64)
    for row in held.groupBy("list").count().collect():  # one row per list, and lists are bounded
        sizes[row[0]] = row[1]
    most = shard_vectors or int(np.clip(-(-n // 4), 8192, SHARD_VECTORS))
    first, pieces = shards_of(index.centres, sizes, most)
    probes = max(1, int(np.ceil(lists * share)))

    @F.pandas_udf("reach double, home int, shards array<int>")
    def probed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            out = []
            for q in np.array_split(_matrix(s), -(-len(s) // STEP_QUERIES)) if len(s) else []:
                far = shipped.value.to_lists(q)
                order = np.argsort(far, axis=1, kind="stable")
                enough = np.cumsum(sizes[order], axis=1) > k + 1
                need = np.where(enough.any(axis=1), enough.argmax(axis=1) + 1, lists)
                for row, o, m in zip(far, order, np.maximum(need, probes)):
                    o = o[:m]
                    at = np.unique(np.concatenate([first[o], *(np.arange(first[i], first[i] + pieces[i]) for i in o[pieces[o] > 1])]))
                    home = first[o[np.argmax(sizes[o] > 0)]]
                    out.append((row[o[-1]] + 1e-12 * shipped.value.longest**2, int(home), at[at != home].tolist()))
            yield pd.DataFrame(out, columns=["reach", "home", "shards"])

    # a number for each row of a query, kept with it
    asked = usable(queries, id_col, vector_col).where(F.size("v") == dim).withColumn("p", probed("v"))
    asked = cut(asked.select(F.monotonically_increasing_id().alias("row"), F.col("id").alias("qid"), F.col("v").alias("qv"), "p.*"))
    n_asked = asked.count()
    block = block_queries or int(np.clip(-(-n_asked // 4), 512, BLOCK_QUERIES))
    places = spark.createDataFrame(pd.DataFrame({"list": np.arange(lists, dtype=np.int32), "first": first, "pieces": pieces}))
    kept = held.join(F.broadcast(places), "list").select(  # one row per list
        "list", "id", "v", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("pieces"))).cast("int").alias("shard")
    )

    def work(key: tuple, mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        if not len(mine) or not len(theirs):
            return pd.DataFrame({"row": [], "query_id": [], "vec_id": [], "score": []})
        a, b, c = scan(
            mine["id"].to_numpy(), _matrix(mine["v"]), mine["list"].to_numpy(), theirs["qid"].to_numpy(), _matrix(theirs["qv"]),
            theirs["reach"].to_numpy(np.float64), theirs["floor"].to_numpy(np.float64), shipped.value, k,
        )
        return pd.DataFrame({"row": theirs["row"].to_numpy()[a], "query_id": theirs["qid"].to_numpy()[a], "vec_id": b, "score": c})

    def scanned(at: DataFrame) -> DataFrame:
        sets = small(at.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("sets")))
        left = kept.join(sets, "shard").withColumn("set", F.explode(F.sequence(F.lit(0), F.col("sets") - 1))).drop("sets")
        right = at.join(sets, "shard").withColumn("set", F.pmod(F.xxhash64("row"), F.col("sets")).cast("int")).drop("sets")
        keys = ["shard", "set"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(work, "row long, query_id long, vec_id long, score double")

    none = F.lit(float("-inf"))
    columns = ["row", "qid", "qv", "reach"]
    near = cut(scanned(asked.select(*columns, none.alias("floor"), F.col("home").alias("shard"))))
    floors = near.groupBy("row").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(none).alias("floor"))
    others = asked.where(F.size("shards") > 0).join(floors, "row", "left")
    others = others.select(*columns, F.coalesce("floor", none).alias("floor"), F.explode("shards").alias("shard"))
    found = near.unionByName(scanned(others)) if first.max() > 0 or pieces.max() > 1 else near
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of each vector whose id is divisible by 20."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(v, v.where(F.col("vec_id") % 20 == 0))
