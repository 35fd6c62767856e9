"""SimHash near-duplicates found by covering locality-sensitive hashing.

A random map gives each of the 64 bit positions a vector of radius + 1 bits.
For every non-zero vector v of that length there is one table, whose mask
holds the positions whose vector has an odd inner product with v.  Positions
where two fingerprints within the radius differ span too few dimensions to
meet every v, so some mask avoids all of them: each pair within the radius
agrees on all of some mask.  There are no false negatives.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, join_hot, table

BITS = 64
#: Distinct fingerprints compared with each other in one piece of work.
BLOCK = 4096

_BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.int64)


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """SimHash of the text's word shingles, repeats included.

    A-Z are lower-cased, words are runs of other than ASCII white space.  Fewer
    words than ``width``: the whole sequence is the shingle.  None: 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    k = min(width, len(words))
    starts = np.concatenate(([0], ends[: len(words) - k] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    n = len(starts)
    h = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends[k - 1 :].tolist())), np.uint64, n)
    out = 0
    planes = h.astype("<u8").view(np.uint8).reshape(n, 8)
    for i in range(8):
        ones = np.bincount(planes[:, i], minlength=256) @ _BYTE_BITS
        for b in np.flatnonzero(2 * ones > n).tolist():
            out |= 1 << (8 * i + b)
    return out


def covering_masks(radius: int, bits: int = BITS, seed: int = 1) -> list[int]:
    """2**(radius + 1) - 1 masks; any ``radius`` positions are avoided by one of them."""
    rng = random.Random(seed)
    size = 1 << (radius + 1)
    vectors = [1 + i % (size - 1) for i in range(bits)]  # as even as can be, none zero
    rng.shuffle(vectors)
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() & 1) for v in range(1, size)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(fps: np.ndarray, ids: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that join what is linked in the group; at most one fewer than its members.

    Grows each component breadth-first against the members not yet reached, so
    nothing quadratic is held.
    """
    left, out = np.arange(len(fps)), []
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            new = []
            for i in front.tolist():
                near = np.bitwise_count(fps[left] ^ fps[i]) <= radius
                if near.any():
                    hit = left[near]
                    out += [(int(ids[i]), int(ids[j])) for j in hit.tolist()]
                    new.append(hit)
                    left = left[~near]
                    if not len(left):
                        break
            front = np.concatenate(new) if new else left[:0]
    return out


def near_links(nodes: DataFrame, radius: int = 3, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between nodes (node, fp), fp distinct: enough to connect all within the radius.

    Every bucket of more than ``block`` members is cut into blocks by hash, and
    each pair of its blocks is compared on its own, so work in a task is bounded
    and no pair is missed.
    """
    masks = F.array(*[F.lit(_signed(m)) for m in covering_masks(radius)])
    keyed = nodes.select("node", "fp", F.posexplode(masks).alias("t", "m")).select(
        "node", "fp", "t", F.col("fp").bitwiseAND(F.col("m")).alias("key")
    )
    sizes = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    held = keyed.join(sizes, ["t", "key"]).withColumn("k", F.ceil(F.col("n") / block).cast("int"))
    held = held.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("k")).cast("int"))
    pieces = held.select(
        "t", "key", "node", "fp", "k", "own", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other")
    ).where("own != other or k = 1").select(
        "t", "key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "node", "fp"
    )
    names = ["t", "key", "p", "q"]
    pieces = pieces.repartition(*names).sortWithinPartitions(*names)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pd.DataFrame | None = None

        def links(df: pd.DataFrame) -> list[tuple[int, int]]:
            keys = df[names].to_numpy()
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            bounds = np.concatenate(([0], cuts, [len(df)]))
            fps = df["fp"].to_numpy(np.int64).view(np.uint64)
            ids, out = df["node"].to_numpy(np.int64), []
            two = np.diff(bounds) == 2
            i = bounds[:-1][two]  # most groups are pairs
            near = np.bitwise_count(fps[i] ^ fps[i + 1]) <= radius
            out += list(zip(ids[i[near]].tolist(), ids[i[near] + 1].tolist()))
            for a, b in zip(bounds[:-1][~two].tolist(), bounds[1:][~two].tolist()):
                out += _forest(fps[a:b], ids[a:b], radius)
            return out

        def emit(out: list[tuple[int, int]]) -> pa.RecordBatch:
            pairs = np.array(out, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs.min(axis=1)), pa.array(pairs.max(axis=1))], names=["a", "b"])

        for batch in batches:
            df = batch.to_pandas()
            df = df if rest is None else pd.concat([rest, df], ignore_index=True)
            if not len(df):
                continue
            last = (df[names].to_numpy() == df[names].iloc[-1].to_numpy()).all(axis=1)
            start = int(np.argmax(last))  # the last group may go on in the next batch
            rest, done = df.iloc[start:], df.iloc[:start]
            if len(done) and (out := links(done)):
                yield emit(out)
        if rest is not None and (out := links(rest)):
            yield emit(out)

    return pieces.mapInArrow(compare, "a long, b long").distinct()


def fingerprints(docs: DataFrame, text_col: str = "text", width: int = 3) -> DataFrame:
    """docs with column ``fp`` added: the fingerprint as a signed long."""

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        h = np.fromiter((fingerprint(t, width) for t in texts), np.uint64, len(texts))
        return pd.Series(h.view(np.int64))

    return docs.withColumn("fp", fp(F.col(text_col)))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3) -> DataFrame:
    """Per row: id, ``fp`` and ``component_id``, the least id that links reach.

    Equal fingerprints are one class, named by its least id, before anything is
    compared; only classes that have a link take part in the rounds for
    components.  Rows of a class with a large share of all rows aren't shuffled.  Null and blank texts have fingerprint 0 and link like any
    other.  Rows with a null id keep null, and name no component; a class of
    such rows alone has a null component.  Repeated rows each give a row.
    """
    rows = cut(fingerprints(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text").select("id", "fp"))
    share = (F.count(F.lit(1)) / F.lit(max(rows.count(), 1))).alias("share")
    nodes = cut(rows.groupBy("fp").agg(F.min("id").alias("node"), share))
    usable = nodes.where("node is not null").select("fp", "node")
    # an id that repeats with other texts links their classes
    repeated = rows.where("id is not null").groupBy("id").agg(F.min("fp").alias("x"), F.max("fp").alias("y"))
    repeated = repeated.where("x != y").select("id")
    twins = rows.join(repeated, "id", "left_semi").join(usable, "fp").where("id != node")
    twins = twins.select(F.col("id").alias("a"), F.col("node").alias("b"))
    comp = components(near_links(usable, radius).unionByName(twins))
    roots = cut(nodes.join(comp, "node", "left").select("fp", "share", F.coalesce("root", "node").alias("component_id")))
    return join_hot(rows, roots, "fp", "share").select("id", "fp", "component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the component's id.

    Rows that repeat that id: one of them.  Rows with a null id all stay.
    """
    comp = near_duplicates(docs)
    keep = comp.where("id = component_id").select(F.col("id").alias("__keep")).distinct()
    columns = docs.columns
    named = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    key = f"c{columns.index('doc_id')}"
    kept = named.join(keep, F.col(key) == F.col("__keep"), "left_semi")
    again = comp.where("id is not null").groupBy("id").count().where("count > 1")
    again = again.select(F.col("id").alias("__again"))
    single = kept.join(again, F.col(key) == F.col("__again"), "left_anti")
    several = kept.join(again, F.col(key) == F.col("__again"), "left_semi").dropDuplicates([key])
    out = single.unionByName(several).unionByName(named.where(F.col(key).isNull()))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])
