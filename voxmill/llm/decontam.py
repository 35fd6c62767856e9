"""Benchmark decontamination by size-partitioned MinHash containment search.

Items and documents become sets of five-word shingles.  An item of n shingles
counts as leaked into a document that holds at least the share t of them, so
the document may lack no more than floor((1 - t) n).  Items are partitioned by
n; the sketch of an item in partition n is its floor((1 - t) n) + 1 shingles of
least hash (a bottom-k MinHash).  A document that holds none of the sketch
lacks too many; so probing the document shingles with the sketches finds every
leak, however long the document is, and what it finds is verified by counting
exact shingles.

Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, fits, small, table

WIDTH = 5
#: What separates words, beside letters, digits and marks.
_SEPARATOR = r"[^\p{L}\p{N}\p{M}]+"
_WORD = r"[\p{L}\p{N}\p{M}]"


def words(text: Column) -> Column:
    """Lower-cased words: runs of letters, marks and digits."""
    return F.filter(F.split(F.lower(text), _SEPARATOR), lambda w: w != "")


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once for all its uses inside lambdas."""
    return F.transform(F.array(value), use)[0]


def shingles(words: Column, width: int = WIDTH) -> Column:
    """All shingles of an array of words; fewer words than ``width``: the whole sequence, if any."""
    return _bound(
        words,
        lambda w: F.transform(
            F.sequence(F.lit(1), F.greatest(F.size(w) - (width - 1), F.lit(1))),
            lambda i: F.concat_ws(" ", F.slice(w, i, F.lit(width))),
        ),
    )


def _hashes(words: Column, width: int = WIDTH) -> Column:
    """xxhash64 of the words of each shingle, in the same order as ``shingles``."""
    return _bound(
        words,
        lambda w: F.transform(
            F.sequence(F.lit(0), F.greatest(F.size(w) - width, F.lit(0))),
            lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(width)]),
        ),
    )


def maybe(probe: DataFrame, wanted: DataFrame, buckets: int = 1 << 17) -> DataFrame:
    """The rows of probe whose ``h`` may be in ``wanted``: all that are, and few others.

    A filter of 64 bits for each of ``buckets`` keys, so of bounded size.  It
    keeps what isn't wanted out of the shuffle; hot shingles with it.
    """
    bucket = lambda h: F.pmod(h, F.lit(buckets)).cast("int")
    bit = lambda: F.expr("shiftleft(1L, cast(pmod(shiftright(h, 24), 64) as int))")
    bits = wanted.select(bucket(F.col("h")).alias("k"), bit().alias("b")).groupBy("k").agg(F.bit_or("b").alias("bits"))
    keyed = probe.withColumn("k", bucket(F.col("h"))).join(F.broadcast(bits), "k")
    return keyed.where(F.col("bits").bitwiseAND(bit()) != 0).select(*probe.columns)


def contained(
    docs: DataFrame,
    items: DataFrame,
    threshold: float = 0.8,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(id, item_id, shared, of, containment) of every leak at ``threshold`` or more.

    Null or wordless texts hold and match nothing.  Texts of fewer than five
    words are one shingle, which matches such texts only.  Repeated items or
    documents of one id are taken together: the union of their shingles.  Rows
    with a null id are left out.
    """
    i = items.select(F.col(item_col).alias("item_id"), words(F.col(item_text_col)).alias("w")).where("item_id is not null")
    i = i.where(F.size("w") > 0).select("item_id", F.explode(F.arrays_zip(shingles(F.col("w")).alias("s"), _hashes(F.col("w")).alias("h"))).alias("z"))
    i = cut(i.select("item_id", F.col("z.s").alias("s"), F.col("z.h").alias("h")).distinct())
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy("h", "s"))
    sizes = i.groupBy("item_id").agg(F.count(F.lit(1)).alias("of"))
    # one more than may be missing; 1e-9 against the error of 1 - threshold
    depth = F.floor(F.col("of") * (1.0 - threshold) + 1e-9) + 1
    sketch = i.withColumn("r", rank).join(sizes, "item_id").where(F.col("r") <= depth).select("item_id", "h")

    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    d = d.where(F.col("id").isNotNull() & F.col("text").rlike(_WORD))
    probe = d.select("id", F.explode(_hashes(words(F.col("text")))).alias("h"))
    sketch = cut(sketch)
    keys = sketch.select("h").distinct()
    hit = probe.join(F.broadcast(keys), "h", "left_semi") if fits(keys) else maybe(probe, keys).join(keys, "h", "left_semi")
    hit = hit.distinct()
    found = cut(hit.join(small(sketch), "h").select("id", "item_id").distinct())

    texts = d.join(small(found.select("id").distinct()), "id", "left_semi")
    held = texts.select("id", F.explode(F.array_distinct(shingles(words(F.col("text"))))).alias("s"))
    held = held.join(small(i.select("s").distinct()), "s", "left_semi").distinct()  # only documents that hold a sketch
    wanted = found.join(small(i.select("item_id", "s")), "item_id")
    shared = held.join(wanted, ["id", "s"]).groupBy("id", "item_id").agg(F.count(F.lit(1)).alias("shared"))
    out = shared.join(small(sizes), "item_id").where(F.col("shared") >= F.col("of") * threshold - 1e-9)
    return out.select("id", "item_id", "shared", "of", (F.col("shared") / F.col("of")).alias("containment"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item of which the document holds four fifths or more."""
    out = contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        F.col("id").alias("doc_id"), "item_id", "shared", F.col("of").alias("item_shingles"), F.round("containment", 6).alias("containment")
    )


_SQL_SHINGLES = r"""
    SELECT id, CASE WHEN len(w) = 0 THEN [] ELSE
        list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')) END AS s
    FROM (SELECT {id} AS id, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}\p{{M}}]+'), lambda x: x <> '') AS w
          FROM {table} WHERE text IS NOT NULL AND {id} IS NOT NULL)
"""

OP2_SQL = f"""
WITH i AS (SELECT DISTINCT id AS item_id, unnest(s) AS s FROM ({_SQL_SHINGLES.format(id='item_id', table='benchmark')})),
n AS (SELECT item_id, count(*) AS item_shingles FROM i GROUP BY item_id),
d AS (SELECT DISTINCT id AS doc_id, unnest(s) AS s FROM ({_SQL_SHINGLES.format(id='doc_id', table='documents')})),
j AS (SELECT doc_id, item_id, count(*) AS shared FROM d JOIN i USING (s) GROUP BY ALL)
SELECT doc_id, item_id, shared, item_shingles, round(shared / item_shingles, 6) AS containment
FROM j JOIN n USING (item_id) WHERE shared >= item_shingles * 0.8 - 1e-9
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; rows with a null id stay."""
    leaks = contained(docs, table(spark, sf_dir, "benchmark")).select(F.col("id").alias("__leak")).distinct()
    columns = docs.columns
    named = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    out = named.join(small(leaks), F.col(f"c{columns.index('doc_id')}") == F.col("__leak"), "left_anti")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])
