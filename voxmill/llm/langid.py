"""Language identification with language-bitmask n-gram filters.

One Bloom filter per language, stored bit-sliced: row r of the table is a
bitmask of the languages whose filter has bit r.  ANDing the rows that an
n-gram hashes to gives all languages that contain it, in one look-up for any
number of languages.  Per language, the n-grams of a text that carry its bit
are counted; the share expected from the filter's false positives is taken
out, and the largest corrected share decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc_remainder, table

UND = "und"
#: Standard errors by which a small share must exceed what false positives leave.
NOISE = 4.0
_B = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)


def letter_table() -> np.ndarray:
    """For every code point: whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _symbols(text: str, letters: np.ndarray) -> np.ndarray:
    """Code points of the lower-cased text, each run of other than letters one space, padded."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    ok = letters[points]
    if not ok.any():
        return np.empty(0, np.uint64)
    keep = ok.copy()
    keep[1:] |= ok[:-1]  # the first of each run after a letter stays, as the space
    kept, is_letter = points[keep].astype(np.uint64), ok[keep]
    kept[~is_letter] = 32
    space = np.array([32], np.uint64)
    return np.concatenate([space, kept, space[: int(is_letter[-1])]])


def gram_hashes(text: str | None, orders: tuple[int, ...], letters: np.ndarray) -> np.ndarray:
    """64-bit hashes of all n-grams of the text, repeats included."""
    s = _symbols(text or "", letters)
    out = []
    for n in orders:
        if len(s) < n:
            continue
        h = np.full(len(s) - n + 1, n, np.uint64)
        for i in range(n):
            h = h * _B + s[i : len(s) - n + 1 + i]
        h ^= h >> np.uint64(30)
        h *= _M1
        h ^= h >> np.uint64(27)
        h *= _M2
        h ^= h >> np.uint64(31)
        out.append(h)
    return np.concatenate(out) if out else np.empty(0, np.uint64)


class LanguageFilters:
    """The bit-sliced filters: ``words`` tables of up to 64 languages each."""

    def __init__(self, grams: dict[str, np.ndarray], orders: tuple[int, ...], bits: int, hashes: int):
        self.langs, self.orders, self.hashes = sorted(grams), orders, hashes
        self.mask = np.uint64((1 << bits) - 1)
        n = len(self.langs)
        kind = next((k for k, w in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32)) if n <= w), np.uint64)
        self.width = np.dtype(kind).itemsize * 8
        self.tables = [np.zeros(1 << bits, kind) for _ in range(-(-n // self.width))]
        fill = []
        for i, lang in enumerate(self.langs):
            t, bit = self.tables[i // self.width], kind(1 << (i % self.width))
            for row in self._rows(grams[lang]):
                t[row] |= bit
            fill.append(np.count_nonzero(t & bit) / t.size)
        self.false = np.array(fill) ** hashes

    def _rows(self, h: np.ndarray) -> Iterator[np.ndarray]:
        step = (h >> np.uint64(32)) | np.uint64(1)
        for k in range(self.hashes):
            yield ((h + np.uint64(k) * step) & self.mask).astype(np.int64)

    def shares(self, text: str | None, letters: np.ndarray) -> np.ndarray | None:
        """Per language, the corrected share of the text's n-grams; None without a letter."""
        h = gram_hashes(text, self.orders, letters)
        if not len(h):
            return None
        rows, counts = list(self._rows(h)), []
        for w, t in enumerate(self.tables):
            m = t[rows[0]]
            for r in rows[1:]:
                m = m & t[r]
            here = min(self.width, len(self.langs) - w * self.width)
            if self.width == 8:  # a histogram of masks, then each bit's sum
                hist = np.bincount(m, minlength=256)
                counts += [int(hist[(np.arange(256) >> b) & 1 == 1].sum()) for b in range(here)]
            else:
                counts += [int(np.count_nonzero(m & t.dtype.type(1 << b))) for b in range(here)]
        share = np.array(counts) / len(h)
        return np.clip((share - self.false) / np.maximum(1 - self.false, 1e-9), 0, 1)

    def predict(self, text: str | None, letters: np.ndarray) -> tuple[str, float, float, bool]:
        """(language, score, corrected share of that language, whether that is more than false positives explain)."""
        if not self.langs:
            return UND, 0.0, 0.0, False
        s = self.shares(text, letters)
        if s is None:
            return UND, 0.0, 0.0, False
        best = int(np.argmax(s))  # ties: the first in alphabetical order
        total, share, false = float(s.sum()), float(s[best]), self.false[best]
        n = len(gram_hashes(text, self.orders, letters)) if 0 < share < 0.1 else 1  # a larger share needs no test
        known = share > (NOISE * float(np.sqrt(false * (1 - false) / n)) if share < 0.1 else 0)
        return self.langs[best], (share / total if total else 0.0), share, known


def learn(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    id_col: str = "doc_id",
    docs_per_lang: int = 1500,
    orders: tuple[int, ...] = (3, 5),
    rate: float = 0.1,
    rows_per_gram: int = 16,
    hashes: int = 3,
) -> LanguageFilters:
    """Fit the filters on rows with a language and a text.

    Only a sample is read in full: of each language, rows whose id hashes below
    a threshold that leaves ``docs_per_lang`` rows on average.  n-grams are
    counted once per document, within tasks first.  Every n-gram enters the
    filters of the languages in which the share of documents that hold it is at
    least ``rate`` times its largest; so those of a passage in another language
    enter only that language's.  The filters' rows grow with the n-grams, of
    which the sample bounds the number, and the driver takes hashes alone.
    """
    known = docs.where(F.col(lang_col).isNotNull())
    counts = {r[0]: r[1] for r in known.groupBy(lang_col).count().collect()}
    if not counts:
        return LanguageFilters({}, orders, 3, hashes)
    below = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, docs_per_lang / n))])
    u = F.pmod(F.xxhash64(F.lit("langid"), F.col(id_col)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = known.where(u < below[F.col(lang_col)]).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text")
    )

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letters = letter_table()
        for pdf in batches:
            for lang, group in pdf.groupby("lang"):
                hs = [np.unique(gram_hashes(t, orders, letters)) for t in group["text"]]
                h, n = np.unique(np.concatenate(hs), return_counts=True)
                yield pd.DataFrame({"lang": lang, "h": h.view(np.int64), "n": n})

    drawn = {r[0]: r[1] for r in sample.groupBy("lang").count().collect()}
    if not drawn:
        return LanguageFilters({}, orders, 3, hashes)
    of = F.create_map(*[F.lit(x) for k, n in drawn.items() for x in (k, float(n))])
    per = sample.mapInPandas(count, "lang string, h long, n long")
    total = per.groupBy("lang", "h").agg((F.sum("n") / of[F.col("lang")]).alias("r"))
    most = F.max("r").over(Window.partitionBy("h"))  # a row for each language
    got = total.withColumn("most", most).where(F.col("r") >= F.col("most") * rate).select("lang", "h").toPandas()
    grams = {lang: g["h"].to_numpy(np.int64).view(np.uint64) for lang, g in got.groupby("lang")}
    largest = max(map(len, grams.values()), default=1)
    return LanguageFilters(grams, orders, max(10, (largest * rows_per_gram - 1).bit_length()), hashes)


def identify(docs: DataFrame, model: LanguageFilters, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, lang_score, lang_share and lang_known added (replacing columns of these names).

    Null texts and texts without a letter: ``und``, 0, 0, false.  Every text is
    read whole; each row depends on its text alone.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, lang_score double, lang_share double, lang_known boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        letters, m = letter_table(), shipped.value
        for texts in batches:
            rows = [m.predict(t, letters) for t in texts]
            yield pd.DataFrame(rows, columns=["lang_pred", "lang_score", "lang_share", "lang_known"])

    out = docs.withColumn("__p", predict(F.col(text_col)))
    for c in ("lang_pred", "lang_score", "lang_share", "lang_known"):
        out = out.withColumn(c, F.col(f"__p.{c}"))
    return out.drop("__p")


def held_out(id_col: str = "doc_id"):
    return F.coalesce(crc_remainder(id_col, 4) == 2, F.lit(False))


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learnt where crc32 of the id mod 4 is not 2."""
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.where(crc_remainder("doc_id", 4) != 2))
    out = identify(docs.select("doc_id", "text", held_out().alias("held_out")), model)
    return out.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"), F.col("lang_share").alias("share"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with an identified language: not ``und``, and more of its n-grams than false positives explain."""
    columns = docs.columns
    model = learn(docs.where(crc_remainder("doc_id", 4) != 2))
    named = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    out = identify(named, model, f"c{columns.index('text')}")
    kept = out.where((F.col("lang_pred") != UND) & F.col("lang_known"))
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])
