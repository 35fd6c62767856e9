"""Mixing sources to target weights by iterative proportional fitting.

Documents are summed into cells of (source, language, topic).  Raking scales
the cells' token weights to each of the three target marginals in turn until all
are met, so the fitted table has the wanted marginals and otherwise stays as
close to the corpus as it can.  A cell's fitted weight over its tokens is the rate of its
documents.  Probabilities are rates times a factor, 1 at most, and the factor is
calibrated so that the sample holds a wanted share of the corpus in expectation:
what cells that run out can't give, the others do.  Documents are sampled by a
hash of their id.

Only DataFrame functions are used.  Nothing but cell sums is shuffled before
the last join; a source of any size is summed within tasks first.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fits, scratch, small, table, unit_hash

DIMS = ("source", "lang", "topic")
TEMPERATURE = 0.7
KEEP = 0.5
#: Marginals are met when none is off by more than this share of itself.
TOLERANCE = 1e-8
#: Factors of up to so many values are written into expressions, those of more are joined.
LITERALS = 256
_WORD = r"[^\x20\x09-\x0D]+"


def tokens(text: Column) -> Column:
    """Number of runs of other than ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("double")


#: Forms of text in the order they are looked for: a pattern, and the words for one match that make a text of that form (None: any match).
FORMS = (
    ("legal", r"(?i)licen[cs]e|copyright|all rights reserved", None),
    ("table", r"[|\x09]", 8),
    ("noise", r"[!?&#*~_=]{2}", 8),
    ("figures", r"[0-9]{2}", 16),
)


def topic(text: Column, words: Column) -> Column:
    """What kind of text it is, where the corpus carries no topic of its own.

    legal (licence lines), table (cells), noise (runs of marks), figures (many
    numbers) or prose; without a word: none.
    """
    text, out = F.coalesce(text, F.lit("")), F.when(words == 0, "none")
    for name, pattern, per in FORMS:
        is_it = text.rlike(pattern) if per is None else F.regexp_count(text, F.lit(pattern)) * per >= words
        out = out.when(is_it, name)
    return out.otherwise("prose")


def tempered(cells: DataFrame, dim: str, temperature: float) -> DataFrame:
    """(dim, target): the corpus shares raised to ``temperature`` and made to sum to 1."""
    sums = cells.groupBy(dim).agg(F.sum("tokens").alias("t")).where("t > 0")
    powered = cut(sums.withColumn("p", F.pow(F.col("t"), F.lit(temperature))))
    total = powered.agg(F.sum("p")).first()[0] or 1.0
    return powered.select(dim, (F.col("p") / F.lit(total)).alias("target"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], tolerance: float = TOLERANCE, most_rounds: int = 400) -> DataFrame:
    """cells with ``weight`` fitted to ``targets``, a table (dim, target) for each dim.

    Cells start at their share of tokens.  Values without a target, and cells
    without tokens, get weight 0; a target without tokens can't be met and goes
    to the others in proportion.  A cell's weight is its share times a factor
    for each of its values; a round sets the factors of every dim in turn, from
    sums that are added up within tasks first.  Factors of a dim that was
    counted to be small are numbers of the driver; of others, a table.  When no
    marginal is off by more than ``tolerance`` of itself it is done.  Targets
    that contradict each other can't all be met: when ten rounds took away less
    than a tenth of the largest deviation, or after ``most_rounds``, a warning
    names it.
    """
    spark = cells.sparkSession
    total = cells.agg(F.sum("tokens")).first()[0] or 1.0  # one number, as are the others taken to the driver
    base = cells.withColumn("__w", F.col("tokens") / F.lit(total))
    base = cut(base.coalesce(1) if fits(base) else base)  # few cells need no exchange
    goals, few = {}, {}
    for dim, target in targets.items():
        held = base.where("tokens > 0").select(F.col(dim).alias("__d")).distinct()
        goal = cut(target.join(small(held), F.col(dim).eqNullSafe(F.col("__d")), "left_semi"))
        sum_ = goal.agg(F.sum("target")).first()[0] or 1.0
        goals[dim] = goal.select(F.col(dim).alias("__d"), (F.col("target") / F.lit(sum_)).alias("__t"))
        few[dim] = fits(goals[dim])
    given = {dim: dict(map(tuple, goals[dim].collect())) for dim in targets if few[dim]}  # counted to be few
    known = {dim: dict.fromkeys(given[dim], 1.0) for dim in given}
    tables = {dim: goals[dim].select("__d", F.lit(1.0).alias("__f")) for dim in targets if not few[dim]}

    def factors(dim: str) -> DataFrame:
        if not few[dim]:
            return tables[dim]
        kind = cells.schema[dim].dataType.simpleString()
        return F.broadcast(spark.createDataFrame(list(known[dim].items()), f"__d {kind}, __f double"))

    def literal(dim: str) -> Column:
        kept = [F.lit(x) for item in known[dim].items() if item[0] is not None for x in item]
        of_null = F.lit(known[dim].get(None, 0.0))
        return F.when(F.col(dim).isNull(), of_null).otherwise(F.coalesce(F.create_map(*kept)[F.col(dim)], F.lit(0.0)) if kept else 0.0)

    def weighted() -> DataFrame:
        f, weight = base, F.col("__w")
        for dim in targets:
            if few[dim] and len(known[dim]) <= LITERALS:
                weight = weight * literal(dim)
                continue
            f = f.join(factors(dim).select(F.col("__d").alias(f"__d_{dim}"), F.col("__f").alias(f"__f_{dim}")), F.col(dim).eqNullSafe(F.col(f"__d_{dim}")), "left")
            weight = weight * F.coalesce(F.col(f"__f_{dim}"), F.lit(0.0))
        return f.select(*cells.columns, weight.alias("weight"))

    past: list[float] = []
    for _ in range(most_rounds):
        worst = 0.0
        for dim in targets:
            now = weighted().groupBy(dim).agg(F.sum("weight").alias("now"))
            if few[dim]:
                sums = dict(map(tuple, now.collect()))
                for value, goal in given[dim].items():
                    at = sums.get(value) or 0.0
                    worst = max(worst, abs(at / goal - 1) if goal else 0.0)
                    known[dim][value] *= goal / at if at else 0.0
            else:
                held = now.join(tables[dim], F.col(dim).eqNullSafe(F.col("__d")), "right").select("__d", "__f", "now")
                held = cut(held.join(goals[dim].withColumnRenamed("__d", "__e"), F.col("__d").eqNullSafe(F.col("__e"))))
                at = F.coalesce("now", F.lit(0.0))
                tables[dim] = held.select("__d", F.when(at > 0, F.col("__f") * F.col("__t") / at).otherwise(0.0).alias("__f"))
                off = held.agg(F.max(F.when(F.col("__t") > 0, F.abs(at / F.col("__t") - 1)))).first()[0]
                worst = max(worst, off or 0.0)
        if worst <= tolerance:
            return cut(weighted())
        past.append(worst)
        if len(past) > 10 and worst > 0.9 * past[-11]:
            break
    warnings.warn(f"marginals can't all be met: one is off by {worst:.2g} of itself after {len(past)} rounds", stacklevel=2)
    return cut(weighted())


def features(
    docs: DataFrame, text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_col: str | None = None
) -> DataFrame:
    """docs with the columns that mixing reads: mix_source, mix_lang, mix_topic and mix_tokens.

    ``topic_col`` names a column with topics; without it the form of the text is the topic.
    """
    text = F.col(text_col)
    d = docs.withColumns({"mix_source": F.col(source_col), "mix_lang": F.col(lang_col), "mix_tokens": tokens(text)})
    return d.withColumn("mix_topic", F.col(topic_col) if topic_col else topic(text, F.col("mix_tokens")))


def calibrate(rated: DataFrame, keep: float) -> float:
    """The factor c at which the tokens of min(1, c rate) of each cell add up to the share ``keep`` of all.

    Cells of probability 1 give all they have and the others the rest; c only
    grows, as more cells run out, until no more do.  Each step is one sum over
    cells, and each but the last has more cells that run out, so it ends.
    """
    total, weight = rated.agg(F.sum("tokens"), F.sum(F.col("tokens") * F.col("rate"))).first()
    if not total or not weight:
        return 0.0
    c = keep * total / weight
    while True:
        out = F.col("rate") * F.lit(c) >= 1
        spent, left = rated.agg(
            F.sum(F.when(out, F.col("tokens")).otherwise(0.0)), F.sum(F.when(out, 0.0).otherwise(F.col("tokens") * F.col("rate")))
        ).first()
        new = (keep * total - spent) / left if left else c
        if new <= c * (1 + 1e-12):
            return c
        c = new


def plan(
    d: DataFrame, targets: dict[str, dict[str, float]] | None = None, temperature: float = TEMPERATURE, keep: float = KEEP
) -> DataFrame:
    """Of each cell of d, with ``features``: source, lang, topic, tokens, weight, rate and p.

    ``targets`` gives weights by dim and value; a dim that is left out takes the
    corpus shares raised to ``temperature``.
    """
    named = [F.col(f"mix_{c}").alias(c) for c in DIMS]
    cells = cut(d.select(*named, F.col("mix_tokens").alias("tokens")).groupBy(*DIMS).agg(F.sum("tokens").alias("tokens")))
    wanted = {}
    for dim in DIMS:
        given = (targets or {}).get(dim)
        if given is None:
            wanted[dim] = tempered(cells, dim, temperature)
        else:
            total = sum(given.values())
            shares = [(k, v / total) for k, v in given.items()]
            wanted[dim] = d.sparkSession.createDataFrame(shares, f"{dim} string, target double")
    fitted = rake(cells, wanted)
    rated = cut(fitted.withColumn("rate", F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0)))
    return rated.withColumn("p", F.least(F.col("rate") * F.lit(calibrate(rated, keep)), F.lit(1.0)))


def reached(cells: DataFrame, dim: str) -> DataFrame:
    """(dim, wanted, sampled): the share of each value in the fitted weights, and in the tokens of the sample in expectation.

    They differ where cells run out.
    """
    sums = cells.groupBy(dim).agg(F.sum("weight").alias("w"), F.sum(F.col("tokens") * F.col("p")).alias("t"))
    w, t = sums.agg(F.sum("w"), F.sum("t")).first()
    return sums.select(dim, (F.col("w") / F.lit(w or 1.0)).alias("wanted"), (F.col("t") / F.lit(t or 1.0)).alias("sampled"))


def mix(
    d: DataFrame,
    targets: dict[str, dict[str, float]] | None = None,
    temperature: float = TEMPERATURE,
    keep: float = KEEP,
    seed: int = 0,
    id_col: str = "doc_id",
) -> DataFrame:
    """d, with ``features``, with mix_weight, mix_probability and mix_sampled added (replacing columns of these names).

    ``plan`` tells of targets.  The sample holds the share ``keep`` of all
    tokens, in expectation.  Null sources and languages are values of their own.
    Documents without a word have weight and probability 0.  Equal ids get equal
    draws; null ids draw as one id.  d is read twice: for the cell sums and for
    the result.
    """
    added = ("mix_weight", "mix_probability", "mix_sampled")
    columns = [c for c in d.columns if c not in added]
    cells = plan(d, targets, temperature, keep).select(*[F.col(c).alias(f"__mix_{c}") for c in (*DIMS, "rate", "p")])
    match = [F.col(f"mix_{c}").eqNullSafe(F.col(f"__mix_{c}")) for c in DIMS]
    out = d.select(*[F.col(f"`{c}`") for c in columns]).join(small(cells), match[0] & match[1] & match[2], "left")
    own, p = F.col("mix_tokens") > 0, F.col("__mix_p")
    u = unit_hash(F.lit(seed), F.col(id_col))
    return out.select(
        *[F.col(f"`{c}`") for c in columns],
        F.when(own, F.col("__mix_rate") * F.col("mix_tokens")).otherwise(0.0).alias("mix_weight"),
        F.when(own, p).otherwise(0.0).alias("mix_probability"),
        (own & (u < p)).alias("mix_sampled"),
    )


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fitted weight, probability and whether it is sampled.

    Texts are read once, for their features, which are small and kept.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    out = mix(cut(features(docs).drop("text")))
    return out.select(
        "doc_id", "source", "lang", F.col("mix_topic").alias("topic"), F.col("mix_tokens").cast("long").alias("tokens"),
        F.round("mix_probability", 6).alias("probability"), F.col("mix_sampled").alias("sampled"),
    )


def _op5_sql(rounds: int = 100) -> str:
    """More rounds than it takes; then nothing changes at six places."""
    forms = " ".join(
        f"WHEN regexp_matches(body, '{p}') THEN '{name}'" if per is None else f"WHEN len(regexp_extract_all(body, '{p}')) * {per} >= tokens THEN '{name}'"
        for name, p, per in FORMS
    )
    targets = ",\n".join(
        f"t_{dim} AS MATERIALIZED (SELECT {dim}, p / sum(p) OVER () AS target FROM "
        f"(SELECT {dim}, pow(sum(tokens), {TEMPERATURE}) AS p FROM c GROUP BY {dim} HAVING sum(tokens) > 0))" for dim in DIMS
    )
    step = "SELECT * FROM r WHERE n < {rounds}".format(rounds=rounds)
    for dim in DIMS:
        step = (
            f"SELECT * REPLACE (CASE WHEN w > 0 THEN w * g_{dim} / sum(w) OVER (PARTITION BY {dim}) ELSE 0 END AS w) FROM ({step})"
        )
    return f"""WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, source, lang, tokens, CASE WHEN tokens = 0 THEN 'none' {forms} ELSE 'prose' END AS topic
  FROM (SELECT doc_id, source, lang, coalesce(text, '') AS body,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::DOUBLE AS tokens FROM documents)),
c AS MATERIALIZED (SELECT source, lang, topic, sum(tokens) AS tokens FROM d GROUP BY ALL),
{targets},
r AS (SELECT c.source, c.lang, c.topic, tokens, tokens / sum(tokens) OVER () AS w, coalesce(a.target, 0) AS g_source, coalesce(b.target, 0) AS g_lang,
    coalesce(e.target, 0) AS g_topic, 0 AS n
  FROM c LEFT JOIN t_source a ON c.source IS NOT DISTINCT FROM a.source LEFT JOIN t_lang b ON c.lang IS NOT DISTINCT FROM b.lang LEFT JOIN t_topic e ON c.topic = e.topic
  UNION ALL SELECT * REPLACE (n + 1 AS n) FROM ({step})),
q AS MATERIALIZED (SELECT source, lang, topic, tokens, CASE WHEN tokens > 0 THEN w / tokens ELSE 0 END AS rate FROM r WHERE n = {rounds}),
s AS (SELECT tokens, rate, sum(tokens) OVER w - tokens AS spent, sum(tokens * rate) OVER () - sum(tokens * rate) OVER w + tokens * rate AS rest, sum(tokens) OVER () AS total
  FROM q WINDOW w AS (ORDER BY rate DESC, tokens DESC ROWS UNBOUNDED PRECEDING)),
k AS (SELECT coalesce(max(({KEEP} * total - spent) / rest), 0) AS k FROM s WHERE rest > 1e-12 * tokens AND rate > 0),
f AS MATERIALIZED (SELECT source, lang, topic, least(rate * k, 1) AS p FROM q, k)
SELECT doc_id, d.source, d.lang, d.topic, d.tokens::BIGINT AS tokens, round(CASE WHEN d.tokens > 0 THEN p ELSE 0 END, 6) AS probability,
  d.tokens > 0 AND ('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0 < p AS sampled
FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source AND d.lang IS NOT DISTINCT FROM f.lang AND d.topic = f.topic
"""


OP5_SQL = _op5_sql()


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sampled documents, with topic, tokens, weight and probability.

    Documents are written with their features, so that texts are looked through
    once; the sums over cells then read the features alone.
    """
    columns = docs.columns
    at = {c: f"c{i}" for i, c in enumerate(columns)}
    path = scratch(spark, "features")
    features(docs.toDF(*at.values()), at["text"], at["source"], at["lang"]).write.parquet(path)
    out = mix(spark.read.parquet(path), id_col=at["doc_id"]).where("mix_sampled")
    extra = [c for c in ("mix_topic", "mix_tokens", "mix_weight", "mix_probability") if c not in columns]
    return out.select(*[F.col(at[c]).alias(c) for c in columns], *extra)
