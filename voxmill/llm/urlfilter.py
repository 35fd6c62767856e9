"""URL filters as a temporal list join.

A block list changes over time: each dated entry adds a rule or takes it off.
Entries of one rule, put in order, become intervals in which the rule is
active.  A capture matches a rule on its host or any parent domain, if the
rule's path prefix fits, and the interval that holds its fetch time decides, as
of that time; a later listing never changes an earlier capture.

Nothing is compared that doesn't match: rules are looked up by domain and by the
prefixes of the path that have the length of one of the domain's rules, and
intervals by blocks of time, into which each is cut without rest.  So neither a
host with many rules nor a rule with many changes meets all of its captures.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, small, table

_URL = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    """Lower-cased host without user, port and final dot; null where the URL has none."""
    authority = F.regexp_extract(url, _URL, 1)
    h = F.regexp_replace(F.lower(F.regexp_replace(authority, r"^.*@", "")), r":\d*$", "")
    h = F.regexp_replace(h, r"\.$", "")
    return F.when(h == "", None).otherwise(h)


def path(url: Column) -> Column:
    """Path of the URL; ``/`` where it is empty."""
    p = F.regexp_extract(url, _URL, 2)
    return F.when(p == "", "/").otherwise(p)


def domains(host: Column) -> Column:
    """The host and its parent domains of two labels or more; a host of one label: itself."""
    parts = F.split(host, r"\.")
    n = F.size(parts)
    return F.transform(
        F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
        lambda i: F.concat_ws(".", F.slice(parts, i, n - i + 1)),
    )


def intervals(entries: DataFrame) -> DataFrame:
    """Entries (domain, prefix, category, action, at) as (domain, prefix, category, since, until).

    ``action`` is ``add`` or ``remove``, ``until`` is exclusive and null while
    open.  Of entries of one rule at one time a removal wins.  Adding what is
    listed, and removing what isn't, change nothing.  Entries with a null
    domain, action or time are left out; a null prefix is ``/``, a null
    category the empty one.
    """
    e = entries.where("domain is not null and action in ('add', 'remove') and at is not null").select(
        F.lower("domain").alias("domain"), F.coalesce("prefix", F.lit("/")).alias("prefix"),
        F.coalesce("category", F.lit("")).alias("category"), "at", (F.col("action") == "add").alias("on"),
    )
    rule = ["domain", "prefix", "category"]
    e = e.groupBy(*rule, "at").agg(F.min("on").alias("on"))
    w = Window.partitionBy(*rule).orderBy("at")
    e = e.withColumn("was", F.coalesce(F.lag("on").over(w), F.lit(False))).where("on != was")
    e = e.withColumn("until", F.lead("at").over(w))
    return e.where("on").select(*rule, F.col("at").alias("since"), "until")


#: Blocks of time have powers of this many seconds; the last level spans 136 years.
_BASE, _LEVELS = 16, 8


def _seconds(t: Column) -> Column:
    last = _BASE**_LEVELS - 1
    return F.greatest(F.lit(0), F.least(F.floor(F.unix_micros(t.cast("timestamp")) / 1_000_000), F.lit(last))).cast("long")


def covering(since: Column, until: Column) -> Column:
    """Blocks (level, block) that make up the seconds from ``since`` up to ``until``, itself included; no end: all that follow."""
    a = _seconds(since)
    b = F.coalesce(_seconds(until) + 1, F.lit(_BASE**_LEVELS).cast("long"))

    def level(k: int) -> Column:
        up = lambda x, n: F.floor((x + (n - 1)) / n).cast("long")
        down = lambda x, n: F.floor(x / n).cast("long")
        first, end = up(a, _BASE**k), down(b, _BASE**k)
        span = lambda x, y: F.when(x < y, F.sequence(x, y - 1)).otherwise(F.array().cast("array<long>"))
        if k == _LEVELS:
            blocks = span(first, end)
        else:  # what whole blocks of the next level don't hold
            x, y = up(a, _BASE ** (k + 1)), down(b, _BASE ** (k + 1))
            blocks = F.when(x < y, F.concat(span(first, x * _BASE), span(y * _BASE, end))).otherwise(span(first, end))
        return F.transform(blocks, lambda n: F.struct(F.lit(k).alias("level"), n.alias("block")))

    return F.concat(*[level(k) for k in range(_LEVELS + 1)])


def blocks_of(t: Column) -> Column:
    """The block of each level that holds a time."""
    s = _seconds(t)
    return F.array(*[F.struct(F.lit(k).alias("level"), F.floor(s / _BASE**k).cast("long").alias("block")) for k in range(_LEVELS + 1)])


def filter_urls(captures: DataFrame, entries: DataFrame, id_col: str, url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """captures with url_host, blocked, rule, category and listed_since added.

    Of several active rules the one with the longest domain is named, then the
    longest prefix, then the first category and rule in order.  Null or malformed
    URLs and null times are not blocked.  Repeated captures and ids each keep
    their row.  Captures are looked up once per distinct (host, path, time).
    Times are dates or timestamps.
    """
    columns = captures.columns
    at = {c: f"c{i}" for i, c in enumerate(columns)}
    d = captures.toDF(*at.values())
    d = d.withColumns({"host": host(F.col(at[url_col])), "path": path(F.col(at[url_col])), "t": F.col(at[time_col])})
    rules = cut(intervals(entries))
    lengths = rules.groupBy("domain").agg(F.collect_set(F.length("prefix")).alias("lengths"))
    asked = d.where("host is not null and t is not null").select("host", "path", "t").distinct()
    probe = asked.select("*", F.explode(domains(F.col("host"))).alias("domain")).join(small(lengths), "domain")
    probe = probe.withColumn("n", F.explode("lengths")).where(F.col("n") <= F.length("path"))
    probe = probe.withColumn("prefix", F.substring("path", F.lit(1), F.col("n"))).drop("n", "lengths")
    some = small(rules.select("domain", "prefix").distinct())
    probe = probe.join(some, ["domain", "prefix"], "left_semi").withColumn("b", F.explode(blocks_of(F.col("t")))).select("*", "b.*").drop("b")
    cells = rules.withColumn("b", F.explode(covering(F.col("since"), F.col("until")))).select("*", "b.*").drop("b")
    hits = probe.join(small(cells), ["domain", "prefix", "level", "block"]).where(
        (F.col("t") >= F.col("since")) & (F.col("until").isNull() | (F.col("t") < F.col("until")))
    )
    best = F.min(F.struct(
        (-F.length("domain")).alias("a"), (-F.length("prefix")).alias("b"), "category", "domain", "prefix", "since"
    ))
    found = cut(hits.groupBy("host", "path", "t").agg(best.alias("m")))
    out = d.join(small(found.withColumnsRenamed({"host": "h2", "path": "p2", "t": "t2"})),
                 (F.col("host") == F.col("h2")) & (F.col("path") == F.col("p2")) & (F.col("t") == F.col("t2")), "left")
    return out.select(
        *[F.col(at[c]).alias(c) for c in columns],
        F.col("host").alias("url_host"),
        F.col("m").isNotNull().alias("blocked"),
        F.concat("m.domain", "m.prefix").alias("rule"),
        F.col("m.category").alias("category"),
        F.col("m.since").alias("listed_since"),
    )


def captures_of(pages: DataFrame, events: DataFrame) -> DataFrame:
    """(page_id, url, fetched_at): a page is fetched at the time of the first event of its number, without one never."""
    log = events.groupBy("event_id").agg(F.min("ts").alias("fetched_at"))
    return pages.select("page_id", "url").join(log, F.col("page_id") == F.col("event_id"), "left").select("page_id", "url", "fetched_at")


def entries_of(pages: DataFrame, events: DataFrame) -> DataFrame:
    """The dated list that the events tell of.

    An ``error`` of a page puts its host on the list, or only the first folder
    of its path where the event's value is below 50, and a ``signup`` takes the
    same rule off.  An hour's events are in the list from the next full hour on.
    """
    e = events.where("event_type in ('error', 'signup')").join(pages.select("page_id", "url"), F.col("event_id") == F.col("page_id"))
    folder = F.regexp_extract(path(F.col("url")), "^/[^/]*/", 0)
    return e.select(
        host(F.col("url")).alias("domain"), F.when((F.col("value") < 50) & (folder != ""), folder).alias("prefix"), F.lit("reported").alias("category"),
        F.when(F.col("event_type") == "error", "add").otherwise("remove").alias("action"), (F.date_trunc("hour", "ts") + F.expr("interval 1 hour")).alias("at"),
    )


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, judged by the list as of the time it was fetched."""
    pages, events = table(spark, sf_dir, "pages"), table(spark, sf_dir, "events")
    return filter_urls(captures_of(pages, events), entries_of(pages, events), "page_id")


OP10_SQL = r"""
WITH u AS (SELECT page_id, url,
  nullif(regexp_replace(regexp_replace(lower(regexp_replace(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)([^?#]*)', 1), '^.*@', '')), ':\d*$', ''), '\.$', ''), '') AS url_host,
  coalesce(nullif(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)([^?#]*)', 2), ''), '/') AS path FROM pages),
p AS (SELECT page_id, url, url_host, path, fetched_at FROM u LEFT JOIN (SELECT event_id, min(ts) AS fetched_at FROM events GROUP BY ALL) ON page_id = event_id),
e AS (SELECT url_host AS domain, coalesce(CASE WHEN value < 50 THEN nullif(regexp_extract(path, '^/[^/]*/'), '') END, '/') AS prefix, 'reported' AS category,
    date_trunc('hour', ts)::TIMESTAMP + INTERVAL 1 HOUR AS day, min(event_type = 'error') AS act
  FROM events JOIN u ON event_id = page_id WHERE event_type IN ('error', 'signup') AND url_host IS NOT NULL GROUP BY ALL),
ch AS (SELECT * FROM (SELECT *, coalesce(lag(act) OVER w, false) AS was FROM e WINDOW w AS (PARTITION BY domain, prefix, category ORDER BY day)) WHERE act <> was),
iv AS (SELECT domain, prefix, category, day AS since, until FROM (SELECT *, lead(day) OVER (PARTITION BY domain, prefix, category ORDER BY day) AS until FROM ch) WHERE act),
a AS (SELECT DISTINCT url_host, path, fetched_at FROM p),
j AS (SELECT url_host, path, fetched_at, min({'a': -length(iv.domain), 'b': -length(prefix), 'category': category, 'domain': iv.domain, 'prefix': prefix, 'since': since}) AS m
  FROM a JOIN iv ON (url_host = iv.domain OR ends_with(url_host, '.' || iv.domain)) AND fetched_at >= since AND (until IS NULL OR fetched_at < until) AND starts_with(path, prefix)
  GROUP BY ALL)
SELECT page_id, url, fetched_at, p.url_host, m IS NOT NULL AS blocked, m.domain || m.prefix AS rule, m.category AS category, m.since AS listed_since
FROM p LEFT JOIN j USING (url_host, path, fetched_at)
"""
