"""URL filters as a temporal list join.

A list has dated entries: (pattern, action, since). For each pattern an entry holds until the next one, which makes
validity intervals; action `none` ends a pattern's validity. A capture (url, fetched) is looked up by every suffix of
its host, and by every such suffix with each prefix of the path that ends at a slash, against the intervals containing
its fetch time. Of what is active, the pattern with the most characters decides, then the one first in code-point order.

DataFrame operations only. A list of a size that has been counted is broadcast; a longer one is joined by shuffling
the keys. Distinct (host, path prefix, time) keys are made without a Python step.

Defined cases: a url that is null or has no host matches nothing and is kept; a null fetch time is before all entries;
of entries with one pattern and date, the action last in code-point order holds; entries with a null part are void;
repeated captures are judged alike; extra columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .core import cut, small

#: The registered query's list: of each host, and of each host with these paths, so many entries, dated and decided by md5.
PATHS, DATES = ["", "/en", "/de", "/fr", "/es"], 8
ACTIONS = ["block", "none", "review", "allow"]


def entries_of(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Dated entries (pattern, action, since) for the hosts of a table, by rule: some dozens a host, over two years."""
    hosts = pages.select(host(F.col(url_col)).alias("host")).where("host <> ''").distinct()
    each = hosts.select("host", F.explode(F.array(*map(F.lit, PATHS))).alias("path")).select(F.concat("host", "path").alias("pattern"), F.explode(F.sequence(F.lit(1), F.lit(DATES))).alias("k"))
    digest = F.md5(F.concat("pattern", F.lit("#"), F.col("k").cast("string")))
    number = lambda at, n: F.conv(F.substring(digest, at, n), 16, 10).cast("int")
    since = F.date_add(F.lit("2024-01-01").cast("date"), number(1, 5) % 730)
    return each.select("pattern", F.element_at(F.array(*map(F.lit, ACTIONS)), number(6, 2) % len(ACTIONS) + 1).alias("action"), since.alias("since"))


def intervals(entries: DataFrame) -> DataFrame:
    """pattern, action, since, until (null: still valid) of dated entries (pattern, action, since)."""
    rows = entries.select(F.lower("pattern").alias("pattern"), "action", "since").where("pattern is not null and action is not null and since is not null")
    last = rows.groupBy("pattern", "since").agg(F.max("action").alias("action"))
    order = Window.partitionBy("pattern").orderBy("since")
    return last.withColumn("until", F.lead("since").over(order)).where("action <> 'none'")


def host(url: Column) -> Column:
    """The lower-case host, without user and port; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))


def lookup_keys(url: Column) -> Column:
    """The patterns that can match a url: host suffixes, alone and with path prefixes."""
    labels = F.split(host(url), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)", 1)
    steps = F.filter(F.split(path, "/"), lambda x: x != "")
    prefixes = F.concat(F.array(F.lit("")), F.when(F.size(steps) > 0, F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(steps, 1, i), "/")))).otherwise(F.array().cast("array<string>")))
    every = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    return F.when(host(url) == "", F.array().cast("array<string>")).otherwise(every)


def judge(captures: DataFrame, entries: DataFrame, id_col: str, url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """_id, _url, _fetched, pattern, action and since of the deciding entry, and keep (false for action block) of each capture.

    The keys of each distinct (url, time) are matched once; the matched ones come back by a join on that pair.
    """
    rows = captures.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(time_col).alias("_fetched"))
    held = small(intervals(entries))
    keys = rows.select("_url", "_fetched").where("_url is not null and _fetched is not null").distinct().select("_url", "_fetched", F.explode(lookup_keys(F.col("_url"))).alias("pattern"))
    active = keys.join(held, "pattern").where("_fetched >= since and (until is null or _fetched < until)")
    best = F.max_by(F.struct("pattern", "action", "since"), F.struct(F.length("pattern"), F.col("pattern")))
    found = active.groupBy("_url", "_fetched").agg(best.alias("_hit"))
    out = rows.join(found, ["_url", "_fetched"], "left")
    return out.select("_id", "_url", "_fetched", "_hit.pattern", "_hit.action", "_hit.since", (F.coalesce(F.col("_hit.action"), F.lit("")) != "block").alias("keep"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judges every page against the list that entries_of makes for their hosts; pages have no fetch time, so that it is set by rule: page_id modulo 730 days after 2024-01-01."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url").withColumn("fetched", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(730)).cast("int")))
    out = judge(pages, cut(entries_of(pages)), "page_id")
    return out.select(F.col("_id").alias("page_id"), F.col("_fetched").cast("string").alias("fetched"), "pattern", "action", F.col("since").cast("string").alias("since"), "keep")


_HOST = r"lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1))"
SQL = (
    f"""WITH h AS (SELECT DISTINCT {_HOST} AS host FROM pages), g AS (
  SELECT host || path AS pattern, md5(host || path || '#' || k) AS d FROM h, unnest({PATHS}) AS p(path), range(1, {DATES + 1}) AS r(k) WHERE host <> ''
), e AS (
  SELECT pattern, {ACTIONS}[CAST('0x' || substr(d, 6, 2) AS INTEGER) % {len(ACTIONS)} + 1] AS action, DATE '2024-01-01' + CAST('0x' || substr(d, 1, 5) AS INTEGER) % 730 AS since FROM g
), x AS (
  SELECT pattern, since, max(action) AS action FROM e GROUP BY pattern, since"""
    + r"""
), i AS (
  SELECT * FROM (SELECT pattern, action, since, lead(since) OVER (PARTITION BY pattern ORDER BY since) AS until FROM x) WHERE action <> 'none'
), c AS (
  SELECT page_id, DATE '2024-01-01' + CAST(((page_id % 730) + 730) % 730 AS INTEGER) AS fetched,
    lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)) AS host,
    regexp_replace(rtrim(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)', 1), '/'), '/+', '/', 'g') AS path
  FROM pages
), m AS (
  SELECT c.page_id, c.fetched, i.pattern, i.action, i.since,
    row_number() OVER (PARTITION BY c.page_id ORDER BY length(i.pattern) DESC NULLS LAST, i.pattern DESC) AS n
  FROM c LEFT JOIN i ON c.host <> '' AND c.fetched >= i.since AND (i.until IS NULL OR c.fetched < i.until)
    AND ('.' || c.host) LIKE ('%.' || split_part(i.pattern, '/', 1))
    AND (position('/' IN i.pattern) = 0 OR starts_with(c.path || '/', substr(i.pattern, position('/' IN i.pattern)) || '/'))
)
SELECT page_id, strftime(fetched, '%Y-%m-%d') AS fetched, pattern, action, strftime(since, '%Y-%m-%d') AS since,
  coalesce(action, '') <> 'block' AS keep FROM m WHERE n = 1
"""
)
