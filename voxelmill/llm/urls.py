"""URL filters by a temporal list join.

The list has dated entries (pattern, listed_on, action): from that day on the pattern, a host or a parent
domain of at least two labels, is blocked, allowed, or off the list (`remove`). An entry is valid until the
pattern's next one. A capture is judged by the entries that were valid on the day of its fetch; of several
patterns that fit its host the longest decides.

Captures are reduced to the distinct pairs of host and day before they meet the list, so a host that has a
third of all captures is a few hundred rows. Intervals are dealt out over months, so that the join is on
equal pattern and month and each pair meets only intervals of its month.

A null or unparsable url has no host, a null day no entries: such captures are kept with action `none`. Of
several entries for a pattern on one day block wins over allow and allow over remove. Entries with a null
pattern or day, or an action of another name, are ignored. Repeated rows are judged alike and all returned.
An address in digits is no part of another. There is no list of public suffixes: an entry for `co.uk` holds for all below it. Empty lists decide nothing; an empty table of captures gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Days of a month of the join.
MONTH = 30
STRENGTH = ["remove", "allow", "block"]
#: A host of digits and dots.
ADDRESS = r"^[0-9.]+$"


def host_of(url: Column) -> Column:
    """The lower-case host of an absolute url without user, port and final dot; null where there is none."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), ":[0-9]*$", ""), r"\.$", ""))
    return F.when(host != "", host)


def suffixes(host: Column) -> Column:
    """The host and its parent domains down to two labels; a host of one label and an IPv4 address are their own only ones."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    return F.when(host.rlike(ADDRESS), F.array(host)).otherwise(parents(labels, n))


def parents(labels: Column, n: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda k: F.array_join(F.slice(labels, k, n), "."))


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, action, listed_on, until): what is valid when; `until` is the first day it no longer is, or null."""
    strength = F.array_position(F.array(*[F.lit(a) for a in STRENGTH]), F.col("action")).cast("int")
    known = entries.where(F.col("pattern").isNotNull() & F.col("listed_on").isNotNull() & F.col("action").isin(STRENGTH))
    days = known.groupBy(F.lower("pattern").alias("pattern"), "listed_on").agg(F.max(strength).alias("strength"))
    until = F.lead("listed_on").over(W.partitionBy("pattern").orderBy("listed_on"))
    action = F.element_at(F.array(*[F.lit(a) for a in STRENGTH]), F.col("strength"))
    return days.select("pattern", action.alias("action"), "listed_on", until.alias("until")).where("action <> 'remove'")


def month_of(day: Column) -> Column:
    return F.floor(F.unix_date(day) / MONTH).cast("int")


def judge(captures: DataFrame, entries: DataFrame, url: str = "url", fetched_on: str = "fetched_on") -> DataFrame:
    """`captures` with host, action (block, allow or none), pattern and listed_on of the entry that decided, and keep.

    Columns of these names in `captures` are replaced.
    """
    made = ["host", "action", "pattern", "listed_on", "keep"]
    rows = captures.drop(*[c for c in made if c not in (url, fetched_on)]).withColumn("host", host_of(F.col(url)))
    pairs = rows.where(F.col("host").isNotNull() & F.col(fetched_on).isNotNull()).groupBy("host", F.col(fetched_on).alias("__day")).agg(F.count("*").alias("__n"))
    asked = pairs.select("host", "__day", F.explode(suffixes(F.col("host"))).alias("__suffix"), month_of(F.col("__day")).alias("__month"))
    last = captures.agg(F.max(fetched_on)).first()[0]
    end = F.coalesce(F.col("until"), F.date_add(F.greatest(F.lit(last).cast("date"), F.col("listed_on")), 1))
    valid = intervals(entries).select("pattern", "action", "listed_on", end.alias("__end"))
    valid = valid.withColumn("__month", F.explode(F.sequence(month_of(F.col("listed_on")), month_of(F.date_sub("__end", 1)))))
    met = asked.join(valid, (F.col("__suffix") == F.col("pattern")) & (asked["__month"] == valid["__month"]) & (F.col("listed_on") <= F.col("__day")) & (F.col("__day") < F.col("__end")))
    best = met.groupBy("host", "__day").agg(F.max(F.struct(F.length("pattern").alias("n"), "pattern", "action", "listed_on")).alias("__best"))
    best = best.select(F.col("host").alias("__host"), "__day", *[F.col(f"__best.{c}") for c in ("action", "pattern", "listed_on")])
    out = rows.join(best, (F.col("host") == F.col("__host")) & (F.col(fetched_on) == F.col("__day")), "left").drop("__host", "__day")
    return out.withColumn("action", F.coalesce("action", F.lit("none"))).withColumn("keep", F.col("action") != "block")


def filter_urls(captures: DataFrame, entries: DataFrame, url: str = "url", fetched_on: str = "fetched_on") -> DataFrame:
    """The captures that the list doesn't block, with their own columns."""
    named = captures.select(F.col(url).alias("__url"), F.col(fetched_on).alias("__fetched"), F.struct("*").alias("__row"))
    return judge(named, entries, "__url", "__fetched").where("keep").select("__row.*")


def dated(pages: DataFrame) -> DataFrame:
    """Pages with a day of fetch, which the table lacks: two years from 2023, by page id."""
    return pages.select("page_id", "url", F.date_add(F.lit("2023-01-01").cast("date"), F.pmod("page_id", F.lit(730)).cast("int")).alias("fetched_on"))


def reports(pages: DataFrame) -> DataFrame:
    """A list made from the pages: each reports its host and the last two labels of it, by what its url looks like."""
    host = host_of(F.col("url"))
    url = F.col("url")
    by_host = F.when(url.contains("?"), "block").when(url.contains("#"), "allow").otherwise("remove")
    by_domain = F.when(url.endswith(".html"), "block").when(url.startswith("https"), "allow").otherwise("remove")
    each = F.array(F.struct(host.alias("pattern"), by_host.alias("action")), F.struct(F.substring_index(host, ".", -2).alias("pattern"), by_domain.alias("action")))
    return pages.select(F.col("fetched_on").alias("listed_on"), F.explode(each).alias("e")).select("e.pattern", "listed_on", "e.action")


def url_query(pages: DataFrame) -> DataFrame:
    captures = dated(pages)
    return judge(captures, reports(captures)).select("page_id", "url", "host", F.date_format("fetched_on", "yyyy-MM-dd").alias("fetched_on"), "action", "pattern", F.date_format("listed_on", "yyyy-MM-dd").alias("listed_on"), "keep")


URL_SQL = r"""
WITH captures AS (
  SELECT page_id, url, DATE '2023-01-01' + CAST(page_id % 730 AS INTEGER) AS fetched_on,
    nullif(lower(regexp_replace(regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', ''), '\.$', '')), '') AS host
  FROM pages
), entries AS (
  SELECT host AS pattern, fetched_on AS listed_on, CASE WHEN contains(url, '?') THEN 3 WHEN contains(url, '#') THEN 2 ELSE 1 END AS strength FROM captures
  UNION ALL
  SELECT regexp_extract(host, '([^.]*\.)?[^.]*$', 0), fetched_on, CASE WHEN ends_with(url, '.html') THEN 3 WHEN starts_with(url, 'https') THEN 2 ELSE 1 END FROM captures
), days AS (SELECT pattern, listed_on, max(strength) AS strength FROM entries WHERE pattern IS NOT NULL AND listed_on IS NOT NULL GROUP BY ALL),
valid AS (SELECT pattern, strength, listed_on, lead(listed_on) OVER (PARTITION BY pattern ORDER BY listed_on) AS until FROM days),
pairs AS (SELECT DISTINCT host, fetched_on FROM captures WHERE host IS NOT NULL AND fetched_on IS NOT NULL),
best AS (
  SELECT host, fetched_on, pattern, listed_on, strength FROM pairs JOIN valid
    ON (host = pattern OR ends_with(host, '.' || pattern) AND NOT regexp_matches(host, '^[0-9.]+$')) AND listed_on <= fetched_on AND (until IS NULL OR fetched_on < until)
  WHERE strength > 1 QUALIFY row_number() OVER (PARTITION BY host, fetched_on ORDER BY length(pattern) DESC) = 1
)
SELECT page_id, url, c.host AS host, strftime(c.fetched_on, '%Y-%m-%d') AS fetched_on, CASE strength WHEN 3 THEN 'block' WHEN 2 THEN 'allow' ELSE 'none' END AS action,
  pattern, strftime(listed_on, '%Y-%m-%d') AS listed_on, coalesce(strength, 0) <> 3 AS keep
FROM captures c LEFT JOIN best b ON c.host = b.host AND c.fetched_on = b.fetched_on
"""
