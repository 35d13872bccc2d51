"""Operator 9: URL filters as a temporal list join, in DataFrame operations only.

A list is a log of dated entries: a pattern is added to it or removed from it. Each pattern's entries become validity
intervals, [added, next entry). A pattern is a domain, which covers its subdomains, or a host with the first segments of a
path. Every capture is matched as of its own fetch time: its host's suffixes and its path's prefixes are joined with the
patterns, and the interval that holds at that time decides. The longest active pattern is the rule that is reported.

Of a capture's suffixes and prefixes only those stay that a map of bits of all patterns has, before anything is shuffled; so a
key such as `com` costs nothing unless it is listed, and then only its own captures. Captures that agree in URL and time are
decided once. Keys of many captures are split into parts by their counts, each of which gets the key's intervals: a host with
a third of all captures isn't dealt to one task. Only URLs, times and ids travel, and no list is sent to all tasks but the bits.

Null and relative URLs and null times match nothing and aren't blocked. Entries with null patterns, times or actions are
left out; entries of one pattern at one time count in the order add, remove. Captures that repeat are decided alike and
each keeps its row; extra columns of captures are left out, unless asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinship.llm.common import split_join, stored, with_membership

#: (pattern, action, date): the fixed part of the list that the query uses.
LIST = (
    ("spam-farm.example.com", "add", "2024-01-15"),
    ("ads-track.example.com", "add", "2024-02-01"),
    ("ads-track.example.com", "remove", "2024-05-01"),
    ("ads-track.example.com", "add", "2024-09-10"),
    ("blog.tionble.example.com", "add", "2024-03-20"),
    ("tionsh.example.net", "add", "2024-06-01"),
    ("tionsh.example.net", "remove", "2024-07-15"),
    ("therhe.example.org/en", "add", "2024-01-01"),
    ("thered.example.org", "add", "2024-04-04"),
    ("thered.example.org", "remove", "2024-04-05"),
    ("example.org/de", "add", "2024-02-02"),
    ("m.therin.example.org/en", "add", "2024-10-01"),
    ("example.net", "add", "2024-12-20"),
)


def host_of(url: Column) -> Column:
    """The host of an absolute URL in lower case, without user and port; null for others."""
    place = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))
    host = F.regexp_replace(F.regexp_replace(place, r"^.*@", ""), r":[0-9]*$", "")
    return F.when(host != "", host)


def path_of(url: Column) -> Column:
    """The segments of an absolute URL's path."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    return F.filter(F.split(path, "/"), lambda s: s != "")


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, since, until) of a log of (pattern, action, at): when each pattern was on the list; until is null while it still is."""
    clean = entries.filter(F.col("pattern").isNotNull() & F.col("at").isNotNull() & F.col("action").isin("add", "remove")).select(F.lower(F.rtrim(F.col("pattern"), F.lit("/"))).alias("pattern"), "action", "at").distinct()
    later = Window.partitionBy("pattern").orderBy("at", "action")
    return clean.withColumn("until", F.lead("at").over(later)).filter("action = 'add' AND (until IS NULL OR until > at)").select("pattern", F.col("at").alias("since"), "until")


def matched(captures: DataFrame, entries: DataFrame, id_col: str = "id", url_col: str = "url", at_col: str = "at") -> DataFrame:
    """One row per capture: id, url, at, host, blocked, rule (the longest pattern active at its time) and since (when that was added)."""
    listed = stored(intervals(entries), "listed")
    depth = listed.agg(F.max(F.size(F.split("pattern", "/"))) - 1).first()[0] or 0  # segments that a pattern has at most
    host, labels = host_of(F.col("url")), F.split("host", r"\.")
    rows = captures.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(at_col).alias("at")).withColumn("host", host)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = rows.filter("host IS NOT NULL AND at IS NOT NULL").withColumns({"suffix": suffixes, "path": F.slice(path_of(F.col("url")), 1, depth) if depth else F.array().cast("array<string>")})
    keys = F.flatten(F.transform("suffix", lambda s: F.transform(F.sequence(F.lit(0), F.size("path")), lambda n: F.concat_ws("/", s, F.slice("path", 1, n)))))
    exploded = hosts.select("url", "at", F.explode(F.array_distinct(keys)).alias("pattern"))
    asked = stored(with_membership(exploded, listed.select("pattern"), ["pattern"], "maybe").filter("maybe").select("url", "at", "pattern").distinct(), "asked")
    sizes = asked.groupBy("pattern").agg(F.count("*").alias("n"))
    found = split_join(asked, listed, ["pattern"], sizes, asked.count()).filter("since <= at AND (until IS NULL OR at < until)")
    best = stored(found.groupBy("url", "at").agg(F.max_by(F.struct("pattern", "since"), F.struct(F.length("pattern"), "pattern")).alias("rule")), "rules")
    # captures without a rule pass by the last join
    shown = with_membership(rows, best.select("url", "at"), ["url", "at"], "maybe").withColumn("maybe", F.col("maybe") & F.col("url").isNotNull() & F.col("at").isNotNull())
    some, none = shown.filter("maybe").drop("maybe"), shown.filter("NOT maybe").drop("maybe")
    repeats = some.groupBy("url", "at").agg(F.count("*").alias("n"))
    ruled = split_join(some, some.select("url", "at").distinct().join(best, ["url", "at"], "left"), ["url", "at"], repeats, some.count())
    decided = ruled.select("id", "url", "at", "host", "rule").unionByName(none.select("id", "url", "at", "host", F.lit(None).cast(ruled.schema["rule"].dataType).alias("rule")))
    return decided.select(F.col("id").alias(id_col), F.col("url").alias(url_col), F.col("at").alias(at_col), "host", F.col("rule").isNotNull().alias("blocked"), F.col("rule.pattern").alias("rule"), F.col("rule.since").alias("since"))


def host_entries(hosts: DataFrame) -> DataFrame:
    """(pattern, action, at): a log that grows with the crawl. A quarter of the hosts, chosen by their md5, is added on a day of 2024 and removed up to 90 days later."""
    digits = lambda first: F.conv(F.substring(F.md5("host"), first, 4), 16, 10).cast("int")
    added = F.date_add(F.lit("2024-01-01").cast("date"), digits(2) % 366)
    log = F.array(F.struct(F.lit("add").alias("action"), added.alias("at")), F.struct(F.lit("remove").alias("action"), F.date_add(added, 1 + digits(6) % 90).alias("at")))
    return hosts.filter(F.substring(F.md5("host"), 1, 1).isin(*"0123")).select(F.col("host").alias("pattern"), F.explode(log).alias("e")).select("pattern", "e.action", "e.at")


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page against the list as it stood when the page was fetched: LIST and the hosts' own log. Pages carry no dates: page p counts as fetched on day 37 p mod 366 of 2024."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 37, F.lit(366)).cast("int")).alias("at"))
    fixed = spark.createDataFrame(LIST, "pattern string, action string, at string").withColumn("at", F.to_date("at"))
    entries = fixed.unionByName(host_entries(pages.select(host_of(F.col("url")).alias("host")).filter("host IS NOT NULL").distinct()))
    return matched(pages, entries, "page_id").select("page_id", "host", F.col("at").cast("string").alias("fetched_on"), "blocked", "rule", F.col("since").cast("string").alias("since"))


OP9_SQL = f"""
WITH fixed(pattern, action, day) AS (VALUES {", ".join(f"('{p}', '{a}', DATE '{d}')" for p, a, d in LIST)}),
captures AS (
  SELECT page_id, url, DATE '2024-01-01' + CAST((page_id * 37) % 366 AS INT) AS day,
    nullif(regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1)), '^.*@', ''), ':[0-9]*$', ''), '') AS host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
),
hosts AS (
  SELECT host, DATE '2024-01-01' + CAST(CAST('0x' || substr(md5(host), 2, 4) AS INT) % 366 AS INT) AS added, 1 + CAST('0x' || substr(md5(host), 6, 4) AS INT) % 90 AS days
  FROM (SELECT DISTINCT host FROM captures WHERE host IS NOT NULL) WHERE substr(md5(host), 1, 1) IN ('0', '1', '2', '3')
),
entries AS (
  SELECT DISTINCT * FROM (SELECT * FROM fixed UNION ALL SELECT host, 'add', added FROM hosts UNION ALL SELECT host, 'remove', added + days FROM hosts)
),
listed AS (
  SELECT pattern, day AS since, until FROM (SELECT *, lead(day) OVER (PARTITION BY pattern ORDER BY day, action) AS until FROM entries)
  WHERE action = 'add' AND (until IS NULL OR until > day)
),
met AS (
  SELECT page_id, pattern, since, row_number() OVER (PARTITION BY page_id ORDER BY length(pattern) DESC, pattern DESC) AS n
  FROM captures JOIN listed
    ON (host = split_part(pattern, '/', 1) OR ends_with(host, '.' || split_part(pattern, '/', 1)))
   AND (NOT contains(pattern, '/') OR path || '/' LIKE '/' || substr(pattern, strpos(pattern, '/') + 1) || '/%')
   AND since <= day AND (until IS NULL OR day < until)
)
SELECT page_id, host, CAST(day AS VARCHAR) AS fetched_on, pattern IS NOT NULL AS blocked, pattern AS rule, CAST(since AS VARCHAR) AS since
FROM captures LEFT JOIN (SELECT * FROM met WHERE n = 1) m USING (page_id)
"""
