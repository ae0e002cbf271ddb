"""URL filtering by a temporal list join, in DataFrame operations only.

A list is a table of dated entries: (list_name, kind, pattern, action, since, seq), kind one of 'domain' (that
host and everything below it), 'host' (that host alone) and 'path' (host/first path segment); action 'add' or
'drop'. Each list's entries for one pattern become validity intervals: an entry holds from its date until the
next one of the same list and pattern (on one date, the highest seq holds). Every capture asks, as of its fetch
time, which entries of action 'add' are in force for its host, its parent domains and its path; the most specific
decides (path, host, then the longest domain; among equals an allow list, then the first list by name).

A list of at most BROADCAST_ROWS intervals (counted) is broadcast; a longer one is joined by a shuffle in which
captures are salted and the list repeated, so that a host with a third of all captures is split.

Null or malformed URLs and null fetch times match nothing and are allowed; list rows with a null pattern or date
are ignored; repeated captures give repeated rows; empty captures or an empty list are fine; columns of captures
other than page_id, url and fetched are left behind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Intervals that are broadcast at most, and salts of the shuffle join beyond it.
BROADCAST_ROWS, SALTS = 100_000, 32

# A dated list for the query over pages. Lists named allow_* let through what others block.
ENTRIES = [
    ("gambling", "domain", "casino-win.example.net", "add", "2024-02-01", 1),
    ("gambling", "domain", "casino-win.example.com", "add", "2024-02-01", 2),
    ("gambling", "domain", "casino-win.example.net", "drop", "2024-09-15", 3),
    ("gambling", "domain", "casino-win.example.net", "add", "2025-01-10", 4),
    ("gambling", "domain", "free-bets.example.net", "add", "2024-01-01", 5),
    ("gambling", "domain", "free-bets.example.net", "drop", "2024-06-30", 6),
    ("pharmacy", "domain", "cheap-pills.example.net", "add", "2024-03-05", 7),
    ("pharmacy", "host", "m.cheap-pills.example.net", "add", "2024-01-15", 8),
    ("adult", "domain", "adult-x.example.com", "add", "2024-01-01", 9),
    ("tracking", "domain", "ads-track.example.com", "add", "2024-05-20", 10),
    ("tracking", "domain", "ads-track.example.com", "drop", "2024-05-20", 11),
    ("tracking", "domain", "ads-track.example.com", "add", "2024-07-01", 12),
    ("spam", "domain", "spam-farm.example.org", "add", "2024-01-20", 13),
    ("spam", "domain", "spam-farm.example.org", "drop", "2025-06-01", 14),
    ("spam", "path", "tionsh.example.net/fr", "add", "2024-04-01", 15),
    ("spam", "host", "blog.tionble.example.com", "add", "2024-08-01", 16),
    ("spam", "host", "blog.tionble.example.com", "drop", "2024-11-01", 17),
    ("allow_research", "path", "spam-farm.example.org/en", "add", "2024-10-01", 18),
    ("allow_research", "domain", "adult-x.example.com", "add", "2025-03-01", 19),
    ("allow_research", "path", "tionsh.example.net/fr", "add", "2025-02-01", 20),
]
#: The pages table has no fetch time: the query takes noon of a day in 2024 or 2025 that follows from page_id.
FIRST_DAY, DAYS = "2024-01-01", 730


def entries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ENTRIES, "list_name string, kind string, pattern string, action string, since string, seq int").withColumn("since", F.to_timestamp("since"))


def intervals(listed: DataFrame) -> DataFrame:
    """list_name, key, rank, valid_from, valid_to (null: still in force) of every time an entry is in force."""
    same = Window.partitionBy("list_name", "kind", "pattern").orderBy("since", "seq")
    pattern = F.lower(F.trim("pattern"))
    return (
        listed.where("pattern is not null and since is not null and kind in ('domain', 'host', 'path')")
        .select("list_name", "kind", pattern.alias("pattern"), "action", "since", "seq")
        .withColumn("valid_to", F.lead("since").over(same))
        .where("action = 'add' and (valid_to is null or valid_to > since)")
        .select("list_name", F.concat("kind", F.lit(":"), "pattern").alias("key"), F.when(F.col("kind") == "path", 3).when(F.col("kind") == "host", 2).otherwise(1).alias("rank"), F.col("since").alias("valid_from"), "valid_to")
    )


def with_keys(captures: DataFrame) -> DataFrame:
    """host, and the list keys that concern each capture."""
    url = F.lower(F.trim(F.col("url").cast("string")))
    got = captures.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("fetched").cast("timestamp").alias("fetched"),
        F.nullif(F.regexp_replace(F.regexp_extract(url, r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), r"\.+$", ""), F.lit("")).alias("host"),
        F.regexp_extract(url, r"^[a-z][a-z0-9+.-]*://[^/?#]*/([^/?#]+)", 1).alias("first"),
    )
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("domain:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    # a path entry may be kept for a parent domain, too
    paths = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("path:"), F.array_join(F.slice(labels, i, F.size(labels)), "."), F.lit("/"), F.col("first")))
    keys = F.concat(parents, F.array(F.concat(F.lit("host:"), "host")), F.when(F.col("first") != "", paths).otherwise(F.array().cast("array<string>")))
    return got.withColumn("keys", F.when(F.col("host").isNotNull() & F.col("fetched").isNotNull(), F.array_distinct(keys)).otherwise(F.array().cast("array<string>"))).drop("first")


def evaluate(captures: DataFrame, listed: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """page_id, url, host, fetched, blocked, list_name and entry that decided, since when, and how many entries were in force."""
    spans = intervals(listed).withColumnRenamed("key", "list_key")
    asked = with_keys(captures)
    same = ["page_id", "url", "host", "fetched"]
    narrow = asked.select(*same, F.explode("keys").alias("key"))
    on = (F.col("key") == F.col("list_key")) & (F.col("valid_from") <= F.col("fetched")) & (F.col("valid_to").isNull() | (F.col("fetched") < F.col("valid_to")))
    if spans.limit(broadcast_rows + 1).count() <= broadcast_rows:
        met = narrow.join(F.broadcast(spans), on)
    else:
        narrow = narrow.withColumn("salt", F.pmod(F.xxhash64(*same), F.lit(SALTS)).cast("int"))
        spans = spans.withColumn("list_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = narrow.join(spans, on & (F.col("salt") == F.col("list_salt")))
    one = F.struct("rank", F.length("key").alias("size"), F.col("list_name").startswith("allow_").alias("allow"), "list_name", "key", "valid_from")
    hits = met.groupBy(*same).agg(F.collect_set(one).alias("live"))  # at most a few entries for each capture
    left, right = asked.select(*same).alias("l"), hits.alias("r")
    match = F.lit(True)
    for c in same:
        match = match & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    live = left.join(right, match, "left").select(*[F.col(f"l.{c}").alias(c) for c in same], F.coalesce("live", F.array().cast("array<struct<rank:int,size:int,allow:boolean,list_name:string,key:string,valid_from:timestamp>>")).alias("live"))
    best = F.array_sort("live", lambda a, b: F.when(a["rank"] != b["rank"], b["rank"] - a["rank"]).when(a["size"] != b["size"], b["size"] - a["size"]).when(a["allow"] != b["allow"], F.when(a["allow"], -1).otherwise(1)).when(a["list_name"] < b["list_name"], -1).when(a["list_name"] > b["list_name"], 1).otherwise(0))
    return live.withColumn("best", F.get(best, F.lit(0))).select(
        "page_id", "url", "host", "fetched",
        (F.col("best").isNotNull() & ~F.coalesce(F.col("best.allow"), F.lit(False))).alias("blocked"),
        F.col("best.list_name").alias("list_name"), F.col("best.key").alias("entry"), F.col("best.valid_from").alias("valid_from"),
        F.size("live").cast("long").alias("n_active"),
    )


def page_captures(pages: DataFrame) -> DataFrame:
    day = F.expr(f"date_add(date'{FIRST_DAY}', cast(pmod(page_id, {DAYS}) as int))")
    return pages.select("page_id", "url", (day.cast("timestamp") + F.expr("interval 12 hours")).alias("fetched"))


ORACLE = f"""
WITH list(list_name, kind, pattern, action, since, seq) AS (VALUES {", ".join(f"('{a}', '{b}', '{c}', '{d}', TIMESTAMP '{e} 00:00:00', {f})" for a, b, c, d, e, f in ENTRIES)}),
led AS (SELECT *, lead(since) OVER (PARTITION BY list_name, kind, pattern ORDER BY since, seq) AS valid_to FROM list),
spans AS (SELECT list_name, kind, pattern, kind || ':' || pattern AS key, CASE kind WHEN 'path' THEN 3 WHEN 'host' THEN 2 ELSE 1 END AS rank,
  since AS valid_from, valid_to FROM led WHERE action = 'add' AND (valid_to IS NULL OR valid_to > since)),
caps AS (SELECT page_id, url, TIMESTAMP '{FIRST_DAY} 12:00:00' + to_days(CAST(page_id % {DAYS} AS INTEGER)) AS fetched,
  nullif(regexp_replace(regexp_extract(lower(trim(url)), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), '[.]+$', ''), '') AS host,
  regexp_extract(lower(trim(url)), '^[a-z][a-z0-9+.-]*://[^/?#]*/([^/?#]+)', 1) AS first FROM pages),
hits AS (SELECT c.page_id, s.* FROM caps c JOIN spans s ON c.fetched >= s.valid_from AND (s.valid_to IS NULL OR c.fetched < s.valid_to) AND
  ((s.kind = 'host' AND c.host = s.pattern) OR (s.kind = 'domain' AND (c.host = s.pattern OR ends_with(c.host, '.' || s.pattern)))
   OR (s.kind = 'path' AND (c.host || '/' || c.first = s.pattern OR ends_with(c.host || '/' || c.first, '.' || s.pattern))))),
best AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY rank DESC, length(key) DESC, starts_with(list_name, 'allow_') DESC, list_name) AS k,
  count(*) OVER (PARTITION BY page_id) AS n FROM hits)
SELECT c.page_id, c.url, c.host, c.fetched, b.list_name IS NOT NULL AND NOT starts_with(b.list_name, 'allow_') AS blocked,
  b.list_name, b.key AS entry, b.valid_from, coalesce(b.n, 0) AS n_active
FROM caps c LEFT JOIN best b ON c.page_id = b.page_id AND b.k = 1
"""
