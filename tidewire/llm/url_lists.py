"""URL filters [native]: a temporal list join.

Dated list entries (add, remove) become validity intervals; an as-of join holds
every capture against the entries that were active when it was fetched.

An entry names a host, a registered domain (with all hosts below it) or a URL
prefix without scheme.  ``action`` is block or allow.  The most specific active
entry decides: prefix before host before longer domain before shorter domain;
allow wins a tie.

Defined cases: a null or unparsable URL, or a null fetch time, matches nothing;
repeated captures give a row each; repeated entries of one date count once, and
at one instant a removal comes before an addition; an empty list blocks nothing.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table

#: Size up to which the interval table is broadcast, in rows; beyond it the join shuffles on the key.
BROADCAST_ROWS = 50_000
FOREVER = "9999-12-31 00:00:00"


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and leading www."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    bare = F.regexp_replace(F.regexp_replace(F.lower(authority), r"^[^@]*@", ""), r":[0-9]*$", "")
    return F.regexp_replace(bare, r"^www\.", "")


def address_of(url: Column) -> Column:
    """Host and path, as prefix entries name them."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.concat(host_of(url), path)


def intervals(entries: DataFrame) -> DataFrame:
    """(key, kind, action, valid_from, valid_to) from dated events (key, kind, action, op add|remove, at).

    An entry is active from an add to the next remove of the same key, kind and action.
    """
    by = Window.partitionBy("key", "kind", "action").orderBy("at")
    # one state per entry and instant: an add outlasts a removal of the same instant
    states = entries.where(F.col("key").isNotNull() & F.col("at").isNotNull()).groupBy("key", "kind", "action", "at").agg(F.max(F.col("op") == "add").alias("on"))
    changes = states.withColumn("was", F.coalesce(F.lag("on").over(by), F.lit(False))).where(F.col("on") != F.col("was"))
    ends = changes.withColumn("valid_to", F.coalesce(F.lead("at").over(by), F.lit(FOREVER).cast("timestamp")))
    return ends.where("on").select("key", "kind", "action", F.col("at").alias("valid_from"), "valid_to")


def _keys(host: Column, address: Column) -> Column:
    """Every (kind, key, rank) under which an entry could name this capture."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    domains = F.transform(
        F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
        lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, n), ".").alias("key"), (n - i + 1).cast("int").alias("rank")),
    )
    parts = F.split(address, "/")
    depth = F.size(parts)
    prefixes = F.transform(
        F.sequence(F.lit(2), F.greatest(depth, F.lit(2))),
        lambda i: F.struct(F.lit("prefix").alias("kind"), F.array_join(F.slice(parts, 1, i), "/").alias("key"), (F.lit(2000) + i).cast("int").alias("rank")),
    )
    whole = F.array(F.struct(F.lit("host").alias("kind"), host.alias("key"), F.lit(1000).alias("rank")))
    return F.concat(whole, F.when(n >= 2, domains).otherwise(F.slice(domains, 1, 0)), F.when(depth >= 2, prefixes).otherwise(F.slice(prefixes, 1, 0)))


def filter_captures(captures: DataFrame, entries: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Each capture (id, url, fetched_at) with host, blocked, and the deciding entry (null if none)."""
    active = intervals(entries)
    own = captures.select(F.col(id_col).alias("id"), "url", "fetched_at")
    asked = own.where("url IS NOT NULL AND fetched_at IS NOT NULL").select("url", "fetched_at").distinct()
    keyed = asked.select("url", "fetched_at", host_of(F.col("url")).alias("host"), address_of(F.col("url")).alias("address")).where("host <> ''")
    keyed = keyed.select("url", "fetched_at", F.explode(_keys(F.col("host"), F.col("address"))).alias("k")).select("url", "fetched_at", "k.*")
    active = F.broadcast(active) if active.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else active
    hits = keyed.join(active, ["key", "kind"]).where("valid_from <= fetched_at AND fetched_at < valid_to")
    order = F.struct("rank", (F.col("action") == "allow").alias("allows"), "key", "valid_from")
    best = hits.groupBy("url", "fetched_at").agg(F.max_by(F.struct("kind", "key", "action", "valid_from", "valid_to"), order).alias("by"), F.count("*").alias("n_active"))
    return own.join(best, ["url", "fetched_at"], "left").select(
        F.col("id").alias(id_col), F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"), "fetched_at",
        F.coalesce(F.col("by.action") == "block", F.lit(False)).alias("blocked"), F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"),
        F.col("by.kind").alias("entry_kind"), F.col("by.key").alias("entry_key"), F.col("by.action").alias("entry_action"), F.col("by.valid_from").alias("valid_from"), F.col("by.valid_to").alias("valid_to"),
    )


def _number(h: Column, at: int, width: int) -> Column:
    return F.conv(F.substring(h, at, width), 16, 10).cast("int")


def captures_of(pages: DataFrame) -> DataFrame:
    """The pages with a fetch time spread over the year 2024, set by page_id."""
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return pages.select("page_id", "url", F.timestamp_seconds(F.unix_timestamp(start) + F.pmod(F.col("page_id") * 7919, F.lit(31_536_000))).alias("fetched_at"))


def entries_of(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts of the pages, set by the MD5 of each name: hosts and their parent domains are blocked, lifted and blocked again; one path is allowed for a time."""
    start = F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    hosts = pages.where("url IS NOT NULL").select(host_of(F.col("url")).alias("host")).where("host <> ''").distinct()
    domains = hosts.select(F.substring_index("host", ".", -3).alias("key")).distinct()
    named = hosts.select(F.col("host").alias("key"), F.lit("host").alias("kind"), F.lit("block").alias("action"), F.lit("012345").alias("from"))
    named = named.unionByName(domains.select("key", F.lit("domain").alias("kind"), F.lit("block").alias("action"), F.lit("01").alias("from")))
    named = named.unionByName(hosts.select(F.concat("host", F.lit("/en")).alias("key"), F.lit("prefix").alias("kind"), F.lit("allow").alias("action"), F.lit("0123").alias("from")))
    h = F.md5("key")
    chosen = named.where(F.expr("instr(from, substr(md5(key), 1, 1)) > 0")).select("key", "kind", "action", _number(h, 2, 2).alias("day"), _number(h, 4, 2).alias("stay"))
    steps = F.array(F.struct(F.lit("add").alias("op"), F.col("day").alias("d")), F.struct(F.lit("remove").alias("op"), (F.col("day") + F.col("stay")).alias("d")), F.struct(F.lit("add").alias("op"), (F.col("day") + 2 * F.col("stay")).alias("d")))
    return chosen.select("key", "kind", "action", F.explode(steps).alias("s")).select("key", "kind", "action", "s.op", F.timestamp_seconds(start + F.col("s.d") * 86_400).alias("at"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a capture, held against the list of its year; fetch times in epoch seconds, validity as dates."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    out = filter_captures(captures_of(pages), entries_of(pages))
    days = {c: F.date_format(c, "yyyy-MM-dd") for c in ("valid_from", "valid_to")}
    return out.withColumns({"fetched_at": F.unix_timestamp("fetched_at"), **days})


OP2_SQL = r"""
WITH captures AS (
  SELECT page_id, url, 1704067200::BIGINT + (page_id * 7919) % 31536000 AS fetched_at,
         regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^[^@]*@', ''), ':[0-9]*$', ''), '^www\.', '') AS host,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
hosts AS (SELECT DISTINCT host FROM captures WHERE host <> ''),
domains AS (SELECT DISTINCT array_to_string(string_split(host, '.')[-3:], '.') AS key FROM hosts),
named AS (
  SELECT host AS key, 'host' AS kind, 'block' AS action, '012345' AS hits FROM hosts
  UNION ALL SELECT key, 'domain', 'block', '01' FROM domains
  UNION ALL SELECT host || '/en', 'prefix', 'allow', '0123' FROM hosts),
chosen AS (
  SELECT key, kind, action, ('0x' || substr(md5(key), 2, 2))::INT AS day, ('0x' || substr(md5(key), 4, 2))::INT AS stay
  FROM named WHERE instr(hits, substr(md5(key), 1, 1)) > 0),
events_ AS (
  SELECT key, kind, action, TRUE AS adds, 1704067200::BIGINT + day * 86400 AS at_s FROM chosen
  UNION ALL SELECT key, kind, action, FALSE, 1704067200::BIGINT + (day + stay) * 86400 FROM chosen
  UNION ALL SELECT key, kind, action, TRUE, 1704067200::BIGINT + (day + 2 * stay) * 86400 FROM chosen),
states AS (SELECT key, kind, action, at_s, bool_or(adds) AS active FROM events_ GROUP BY ALL),
changes AS (SELECT *, coalesce(lag(active) OVER (PARTITION BY key, kind, action ORDER BY at_s), FALSE) AS was FROM states),
spans AS (
  SELECT *, coalesce(lead(at_s) OVER (PARTITION BY key, kind, action ORDER BY at_s), 253402300800 - 86400) AS valid_to
  FROM changes WHERE active <> was),
active AS (SELECT key, kind, action, at_s AS valid_from, valid_to FROM spans WHERE active),
asked AS (SELECT DISTINCT url, host, path, fetched_at FROM captures WHERE host <> '' AND url IS NOT NULL),
keyed AS (
  SELECT url, fetched_at, 'host' AS kind, host AS key, 1000 AS rank FROM asked
  UNION ALL
  SELECT url, fetched_at, 'domain', array_to_string(string_split(host, '.')[i:], '.'), len(string_split(host, '.')) - i + 1
  FROM asked, range(1, len(string_split(host, '.'))) AS r(i)
  UNION ALL
  SELECT url, fetched_at, 'prefix', array_to_string(string_split(host || path, '/')[:i], '/'), 2000 + i
  FROM asked, range(2, len(string_split(host || path, '/')) + 1) AS r(i)),
hits AS (
  SELECT k.url, k.fetched_at, k.kind, k.key, a.action, a.valid_from, a.valid_to,
         count(*) OVER w AS n_active, row_number() OVER (w ORDER BY k.rank DESC, (a.action = 'allow') DESC, k.key DESC, a.valid_from DESC) AS place
  FROM keyed k JOIN active a USING (key, kind)
  WHERE a.valid_from <= k.fetched_at AND k.fetched_at < a.valid_to
  WINDOW w AS (PARTITION BY k.url, k.fetched_at))
SELECT c.page_id, coalesce(c.host, '') AS host, c.fetched_at, coalesce(h.action = 'block', FALSE) AS blocked, coalesce(h.n_active, 0)::BIGINT AS n_active,
       h.kind AS entry_kind, h.key AS entry_key, h.action AS entry_action, strftime(make_timestamp(h.valid_from * 1000000), '%Y-%m-%d') AS valid_from, strftime(make_timestamp(h.valid_to * 1000000), '%Y-%m-%d') AS valid_to
FROM captures c LEFT JOIN hits h ON h.url = c.url AND h.fetched_at = c.fetched_at AND h.place = 1
"""
