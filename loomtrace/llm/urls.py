"""URL filters by a temporal list join.

A list is a log of dated entries: from a day on, a host suffix has a category and is blocked or
not, until its next entry. Entries become validity intervals, one row each; every capture looks up
the suffixes of its host and takes, among the intervals that hold at its fetch time, the one of the
longest suffix. Intervals are dealt by suffix and stretch of time, so a capture meets only what held
around its fetch time, and a suffix that a third of the captures have is split by time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtrace.llm._common import stored

START = "2024-01-01"
CATEGORIES = ("spam", "adult", "malware", "tracking")
#: Days of a stretch of time that intervals are dealt by.
STRETCH = 32
#: Rows of dealt intervals that a broadcast may hold; beyond it the same join shuffles.
BROADCAST_ROWS = 200_000


def host(url: Column) -> Column:
    """Lower-case host of a URL without user, port and final dots; null if there is none.

    Blanks and controls around the URL go. The scheme may be missing (//host/x, or host.tld/x with a
    dot in the host); a backslash ends the authority as a slash does. An IPv6 host comes without
    brackets. Escapes and names in other scripts stay as written.
    """
    u = F.regexp_replace(url, r"^[\x00-\x20]+|[\x00-\x20]+$", "")
    full = F.regexp_extract(u, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?[/\\]{2}([^/?#\\]*)", 1)
    bare = F.regexp_extract(u, r"^([^/?#\\:@\s]+\.[^/?#\\:@\s]*(?::[0-9]*)?)(?:[/?#\\]|$)", 1)
    named = F.regexp_replace(F.when(full != "", full).otherwise(bare), "^.*@", "")
    got = F.when(named.startswith("["), F.regexp_extract(named, r"^\[([^\]]*)", 1)).otherwise(F.regexp_extract(named, "^([^:]*)", 1))
    return F.nullif(F.regexp_replace(F.lower(got), r"\.+$", ""), F.lit(""))


def suffixes(hosts: DataFrame) -> DataFrame:
    """hosts with each suffix of their host and its depth in labels: a row for each, of any depth."""
    deep = hosts.withColumn("depth", F.explode(F.sequence(F.lit(1), F.size(F.split("host", r"\.")))))
    return deep.withColumn("suffix", F.expr("substring_index(host, '.', -depth)"))


def intervals(entries: DataFrame) -> DataFrame:
    """(suffix, since, until, category, blocked) of entries (suffix, since, category, blocked): each
    entry holds from its date up to the next one of its suffix. Suffixes are lower-cased; a leading
    "*." or "." and final dots go. Of entries of one suffix and date the blocking one holds, then the
    one of the first category. Entries without suffix or date are left out; blocked null is false."""
    clean = F.regexp_replace(F.lower(F.trim("suffix")), r"^\*?\.+|\.+$", "")
    one = entries.select(clean.alias("suffix"), "since", "category", "blocked").filter("suffix <> '' AND since IS NOT NULL").groupBy("suffix", "since").agg(
        F.min(F.struct(F.when(F.col("blocked"), 0).otherwise(1).alias("k"), "category")).alias("e"))
    until = F.lead("since").over(W.partitionBy("suffix").orderBy("since"))
    return one.select("suffix", "since", until.alias("until"), F.col("e.category").alias("category"), (F.col("e.k") == 0).alias("blocked"))


def _stretch(at: Column) -> Column:
    return F.floor(F.datediff(F.to_date(at), F.lit("1970-01-01").cast("date")) / STRETCH).cast("int")


def filter_captures(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures with host, entry (the deciding suffix), category and blocked (false without entry).

    captures have url and fetched (a date or a timestamp). Null or unreadable URLs have a null host;
    they and captures without a fetch time match nothing. Of the intervals that hold, the longest
    suffix decides; a suffix has one interval at a time, so there are no ties. Repeated rows stay. An
    empty list blocks nothing, an empty table stays empty. Columns named host, entry, category or
    blocked are replaced; all others stay, whatever their names. Distinct (host, fetch time) pairs are
    looked up once.
    """
    own = [c for c in captures.columns if c.lower() not in ("host", "entry", "category", "blocked")]
    base = captures.select(F.struct(*own).alias("row"), host(F.col("url")).alias("host"), F.col("fetched").alias("fetched"))
    asked = base.filter("host IS NOT NULL AND fetched IS NOT NULL").select("host", "fetched").distinct()
    seen = captures.agg(F.min("fetched").alias("lo"), F.max("fetched").alias("hi"))
    live = intervals(entries).join(F.broadcast(seen), F.expr("since <= hi AND (until IS NULL OR until > lo)"))
    dealt = stored(live.select(
        F.col("suffix").alias("listed"), "since", "until", "category", "blocked",
        F.explode(F.sequence(_stretch(F.greatest("since", "lo")), _stretch(F.least(F.coalesce("until", "hi"), "hi")))).alias("at")), "url-intervals")
    side = F.broadcast(dealt) if dealt.count() <= BROADCAST_ROWS else dealt
    deep = suffixes(asked).withColumn("stretch", _stretch(F.col("fetched")))
    hit = deep.join(side, F.expr("suffix = listed AND stretch = at AND since <= fetched AND (until IS NULL OR fetched < until)"))
    best = hit.groupBy("host", "fetched").agg(F.max(F.struct("depth", "suffix", "category", "blocked")).alias("m"))
    return base.join(best, ["host", "fetched"], "left").select(
        "row.*", "host", F.col("m.suffix").alias("entry"), F.col("m.category").alias("category"), F.coalesce("m.blocked", F.lit(False)).alias("blocked"))


def _number(text: Column, start: int, n: int) -> Column:
    return F.conv(F.substring(F.md5(text), start, n), 16, 10).cast("long")


def dated(pages: DataFrame) -> DataFrame:
    """pages with a fetch date of 2024, which the table lacks: its id sets the day of the year."""
    day = F.pmod("page_id", F.lit(366)).cast("int")
    return pages.select("page_id", "url").withColumn("fetched", F.date_add(F.to_date(F.lit(START)), day))


def list_from_hosts(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts of pages and their parents, with the digest of a name as chance:
    a third of the names are listed, of them half are released and a quarter listed again."""
    hosts = pages.select(host(F.col("url")).alias("host"))
    names = hosts.select(F.explode(F.array("host", F.expr("substr(host, instr(host, '.') + 1)"))).alias("suffix")).filter("contains(suffix, '.')").distinct()
    s = F.col("suffix")
    chosen = names.filter(_number(s, 1, 2) % 3 == 0)
    first = F.date_add(F.to_date(F.lit(START)), (_number(s, 3, 3) % 200).cast("int"))
    entry = lambda days, blocked: F.struct(F.date_add(first, days).alias("since"), F.lit(blocked).alias("blocked"))
    steps = F.when(_number(s, 6, 1) % 4 == 0, F.array(entry(0, True), entry(40, False), entry(90, True))).when(
        _number(s, 6, 1) % 4 == 1, F.array(entry(0, True), entry(60, False))).otherwise(F.array(entry(0, True)))
    category = F.element_at(F.array(*map(F.lit, CATEGORIES)), (_number(s, 7, 2) % 4 + 1).cast("int"))
    return chosen.select("suffix", category.alias("category"), F.explode(steps).alias("e")).select("suffix", "e.since", "category", "e.blocked")


ORACLE = r"""
WITH b AS (SELECT page_id, url, replace(trim(url), '\', '/') AS t FROM pages),
s AS (SELECT *, strpos(t, '//') AS p FROM b),
a AS (SELECT *, CASE WHEN p = 1 OR (p > 2 AND substr(t, p - 1, 1) = ':' AND strpos(substr(t, 1, p - 1), '/') = 0 AND strpos(substr(t, 1, p - 1), '?') = 0 AND strpos(substr(t, 1, p - 1), '#') = 0)
                     THEN split_part(split_part(split_part(substr(t, p + 2), '/', 1), '?', 1), '#', 1)
                     WHEN contains(split_part(split_part(split_part(split_part(t, '/', 1), '?', 1), '#', 1), ':', 1), '.') AND NOT contains(split_part(t, '/', 1), '@')
                     THEN split_part(split_part(split_part(t, '/', 1), '?', 1), '#', 1) END AS authority FROM s),
h AS (SELECT *, string_split(authority, '@')[-1] AS named FROM a),
p AS (SELECT page_id, url, nullif(rtrim(lower(CASE WHEN starts_with(named, '[') THEN split_part(substr(named, 2), ']', 1) ELSE split_part(named, ':', 1) END), '.'), '') AS host,
             DATE '2024-01-01' + (page_id % 366)::INT AS fetched FROM h),
l AS (SELECT *, string_split(host, '.') AS parts FROM p),
deep AS (SELECT page_id, fetched, k, array_to_string(parts[len(parts) - k + 1 : len(parts)], '.') AS suffix FROM l, unnest(range(1, len(parts) + 1)) AS t(k)),
names AS (SELECT DISTINCT array_to_string(parts[i : len(parts)], '.') AS suffix FROM l, unnest(range(1, least(len(parts), 2) + 1)) AS t(i)),
n AS (SELECT suffix, md5(suffix) AS h FROM names WHERE contains(suffix, '.')),
c AS (SELECT suffix, DATE '2024-01-01' + (('0x' || substr(h, 3, 3))::BIGINT % 200)::INT AS d, ('0x' || substr(h, 6, 1))::BIGINT % 4 AS kind,
             (['spam', 'adult', 'malware', 'tracking'])[('0x' || substr(h, 7, 2))::BIGINT % 4 + 1] AS category
      FROM n WHERE ('0x' || substr(h, 1, 2))::BIGINT % 3 = 0),
e AS (SELECT suffix, d AS since, category, true AS blocked FROM c
      UNION ALL SELECT suffix, d + (CASE kind WHEN 0 THEN 40 ELSE 60 END)::INT, category, false FROM c WHERE kind IN (0, 1)
      UNION ALL SELECT suffix, d + 90, category, true FROM c WHERE kind = 0),
v AS (SELECT *, lead(since) OVER (PARTITION BY suffix ORDER BY since) AS until FROM e),
m AS (SELECT deep.page_id, arg_max(v.suffix, k) AS entry, arg_max(category, k) AS category, arg_max(blocked, k) AS blocked
      FROM deep JOIN v ON deep.suffix = v.suffix AND fetched >= since AND (until IS NULL OR fetched < until) GROUP BY deep.page_id)
SELECT p.page_id, p.url, p.host, p.fetched::VARCHAR AS fetched, m.entry, m.category, coalesce(m.blocked, false) AS blocked FROM p LEFT JOIN m ON p.page_id = m.page_id
"""
