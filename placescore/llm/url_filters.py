"""URL filtering against dated lists: entries become validity intervals, captures meet them as of their fetch time.

DataFrame operations only. The list is joined by equality on a host suffix, so a capture meets only entries that could
apply; captures are first reduced to distinct (host, day), so a host with a third of all captures is a few hundred rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placescore.llm.common import query, table

#: Longest chain of host suffixes that is looked up; the name system allows at most 127 labels.
MAX_LABELS = 127


def host_of(url: Column) -> Column:
    """Lower-case host of an absolute URL without user info, port, or trailing dots; null where there is none."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*+://(?:[^/?#@]*+@)?([^/?#:]*+)", 1)
    host = F.regexp_replace(F.lower(rest), r"\.+$", "")
    return F.when(host != "", host)


def suffixes(host: Column) -> Column:
    """The host itself and each parent domain: a.b.c -> [a.b.c, b.c, c]."""
    labels = F.split(host, r"\.")
    n = F.least(F.size(labels), F.lit(MAX_LABELS))
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, F.size(labels) - i + 1, i), "."))


def intervals(entries: DataFrame) -> DataFrame:
    """Dated entries (key, since, action, category) as intervals [since, until) of what each list said.

    ``action`` is 'add' or 'remove'. A list is a category; of several entries of one key, category and date a removal wins.
    Rows with a null key, date, action or category say nothing and are left out, as are unknown actions. Repeated rows count once. At most
    one row per key, category and date reaches the window, so a key is never more than its distinct dates.
    """
    known = entries.where(F.col("action").isin("add", "remove") & F.col("key").isNotNull() & F.col("since").isNotNull() & F.col("category").isNotNull())
    daily = known.groupBy(F.lower("key").alias("key"), "category", "since").agg(F.max("action").alias("action"))
    w = Window.partitionBy("key", "category").orderBy("since")
    spans = daily.withColumn("until", F.lead("since").over(w)).where("action = 'add'")
    return spans.select("key", "category", "since", "until")


def judge(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """Id, host, fetch date, number of active entries, the deciding (longest) key, its category and ``allowed`` per capture.

    Among active entries the longest key decides, ties to the smallest category. A capture without host or fetch time
    meets no entry and is allowed. Repeated captures are judged each; empty lists allow everything; an empty capture table gives an empty result.
    """
    seen = captures.select(F.col(id_col).alias("_id"), host_of(F.col(url_col).cast("string")).alias("host"), F.col(time_col).cast("date").alias("fetched"))
    asked = seen.where("host IS NOT NULL AND fetched IS NOT NULL").select("host", "fetched").distinct()
    keyed = asked.select("host", "fetched", F.explode(suffixes(F.col("host"))).alias("key"))
    valid = intervals(entries)
    hit = keyed.join(valid, "key").where((F.col("fetched") >= F.col("since")) & (F.col("until").isNull() | (F.col("fetched") < F.col("until"))))
    best = F.max_by(F.struct("key", "category"), F.struct(F.length("key"), -F.col("_rank")))
    ranked = hit.withColumn("_rank", F.dense_rank().over(Window.partitionBy("host", "fetched", "key").orderBy("category")))
    verdicts = ranked.groupBy("host", "fetched").agg(F.count("*").alias("active"), best.alias("best"))
    out = seen.join(verdicts, ["host", "fetched"], "left")
    return out.select(
        F.col("_id").alias(id_col),
        "host",
        "fetched",
        F.coalesce("active", F.lit(0).cast("bigint")).alias("active"),
        F.col("best.key").alias("decided_by"),
        F.col("best.category").alias("category"),
        F.col("active").isNull().alias("allowed"),
    )


def page_captures(pages: DataFrame) -> DataFrame:
    """The page table has no fetch time; one day of 2024 follows from the id."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 7919, F.lit(366)).cast("int")).alias("fetched"))


def page_list(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts and parent domains seen in the pages: which, when and what follow from a digest of the key."""
    keys = pages.select(host_of(F.col("url")).alias("host")).distinct().where("host IS NOT NULL").select(F.explode(suffixes(F.col("host"))).alias("key")).distinct()
    turn = keys.select("key", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("turn")).where("key LIKE '%.%'")
    nibble = lambda at, n: F.conv(F.substring(F.md5(F.concat_ws("#", "key", "turn")), at, n), 16, 10).cast("int")
    return turn.where(nibble(1, 1) < 5).select(
        "key",
        F.date_add(F.lit("2024-01-01").cast("date"), nibble(2, 3) % 366).alias("since"),
        F.when(nibble(5, 1) < 9, "add").otherwise("remove").alias("action"),
        F.element_at(F.array(*[F.lit(x) for x in ("adult", "malware", "spam")]), nibble(6, 1) % 3 + 1).alias("category"),
    )


SQL = r"""
WITH p AS (
  SELECT page_id, nullif(regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '\.+$', ''), '') AS host,
         CAST(DATE '2024-01-01' + CAST((page_id * 7919) % 366 AS INTEGER) AS DATE) AS fetched FROM pages),
h AS (SELECT DISTINCT host, string_split(host, '.') AS l FROM p WHERE host IS NOT NULL),
k AS (SELECT DISTINCT host, array_to_string(l[i:len(l)], '.') AS key FROM (SELECT host, l, unnest(range(1, len(l) + 1)) AS i FROM h)),
t AS (SELECT key, turn, md5(key || '#' || turn) AS m FROM (SELECT DISTINCT key FROM k WHERE contains(key, '.')), range(0, 6) r(turn)),
e AS (SELECT key, CAST(DATE '2024-01-01' + CAST(('0x' || m[2:4])::INTEGER % 366 AS INTEGER) AS DATE) AS since,
             CASE WHEN ('0x' || m[5:5])::INTEGER < 9 THEN 'add' ELSE 'remove' END AS action,
             ['adult', 'malware', 'spam'][('0x' || m[6:6])::INTEGER % 3 + 1] AS category
      FROM t WHERE ('0x' || m[1:1])::INTEGER < 5),
d AS (SELECT key, category, since, max(action) AS action FROM e GROUP BY ALL),
v AS (SELECT *, lead(since) OVER (PARTITION BY key, category ORDER BY since) AS until FROM d),
hit AS (SELECT page_id, k.key, category FROM p JOIN k USING (host) JOIN v ON v.key = k.key AND action = 'add' AND fetched >= since AND (until IS NULL OR fetched < until)),
n AS (SELECT page_id, count(*) AS active FROM hit GROUP BY 1),
b AS (SELECT page_id, key, category FROM hit QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(key) DESC, category) = 1)
SELECT p.page_id, p.host, p.fetched, coalesce(n.active, 0) AS active, b.key AS decided_by, b.category, n.active IS NULL AS allowed
FROM p LEFT JOIN n USING (page_id) LEFT JOIN b USING (page_id)
"""


@query("op9_url_filters", SQL)
def op9(spark, sf):
    pages = table(spark, sf, "pages")
    return judge(page_captures(pages), page_list(pages))
