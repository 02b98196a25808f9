"""Queries of the operators that carry state: a reader's memory, the cache's log, chapter jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark import schema
from leafmark.operators import memory
from leafmark.plans.catalogue import query
from leafmark.plans.views import table
from leafmark.sources import changelog
from leafmark.streaming import chapters

# An error is a poll that sees no, one or two of four pages; other events visit an item.
_SEEN = "CASE WHEN event_type <> 'error' THEN NULL WHEN event_id % 5 = 0 THEN {none} WHEN event_id % 5 < 3 THEN {one} ELSE {two} END"
_ITEM = "CASE WHEN event_type <> 'error' THEN event_type || event_id % 2 END"


@query(f"""WITH RECURSIVE e AS (
  SELECT user_id, event_id, {_SEEN.format(none="[]", one="[event_id % 4]", two="[event_id % 4, event_id // 7 % 4]")} AS seen, {_ITEM} AS item, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
t AS (SELECT *, seen IS NOT NULL AND NOT list_has_any(seen, last) AND len(seen) > 0 AND len(last) > 0 AS turned
  FROM (SELECT *, CASE WHEN seen IS NOT NULL THEN coalesce(lag(seen) OVER (PARTITION BY user_id, seen IS NULL ORDER BY event_id), []) END AS last FROM e)),
f AS (
  SELECT user_id, 0::BIGINT AS n, 0::BIGINT AS epoch, []::VARCHAR[] AS items, []::BIGINT[] AS ids, NULL::VARCHAR AS active FROM (SELECT DISTINCT user_id FROM e)
  UNION ALL
  SELECT f.user_id, t.n, f.epoch + CASE WHEN t.turned THEN 1 ELSE 0 END,
    CASE WHEN t.turned THEN [] WHEN t.item IS NULL OR list_contains(f.items, t.item) THEN f.items WHEN len(f.items) = 3 THEN list_append(f.items[2:3], t.item) ELSE list_append(f.items, t.item) END,
    CASE WHEN t.turned THEN [] WHEN t.item IS NULL OR list_contains(f.items, t.item) THEN f.ids WHEN len(f.items) = 3 THEN list_append(f.ids[2:3], t.event_id) ELSE list_append(f.ids, t.event_id) END,
    CASE WHEN t.turned THEN NULL ELSE coalesce(t.item, f.active) END
  FROM f JOIN t ON t.user_id = f.user_id AND t.n = f.n + 1),
l AS (SELECT user_id, epoch, arg_max(items, n) AS items, arg_max(ids, n) AS ids, arg_max(active, n) AS active FROM f GROUP BY ALL),
u AS (SELECT user_id, epoch, unnest(items) AS item, unnest(ids) AS event_id, active, epoch = max(epoch) OVER (PARTITION BY user_id) AS current FROM l)
SELECT user_id, epoch, item, event_id, item = active AS active, current FROM u""")
def memory_with_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = _SEEN.format(none="CAST(array() AS array<bigint>)", one="array(event_id % 4)", two="array(event_id % 4, CAST(floor(event_id / 7) AS BIGINT) % 4)")
    events = table(spark, sf_dir, "events").select("user_id", "event_id", F.expr(seen).alias("seen"), F.expr(_ITEM).alias("item"))
    return memory.remembered(events, "user_id", "event_id", "seen", "item")


# What the events did to the cache: one in 499 purges it, those of 0 (mod 13) bring no data.
_KIND = "CASE WHEN event_id % 499 = 498 THEN 'purged' WHEN event_type IN ('view', 'click') THEN 'imported' WHEN event_type = 'error' THEN 'recognised' ELSE 'updated' END"
_URL = "CASE WHEN event_id % 499 <> 498 THEN 'u' || user_id END"
#: Numbers as of which the cache is asked for, as shares of the highest.
_SHARES = (0.2, 0.55, 0.83, 1.0)


@query(f"""WITH RECURSIVE e AS (SELECT event_id AS seq, {_KIND} AS kind, {_URL} AS url, event_type AS context, event_id % 13 <> 0 AS good FROM events),
numbers AS (SELECT k, CAST(floor((SELECT max(event_id) FROM events) * s) AS BIGINT) AS upto FROM (VALUES {", ".join(f"({k}, {s})" for k, s in enumerate(_SHARES))}) AS v(k, s)),
own AS (SELECT url AS u, seq, kind, context FROM e WHERE kind <> 'purged' AND good UNION ALL SELECT u.url, p.seq, p.kind, NULL FROM (SELECT DISTINCT url FROM e WHERE url IS NOT NULL) u, e p WHERE p.kind = 'purged'),
steps AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY seq) AS n FROM own),
f AS (
  SELECT DISTINCT u, 0::BIGINT AS n, -1::BIGINT AS at, NULL::VARCHAR AS context, NULL::BIGINT AS seq FROM own
  UNION ALL
  SELECT f.u, s.n, s.seq, CASE WHEN s.kind = 'purged' THEN NULL WHEN s.kind = 'imported' AND f.seq IS NOT NULL THEN f.context ELSE s.context END,
    CASE WHEN s.kind = 'purged' THEN NULL WHEN s.kind = 'imported' AND f.seq IS NOT NULL THEN f.seq ELSE s.seq END
  FROM f JOIN steps s ON s.u = f.u AND s.n = f.n + 1),
state AS (SELECT x.k, x.upto, f.u, arg_max({{'context': f.context, 'seq': f.seq}}, f.n) AS v FROM f JOIN numbers x ON f.at <= x.upto GROUP BY ALL)
SELECT upto, u AS url, v.context AS context, v.seq AS seq FROM state WHERE v.seq IS NOT NULL""")
def cache_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    data = F.when(F.expr("event_id % 13 <> 0"), F.array().cast(schema.CACHE["data"].dataType))
    log = events.select(F.col("event_id").alias("seq"), F.expr(_KIND).alias("kind"), F.expr(_URL).alias("url"), F.col("event_type").alias("context"), data.alias("data"))
    last = events.agg(F.max("event_id")).first()[0] or 0  # one number
    found = None
    for share in _SHARES:
        upto = int(last * share)
        one = changelog.replayed(log, upto).select(F.lit(upto).cast("long").alias("upto"), "url", "context", "seq")
        found = one if found is None else found.unionByName(one)
    return found


# A customer is a chapter; its orders stand for pages: one in seven numbers is in the cache, and
# those of high priority cannot be recognised.
_PAGES = "SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS page, o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' OR o_orderpriority LIKE '3%' AS bad, o_orderkey % 7 = 0 AS cached FROM orders"


@query(f"""WITH RECURSIVE p AS ({_PAGES}),
walk(chapter, page, failures, status) AS (
  SELECT c_custkey, -1::BIGINT, 0, '' FROM customer
  UNION ALL
  SELECT w.chapter, w.page + 1, CASE WHEN p.cached OR NOT p.bad THEN 0 ELSE w.failures + 1 END, CASE WHEN p.cached THEN 'cached' WHEN NOT p.bad THEN 'ready' ELSE 'failed' END
  FROM walk w LEFT JOIN p ON p.o_custkey = w.chapter AND p.page = w.page + 1 WHERE w.failures < 3)
SELECT 'c/' || chapter || '/page/' AS chapter, page, status FROM walk WHERE page >= 0""")
def chapter_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.sql(_PAGES.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders")).withColumn("url", F.expr("'c/' || o_custkey || '/page/' || page"))
    bases = table(spark, sf_dir, "customer").select(F.expr("'c/' || c_custkey || '/page/'").alias("chapter"))
    return chapters.job(bases, own.where("cached").select("url"), own.where("NOT bad").select("url")).select("chapter", "page", "status")
