"""Queries of hosts that mustn't be asked: users of the event table as hosts, customers and parts as lists of names and ranges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ashlar.plans.registry import query
from ashlar.session import table
from ashlar.sources import hosts

_HOST = "concat('w', event_id % 97, '.s', user_id % 31, CASE WHEN event_id % 3 = 0 THEN '.Deep' ELSE '' END, '.t', event_id % 7, '.test', CASE WHEN event_id % 5 = 0 THEN '.' ELSE '' END)"
_ALIAS = "concat('c', event_id % 11, '.edge', user_id % 53, '.net')"
_ADDRESS = "concat(user_id % 200, '.', event_id % 256, '.', (event_id * 7) % 300, '.', event_id % 4)"
#: Lists: suffixes of names, of two lengths; suffixes of aliases; ranges of addresses, wide and narrow, one the wrong way round.
_NAMES = "SELECT concat('s', p_partkey % 40, '.t', p_size % 7, '.test') AS suffix, p_brand AS label FROM part WHERE p_partkey % 9 = 0 UNION ALL SELECT concat('t', n_nationkey, '.test'), n_name FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 'deep.t4.test', 'deep'"
_ALIASES = "SELECT concat('edge', s_suppkey, '.net') AS suffix, s_name AS label FROM supplier WHERE s_suppkey % 4 = 0"
_RANGES = """SELECT concat(c_custkey % 200, '.', c_nationkey, '.0.0') AS first, concat(c_custkey % 200, '.', c_nationkey + c_custkey % 9, '.200.7') AS last, c_mktsegment AS label FROM customer WHERE c_custkey % 3 = 0
UNION ALL SELECT '7.0.0.0', '9.255.255.255', 'wide' UNION ALL SELECT '50.9.0.0', '50.8.0.0', 'none' UNION ALL SELECT '11.11.77.3', '11.11.77.3', 'one'"""


@query(f"""
WITH e AS (SELECT rtrim(lower({_HOST}), '.') AS h, {_ALIAS} AS a, {_ADDRESS} AS ip FROM events), hs AS (SELECT h, min(a) AS a, min(ip) AS ip FROM e GROUP BY 1),
n AS (SELECT suffix, min(label) AS label FROM ({_NAMES}) GROUP BY 1), al AS (SELECT suffix, min(label) AS label FROM ({_ALIASES}) GROUP BY 1),
num AS (SELECT first, last, label, CAST(string_split(first, '.') AS BIGINT[]) AS f, CAST(string_split(last, '.') AS BIGINT[]) AS l FROM ({_RANGES})),
r AS (SELECT ((f[1] * 256 + f[2]) * 256 + f[3]) * 256 + f[4] AS f, ((l[1] * 256 + l[2]) * 256 + l[3]) * 256 + l[4] AS l, label FROM num),
x AS (SELECT h, ip, CAST(string_split(ip, '.') AS BIGINT[]) AS b FROM hs), xs AS (SELECT h, ip, ((b[1] * 256 + b[2]) * 256 + b[3]) * 256 + b[4] AS x FROM x WHERE b[3] < 256),
m AS (SELECT h, 0 AS o, 'name' AS "by", label, h AS via, row_number() OVER (PARTITION BY h ORDER BY length(suffix) DESC) AS k FROM hs JOIN n ON h = suffix OR ends_with(h, '.' || suffix)
  UNION ALL SELECT h, 1, 'alias', label, a, row_number() OVER (PARTITION BY h ORDER BY length(suffix) DESC) FROM hs JOIN al ON a = suffix OR ends_with(a, '.' || suffix)
  UNION ALL SELECT h, 2, 'address', label, ip, row_number() OVER (PARTITION BY h ORDER BY l - f, label) FROM xs JOIN r ON x BETWEEN f AND l)
SELECT h AS host, "by", label, via FROM m WHERE k = 1 QUALIFY row_number() OVER (PARTITION BY h ORDER BY o) = 1
""")
def blocked_by_lists(spark, sf_dir):
    t = {n: table(spark, sf_dir, n) for n in ("events", "part", "nation", "supplier", "customer")}
    e = t["events"].select(F.expr(_HOST).alias("host"), F.expr(_ALIAS).alias("a"), F.expr(_ADDRESS).alias("ip"))
    resolved = e.groupBy(hosts.plain_host("host").alias("host")).agg(F.array(F.min("a")).alias("names"), F.array(F.min("ip")).alias("addresses"))
    number = lambda x: x.cast("string")
    p, key, nation = t["part"], F.col("c_custkey"), F.col("c_nationkey")
    names = p.where("p_partkey % 9 = 0").select(F.expr("concat('s', p_partkey % 40, '.t', p_size % 7, '.test')").alias("suffix"), F.col("p_brand").alias("label"))
    names = names.unionByName(t["nation"].where("n_nationkey = 3").select(F.expr("concat('t', n_nationkey, '.test')").alias("suffix"), F.col("n_name").alias("label")))
    names = names.unionByName(spark.createDataFrame([("deep.t4.test", "deep")], "suffix string, label string"))
    aliases = t["supplier"].where("s_suppkey % 4 = 0").select(F.expr("concat('edge', s_suppkey, '.net')").alias("suffix"), F.col("s_name").alias("label"))
    ranges = t["customer"].where(key % 3 == 0).select(
        F.concat(number(key % 200), F.lit("."), number(nation), F.lit(".0.0")).alias("first"), F.concat(number(key % 200), F.lit("."), number(nation + key % 9), F.lit(".200.7")).alias("last"), F.col("c_mktsegment").alias("label"))
    ranges = ranges.unionByName(spark.createDataFrame([("7.0.0.0", "9.255.255.255", "wide"), ("50.9.0.0", "50.8.0.0", "none"), ("11.11.77.3", "11.11.77.3", "one")], "first string, last string, label string"))
    return hosts.blocked_hosts(e, "host", resolved, names, aliases, ranges)
