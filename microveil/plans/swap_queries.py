"""Queries over swaps with targets per key and chains of pairs, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from microveil.operators import swap, tabulate
from microveil.plans.catalog import CHOSEN, HOUSE, _chosen, _households
from microveil.plans.registry import query
from microveil.plans.views import table

# Runs of chosen neighbours by size and area with a target of 0.3 in each: r has a row for each household, t one a key.
BY_KEY = f"""{CHOSEN.split(', st AS')[0]}, k AS (SELECT *, (hid * 15485863 % 1000003) / 1000003.0::DOUBLE AS u3, row_number() OVER o AS i, CASE WHEN sel AND NOT coalesce(lag(sel) OVER o, false) THEN 1 ELSE 0 END AS b
  FROM c WINDOW o AS (PARTITION BY size, area ORDER BY draw, hid)),
r AS (SELECT *, sum(b) OVER (PARTITION BY size, area ORDER BY draw, hid ROWS UNBOUNDED PRECEDING) AS run FROM k),
n AS (SELECT size, area, run, count(*) FILTER (sel) AS n, count(*) AS rows, arg_min(u3, i) FILTER (sel) AS u FROM r GROUP BY 1, 2, 3),
t0 AS (SELECT size, area, sum(rows)::BIGINT AS households, CASE WHEN sum(rows) > 1 THEN sum(n + n % 2) ELSE 0 END::BIGINT AS projected FROM n GROUP BY 1, 2),
t AS (SELECT *, households * 0.3::DOUBLE AS target, greatest(0, round(projected - households * 0.3))::BIGINT AS deselect FROM t0)"""


def _by_key(spark, d):
    return _chosen(spark, d).withColumn("u3", (F.col("hid") * 15485863 % 1000003) / 1000003)


@query(f"WITH {BY_KEY} SELECT * FROM t")
def swap_key_targets(spark, d):
    return swap.key_targets(_by_key(spark, d), ["size", "area"], ["draw", "hid"], "sel", 0.3)


@query(f"""WITH {BY_KEY},
q AS (SELECT n.*, CASE WHEN projected > 0 THEN least(1.0::DOUBLE, deselect::DOUBLE / projected) ELSE 0.0::DOUBLE END AS p, CASE WHEN n % 2 = 0 THEN n // 2 ELSE n END AS m FROM n JOIN t USING (size, area) WHERE n > 0),
m AS (SELECT size, area, run, n, u, x, sum(exp(lgamma(m + 1) - lgamma(x + 1) - lgamma(m - x + 1) + x * ln(p) + (m - x) * ln(1 - p))) OVER (PARTITION BY size, area, run ORDER BY x) AS cdf
  FROM q, unnest(range(0, m + 1)) AS v(x) WHERE p > 0 AND p < 1),
dr AS (SELECT size, area, run, n, count(*) FILTER (cdf < u) AS x FROM m GROUP BY ALL UNION ALL SELECT size, area, run, n, m FROM q WHERE p >= 1 UNION ALL SELECT size, area, run, n, 0 FROM q WHERE p <= 0),
tk AS (SELECT size, area, run, CASE WHEN n % 2 = 0 THEN 2 * x WHEN x > 0 AND x % 2 = 0 THEN x - 1 ELSE x END AS take FROM dr)
SELECT r.hid, sel AND NOT coalesce(row_number() OVER (PARTITION BY r.size, r.area, r.run ORDER BY sel DESC, u2, draw, hid) <= take, false) AS sel FROM r LEFT JOIN tk USING (size, area, run)""")
def swap_deselected_by_run(spark, d):
    h = _by_key(spark, d)
    targets = swap.key_targets(h, ["size", "area"], ["draw", "hid"], "sel", 0.3)
    return swap.deselected_by_run(h, targets, ["size", "area"], ["draw", "hid"], "sel", "u3", "u2").select("hid", "sel")


@query(f"""WITH {HOUSE}, p AS (SELECT hid AS a, hid * 7 % (SELECT max(hid) + 2 FROM hh) AS b, draw AS e FROM hh), v AS (SELECT p.* FROM p JOIN hh x ON x.hid = a JOIN hh y ON y.hid = b WHERE a <> b),
l AS (SELECT list(a * 10000000 + b ORDER BY e, a) AS es FROM v),
w AS (SELECT hid, list_reduce(es, lambda loc, e: CASE WHEN loc = e // 10000000 THEN e % 10000000 WHEN loc = e % 10000000 THEN e // 10000000 ELSE loc END, hid) AS loc FROM hh, l)
SELECT t.hid, f.area AS area, (EXISTS (SELECT 1 FROM v WHERE v.a = t.hid OR v.b = t.hid))::BIGINT AS swapped FROM hh t JOIN w ON w.loc = t.hid JOIN hh f ON f.hid = w.hid""")
def swap_chains(spark, d):
    """Pairs in which keys occur again and again, one after the other."""
    h = _households(spark, d)
    most = table(spark, d, "customer").agg((F.max("c_custkey") + 2).alias("m"))
    pairs = h.crossJoin(F.broadcast(most)).select(F.col("hid").alias("a"), (F.col("hid") * 7 % F.col("m")).alias("b"), F.col("draw"))
    ordered = tabulate.ranked(pairs, [], ["draw", "a"], "e")
    return swap.exchange_in_order(h, ordered, "hid", ["area"], "e").select("hid", "area", F.col("swapped").cast("long").alias("swapped"))
