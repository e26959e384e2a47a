"""SQL for the queries of categories, checks and derived columns."""

from __future__ import annotations

from furrow.plans.oracles import (
    LINEITEM_REG, ORACLES, ORDER_PARTS, ORDERS_DIRTY, PART_PARTS, r6, split, vocabulary,
)

LINE = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate"
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _values(source: str, columns: list[str], where: str = "TRUE") -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", trim(CAST({c} AS VARCHAR)) AS value, count(*) AS n "
        f"FROM {source} WHERE {where} GROUP BY 2" for c in columns)


# ---- categories -----------------------------------------------------------------------------------

ORACLES["near_constant"] = f"""
WITH wide AS (SELECT event_type, CASE WHEN event_id % 211 <> 3 THEN 'web' ELSE event_type END
  AS channel, CASE WHEN event_id % 499 = 1 THEN event_type END AS note,
  CASE WHEN event_id % 2 = 0 THEN 'even' END AS half FROM events),
counted AS ({_values('wide', ['event_type', 'channel', 'note', 'half'])})
SELECT "column", value, n, rows, {r6('n / rows')} AS share FROM (SELECT *, CAST(sum(n) OVER
  (PARTITION BY "column") AS BIGINT) AS rows FROM counted) WHERE n / rows >= 0.99"""
ORACLES["rare_categories"] = f"""
WITH texts AS (SELECT l_suppkey, l_returnflag, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS l_shipdate
  FROM lineitem),
counted AS ({_values('texts', ['l_suppkey', 'l_shipdate', 'l_returnflag'])})
SELECT "column", value, n, {r6('n / rows')} AS share FROM (SELECT *, sum(n) OVER
  (PARTITION BY "column") AS rows FROM counted WHERE value IS NOT NULL)
WHERE n < 20 OR n / rows < 0.01"""


def _merged(column: str) -> str:
    value = f"trim(CAST({column} AS VARCHAR))"
    return (f"CASE WHEN {value} IN (SELECT value FROM kept WHERE \"column\" = '{column}') THEN {value} "
            f"WHEN {value} IS NOT NULL THEN '__OTHER__' END AS {column}")


ORACLES["merge_rare"] = f"""{PART_PARTS},
counted AS ({_values('parts', ['p_type', 'p_size', 'p_brand'], "split = 'train'")}),
kept AS (SELECT * FROM (SELECT *, sum(n) OVER (PARTITION BY "column") AS rows FROM counted
  WHERE value IS NOT NULL) WHERE n >= 5 AND n / rows >= 0.02)
SELECT p_partkey, {', '.join(map(_merged, ('p_type', 'p_size', 'p_brand')))}, split FROM parts"""
CLASSES = f"""WITH {ORDERS_DIRTY},
classes AS (SELECT o_orderstatus AS class, count(*) AS n FROM orders_dirty
  WHERE o_orderstatus IS NOT NULL GROUP BY 1),
shares AS (SELECT class, n, n / sum(n) OVER () AS share,
  sum(n) OVER () / (count(*) OVER () * n) AS weight FROM classes)"""
ORACLES["class_weights"] = f"""{CLASSES}
SELECT class, n, {r6('share')} AS share, {r6('weight')} AS weight FROM shares"""
ORACLES["class_imbalance"] = f"""{CLASSES}
SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS classes, {r6('min(share)')} AS least_share,
  CASE WHEN min(share) < 0.1 THEN 'severe' WHEN min(share) < 0.2 THEN 'imbalanced' ELSE 'balanced' END
  AS level FROM shares"""


def _resampled(size: str) -> str:
    return f"""{ORDER_PARTS},
train AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus
  ORDER BY md5('42|' || o_orderkey)) AS place, count(*) OVER (PARTITION BY o_orderstatus) AS n
  FROM parts WHERE split = 'train'),
times AS (SELECT *, wanted // n + CASE WHEN place <= wanted % n THEN 1 ELSE 0 END AS times
  FROM train, (SELECT {size}(n) AS wanted FROM train))
SELECT o_orderkey, o_orderstatus, unnest(range(times)) AS copy FROM times"""


ORACLES["oversample"] = _resampled("max")
ORACLES["undersample"] = _resampled("min")
ORACLES["encode_ordinal"] = f"""WITH {ORDERS_DIRTY}
SELECT o_orderkey, CASE trim(o_orderpriority) WHEN '5-LOW' THEN 0 WHEN '3-MEDIUM' THEN 1
  WHEN '2-HIGH' THEN 2 WHEN '1-URGENT' THEN 3
  ELSE CASE WHEN o_orderpriority IS NOT NULL THEN -1 END END AS priority FROM orders_dirty"""
ORACLES["encode_binary"] = f"""
SELECT {LINE}, CASE l_linestatus WHEN (SELECT min(l_linestatus) FROM lineitem) THEN 0
  WHEN (SELECT max(l_linestatus) FROM lineitem) THEN 1 END AS status FROM lineitem"""
ORACLES["encode_frequency"] = f"""{ORDER_PARTS},
train AS (SELECT *, trim(o_orderpriority) AS p FROM parts WHERE split = 'train'),
size AS (SELECT count(*) AS rows FROM train),
c AS (SELECT o_custkey AS v, count(*) AS n FROM train GROUP BY 1),
p AS (SELECT p AS v, count(*) AS n FROM train GROUP BY 1)
SELECT o_orderkey, split, {r6('coalesce(c.n, 0) / rows')} AS customer_share,
  {r6('coalesce(p.n, 0) / rows')} AS priority_share
FROM parts LEFT JOIN c ON o_custkey IS NOT DISTINCT FROM c.v
  LEFT JOIN p ON trim(o_orderpriority) IS NOT DISTINCT FROM p.v, size"""

# ---- checks ---------------------------------------------------------------------------------------

ORACLES["duplicates_by_key"] = f"""WITH {ORDERS_DIRTY}
SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders_dirty GROUP BY ALL HAVING count(*) > 1"""
ORACLES["target_conflicts"] = f"""WITH {ORDERS_DIRTY}
SELECT o_custkey, mostly_missing, count(*) AS n, count(DISTINCT o_orderstatus) AS targets
FROM orders_dirty WHERE o_orderstatus IS NOT NULL GROUP BY 1, 2
HAVING count(DISTINCT o_orderstatus) > 1"""
BROKEN = {
    "status given": "o_orderstatus IS NULL",
    "price in range": "o_totalprice NOT BETWEEN 20000 AND 300000",
    "price is a number": "try_cast(num_text AS DOUBLE) IS NULL",
    "known priority": "o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')",
    "form of priority": "NOT regexp_matches(o_orderpriority, '^[1-5]-[A-Z ]+$')",
    "in the nineties": "o_orderdate < '1992-01-01' OR o_orderdate > '1997-06-30'",
}
KINDS = dict(zip(BROKEN, ("not_null", "range", "range", "in_set", "pattern", "date_range")))
ORACLES["validate_rules"] = f"WITH {ORDERS_DIRTY} " + " UNION ALL ".join([
    *[f"SELECT '{name}' AS rule, '{KINDS[name]}' AS kind, count(*) AS rows, "
      f"count(*) FILTER ({broken}) AS violations FROM orders_dirty" for name, broken in BROKEN.items()],
    "SELECT 'one row a key', 'unique', count(*), count(*) - count(DISTINCT o_orderkey) FROM orders_dirty",
    "SELECT 'one row a customer and day', 'unique', count(*), count(*) - count(DISTINCT "
    "(o_custkey, o_orderdate)) FROM orders_dirty"])
ORACLES["rule_violations"] = f"""WITH {ORDERS_DIRTY},
named AS (SELECT o_orderkey, concat_ws('; ', {', '.join(
    f"CASE WHEN {broken} THEN '{name}' END" for name, broken in BROKEN.items())}) AS broken_rules
  FROM orders_dirty)
SELECT * FROM named WHERE broken_rules <> ''"""
ORACLES["resource_estimate"] = f"""{ORDER_PARTS}, {vocabulary('priorities', 'o_orderpriority')}
SELECT count(*) AS rows, CAST(sum(CASE WHEN o_totalprice IS NOT NULL THEN 8 ELSE 0 END
    + coalesce(strlen(o_orderpriority), 0) + coalesce(strlen(mostly_missing), 0)) AS BIGINT)
    AS input_bytes,
  (SELECT 1 + 1 + count(*) + 1 + 1 + 2 + 1 FROM priorities) AS output_columns,
  count(*) * (SELECT 8 + 1 + count(*) + 1 + 1 + 2 + 1 FROM priorities) AS output_bytes FROM parts"""

# ---- derived columns --------------------------------------------------------------------------------

WRITTEN = """written AS (SELECT *, CAST(l_extendedprice AS DECIMAL(12,2)) AS p FROM lineitem)"""
ORACLES["parse_numbers"] = f"""WITH {WRITTEN}
SELECT {LINE}, {r6('''CASE l_orderkey % 11 WHEN 1 THEN -CAST(p AS DOUBLE) WHEN 3 THEN -CAST(p AS DOUBLE)
    WHEN 5 THEN CAST(p AS DOUBLE) * 100 WHEN 4 THEN NULL WHEN 6 THEN NULL
    ELSE CAST(p AS DOUBLE) END''')} AS price,
  {r6('CAST(CAST(l_discount * 100 AS DECIMAL(5,1)) AS DOUBLE) / 100')} AS share,
  CASE WHEN l_orderkey % 7 <> 0 THEN CAST(date_trunc('day', l_shipdate) AS TIMESTAMP) END AS day
FROM written"""
ORACLES["parse_report"] = """
SELECT 'price' AS "column", count(*) AS present,
  count(*) FILTER (l_orderkey % 11 NOT IN (4, 6)) AS parsed,
  count(*) FILTER (l_orderkey % 11 IN (4, 6)) AS rejected FROM lineitem
UNION ALL SELECT 'share', count(*), count(*), 0 FROM lineitem
UNION ALL SELECT 'day', count(*), count(*), 0 FROM lineitem"""
ORACLES["date_features"] = """
SELECT event_id, year(ts) AS ts__year, quarter(ts) AS ts__quarter, month(ts) AS ts__month,
  day(ts) AS ts__day, isodow(ts) AS ts__weekday, hour(ts) AS ts__hour,
  CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS ts__is_weekend FROM events"""
ORACLES["ratio_diff_sum_product"] = f"""WITH {LINEITEM_REG}
SELECT {LINE}, {r6('l_tax + l_discount')} AS total, {r6('l_quantity - l_tax')} AS gap,
  {r6('l_quantity * l_tax')} AS taxed,
  {r6('CASE WHEN l_discount <> 0 THEN l_quantity / l_discount END')} AS rate FROM lineitem_reg"""
SCALED = f"""WITH holed AS (SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN value END AS value,
  CAST(user_id AS DOUBLE) AS user_number FROM events),
events_scaled AS (SELECT *, value * value AS squared FROM holed),
{split('events_scaled', 'event_id', "'all'")},
facts AS (SELECT quantile_cont(value, 0.5) AS vm, quantile_cont(value, 0.75) - quantile_cont(value, 0.25)
    AS vr, quantile_cont(squared, 0.5) AS sm, quantile_cont(squared, 0.25) AS s1,
    quantile_cont(squared, 0.75) AS s3, min(value) AS vlow, max(value) AS vhigh,
    min(user_number) AS ulow, max(user_number) AS uhigh FROM parts WHERE split = 'train')"""
ORACLES["scale_robust"] = f"""{SCALED}
SELECT event_id, {r6('(value - vm) / vr')} AS value, {r6('(squared - sm) / (s3 - s1)')} AS squared, split
FROM parts, facts"""
ORACLES["log_transform"] = f"""
WITH holed AS (SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN value END AS value FROM events)
SELECT event_id, {r6('sign(value) * ln(1 + abs(value))')} AS value,
  {r6('-sign(value) * ln(1 + abs(value))')} AS negative FROM holed"""


def _bins(value: str, edges: list[str]) -> str:
    places = " + ".join(f"CASE WHEN {value} >= {e} THEN 1 ELSE 0 END" for e in edges)
    return f"CASE WHEN {value} IS NOT NULL THEN {places} END AS {value}"


ORACLES["binning"] = f"""{SCALED}
SELECT event_id, {_bins('value', [f'vlow + (vhigh - vlow) * {i} / 5' for i in range(1, 5)])},
  {_bins('user_number', [f'ulow + (uhigh - ulow) * {i} / 3' for i in range(1, 3)])},
  {_bins('squared', ['s1', 'sm', 's3'])}, split FROM parts, facts"""

# ---- streams ----------------------------------------------------------------------------------------

ORACLES["stream_profile"] = """
WITH holed AS (SELECT * REPLACE (CASE WHEN event_id % 10 <> 0 THEN value END AS value) FROM events)
""" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) - count({c}) AS missing, "
    f"{r6(f'min({x})')} AS low, {r6(f'max({x})')} AS high FROM holed"
    for c, x in (("event_id", "event_id"), ("user_id", "user_id"),
                 ("event_type", "CAST(NULL AS DOUBLE)"), ("value", "value")))
