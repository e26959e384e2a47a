"""SQL for the queries of the planned feature operators."""

from __future__ import annotations

from furrow.functions.text import NULL_MARK
from furrow.plans.oracles import (
    LINEITEM_REG, ORACLES, ORDER_PARTS, ORDERS_DIRTY, PART_PARTS, r6, split,
)


def _target_encoding(parts: str, columns: dict[str, str], y: str, key: str) -> str:
    """Leave-one-fold-out means: for every row the rows of other folds, by sums minus own ones."""
    fold = f"CAST('0x' || substr(md5('42|fold|' || CAST({key} AS VARCHAR)), 1, 8) AS BIGINT) % 5"
    values = ", ".join(f"{v} AS v{i}" for i, v in enumerate(columns.values()))
    encoded = []
    ctes = [f"base AS (SELECT {key}, split, {y} AS y, CASE WHEN split = 'train' THEN {fold} "
            f"ELSE -1 END AS fold, {values} FROM parts)",
            "whole AS (SELECT count(y) AS n, sum(y) AS s FROM base WHERE split = 'train')",
            "folds AS (SELECT fold, count(y) AS n, sum(y) AS s FROM base WHERE split = 'train' "
            "GROUP BY fold)"]
    joins = ["FROM base b CROSS JOIN whole w LEFT JOIN folds f ON b.fold = f.fold"]
    prior = "((w.s - coalesce(f.s, 0)) / (w.n - coalesce(f.n, 0)))"
    for i, name in enumerate(columns):
        ctes += [f"t{i} AS (SELECT v{i}, count(y) AS n, sum(y) AS s FROM base "
                 f"WHERE split = 'train' GROUP BY v{i})",
                 f"o{i} AS (SELECT v{i}, fold, count(y) AS n, sum(y) AS s FROM base "
                 f"WHERE split = 'train' GROUP BY v{i}, fold)"]
        joins += [f"LEFT JOIN t{i} ON b.v{i} = t{i}.v{i}",
                  f"LEFT JOIN o{i} ON b.v{i} = o{i}.v{i} AND b.fold = o{i}.fold"]
        total = f"(coalesce(t{i}.s, 0) - coalesce(o{i}.s, 0) + 10 * {prior})"
        n = f"(coalesce(t{i}.n, 0) - coalesce(o{i}.n, 0) + 10)"
        encoded.append(f"{r6(total + ' / ' + n)} AS {name}__target")
    return f"{parts},\n{', '.join(ctes)}\nSELECT b.{key}, split, {', '.join(encoded)} " + " ".join(joins)


ORACLES["target_encoding"] = _target_encoding(ORDER_PARTS, {
    "o_orderpriority": "coalesce(trim(o_orderpriority), '__MISSING__')",
    "o_custkey": "coalesce(CAST(o_custkey AS VARCHAR), '__MISSING__')",
    "mostly_missing": "coalesce(trim(mostly_missing), '__MISSING__')",
}, "CAST(o_orderstatus = 'F' AS INTEGER)", "o_orderkey")
ORACLES["target_encoding_regression"] = _target_encoding(PART_PARTS, {
    "p_brand": "coalesce(trim(p_brand), '__MISSING__')",
    "p_type": "coalesce(trim(p_type), '__MISSING__')",
    "p_size": "coalesce(CAST(p_size AS VARCHAR), '__MISSING__')",
}, "p_retailprice", "p_partkey")


def _slipped(text: str) -> str:
    return f"""CASE WHEN p_partkey % 23 = 0 THEN substr({text}, 1, 3) || substr({text}, 5)
      WHEN p_partkey % 29 = 0 THEN substr({text}, 2, 1) || substr({text}, 1, 1) || substr({text}, 3)
      WHEN p_partkey % 31 = 0 THEN {text} || 'e' WHEN p_partkey % 37 = 0 THEN upper({text})
      ELSE {text} END"""


_NAMES = f"""
named AS (SELECT p_partkey, p_name AS short, p_name || ' of the finest ' || p_type || ' make' AS long
          FROM part),
names AS (SELECT {_slipped('short')} AS value FROM named
          UNION ALL SELECT {_slipped('long')} FROM named),
counts AS (SELECT trim(value) AS value, count(*) AS n FROM names WHERE value IS NOT NULL GROUP BY 1)"""
ORACLES["case_variants"] = f"""WITH {_NAMES}
SELECT value, n, suggestion FROM (
  SELECT value, n, first_value(value) OVER (PARTITION BY lower(value) ORDER BY n DESC, value)
    AS suggestion, count(*) OVER (PARTITION BY lower(value)) AS forms FROM counts)
WHERE forms > 1"""
ORACLES["near_spellings"] = f"""WITH {_NAMES}
SELECT a.value AS value, b.value AS other, a.n AS n, b.n AS other_n,
  CAST(levenshtein(a.value, b.value) AS INTEGER) AS distance,
  CASE WHEN b.n > a.n THEN b.value ELSE a.value END AS suggestion
FROM counts a JOIN counts b ON a.value < b.value
WHERE length(a.value) >= 5 AND length(b.value) >= 5 AND levenshtein(a.value, b.value) <= 2"""

_WIDE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
         "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate", "quantity_again",
         "price_again", "date_again", "nearly_quantity"]
_WIDE_SQL = """
wide AS (SELECT *, l_quantity AS quantity_again, l_extendedprice AS price_again,
  l_shipdate AS date_again, CASE WHEN l_orderkey % 1000 <> 7 THEN l_quantity END AS nearly_quantity
  FROM lineitem)"""
_BINNED = ("l_extendedprice", "l_quantity", "price_again")
ORACLES["duplicate_columns"] = f"WITH {_WIDE_SQL}, compared AS (" + " UNION ALL ".join(
    f"SELECT {i} AS i, {j} AS j, '{b}' AS \"column\", '{a}' AS duplicate_of FROM wide HAVING "
    f"count(*) > 0 AND count(*) FILTER (CAST({a} AS VARCHAR) IS DISTINCT FROM CAST({b} AS VARCHAR)) = 0"
    for i, a in enumerate(_WIDE) for j, b in enumerate(_WIDE) if i < j) + """)
SELECT "column", duplicate_of FROM compared QUALIFY row_number() OVER (PARTITION BY j ORDER BY i) = 1"""


def _coded(c: str) -> str:
    if c not in _BINNED:
        return f"coalesce(CAST({c} AS VARCHAR), '') || ({c} IS NULL) AS {c}"
    low, high = (f"(SELECT {f}({c}) FROM wide)" for f in ("min", "max"))
    return (f"CAST(coalesce(least(floor(({c} - {low}) / ({high} - {low}) * 10), 9), -1) AS VARCHAR)"
            f" AS {c}")


def _entropy(*columns: str) -> str:
    return (f"(SELECT ln(sum(n)) - sum(n * ln(n)) / sum(n) FROM (SELECT count(*) AS n FROM coded "
            f"GROUP BY {', '.join(columns)}))")


ORACLES["mutual_information"] = f"""WITH {_WIDE_SQL},
coded AS (SELECT {', '.join(map(_coded, _WIDE))} FROM wide),
single AS ({' UNION ALL '.join(f"SELECT '{c}' AS c, {_entropy(c)} AS h" for c in _WIDE)}),
joint AS ({' UNION ALL '.join(f"SELECT '{a}' AS a, '{b}' AS b, {_entropy(a, b)} AS h"
                             for i, a in enumerate(_WIDE) for b in _WIDE[i + 1:])}),
informed AS (
  SELECT a, b, greatest(x.h + y.h - joint.h, 0) AS mi, x.h AS h_a, y.h AS h_b
  FROM joint JOIN single x ON x.c = a JOIN single y ON y.c = b)
SELECT a, b, {r6('mi', 5)} AS mi, {r6('h_a', 5)} AS h_a, {r6('h_b', 5)} AS h_b,
  {r6('CASE WHEN h_a > 1e-12 AND h_b > 1e-12 THEN mi / sqrt(h_a * h_b) ELSE 0 END', 5)} AS normalized
FROM informed"""


# ---- correlation and components -----------------------------------------------------------------

_RELATED = ["l_quantity", "quantity_again", "l_extendedprice", "l_discount", "discount_again", "l_tax",
            "l_partkey", "l_suppkey", "nearly_quantity"]
_RELATED_SQL = """
related AS (SELECT * REPLACE (CASE WHEN l_orderkey % 9 <> 0 THEN l_quantity END AS l_quantity),
  l_quantity * -2 + 7 AS quantity_again, l_discount + l_tax / 4 AS discount_again,
  CASE WHEN l_partkey % 7 <> 0 THEN l_quantity + l_tax END AS nearly_quantity FROM lineitem)"""
_CORRELATION = f"WITH {_RELATED_SQL}, pairs AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS rows, "
    f"corr({a}, {b}) AS r FROM related"
    for i, a in enumerate(_RELATED) for b in _RELATED[i + 1:]) + ")"
ORACLES["correlation"] = f"{_CORRELATION} SELECT a, b, rows, {r6('r')} AS r FROM pairs WHERE rows > 0"
ORACLES["high_correlation"] = (
    f"{_CORRELATION} SELECT a, b, rows, {r6('r')} AS r FROM pairs WHERE abs(r) >= 0.9")


def _pca(columns: list[str], steps: int = 4000) -> str:
    """Two components by power steps over the matrix of correlations, the first one taken out.

    Their variances lie within 3 % of each other on some tables, so it takes thousands of steps.
    """
    filled = ", ".join(f"coalesce({c}, (SELECT avg({c}) FROM related)) AS {c}" for c in columns)
    matrix = "[" + ", ".join(
        "[" + ", ".join(f"corr({a}, {b})" for b in columns) + "]" for a in columns) + "]"
    start = "[" + ", ".join(str(1.0 + i / 7) for i in range(len(columns))) + "]::DOUBLE[]"

    def iterate(name: str, source: str) -> str:
        return f"""
{name}_steps(step, m, v) AS (
  SELECT 0, m, {start} FROM {source}
  UNION ALL
  SELECT step + 1, m, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) FROM (
    SELECT step, m, list_transform(m, lambda line: list_dot_product(line, v)) AS w
    FROM {name}_steps) WHERE step < {steps}),
{name} AS (
  SELECT m, v, list_dot_product(v, list_transform(m, lambda line: list_dot_product(line, v))) AS value
  FROM {name}_steps WHERE step = {steps})"""

    names = "[" + ", ".join(f"'{c}'" for c in columns) + "]"
    rows = " UNION ALL ".join(
        f"SELECT {k} AS component, unnest({names}) AS \"column\", unnest(list_transform(v, "
        f"lambda x: x * sign(v[list_position(list_transform(v, lambda y: abs(y)), "
        f"list_max(list_transform(v, lambda y: abs(y))))]))) AS loading, value FROM {name}"
        for k, name in ((1, "one"), (2, "two")))
    return f"""WITH RECURSIVE {_RELATED_SQL},
filled AS (SELECT {filled} FROM related),
whole AS (SELECT {matrix} AS m FROM filled),{iterate('one', 'whole')},
rest AS (SELECT list_transform(m, lambda line, i: list_transform(line,
  lambda x, j: x - value * v[i] * v[j])) AS m FROM one),{iterate('two', 'rest')}
SELECT CAST(component AS INTEGER) AS component, "column", {r6('loading')} AS loading,
  {r6('value')} AS variance, {r6(f'value / {len(columns)}')} AS share FROM ({rows})"""


ORACLES["pca"] = _pca(_RELATED[:6])


# ---- power transformation -----------------------------------------------------------------------

def _likelihood(column: str, power: float, both_signs: bool) -> str:
    """Values of one sign are all 0 or more here; without the constant no digits are lost."""
    size = f"ln(1 + abs({column}))"

    def branch(p: float) -> str:
        if p == 0:
            return size
        return f"(exp({p} * {size}) - 1) / {p}" if both_signs else f"exp({p} * {size}) / {p}"

    y = f"CASE WHEN {column} >= 0 THEN {branch(power)} ELSE -({branch(2 - power)}) END"
    value = f"-ln(var_pop({y})) / 2 + {power - 1} * avg(sign({column}) * {size})"
    return (f"SELECT '{column}' AS \"column\", CAST({power} AS DOUBLE) AS exponent, "
            f"{r6(value)} AS log_likelihood FROM powered")


ORACLES["yeo_johnson_likelihood"] = f"""WITH {LINEITEM_REG},
powered AS (SELECT *, l_extendedprice / 1000 - l_quantity AS balance FROM lineitem_reg)
""" + " UNION ALL ".join(
    _likelihood(c, p, c == "balance")
    for c in ("l_extendedprice", "l_quantity", "l_tax", "balance")
    for p in (-2.0, -1.0, 0.0, 0.5, 1.0, 2.0, 3.0))


# ---- splits by time and group -------------------------------------------------------------------

def _time_split(view: str, time: str, key: list[str], share: float, columns: str) -> str:
    token = " || '|' || ".join(["'42'", *[f"CAST({c} AS VARCHAR)" for c in key]])
    return f"""SELECT {columns}, CASE WHEN row_number() OVER (ORDER BY {time} DESC, md5({token}))
  <= ceil({share} * (SELECT count(*) FROM {view})) THEN 'test' ELSE 'train' END AS split FROM {view}"""


ORACLES["split_time"] = "WITH lines AS (SELECT DISTINCT * FROM lineitem) " + _time_split(
    "lines", "l_shipdate", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], 0.2,
    "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate")
ORACLES["split_time_events"] = _time_split("events", "ts", ["event_id"], 0.15, "event_id, ts")


def _group_split(columns: list[str], share: float, seed: int) -> str:
    marked = " || ".join(
        f"'|' || coalesce(length({c}::VARCHAR) + 1 || ':=' || {c}::VARCHAR, '{len(NULL_MARK)}:' "
        f"|| '{NULL_MARK}')" for c in columns)
    listed = ", ".join(columns)
    return f"""WITH {ORDERS_DIRTY},
tokens AS (SELECT *, md5('{seed}|group' || {marked}) AS token FROM orders_dirty),
sizes AS (SELECT token, count(*) AS n FROM tokens GROUP BY token),
running AS (SELECT token, n, sum(n) OVER (ORDER BY token) AS upto,
  row_number() OVER (ORDER BY token) AS place, count(*) OVER () AS groups,
  ceil({share} * sum(n) OVER ()) AS wanted FROM sizes),
ends AS (SELECT token, abs(upto - wanted) AS off, place FROM running WHERE place < groups),
cut AS (SELECT token FROM ends ORDER BY off, place LIMIT 1)
SELECT o_orderkey, {listed}, CASE WHEN token <= (SELECT token FROM cut) THEN 'test' ELSE 'train' END
  AS split FROM tokens"""


ORACLES["split_group"] = _group_split(["o_custkey"], 0.2, 42)
ORACLES["split_group_pairs"] = _group_split(["o_orderstatus", "o_orderpriority"], 0.3, 7)


# ---- outliers -----------------------------------------------------------------------------------

_SPREAD = ["value", "squared", "tied", "amount"]
_SPREAD_SQL = """
holed AS (SELECT * REPLACE (CASE WHEN event_id % 10 <> 0 THEN value END AS value) FROM events),
spread AS (SELECT event_id, value, value * value AS squared,
  CAST(floor(value / 10) AS BIGINT) AS tied, CASE WHEN event_id % 41 = 3 THEN value * 100
  WHEN event_id % 59 = 5 THEN -value ELSE value END AS amount FROM holed)"""
_FENCES = f"""WITH {_SPREAD_SQL},
{split('spread', 'CAST(event_id AS VARCHAR)', chr(39) + 'all' + chr(39))},
fences AS (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS c, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 "
    f"FROM parts WHERE split = 'train'" for c in _SPREAD) + """),
bounds AS (SELECT *, q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high,
  q1 - 3 * (q3 - q1) AS far_low, q3 + 3 * (q3 - q1) AS far_high FROM fences)"""
ORACLES["quantiles"] = f"WITH {_SPREAD_SQL} " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST({s} AS DOUBLE) AS share, "
    f"{r6(f'CAST(quantile_cont(CAST({c} AS DOUBLE), {s}) AS DOUBLE)')} AS quantile FROM spread"
    for c in _SPREAD for s in (0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0))
ORACLES["outliers_iqr"] = _FENCES + " UNION ALL ".join(f"""
SELECT c AS "column", {r6('q1')} AS q1, {r6('q3')} AS q3, {r6('low')} AS low, {r6('high')} AS high,
  (SELECT count(*) FROM parts WHERE {c} < low OR {c} > high) AS outliers,
  (SELECT count(*) FROM parts WHERE {c} < far_low OR {c} > far_high) AS extreme
FROM bounds WHERE c = '{c}'""" for c in _SPREAD)


def _outlier_action(action: str) -> str:
    def bound(name: str, c: str) -> str:
        return f"(SELECT {name} FROM bounds WHERE c = '{c}')"

    beyond = {c: f"coalesce({c} < {bound('low', c)} OR {c} > {bound('high', c)}, FALSE)"
              for c in _SPREAD}
    cells = {c: c if c == "tied" and action != "clip" else r6(c) for c in _SPREAD}
    more, where = "", ""
    if action == "flag":
        more = "".join(f", CAST({b} AS INTEGER) AS {c}__outlier" for c, b in beyond.items())
    elif action == "clip":
        cells = {c: r6(f"greatest({bound('low', c)}, least({bound('high', c)}, CAST({c} AS DOUBLE)))")
                 for c in _SPREAD}
        cells = {c: f"CASE WHEN {c} IS NOT NULL THEN {x} END" for c, x in cells.items()}
    elif action == "null":
        cells = {c: f"CASE WHEN NOT {b} THEN {cells[c]} END" for c, b in beyond.items()}
    elif action == "drop":
        where = " WHERE NOT (" + " OR ".join(beyond.values()) + ")"
    listed = ", ".join(f"{x} AS {c}" for c, x in cells.items())
    return f"{_FENCES} SELECT event_id, split, {listed}{more} FROM parts{where}"


for _action in ("keep", "flag", "clip", "null", "drop"):
    ORACLES[f"outliers_{_action}"] = _outlier_action(_action)
