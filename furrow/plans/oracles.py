"""Independent SQL for the registered queries, for checking results with another engine.

Everything is computed from the base tables; nothing is taken from what the library produced.
"""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORDERS_DIRTY = """
orders_dirty AS (
  SELECT o_orderkey, o_custkey,
    CASE WHEN o_orderkey % 97 <> 0 THEN o_orderstatus END AS o_orderstatus,
    CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS o_totalprice,
    o_orderdate,
    CASE WHEN o_orderkey % 11 = 0 THEN NULL
         WHEN o_orderkey % 13 = 0 THEN '  ' || o_orderpriority || ' '
         ELSE o_orderpriority END AS o_orderpriority,
    'x' AS const_col,
    CASE WHEN o_orderkey % 5 = 0 THEN 'v' END AS mostly_missing,
    CASE WHEN o_orderkey % 101 = 0 THEN 'n/a'
         ELSE CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR) END AS num_text
  FROM (SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderkey % 50 = 0)
)"""
LINEITEM_REG = """
lineitem_reg AS (
  SELECT * REPLACE (CASE WHEN l_orderkey % 9 <> 0 THEN l_quantity END AS l_quantity) FROM lineitem
)"""
CUSTOMER_CODED = """
customer_coded AS (
  SELECT c_custkey, c_name AS customer_code, c_mktsegment, c_acctbal, c_acctbal > 0 AS in_credit
  FROM customer
)"""
ORDER_COLUMNS = {
    "o_orderkey": "Int64", "o_custkey": "Int64", "o_orderstatus": "String",
    "o_totalprice": "Float64", "o_orderdate": "Datetime", "o_orderpriority": "String",
    "const_col": "String", "mostly_missing": "String", "num_text": "String",
}
CUSTOMER_COLUMNS = {
    "c_custkey": "Int64", "customer_code": "String", "c_mktsegment": "String",
    "c_acctbal": "Float64", "in_credit": "Boolean",
}
DOCUMENT_COLUMNS = {
    "doc_id": "Int64", "text": "String", "lang": "String", "source": "String", "n_chars": "Int64",
}
LINE_COLUMNS = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
)


def r6(expression: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) + 0.0"


# ---- profiles ----------------------------------------------------------------------------------

def column_facts(view: str, column: str) -> str:
    return (f"count(*) AS rows, count(*) - count({column}) AS missing_count, "
            f"count(DISTINCT {column}) + CASE WHEN count(*) > count({column}) THEN 1 ELSE 0 END "
            f"AS unique_count FROM {view}")


def examples(view: str, column: str, key: str) -> str:
    return (f"(SELECT coalesce(list(x ORDER BY k), []) FROM (SELECT CAST({column} AS VARCHAR) AS x,"
            f" {key} AS k FROM {view} WHERE {column} IS NOT NULL ORDER BY {key} LIMIT 3))")


def profile(view: str, columns: dict[str, str], key: str, name: str = "profile") -> str:
    parts = [
        f"SELECT {i} AS ordinal, '{c}' AS \"column\", '{t}' AS inferred_type, "
        f"{examples(view, c, key)} AS examples, {column_facts(view, c)}"
        for i, (c, t) in enumerate(columns.items())
    ]
    body = "\nUNION ALL ".join(parts)
    return (f"{name} AS (SELECT *, CASE WHEN rows > 0 THEN missing_count / rows ELSE 0 END "
            f"AS missing_rate FROM ({body}))")


def roles(source: str = "profile", name: str = "roles") -> str:
    return f"""
{name} AS (SELECT *, CASE
  WHEN inferred_type = 'Boolean' THEN 'boolean'
  WHEN inferred_type = 'Datetime' THEN 'datetime'
  WHEN inferred_type IN ('Int64', 'Int32', 'Float64') THEN
    CASE WHEN unique_count / rows <= 0.05 OR unique_count <= 20 THEN 'discrete_numeric'
         ELSE 'continuous_numeric' END
  WHEN unique_count / rows >= 0.98
    AND regexp_matches("column", '(^id$|_id$|id_|编号|代码|编码|code|key)', 'i') THEN 'id'
  WHEN unique_count / rows >= 0.5
    AND list_avg(list_transform(examples, lambda x: length(x))) >= 20 THEN 'text'
  ELSE 'nominal_category' END AS role FROM {source})"""


ORDER_PROFILE = f"WITH {ORDERS_DIRTY},\n{profile('orders_dirty', ORDER_COLUMNS, 'o_orderkey')}"
ORDER_INFERRED = f"{ORDER_PROFILE},\n{roles()}"
CONFIRMED = """
roles AS (SELECT *, CASE "column"
  WHEN 'o_orderkey' THEN 'id' WHEN 'o_orderstatus' THEN 'target' WHEN 'o_orderdate' THEN 'ignore'
  WHEN 'num_text' THEN 'ignore' WHEN 'o_custkey' THEN 'continuous_numeric'
  WHEN 'o_totalprice' THEN 'continuous_numeric' ELSE 'nominal_category' END AS role FROM profile)"""
ORDER_CONFIRMED = f"{ORDER_PROFILE},\n{CONFIRMED}"

ORACLES["missing_stats"] = f"""{ORDER_PROFILE}
SELECT "column", rows, missing_count, {r6('missing_rate')} AS missing_rate FROM profile"""
ORACLES["unique_stats"] = f'{ORDER_PROFILE} SELECT "column", unique_count FROM profile'
ORACLES["unique_stats_lineitem"] = f"WITH {LINEITEM_REG} " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", unique_count FROM (SELECT {column_facts('lineitem_reg', c)})"
    for c in LINE_COLUMNS)
ORACLES["example_values"] = f"""{ORDER_PROFILE}
SELECT "column", array_to_string(examples, '|') AS examples FROM profile"""
ORACLES["column_profile"] = f"""{ORDER_PROFILE}
SELECT ordinal, "column", inferred_type, rows, missing_count, {r6('missing_rate')} AS missing_rate,
  unique_count, array_to_string(examples, '|') AS examples FROM profile"""
ORACLES["column_profile_documents"] = f"""
WITH {profile('documents', DOCUMENT_COLUMNS, 'doc_id')}
SELECT ordinal, "column", inferred_type, rows, missing_count, {r6('missing_rate')} AS missing_rate,
  unique_count FROM profile"""
ORACLES["dataset_profile"] = f"""{ORDER_PROFILE}
SELECT max(rows) AS sampled_rows, FALSE AS is_sampled, count(*) AS column_count,
  CAST(sum(missing_count) AS BIGINT) AS missing_cells, CAST(NULL AS VARCHAR) AS warning
FROM profile"""
ORACLES["dataset_profile_sampled"] = """
SELECT least(count(*), 10000) AS sampled_rows, count(*) > 10000 AS is_sampled,
  CAST(6 AS BIGINT) AS column_count, CAST(0 AS BIGINT) AS missing_cells,
  CASE WHEN count(*) > 10000 THEN 'profile of the first 10000 rows' END AS warning FROM orders"""
ORACLES["head_sample"] = """
SELECT o_orderkey, o_custkey, o_totalprice, (SELECT count(*) > 10000 FROM orders) AS is_sampled
FROM orders ORDER BY o_orderkey LIMIT 10000"""
ORACLES["schema_infer"] = """
SELECT column_name AS "column", CASE column_type WHEN 'BIGINT' THEN 'Int64'
  WHEN 'INTEGER' THEN 'Int32' WHEN 'DOUBLE' THEN 'Float64' WHEN 'VARCHAR' THEN 'String'
  WHEN 'TIMESTAMP' THEN 'Datetime' ELSE column_type END AS inferred_type
FROM (DESCRIBE lineitem)"""
ORACLES["preview_rows"] = f"""WITH {ORDERS_DIRTY}
SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey,
  o_orderstatus, CAST(o_totalprice AS VARCHAR) AS o_totalprice,
  CAST(o_orderdate AS VARCHAR) AS o_orderdate, o_orderpriority, const_col, mostly_missing, num_text
FROM orders_dirty ORDER BY orders_dirty.o_orderkey LIMIT 5"""

# ---- roles and quality ---------------------------------------------------------------------------

_INFERRED = (("orders_dirty", ORDER_COLUMNS, "o_orderkey", "p1"),
             ("customer_coded", CUSTOMER_COLUMNS, "c_custkey", "p2"),
             ("documents", DOCUMENT_COLUMNS, "doc_id", "p3"))
ORACLES["infer_roles"] = (
    f"WITH {ORDERS_DIRTY}, {CUSTOMER_CODED}, "
    + ", ".join(profile(*v) + ", " + roles(v[3], f"r{v[3]}") for v in _INFERRED)
    + " " + " UNION ALL ".join(
        f'SELECT "column", inferred_type, role FROM r{v[3]}' for v in _INFERRED))
ORACLES["confirm_roles"] = f"""{ORDER_INFERRED},
given AS (
  SELECT "column", role FROM roles WHERE "column" <> 'num_text'
  UNION ALL SELECT "column", role FROM roles WHERE "column" = 'const_col'
  UNION ALL SELECT "column" || '_2', role FROM roles WHERE "column" = 'num_text')
SELECT 'missing_column' AS problem, "column" AS subject FROM roles
  WHERE "column" NOT IN (SELECT "column" FROM given)
UNION ALL SELECT 'unknown_column', "column" FROM given
  WHERE "column" NOT IN (SELECT "column" FROM roles)
UNION ALL SELECT 'duplicate_column', "column" FROM given GROUP BY "column" HAVING count(*) > 1
UNION ALL SELECT 'target_count', CAST(count(*) AS VARCHAR) FROM given WHERE role = 'target'
  HAVING count(*) <> 1"""

SCORES = """
scores AS (
  SELECT CAST(CASE WHEN sum(rows) > 0
      THEN round_even(100 * (1 - sum(missing_count) / sum(rows)), 0) ELSE 0 END AS INTEGER)
      AS completeness,
    CAST(greatest(0, 100 - 10 * count(*) FILTER (inferred_type IN ('Object', 'Unknown')))
      AS INTEGER) AS validity,
    CAST(100 - least(30, 5 * count(*) FILTER (missing_count > 0 AND unique_count > 1))
      AS INTEGER) AS consistency,
    CAST(greatest(0, 100 - 15 * count(*) FILTER (unique_count <= 1)) AS INTEGER) AS uniqueness,
    CAST(100 - least(45, 5 * count(*) FILTER (role IN ('id', 'text'))
      + 8 * count(*) FILTER (inferred_type = 'String' AND unique_count > 50)) AS INTEGER)
      AS structure_usability,
    CAST(greatest(0, 100 - CASE WHEN count(*) FILTER (role = 'target') <> 1 THEN 35 ELSE 0 END
      - CASE WHEN count(*) FILTER (role IN ('ignore', 'id', 'text')) = count(*) THEN 50 ELSE 0 END)
      AS INTEGER) AS task_readiness
  FROM roles),
report AS (
  UNPIVOT (SELECT *, CAST(round_even((completeness + validity + consistency + uniqueness
    + structure_usability + task_readiness) / 6, 0) AS INTEGER) AS total FROM scores)
  ON COLUMNS(*) INTO NAME dimension VALUE score)"""
ORACLES["quality_report"] = f"{ORDER_INFERRED}, {SCORES} SELECT dimension, score FROM report"
for _key, _dimension in (
    ("q_completeness", "completeness"), ("q_validity", "validity"),
    ("q_consistency", "consistency"), ("q_uniqueness", "uniqueness"),
    ("q_structure", "structure_usability"), ("q_task_readiness", "task_readiness"),
):
    ORACLES[_key] = (f"{ORDER_INFERRED}, {SCORES} SELECT dimension, score FROM report "
                     f"WHERE dimension = '{_dimension}'")
ORACLES["quality_deductions"] = f"""{ORDER_INFERRED}
SELECT 'completeness' AS dimension, 'BD-Q-COMP-001' AS rule_id, "column",
  CAST(greatest(1, round_even(100 * missing_rate, 0)) AS INTEGER) AS points
  FROM roles WHERE missing_count > 0
UNION ALL SELECT 'validity', 'BD-Q-VALID-001', "column", 10 FROM roles
  WHERE inferred_type IN ('Object', 'Unknown')
UNION ALL SELECT 'consistency', 'BD-Q-CONS-001', "column", 5 FROM roles
  WHERE missing_count > 0 AND unique_count > 1
UNION ALL SELECT 'uniqueness', 'BD-Q-UNIQ-001', "column", 15 FROM roles WHERE unique_count <= 1
UNION ALL SELECT 'structure_usability', 'BD-Q-STRUCT-001', "column", 5 FROM roles
  WHERE role IN ('id', 'text')
UNION ALL SELECT 'structure_usability', 'BD-Q-STRUCT-002', "column", 8 FROM roles
  WHERE inferred_type = 'String' AND unique_count > 50
UNION ALL SELECT 'task_readiness', 'BD-Q-TASK-001', NULL, 35 FROM roles WHERE role = 'target'
  HAVING count(*) <> 1
UNION ALL SELECT 'task_readiness', 'BD-Q-TASK-002', NULL, 50 FROM roles
  HAVING count(*) = count(*) FILTER (role IN ('ignore', 'id', 'text'))"""

# ---- recommendations --------------------------------------------------------------------------------


def recs(supervised: bool = True) -> str:
    target = """
  SELECT 'BD-TARGET-001:project' AS id, 'BD-TARGET-001' AS rule_id, NULL AS "column",
    'high' AS severity, 'high' AS risk, CAST(1.0 AS DOUBLE) AS confidence,
    'configure_target' AS action, FALSE AS enabled
  FROM roles WHERE role = 'target' HAVING count(*) <> 1 UNION ALL""" if supervised else ""

    def rule(rule_id: str, when: str, levels: str, confidence: str, action: str, on: str) -> str:
        severity, risk = levels.split("/")
        return f"""
  SELECT '{rule_id}:' || lower(hex(encode("column"))) AS id, '{rule_id}' AS rule_id, "column",
    '{severity}' AS severity, '{risk}' AS risk, CAST({confidence} AS DOUBLE) AS confidence,
    '{action}' AS action, {on} AS enabled FROM roles WHERE {when}"""

    rules = [
        rule("BD-MISSING-001", "missing_rate >= 0.5 AND role <> 'target'", "high/high", "0.98",
             "remove_column", "FALSE"),
        rule("BD-MISSING-002", "missing_rate >= 0.1 AND role <> 'target'", "low/low", "0.95",
             "add_missing_indicator", "TRUE"),
        rule("BD-CONSTANT-001", "unique_count <= 1 AND role <> 'target'", "low/low", "0.99",
             "remove_column", "TRUE"),
        rule("BD-ID-001", "role = 'id'", "medium/low", "0.9", "exclude_feature", "TRUE"),
        rule("BD-CATEGORY-001", "inferred_type = 'String' AND unique_count > 50", "medium/medium",
             "0.9", "limit_category_cardinality", "FALSE"),
    ]
    return f"recs AS ({target}" + " UNION ALL ".join(rules) + ")"


CONFLICTS = """
conflicts AS (
  SELECT a.id, b.id AS other FROM recs a JOIN recs b ON a."column" = b."column"
  WHERE (a.action = 'remove_column' AND b.action NOT IN ('remove_column', 'exclude_feature'))
     OR (b.action = 'remove_column' AND a.action NOT IN ('remove_column', 'exclude_feature')))"""
ORDER_RECS = f"{ORDER_INFERRED}, {recs()}"
for _key, _rule in (
    ("rec_target", "BD-TARGET-001"), ("rec_high_missing", "BD-MISSING-001"),
    ("rec_missing_indicator", "BD-MISSING-002"), ("rec_constant", "BD-CONSTANT-001"),
    ("rec_high_cardinality", "BD-CATEGORY-001"),
):
    ORACLES[_key] = f"{ORDER_RECS} SELECT * FROM recs WHERE rule_id = '{_rule}'"
ORACLES["rec_exclude_id"] = (
    f"WITH {CUSTOMER_CODED}, {profile('customer_coded', CUSTOMER_COLUMNS, 'c_custkey')}, {roles()},"
    f" {recs(False)} SELECT * FROM recs WHERE rule_id = 'BD-ID-001'")
ORACLES["rec_conflicts"] = f"""{ORDER_RECS}, {CONFLICTS}
SELECT recs.id, coalesce(string_agg(other, '|' ORDER BY other), '') AS conflicts_with
FROM recs LEFT JOIN conflicts USING (id) GROUP BY recs.id"""
ORACLES["rec_selection_check"] = f"""{ORDER_RECS}, {CONFLICTS},
selected AS (
  SELECT id FROM recs
  UNION ALL SELECT id FROM recs WHERE rule_id = 'BD-CONSTANT-001'
  UNION ALL SELECT id || '00' FROM recs WHERE rule_id = 'BD-CATEGORY-001')
SELECT 'duplicate' AS problem, id FROM selected GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'unknown', id FROM selected WHERE id NOT IN (SELECT id FROM recs)
UNION ALL SELECT DISTINCT 'conflict', id FROM conflicts
  WHERE id IN (SELECT id FROM selected) AND other IN (SELECT id FROM selected)"""
ORACLES["rec_enablement"] = f"""{ORDER_RECS}
SELECT 'first' AS build, id, enabled FROM recs
UNION ALL SELECT 'later', id, id IN ('BD-MISSING-001:6d6f73746c795f6d697373696e67',
  'BD-MISSING-002:6f5f746f74616c7072696365') FROM recs"""
ORACLES["select_features"] = f"""{ORDER_CONFIRMED}, {recs()}
SELECT "column", role, "column" IN (SELECT "column" FROM recs WHERE enabled
    AND action = 'add_missing_indicator') AS missing_indicator
FROM roles WHERE role NOT IN ('id', 'text', 'group', 'sensitive', 'ignore', 'target')
  AND "column" NOT IN (SELECT "column" FROM recs WHERE enabled
    AND action IN ('remove_column', 'exclude_feature'))"""

# ---- rows and splits ----------------------------------------------------------------------------------


def split(source: str, key: str, label: str, size: str = "0.2", seed: int = 42,
          name: str = "parts") -> str:
    """The rows of `source` with `split`, by rank of a hash within each class."""
    return f"""
tokens AS (SELECT *, {label} AS class, md5('{seed}|' || {key}) AS token FROM {source}),
classes AS (SELECT class, count(*) AS n FROM tokens GROUP BY class),
total AS (SELECT CAST(sum(n) AS BIGINT) AS n,
  CAST(ceil(CAST(sum(n) AS DOUBLE) * CAST({size} AS DOUBLE)) AS BIGINT) AS t FROM classes),
shares AS (SELECT class, c.n AS n, c.n * t // total.n AS base, c.n * t % total.n AS rest, t
  FROM classes c, total),
quotas AS (SELECT class, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, n DESC, class)
  <= t - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM shares),
{name} AS (SELECT * EXCLUDE (token, class, quota), CASE WHEN row_number() OVER
  (PARTITION BY class ORDER BY token) <= quota THEN 'test' ELSE 'train' END AS split
  FROM tokens JOIN quotas USING (class))"""


ORDER_PARTS = f"""WITH {ORDERS_DIRTY},
eligible AS (SELECT DISTINCT * FROM orders_dirty WHERE o_orderstatus IS NOT NULL),
{split('eligible', 'CAST(o_orderkey AS VARCHAR)', 'o_orderstatus')}"""
PART_PARTS = f"WITH {split('part', 'CAST(p_partkey AS VARCHAR)', chr(39) + 'all' + chr(39))}"
LINE_TOKEN = " || '|' || ".join(
    f"CAST({c} AS VARCHAR)"
    for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate"))
LINE_PARTS = f"""WITH {LINEITEM_REG},
eligible AS (SELECT DISTINCT * FROM lineitem_reg),
{split('eligible', LINE_TOKEN, chr(39) + 'all' + chr(39))}"""

ORACLES["drop_duplicates"] = f"WITH {ORDERS_DIRTY} SELECT DISTINCT * FROM orders_dirty"
ORACLES["target_missing"] = f"""WITH {ORDERS_DIRTY}
SELECT DISTINCT * FROM orders_dirty WHERE o_orderstatus IS NULL"""
ORACLES["target_present"] = f"""WITH {ORDERS_DIRTY}
SELECT o_orderkey, o_orderstatus FROM (SELECT DISTINCT * FROM orders_dirty)
WHERE o_orderstatus IS NOT NULL"""
ORACLES["split_preconditions"] = f"""WITH {ORDERS_DIRTY},
classes AS (SELECT CASE WHEN o_orderkey = 1 THEN 'rare' ELSE o_orderstatus END AS class,
  count(*) AS n FROM orders GROUP BY 1)
SELECT 'class_too_small' AS problem, min(n) AS found, CAST(2 AS BIGINT) AS required
  FROM classes HAVING min(n) < 2
UNION ALL SELECT 'target_not_numeric', count(*), CAST(0 AS BIGINT) FROM orders_dirty
  WHERE num_text IS NOT NULL AND TRY_CAST(num_text AS DOUBLE) IS NULL HAVING count(*) > 0"""
ORACLES["split_ties"] = """
WITH placed AS (
  SELECT o_custkey, o_orderdate + to_microseconds(o_orderkey % 3) AS placed_at FROM orders)
SELECT o_custkey, placed_at, 2 * count(*) AS n,
  (SELECT CAST(ceil(2 * count(*) / 5.0) AS BIGINT) FROM orders) AS test_rows
FROM placed GROUP BY ALL"""
ORACLES["split_random"] = f"""
WITH {split('events', 'CAST(event_id AS VARCHAR)', chr(39) + 'all' + chr(39))}
SELECT event_id, split FROM parts"""
ORACLES["split_stratified"] = f"{ORDER_PARTS} SELECT o_orderkey, o_orderstatus, split FROM parts"
ORACLES["split_stratified_labels"] = f"""
WITH labelled AS (SELECT doc_id, quality FROM documents JOIN labels USING (doc_id)),
{split('labelled', 'CAST(doc_id AS VARCHAR)', 'quality', '0.3', 7)}
SELECT doc_id, quality, split FROM parts"""
ORACLES["split_counts"] = f"""{ORDER_PARTS}
SELECT count(*) FILTER (split = 'train') AS train_rows, count(*) FILTER (split = 'test')
  AS test_rows, (SELECT count(*) FROM (SELECT DISTINCT * FROM orders_dirty)
  WHERE o_orderstatus IS NULL) AS target_missing_rows, TRUE AS stratified FROM parts"""
ORACLES["strict_numeric"] = f"""WITH {ORDERS_DIRTY}
SELECT 'num_text' AS "column", count(*) AS rejected FROM orders_dirty
  WHERE num_text IS NOT NULL AND TRY_CAST(num_text AS DOUBLE) IS NULL
UNION ALL SELECT 'o_totalprice', CAST(0 AS BIGINT)
UNION ALL SELECT 'o_orderpriority', count(*) FROM orders_dirty
  WHERE o_orderpriority IS NOT NULL AND TRY_CAST(o_orderpriority AS DOUBLE) IS NULL"""
ORACLES["schema_drift"] = f"""WITH {ORDERS_DIRTY},
confirmed AS (SELECT unnest([{', '.join(repr(c) for c in ORDER_COLUMNS)}]) AS "column"),
found AS (SELECT column_name AS "column" FROM (DESCRIBE orders))
SELECT 'missing_column' AS problem, "column" FROM confirmed
  WHERE "column" NOT IN (SELECT "column" FROM found)
UNION ALL SELECT 'unexpected_column', "column" FROM found
  WHERE "column" NOT IN (SELECT "column" FROM confirmed)"""

# ---- fit and transform -----------------------------------------------------------------------------------


def moments(columns: dict[str, str], fill: str = "median", source: str = "parts",
            where: str = "split = 'train'") -> str:
    """Fill and filled moments of numeric columns; `columns` maps a column to its short name."""
    fills = ", ".join(f"{fill}({c}) AS {s}_fill" for c, s in columns.items())
    filled = ", ".join(
        f"avg(coalesce({c}, {s}_fill)) AS {s}_mean, stddev_pop(coalesce({c}, {s}_fill)) AS {s}_dev,"
        f" min(coalesce({c}, {s}_fill)) AS {s}_min, max(coalesce({c}, {s}_fill)) AS {s}_max"
        for c, s in columns.items())
    return f"""
fills AS (SELECT {fills} FROM {source} WHERE {where}),
stats AS (SELECT any_value(fills) AS f, {filled} FROM {source}, fills WHERE {where})"""


def standard(column: str, short: str) -> str:
    return r6(f"(coalesce({column}, {short}_fill) - {short}_mean) / {short}_dev")


def vocabulary(name: str, column: str, source: str = "parts",
               where: str = "split = 'train'") -> str:
    return f"""
{name} AS (SELECT value, n, row_number() OVER (ORDER BY n DESC, value) AS place
  FROM (SELECT trim({column}) AS value, count(*) AS n FROM {source}
        WHERE {where} AND {column} IS NOT NULL GROUP BY 1))"""


def indicators(name: str, column: str, size: int) -> str:
    value = f"coalesce(trim({column}), (SELECT value FROM {name} WHERE place = 1))"
    parts = [
        f"CAST({value} = (SELECT value FROM {name} WHERE place = {i + 1}) AS TINYINT) "
        f"AS {column}__category_{i:03d}" for i in range(size)
    ]
    parts.append(f"CAST({value} NOT IN (SELECT value FROM {name} WHERE place <= {size}) AS TINYINT)"
                 f" AS {column}__unknown")
    return ",\n  ".join(parts)


PRICE = {"o_totalprice": "tp"}
ORDER_NUMBERS = {"o_custkey": "ck", "o_totalprice": "tp"}
PRIORITY = vocabulary("priorities", "o_orderpriority")

ORACLES["impute_mean"] = f"""{ORDER_PARTS}, {moments(PRICE, 'avg')}
SELECT o_orderkey, split, {r6('coalesce(o_totalprice, tp_fill)')} AS o_totalprice
FROM parts, fills"""
ORACLES["impute_median"] = f"""{ORDER_PARTS}, {moments(PRICE)}
SELECT o_orderkey, split, {r6('coalesce(o_totalprice, tp_fill)')} AS o_totalprice
FROM parts, fills"""
ORACLES["drop_constant_numeric"] = f"""{ORDER_PARTS},
train AS (SELECT o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN 7.0 END AS const_num,
  CAST(NULL AS DOUBLE) AS empty_num FROM parts WHERE split = 'train')
SELECT name AS "column", CASE WHEN present = 0 THEN 'all_missing_in_train'
  WHEN low = high THEN 'constant_in_train' END AS dropped, fill_num FROM (
  SELECT 'o_custkey' AS name, count(o_custkey) AS present, min(o_custkey) AS low,
    max(o_custkey) AS high, CAST(median(o_custkey) AS DOUBLE) AS fill_num FROM train
  UNION ALL SELECT 'const_num', count(const_num), min(const_num), max(const_num),
    median(const_num) FROM train
  UNION ALL SELECT 'empty_num', count(empty_num), min(empty_num), max(empty_num),
    median(empty_num) FROM train)"""
ORACLES["scale_standard"] = f"""{ORDER_PARTS}, {moments(ORDER_NUMBERS)}
SELECT o_orderkey, split, {standard('o_custkey', 'ck')} AS o_custkey,
  {standard('o_totalprice', 'tp')} AS o_totalprice FROM parts, fills, stats"""
ORACLES["scale_minmax"] = f"""{ORDER_PARTS}, {moments(ORDER_NUMBERS)}
SELECT o_orderkey, split,
  {r6('(coalesce(o_custkey, ck_fill) - ck_min) / (ck_max - ck_min)')} AS o_custkey,
  {r6('(coalesce(o_totalprice, tp_fill) - tp_min) / (tp_max - tp_min)')} AS o_totalprice
FROM parts, fills, stats"""
ORACLES["scale_none"] = f"""{ORDER_PARTS}
SELECT o_orderkey, split, CAST(o_custkey AS DOUBLE) AS o_custkey FROM parts"""
ORACLES["normalize_category"] = f"""WITH {ORDERS_DIRTY}
SELECT o_orderkey, trim(o_orderpriority) AS o_orderpriority FROM orders_dirty"""
ORACLES["impute_mode"] = f"""{ORDER_PARTS}, {PRIORITY},
{vocabulary('rare', 'mostly_missing')}
SELECT o_orderkey, split, coalesce(trim(o_orderpriority),
    (SELECT value FROM priorities WHERE place = 1)) AS o_orderpriority,
  coalesce(mostly_missing, (SELECT value FROM rare WHERE place = 1)) AS mostly_missing FROM parts"""
ORACLES["impute_missing_category"] = f"""{ORDER_PARTS}
SELECT o_orderkey, split, coalesce(trim(o_orderpriority), '__MISSING__') AS o_orderpriority,
  coalesce(mostly_missing, '__MISSING__') AS mostly_missing FROM parts"""
ORACLES["vocabulary"] = PART_PARTS + "".join(
    f", {vocabulary(c + '_v', c)}" for c in ("p_name", "p_brand", "p_type")) + " UNION ALL ".join(
    f" SELECT '{c}' AS \"column\", value, n, CAST(place AS INTEGER) AS place FROM {c}_v "
    f"WHERE place <= 50" for c in ("p_name", "p_brand", "p_type"))
ORACLES["drop_constant_category"] = f"""{ORDER_PARTS}, {PRIORITY},
{vocabulary('rare', 'mostly_missing')}, {vocabulary('consts', 'const_col')}
SELECT name AS "column", CASE WHEN distinct_values <= 1 THEN 'constant_in_train' END AS dropped,
  fill_str FROM (
  SELECT 'o_orderpriority' AS name, count(*) AS distinct_values,
    any_value(value) FILTER (place = 1) AS fill_str FROM priorities
  UNION ALL SELECT 'const_col', count(*), any_value(value) FILTER (place = 1) FROM consts
  UNION ALL SELECT 'mostly_missing', count(*), any_value(value) FILTER (place = 1) FROM rare)"""
ORACLES["one_hot"] = f"""{ORDER_PARTS}, {PRIORITY}
SELECT o_orderkey, split, {indicators('priorities', 'o_orderpriority', 5)} FROM parts"""
PART_UNKNOWN = f"""{PART_PARTS}, {vocabulary('names', 'p_name')}, {vocabulary('types', 'p_type')},
flagged AS (SELECT p_partkey, split,
  CAST(trim(p_name) NOT IN (SELECT value FROM names WHERE place <= 50) AS TINYINT)
    AS p_name__unknown,
  CAST(trim(p_type) NOT IN (SELECT value FROM types WHERE place <= 50) AS TINYINT)
    AS p_type__unknown FROM parts)"""
ORACLES["unknown_bucket"] = f"{PART_UNKNOWN} SELECT * FROM flagged"
ORACLES["unknown_counts"] = f"""{PART_UNKNOWN}
SELECT 'p_name' AS "column", CAST(sum(p_name__unknown) AS BIGINT) AS unknown FROM flagged
  WHERE split = 'test'
UNION ALL SELECT 'p_type', CAST(sum(p_type__unknown) AS BIGINT) FROM flagged WHERE split = 'test'"""
ORACLES["missing_indicator"] = f"""{ORDER_PARTS}
SELECT o_orderkey, split, CAST(o_totalprice IS NULL AS TINYINT) AS o_totalprice__is_missing,
  CAST(mostly_missing IS NULL AS TINYINT) AS mostly_missing__is_missing FROM parts"""


def number_state(column: str, short: str, ordinal: int, indicator: str = "NULL") -> str:
    return f"""
SELECT '{column}' AS "column", CAST({ordinal} AS INTEGER) AS ordinal, 'numeric' AS kind,
  'median' AS imputation, {r6(f'CAST({short}_fill AS DOUBLE)', 5)} AS fill_num,
  CAST(NULL AS VARCHAR) AS fill_str, 'standard' AS scaling, {r6(f'{short}_mean', 5)} AS center,
  {r6(f'{short}_dev', 5)} AS scale, '' AS categories, CAST(NULL AS BOOLEAN) AS truncated,
  CAST(NULL AS VARCHAR) AS unknown_output, CAST(NULL AS VARCHAR) AS dropped,
  CAST({indicator} AS VARCHAR) AS missing_indicator FROM fills, stats"""


PRIORITY_STATE = """
SELECT 'o_orderpriority', 2, 'categorical', 'most_frequent', NULL,
  (SELECT value FROM priorities WHERE place = 1), NULL, NULL, NULL,
  (SELECT string_agg(value, '|' ORDER BY place) FROM priorities WHERE place <= 50),
  (SELECT count(*) > 50 FROM priorities), 'o_orderpriority__unknown', NULL, NULL"""
ORACLES["fitted_state"] = f"""{ORDER_PARTS}, {moments(ORDER_NUMBERS)}, {PRIORITY}
{number_state('o_custkey', 'ck', 0)}
UNION ALL {number_state('o_totalprice', 'tp', 1, "'o_totalprice__is_missing'")}
UNION ALL {PRIORITY_STATE}
UNION ALL SELECT 'mostly_missing', 3, 'categorical', NULL, NULL, 'v', NULL, NULL, NULL, '', NULL,
  NULL, 'constant_in_train', 'mostly_missing__is_missing'"""
ORACLES["state_json"] = f"""{ORDER_PARTS}, {moments(ORDER_NUMBERS)}, {PRIORITY}
{number_state('o_custkey', 'ck', 0)}
UNION ALL {number_state('o_totalprice', 'tp', 1)} UNION ALL {PRIORITY_STATE}"""
ORACLES["output_schema"] = f"""{ORDER_PARTS}, {PRIORITY},
names AS (
  SELECT 0 AS a, 0 AS b, 'o_custkey' AS name UNION ALL SELECT 1, 0, 'o_totalprice'
  UNION ALL SELECT 1, 1, 'o_totalprice__is_missing'
  UNION ALL SELECT 2, place, format('o_orderpriority__category_{{:03d}}', place - 1)
    FROM priorities WHERE place <= 50
  UNION ALL SELECT 2, 1000, 'o_orderpriority__unknown'
  UNION ALL SELECT 3, 0, 'mostly_missing__is_missing' UNION ALL SELECT 4, 0, 'o_orderstatus')
SELECT CAST(row_number() OVER (ORDER BY a, b) - 1 AS INTEGER) AS position, name FROM names"""
ORACLES["supervised_pipeline"] = f"""{ORDER_PARTS}, {moments(ORDER_NUMBERS)}, {PRIORITY}
SELECT split, {standard('o_custkey', 'ck')} AS o_custkey,
  {standard('o_totalprice', 'tp')} AS o_totalprice,
  CAST(o_totalprice IS NULL AS TINYINT) AS o_totalprice__is_missing,
  {indicators('priorities', 'o_orderpriority', 5)},
  CAST(mostly_missing IS NULL AS TINYINT) AS mostly_missing__is_missing, o_orderstatus
FROM parts, fills, stats"""
LINE_NUMBERS = {"l_quantity": "q"}
ORACLES["supervised_pipeline_regression"] = f"""{LINE_PARTS}, {moments(LINE_NUMBERS)}
SELECT split, {standard('l_quantity', 'q')} AS l_quantity,
  {r6('l_extendedprice')} AS l_extendedprice FROM parts, fills, stats"""
ORACLES["cleaning_pipeline"] = f"""WITH {ORDERS_DIRTY},
parts AS (SELECT DISTINCT * FROM orders_dirty), {moments(ORDER_NUMBERS, where='TRUE')},
{vocabulary('priorities', 'o_orderpriority', where='TRUE')},
{vocabulary('states', 'o_orderstatus', where='TRUE')}
SELECT {standard('o_custkey', 'ck')} AS o_custkey, {indicators('states', 'o_orderstatus', 3)},
  {standard('o_totalprice', 'tp')} AS o_totalprice,
  CAST(o_totalprice IS NULL AS TINYINT) AS o_totalprice__is_missing,
  {indicators('priorities', 'o_orderpriority', 5)},
  CAST(mostly_missing IS NULL AS TINYINT) AS mostly_missing__is_missing
FROM parts, fills, stats"""
ORACLES["transform_stream"] = f"""
WITH parts AS (SELECT event_id, event_type,
  CASE WHEN event_id % 10 <> 0 THEN value END AS value FROM events),
{moments({'value': 'v'}, where='TRUE')}, {vocabulary('types', 'event_type', where='TRUE')}
SELECT event_id, {standard('value', 'v')} AS value,
  CAST(value IS NULL AS TINYINT) AS value__is_missing, {indicators('types', 'event_type', 5)}
FROM parts, fills, stats"""

# ---- evaluation --------------------------------------------------------------------------------------------

ORACLES["same_split_check"] = f"""{ORDER_PARTS}
, both_sides AS (
  SELECT split, o_orderkey, o_orderstatus, 1 AS sign FROM parts
  UNION ALL SELECT split, o_orderkey, CASE WHEN o_orderkey % 103 = 2 THEN 'F' ELSE o_orderstatus END, -1
  FROM parts WHERE o_orderkey % 101 <> 1),
off AS (SELECT split FROM both_sides GROUP BY split, o_orderkey, o_orderstatus HAVING sum(sign) <> 0)
SELECT part, TRUE AS compared, (SELECT count(*) FROM off WHERE off.split = part) AS mismatches
FROM (VALUES ('train'), ('test')) AS names(part)"""
ORACLES["baseline_features"] = f"""{ORDER_PARTS}, {moments(PRICE)}, {PRIORITY},
alphabet AS (SELECT value, row_number() OVER (ORDER BY value) AS place FROM priorities),
filled AS (SELECT split, coalesce(o_totalprice, tp_fill) AS price, coalesce(trim(o_orderpriority),
  (SELECT value FROM priorities WHERE place = 1)) AS priority FROM parts, fills)
SELECT CAST(0 AS INTEGER) AS feature, {r6('sum(price)', 2)} AS total, split AS part
  FROM filled GROUP BY split
UNION ALL SELECT CAST(place AS INTEGER), CAST(count(*) FILTER (priority = value) AS DOUBLE), split
  FROM filled, alphabet GROUP BY place, split
UNION ALL SELECT CAST(1 + (SELECT count(*) FROM alphabet) AS INTEGER), CAST(count(*) AS DOUBLE),
  split FROM filled GROUP BY split"""
ORACLES["classification_metrics"] = f"""
WITH scored AS (SELECT o_orderstatus AS label, CASE WHEN o_totalprice < 150000 THEN 'F'
  WHEN o_totalprice < 380000 THEN 'O' ELSE 'X' END AS prediction FROM orders),
names AS (SELECT label AS class FROM scored UNION SELECT prediction FROM scored),
per_class AS (SELECT class, count(*) FILTER (label = class) AS support,
  count(*) FILTER (prediction = class) AS predicted,
  count(*) FILTER (label = class AND prediction = class) AS hits FROM names, scored GROUP BY class)
SELECT 'accuracy' AS metric, {r6('sum(hits) / sum(support)')} AS value FROM per_class
UNION ALL SELECT 'balanced_accuracy', {r6('avg(hits / support) FILTER (support > 0)')}
  FROM per_class
UNION ALL SELECT 'f1_weighted',
  {r6('sum(support * 2 * hits / (support + predicted)) / sum(support)')} FROM per_class"""
REGRESSION = """
  SELECT avg(abs(label - prediction)) AS mae, sqrt(avg(pow(label - prediction, 2))) AS rmse,
    1 - sum(pow(label - prediction, 2)) / (count(*) * var_pop(label)) AS r2"""
ORACLES["regression_metrics"] = f"""
WITH scored AS (SELECT l_extendedprice AS label, l_quantity * 1500 + l_discount AS prediction
  FROM lineitem), m AS ({REGRESSION} FROM scored)
SELECT 'mae' AS metric, {r6('mae', 4)} AS value FROM m
UNION ALL SELECT 'rmse', {r6('rmse', 4)} FROM m UNION ALL SELECT 'r2', {r6('r2', 4)} FROM m"""


def ridge(name: str, x: str) -> str:
    """One-feature ridge with penalty 1: predictions on the test part."""
    return f"""
{name}_fit AS (SELECT avg({x}) AS mx, avg(l_extendedprice) AS my, covar_pop({x}, l_extendedprice)
    * count(*) / (var_pop({x}) * count(*) + 1) AS slope
  FROM parts, fills, stats WHERE split = 'train'),
{name} AS (SELECT l_extendedprice AS label, my + slope * ({x} - mx) AS prediction
  FROM parts, fills, stats, {name}_fit WHERE split = 'test')"""


BASE_X = "coalesce(l_quantity, q_fill)"
FULL_X = "((coalesce(l_quantity, q_fill) - q_mean) / q_dev)"
ORACLES["fit_ridge"] = f"""{LINE_PARTS}, {moments(LINE_NUMBERS)}, {ridge('complete', FULL_X)}
SELECT {r6('label', 3)} AS label, {r6('prediction', 3)} AS prediction FROM complete"""
ORACLES["scheme_comparison"] = f"""{LINE_PARTS}, {moments(LINE_NUMBERS)},
{ridge('base', BASE_X)}, {ridge('complete', FULL_X)},
b AS ({REGRESSION} FROM base), c AS ({REGRESSION} FROM complete)
SELECT 'mae' AS metric, {r6('b.mae', 4)} AS baseline, {r6('c.mae', 4)} AS complete FROM b, c
UNION ALL SELECT 'rmse', {r6('b.rmse', 4)}, {r6('c.rmse', 4)} FROM b, c
UNION ALL SELECT 'r2', {r6('b.r2', 4)}, {r6('c.r2', 4)} FROM b, c"""
ORACLES["numeric_target"] = f"""WITH {ORDERS_DIRTY}
SELECT o_orderkey, {r6('TRY_CAST(num_text AS DOUBLE)')} AS num_text FROM orders_dirty
WHERE TRY_CAST(num_text AS DOUBLE) IS NOT NULL"""
ORACLES["evaluation_off"] = f"""{ORDER_PARTS}
SELECT split AS part, count(*) AS rows, FALSE AS scored FROM parts GROUP BY split"""

# ---- sources, records, catalog ---------------------------------------------------------------------------------

ORACLES["csv_scan"] = """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
  strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority FROM orders"""
ORACLES["xlsx_ingest"] = """
SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size, p_retailprice
FROM part"""
ORACLES["csv_dialects"] = """
SELECT d.dialect, 'utf-8' AS encoding, d.delimiter,
  (SELECT string_agg(column_name, '|') FROM (DESCRIBE customer)) AS header
FROM (VALUES ('comma', ','), ('pipe', '|'), ('semicolon', ';'), ('tab', chr(9)))
  d(dialect, delimiter)"""
ORACLES["header_validate"] = """
SELECT 'blank' AS folder, 'blank_header' AS problem
UNION ALL SELECT 'repeated', 'duplicate_header'"""
ORACLES["corrupt_rows"] = """
SELECT CAST(o_orderkey AS VARCHAR) || ',' ||
  CASE WHEN o_orderkey % 103 = 0 THEN 'oops' ELSE CAST(o_custkey AS VARCHAR) END || ',' ||
  o_orderstatus || CASE WHEN o_orderkey % 101 = 0 THEN ',extra' ELSE '' END AS line
FROM orders WHERE o_orderkey % 103 = 0 OR o_orderkey % 101 = 0"""
ORACLES["parquet_roundtrip"] = f"WITH {ORDERS_DIRTY} SELECT * FROM orders_dirty"
ORACLES["csv_bom_export"] = """
SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size, p_retailprice
FROM part"""
def exact(value: str) -> str:
    """A value's text after its length; a present one has a mark before it, null is a mark alone."""
    text = f"coalesce('=' || CAST({value} AS VARCHAR), chr(1))"
    return f"length({text}) || ':' || {text}"


FINGERPRINT = f"""WITH {ORDERS_DIRTY},
texts AS (SELECT md5({" || ".join(map(exact, ORDER_COLUMNS))}) AS digest FROM orders_dirty),
fingerprint AS (SELECT count(*) AS rows, {" || '-' || ".join(
    f"CAST(sum(CAST(CAST('0x' || substr(digest, {i}, 16) AS UBIGINT) AS HUGEINT)) AS VARCHAR)"
    for i in (1, 17))} AS fingerprint FROM texts)"""
ORACLES["table_fingerprint"] = f"{FINGERPRINT} SELECT rows, fingerprint FROM fingerprint"
ORACLES["run_manifest"] = f"""{FINGERPRINT}, {ORDER_PARTS.removeprefix(f'WITH {ORDERS_DIRTY},')},
{PRIORITY}
SELECT 'r1' AS run_id, (SELECT fingerprint FROM fingerprint) AS source_fingerprint,
  'classification' AS task, 'o_orderstatus' AS target_column,
  count(*) FILTER (split = 'train') AS train_rows, count(*) FILTER (split = 'test') AS test_rows,
  (SELECT count(*) FROM (SELECT DISTINCT * FROM orders_dirty) WHERE o_orderstatus IS NULL)
  AS target_missing_rows, TRUE AS stratified,
  CAST(5 + (SELECT count(*) FROM priorities) AS INTEGER) AS outputs FROM parts"""
RUNS = """runs AS (SELECT o_custkey AS project_id, o_orderkey AS run_id, o_orderdate AS created_at,
  o_orderpriority AS upstream FROM orders)"""
ORACLES["latest_run"] = f"""WITH {RUNS}
SELECT project_id, run_id, created_at, upstream FROM runs QUALIFY row_number() OVER
  (PARTITION BY project_id ORDER BY created_at DESC, run_id DESC) = 1"""
ORACLES["stale_runs"] = f"""WITH {RUNS},
current_state AS (SELECT c_custkey AS project_id, CASE WHEN c_custkey % 2 = 0 THEN '1-URGENT'
  ELSE '5-LOW' END AS upstream FROM customer)
SELECT project_id, run_id, created_at, runs.upstream AS upstream FROM runs
JOIN current_state c USING (project_id) WHERE runs.upstream <> c.upstream"""
PROJECTS = """projects AS (
  SELECT p_partkey AS id, p_name AS name, p_brand || '.CSV' AS source_filename,
    ['classification', 'regression', 'clustering_prep', 'cleaning'][p_partkey % 4 + 1] AS task_type,
    CASE WHEN p_partkey % 3 = 0 THEN 'processing' ELSE 'ready' END AS status,
    CAST(p_size AS BIGINT) * 1024 AS source_size, p_partkey * 7919 % 100003 AS created_at FROM part),
labelled AS (SELECT *, CASE task_type WHEN 'classification' THEN '分类'
  WHEN 'regression' THEN '回归' WHEN 'clustering_prep' THEN '聚类预处理'
  ELSE '纯数据清洗' END AS label FROM projects)"""
ORACLES["catalog_list"] = f"""WITH {PROJECTS}
SELECT id, name, created_at FROM projects ORDER BY created_at DESC, id"""
ORACLES["catalog_search"] = f"WITH {PROJECTS} " + " UNION ALL ".join(
    f"SELECT CAST({i} AS INTEGER) AS search, id FROM labelled WHERE contains(lower(name), '{q}') "
    f"OR contains(lower(source_filename), '{q}') OR contains(lower(label), '{q}')"
    for i, q in enumerate(("red", "brand#2.csv", "分类")))
ORACLES["catalog_summary"] = f"""WITH {PROJECTS}
SELECT count(*) FILTER (status IN ('processing', 'running')) AS active,
  CAST(sum(source_size) AS BIGINT) AS storage FROM projects"""
ORACLES["run_summary"] = f"""{ORDER_CONFIRMED}, {SCORES}, {recs()},
{ORDER_PARTS.removeprefix(f'WITH {ORDERS_DIRTY},')}
SELECT 'rows' AS section, split AS name, CAST(count(*) AS DOUBLE) AS value FROM parts GROUP BY split
UNION ALL SELECT 'quality', dimension, CAST(score AS DOUBLE) FROM report
UNION ALL SELECT 'applied_rule', id, CAST(1 AS DOUBLE) FROM recs WHERE enabled"""
