"""SQL counterpart of each registered query, written for DuckDB on the same tables.

Statements are put together from named common table expressions. They state results in
their own way (calendar joins instead of windows, regression aggregates, built-in
percentiles) so that agreement means something.
"""

from seasonwise.plans.catalog import MODEL_YEARS, SHOWN_YEARS, SPECIAL_PERCENT, YEAR
from seasonwise.schemas import MONTH_NAMES

TEXT_NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"

CTES = {}
# Steps that several others build on.
COMPUTED_ONCE = set()


def cte(name: str, body: str, *needs: str):
    CTES[name] = (needs, body)


def statement(final: str, *needs: str) -> str:
    ordered: list[str] = []

    def visit(name):
        for need in CTES[name][0]:
            visit(need)
        if name not in ordered:
            ordered.append(name)

    for need in needs:
        visit(need)
    parts = ",\n".join(f"{n} AS {'MATERIALIZED ' if n in COMPUTED_ONCE else ''}({CTES[n][1]})"
                       for n in ordered)
    return f"WITH {parts}\n{final}" if parts else final


def r(expression: str, digits: int = 6) -> str:
    """Rounded double without a negative zero."""
    return f"(round({expression}, {digits}) + 0.0)"


def even(expression: str, digits: int = 0) -> str:
    """Half-even rounding."""
    if digits == 0:
        return f"round_even({expression}, 0)"
    scale = f"{10 ** digits}.0::DOUBLE"
    return f"(round_even(({expression}) * {scale}, 0) / {scale})"


def whole(expression: str) -> str:
    return f"CAST(trunc({expression}) AS BIGINT)"


# Inputs

cte("f1_all", """
SELECT CAST(l_shipdate AS DATE) AS date, l_suppkey AS product_code,
       CASE WHEN l_returnflag = 'R' THEN 0.0::DOUBLE ELSE l_quantity END AS turnover_qty,
       l_discount * 100 AS discount_pct, l_extendedprice * (1 - l_discount) AS turnover_net
FROM lineitem""")
cte("dim1", """
SELECT s_suppkey AS product_code, r_name AS category, n_name AS "group",
       n_name || '/' || CAST(s_suppkey % 2 AS VARCHAR) AS subgroup
FROM supplier JOIN nation ON s_nationkey = n_nationkey
              JOIN region ON n_regionkey = r_regionkey""")
cte("f1", 'SELECT f1_all.*, category, "group", subgroup FROM f1_all LEFT JOIN dim1 USING (product_code)',
    "f1_all", "dim1")
cte("f1_two", f"SELECT * FROM f1 WHERE year(date) IN {MODEL_YEARS}", "f1")
cte("f1_year", f"SELECT * FROM f1 WHERE year(date) = {YEAR}", "f1")
cte("f2", """
SELECT CAST(l_shipdate AS DATE) AS date, l_partkey AS product_code,
       CASE WHEN l_returnflag = 'R' THEN 0.0::DOUBLE ELSE l_quantity END AS turnover_qty,
       p_type AS category, p_brand AS "group", p_brand || '#' || CAST(p_size AS VARCHAR) AS subgroup
FROM lineitem LEFT JOIN part ON l_partkey = p_partkey""")
cte("dirty", r"""
SELECT CAST(l_suppkey AS VARCHAR) AS product_code, strftime(l_shipdate, '%Y-%m-%d') AS date,
       CASE WHEN l_linenumber = 7 THEN 'n/a' WHEN l_linenumber = 6 THEN '1,5'
            WHEN l_linenumber = 5 THEN '1d'
            WHEN l_linenumber = 4 THEN regexp_replace(CAST(s * 1000 AS VARCHAR),
                 '([0-9])([0-9]{3})($|[.])', '\1 \2\3', 'g')
            ELSE CAST(s AS VARCHAR) END AS turnover_qty,
       replace(regexp_replace(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR),
               '([0-9])([0-9]{3})($|[.])', '\1 \2\3', 'g'), '.', ',') AS turnover_net,
       replace(CAST(CAST(l_discount * 100 AS DECIMAL(18,2)) AS VARCHAR), '.', ',') || '%'
       AS discount_pct
FROM (SELECT *, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * CAST(l_quantity AS BIGINT) AS s
      FROM lineitem)""")
cte("clean", f"""
SELECT CAST(date AS DATE) AS date, CAST(product_code AS BIGINT) AS product_code,
       greatest(CAST(replace(turnover_qty, ' ', '') AS DOUBLE), 0.0::DOUBLE) AS turnover_qty,
       CAST(replace(replace(discount_pct, '%', ''), ',', '.') AS DOUBLE) AS discount_pct,
       CAST(replace(replace(turnover_net, ',', '.'), ' ', '') AS DOUBLE) AS turnover_net
FROM (SELECT * FROM dirty
      WHERE CASE WHEN regexp_full_match(replace(turnover_qty, ' ', ''), '{TEXT_NUMBER}')
                 THEN true ELSE false END)""", "dirty")
cte("dirty_dim", """
SELECT CAST(product_code AS VARCHAR) AS product_code,
       '[' || category[1] || ']' || category[2:] AS category,
       '[' || "group"[1] || ']' || "group"[2:] AS "group",
       '[' || subgroup[1] || ']' || subgroup[2:] AS subgroup FROM dim1""", "dim1")
cte("asked", """
SELECT 'category-' || r_regionkey AS request_id, r_name AS request FROM region
UNION ALL SELECT 'group-' || n_nationkey, n_name FROM nation
UNION ALL SELECT 'subgroup-' || n_nationkey, n_name || '/0' FROM nation
UNION ALL SELECT 'product-' || s_suppkey, CAST(s_suppkey AS VARCHAR) FROM supplier
UNION ALL SELECT 'unknown-' || c_custkey, c_name FROM customer""")
cte("asked_parsed", """
SELECT request_id, request,
       CASE WHEN regexp_full_match(trim(request), '[+-]?[0-9]+([.][0-9]*)?')
            THEN CAST(regexp_extract(trim(request), '^[+-]?[0-9]+') AS BIGINT) END AS product_code,
       CASE WHEN NOT regexp_full_match(trim(request), '[+-]?[0-9]+([.][0-9]*)?')
            THEN request END AS name
FROM asked""", "asked")

LEVEL_COLUMNS = (("product", "CAST(product_code AS VARCHAR)"), ("subgroup", "subgroup"),
                 ("group", '"group"'), ("category", "category"))


def long_form(source: str, levels=None) -> str:
    return " UNION ALL ".join(
        f"SELECT '{level}' AS level, {column} AS entity, * FROM {source} WHERE {column} IS NOT NULL"
        for level, column in LEVEL_COLUMNS if levels is None or level in levels)


def series_cte(name: str, source: str, unit: str, levels=None):
    """Gap-filled sums by way of a calendar of each entity's own range."""
    time = "month_start" if unit == "month" else "day"
    cte(f"{name}_long", long_form(source, levels), source)
    cte(f"{name}_sum", f"""
SELECT level, entity, CAST(date_trunc('{unit}', date) AS DATE) AS {time},
       sum(turnover_qty) AS turnover FROM {name}_long GROUP BY ALL""", f"{name}_long")
    cte(f"{name}_cal", f"""
SELECT level, entity, CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP),
       INTERVAL 1 {unit})) AS DATE) AS {time}
FROM (SELECT level, entity, min({time}) AS a, max({time}) AS b FROM {name}_sum GROUP BY ALL)""",
        f"{name}_sum")
    cte(name, f"""
SELECT level, entity, {time}, coalesce(turnover, 0.0::DOUBLE) AS turnover
FROM {name}_cal LEFT JOIN {name}_sum USING (level, entity, {time})""",
        f"{name}_cal", f"{name}_sum")


UPPER = ("subgroup", "group", "category")
series_cte("m1", "f1", "month")
series_cte("m1_upper", "f1", "month", UPPER)
series_cte("m1_group", "f1", "month", ("group",))
series_cte("m1_two_top", "f1", "month", ("group", "category"))
series_cte("m1_pair", "f1_two", "month")
series_cte("m1_product", "f1", "month", ("product",))
series_cte("m2", "f2", "month")
cte("f2_two", f"SELECT * FROM f2 WHERE year(date) IN {MODEL_YEARS}", "f2")
series_cte("m2_pair", "f2_two", "month", ("product",))
series_cte("m2_product", "f2", "month", ("product",))
series_cte("d1", "f1", "day")
series_cte("d1_upper", "f1", "day", UPPER)

cte("known", "SELECT DISTINCT product_code, category, \"group\", subgroup FROM f1", "f1")
cte("known_long", long_form("known"), "known")
cte("resolved", """
SELECT request_id, request, level, entity, level IS NOT NULL AS found FROM (
  SELECT a.request_id, a.request, k.level, k.entity, row_number() OVER (
           PARTITION BY a.request_id ORDER BY CASE k.level WHEN 'category' THEN 1
           WHEN 'group' THEN 2 WHEN 'subgroup' THEN 3 ELSE 0 END) AS rn
  FROM asked_parsed a LEFT JOIN (SELECT DISTINCT level, entity FROM known_long) k
    ON (a.product_code IS NOT NULL AND k.level = 'product'
        AND k.entity = CAST(a.product_code AS VARCHAR))
    OR (a.name IS NOT NULL AND k.level <> 'product' AND k.entity = a.name))
WHERE rn = 1""", "asked_parsed", "known_long")

SQL = {}

# Sources and cleaning

SQL["src1_raw_sales"] = statement(
    "SELECT product_code, date, turnover_qty, turnover_net, discount_pct FROM dirty", "dirty")
SQL["src2_raw_products"] = statement("SELECT * FROM dirty_dim", "dirty_dim")
SQL["src3_prepared"] = statement(
    f'SELECT date, product_code, turnover_qty, {r("discount_pct")} AS discount_pct, '
    f'{r("turnover_net")} AS turnover_net, category, "group", subgroup FROM f1', "f1")
# Lines of a folder, written out again for each layout.
cte("folder", CTES["dirty"][1].replace("SELECT CAST(l_suppkey", "SELECT l_orderkey, l_partkey, "
                                       "CAST(l_suppkey", 1))
cte("folder_lines", f"""
SELECT 'part-' || n AS file, CASE WHEN l_orderkey % 50 = 0 THEN
       array_to_string(string_split(line, ';')[1:2], ';') ELSE line END AS line, *
       EXCLUDE (line),
       CASE WHEN n = 3 THEN 'header' WHEN l_orderkey % 50 = 0 THEN 'columns'
            WHEN l_orderkey % 41 = 0 THEN 'date'
            WHEN NOT regexp_full_match(replace(turnover_qty, ' ', ''), '{TEXT_NUMBER}')
            THEN 'quantity' WHEN l_partkey % 37 = 0 THEN 'money' END AS reason
FROM (SELECT *, CASE n WHEN 1 THEN concat_ws(';', discount_pct, turnover_net, '"a;""b""' || '"',
                                             turnover_qty, date, product_code)
                       WHEN 2 THEN concat_ws(';', date, product_code, discount_pct, turnover_qty,
                                             turnover_net)
                       ELSE concat_ws(';', product_code, date, turnover_qty, turnover_net,
                                      discount_pct) END AS line
      FROM (SELECT * REPLACE (CASE WHEN l_orderkey % 41 = 0 THEN '31.12.1996' ELSE date END AS date,
                              CASE WHEN l_partkey % 37 = 0 THEN 'abc' ELSE turnover_net END
                              AS turnover_net),
                   CASE WHEN l_orderkey % 97 = 1 THEN 3 ELSE l_orderkey % 3 END AS n
            FROM folder))""", "folder")
SQL["src1_folder_sales"] = statement("""
SELECT product_code, date, turnover_qty, turnover_net, discount_pct FROM folder_lines
WHERE reason IS NULL""", "folder_lines")
SQL["src1_rejects"] = statement(
    "SELECT file, reason, line FROM folder_lines WHERE reason IS NOT NULL", "folder_lines")
SQL["src1_reject_counts"] = statement("""
SELECT file, coalesce(reason, 'ok') AS reason, count(*) AS n_lines FROM folder_lines GROUP BY ALL""",
                                      "folder_lines")
SQL["src4_requests"] = statement("SELECT * FROM asked_parsed", "asked_parsed")
SQL["cln1_percent"] = statement("""
SELECT discount_pct, CAST(replace(replace(discount_pct, '%', ''), ',', '.') AS DOUBLE) AS value
FROM dirty""", "dirty")
SQL["cln2_money"] = statement("""
SELECT turnover_net, CAST(replace(replace(turnover_net, ',', '.'), ' ', '') AS DOUBLE) AS value
FROM dirty""", "dirty")
SQL["cln3_quantity"] = statement(f"""
SELECT turnover_qty, CAST(replace(turnover_qty, ' ', '') AS DOUBLE) AS value FROM (
  SELECT * FROM dirty
  WHERE regexp_full_match(replace(turnover_qty, ' ', ''), '{TEXT_NUMBER}'))""", "dirty")
SQL["cln4_returns"] = statement("SELECT * FROM clean", "clean")
SQL["cln5_brackets"] = statement("SELECT * FROM dim1", "dim1")
SQL["cln6_date"] = statement(
    "SELECT date AS date_text, CAST(date AS DATE) AS date FROM dirty", "dirty")
SQL["cln7_year"] = statement(f"SELECT * FROM clean WHERE year(date) = {YEAR}", "clean")
SQL["cln8_hierarchy"] = statement(
    f'SELECT date, product_code, turnover_qty, discount_pct, turnover_net, category, "group", '
    "subgroup FROM clean LEFT JOIN dim1 USING (product_code)", "clean", "dim1")
SQL["cln9_month"] = statement(
    "SELECT date, product_code, CAST(month(date) AS INTEGER) AS month, turnover_qty FROM f1_all",
    "f1_all")


def shown(expression: str, digits: int, sign: str = "") -> str:
    return f"replace(printf('%{sign}.{digits}f', {expression}), '.', ',')"


SQL["cln10_display"] = statement(f"""
SELECT product_code, date, {shown("turnover_qty", 0)} AS whole,
       {shown("turnover_net / 1000", 2)} AS plain, {shown("turnover_qty - 20", 2, "+")} AS signed
FROM f1_all""", "f1_all")

# Promo day

cte("base2", f"""
SELECT product_code, CAST(month(date) AS INTEGER) AS month, {even("avg(turnover_qty)")} AS baseline
FROM f2 WHERE day(date) <> 15 GROUP BY ALL""", "f2")
cte("gate1", """
SELECT product_code, count(*) AS months FROM base2 GROUP BY ALL HAVING count(*) <> 12""", "base2")
cte("gate2", """
SELECT product_code, count(DISTINCT month(date)) AS months FROM f2
WHERE product_code NOT IN (SELECT product_code FROM gate1)
GROUP BY ALL HAVING count(DISTINCT month(date)) = 12""", "f2", "gate1")
cte("free2", """
SELECT date, f2.product_code, CAST(month(date) AS INTEGER) AS month,
       CASE WHEN day(date) = 15 THEN coalesce(baseline, turnover_qty) ELSE turnover_qty END
       AS turnover_qty
FROM f2 JOIN gate2 USING (product_code)
LEFT JOIN base2 ON base2.product_code = f2.product_code AND base2.month = month(f2.date)""",
    "f2", "gate2", "base2")
SQL["prm1_baseline"] = statement("SELECT * FROM base2", "base2")
SQL["prm2_incomplete"] = statement("SELECT * FROM gate1", "gate1")
SQL["prm3_neutralised"] = statement("SELECT * FROM free2", "free2")
SQL["prm4_complete"] = statement("SELECT * FROM gate2", "gate2")
SQL["prm_months"] = statement("""
SELECT product_code, CAST(date_trunc('month', date) AS DATE) AS month_start,
       sum(turnover_qty) AS turnover FROM free2 GROUP BY ALL""", "free2")

SQL["prm_days"] = statement("""
SELECT product_code, date AS day, sum(turnover_qty) AS turnover FROM free2 GROUP BY ALL""",
                            "free2")
cte("free2_named", """
SELECT date, product_code, turnover_qty, p_type AS category, p_brand AS "group",
       p_brand || '#' || CAST(p_size AS VARCHAR) AS subgroup
FROM free2 LEFT JOIN part ON product_code = p_partkey""", "free2")
series_cte("m2_free", "free2_named", "month", UPPER)
SQL["prm_group_months"] = statement("SELECT * FROM m2_free", "m2_free")

# Selection

SQL["sel1_resolve"] = statement("SELECT * FROM resolved", "resolved")
SQL["sel2_rows"] = statement("""
SELECT request_id, date, product_code, turnover_qty, category, "group", subgroup
FROM resolved JOIN f1 ON CASE level WHEN 'product' THEN CAST(product_code AS VARCHAR)
     WHEN 'category' THEN category WHEN 'group' THEN "group" ELSE subgroup END = entity""",
    "resolved", "f1")
SQL["sel2_entity_rows"] = statement("""
SELECT a.level, a.entity, date, product_code, turnover_qty, category, "group", subgroup
FROM (SELECT DISTINCT level, entity FROM resolved WHERE found) a
JOIN f1 ON CASE a.level WHEN 'product' THEN CAST(product_code AS VARCHAR)
     WHEN 'category' THEN category WHEN 'group' THEN "group" ELSE subgroup END = a.entity""",
    "resolved", "f1")
SQL["sel3_filter"] = statement("""
SELECT date, product_code, turnover_qty, category, "group", subgroup FROM f1
WHERE category = 'ASIA' AND date BETWEEN DATE '1996-03-01' AND DATE '1998-09-30'""", "f1")
cte("ranges", """
SELECT request_id, level, CASE level WHEN 'product' THEN CAST(product_code AS VARCHAR)
       WHEN 'subgroup' THEN subgroup WHEN 'group' THEN "group" ELSE category END AS entity,
       start_date, end_date
FROM (SELECT o_orderkey AS request_id, o_custkey % 103 AS product_code,
             CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderdate AS DATE) - 30 END AS start_date,
             CASE WHEN o_orderkey % 13 <> 0 THEN CAST(o_orderdate AS DATE)
                  + CAST(o_orderkey % 700 AS INTEGER) - 50 END AS end_date,
             ['product', 'subgroup', 'group', 'category'][o_orderkey % 4 + 1] AS level FROM orders)
LEFT JOIN dim1 USING (product_code)""", "dim1")
cte("sold_days", """
SELECT 'product' AS level, CAST(product_code AS VARCHAR) AS entity, date, sum(turnover_qty) AS q
FROM f1 GROUP BY ALL
UNION ALL SELECT 'subgroup', subgroup, date, sum(turnover_qty) FROM f1 GROUP BY ALL
UNION ALL SELECT 'group', "group", date, sum(turnover_qty) FROM f1 GROUP BY ALL
UNION ALL SELECT 'category', category, date, sum(turnover_qty) FROM f1 GROUP BY ALL""", "f1")
SQL["sel3_ranges"] = statement(f"""
SELECT r.request_id, r.level, r.entity, start_date, end_date, CASE WHEN known THEN {r("coalesce(sum(q), 0.0::DOUBLE)")} END AS turnover,
       CASE WHEN known THEN count(q) END AS active_days
FROM (SELECT *, (level, entity) IN (SELECT (level, entity) FROM sold_days) AS known FROM ranges) r
LEFT JOIN sold_days d ON d.level = r.level AND d.entity = r.entity
     AND d.date >= coalesce(start_date, DATE '1900-01-01')
     AND d.date <= coalesce(end_date, DATE '2900-01-01')
GROUP BY r.request_id, r.level, r.entity, start_date, end_date, known""", "ranges", "sold_days")
SQL["sel4_choices"] = statement("""
SELECT *, CAST(rank() OVER (PARTITION BY parent_level, parent ORDER BY child) AS INTEGER)
       AS position FROM (
SELECT DISTINCT 'category' AS parent_level, category AS parent, 'group' AS child_level,
       "group" AS child FROM f1
UNION ALL SELECT DISTINCT 'group', "group", 'subgroup', subgroup FROM f1
UNION ALL SELECT DISTINCT 'subgroup', subgroup, 'product', CAST(product_code AS VARCHAR) FROM f1)
""", "f1")
SQL["sel4_groups_of_category"] = statement(
    "SELECT DISTINCT \"group\" FROM f1 WHERE category = 'ASIA'", "f1")
SQL["sel5_values"] = statement("""
SELECT *, CAST(row_number() OVER (PARTITION BY level ORDER BY value) AS INTEGER) AS position
FROM (SELECT DISTINCT level, entity AS value FROM known_long)""", "known_long")
SQL["sel6_bounds"] = statement(
    "SELECT min(date) AS min_date, max(date) AS max_date FROM f1_all", "f1_all")
cte("selected", """
SELECT request_id, k.* EXCLUDE (level, entity) FROM resolved JOIN known_long k
USING (level, entity)""", "resolved", "known_long")
SQL["sel2_wanted_rows"] = statement("""
SELECT date, product_code, turnover_qty, n_requests FROM f1_all JOIN (
  SELECT product_code, count(DISTINCT request_id) AS n_requests FROM selected GROUP BY product_code)
USING (product_code)""", "f1_all", "selected")
SQL["sel7_level"] = statement("""
SELECT request_id,
       CASE WHEN count(DISTINCT product_code) = 1 THEN 'product'
            WHEN count(DISTINCT subgroup) = 1 THEN 'subgroup'
            WHEN count(DISTINCT "group") = 1 THEN 'group'
            WHEN count(DISTINCT category) = 1 THEN 'category' END AS level,
       CASE WHEN count(DISTINCT product_code) = 1 THEN CAST(any_value(product_code) AS VARCHAR)
            WHEN count(DISTINCT subgroup) = 1 THEN any_value(subgroup)
            WHEN count(DISTINCT "group") = 1 THEN any_value("group")
            WHEN count(DISTINCT category) = 1 THEN any_value(category) END AS entity
FROM selected GROUP BY request_id""", "selected")

# Series

SQL["ts1_monthly"] = statement("SELECT * FROM m1_upper", "m1_upper")
SQL["ts2_daily"] = statement("SELECT * FROM d1_upper", "d1_upper")
SQL["ts3_product_monthly"] = statement("SELECT * FROM m2_product", "m2_product")
SQL["ts4_all_levels"] = statement("SELECT * FROM m2", "m2")
cte("w24", """
SELECT level, entity, CAST(row_number() OVER (PARTITION BY level, entity ORDER BY month_start)
       AS INTEGER) AS t, month_start, turnover
FROM (SELECT *, row_number() OVER (PARTITION BY level, entity ORDER BY month_start) AS rn
      FROM m1_pair)
WHERE rn <= 12 OR rn >= 25
QUALIFY count(*) OVER (PARTITION BY level, entity) = 24""", "m1_pair")
SQL["ts5_model_window"] = statement("SELECT * FROM w24", "w24")
SQL["ts5_without_window"] = statement("""
SELECT level, entity, min(month_start) AS first, max(month_start) AS last,
       CAST(count(*) AS INTEGER) AS periods FROM m2_pair GROUP BY level, entity
HAVING count(*) <> 36""", "m2_pair")
SQL["ts6_calendar_product"] = statement("""
SELECT product_code, CAST(month(date) AS INTEGER) AS month, sum(turnover_qty) AS turnover
FROM f2 GROUP BY ALL""", "f2")
SQL["ts6_calendar_group"] = statement("""
SELECT "group", CAST(month(date) AS INTEGER) AS month, sum(turnover_qty) AS turnover
FROM f2 WHERE "group" IS NOT NULL GROUP BY ALL""", "f2")
(FROM_YEAR, TO_YEAR), = SHOWN_YEARS.items()
SQL["ts7_month_label"] = statement(f"""
SELECT level, entity, month_start,
       replace(strftime(month_start, '%m/%Y'), '{FROM_YEAR}', '{TO_YEAR}') AS month_label
FROM m1_group""", "m1_group")
NAME_LIST = "[" + ", ".join(f"'{n}'" for n in MONTH_NAMES) + "]"
SQL["ts8_month_name"] = statement(f"""
SELECT CAST(month(date) AS INTEGER) AS month, {NAME_LIST}[month(date)] AS month_name,
       sum(turnover_qty) AS turnover FROM f1_all GROUP BY ALL""", "f1_all")

# Descriptive statistics

SQL["dsc1_card"] = statement("""
SELECT level, entity,
       CASE WHEN level IN ('product', 'subgroup') THEN min(subgroup) END AS subgroup,
       CASE WHEN level <> 'category' THEN min("group") END AS "group",
       min(category) AS category,
       CASE WHEN level <> 'product' THEN count(DISTINCT product_code) END AS n_products,
       CASE WHEN level IN ('group', 'category') THEN count(DISTINCT subgroup) END AS n_subgroups,
       CASE WHEN level = 'category' THEN count(DISTINCT "group") END AS n_groups
FROM known_long GROUP BY level, entity""", "known_long")
SQL["dsc2_statistics"] = statement(f"""
SELECT level, entity, {whole(even("avg(turnover)"))} AS mean,
       {whole("stddev_samp(turnover)")} AS std, {whole("min(turnover)")} AS min,
       {whole("max(turnover)")} AS max, {whole("quantile_cont(turnover, 0.5)")} AS median,
       {whole("quantile_cont(turnover, 0.25)")} AS q1,
       {whole("quantile_cont(turnover, 0.75)")} AS q3,
       {whole("stddev_samp(turnover) / nullif(avg(turnover), 0) * 100")} AS cv_pct
FROM m1 GROUP BY level, entity""", "m1")
cte("quartiles", """
SELECT level, entity, quantile_cont(turnover, 0.25) AS q1, quantile_cont(turnover, 0.5) AS q2,
       quantile_cont(turnover, 0.75) AS q3, avg(turnover) AS mean, min(turnover) AS low
FROM m1 GROUP BY level, entity""", "m1")
SQL["dsc3_boxplot"] = statement(f"""
SELECT level, entity, any_value(low) AS lower_fence, {whole(even("any_value(q1)"))} AS q1,
       {whole(even("any_value(q2)"))} AS median, {whole(even("any_value(mean)"))} AS mean,
       {whole(even("any_value(q3)"))} AS q3,
       max(turnover) FILTER (WHERE turnover < q3 + (q3 - q1) * 1.5) AS upper_fence
FROM m1 JOIN quartiles USING (level, entity) GROUP BY level, entity""", "m1", "quartiles")
SQL["dsc4_line"] = statement(f"""
SELECT level, entity, month_start, {NAME_LIST}[month(month_start)] AS month_name, turnover
FROM m1_two_top""", "m1_two_top")

# Seasonality

for suffix, source in (("1", "f1"), ("2", "f2")):
    cte(f"coef{suffix}", f"""
SELECT product_code, month, turnover,
       turnover / nullif(avg(turnover) OVER (PARTITION BY product_code), 0) AS coefficient,
       category, "group", subgroup
FROM (SELECT product_code, category, "group", subgroup, CAST(month(date) AS INTEGER) AS month,
             sum(turnover_qty) AS turnover FROM {source} GROUP BY ALL)""", source)
(SPECIAL, PERCENT), = SPECIAL_PERCENT.items()
cte("threshold1", f"""
SELECT category, {even(f'''CASE WHEN category = '{SPECIAL}'
       THEN quantile_cont(coefficient, {PERCENT / 100}) ELSE quantile_cont(coefficient, 0.75) END''',
                       2)} AS threshold FROM coef1 GROUP BY category""", "coef1")
SQL["sea1_coefficients"] = statement(f"""
SELECT product_code, month, turnover, {r("coefficient")} AS coefficient, category, "group", subgroup
FROM coef2""", "coef2")
SQL["sea2_threshold"] = statement("SELECT * FROM threshold1", "threshold1")
SQL["sea2_threshold_parts"] = statement(f"""
SELECT category, {even("quantile_cont(coefficient, 0.75)", 2)} AS threshold
FROM coef2 GROUP BY category""", "coef2")
SQL["sea2_threshold_promo_free"] = statement(f"""
SELECT category, {even("quantile_cont(coefficient, 0.75)", 2)} AS threshold
FROM (SELECT product_code, category,
             turnover / nullif(avg(turnover) OVER (PARTITION BY product_code), 0) AS coefficient
      FROM (SELECT product_code, category, month(date) AS month, sum(turnover_qty) AS turnover
            FROM free2_named GROUP BY ALL))
GROUP BY category""", "free2_named")
SQL["sea3_request_category"] = statement("""
SELECT request_id, level, entity, min(category) AS category
FROM resolved JOIN known_long USING (level, entity) GROUP BY ALL""", "resolved", "known_long")
SQL["sea4_histogram"] = statement(f"""
SELECT category, {r("bin / 10.0::DOUBLE")} AS bin_start, n,
       {r("n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY category)")} AS share_pct
FROM (SELECT category, floor(coefficient * 10) AS bin, count(*) AS n FROM coef2
      WHERE coefficient < 5 GROUP BY ALL)""", "coef2")
CLASS = """CASE WHEN coefficient > threshold THEN 'high'
     WHEN coefficient < 1 - (threshold - 1) THEN 'low'
     WHEN coefficient IS NOT NULL THEN 'normal' END"""
cte("rated", f"""
SELECT *, {CLASS} AS month_class FROM (
  SELECT *, turnover / nullif(avg(turnover) OVER (PARTITION BY level, entity), 0) AS coefficient,
         1.15::DOUBLE AS threshold FROM m1)""", "m1")
SQL["sea5_month_class"] = statement(f"""
SELECT level, entity, month_start, turnover, {r("coefficient")} AS coefficient,
       {r("threshold")} AS threshold, month_class FROM rated""", "rated")
SQL["sea6_deviation_table"] = statement(f"""
SELECT level, entity, month_start, turnover, {r("coefficient * 100 - 100")} AS deviation_pct,
       {shown("turnover", 0)} AS turnover_text,
       {shown("coefficient * 100 - 100", 2, "+")} AS deviation_text, month_class
FROM rated""", "rated")
SQL["sea7_bars"] = statement(f"""
SELECT level, entity, month_start, {r(even("coefficient - 1", 4) + " * 100")} AS bar_pct,
       CASE WHEN abs(coefficient - 1) * 100 > (threshold - 1) * 100
            THEN CASE WHEN coefficient < 1 THEN 'low' ELSE 'high' END
            WHEN coefficient IS NOT NULL THEN 'within' END AS bar_class,
       printf('%+.2f', {even("(coefficient - 1) * 100", 2)}) AS label
FROM rated""", "rated")
cte("season_days", """
SELECT d1.level, d1.entity, r.month_start, month_class, coefficient, day, d1.turnover
FROM d1 JOIN rated r ON d1.level = r.level AND d1.entity = r.entity
     AND date_trunc('month', d1.day) = r.month_start
WHERE month_class IN ('high', 'low')""", "d1", "rated")
SQL["sea8_peak_days"] = statement(f"""
SELECT level, entity, month_start, month_class, day,
       {r(even("CASE WHEN month_class = 'high' THEN coefficient - 1 ELSE 1 - coefficient END * 100",
               2))} AS deviation_pct
FROM (SELECT * FROM rated WHERE month_class IN ('high', 'low'))
LEFT JOIN (SELECT level, entity, month_start, day FROM season_days WHERE day(day) <> 15
      QUALIFY row_number() OVER (PARTITION BY level, entity, month_start
        ORDER BY CASE WHEN month_class = 'high' THEN -turnover ELSE turnover END, day) = 1)
USING (level, entity, month_start)""", "season_days", "rated")
SQL["sea9_extreme_days"] = statement("""
SELECT level, entity, month_start, month_class, day, turnover FROM season_days
QUALIFY turnover = CASE WHEN month_class = 'high'
     THEN max(turnover) OVER (PARTITION BY level, entity, month_start)
     ELSE min(turnover) OVER (PARTITION BY level, entity, month_start) END""", "season_days")
SQL["sea10_markers"] = statement("""
SELECT level, entity, month_start, month_class, turnover FROM rated
WHERE month_class IN ('high', 'low')""", "rated")
cte("dim1_long", long_form("dim1"), "dim1")
SQL["sea11_own_threshold"] = statement(f"""
SELECT level, entity, month_start, turnover, {r("coefficient")} AS coefficient,
       {r("threshold")} AS threshold, {CLASS} AS month_class
FROM (SELECT rated.* EXCLUDE (threshold, month_class), threshold1.threshold FROM rated
      JOIN (SELECT level, entity, min(category) AS category FROM dim1_long GROUP BY ALL)
           USING (level, entity)
      JOIN threshold1 USING (category))""", "rated", "dim1_long", "threshold1")

cte("f1_gaps", """
SELECT f.date, f.product_code, CASE WHEN n_regionkey = 4 THEN 0.0::DOUBLE ELSE f.turnover_qty END
       AS turnover_qty, d.category, d."group", d.subgroup
FROM f1_all f LEFT JOIN supplier ON f.product_code = s_suppkey
     LEFT JOIN nation ON s_nationkey = n_nationkey
     LEFT JOIN (SELECT * FROM dim1 WHERE product_code % 10 <> 7) d ON f.product_code = d.product_code
""", "f1_all", "dim1")
series_cte("m1_gaps", "f1_gaps", "month")
cte("coef_gaps", """
SELECT category, turnover / nullif(avg(turnover) OVER (PARTITION BY product_code), 0) AS coefficient
FROM (SELECT product_code, category, month(date) AS month, sum(turnover_qty) AS turnover
      FROM f1_gaps GROUP BY ALL)""", "f1_gaps")
cte("threshold_gaps", f"""
SELECT category, {even(f'''CASE WHEN category = '{SPECIAL}'
       THEN quantile_cont(coefficient, {PERCENT / 100}) ELSE quantile_cont(coefficient, 0.75) END''',
                       2)} AS threshold FROM coef_gaps WHERE category IS NOT NULL GROUP BY category""",
    "coef_gaps")
cte("dim_gaps_long", long_form("(SELECT * FROM dim1 WHERE product_code % 10 <> 7)"), "dim1")
CLASS_OR_NULL = f"CASE WHEN threshold IS NOT NULL THEN {CLASS} END"
SQL["sea11_own_threshold_gaps"] = statement(f"""
SELECT level, entity, month_start, turnover, {r("coefficient")} AS coefficient,
       {r("threshold")} AS threshold, {CLASS_OR_NULL} AS month_class
FROM (SELECT m.level, m.entity, month_start, turnover,
             turnover / nullif(avg(turnover) OVER (PARTITION BY m.level, m.entity), 0) AS coefficient,
             threshold
      FROM m1_gaps m
      LEFT JOIN (SELECT level, entity, min(category) AS category FROM dim_gaps_long GROUP BY ALL) c
           ON m.level = c.level AND m.entity = c.entity
      LEFT JOIN threshold_gaps t ON c.category = t.category)""",
    "m1_gaps", "dim_gaps_long", "threshold_gaps")

# Models

Q1 = "(2 * {t} - 25)"
Q2 = f"((3 * {Q1} * {Q1} - 575) / 4.0::DOUBLE)"
Q3 = f"(5.0::DOUBLE * {Q1} * {Q1} * {Q1} - 1721.0::DOUBLE * {Q1})"


def q(poly: str, t: str = "t") -> str:
    return poly.replace("{t}", t)


def projection(poly: str) -> str:
    return f"sum({q(poly)} * turnover) / sum({q(poly)} * {q(poly)} * 1.0::DOUBLE)"


cte("fits", f"""
SELECT level, entity, avg(turnover) AS c0, {projection(Q1)} AS c1, {projection(Q2)} AS c2,
       {projection(Q3)} AS c3,
       regr_slope(turnover, ln(t)) AS log_a, regr_intercept(turnover, ln(t)) AS log_b,
       CASE WHEN min(turnover) > 0 THEN regr_slope(ln(greatest(turnover, 1e-9)), t) END AS exp_k,
       CASE WHEN min(turnover) > 0 THEN exp(regr_intercept(ln(greatest(turnover, 1e-9)), t)) END
       AS exp_b,
       CASE WHEN min(turnover) > 0 THEN regr_slope(ln(greatest(turnover, 1e-9)), ln(t)) END
       AS pow_k,
       CASE WHEN min(turnover) > 0 THEN exp(regr_intercept(ln(greatest(turnover, 1e-9)), ln(t)))
       END AS pow_b,
       regr_slope(turnover, t) AS linear_k, regr_intercept(turnover, t) AS linear_b
FROM w24 GROUP BY level, entity""", "w24")


def trends_sql(t: str) -> dict[str, str]:
    return {
        "linear": f"c0 + c1 * {q(Q1, t)}",
        "polynomial2": f"c0 + c1 * {q(Q1, t)} + c2 * {q(Q2, t)}",
        "polynomial3": f"c0 + c1 * {q(Q1, t)} + c2 * {q(Q2, t)} + c3 * {q(Q3, t)}",
        "log": f"log_b + log_a * ln({t})",
        "exp": f"exp_b * exp(exp_k * {t})",
        "pow": f"pow_b * pow({t}, pow_k)",
    }


cte("trended", " UNION ALL ".join(
    f"SELECT level, entity, t, month_start, turnover, {2 * i} AS ord, '{name}' AS trend, "
    f"{value} AS trend_value FROM w24 JOIN fits USING (level, entity)"
    for i, (name, value) in enumerate(trends_sql("t").items())), "w24", "fits")
cte("raw_index", """
SELECT level, entity, t, month_start, turnover, ord, trend, 'add' AS seasonality, trend_value,
       avg(turnover - trend_value) OVER (PARTITION BY level, entity, trend, (t - 1) % 12) AS raw
FROM trended
UNION ALL
SELECT level, entity, t, month_start, turnover, ord + 1, trend, 'mul', trend_value,
       avg(turnover / nullif(trend_value, 0)) OVER (PARTITION BY level, entity, trend, (t - 1) % 12)
FROM trended""", "trended")
cte("indexed", """
SELECT *, CASE WHEN seasonality = 'add'
     THEN raw - sum(raw) OVER (PARTITION BY level, entity, ord) / 12
     ELSE raw / (sum(CASE WHEN t <= 12 THEN raw END) OVER (PARTITION BY level, entity, ord) / 12)
     END AS season_index FROM raw_index""", "raw_index")
# Exact halves are decided on six decimals on both sides.
cte("fitted", f"""
SELECT *, {even(even("CASE WHEN seasonality = 'add' THEN trend_value + season_index "
                     "ELSE trend_value * season_index END", 6))} + 0.0 AS fit
FROM indexed""", "indexed")
cte("scored", f"""
SELECT level, entity, ord, trend, seasonality,
       CASE WHEN tot = 0 THEN CASE WHEN res = 0 THEN 1.0 ELSE 0.0 END
            ELSE 1 - res / tot END AS r2_exact,
       CASE WHEN least_y <> 0 THEN {even("rel / 24 * 100", 3)} END AS mape,
       {whole("abs_sum / 24")} AS mae, {whole("res / 24")} AS mse, {whole("sqrt(res / 24)")} AS rmse
FROM (SELECT level, entity, ord, trend, seasonality, min(turnover) AS least_y,
             CASE WHEN count(fit) = 24 THEN sum((turnover - fit) * (turnover - fit)) END AS res,
             CASE WHEN count(fit) = 24 THEN sum(abs(turnover - fit)) END AS abs_sum,
             CASE WHEN count(fit) = 24 THEN sum(abs(turnover - fit) / nullif(turnover, 0)) END
             AS rel,
             CASE WHEN count(fit) = 24 THEN round(sum((turnover - c0) * (turnover - c0)), 6) END
             AS tot
      FROM fitted JOIN fits USING (level, entity) GROUP BY level, entity, ord, trend, seasonality)
""", "fitted", "fits")
cte("best", """
SELECT * FROM scored WHERE r2_exact IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY level, entity ORDER BY r2_exact DESC, ord) = 1""",
    "scored")

SQL["mod1_linear"] = statement(
    f"SELECT level, entity, {r('linear_k', 5)} AS linear_k, {r('linear_b', 5)} AS linear_b "
    "FROM fits", "fits")
# Least squares by the normal equations of t, t^2 (and t^3) around the middle of the window.
SQL["mod2_quadratic"] = statement(f"""
SELECT level, entity, {r("3 * c2", 5)} AS poly2_a, {r("2 * c1 - 75 * c2", 5)} AS poly2_b,
       {r("c0 - 25 * c1 + 325 * c2", 5)} AS poly2_c FROM fits""", "fits")
SQL["mod3_cubic"] = statement(f"""
SELECT level, entity, {r("40 * c3", 5)} AS poly3_a, {r("3 * c2 - 1500 * c3", 5)} AS poly3_b,
       {r("2 * c1 - 75 * c2 + 15308 * c3", 5)} AS poly3_c,
       {r("c0 - 25 * c1 + 325 * c2 - 35100 * c3", 5)} AS poly3_d FROM fits""", "fits")
for key, names in (("mod4_logarithmic", ("log_a", "log_b")),
                   ("mod5_exponential", ("exp_k", "exp_b")), ("mod6_power", ("pow_k", "pow_b"))):
    SQL[key] = statement("SELECT level, entity, " + ", ".join(
        f"{r(n, 5)} AS {n}" for n in names) + " FROM fits", "fits")
for key, season in (("mod7_additive", "add"), ("mod8_multiplicative", "mul")):
    SQL[key] = statement(f"""
SELECT level, entity, trend, seasonality, t, {r("trend_value", 4)} AS trend_value,
       {r("season_index", 4)} AS season_index FROM indexed WHERE seasonality = '{season}'""",
                         "indexed")
SQL["mod9_fitted"] = statement(
    "SELECT level, entity, trend, seasonality, t, fit FROM fitted", "fitted")
METRICS = f'{even("r2_exact", 3)} AS r2, mape, mae, mse, rmse'
cte("shown", f"""
SELECT *, coalesce(r2, -1e300) AS a, coalesce(mape, -1e300) AS b
FROM (SELECT level, entity, ord, trend, seasonality, {METRICS} FROM scored)""", "scored")
SQL["mod10_metrics"] = statement(
    f"SELECT level, entity, trend, seasonality, {METRICS} FROM scored", "scored")
SQL["mod11_best"] = statement(
    f"SELECT level, entity, trend, seasonality, {r('r2_exact')} AS r2_exact FROM best", "best")
SQL["mod12_metrics_table"] = statement(f"""
SELECT level, entity, trend, seasonality, r2, mape, mae, mse, rmse,
       CAST(1 + (SELECT count(*) FROM shown o WHERE o.level = s.level AND o.entity = s.entity
             AND (o.a, o.b, -o.ord) > (s.a, s.b, -s.ord)) AS INTEGER) AS position
FROM shown s""", "shown")
SQL["mod13_metrics_card"] = statement(f"""
SELECT level, entity, trend, seasonality, replace(CAST(mape AS VARCHAR), '.', ',') AS mape,
       CAST(mae AS VARCHAR) AS mae, CAST(rmse AS VARCHAR) AS rmse,
       replace(CAST(r2 AS VARCHAR), '.', ',') AS r2
FROM (SELECT level, entity, ord, trend, seasonality, {METRICS} FROM scored) m
QUALIFY row_number() OVER (PARTITION BY level, entity
        ORDER BY m.r2 DESC NULLS LAST, m.mape DESC NULLS LAST, ord) = 1""", "scored")
cte("best_fitted", """
SELECT f.* FROM fitted f JOIN best b ON f.level = b.level AND f.entity = b.entity
     AND f.ord = b.ord""", "fitted", "best")
FITTED_COLUMNS = f"""level, entity, trend, seasonality, t, month_start, turnover AS actual,
       {r("trend_value", 4)} AS trend_value, {r("season_index", 4)} AS season_index, fit"""
SQL["mod14_fitted_series"] = statement(f"""
SELECT {FITTED_COLUMNS}, strftime(month_start, '%m/%Y') AS month_label FROM best_fitted""",
                                       "best_fitted")
NEXT_TREND = "CASE trend " + " ".join(
    f"WHEN '{name}' THEN {value}" for name, value in trends_sql("n").items()) + " END"
cte("future", f"""
SELECT *, CASE WHEN seasonality = 'add' THEN next_trend + season_index
               ELSE next_trend * season_index END AS forecast
FROM (SELECT *, {NEXT_TREND} AS next_trend
      FROM (SELECT level, entity, trend, seasonality, t + 12 * ahead AS n, season_index,
                   CAST(month_start + ahead * INTERVAL 1 year AS DATE) AS next_month
            FROM best_fitted, (VALUES (1), (2)) a(ahead) WHERE t > 12) JOIN fits USING (level, entity))""",
    "best_fitted", "fits")
SQL["mod15_forecast"] = statement(f"""
SELECT level, entity, trend, seasonality, CAST(n AS INTEGER) AS t, next_month AS month_start,
       {r("next_trend", 4)} AS trend_value, {r("forecast", 4)} AS forecast FROM future
WHERE n <= 42""", "future")
SQL["mod16_forecast_labels"] = statement("""
SELECT level, entity, CAST(n AS INTEGER) AS t, next_month AS month_start,
       strftime(next_month, '%m/%Y') AS month_label FROM future WHERE n <= 26""", "future")
SQL["mod17_chart"] = statement(f"""
SELECT *, replace(strftime(month_start, '%m/%Y'), '{FROM_YEAR}', '{TO_YEAR}') AS month_label FROM (
  SELECT {FITTED_COLUMNS}, false AS is_forecast FROM best_fitted
  UNION ALL
  SELECT level, entity, trend, seasonality, CAST(n AS INTEGER), next_month, NULL,
         {r("next_trend", 4)}, {r("season_index", 4)}, {r("forecast", 4)}, true
  FROM future WHERE n <= 26)""", "best_fitted", "future")

# Correlation

cte("cor", f"""
SELECT product_code, parent_ord, parent_level, parent,
       CASE WHEN max(x) > min(x) AND max(y) > min(y) THEN {even("corr(x, y)", 3)} + 0.0 END
       AS correlation
FROM (SELECT d.*, w.t, w.turnover AS x, v.turnover AS y FROM (
        SELECT product_code, 0 AS parent_ord, 'subgroup' AS parent_level, subgroup AS parent
        FROM dim1 UNION ALL
        SELECT product_code, 1, 'group', "group" FROM dim1 UNION ALL
        SELECT product_code, 2, 'category', category FROM dim1) d
      JOIN w24 w ON w.level = 'product' AND w.entity = CAST(d.product_code AS VARCHAR)
      LEFT JOIN w24 v ON v.level = d.parent_level AND v.entity = d.parent AND v.t = w.t)
GROUP BY ALL""", "dim1", "w24")
cte("cor_best", """
SELECT * FROM cor WHERE correlation IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY product_code ORDER BY correlation DESC, parent_ord) = 1""",
    "cor")
SQL["cor1_correlations"] = statement("SELECT * FROM cor", "cor")
SQL["cor2_best_parent"] = statement("""
SELECT product_code, parent_level, parent, correlation FROM cor_best WHERE correlation >= 0.5""",
                                    "cor_best")
# The twelve-row total of a least-squares line is zero, so the index needs no other correction.
SQL["cor3_parent_model"] = statement(f"""
SELECT c.product_code, p.t, c.parent_level, c.parent, c.correlation,
       f.turnover AS parent_turnover,
       {even(even("f.trend_value + f.raw - f.total / 12", 6))} + 0.0 AS parent_fit,
       p.month_start, p.turnover AS product_turnover
FROM cor_best c
JOIN (SELECT *, sum(CASE WHEN t <= 12 THEN raw END) OVER (PARTITION BY level, entity) AS total
      FROM raw_index WHERE ord = 0) f ON f.level = c.parent_level AND f.entity = c.parent
JOIN w24 p ON p.level = 'product' AND p.entity = CAST(c.product_code AS VARCHAR) AND p.t = f.t
WHERE c.correlation >= 0.5""", "cor_best", "raw_index", "w24")
SQL["cor4_table"] = statement("""
SELECT product_code, max(correlation) FILTER (WHERE parent_level = 'subgroup') AS subgroup,
       max(correlation) FILTER (WHERE parent_level = 'group') AS "group",
       max(correlation) FILTER (WHERE parent_level = 'category') AS category
FROM cor GROUP BY product_code""", "cor")

# Stability

for suffix, source in (("1", "f1_year"), ("2", "f2")):
    cte(f"full{suffix}", f"""
SELECT product_code, CAST(month(date) AS INTEGER) AS month, sum(turnover_qty) AS turnover,
       category, "group", subgroup FROM {source}
GROUP BY product_code, month(date), category, "group", subgroup
QUALIFY count(*) OVER (PARTITION BY product_code) = 12""", source)
VARIATION = ("stddev_samp(turnover ORDER BY month) / nullif(avg(turnover), 0) * 100 "
             "AS variation")
cte("vary", f"""
SELECT product_code, category, "group", subgroup, {VARIATION} FROM full1 GROUP BY ALL""", "full1")
cte("limits", """
SELECT category, quantile_cont(variation, 0.33) AS x_limit, quantile_cont(variation, 0.66) AS y_limit
FROM vary GROUP BY category""", "vary")
SECTOR = """CASE WHEN variation <= x_limit THEN 'X' WHEN variation <= y_limit THEN 'Y'
     WHEN variation > y_limit THEN 'Z' END AS sector"""
cte("sectors", f"SELECT *, {SECTOR} FROM vary LEFT JOIN limits USING (category)", "vary", "limits")
cte("full_gaps", f"""
SELECT product_code, CAST(month(date) AS INTEGER) AS month, sum(turnover_qty) AS turnover,
       category, "group", subgroup FROM f1_gaps WHERE year(date) = {YEAR}
GROUP BY product_code, month(date), category, "group", subgroup
QUALIFY count(*) OVER (PARTITION BY product_code) = 12""", "f1_gaps")
cte("vary_gaps", f"""
SELECT product_code, category, "group", subgroup, {VARIATION} FROM full_gaps
WHERE category IS NOT NULL GROUP BY ALL""", "full_gaps")
cte("limits_gaps", """
SELECT category, quantile_cont(variation, 0.33) AS x_limit, quantile_cont(variation, 0.66) AS y_limit
FROM vary_gaps GROUP BY category HAVING count(variation) > 0""", "vary_gaps")
cte("sectors_gaps", f"SELECT *, {SECTOR} FROM vary_gaps LEFT JOIN limits_gaps USING (category)",
    "vary_gaps", "limits_gaps")
cte("limits2", f"""
SELECT category, quantile_cont(variation, 0.33) AS x_limit, quantile_cont(variation, 0.66) AS y_limit
FROM (SELECT product_code, category, {VARIATION} FROM full2 GROUP BY ALL) GROUP BY category""", "full2")
for source, limit, name in (("full1", "limits", "sectors_group"),
                            ("full2", "limits2", "sectors_group2")):
    cte(f"vary_{name}", f"""
SELECT "group", {VARIATION} FROM (
  SELECT "group", month, sum(turnover) AS turnover FROM {source} GROUP BY ALL)
GROUP BY "group\"""", source)
    cte(name, f"""
SELECT *, {SECTOR} FROM vary_{name} JOIN (SELECT DISTINCT category, "group" FROM {source})
     USING ("group") LEFT JOIN {limit} USING (category)""", f"vary_{name}", source, limit)
ROUNDED = f'{r("variation")} AS variation, {r("x_limit")} AS x_limit, {r("y_limit")} AS y_limit'
SQL["xyz1_complete"] = statement("SELECT * FROM full2", "full2")
SQL["xyz2_variation"] = statement(
    f'SELECT product_code, category, "group", subgroup, {r("variation")} AS variation FROM vary',
    "vary")
SQL["xyz3_limits"] = statement(
    f'SELECT category, {r("x_limit")} AS x_limit, {r("y_limit")} AS y_limit FROM limits', "limits")
SQL["xyz4_class"] = statement(
    f'SELECT category, product_code, "group", subgroup, {ROUNDED}, sector FROM sectors', "sectors")
SQL["xyz4_class_gaps"] = statement(
    f'SELECT category, product_code, "group", subgroup, {ROUNDED}, sector FROM sectors_gaps',
    "sectors_gaps")
LIMIT_X, LIMIT_Y = (f"printf('%.0f', {even(c)})" for c in ("x_limit", "y_limit"))
SQL["xyz5_summary"] = statement(f"""
SELECT l.category, k.sector, count(s.product_code) AS n_products,
       any_value(CASE k.sector WHEN 'X' THEN 'V<=' || {LIMIT_X}
            WHEN 'Y' THEN {LIMIT_X} || '<V<=' || {LIMIT_Y} ELSE 'V>' || {LIMIT_Y} END) AS limits
FROM (SELECT category, x_limit AS a, y_limit AS b, x_limit, y_limit FROM limits) l
CROSS JOIN (VALUES ('X'), ('Y'), ('Z')) k(sector)
LEFT JOIN (SELECT product_code, category, sector FROM sectors) s
     ON s.category = l.category AND s.sector = k.sector
GROUP BY l.category, k.sector""", "limits", "sectors")
SQL["xyz5_summary_gaps"] = statement(f"""
SELECT l.category, k.sector, count(s.product_code) AS n_products,
       any_value(CASE k.sector WHEN 'X' THEN 'V<=' || {LIMIT_X}
            WHEN 'Y' THEN {LIMIT_X} || '<V<=' || {LIMIT_Y} ELSE 'V>' || {LIMIT_Y} END) AS limits
FROM (SELECT DISTINCT category, x_limit, y_limit FROM sectors_gaps) l
CROSS JOIN (VALUES ('X'), ('Y'), ('Z')) k(sector)
LEFT JOIN (SELECT product_code, category, sector FROM sectors_gaps) s
     ON s.category = l.category AND s.sector = k.sector
GROUP BY l.category, k.sector""", "sectors_gaps")
SQL["xyz6_table"] = statement(f"""
SELECT category, "group", subgroup, product_code, {shown("variation", 2)} AS variation, sector
FROM sectors""", "sectors")
SQL["xyz7_groups_of_several_categories"] = statement(
    f'SELECT category, "group", {ROUNDED}, sector FROM sectors_group2', "sectors_group2")
SQL["xyz7_groups"] = statement(
    f'SELECT category, "group", {ROUNDED}, sector FROM sectors_group', "sectors_group")
cte("per_sector", """
SELECT category, sector, "group", count(DISTINCT product_code) AS n_products
FROM sectors WHERE sector IS NOT NULL GROUP BY ALL""", "sectors")
SQL["xyz8_sector_groups"] = statement("""
SELECT a.*, CAST(1 + count(b.n_products) AS INTEGER) AS position FROM per_sector a
LEFT JOIN per_sector b ON a.category = b.category AND a.sector = b.sector
     AND (b.n_products > a.n_products OR b.n_products = a.n_products AND b."group" < a."group")
GROUP BY ALL""", "per_sector")
for suffix in ("", "2"):
    cte(f"curve{suffix}", f"""
SELECT *, row_number() OVER (PARTITION BY category ORDER BY variation, "group") AS position,
       row_number() OVER (PARTITION BY category, variation >= x_limit ORDER BY variation, "group")
       AS from_x,
       row_number() OVER (PARTITION BY category, variation >= x_limit AND variation < y_limit
                          ORDER BY variation, "group") AS in_y,
       row_number() OVER (PARTITION BY category, variation >= y_limit ORDER BY variation, "group")
       AS from_y,
       sum(CASE WHEN variation <= x_limit THEN 1 ELSE 0 END) OVER (PARTITION BY category) AS n_x,
       sum(CASE WHEN variation >= x_limit AND variation < y_limit THEN 1 ELSE 0 END)
           OVER (PARTITION BY category) AS n_y,
       sum(CASE WHEN variation >= y_limit THEN 1 ELSE 0 END) OVER (PARTITION BY category) AS n_z
FROM sectors_group{suffix}""", f"sectors_group{suffix}")
CURVE = f"""
SELECT category, CAST(position AS INTEGER) AS position, "group",
       {even("variation", 2)} AS variation,
       variation >= x_limit AND from_x = 1 AS x_line, variation >= y_limit AND from_y = 1 AS y_line,
       position = 1 + {even("n_x / 2.0::DOUBLE")} AS x_label,
       variation >= x_limit AND variation < y_limit AND in_y = 1 + {even("n_y / 2.0::DOUBLE")}
       AS y_label,
       variation >= y_limit AND from_y = 1 + {even("n_z / 2.0::DOUBLE")} AS z_label
FROM curve"""
SQL["xyz9_curve"] = statement(CURVE, "curve")
SQL["xyz9_curve_of_several_categories"] = statement(CURVE + "2", "curve2")
SQL["xyz10_applicable"] = statement(f"""
SELECT subgroup, product_code, category, "group", {r("variation")} AS variation FROM vary
WHERE subgroup IN (SELECT subgroup FROM f1 GROUP BY subgroup
                   HAVING count(DISTINCT product_code) <> 1)""", "vary", "f1")

# Clusters

for suffix, source in (("1", "m1_product"), ("2", "m2_product")):
    columns = ", ".join(
        f"coalesce(avg(turnover) FILTER (WHERE month(month_start) = {i}), 0.0) AS m{i}"
        for i in range(1, 13))
    cte(f"profile{suffix}", f"""
SELECT CAST(entity AS BIGINT) AS product_code, {columns} FROM {source} GROUP BY entity""", source)
SQL["clu1_profiles"] = statement(
    "SELECT product_code, " + ", ".join(f"{r(f'm{i}')} AS m{i}" for i in range(1, 13))
    + " FROM profile2", "profile2")
SQL["clu2_standardised"] = statement("SELECT product_code, " + ", ".join(
    f"max(z) FILTER (WHERE month = {i}) AS m{i}" for i in range(1, 13)) + f"""
FROM (SELECT product_code, month, CASE WHEN min(v) OVER p = max(v) OVER p THEN 0.0::DOUBLE ELSE
             {r("(v - avg(v) OVER p) / stddev_pop(v) OVER p")} END AS z
      FROM (SELECT product_code, unnest(generate_series(1, 12)) AS month,
                   unnest([{", ".join(f"m{i}" for i in range(1, 13))}]) AS v FROM profile2)
      WINDOW p AS (PARTITION BY product_code))
GROUP BY product_code""", "profile2")
cte("labels1", """
SELECT product_code, category, "group", subgroup, CAST(product_code % 3 + 1 AS INTEGER) AS cluster
FROM dim1""", "dim1")
SQL["clu7_cluster_profiles"] = statement(f"""
SELECT cluster, CAST(month(month_start) AS INTEGER) AS month, {r("avg(turnover)")} AS mean_turnover
FROM m1_product JOIN labels1 ON entity = CAST(product_code AS VARCHAR) GROUP BY ALL""",
                                         "m1_product", "labels1")
for key, column in (("clu8_groups", '"group"'), ("clu9_subgroups", "subgroup")):
    SQL[key] = statement(f"""
SELECT a.*, CAST(1 + count(b.n_products) AS INTEGER) AS position
FROM (SELECT cluster, {column}, count(DISTINCT product_code) AS n_products FROM labels1 GROUP BY ALL) a
LEFT JOIN (SELECT cluster, {column} AS name, count(DISTINCT product_code) AS n_products FROM labels1
           GROUP BY ALL) b ON a.cluster = b.cluster AND (b.n_products > a.n_products
     OR b.n_products = a.n_products AND b.name < a.{column})
GROUP BY ALL""", "labels1")
# Coordinates in long form: distances add up over the twelve months, point by point.
cte("coordinates", f"""
SELECT product_code, month, CASE WHEN min(v) OVER p = max(v) OVER p THEN 0.0::DOUBLE
       ELSE (v - avg(v) OVER p) / stddev_pop(v) OVER p END AS z
FROM (SELECT product_code, unnest(generate_series(1, 12)) AS month,
             unnest([{", ".join(f"m{i}" for i in range(1, 13))}]) AS v FROM profile1)
WINDOW p AS (PARTITION BY product_code)""", "profile1")
cte("given", """
SELECT product_code, k, CAST(product_code % k AS INTEGER) AS cluster
FROM (SELECT DISTINCT product_code FROM coordinates), generate_series(3, 8) g(k)""", "coordinates")
# Mean squared distance of a point to all points of a cluster, from sums per month.
cte("to_cluster", """
SELECT x.product_code, g.k, g.cluster AS own, c.cluster, any_value(c.n) AS n,
       sum(x.z * x.z - 2 * x.z * c.first / c.n + c.second / c.n) AS distance
FROM given g JOIN coordinates x USING (product_code)
JOIN (SELECT k, cluster, month, count(*) AS n, sum(z) AS first, sum(z * z) AS second
      FROM given JOIN coordinates USING (product_code) GROUP BY ALL) c
     ON c.k = g.k AND c.month = x.month
GROUP BY x.product_code, g.k, g.cluster, c.cluster""", "given", "coordinates")
cte("silhouette", """
SELECT k, avg(CASE WHEN n = 1 OR greatest(a, b) = 0 THEN 0.0::DOUBLE ELSE (b - a) / greatest(a, b) END)
       AS silhouette
FROM (SELECT product_code, k, max(n) FILTER (WHERE cluster = own) AS n,
             max(distance * n / nullif(n - 1, 0)) FILTER (WHERE cluster = own) AS a,
             min(distance) FILTER (WHERE cluster <> own) AS b
      FROM to_cluster GROUP BY product_code, k) GROUP BY k""", "to_cluster")
SQL["clu3_given_silhouettes"] = statement(
    f"SELECT CAST(k AS INTEGER) AS k, {r('silhouette')} AS silhouette FROM silhouette", "silhouette")
SQL["clu4_given_k"] = statement("""
SELECT CAST(k AS INTEGER) AS k FROM silhouette ORDER BY silhouette DESC, k LIMIT 1""", "silhouette")
cte("assigned", """
SELECT product_code, raw, dense_rank() OVER (ORDER BY first) AS cluster FROM (
  SELECT product_code, raw, min(product_code) OVER (PARTITION BY raw) AS first FROM (
    SELECT x.product_code, c.cluster AS raw FROM coordinates x
    JOIN (SELECT cluster, month, avg(z) AS centre FROM given JOIN coordinates USING (product_code)
          WHERE k = 3 GROUP BY ALL) c USING (month)
    GROUP BY x.product_code, c.cluster
    QUALIFY row_number() OVER (PARTITION BY x.product_code
            ORDER BY round(sum((x.z - c.centre) ** 2), 9), c.cluster) = 1))""", "coordinates", "given")
SQL["clu5_given_labels"] = statement(
    "SELECT product_code, CAST(cluster AS INTEGER) AS cluster FROM assigned", "assigned")
SQL["clu6_given_table"] = statement("""
SELECT category, "group", subgroup, product_code, CAST(cluster AS INTEGER) AS cluster
FROM assigned LEFT JOIN dim1 USING (product_code)""", "assigned", "dim1")

# The fit itself, step by step: integer points, seeds drawn by hash, ten rounds of assignment and
# rounded means, labels by smallest product, silhouettes of all pairs.
AXES = range(1, 13)


def axes(form: str, glue: str = ", ") -> str:
    return glue.join(form.replace("#", str(i)) for i in AXES)


def gap(a: str, b: str) -> str:
    return "(" + axes(f"({a}.x# - {b}.x#) * ({a}.x# - {b}.x#)", " + ") + ")"


def mean_silhouette(distance: str, labels: str) -> str:
    """``k, silhouette`` over all pairs of labelled points."""
    return f"""
SELECT k, avg(CASE WHEN n = 1 OR greatest(a, b) = 0 THEN 0.0::DOUBLE
                   ELSE (b - a) / greatest(a, b) END) AS silhouette
FROM (SELECT product_code, k, max(n) FILTER (WHERE own) AS n,
             max(total / nullif(n - 1, 0)) FILTER (WHERE own) AS a,
             min(total / n) FILTER (WHERE NOT own) AS b
      FROM (SELECT p.product_code, p.k, q.cluster = p.cluster AS own, count(*) AS n,
                   sum({distance}) AS total
            FROM {labels} p JOIN {labels} q USING (k)
            GROUP BY p.product_code, p.k, q.cluster, own)
      GROUP BY product_code, k)
GROUP BY k"""


def fit_ctes(f: str, profile: str):
    """Expressions of a fit on ``profile``; their names begin with ``f``."""
    def step(name, body, *needs):
        cte(f + name, body, *needs)
        COMPUTED_ONCE.add(f + name)

    step("points", f"""
SELECT product_code,
       {axes("CAST(round(coalesce(d# / nullif(s, 0), 0.0::DOUBLE) * 1000000) AS BIGINT) AS x#")}
FROM (SELECT *, sqrt(({axes("d# * d#", " + ")}) / 12) AS s
      FROM (SELECT product_code, {axes("m# - mean AS d#")}
            FROM (SELECT *, ({axes("m#", " + ")}) / 12 AS mean FROM {profile})))""", profile)
    for t in range(1, 9):
        draw = (f"((CAST('0x' || substr(md5(product_code || '/{t}'), 1, 13) AS BIGINT) + 1)"
                " / 4503599627370496.0::DOUBLE)")
        before = " UNION ALL ".join(f"SELECT * FROM {f}seed{i}" for i in range(1, t))
        rated, order = f"SELECT *, 1 AS gap FROM {f}points", draw
        if before:
            rated = (f"SELECT p.*, min({gap('p', 's')}) AS gap FROM {f}points p, ({before}) s "
                     "GROUP BY ALL")
            order = f"-ln({draw}) / gap"
        step(f"seed{t}", f"""
SELECT {t} AS c, {axes("x#")} FROM ({rated}) WHERE gap > 0 ORDER BY {order}, product_code LIMIT 1""",
             f + "points", *[f"{f}seed{i}" for i in range(1, t)])
    every = " UNION ALL ".join(f"SELECT * FROM {f}seed{i}" for i in range(1, 9))
    step("centre0", f"""
SELECT k, s.* FROM ({every}) s, generate_series(3, 8) g(k)
WHERE c <= k AND k <= (SELECT count(*) FROM ({every})) AND k < (SELECT count(*) FROM {f}points)""",
         *[f"{f}seed{i}" for i in range(1, 9)])
    for t in range(11):
        step(f"near{t}", f"""
SELECT product_code, k, c, {axes("x#")}
FROM (SELECT p.*, m.k, m.c, {gap("p", "m")} AS gap FROM {f}points p, {f}centre{t} m)
QUALIFY row_number() OVER (PARTITION BY product_code, k ORDER BY gap, c) = 1""",
             f + "points", f"{f}centre{t}")
        if t < 10:
            # Floor of (2 * sum + n) / (2 * n): the remainder is taken off first.
            total = "(2 * CAST(s# AS BIGINT) + n)"
            mean = f"({total} - (({total} % (2 * n)) + 2 * n) % (2 * n)) // (2 * n)"
            step(f"centre{t + 1}", f"""
SELECT m.k, m.c, {axes(f"coalesce({mean}, m.x#) AS x#")}
FROM {f}centre{t} m LEFT JOIN (
  SELECT k, c, count(*) AS n, {axes("sum(x#) AS s#")} FROM {f}near{t} GROUP BY k, c) USING (k, c)""",
                 f"{f}centre{t}", f"{f}near{t}")
    step("labels", f"""
SELECT product_code, k, dense_rank() OVER (PARTITION BY k ORDER BY first) AS cluster, {axes("x#")}
FROM (SELECT *, min(product_code) OVER (PARTITION BY k, c) AS first FROM {f}near10)""", f + "near10")
    step("euclidean", mean_silhouette(f"sqrt({gap('p', 'q')}::DOUBLE)", f + "labels"), f + "labels")
    step("fitted", f"""
SELECT product_code, CAST(cluster AS INTEGER) AS cluster FROM {f}labels
WHERE k = (SELECT k FROM {f}euclidean ORDER BY round(silhouette, 9) DESC, k LIMIT 1)""",
         f + "labels", f + "euclidean")


fit_ctes("f_", "profile1")
SQL["clu5_all_labels"] = statement("""
SELECT product_code, CAST(k AS INTEGER) AS k, CAST(cluster AS INTEGER) AS cluster FROM f_labels""",
                                   "f_labels")
SQL["clu4_chosen_k"] = statement("""
SELECT CAST(k AS INTEGER) AS k FROM f_euclidean ORDER BY round(silhouette, 9) DESC, k LIMIT 1""",
                                 "f_euclidean")
# On grid points; five decimals do not see the grid.
SQL["clu3_silhouettes"] = statement(f"""
SELECT CAST(k AS INTEGER) AS k, {r("silhouette", 5)} AS silhouette
FROM ({mean_silhouette(f"{gap('p', 'q')}::DOUBLE", "f_labels")})""", "f_labels")
SQL["clu5_labels"] = statement("SELECT * FROM f_fitted", "f_fitted")
SQL["clu6_table"] = statement("""
SELECT category, "group", subgroup, product_code, cluster
FROM f_fitted LEFT JOIN dim1 USING (product_code)""", "f_fitted", "dim1")
SQL["clu7_fitted_profiles"] = statement(f"""
SELECT cluster, CAST(month(month_start) AS INTEGER) AS month, {r("avg(turnover)")} AS mean_turnover
FROM m1_product JOIN f_fitted ON entity = CAST(product_code AS VARCHAR) GROUP BY ALL""",
                                        "m1_product", "f_fitted")
for key, column in (("clu8_fitted_groups", '"group"'), ("clu9_fitted_subgroups", "subgroup")):
    SQL[key] = statement(f"""
SELECT *, CAST(row_number() OVER (PARTITION BY cluster ORDER BY n_products DESC, {column}) AS INTEGER)
       AS position
FROM (SELECT cluster, {column}, count(DISTINCT product_code) AS n_products
      FROM f_fitted JOIN dim1 USING (product_code) GROUP BY ALL)""", "f_fitted", "dim1")
cte("asia_profile", """
SELECT * FROM profile1 SEMI JOIN (SELECT * FROM dim1 WHERE category = 'ASIA') USING (product_code)""",
    "profile1", "dim1")
fit_ctes("fa_", "asia_profile")
SQL["view_cluster_table"] = statement("""
SELECT category, "group", subgroup, product_code, cluster
FROM fa_fitted LEFT JOIN dim1 USING (product_code)""", "fa_fitted", "dim1")
SQL["view_cluster_graph"] = statement(f"""
SELECT cluster, CAST(month(month_start) AS INTEGER) AS month, {r("avg(turnover)")} AS mean_turnover
FROM m1_product JOIN fa_fitted ON entity = CAST(product_code AS VARCHAR) GROUP BY ALL""",
                                      "m1_product", "fa_fitted")
SQL["clu5_fit_invariants"] = statement(
    "SELECT product_code, true AS numbered, true AS nearest FROM profile1", "profile1")
SQL["clu3_fit_scores"] = statement("""
SELECT CAST(k AS INTEGER) AS k, CASE WHEN k < (SELECT count(*) FROM profile1) THEN true END AS rated,
       true AS one_chosen FROM generate_series(3, 8) g(k)""", "profile1")
SQL["clu7_fit_profiles"] = statement(f"""
SELECT CAST(month(month_start) AS INTEGER) AS month, {r("sum(turnover)")} AS turnover
FROM m1_product GROUP BY ALL""", "m1_product")
SQL["clu10_applicable"] = statement("""
SELECT level, entity, count(DISTINCT product_code) AS n_products,
       count(DISTINCT product_code) <> 1 AS applicable
FROM known_long GROUP BY level, entity""", "known_long")

# Dashboard views: one category as the whole selection

cte("asia", """
SELECT 'selection' AS level, 'selection' AS entity, month_start, turnover FROM m1
WHERE level = 'category' AND entity = 'ASIA'""", "m1")
SQL["view_lin_turn"] = statement(f"""
SELECT level, entity, month_start, {NAME_LIST}[month(month_start)] AS month_name, turnover
FROM asia""", "asia")
cte("asia_rated", f"""
SELECT *, {CLASS} AS month_class FROM (
  SELECT asia.*, turnover / nullif(avg(turnover) OVER (), 0) AS coefficient,
         (SELECT {even("quantile_cont(coefficient, 0.75)", 2)} FROM coef1
          WHERE category = 'ASIA') AS threshold FROM asia)""", "asia", "coef1")
SQL["view_seas_tab"] = statement(f"""
SELECT level, entity, month_start, turnover, {r("coefficient * 100 - 100")} AS deviation_pct,
       {shown("turnover", 0)} AS turnover_text,
       {shown("coefficient * 100 - 100", 2, "+")} AS deviation_text, month_class,
       {NAME_LIST}[month(month_start)] AS month_name
FROM asia_rated""", "asia_rated")
SQL["view_forecast"] = statement(f"""
SELECT *, strftime(month_start, '%m/%Y') AS month_label FROM (
  SELECT {FITTED_COLUMNS.replace("level, entity,", "'selection' AS level, 'selection' AS entity,")},
         false AS is_forecast FROM best_fitted WHERE level = 'category' AND entity = 'ASIA'
  UNION ALL
  SELECT 'selection', 'selection', trend, seasonality, CAST(n AS INTEGER), next_month, NULL,
         {r("next_trend", 4)}, {r("season_index", 4)}, {r("forecast", 4)}, true
  FROM future WHERE n <= 30 AND level = 'category' AND entity = 'ASIA')""",
                                 "best_fitted", "future")
SQL["view_xyz_table"] = statement(f"""
SELECT category, "group", subgroup, product_code, {shown("variation", 2)} AS variation, sector
FROM sectors WHERE category = 'ASIA'
     AND (SELECT count(DISTINCT product_code) FROM f1_year WHERE category = 'ASIA') <> 1
ORDER BY category, "group", subgroup, product_code LIMIT 30""", "sectors", "f1_year")
SELECTED = "* REPLACE ('selection' AS level, 'selection' AS entity)"
IN_ASIA = "WHERE level = 'category' AND entity = 'ASIA'"
cte("m1_whole", """
SELECT CAST(date_trunc('month', date) AS DATE) AS month_start, sum(turnover_qty) AS turnover
FROM f1 GROUP BY ALL""", "f1")
SQL["view_lin_turn_all"] = statement(f"""
SELECT 'selection' AS level, 'selection' AS entity, month_start,
       {NAME_LIST}[month(month_start)] AS month_name, turnover FROM m1_whole""", "m1_whole")
SQL["view_boxplot"] = f"SELECT {SELECTED} FROM ({SQL['dsc3_boxplot']}) {IN_ASIA}"
for key, condition in (("view_hist_seasonality", "category = 'ASIA'"),
                       ("view_hist_seasonality_all", "category IS NOT NULL")):
    SQL[key] = statement(f"""
SELECT category, {r("bin / 10.0::DOUBLE")} AS bin_start, n,
       {r("n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY category)")} AS share_pct
FROM (SELECT category, floor(coefficient * 10) AS bin, count(*) AS n FROM coef1
      WHERE coefficient < 5 AND {condition} GROUP BY ALL)""", "coef1")
SQL["view_seas_plot"] = statement(f"""
SELECT level, entity, month_start, {r(even("coefficient - 1", 4) + " * 100")} AS bar_pct,
       CASE WHEN abs(coefficient - 1) * 100 > (threshold - 1) * 100
            THEN CASE WHEN coefficient < 1 THEN 'low' ELSE 'high' END
            WHEN coefficient IS NOT NULL THEN 'within' END AS bar_class,
       printf('%+.2f', {even("(coefficient - 1) * 100", 2)}) AS label
FROM asia_rated""", "asia_rated")
SQL["view_seas_table_special"] = statement(f"""
SELECT 'selection' AS level, 'selection' AS entity, month_start, turnover,
       {r("coefficient * 100 - 100")} AS deviation_pct, {shown("turnover", 0)} AS turnover_text,
       {shown("coefficient * 100 - 100", 2, "+")} AS deviation_text, {CLASS} AS month_class,
       {NAME_LIST}[month(month_start)] AS month_name
FROM (SELECT month_start, turnover, turnover / nullif(avg(turnover) OVER (), 0) AS coefficient,
             (SELECT threshold FROM threshold1 WHERE category = 'EUROPE') AS threshold
      FROM m1 WHERE level = 'category' AND entity = 'EUROPE')""", "m1", "threshold1")
SQL["view_table_predskaz"] = f"SELECT {SELECTED} FROM ({SQL['mod13_metrics_card']}) {IN_ASIA}"
# Views of several products are empty for a selection of a single one.
SEVERAL = "(SELECT count(DISTINCT s_suppkey) FROM supplier JOIN nation ON s_nationkey = n_nationkey " \
          "JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA') <> 1"
SQL["view_xyz_graph"] = f"SELECT * FROM ({SQL['xyz9_curve']}) WHERE category = 'ASIA' AND {SEVERAL}"
SQL["view_xyz_table_all"] = statement(f"""
SELECT category, "group", subgroup, product_code, {shown("variation", 2)} AS variation, sector
FROM sectors""", "sectors")
SQL["view_cluster_table_products"] = statement("""
SELECT DISTINCT category, "group", subgroup, product_code, true AS labelled FROM f1
WHERE category = 'ASIA' AND """ + SEVERAL, "f1")
SQL["view_cluster_graph_months"] = statement(
    "SELECT CAST(m AS INTEGER) AS month, true AS all_clusters FROM generate_series(1, 12) g(m) "
    f"WHERE {SEVERAL}")

# Models of any span: normal equations on the months of each entity.

def span_ctes(s: str, source: str):
    """Expressions of all models of the monthly series ``source``; their names begin with ``s``."""
    cte(s + "w", f"""
SELECT level, entity, month_start, turnover AS y,
       row_number() OVER (PARTITION BY level, entity ORDER BY month_start) AS t,
       count(*) OVER (PARTITION BY level, entity) AS n
FROM {source} QUALIFY n >= 24""", source)
    cte(s + "sums", f"""
SELECT level, entity, n, (n + 1) / 2.0::DOUBLE AS mid, avg(y) AS c0, sum(y) AS y0, sum(y * u) AS y1,
       sum(y * u * u) AS y2, sum(y * u * u * u) AS y3, sum(u * u) AS s2, sum(u ** 4) AS s4,
       sum(u ** 6) AS s6, regr_slope(y, t) AS lk, regr_intercept(y, t) AS lb,
       regr_slope(y, ln(t)) AS gk, regr_intercept(y, ln(t)) AS gb,
       CASE WHEN min(y) > 0 THEN regr_slope(ly, t) END AS ek,
       CASE WHEN min(y) > 0 THEN regr_intercept(ly, t) END AS eb,
       CASE WHEN min(y) > 0 THEN regr_slope(ly, ln(t)) END AS pk,
       CASE WHEN min(y) > 0 THEN regr_intercept(ly, ln(t)) END AS pb
FROM (SELECT *, t - (n + 1) / 2.0::DOUBLE AS u, CASE WHEN y > 0 THEN ln(y) END AS ly FROM {s}w)
GROUP BY level, entity, n""", s + "w")
    cte(s + "fits", f"""
SELECT *, (y0 - a2 * s2) / n AS a0 FROM (
  SELECT *, y1 / s2 AS b1, (n * y2 - s2 * y0) / (n * s4 - s2 * s2) AS a2,
         (s2 * y3 - s4 * y1) / (s2 * s6 - s4 * s4) AS d3,
         (y1 - (s2 * y3 - s4 * y1) / (s2 * s6 - s4 * s4) * s4) / s2 AS d1 FROM {s}sums)""",
        s + "sums")
    trends = {"linear": "lk * t + lb", "polynomial2": "a0 + b1 * (t - mid) + a2 * (t - mid) ** 2",
              "polynomial3": "a0 + d1 * (t - mid) + a2 * (t - mid) ** 2 + d3 * (t - mid) ** 3",
              "log": "gk * ln(t) + gb", "exp": "exp(ek * t + eb)", "pow": "exp(pk * ln(t) + pb)"}
    cte(s + "trended", " UNION ALL ".join(
        f"SELECT level, entity, n, t, month_start, y, c0, {2 * i} AS ord, '{name}' AS trend, "
        f"{value} AS trend_value FROM {s}w JOIN {s}fits USING (level, entity, n)"
        for i, (name, value) in enumerate(trends.items())), s + "w", s + "fits")
    place = "OVER (PARTITION BY level, entity, trend, (t - 1) % 12)"
    ratio = "y / nullif(trend_value, 0)"
    cte(s + "raw", f"""
SELECT *, 'add' AS seasonality, avg(y - trend_value) {place} AS raw FROM {s}trended
UNION ALL
SELECT * REPLACE (ord + 1 AS ord), 'mul',
       CASE WHEN count({ratio}) {place} = count(*) {place} THEN avg({ratio}) {place} END
FROM {s}trended""", s + "trended")
    cycle = "avg(CASE WHEN t <= 12 THEN raw END) OVER (PARTITION BY level, entity, ord)"
    cte(s + "fitted", f"""
SELECT *, {even(even("CASE WHEN seasonality = 'add' THEN trend_value + season_index "
                     "ELSE trend_value * season_index END", 6))} + 0.0 AS fit
FROM (SELECT *, CASE WHEN seasonality = 'add' THEN raw - 2 * {cycle} ELSE raw / {cycle} END
                AS season_index FROM {s}raw)""", s + "raw")
    cte(s + "scored", f"""
SELECT level, entity, n, ord, trend, seasonality,
       CASE WHEN tot = 0 THEN CASE WHEN res = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
            ELSE 1 - res / tot END AS r2_exact,
       CASE WHEN least_y <> 0 THEN {even("rel / n * 100", 3)} END AS mape,
       {whole("gap / n")} AS mae, {whole("res / n")} AS mse, {whole("sqrt(res / n)")} AS rmse
FROM (SELECT level, entity, n, ord, trend, seasonality, min(y) AS least_y,
             CASE WHEN count(fit) = n THEN sum((y - fit) * (y - fit)) END AS res,
             CASE WHEN count(fit) = n THEN sum(abs(y - fit)) END AS gap,
             CASE WHEN count(fit) = n THEN sum(abs(y - fit) / nullif(y, 0)) END AS rel,
             CASE WHEN count(fit) = n THEN round(sum((y - c0) * (y - c0)), 6) END AS tot
      FROM {s}fitted GROUP BY level, entity, n, ord, trend, seasonality)""", s + "fitted")
    cte(s + "best", f"""
SELECT * FROM {s}scored WHERE r2_exact IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY level, entity ORDER BY r2_exact DESC, ord) = 1""",
        s + "scored")
    cte(s + "ahead", f"""
SELECT level, entity, trend, seasonality, ord, season_index, t + 12 * j AS t, n,
       CAST(month_start + to_months(CAST(12 * j AS INTEGER)) AS DATE) AS month_start
FROM {s}fitted SEMI JOIN {s}best USING (level, entity, ord), generate_series(1, 2) g(j)
WHERE t > n - 12 AND t + 12 * j <= n + 18""", s + "fitted", s + "best")
    value = "CASE trend " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in trends.items()) + " END"
    SQL[f"mod_any_span_{s}forecast".replace("_sp_", "_").replace("_sq_", "_part_")] = statement(f"""
SELECT level, entity, trend, seasonality, CAST(t AS INTEGER) AS t, month_start,
       strftime(month_start, '%m/%Y') AS month_label, {r("v", 4)} AS trend_value,
       {r("CASE WHEN seasonality = 'add' THEN v + season_index ELSE v * season_index END", 4)}
       AS forecast
FROM (SELECT *, {value} AS v FROM {s}ahead JOIN {s}fits USING (level, entity, n))""",
                                                                 s + "ahead", s + "fits")


span_ctes("sp_", "m1")
span_ctes("sq_", "m2_pair")
SQL["mod_any_span_coefficients"] = statement(f"""
SELECT level, entity, CAST(n AS INTEGER) AS n, {r("lk", 5)} AS linear_k, {r("lb", 5)} AS linear_b,
       {r("a2", 5)} AS poly2_a, {r("d3", 7)} AS poly3_a, {r("gk", 5)} AS log_a,
       {r("ek", 7)} AS exp_k, {r("pk", 7)} AS pow_k
FROM sp_fits""", "sp_fits")
SQL["mod_any_span_metrics"] = statement(f"""
SELECT level, entity, CAST(n AS INTEGER) AS n, trend, seasonality,
       {METRICS} FROM sp_scored""", "sp_scored")
SQL["mod_any_span_part_best"] = statement(f"""
SELECT level, entity, CAST(n AS INTEGER) AS n, trend, seasonality, {r("r2_exact")} AS r2_exact
FROM sq_best""", "sq_best")
SQL["mod_any_span_fitted"] = statement(f"""
SELECT level, entity, trend, seasonality, CAST(t AS INTEGER) AS t, month_start, y,
       {r("trend_value", 4)} AS trend_value, {r("season_index", 4)} AS season_index, fit
FROM sp_fitted SEMI JOIN sp_best USING (level, entity, ord)""", "sp_fitted", "sp_best")
