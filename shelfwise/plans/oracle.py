"""DuckDB SQL for every registered query, computed flat from the given tables.

The feed rules of ``sources.sales_feed`` and the cleaning rules of
``functions`` are restated here in SQL; the star tables are rebuilt with
``row_number()`` over their natural keys, and every metric is computed from
those CTEs.  Money is summed as DECIMAL(18,2) and turned into DOUBLE at the
end, on both engines.
"""

from __future__ import annotations

from ..sources.sales_feed import RAGGED_EVERY, RAGGED_UP_TO
from . import catalog as K

# The code points of white space, as Python's str.strip() has them.
WS_CODES = (9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233,
            8239, 8287, 12288)
WS = " || ".join(f"chr({c})" for c in WS_CODES)

# The order lines with their own truth: the answer to a corrupted spelling is
# the value it was made from, or Unknown where the rule drops the name.
LINES = """lines AS (
  SELECT l_orderkey, l_linenumber, p_partkey, l_quantity AS volume,
         p_retailprice + (p_partkey % 8) * 0.125::DOUBLE AS unit_price,
         l_extendedprice::DECIMAL(18,2) AS amount,
         date_trunc('week', l_shipdate)::DATE AS week_start,
         p_type AS category, p_brand AS brand, split_part(p_name, ' ', 2) AS variant,
         c_mktsegment AS retailer,
         l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey IN (
           SELECT n_nationkey FROM nation WHERE n_regionkey IN (
             SELECT r_regionkey FROM region WHERE r_name = 'AMERICA'))) AS is_internal
  FROM lineitem, part, orders, customer
  WHERE l_partkey = p_partkey AND l_orderkey = o_orderkey AND o_custkey = c_custkey)"""


def known(name: str, key: str) -> str:
    return f"CASE WHEN ({key}) % 20 IN (17, 18) THEN 'Unknown' ELSE {name} END"


RAW_INTERNAL = f"""reported_lines AS (
  SELECT CASE p_partkey % 10
           WHEN 0 THEN NULL
           WHEN 1 THEN 'sku a' || code
           WHEN 2 THEN 'SKU-' || code || '7'
           WHEN 3 THEN ' sku-' || code || chr(160)
           WHEN 4 THEN 'SKU-' || replace(code, '0', 'Z')
           WHEN 5 THEN CASE WHEN p_partkey % 100 = 5 THEN 'unassigned' ELSE 'SKU-' || code END
           ELSE 'SKU-' || code END AS Reported_SKU,
         volume AS Volume,
         CASE WHEN ln % 20 <> 0 THEN unit_price END AS Unit_Price,
         -- NULL, the empty text and n/a all read as missing
         CASE WHEN ln % 10 IN (0, 3) OR ln % 10 = 5 AND p_partkey % 2 = 0 THEN NULL
              WHEN ln % 10 = 2 AND p_partkey % 3 = 1 THEN (amount::VARCHAR)[1] || '_' || (amount::VARCHAR)[2:]
              WHEN ln % 10 = 6 AND p_partkey % 3 = 0 THEN '1e400'
              WHEN ln % 10 = 7 AND p_partkey % 2 = 0 THEN amount || 'D'
              WHEN ln % 10 = 7 THEN chr(160) || amount || ' '
              WHEN ln % 10 = 8 AND p_partkey % 4 = 0 THEN 'approx. 12'
              ELSE amount::VARCHAR END AS Total_Sales,
         CASE WHEN ln % 10 IN (0, 3) OR ln % 10 IN (5, 7) AND p_partkey % 2 = 0
                OR ln % 10 = 6 AND p_partkey % 3 = 0 OR ln % 10 = 8 AND p_partkey % 4 = 0
              THEN NULL ELSE amount::DOUBLE END AS reported,
         CASE l_orderkey % 20
           WHEN 2 THEN strftime(week_start, '%Y/%m/%d')
           WHEN 3 THEN strftime(week_start, '%Y-%m-%dT00:00:00')
           WHEN 4 THEN strftime(week_start, '%Y-%m-%d 00:00:00.000')
           WHEN 5 THEN year(week_start) || '-' || month(week_start) || '-' || day(week_start)
           WHEN 6 THEN strftime(week_start, '%m/%d/%Y')
           WHEN 7 THEN strftime(week_start, '%m-%d-%Y')
           WHEN 8 THEN day(week_start) || strftime(week_start, ' %b %Y')
           WHEN 9 THEN 'week unknown'
           ELSE strftime(week_start, '%Y-%m-%d') END AS Week_Start,
         CASE WHEN l_orderkey % 20 <> 9 THEN week_start END AS week_date,
         {known("brand", "p_partkey")} AS brand,
         {known("category", "p_partkey + l_linenumber")} AS category,
         {known("retailer", "l_orderkey")} AS retailer,
         {known("variant", "ln")} AS variant,
         l_orderkey <= {RAGGED_UP_TO} AND l_orderkey % {RAGGED_EVERY} = 3 AS again,
         l_linenumber % 2 = 1 AS odd
  FROM (SELECT *, lpad(p_partkey::VARCHAR, 9, '0') AS code, l_orderkey + l_linenumber AS ln
        FROM lines WHERE is_internal) x),
-- the late drop's records without their last field, the week; those with a
-- surplus field are refused
raw_internal AS (
  SELECT * EXCLUDE (again, odd) FROM reported_lines
  UNION ALL
  SELECT * EXCLUDE (again, odd) REPLACE (NULL AS Week_Start, NULL AS week_date)
  FROM reported_lines WHERE again AND NOT odd)"""

SKU_T = f"translate(upper(trim(Reported_SKU, {WS})), 'AZ', '-0')"
CLEAN_SKU = (f"CASE WHEN Reported_SKU IS NULL THEN NULL "
             f"WHEN regexp_extract({SKU_T}, '(\\d{{9}})', 1) <> '' "
             f"THEN 'SKU-' || regexp_extract({SKU_T}, '(\\d{{9}})', 1) ELSE {SKU_T} END")

# a missing total is volume times price, where both are there
CLEAN_INTERNAL = f"""clean_internal AS (
  SELECT {CLEAN_SKU} AS sku_id, brand, category, retailer, variant, Volume AS volume,
         coalesce(reported, Volume * Unit_Price) AS total_sales,
         reported IS NULL AND Volume IS NOT NULL AND Unit_Price IS NOT NULL AS is_imputed,
         Reported_SKU, reported, Total_Sales AS reported_text, Unit_Price AS unit_price,
         Week_Start AS reported_week, week_date AS week_start
  FROM raw_internal)"""

COMPETITOR = f"""competitor AS (
  SELECT {known("category", "d")} AS category, {known("retailer", "d + year(week_start)")} AS retailer,
         CASE WHEN d % 30 <> 4 THEN week_start END AS week_start,
         CASE WHEN d % 11 <> 3 THEN v END AS competitor_volume, s AS competitor_sales
  FROM (SELECT category, retailer, week_start, dayofyear(week_start) AS d,
               SUM(volume)::BIGINT AS v, SUM(amount)::DOUBLE AS s
        FROM lines WHERE NOT is_internal GROUP BY ALL) x)"""

DIMS = """dim_time AS (
  SELECT row_number() OVER (ORDER BY week_start) AS date_id, week_start,
         year(week_start) AS year, month(week_start) AS month, quarter(week_start) AS quarter,
         weekofyear(week_start) AS week_number, isoyear(week_start) AS iso_year
  FROM (SELECT week_start FROM clean_internal UNION SELECT week_start FROM competitor) w
  WHERE week_start IS NOT NULL),
dim_product AS (
  SELECT row_number() OVER (ORDER BY sku_id NULLS FIRST, brand, variant) AS product_id,
         sku_id, brand, variant
  FROM (SELECT DISTINCT sku_id, brand, variant FROM clean_internal) p),
dim_category AS (
  SELECT row_number() OVER (ORDER BY category) AS category_id, category
  FROM (SELECT category FROM clean_internal UNION SELECT category FROM competitor) c),
dim_retailer AS (
  SELECT row_number() OVER (ORDER BY retailer) AS retailer_id, retailer
  FROM (SELECT retailer FROM clean_internal UNION SELECT retailer FROM competitor) r)"""

# fi, fc: what of a cleaned feed is in its fact (a date and, inside, a SKU),
# with its attributes; the facts themselves replace these by their ids
FACTS = """fi AS (
  SELECT i.*, total_sales::DECIMAL(28,6) AS money, t.* EXCLUDE (week_start)
  FROM clean_internal i JOIN dim_time t USING (week_start) WHERE sku_id IS NOT NULL),
fc AS (
  SELECT m.*, competitor_sales::DECIMAL(28,6) AS money, t.* EXCLUDE (week_start)
  FROM competitor m JOIN dim_time t USING (week_start)),
fact_internal_sales AS (
  SELECT date_id, product_id, category_id, retailer_id, volume, total_sales, is_imputed
  FROM fi JOIN dim_product USING (sku_id, brand, variant) JOIN dim_category USING (category)
  JOIN dim_retailer USING (retailer)),
fact_competitor_market AS (
  SELECT date_id, category_id, retailer_id, competitor_volume, competitor_sales
  FROM fc JOIN dim_category USING (category) JOIN dim_retailer USING (retailer))"""

STAR = ",\n".join([LINES, RAW_INTERNAL, CLEAN_INTERNAL, COMPETITOR, DIMS, FACTS])


def _q(body: str, ctes: str = STAR) -> str:
    return f"WITH {ctes}\n{body}"


def pct(a: str, b: str) -> str:
    return f"ROUND((CAST({a} AS DOUBLE) - CAST({b} AS DOUBLE)) / NULLIF(CAST({b} AS DOUBLE), 0) * 100, 2)"


def ratio(a: str, b: str) -> str:
    return f"ROUND(CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0) * 100, 2)"


def rev(expr: str = "money") -> str:
    return f"CAST(SUM({expr}) AS DOUBLE)"


def lit(v) -> str:
    return f"'{v}'" if isinstance(v, str) else str(v)


# alias tables and spellings for the resolution queries
ALIAS = """canon AS (SELECT DISTINCT p_brand AS canonical FROM part WHERE p_brand IS NOT NULL),
gen AS (
  SELECT canonical, 0 AS pos, '' AS letter, canonical AS alias FROM canon
  UNION ALL
  SELECT canonical, pos, letter,
         substr(canonical, 1, pos - 1) || letter || substr(canonical, pos + 1) AS alias
  FROM (SELECT canonical, unnest(range(1, length(canonical) + 1)) AS pos FROM canon) x,
       (VALUES ('a'), ('e'), ('s'), ('x'), ('z')) l(letter)),
ranked AS (SELECT lower(alias) AS alias, canonical,
                  row_number() OVER (ORDER BY canonical, pos, letter) AS rank FROM gen),
idx AS (SELECT alias, arg_max(canonical, rank) AS canonical, min(rank) AS rank
        FROM ranked GROUP BY alias),
sp AS (
  SELECT DISTINCT CASE p_partkey % 9
    WHEN 1 THEN upper(p_brand)
    WHEN 2 THEN '  ' || lower(p_brand) || ' '
    WHEN 3 THEN substr(p_brand, 1, 1) || 'x' || substr(p_brand, 3)
    WHEN 4 THEN p_brand || ' Ltd'
    WHEN 5 THEN 'the ' || lower(p_brand) || ' co'
    WHEN 6 THEN substr(p_brand, 1, 1) || 'z' || substr(p_brand, 3, 1) || 'q' || substr(p_brand, 5)
    WHEN 7 THEN NULL
    WHEN 8 THEN upper(substr(p_brand, 1, 2) || 'z' || substr(p_brand, 4, 1) || 'q'
                      || substr(p_brand, 6))
    ELSE p_brand END AS raw
  FROM part),
ex AS (SELECT sp.raw, idx.canonical FROM sp JOIN idx ON lower(trim(sp.raw, """ + WS + """)) = idx.alias
       WHERE sp.raw IS NOT NULL)"""

# every form of every name with its answer: a re-cased, padded or one-letter
# form is a key, a name inside other words contains its own key, a name with a
# q in it is nearest to itself, half a name (ratio between 0.4 and 0.5) counts
# for variants only, and junk is like nothing
CASES = """names AS (
  SELECT DISTINCT 'brand' AS entity, p_brand AS x FROM part
  UNION SELECT 'category', p_type FROM part
  UNION SELECT 'variant', split_part(p_name, ' ', 2) FROM part
  UNION SELECT 'retailer', c_mktsegment FROM customer),
f AS (
  SELECT *, substr(x, 1, 1) || 'x' || substr(x, 3) AS near,
         substr(x, 1, 1) || 'q' || substr(x, 3) AS far,
         CASE WHEN entity = 'brand' THEN x ELSE 'the ' || lower(x) || ' co' END AS inside,
         CASE WHEN entity = 'brand' THEN 'exact' ELSE 'substring' END AS inside_tier,
         length(x) // 2 AS h
  FROM names),
cases AS (
  SELECT entity, x AS raw, x AS canonical, 'exact' AS match_tier FROM f
  UNION ALL SELECT entity, upper(x), x, 'exact' FROM f
  UNION ALL SELECT entity, '  ' || lower(x) || chr(9), x, 'exact' FROM f
  UNION ALL SELECT entity, near, x, 'exact' FROM f
  UNION ALL SELECT entity, x || chr(160), x, 'exact' FROM f
  UNION ALL SELECT entity, chr(12288) || ' ' || upper(x), x, 'exact' FROM f
  UNION ALL SELECT entity, inside, x, inside_tier FROM f
  UNION ALL SELECT entity, chr(160) || inside || ' ', x, inside_tier FROM f
  UNION ALL SELECT entity, far, x, 'fuzzy' FROM f
  UNION ALL SELECT entity, lower(far), x, 'fuzzy' FROM f
  UNION ALL SELECT entity, upper(far), x, 'fuzzy' FROM f
  UNION ALL SELECT entity, repeat('q', 24), 'Unknown', 'none' FROM f
  UNION ALL SELECT entity, left(x, h) || repeat('q', 4 * h - length(x) - 1),
                   CASE WHEN entity = 'variant' THEN x ELSE 'Unknown' END,
                   CASE WHEN entity = 'variant' THEN 'fuzzy' ELSE 'none' END
            FROM f WHERE entity <> 'brand' AND length(x) > 3
  UNION ALL SELECT 'variant', '""" + K.TIED + """', 'ring', 'fuzzy')"""

Y, B, B2, CAT, CAT2, WK, EY = (K.YEAR, lit(K.BRAND), lit(K.BRAND_B), lit(K.CATEGORY),
                               lit(K.CATEGORY_B), K.WEEK, K.EMPTY_YEAR)


def _yearly(where: str, by: str = "") -> str:
    sel = f"{by}, " if by else ""
    return (f"y AS (SELECT {sel}year, SUM(money) AS revenue FROM fi {where} "
            f"GROUP BY {sel}year)")


YOY_COLS = ("CAST(c.revenue AS DOUBLE) AS current_year_revenue, "
            "CAST(p.revenue AS DOUBLE) AS previous_year_revenue, "
            f"{pct('c.revenue', 'p.revenue')} AS yoy_growth_percent")


def _share(where: str) -> str:
    ctes = (STAR + f",\ni AS (SELECT SUM(money) AS s FROM fi {where}),\n"
                   f"m AS (SELECT SUM(money) AS s FROM fc {where})")
    return _q("SELECT CAST(i.s AS DOUBLE) AS internal_sales, CAST(m.s AS DOUBLE) AS competitor_sales, "
              "CAST(i.s + m.s AS DOUBLE) AS total_market_sales, "
              f"{ratio('i.s', 'i.s + m.s')} AS market_share_percent FROM i CROSS JOIN m", ctes)


def oracle_sql() -> dict[str, str]:
    q = {}
    q["clean_sku"] = _q(f"SELECT DISTINCT Reported_SKU AS raw_sku, {CLEAN_SKU} AS sku_id "
                        f"FROM raw_internal")
    q["impute_sales"] = _q("SELECT reported_text AS reported_sales, volume, unit_price, "
                           "total_sales, is_imputed FROM clean_internal")
    q["time_attributes"] = _q(
        "SELECT DISTINCT Week_Start AS reported_week, week_date AS week_start, year(week_date) AS year, "
        "month(week_date) AS month, quarter(week_date) AS quarter, "
        "weekofyear(week_date) AS week_number, isoyear(week_date) AS iso_year FROM raw_internal")
    attrs = ("year(week_start) AS year, month(week_start) AS month, quarter(week_start) AS quarter, "
             "weekofyear(week_start) AS week_number, isoyear(week_start) AS iso_year")
    q["clean_internal"] = _q(
        "SELECT sku_id, brand, category, retailer, variant, volume, total_sales, is_imputed, "
        f"week_start, {attrs} FROM clean_internal")
    q["streamed_clean_internal"] = q["clean_internal"]
    q["clean_competitor"] = _q(
        f"SELECT category, retailer, competitor_volume, competitor_sales, week_start, {attrs} "
        "FROM competitor")
    q["resolve_exact"] = _q("SELECT raw, canonical FROM ex", ALIAS)
    q["resolve_substring"] = _q(
        f"SELECT sp.raw, arg_min(idx.canonical, idx.rank) AS canonical FROM sp "
        f"JOIN idx ON contains(lower(trim(sp.raw, {WS})), idx.alias) "
        f"WHERE sp.raw IS NOT NULL AND sp.raw NOT IN (SELECT raw FROM ex) GROUP BY sp.raw", ALIAS)
    for t in ("dim_time", "dim_product", "dim_category", "dim_retailer",
              "fact_internal_sales", "fact_competitor_market"):
        q[t] = _q(f"SELECT * FROM {t}")
    def n(check, name, source, where="TRUE"):
        return f"SELECT '{check}' AS \"check\", '{name}' AS table_name, COUNT(*) AS value FROM {source} WHERE {where}"

    fi, fc, bad = "fact_internal_sales", "fact_competitor_market", "reported_week IS NOT NULL AND week_start IS NULL"
    counts = [n("row_count", t, t) for t in ("dim_time", "dim_product", "dim_category", "dim_retailer", fi, fc)]
    counts += [n("null_total_sales", fi, fi, "total_sales IS NULL"),
               n("unparseable_date", fi, "clean_internal", bad),
               n("dropped_date", fi, "clean_internal", "week_start IS NULL"),
               n("dropped_product", fi, "clean_internal", "week_start IS NOT NULL AND sku_id IS NULL"),
               n("dropped_category", fi, "clean_internal", "category IS NULL"),
               n("dropped_retailer", fi, "clean_internal", "retailer IS NULL"),
               n("unparseable_date", fc, "competitor", "week_start IS NULL"),
               n("dropped_date", fc, "competitor", "week_start IS NULL"),
               n("dropped_category", fc, "competitor", "category IS NULL"),
               n("dropped_retailer", fc, "competitor", "retailer IS NULL"),
               n("null_competitor_volume", fc, "competitor", "competitor_volume IS NULL"),
               n("short_records", fi, "reported_lines", "again AND NOT odd"),
               n("surplus_records", fi, "reported_lines", "again AND odd"),
               n("short_records", fc, "competitor", "FALSE"),
               n("surplus_records", fc, "competitor", "FALSE")]
    q["ledger_balance"] = _q("SELECT category, CAST(SUM(amount) AS DOUBLE) AS balance FROM lines "
                             "WHERE is_internal GROUP BY category")
    q["quality_counts"] = _q("\nUNION ALL ".join(counts))
    audits = []
    for t, src, attrs_of in ((fi, "fi", ("brand", "variant", "category", "retailer")),
                             (fc, "fc", ("category", "retailer"))):
        for a in attrs_of:
            n_unknown = f"COUNT(*) FILTER (WHERE {a} = 'Unknown')"
            audits.append(f"SELECT '{t}' AS table_name, '{a}' AS attribute, "
                          f"CAST({n_unknown} AS BIGINT) AS unknown_rows, "
                          f"CAST(COUNT(*) AS BIGINT) AS total_rows, "
                          f"{ratio(n_unknown, 'COUNT(*)')} AS unknown_percent FROM {src}")
    q["unknown_audit"] = _q(" UNION ALL ".join(audits))
    q["imputed_audit"] = _q(
        "SELECT year, CAST(COUNT(*) FILTER (WHERE is_imputed) AS BIGINT) AS imputed_rows, "
        "CAST(COUNT(*) AS BIGINT) AS total_rows, "
        "CAST(SUM(CASE WHEN is_imputed THEN money END) AS DOUBLE) AS imputed_revenue, "
        "CAST(SUM(money) AS DOUBLE) AS total_revenue, "
        f"{ratio('SUM(CASE WHEN is_imputed THEN money END)', 'SUM(money)')} AS imputed_share_percent "
        "FROM fi GROUP BY year")
    q["sales_text_audit"] = _q(
        "SELECT year(week_start) AS year, CAST(COUNT(*) AS BIGINT) AS rows, "
        "CAST(COUNT(*) FILTER (WHERE reported_text IS NULL) AS BIGINT) AS missing_reported, "
        "CAST(COUNT(*) FILTER (WHERE reported_text IS NOT NULL AND reported IS NULL) AS BIGINT) "
        "AS unparseable_reported, "
        "CAST(COUNT(*) FILTER (WHERE is_imputed) AS BIGINT) AS imputed_rows, "
        "CAST(COUNT(*) FILTER (WHERE total_sales IS NULL) AS BIGINT) AS null_sales "
        "FROM clean_internal GROUP BY year(week_start)")
    q["star_sample"] = _q(
        "SELECT week_start, brand, category, retailer, volume, total_sales FROM fi "
        "ORDER BY week_start NULLS FIRST, brand NULLS FIRST, category NULLS FIRST, "
        "retailer NULLS FIRST, volume NULLS FIRST, total_sales NULLS FIRST LIMIT 5")
    q["total_revenue"] = _q(f"SELECT {rev()} AS total_revenue FROM fi")
    q["total_revenue_from_fact"] = q["total_revenue"]
    q["total_revenue_filtered"] = _q(
        f"SELECT {rev()} AS total_revenue FROM fi WHERE year = {Y} AND brand = {B}")
    q["brand_revenue"] = _q(f"SELECT {rev()} AS total_revenue FROM fi WHERE brand = {B}")
    q["total_revenue_year_brand"] = _q(
        f"SELECT year, brand, {rev()} AS total_revenue FROM fi GROUP BY year, brand")
    q["rebuild_roundtrip"] = q["total_revenue_year_brand"]
    q["rebuild_twice"] = _q(f"SELECT year, brand, {rev()} AS total_revenue FROM fi "
                            "WHERE NOT regexp_matches(Reported_SKU, '[13579] *$') GROUP BY year, brand")
    q["rebuild_snapshot"] = q["rebuild_twice"]
    # members of the early feed are numbered first, the others after them
    q["rebuild_stable_keys"] = _q(
        "SELECT row_number() OVER (ORDER BY NOT early, sku_id NULLS FIRST, brand, variant) "
        "AS product_id, sku_id, brand, variant FROM (SELECT sku_id, brand, variant, bool_or("
        f"Reported_SKU IS NULL OR NOT regexp_matches(Reported_SKU, '{K.LATE_SKU}')) AS early "
        "FROM clean_internal GROUP BY sku_id, brand, variant) p")
    q["rebuild_incremental"] = _q(
        "SELECT year, CAST(SUM(money) AS DOUBLE) AS total_revenue, COUNT(*) AS weeks, "
        "COUNT(*) FILTER (WHERE gone) AS weeks_written FROM (SELECT year, week_start, "
        "SUM(money) FILTER (WHERE NOT taken) AS money, bool_or(taken) AS gone, "
        "bool_or(NOT taken) AS stays FROM (SELECT *, coalesce(reported_week LIKE "
        f"'{K.TAKEN_BACK}', false) AS taken FROM fi) l GROUP BY year, week_start) w "
        "WHERE stays GROUP BY year")
    q["resolve_fuzzy"] = _q("SELECT DISTINCT entity, raw, canonical, match_tier FROM cases "
                            "WHERE raw IS NOT NULL", CASES)
    q["total_revenue_empty_year"] = _q(
        f"SELECT {rev()} AS total_revenue FROM fi WHERE year = {EY} AND brand = {B}")
    q["yoy_growth"] = _q(
        f"SELECT c.year AS current_year, {YOY_COLS} FROM y c LEFT JOIN y p ON p.year = c.year - 1 "
        f"WHERE c.year = {Y}", STAR + ",\n" + _yearly(f"WHERE year IN ({Y}, {Y - 1})"))
    q["yoy_growth_brand"] = _q(
        f"SELECT c.year AS current_year, {YOY_COLS} FROM y c LEFT JOIN y p ON p.year = c.year - 1 "
        f"WHERE c.year = {Y}", STAR + ",\n" + _yearly(f"WHERE year IN ({Y}, {Y - 1}) AND brand = {B}"))
    q["yoy_growth_by_brand"] = _q(
        f"SELECT c.brand, c.year AS current_year, {YOY_COLS} FROM y c "
        f"LEFT JOIN y p ON p.brand = c.brand AND p.year = c.year - 1", STAR + ",\n" + _yearly("", "brand"))
    w = "OVER (PARTITION BY brand ORDER BY year RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING)"
    q["yoy_growth_window"] = _q(
        f"SELECT brand, year AS current_year, CAST(revenue AS DOUBLE) AS current_year_revenue, "
        f"CAST(SUM(revenue) {w} AS DOUBLE) AS previous_year_revenue, "
        f"{pct('revenue', f'SUM(revenue) {w}')} AS yoy_growth_percent FROM y",
        STAR + ",\n" + _yearly("", "brand"))
    q["market_share"] = _share(f"WHERE year = {Y} AND category = {CAT}")
    q["market_share_total"] = _share("")
    q["market_share_by_year_category"] = _q(
        "SELECT COALESCE(i.year, m.year) AS year, COALESCE(i.category, m.category) AS category, "
        "CAST(i.s AS DOUBLE) AS internal_sales, CAST(m.s AS DOUBLE) AS competitor_sales, "
        "CAST(i.s + m.s AS DOUBLE) AS total_market_sales, "
        f"{ratio('i.s', 'i.s + m.s')} AS market_share_percent "
        "FROM i FULL OUTER JOIN m ON i.year = m.year AND i.category = m.category",
        STAR + ",\ni AS (SELECT year, category, SUM(money) AS s FROM fi GROUP BY year, category),\n"
               "m AS (SELECT year, category, SUM(money) AS s FROM fc GROUP BY year, category)")
    pa = f"CAST(SUM(CASE WHEN brand = {B} THEN money END) AS DOUBLE)"
    pb = f"CAST(SUM(CASE WHEN brand = {B2} THEN money END) AS DOUBLE)"
    q["compare_brands_pivot"] = _q(
        f"SELECT year, {pa} AS brand_a_revenue, {pb} AS brand_b_revenue FROM fi "
        f"WHERE brand IN ({B}, {B2}) GROUP BY year")
    q["pct_difference"] = _q(
        f"SELECT year, revenue_a, revenue_b, {pct('revenue_a', 'revenue_b')} AS pct_difference "
        f"FROM (SELECT year, {pa} AS revenue_a, {pb} AS revenue_b FROM fi "
        f"WHERE brand IN ({B}, {B2}) GROUP BY year) x")
    q["volume_in_year"] = _q(f"SELECT SUM(volume) AS total_volume FROM fi WHERE year = {Y}")
    q["week_revenue"] = _q(
        f"SELECT {rev()} AS total_revenue FROM fi WHERE year = {Y} AND week_number = {WK} "
        f"AND brand = {B}")
    q["top_brand_in_category"] = _q(
        f"SELECT brand, {rev()} AS total_revenue FROM fi WHERE year = {Y} AND category = {CAT} "
        f"GROUP BY brand ORDER BY total_revenue DESC NULLS LAST, brand LIMIT 1")
    q["bottom_brand"] = _q(
        f"SELECT brand, {rev()} AS total_revenue FROM fi GROUP BY brand "
        f"ORDER BY total_revenue ASC NULLS LAST, brand LIMIT 1")
    q["top_k_per_group"] = _q(
        "SELECT * FROM (SELECT year, category, brand, total_revenue, "
        "row_number() OVER (PARTITION BY year, category ORDER BY total_revenue DESC NULLS LAST, "
        f"brand) AS rank FROM (SELECT year, category, brand, {rev()} AS total_revenue FROM fi "
        "GROUP BY year, category, brand) a) b WHERE rank <= 3")
    q["larger_category"] = _q(
        f"SELECT category, {rev()} AS total_revenue FROM fi WHERE year = {Y} "
        f"AND category IN ({CAT}, {CAT2}) GROUP BY category "
        f"ORDER BY total_revenue DESC NULLS LAST, category LIMIT 1")
    tot = "SUM(rev) OVER (PARTITION BY category)"
    q["brand_share_in_category"] = _q(
        f"SELECT category, brand, CAST(rev AS DOUBLE) AS brand_revenue, "
        f"CAST({tot} AS DOUBLE) AS category_revenue, {ratio('rev', tot)} AS share_percent "
        f"FROM (SELECT category, brand, SUM(money) AS rev FROM fi GROUP BY category, brand) x")
    q["brands_in_category"] = _q("SELECT DISTINCT category, brand FROM fi")
    q["internal_vs_competitor_volume"] = _q(
        "SELECT COALESCE(i.year, m.year) AS year, COALESCE(i.category, m.category) AS category, "
        "i.v AS internal_volume, m.v AS competitor_volume, CAST(i.s AS DOUBLE) AS internal_sales, "
        "CAST(m.s AS DOUBLE) AS competitor_sales "
        "FROM i FULL OUTER JOIN m ON i.year = m.year AND i.category = m.category",
        STAR + ",\ni AS (SELECT year, category, SUM(volume) AS v, SUM(money) AS s FROM fi "
               "GROUP BY year, category),\n"
               "m AS (SELECT year, category, CAST(SUM(competitor_volume) AS DOUBLE) AS v, "
               "SUM(money) AS s FROM fc GROUP BY year, category)")
    q["internal_vs_competitor_slice"] = _q(
        "SELECT i.v AS internal_volume, m.v AS competitor_volume, "
        "CAST(i.s AS DOUBLE) AS internal_sales, CAST(m.s AS DOUBLE) AS competitor_sales "
        "FROM i CROSS JOIN m",
        STAR + f",\ni AS (SELECT SUM(volume) AS v, SUM(money) AS s FROM fi "
               f"WHERE year = {Y} AND category = {CAT}),\n"
               f"m AS (SELECT CAST(SUM(competitor_volume) AS DOUBLE) AS v, SUM(money) AS s FROM fc "
               f"WHERE year = {Y} AND category = {CAT})")
    q["period_rollup"] = _q(
        f"SELECT year, quarter, month, week_start, "
        f"CAST(GROUPING(year, quarter, month, week_start) AS BIGINT) AS level_id, "
        f"{rev()} AS total_revenue, SUM(volume) AS total_volume FROM fi "
        f"GROUP BY ROLLUP (year, quarter, month, week_start)")
    q["hierarchy_rollup"] = _q(
        f"SELECT category, brand, variant, sku_id, "
        f"CAST(GROUPING(category, brand, variant, sku_id) AS BIGINT) AS level_id, "
        f"{rev()} AS total_revenue, SUM(volume) AS total_volume FROM fi "
        f"GROUP BY ROLLUP (category, brand, variant, sku_id)")
    wq = "OVER (PARTITION BY category ORDER BY year, quarter)"
    lag = f"LAG(rev) {wq}"
    last = wq.replace(")", " ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
    q["quarterly_trend"] = _q(
        f"SELECT category, year, quarter, CAST(rev AS DOUBLE) AS total_revenue, "
        f"CAST({lag} AS DOUBLE) AS previous_revenue, {pct('rev', lag)} AS change_percent, "
        f"CAST(ROUND(CAST(CAST(SUM(rev) {last} AS DOUBLE) / COUNT(rev) {last} AS DECIMAL(28,6)), 2) "
        f"AS DOUBLE) AS moving_avg "
        f"FROM (SELECT category, year, quarter, SUM(money) AS rev FROM fi "
        f"GROUP BY category, year, quarter) x")
    q["adhoc_sql"] = _q(
        f"SELECT category, quarter, {rev()} AS revenue, COUNT(DISTINCT week_start) AS weeks_sold, "
        "COUNT(*) FILTER (WHERE is_imputed) AS imputed_lines FROM fi WHERE volume > 5 "
        "GROUP BY category, quarter")
    q["kpi_requests"] = _q(KPI_BODY, STAR + ",\n" + KPI_CTES)
    return q


KPI_CTES = r"""pairs AS (SELECT DISTINCT year, brand FROM fi),
years AS (SELECT DISTINCT year FROM dim_time),
brands AS (SELECT DISTINCT brand FROM dim_product),
qs AS (
  SELECT 'What was the total revenue for ' || brand || ' in ' || CAST(year AS VARCHAR) || '?' AS question FROM pairs
  UNION SELECT 'Show me the total revenue in ' || CAST(year AS VARCHAR) || '.' FROM years
  UNION SELECT 'What was the total revenue in ' || CAST(year + 30 AS VARCHAR) || '?' FROM years
  UNION SELECT 'Total Revenue of ' || brand || ' overall, please' FROM brands
  UNION SELECT 'How did ' || brand || ' sell compared with last year?' FROM brands
  UNION SELECT 'Tell me a cake recipe from ' || CAST(year AS VARCHAR) FROM years),
bl AS (SELECT brand, row_number() OVER (ORDER BY length(brand) DESC, brand) AS rank FROM brands),
found AS (SELECT q.question, arg_min(bl.brand, bl.rank) AS brand FROM qs q
          JOIN bl ON contains(lower(q.question), lower(bl.brand)) GROUP BY q.question),
parsed AS (
  SELECT q.question,
         CASE WHEN regexp_extract(q.question, '\b((?:19|20)\d{2})\b', 1) <> ''
              THEN CAST(regexp_extract(q.question, '\b((?:19|20)\d{2})\b', 1) AS BIGINT) END AS year,
         f.brand, contains(lower(q.question), 'total revenue') AS answerable
  FROM qs q LEFT JOIN found f ON q.question = f.question),
cube AS (SELECT year, brand, SUM(money) AS rev FROM fi GROUP BY CUBE (year, brand))"""

KPI_BODY = """SELECT p.question, p.year, p.brand,
       CASE WHEN p.answerable THEN 'answered' ELSE 'not_answered' END AS status,
       CAST(c.rev AS DOUBLE) AS total_revenue
FROM parsed p LEFT JOIN cube c ON p.answerable AND p.year IS NOT DISTINCT FROM c.year
     AND p.brand IS NOT DISTINCT FROM c.brand"""
