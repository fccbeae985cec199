"""DuckDB SQL that every checkable query is compared with.

The texts share named building blocks. ``_sql`` puts the blocks a query needs, in dependency order,
in front of its final SELECT.
"""

from __future__ import annotations

import re

# Blocks that recursive ones read again in every step.
MATERIALIZED: set[str] = {"scaled"}

# Marketplace tables on top of the test tables.
BLOCKS: dict[str, str] = {
    "first_ship": "SELECT l_orderkey, min(l_shipdate) AS first_ship FROM lineitem GROUP BY 1",
    "orders_v": """
        SELECT o_orderkey AS order_id, o_custkey AS customer_id,
               CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'shipped' ELSE 'canceled' END AS order_status,
               o_orderdate AS order_purchase_timestamp,
               o_orderdate + INTERVAL 30 DAY AS order_estimated_delivery_date,
               o_orderdate + to_days(CAST(((date_diff('day', o_orderdate, first_ship) % 45) + 45) % 45 AS INTEGER))
                   AS order_delivered_customer_date
        FROM orders LEFT JOIN first_ship ON o_orderkey = l_orderkey""",
    "items_v": """
        SELECT l_orderkey AS order_id, l_partkey AS product_id, l_suppkey AS seller_id,
               l_extendedprice * (1 - l_discount) AS price, l_extendedprice * l_tax AS freight_value
        FROM lineitem""",
    "customers_v": """
        SELECT c_custkey AS customer_id,
               lpad(CAST(c_nationkey * 4 AS VARCHAR), 2, '0') || '000' AS customer_zip_code_prefix
        FROM customer""",
    "products_v": """
        SELECT p_partkey AS product_id, CASE WHEN p_size % 10 <> 0 THEN p_type END AS product_category_name
        FROM part""",
    "reviews_v": """
        SELECT event_id AS review_id, event_id AS order_id,
               CASE event_type WHEN 'error' THEN 1 WHEN 'signup' THEN 2 WHEN 'view' THEN 3
                               WHEN 'click' THEN 4 WHEN 'purchase' THEN 5 END AS review_score,
               o_orderdate + INTERVAL 35 DAY AS review_creation_date
        FROM events JOIN orders ON event_id = o_orderkey""",
}


def _months_before(expr: str, months: int) -> str:
    """Date some months earlier, where a missing day runs over into the next month."""
    first = f"CAST(date_trunc('month', {expr}) AS DATE) - INTERVAL {months} MONTH"
    return f"(({first}) + to_days(CAST(day({expr}) - 1 AS INTEGER)))"


def _sql(final: str) -> str:
    """Final SELECT with the blocks it names, and the blocks those name, placed before it."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for word in re.findall(r"\b\w+\b", text):
            if word in BLOCKS and word not in ordered and word not in pending:
                pending.append(word)
                visit(BLOCKS[word])
                pending.remove(word)
                ordered.append(word)

    pending: list[str] = []
    visit(final)
    if not ordered:
        return final
    listed = (f"{name} AS {'MATERIALIZED ' if name in MATERIALIZED else ''}({BLOCKS[name]})" for name in ordered)
    return "WITH RECURSIVE " + ",\n".join(listed) + "\n" + final


def r4(expr: str) -> str:
    """Four decimals, without a negative zero."""
    return f"(CASE WHEN abs({expr}) < 0.00005 THEN 0.0 ELSE round({expr}, 4) END)"


def whole(expr: str) -> str:
    """Integer part of an amount after the noise of float addition is rounded away."""
    return f"CAST(trunc(round({expr}, 6)) AS BIGINT)"


BLOCKS["rfm"] = f"""
    SELECT c.customer_id, max(o.order_purchase_timestamp) AS order_purchase_timestamp,
           date_sub('day', max(o.order_purchase_timestamp),
                    (SELECT max(order_purchase_timestamp) FROM orders_v WHERE order_status = 'delivered')) AS recency_days,
           count(o.order_id) AS frequency, {whole('sum(i.price + i.freight_value)')} AS monetary
    FROM customers_v c JOIN orders_v o ON c.customer_id = o.customer_id JOIN items_v i ON o.order_id = i.order_id
    WHERE o.order_status = 'delivered' GROUP BY c.customer_id"""

BLOCKS["satisfaction"] = """
    SELECT o.customer_id, CAST(trunc(avg(r.review_score)) AS BIGINT) AS avg_review_score,
           count(r.review_id) AS review_count,
           CAST(max(CASE WHEN n.customer_id IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS has_negative_flag
    FROM orders_v o JOIN reviews_v r ON o.order_id = r.order_id
    LEFT JOIN (SELECT DISTINCT o2.customer_id FROM orders_v o2 JOIN reviews_v r2 ON o2.order_id = r2.order_id
               WHERE r2.review_score <= 2) n ON o.customer_id = n.customer_id
    GROUP BY o.customer_id"""

BLOCKS["behavior"] = """
    SELECT o.customer_id, count(p.product_category_name) AS unique_categories,
           avg(date_sub('day', o.order_purchase_timestamp, o.order_delivered_customer_date)) AS avg_delivery_time,
           count(i.seller_id) AS unique_sellers
    FROM orders_v o JOIN items_v i ON o.order_id = i.order_id JOIN products_v p ON i.product_id = p.product_id
    WHERE o.order_status = 'delivered' GROUP BY o.customer_id"""

BLOCKS["features"] = """
    SELECT rfm.customer_id, order_purchase_timestamp, recency_days, frequency, monetary, avg_review_score,
           review_count, has_negative_flag, unique_categories, avg_delivery_time, unique_sellers
    FROM rfm LEFT JOIN satisfaction s ON rfm.customer_id = s.customer_id
    LEFT JOIN behavior b ON rfm.customer_id = b.customer_id"""


def _recent(months: int, late: bool) -> str:
    newest = "(SELECT max(order_purchase_timestamp) FROM orders_v WHERE order_status <> 'canceled')"
    late_test = ("AND order_delivered_customer_date >= CAST(order_estimated_delivery_date AS DATE) + INTERVAL 3 DAY"
                 if late else "")
    return f"""SELECT * FROM orders_v
        WHERE order_status <> 'canceled' AND order_estimated_delivery_date IS NOT NULL
          AND order_delivered_customer_date IS NOT NULL {late_test}
          AND order_purchase_timestamp BETWEEN {_months_before(newest, months)} AND {newest}"""


def _revenue(threshold: int) -> str:
    return f"""
        SELECT s.s_suppkey AS seller_id, {whole('sum(i.price + i.freight_value)')} AS total_revenue
        FROM supplier s JOIN items_v i ON s.s_suppkey = i.seller_id JOIN orders_v o ON i.order_id = o.order_id
        WHERE o.order_status = 'delivered' GROUP BY 1
        HAVING {whole('sum(i.price + i.freight_value)')} > {threshold}"""


def _postcodes(min_reviews: int) -> str:
    newest = "(SELECT max(order_purchase_timestamp) FROM orders_v)"
    return f"""
        SELECT c.customer_zip_code_prefix, count(r.review_id) AS review_count, round(avg(r.review_score), 2) AS avg_score
        FROM customers_v c JOIN orders_v o ON c.customer_id = o.customer_id JOIN reviews_v r ON o.order_id = r.order_id
        WHERE r.review_creation_date >= {_months_before(newest, 12)}
        GROUP BY 1 HAVING count(r.review_id) >= {min_reviews}"""


def _coordinates(source: str, columns: str) -> str:
    from shoplens.operators.kpi_tables import AREA_COORDINATES, COUNTRY_COORDINATES, REGION_COORDINATES

    def values(table):
        return ", ".join(f"('{p}', {lat}, {lon})" for p, (lat, lon) in table.items())

    lat, lon = COUNTRY_COORDINATES
    return f"""
        SELECT {columns}, CAST(coalesce(a.lat, g.lat, {lat}) AS DOUBLE) AS latitude,
               CAST(coalesce(a.lon, g.lon, {lon}) AS DOUBLE) AS longitude
        FROM ({source}) z
        LEFT JOIN (VALUES {values(AREA_COORDINATES)}) a(p, lat, lon) ON a.p = z.customer_zip_code_prefix[1:2]
        LEFT JOIN (VALUES {values(REGION_COORDINATES)}) g(p, lat, lon) ON g.p = z.customer_zip_code_prefix[1:1]"""


FEATURES = ("recency_days", "frequency", "monetary", "avg_review_score", "review_count", "has_negative_flag",
            "unique_categories", "avg_delivery_time", "unique_sellers")


def _feature_select(source: str, columns=FEATURES, extra: str = "customer_id, order_purchase_timestamp") -> str:
    picked = [f"{r4(c)} AS {c}" if c == "avg_delivery_time" else c for c in columns]
    return f"SELECT {extra}, {', '.join(picked)} FROM {source}"


def table_queries() -> dict[str, str]:
    """Sources, KPIs, KPI tables and features."""
    from shoplens.sources.catalog import TABLES

    inventory = " UNION ALL ".join(
        f"""SELECT '{t}' AS table_name, count(*) AS n_rows,
            (SELECT CAST(count(*) AS INTEGER) FROM information_schema.columns WHERE table_name = '{t}') AS n_columns
            FROM {t}""" for t in TABLES)
    late_months = f"""
        SELECT strftime(order_purchase_timestamp, '%Y-%m') AS purchase_month,
               CASE WHEN d < 3 THEN 'No Delay' WHEN d <= 4 THEN '3-4 days' WHEN d <= 5 THEN '4-5 days'
                    WHEN d <= 7 THEN '5-7 days' WHEN d <= 10 THEN '7-10 days' ELSE '10+ days' END AS delay_category,
               count(*) AS count
        FROM (SELECT *, floor((epoch_us(order_delivered_customer_date) - epoch_us(order_estimated_delivery_date))
                              / 86400000000.0) AS d FROM ({_recent(6, False)})) GROUP BY 1, 2"""
    return {
        "cached_sql_query": """SELECT l_returnflag, l_linestatus, count(*) AS n_items, round(sum(l_quantity), 2) AS quantity
                               FROM lineitem GROUP BY l_returnflag, l_linestatus""",
        "cached_table": "SELECT * FROM nation",
        "table_inventory": inventory,
        "scan_orders": "SELECT * FROM orders",
        "table_preview": "SELECT * FROM orders ORDER BY o_orderkey LIMIT 5",
        "sql_text_query": """
            SELECT o_orderstatus, o_orderpriority, count(*) AS n_orders, round(avg(o_totalprice), 2) AS mean_price
            FROM orders GROUP BY o_orderstatus, o_orderpriority""",
        "materialized_result": f"SELECT seller_id, total_revenue FROM ({_revenue(0)})",
        "late_deliveries": _recent(3, True),
        "recent_deliveries": _recent(6, False),
        "high_revenue_sellers": _revenue(10_500_000),
        "new_engaged_sellers": f"""
            SELECT p.p_partkey AS seller_id, min(o.order_purchase_timestamp) AS first_sale,
                   count(DISTINCT i.order_id) AS total_orders, count(i.product_id) AS total_products
            FROM part p JOIN items_v i ON p.p_partkey = i.product_id JOIN orders_v o ON i.order_id = o.order_id
            GROUP BY 1 HAVING count(i.product_id) > 30 AND min(o.order_purchase_timestamp) >=
                {_months_before('(SELECT max(order_purchase_timestamp) FROM orders_v)', 78)}""",
        "worst_postcodes": f"SELECT * FROM ({_postcodes(30)}) ORDER BY avg_score, customer_zip_code_prefix LIMIT 5",
        "postcode_scores": _postcodes(1),
        "rfm_features": "SELECT * FROM rfm",
        "satisfaction_features": "SELECT * FROM satisfaction",
        "behavior_features": f"""
            SELECT customer_id, unique_categories, {r4('avg_delivery_time')} AS avg_delivery_time, unique_sellers
            FROM behavior""",
        "combined_features": _feature_select("features"),
        "late_delivery_by_month": late_months,
        "top_sellers": f"""
            SELECT seller_id, total_revenue, substr(CAST(seller_id AS VARCHAR), 1, 8) || '...' AS seller_id_short
            FROM ({_revenue(0)}) ORDER BY total_revenue DESC, seller_id LIMIT 30""",
        "postcode_coordinates": _coordinates(
            "SELECT DISTINCT customer_zip_code_prefix FROM customers_v", "z.customer_zip_code_prefix"),
        "postcode_review_map": _coordinates(
            _postcodes(1), "z.customer_zip_code_prefix, z.review_count, z.avg_score"),
    }


CONTINUOUS = ("recency_days", "monetary", "avg_review_score", "avg_delivery_time")
COUNTS = ("review_count", "unique_categories", "frequency", "unique_sellers")
FLAG = "has_negative_flag"


def _union(parts) -> str:
    return " UNION ALL ".join(parts)


def _long(source: str, columns=FEATURES, keys: str = "") -> str:
    return _union(f"""SELECT {keys} '{c}' AS feature, CAST("{c}" AS DOUBLE) AS value FROM {source}
                      WHERE "{c}" IS NOT NULL""" for c in columns)


BLOCKS["features_long"] = _long("features")

BLOCKS["limit_base"] = """
    SELECT feature, avg(value) AS m, stddev_samp(value) AS s, min(value) AS lo, max(value) AS hi,
           quantile_cont(value, 0.01) AS q01, quantile_cont(value, 0.05) AS q05, quantile_cont(value, 0.25) AS q25,
           quantile_cont(value, 0.75) AS q75, quantile_cont(value, 0.95) AS q95, quantile_cont(value, 0.99) AS q99
    FROM features_long GROUP BY feature"""

RULES = {
    "Z-score (±3)": ("m - 3 * s", "m + 3 * s"),
    "IQR 1.5": ("q25 - 1.5 * (q75 - q25)", "q75 + 1.5 * (q75 - q25)"),
    "Z-score (±2)": ("m - 2 * s", "m + 2 * s"),
    "Quantile 1-99": ("q01", "q99"),
    "Quantile 5-95": ("q05", "q95"),
    "Full Range": ("lo", "hi"),
}

BLOCKS["rule_limits"] = _union(
    f"SELECT '{name}' AS method, feature, {lo} AS lower_bound, {hi} AS upper_bound FROM limit_base"
    for name, (lo, hi) in RULES.items())

_OUTSIDE = "(value < lower_bound OR value > upper_bound)"
_INSIDE = "CASE WHEN value BETWEEN lower_bound AND upper_bound THEN value END"


def _skew(value: str) -> str:
    return f"""CASE WHEN count({value}) < 3 THEN NULL WHEN max({value}) = min({value}) THEN 0.0
                    ELSE skewness({value}) END"""


BLOCKS["outlier_stats"] = f"""
    SELECT method, feature, lower_bound, upper_bound, count(*) AS n,
           count(*) FILTER (WHERE value < lower_bound) AS below_min,
           count(*) FILTER (WHERE value > upper_bound) AS above_max,
           count(*) FILTER (WHERE {_OUTSIDE}) AS outlier_count,
           min(value) FILTER (WHERE value < lower_bound) AS extreme_min,
           max(value) FILTER (WHERE value > upper_bound) AS extreme_max,
           avg(value) AS mean_with, stddev_samp(value) AS std_with, median(value) AS median_with,
           avg({_INSIDE}) AS mean_without, stddev_samp({_INSIDE}) AS std_without,
           median({_INSIDE}) AS median_without, {_skew('value')} AS skewness
    FROM features_long JOIN rule_limits USING (feature) GROUP BY method, feature, lower_bound, upper_bound"""


def _z3_select(source: str, columns) -> str:
    kept = [c for c in FEATURES if c not in columns]
    limits = ", ".join(f"avg({c}) - 3 * stddev_samp({c}) AS lo_{c}, avg({c}) + 3 * stddev_samp({c}) AS hi_{c}"
                       for c in columns)
    cleaned = ", ".join(f"CASE WHEN {c} BETWEEN lo_{c} AND hi_{c} THEN {c} END AS {c}" for c in columns)
    keep = "".join(f", {c}" for c in kept)
    return f"""SELECT customer_id, order_purchase_timestamp{keep}, {cleaned}
               FROM {source}, (SELECT {limits} FROM {source})"""


BLOCKS["cleaned"] = _z3_select("features", FEATURES)
BLOCKS["hybrid"] = _z3_select("features", CONTINUOUS)


def _binned(source: str, bins: str) -> str:
    """Bins per feature; ``bins`` is an expression over the number of values ``total``."""
    return f"""
        layout AS (SELECT feature, total, bins, mean, std, lo, (hi - lo) / bins AS width FROM (
            SELECT feature, count(*) AS total, avg(value) AS mean, stddev_samp(value) AS std,
                   CASE WHEN min(value) = max(value) THEN min(value) - 0.5 ELSE min(value) END AS lo,
                   CASE WHEN min(value) = max(value) THEN max(value) + 0.5 ELSE max(value) END AS hi,
                   CAST({bins.format(total='count(*)')} AS INTEGER) AS bins
            FROM ({_long(source)}) GROUP BY feature)),
        placed AS (SELECT feature, CASE WHEN value < lo + b * width THEN b - 1
                               WHEN value >= lo + (b + 1) * width AND b < bins - 1 THEN b + 1 ELSE b END AS bin
            FROM (SELECT feature, value, lo, width, bins,
                         least(CAST(floor((value - lo) / width) AS INTEGER), bins - 1) AS b
                  FROM ({_long(source)}) JOIN layout USING (feature))),
        grid AS (SELECT layout.*, CAST(unnest(range(bins)) AS INTEGER) AS bin FROM layout),
        binned AS (SELECT g.feature, g.bin, lo + g.bin * width AS bin_start, lo + (g.bin + 1) * width AS bin_end,
                          count(p.bin) AS n, any_value(total) AS total, any_value(width) AS width,
                          any_value(mean) AS mean, any_value(std) AS std
                   FROM grid g LEFT JOIN placed p ON g.feature = p.feature AND g.bin = p.bin
                   GROUP BY g.feature, g.bin, lo, width)"""


def _with_local(local: str, final: str) -> str:
    """Query whose own helper tables follow the shared blocks."""
    text = _sql(f"SELECT * FROM ({final}) -- {' '.join(re.findall(chr(92) + 'w+', local))}")
    text = text[: text.rindex(" -- ")]
    head, tail = text.rsplit("\nSELECT * FROM (", 1)
    return f"{head},\n{local}\nSELECT * FROM ({tail}"


def profiling_queries() -> dict[str, str]:
    pairs = [(a, b) for a in FEATURES for b in FEATURES]

    def correlation(a, b):
        if a == b:
            return f"CASE WHEN stddev_pop({a}) > 0 THEN 1.0 END"
        both = f"FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
        return (f"CASE WHEN stddev_pop({a}) {both} > 0 AND stddev_pop({b}) {both} > 0 "
                f"THEN corr({a}, {b}) END")

    matrix = _union(f"SELECT '{a}' AS feature_x, '{b}' AS feature_y, CAST({correlation(a, b)} AS DOUBLE) AS v FROM hybrid"
                    for a, b in pairs)
    triangle = _union(
        f"SELECT '{a}' AS feature_x, '{b}' AS feature_y, {correlation(a, b)} AS v FROM hybrid"
        for i, a in enumerate(FEATURES) for j, b in enumerate(FEATURES) if i > j)
    sturges = "least(50, greatest(10, ceil(log2({total})) + 1))"
    density = f"""
        SELECT feature, bin, {r4('(bin_start + bin_end) / 2')} AS bin_center, n,
               {r4('n / (total * width)')} AS density,
               CASE WHEN std > 0 THEN {r4('exp(-pow(((bin_start + bin_end) / 2 - mean) / std, 2) / 2) / (std * sqrt(2 * pi()))')}
               END AS normal_density FROM binned"""
    rules = {"outliers_z3": "Z-score (±3)", "outliers_iqr": "IQR 1.5", "outliers_z2": "Z-score (±2)",
             "outliers_q01_q99": "Quantile 1-99", "outliers_q05_q95": "Quantile 5-95",
             "outliers_full_range": "Full Range"}
    texts = {
        "correlation_matrix": _sql(f"SELECT feature_x, feature_y, {r4('v')} AS correlation FROM ({matrix})"),
        "correlation_lower_triangle": _sql(
            f"""SELECT feature_x, feature_y, {r4('v')} AS correlation,
                       CASE WHEN abs(v) < 0.005 THEN 0.0 ELSE round(v, 2) END AS label FROM ({triangle})"""),
        "feature_histograms": _with_local(_binned("features", "20"), f"""
            SELECT feature, bin, {r4('bin_start')} AS bin_start, {r4('bin_end')} AS bin_end, n FROM binned"""),
        "density_histogram": _with_local(_binned("cleaned", sturges), density),
        "feature_box_stats": _sql(f"""
            SELECT feature, n, {r4('q1')} AS q1, {r4('q2')} AS median, {r4('q3')} AS q3,
                   {r4('greatest(lo, q1 - 1.5 * (q3 - q1))')} AS whisker_low,
                   {r4('least(hi, q3 + 1.5 * (q3 - q1))')} AS whisker_high, {r4('m')} AS mean
            FROM (SELECT feature, count(*) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2,
                         quantile_cont(value, 0.75) AS q3, min(value) AS lo, max(value) AS hi, avg(value) AS m
                  FROM features_long GROUP BY feature)"""),
        "column_summary": _sql(f"""
            SELECT feature, {r4(_skew('value'))} AS skewness, {r4('avg(value)')} AS mean,
                   {r4('median(value)')} AS median, {r4('stddev_samp(value)')} AS std, min(value) > 0 AS can_use_log
            FROM ({_long('cleaned')}) GROUP BY feature"""),
        "outlier_summary_all_methods": _sql(f"""
            SELECT method, feature, outlier_count, {r4('outlier_count / n * 100')} AS outlier_pct, below_min, above_max,
                   {r4('lower_bound')} AS min_limit, {r4('upper_bound')} AS max_limit,
                   {r4('extreme_min')} AS extreme_min, {r4('extreme_max')} AS extreme_max,
                   {r4('mean_with')} AS mean_with, {r4('mean_without')} AS mean_without,
                   coalesce({r4('(mean_with - mean_without) / nullif(mean_without, 0) * 100')}, 0.0) AS mean_pct_change,
                   {r4('skewness')} AS skewness, {r4('median_with')} AS median_with, {r4('std_with')} AS std_with,
                   {r4('median_without')} AS median_without, {r4('std_without')} AS std_without
            FROM outlier_stats"""),
        "outlier_method_comparison": _sql(f"""
            SELECT method, {r4('lower_bound')} AS lower_bound, {r4('upper_bound')} AS upper_bound, outlier_count,
                   {r4('outlier_count / n * 100')} AS outlier_pct, {r4('mean_with')} AS mean_with,
                   {r4('mean_without')} AS mean_without,
                   {r4('(mean_with - mean_without) / nullif(mean_without, 0) * 100')} AS mean_pct_change,
                   {r4('median_with')} AS median_with, {r4('median_without')} AS median_without,
                   {r4('std_with')} AS std_with, {r4('std_without')} AS std_without,
                   {r4('(std_with - std_without) / nullif(std_without, 0) * 100')} AS std_pct_change
            FROM outlier_stats WHERE feature = 'monetary'"""),
        "outlier_cleaned": _sql(_feature_select("cleaned")),
        "hybrid_features": _sql(_feature_select("hybrid")),
        "features_with_dates": _sql(_feature_select(
            """(SELECT h.* EXCLUDE (order_purchase_timestamp), d.order_purchase_timestamp FROM hybrid h LEFT JOIN
             (SELECT customer_id, max(order_purchase_timestamp) AS order_purchase_timestamp FROM orders_v GROUP BY 1) d
             ON h.customer_id = d.customer_id)""")),
    }
    for name, rule in rules.items():
        texts[name] = _sql(f"""
            SELECT feature, {r4('lower_bound')} AS lower_bound, {r4('upper_bound')} AS upper_bound, outlier_count
            FROM outlier_stats WHERE method = '{rule}'""")
    return texts


# --- scaling -------------------------------------------------------------------------------------

SCALED = (f"{FLAG}_0.0", f"{FLAG}_1.0", *COUNTS, *CONTINUOUS)


def _scaling_blocks(prefix: str, source: str, learn_from: str) -> None:
    """Blocks that learn on one relation and scale another: fills, filled, spreads, scaled."""
    measured = (*COUNTS, *CONTINUOUS)
    BLOCKS[f"{prefix}_fill"] = f"""
        SELECT {', '.join(f'quantile_cont({c}, 0.5) AS fill_{c}' for c in measured)},
               (SELECT {FLAG} FROM {learn_from} WHERE {FLAG} IS NOT NULL
                GROUP BY 1 ORDER BY count(*) DESC, {FLAG} LIMIT 1) AS fill_{FLAG}
        FROM {learn_from}"""
    filled = ", ".join([f"ln(1 + coalesce({c}, fill_{c})) AS {c}" for c in COUNTS]
                       + [f"coalesce({c}, fill_{c}) AS {c}" for c in CONTINUOUS]
                       + [f"coalesce({FLAG}, fill_{FLAG}) AS {FLAG}"])
    BLOCKS[f"{prefix}_learned"] = f"SELECT {filled} FROM {learn_from}, {prefix}_fill"
    BLOCKS[f"{prefix}_spread"] = "SELECT " + ", ".join(
        f"""quantile_cont({c}, 0.5) AS mid_{c},
            coalesce(nullif(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 0), 1.0) AS iqr_{c}"""
        for c in measured) + f" FROM {prefix}_learned"
    BLOCKS[f"{prefix}_filled"] = f"SELECT customer_id, {filled} FROM {source}, {prefix}_fill"
    BLOCKS[f"{prefix}_scaled"] = f"""
        SELECT customer_id, CASE WHEN {FLAG} = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS "{FLAG}_0.0",
               CASE WHEN {FLAG} = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS "{FLAG}_1.0",
               {', '.join(f'({c} - mid_{c}) / iqr_{c} AS {c}' for c in measured)}
        FROM {prefix}_filled, {prefix}_spread"""


BLOCKS["hybrid_past"] = "SELECT * FROM hybrid WHERE order_purchase_timestamp < TIMESTAMP '2001-01-01'"
_scaling_blocks("base", "hybrid", "hybrid")
_scaling_blocks("past", "hybrid", "hybrid_past")
BLOCKS["scaled"] = "SELECT * FROM base_scaled"


def _rounded(columns) -> str:
    return ", ".join(f"""{r4(f'"{c}"')} AS "{c}\"""" for c in columns)


SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def scaling_queries() -> dict[str, str]:
    role_rows = _union([
        f"""SELECT '{c}' AS feature, CASE WHEN count({c}) = count(*) AND min({c}) >= 0
                 AND count(DISTINCT {c}) < count(*) * 0.1 THEN 'count' ELSE 'numerical' END AS role FROM hybrid"""
        if c != "avg_delivery_time" else f"SELECT '{c}' AS feature, 'numerical' AS role" for c in FEATURES
    ] + ["SELECT 'c_mktsegment' AS feature, 'categorical' AS role"])
    modes = {c: f"""coalesce({c}, (SELECT {c} FROM hybrid WHERE {c} IS NOT NULL
                    GROUP BY 1 ORDER BY count(*) DESC, {c} LIMIT 1)) AS {c}""" for c in (FLAG, "avg_review_score")}
    hot = ", ".join(f"CASE WHEN c_mktsegment = '{s}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS \"c_mktsegment_{s}\""
                    for s in SEGMENTS)
    measured = (*COUNTS, *CONTINUOUS)
    inverse = ", ".join(
        [f"CAST(round_even(exp({c} * iqr_{c} + mid_{c}) - 1, 0) AS BIGINT) AS {c}" for c in COUNTS]
        + [f"{r4(f'{c} * iqr_{c} + mid_{c}')} AS {c}" for c in CONTINUOUS])
    return {
        "column_roles": role_rows,
        "impute_mode": f"SELECT customer_id, {modes[FLAG]}, {modes['avg_review_score']} FROM hybrid",
        "one_hot": f"""SELECT f.customer_id, f."{FLAG}_0.0", f."{FLAG}_1.0", {hot}
                       FROM base_scaled f JOIN customer ON f.customer_id = c_custkey""",
        "impute_median": f"""SELECT customer_id, {', '.join(
            f"{r4(f'coalesce({c}, fill_{c})::DOUBLE')} AS {c}" for c in measured)} FROM hybrid, base_fill""",
        "log1p_counts": f"SELECT customer_id, {', '.join(f'{r4(f"ln(1 + {c})")} AS {c}' for c in COUNTS)} FROM hybrid",
        "robust_scale": f"SELECT customer_id, {_rounded(CONTINUOUS)} FROM base_scaled",
        "time_features": """SELECT event_id, CAST(isodow(ts) - 1 AS INTEGER) AS ts_day_of_week,
            CAST(month(ts) AS INTEGER) AS ts_month, CAST(quarter(ts) AS INTEGER) AS ts_quarter FROM events""",
        "transform_features": f"SELECT customer_id, {_rounded(SCALED)} FROM scaled",
        "transform_new_data": f"SELECT customer_id, {_rounded(SCALED)} FROM past_scaled",
        "inverse_transform": f"SELECT customer_id, {inverse} FROM scaled, base_spread",
    }


# --- clusters ------------------------------------------------------------------------------------

START = "monetary"
K = 4


def q(column: str, alias: str = "") -> str:
    return f'{alias}."{column}"' if alias else f'"{column}"'


def _all(template: str, columns=SCALED, sep: str = ", ") -> str:
    return sep.join(template.format(c=q(c)) for c in columns)


def _distance(a: str, b: str, columns=SCALED) -> str:
    return " + ".join(f"({q(c, a)} - {q(c, b)}) * ({q(c, a)} - {q(c, b)})" for c in columns)


def _step_blocks(prefix: str, source: str, columns=SCALED, group: str | None = None) -> None:
    """Blocks of k-means steps from the block `_start` (grp, model, cluster, columns) until the centres of a model stand still.

    `_steps` holds the centres of every step, `_last` those of each model's last one.
    """
    listed, each = _all("{c}", columns), [q(c) for c in columns]
    BLOCKS[f"{prefix}_points"] = f"SELECT {f'CAST({group} AS VARCHAR)' if group else chr(39) + 'all' + chr(39)} AS grp, customer_id, {listed} FROM {source}"
    MATERIALIZED.add(f"{prefix}_points")
    held = ", ".join(f"o{i} := c.{c}" for i, c in enumerate(each))
    moved = ", ".join(f"abs(avg({c}) - any_value(m.o{i}))" for i, c in enumerate(each))
    BLOCKS[f"{prefix}_steps"] = f"""
        SELECT CAST(0 AS BIGINT) AS step, grp, model, cluster, {listed}, 1.0::DOUBLE AS moved, 0.0::DOUBLE AS cost,
               CAST(0 AS BIGINT) AS n FROM {prefix}_start
        UNION ALL
        SELECT step, grp, model, cluster, {listed}, max(d) OVER (PARTITION BY grp, model) AS moved,
               sum(part) OVER (PARTITION BY grp, model) AS cost, n
        FROM (SELECT step + 1 AS step, grp, model, m.cluster AS cluster, {_all('avg({c}) AS {c}', columns)},
                     greatest({moved}) AS d, sum(near) AS part, count(*) AS n
              FROM (SELECT any_value(c.step) AS step, c.grp, c.model, {_all('any_value(s.{c}) AS {c}', columns)},
                           arg_min(struct_pack(cluster := c.cluster, {held}),
                                   struct_pack(d := {_distance('s', 'c', columns)}, c := c.cluster)) AS m,
                           min({_distance('s', 'c', columns)}) AS near
                    FROM {prefix}_steps c JOIN {prefix}_points s ON c.grp = s.grp
                    WHERE c.moved > 1e-9 AND c.step < 300 GROUP BY c.grp, c.model, s.customer_id)
              GROUP BY step, grp, model, m.cluster)"""
    BLOCKS[f"{prefix}_last"] = f"SELECT * FROM {prefix}_steps QUALIFY step = max(step) OVER (PARTITION BY grp, model)"


def _label_block(prefix: str, source: str, columns=SCALED, group: str | None = None) -> None:
    match = f"CAST(s.{group} AS VARCHAR) = CAST(c.{group} AS VARCHAR)" if group else "true"
    key = f"s.{group}, s.customer_id" if group else "s.customer_id"
    near = _distance('s', 'c', columns)
    BLOCKS[f"{prefix}_labels"] = f"""
        SELECT * EXCLUDE (rn) FROM (
            SELECT s.*, c.cluster, {near} AS squared_distance, row_number() OVER (PARTITION BY {key} ORDER BY {near}, c.cluster) AS rn
            FROM {source} s JOIN {prefix}_centers c ON {match}) WHERE rn = 1"""


def _lloyd_blocks(prefix: str, source: str, k: int = K, group: str | None = None) -> None:
    """Blocks of the fixed start, `_l0` by quantile cuts, and of where its steps end: `_centers` and `_labels`."""
    by = f"{group}, " if group else ""
    match = f"s.{group} = c.{group}" if group else "true"
    cuts = ", ".join(f"quantile_cont({START}, {i / k!r}) AS cut{i}" for i in range(1, k))
    BLOCKS[f"{prefix}_cuts"] = f"SELECT {by}{cuts} FROM {source}" + (f" GROUP BY {group}" if group else "")
    start = " + ".join(f"CASE WHEN s.{START} > c.cut{i} THEN 1 ELSE 0 END" for i in range(1, k))
    BLOCKS[f"{prefix}_l0"] = f"SELECT s.*, {start} AS cluster FROM {source} s JOIN {prefix}_cuts c ON {match}"
    BLOCKS[f"{prefix}_start"] = f"""
        SELECT {f'CAST({group} AS VARCHAR)' if group else "'all'"} AS grp, CAST(0 AS BIGINT) AS model, cluster, {_all('avg({c}) AS {c}')}
        FROM {prefix}_l0 GROUP BY ALL"""
    _step_blocks(prefix, source, SCALED, group)
    BLOCKS[f"{prefix}_centers"] = f"SELECT {f'grp AS {group}, ' if group else ''}cluster, {_all('{c}')} FROM {prefix}_last"
    MATERIALIZED.add(f"{prefix}_centers")
    _label_block(prefix, source, SCALED, group)


def _fit_blocks(prefix: str, source: str, columns=SCALED, k: int = K, group: str | None = None, restarts: int = 10) -> None:
    """Blocks of fits from hashed starts: the restart of lowest cost, clusters numbered by falling size."""
    digest = "md5(CAST(customer_id AS VARCHAR) || '-' || CAST(model AS VARCHAR) || '-' || CAST(cluster // 10 AS VARCHAR))"
    BLOCKS[f"{prefix}_start"] = f"""
        SELECT grp, model, cluster, {_all('arg_min({c}, place) AS {c}', columns)}
        FROM (SELECT *, substr(digest, 3 * (cluster % 10) + 1, 3) || digest AS place
              FROM (SELECT p.*, model, CAST(cluster AS INTEGER) AS cluster, {digest} AS digest
                    FROM {prefix}_points p, range(42, {42 + restarts}) m(model), range({k}) c(cluster)))
        GROUP BY grp, model, cluster"""
    _step_blocks(prefix, source, columns, group)
    BLOCKS[f"{prefix}_best"] = f"""
        SELECT grp, min(model) AS model, arg_min(cost, model) AS cost
        FROM (SELECT *, min(cost) OVER (PARTITION BY grp) AS lowest FROM {prefix}_last)
        WHERE cost <= lowest * (1 + 1e-9::DOUBLE) + 1e-12::DOUBLE GROUP BY grp"""
    BLOCKS[f"{prefix}_centers"] = f"""
        SELECT {f'l.grp AS {group}, ' if group else ''}{_all('{c}', columns)},
               CAST(row_number() OVER (PARTITION BY l.grp ORDER BY n DESC, {_all('{c}', columns)}) - 1 AS INTEGER) AS cluster
        FROM {prefix}_last l JOIN {prefix}_best b ON l.grp = b.grp AND l.model = b.model"""
    MATERIALIZED.update({f"{prefix}_centers", f"{prefix}_last"})
    _label_block(prefix, source, columns, group)


_lloyd_blocks("base", "scaled")
BLOCKS["centers"] = "SELECT * FROM base_centers"
BLOCKS["labelled"] = "SELECT * FROM base_labels"
for _k in range(2, 7):
    _lloyd_blocks(f"try{_k}", "scaled", _k)
_fit_blocks("full", "scaled")

BLOCKS["cluster_moments"] = f"""
    SELECT cluster, count(*) AS size, {_all('var_pop({c})', sep=' + ')} AS spread, {_all('avg({c}) AS {c}')}
    FROM labelled GROUP BY cluster"""
BLOCKS["cluster_counts"] = "SELECT cluster, count(*) AS size FROM labelled GROUP BY cluster"

BLOCKS["strata"] = """
    SELECT customer_id, l.cluster, wanted, total,
           row_number() OVER (PARTITION BY l.cluster ORDER BY md5(CAST(customer_id AS VARCHAR)), customer_id) AS rank
    FROM labelled l JOIN (SELECT cluster, (1000 * size) // total AS wanted, total FROM cluster_counts,
                          (SELECT CAST(sum(size) AS BIGINT) AS total FROM cluster_counts)) w ON l.cluster = w.cluster"""


def _silhouette_squared() -> str:
    return f"""
        SELECT customer_id, cluster, {r4('s')} AS silhouette FROM (
            SELECT customer_id, cluster, CASE WHEN a IS NULL OR greatest(a, b) <= 0 THEN 0.0
                                              ELSE (b - a) / greatest(a, b) END AS s FROM (
                SELECT customer_id, own AS cluster,
                       max(CASE WHEN own = other AND size > 1 THEN d * size / (size - 1) END) AS a,
                       min(CASE WHEN own <> other THEN d END) AS b
                FROM (SELECT l.customer_id, l.cluster AS own, m.cluster AS other, m.size,
                             {_distance('l', 'm')} + m.spread AS d FROM labelled l, cluster_moments m)
                GROUP BY customer_id, own))"""


BLOCKS["stratified"] = """
    SELECT customer_id, cluster FROM strata WHERE rank <= wanted OR total <= 1000
    UNION ALL SELECT customer_id, cluster FROM (
        SELECT customer_id, cluster FROM strata WHERE rank > wanted AND total > 1000
        ORDER BY md5(CAST(customer_id AS VARCHAR)), customer_id
        LIMIT (SELECT greatest(0, 1000 - CAST(sum(w) AS BIGINT)) FROM (SELECT any_value(wanted) AS w FROM strata GROUP BY cluster)))"""
BLOCKS["reference"] = "SELECT l.* FROM labelled l WHERE customer_id IN (SELECT customer_id FROM stratified)"


def _silhouette_euclidean() -> str:
    """Every row against the reference rows, itself left out."""
    return f"""
        SELECT customer_id, cluster, {r4('s')} AS silhouette FROM (
            SELECT customer_id, cluster, CASE WHEN a IS NULL OR greatest(a, b) <= 0 THEN 0.0
                                              ELSE (b - a) / greatest(a, b) END AS s FROM (
                SELECT customer_id, own AS cluster, max(CASE WHEN own = other THEN d END) AS a,
                       min(CASE WHEN own <> other THEN d END) AS b
                FROM (SELECT x.customer_id, x.cluster AS own, y.cluster AS other, avg(sqrt({_distance('x', 'y')})) AS d
                      FROM labelled x JOIN reference y ON x.customer_id <> y.customer_id GROUP BY x.customer_id, x.cluster, y.cluster)
                GROUP BY customer_id, own))"""


BLOCKS["shuffle_keys"] = """
    SELECT s.*, CAST(r AS INTEGER) AS repeat, md5(CAST(customer_id AS VARCHAR) || '-' || CAST(r AS VARCHAR)) AS place,
           CAST(('0x' || substr(md5(CAST(customer_id AS VARCHAR) || '-b' || CAST(r AS VARCHAR)), 1, 8)) AS UBIGINT)
               % (SELECT CAST(greatest(1, ceil(count(*) / 2000.0)) AS UBIGINT) FROM scaled) AS bucket
    FROM scaled s, range(3) t(r)"""
_FOLLOWING = ("coalesce(lead({c}) OVER w, first_value({c}) OVER "
              "(PARTITION BY repeat, bucket ORDER BY place, customer_id))")
BLOCKS["shuffled"] = _union(
    f"""SELECT repeat, {i} AS feature_position, customer_id, {', '.join(
        (_FOLLOWING.format(c=q(c)) if i == j else q(c)) + f' AS {q(c)}' for j, c in enumerate(SCALED))}
        FROM shuffle_keys WINDOW w AS (PARTITION BY repeat, bucket ORDER BY place, customer_id)"""
    for i in range(len(SCALED)))


def _importance_blocks(prefix: str, labels: str, centers: str) -> None:
    """Blocks of the mean silhouette under given centres, before (`_scored`) and after (`_scores`) the shuffles."""
    BLOCKS[f"{prefix}_moments"] = f"""
        SELECT cluster, count(*) AS size, {_all('var_pop({c})', sep=' + ')} AS spread, {_all('avg({c}) AS {c}')}
        FROM {labels} GROUP BY cluster"""
    BLOCKS[f"{prefix}_scored"] = _mean_silhouette(labels, f"{prefix}_moments", "")
    BLOCKS[f"{prefix}_shuffled"] = f"""
        SELECT * EXCLUDE (rn) FROM (
            SELECT s.*, c.cluster, row_number() OVER (PARTITION BY repeat, feature_position, customer_id
                                                     ORDER BY {_distance('s', 'c')}, c.cluster) AS rn
            FROM shuffled s, {centers} c) WHERE rn = 1"""
    BLOCKS[f"{prefix}_again"] = f"""
        SELECT repeat, feature_position, cluster, count(*) AS size, {_all('var_pop({c})', sep=' + ')} AS spread,
               {_all('avg({c}) AS {c}')} FROM {prefix}_shuffled GROUP BY ALL"""
    BLOCKS[f"{prefix}_scores"] = _mean_silhouette(f"{prefix}_shuffled", f"{prefix}_again", "repeat, feature_position")


def _mean_silhouette(labels: str, moments: str, keys: str, columns=SCALED) -> str:
    """Mean silhouette, squared distances, per key of labelled rows with their clusters' moments."""
    by = f"{keys}, " if keys else ""
    own = "".join(f"l.{k.strip()}, " for k in keys.split(",") if k.strip())
    match = " AND ".join(f"l.{k.strip()} = m.{k.strip()}" for k in keys.split(",") if k.strip()) or "true"
    return f"""
        SELECT {by}avg(CASE WHEN a IS NULL OR greatest(a, b) <= 0 THEN 0.0 ELSE (b - a) / greatest(a, b) END) AS silhouette FROM (
            SELECT {by}customer_id, max(CASE WHEN own = other AND size > 1 THEN d * size / (size - 1) END) AS a,
                   min(CASE WHEN own <> other THEN d END) AS b
            FROM (SELECT {own}l.customer_id, l.cluster AS own, m.cluster AS other, m.size,
                         {_distance('l', 'm', columns)} + m.spread AS d FROM {labels} l JOIN {moments} m ON {match})
            GROUP BY {by}customer_id)""" + (f" GROUP BY {keys}" if keys else "")


_importance_blocks("fixed", "labelled", "centers")
_importance_blocks("fitted", "full_labels", "full_centers")


def _importance(prefix: str) -> str:
    return f"""
        SELECT ([{', '.join(f"'{c}'" for c in SCALED)}])[feature_position + 1] AS feature,
               {r4('avg(b.silhouette - s.silhouette)')} AS importance, {r4('stddev_pop(b.silhouette - s.silhouette)')} AS std
        FROM {prefix}_scores s, {prefix}_scored b GROUP BY feature_position"""


# --- components: cyclic rotations of the covariance matrix until it is diagonal --------------------

PCS = tuple(f"pc{j + 1}" for j in range(len(SCALED)))
_PAIRS = [(i, j) for i in range(len(SCALED)) for j in range(i + 1, len(SCALED))]
_ROTATIONS = 10 * len(_PAIRS)

BLOCKS["covariances"] = "SELECT " + ", ".join(
    f"covar_samp({q(a)}, {q(b)}) AS v{i}_{j}" for i, a in enumerate(SCALED) for j, b in enumerate(SCALED)) + " FROM scaled"
BLOCKS["matrix"] = _union(
    f"SELECT {i} AS i, {j} AS j, v{i}_{j} AS v FROM covariances" for i in range(len(SCALED)) for j in range(len(SCALED)))
MATERIALIZED.update({"matrix", "component_scores"})
BLOCKS["rotations"] = f"""
    SELECT 0 AS step, 'A' AS kind, i, j, v FROM matrix
    UNION ALL SELECT 0, 'V', i, j, CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END FROM matrix
    UNION ALL
    SELECT step + 1, kind, i, j, CASE WHEN kind = 'A' AND i = p THEN cs * w - sn * wq WHEN kind = 'A' AND i = q THEN sn * wp + cs * w ELSE w END
    FROM (SELECT *, max(CASE WHEN i = p THEN w END) OVER (PARTITION BY kind, j) AS wp,
                 max(CASE WHEN i = q THEN w END) OVER (PARTITION BY kind, j) AS wq
          FROM (SELECT *, CASE WHEN j = p THEN cs * v - sn * vq WHEN j = q THEN sn * vp + cs * v ELSE v END AS w
                FROM (SELECT *, 1 / sqrt(t * t + 1) AS cs, t / sqrt(t * t + 1) AS sn,
                             max(CASE WHEN j = p THEN v END) OVER (PARTITION BY kind, i) AS vp,
                             max(CASE WHEN j = q THEN v END) OVER (PARTITION BY kind, i) AS vq
                      FROM (SELECT *, CASE WHEN abs(pq) < 1e-30 THEN 0.0
                                           ELSE (CASE WHEN qq >= pp THEN 1 ELSE -1 END) * sign(pq) * 1.0
                                                / (abs((qq - pp) / (2 * pq)) + sqrt(pow((qq - pp) / (2 * pq), 2) + 1)) END AS t
                            FROM (SELECT *, max(CASE WHEN kind = 'A' AND i = p AND j = p THEN v END) OVER () AS pp,
                                         max(CASE WHEN kind = 'A' AND i = q AND j = q THEN v END) OVER () AS qq,
                                         max(CASE WHEN kind = 'A' AND i = p AND j = q THEN v END) OVER () AS pq
                                  FROM (SELECT *, ([{', '.join(str(a) for a, _ in _PAIRS)}])[step % {len(_PAIRS)} + 1] AS p,
                                               ([{', '.join(str(b) for _, b in _PAIRS)}])[step % {len(_PAIRS)} + 1] AS q
                                        FROM rotations WHERE step < {_ROTATIONS}))))))"""
BLOCKS["eigenvalues"] = f"""
    SELECT i AS at, v AS value, row_number() OVER (ORDER BY v DESC) AS component
    FROM rotations WHERE step = {_ROTATIONS} AND kind = 'A' AND i = j"""
BLOCKS["loadings"] = f"""
    SELECT i, component, v * CASE WHEN arg_max(v, struct_pack(size := round(abs(v), 9), first := -i))
                                       OVER (PARTITION BY component) < 0 THEN -1 ELSE 1 END AS v
    FROM rotations r JOIN eigenvalues e ON r.j = e.at WHERE step = {_ROTATIONS} AND kind = 'V'"""
MATERIALIZED.update({"eigenvalues", "loadings", "wide_loadings"})
BLOCKS["wide_loadings"] = "SELECT i, " + ", ".join(
    f"max(CASE WHEN component = {j + 1} THEN v END) AS pc{j + 1}" for j in range(len(SCALED))) + " FROM loadings GROUP BY i"
BLOCKS["flat_loadings"] = "SELECT " + ", ".join(
    f"max(CASE WHEN i = {i} THEN {pc} END) AS {pc}_{i}" for i in range(len(SCALED)) for pc in PCS) + " FROM wide_loadings"
BLOCKS["scaled_means"] = "SELECT " + ", ".join(f"avg({q(c)}) AS m{i}" for i, c in enumerate(SCALED)) + " FROM scaled"
BLOCKS["component_scores"] = "SELECT customer_id, " + ", ".join(
    " + ".join(f"({q(c)} - m{i}) * {pc}_{i}" for i, c in enumerate(SCALED)) + f" AS {pc}" for pc in PCS
) + " FROM scaled, scaled_means, flat_loadings"
_FEATURE = f"([{', '.join(f"'{c}'" for c in SCALED)}])[i + 1] AS feature"
_fit_blocks("drawn", "component_scores", PCS[:3])
for _k in range(2, 11):
    _fit_blocks(f"elbow{_k}", "component_scores", PCS, _k)
    BLOCKS[f"elbow{_k}_moments"] = f"""
        SELECT cluster, count(*) AS size, {_all('var_pop({c})', PCS, ' + ')} AS spread, {_all('avg({c}) AS {c}', PCS)}
        FROM elbow{_k}_labels GROUP BY cluster"""
    BLOCKS[f"elbow{_k}_score"] = _mean_silhouette(f"elbow{_k}_labels", f"elbow{_k}_moments", "", PCS)


def component_queries() -> dict[str, str]:
    wide = ", ".join(f"{r4(pc)} AS {pc}" for pc in PCS)
    top = ", ".join(f"abs({pc}) AS {pc}" for pc in PCS[:4])
    return {
        "pca_projection": f"SELECT customer_id, {wide} FROM component_scores",
        "pca_explained_variance": f"""
            SELECT CAST(component AS INTEGER) AS component, {r4('value / total')} AS explained_variance, {r4('upto / total')} AS cumulative_variance
            FROM (SELECT component, value, sum(value) OVER () AS total, sum(value) OVER (ORDER BY component) AS upto FROM eigenvalues)""",
        "pca_top_loadings": f"""
            SELECT feature, {r4('pc1')} AS pc1, {r4('pc2')} AS pc2, {r4('magnitude')} AS magnitude
            FROM (SELECT {_FEATURE}, pc1, pc2, sqrt(pc1 * pc1 + pc2 * pc2) AS magnitude FROM wide_loadings
                  ORDER BY magnitude DESC, feature LIMIT 5)""",
        "pca_feature_importance": f"""
            SELECT feature, {', '.join(f'{r4(pc)} AS {pc}' for pc in PCS[:4])}, {r4(' + '.join(PCS[:4]))} AS total_loading
            FROM (SELECT {_FEATURE}, {top} FROM wide_loadings)""",
        "kmeans_fit": f"SELECT customer_id, cluster, {r4('squared_distance')} AS squared_distance FROM drawn_labels",
        "elbow_table": _union(f"""SELECT {k} AS k, {r4('cost')} AS inertia, {r4('silhouette')} AS silhouette
                                  FROM elbow{k}_best, elbow{k}_score""" for k in range(2, 11)),
        "kmeans_feature_importance": _importance("fitted"),
        "cluster_projection": f"""
            SELECT c.customer_id, {', '.join(f'{r4(pc)} AS {pc}' for pc in PCS[:3])}, cluster, 'Cluster ' || CAST(cluster AS VARCHAR) AS name
            FROM component_scores c JOIN full_labels l ON c.customer_id = l.customer_id""",
    }


BLOCKS["row_scores"] = _silhouette_squared().replace(r4('s'), 's').replace("AS silhouette", "AS s", 1)


def cluster_queries() -> dict[str, str]:
    covariance = _union(
        f"""SELECT '{a}' AS feature_x, '{b}' AS feature_y, covar_samp({q(a)}, {q(b)}) AS v FROM scaled"""
        for a in SCALED for b in SCALED)
    return {
        "covariance_matrix": f"SELECT feature_x, feature_y, {r4('v')} AS covariance FROM ({covariance})",
        "assign_to_centroids": f"SELECT customer_id, cluster, {r4('squared_distance')} AS squared_distance FROM labelled",
        "kmeans_lloyd_fixed": f"SELECT cluster, {_rounded(SCALED)} FROM centers",
        "inertia_by_k": _union(f"SELECT {k} AS k, {r4('sum(squared_distance)')} AS inertia FROM try{k}_labels"
                               for k in range(2, 7)),
        "silhouette_samples": _silhouette_squared(),
        "silhouette_euclidean_sample": _silhouette_euclidean(),
        "stratified_sample": "SELECT customer_id, cluster FROM stratified",
        "silhouette_report": f"""
            SELECT cluster, count(*) AS size, {r4('count(*) * 100.0 / (SELECT count(*) FROM labelled)')} AS percentage,
                   {r4('avg(s)')} AS mean_silhouette, {r4('min(s)')} AS least_silhouette
            FROM row_scores GROUP BY ROLLUP (cluster)""",
        "silhouette_order": _silhouette_squared(),
        "importance_fixed_centers": _importance("fixed"),
        "intercluster_distances": f"""
            SELECT cluster_a, cluster_b, {r4('d')} AS distance, {r4('d / max(d) OVER ()')} AS normalized_distance,
                   {r4('size_a / largest')} AS relative_size_a, {r4('size_b / largest')} AS relative_size_b
            FROM (SELECT a.cluster AS cluster_a, b.cluster AS cluster_b, sqrt({_distance('a', 'b')}) AS d,
                         m.size AS size_a, n.size AS size_b, (SELECT max(size) FROM cluster_counts) AS largest
                  FROM centers a JOIN centers b ON a.cluster < b.cluster
                  JOIN cluster_counts m ON m.cluster = a.cluster JOIN cluster_counts n ON n.cluster = b.cluster)""",
    }


# --- stability -----------------------------------------------------------------------------------


def _ari(cells: str, keys: str) -> str:
    """Adjusted Rand index per key from a relation of (keys, a, b, n)."""
    by = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    using = f"USING ({keys})" if keys else "ON true"
    return f"""
        SELECT {by}n_common, CASE WHEN n_common < 2 OR most = expected THEN 1.0
                                  ELSE (together - expected) / (most - expected) END AS ari
        FROM (SELECT {by}n_common, together, (in_a + in_b) / 2 AS most,
                     in_a * in_b / (n_common * (n_common - 1.0::DOUBLE) / 2) AS expected
              FROM (SELECT {by}CAST(sum(n) AS BIGINT) AS n_common, sum(n * (n - 1.0::DOUBLE) / 2) AS together
                    FROM ({cells}) {group})
              JOIN (SELECT {by}sum(m * (m - 1.0::DOUBLE) / 2) AS in_a
                    FROM (SELECT {by}a, sum(n) AS m FROM ({cells}) GROUP BY {by}a) {group}) {using}
              JOIN (SELECT {by}sum(m * (m - 1.0::DOUBLE) / 2) AS in_b
                    FROM (SELECT {by}b, sum(n) AS m FROM ({cells}) GROUP BY {by}b) {group}) {using})"""


BLOCKS["sample_members"] = """
    SELECT iteration, customer_id FROM (
      SELECT CAST(i AS INTEGER) AS iteration, customer_id,
             row_number() OVER (PARTITION BY i ORDER BY md5(CAST(customer_id AS VARCHAR) || '-' || CAST(i AS VARCHAR)),
                                customer_id) AS place,
             count(*) OVER (PARTITION BY i) AS n
      FROM scaled, range(20) r(i) WHERE customer_id IS NOT NULL)
    WHERE place <= floor(0.8 * n)"""
BLOCKS["sample_rows"] = "SELECT m.iteration, s.* FROM sample_members m JOIN scaled s ON m.customer_id = s.customer_id"
MATERIALIZED.add("sample_rows")
_lloyd_blocks("boot", "sample_rows", group="iteration")
_fit_blocks("sampled", "sample_rows", group="iteration")
BLOCKS["sample_cells"] = """
    SELECT x.iteration AS i, y.iteration AS j, x.cluster AS a, y.cluster AS b, count(*) AS n
    FROM boot_labels x JOIN boot_labels y ON x.customer_id = y.customer_id AND x.iteration < y.iteration GROUP BY ALL"""

BLOCKS["fitted_sample_cells"] = BLOCKS["sample_cells"].replace("boot_labels", "sampled_labels")

BLOCKS["last_dates"] = """
    SELECT h.customer_id, max(o.order_purchase_timestamp) AS moment
    FROM hybrid h LEFT JOIN orders_v o ON h.customer_id = o.customer_id GROUP BY 1"""
_QUARTER = "strftime({c}, '%Y') || 'Q' || CAST(quarter({c}) AS VARCHAR)"
BLOCKS["quarter_members"] = f"SELECT DISTINCT {_QUARTER.format(c='moment')} AS period, customer_id FROM last_dates"
BLOCKS["year_members"] = """
    SELECT DISTINCT strftime(order_purchase_timestamp, '%Y') AS period, customer_id FROM orders_v"""


def _period_blocks(name: str, members: str, least: int) -> None:
    BLOCKS[f"{name}_sizes"] = f"SELECT period, count(*) AS n_customers FROM {members} GROUP BY 1"
    BLOCKS[f"{name}_rows"] = f"""
        SELECT m.period, s.* FROM {members} m JOIN scaled s ON m.customer_id = s.customer_id
        WHERE m.period IN (SELECT period FROM {name}_sizes WHERE n_customers >= {least})
          AND m.period IN (SELECT m2.period FROM {members} m2 JOIN scaled s2 ON m2.customer_id = s2.customer_id
                           GROUP BY 1 HAVING count(*) >= {least})"""
    MATERIALIZED.add(f"{name}_rows")
    _lloyd_blocks(name, f"{name}_rows", group="period")
    _fit_blocks(f"{name}_fit", f"{name}_rows", group="period")


_period_blocks("quarterly", "quarter_members", 10)
_period_blocks("yearly", "year_members", 20)

BLOCKS["yearly_cells"] = """
    SELECT x.period AS from_period, y.period AS to_period, x.cluster AS a, y.cluster AS b, count(*) AS n
    FROM (SELECT *, dense_rank() OVER (ORDER BY period) AS position FROM yearly_labels) x
    JOIN (SELECT *, dense_rank() OVER (ORDER BY period) AS position FROM yearly_labels) y
      ON x.customer_id = y.customer_id AND x.position + 1 = y.position GROUP BY ALL"""

BLOCKS["yearly_fit_cells"] = BLOCKS["yearly_cells"].replace("yearly_labels", "yearly_fit_labels")
BLOCKS["eval_rows"] = """
    SELECT r.* EXCLUDE (period) FROM quarterly_rows r
    WHERE period = (SELECT period FROM quarterly_sizes WHERE period IN (SELECT period FROM quarterly_rows)
                    ORDER BY n_customers DESC, period LIMIT 1)"""
BLOCKS["eval_labels"] = f"""
    SELECT customer_id, period, cluster FROM (
        SELECT s.customer_id, c.period, c.cluster,
               row_number() OVER (PARTITION BY s.customer_id, c.period ORDER BY {_distance('s', 'c')}, c.cluster) AS rn
        FROM eval_rows s, quarterly_centers c) WHERE rn = 1"""
BLOCKS["eval_fit_labels"] = BLOCKS["eval_labels"].replace("quarterly_centers", "quarterly_fit_centers")
BLOCKS["eval_cells"] = """
    SELECT x.period AS period_a, y.period AS period_b, x.cluster AS a, y.cluster AS b, count(*) AS n
    FROM eval_labels x JOIN eval_labels y ON x.customer_id = y.customer_id AND x.period < y.period GROUP BY ALL"""

BLOCKS["eval_fit_cells"] = BLOCKS["eval_cells"].replace("eval_labels", "eval_fit_labels")


def _fitted_scores() -> dict[str, str]:
    """Agreement under fitted models, and its mean and deviation."""
    scores = {
        "bootstrap_stability": f"SELECT i, j, n_common, ari FROM ({_ari('SELECT * FROM fitted_sample_cells', 'i, j')}) WHERE n_common >= 10",
        "temporal_stability": f"""SELECT from_period, to_period, n_common, ari
                                  FROM ({_ari('SELECT * FROM yearly_fit_cells', 'from_period, to_period')}) WHERE n_common >= 20""",
        "cross_period_stability": f"""SELECT period_a, period_b, n_common, ari
                                      FROM ({_ari('SELECT * FROM eval_fit_cells', 'period_a, period_b')})""",
    }
    out = {}
    for name, text in scores.items():
        out[name] = f"SELECT * REPLACE ({r4('ari')} AS ari) FROM ({text})"
        out[f"{name}_summary"] = f"""
            SELECT count(ari) AS n_pairs, {r4('avg(ari)')} AS mean_ari, {r4('stddev_pop(ari)')} AS std_ari FROM ({text})"""
    return out


def stability_queries() -> dict[str, str]:
    return _fitted_scores() | {
        "bootstrap_samples": "SELECT iteration, customer_id FROM sample_members",
        "adjusted_rand_index": f"""
            SELECT n_common, {r4('ari')} AS ari FROM ({_ari(
                "SELECT x.cluster AS a, y.cluster AS b, count(*) AS n FROM base_l0 x JOIN labelled y "
                "ON x.customer_id = y.customer_id GROUP BY ALL", "")})""",
        "pairwise_ari": f"""
            SELECT i, j, n_common, {r4('ari')} AS ari FROM ({_ari('SELECT * FROM sample_cells', 'i, j')})
            WHERE n_common >= 10""",
        "period_buckets": f"""
            SELECT order_id, strftime(t, '%Y-%m') AS month, CAST(date_trunc('month', t) AS DATE) AS month_start,
                   {_QUARTER.format(c='t')} AS quarter, CAST(date_trunc('quarter', t) AS DATE) AS quarter_start,
                   strftime(t, '%Y') AS year, CAST(date_trunc('year', t) AS DATE) AS year_start
            FROM (SELECT order_id, order_purchase_timestamp AS t FROM orders_v)""",
        "period_customer_counts": """
            SELECT period, n_customers, n_customers >= 20 AS is_clustered FROM quarterly_sizes""",
        "temporal_ari": f"""
            SELECT from_period, to_period, n_common, {r4('ari')} AS ari
            FROM ({_ari('SELECT * FROM yearly_cells', 'from_period, to_period')}) WHERE n_common >= 20""",
        "cluster_migration": f"""
            SELECT from_period, to_period, CAST(f AS INTEGER) AS from_cluster, CAST(t AS INTEGER) AS to_cluster,
                   coalesce(n, 0) AS n_customers, coalesce({r4('n * 100.0::DOUBLE / from_total')}, 0.0) AS percentage
            FROM (SELECT g.*, c.n, sum(c.n) OVER (PARTITION BY g.from_period, g.to_period, g.f) AS from_total FROM (
                    SELECT from_period, to_period, f, t
                    FROM (SELECT from_period, to_period FROM yearly_cells GROUP BY 1, 2 HAVING sum(n) >= 10),
                         range({K}) x(f), range({K}) y(t)) g
                  LEFT JOIN yearly_cells c ON g.from_period = c.from_period AND g.to_period = c.to_period
                                          AND g.f = c.a AND g.t = c.b)""",
        "cross_period_ari": f"""
            SELECT period_a, period_b, n_common, {r4('ari')} AS ari
            FROM ({_ari('SELECT * FROM eval_cells', 'period_a, period_b')})""",
    }


# --- segments ------------------------------------------------------------------------------------

BLOCKS["cluster_means"] = f"""
    SELECT cluster, count(*) AS size, {_all('avg({c}) AS {c}')} FROM labelled GROUP BY cluster"""


def _original(columns_of: str, prefix: str = "") -> str:
    return ", ".join(
        [f"round_even(exp({columns_of}.{c} * iqr_{c} + mid_{c}) - 1, 0) AS {prefix}{c}" for c in COUNTS]
        + [f"{columns_of}.{c} * iqr_{c} + mid_{c} AS {prefix}{c}" for c in CONTINUOUS])


BLOCKS["overall_means"] = f"SELECT {_all('avg({c}) AS {c}', (*COUNTS, *CONTINUOUS))} FROM cluster_means"
BLOCKS["profiles"] = f"""
    SELECT m.cluster, m.size, m.size / sum(m.size) OVER () AS share, {_original('m')}, {_original('o', 'all_')}
    FROM cluster_means m, overall_means o, base_spread"""


def _text(template: str, value: str) -> str:
    """Number as text, an exact half rounded up."""
    digits = template.split(".")[1][0]
    return f"printf('{template}', round({value}, {digits}))"


def segment_queries() -> dict[str, str]:
    from shoplens.plans.registry import ACTION_LIMITS as limit
    from shoplens.plans.registry import SEGMENT_CONFIG as config

    recency, frequency, satisfaction = config["recency"], config["frequency"], config["satisfaction"]
    rfm_name = f"""
        CASE WHEN recency_days < {recency['active']} THEN 'Active' WHEN recency_days < {recency['recent']} THEN 'Recent'
             ELSE 'Inactive' END || ' ' ||
        CASE WHEN frequency > {frequency['frequent']} THEN 'Frequent'
             WHEN frequency > {frequency['returning']} THEN 'Returning' ELSE 'One-time' END || ' ' ||
        CASE WHEN monetary > all_monetary THEN 'High-value' ELSE 'Standard-value' END"""
    mood = f"""
        CASE WHEN avg_review_score >= {satisfaction['very_satisfied']} THEN 'Very Satisfied'
             WHEN avg_review_score >= {satisfaction['satisfied']} THEN 'Satisfied'
             WHEN avg_review_score >= {satisfaction['neutral']} THEN 'Neutral' ELSE 'Unsatisfied' END"""
    share = _text("%.1f%%", "share * 100")
    insights = f"""
        list_filter([
            CASE WHEN recency_days < {recency['active']} THEN 'Recently active customers - ideal for upselling opportunities.'
                 WHEN recency_days > {recency['recent']} THEN 'Inactive customers - consider reactivation campaigns.' END,
            CASE WHEN frequency > all_frequency AND monetary > all_monetary
                     THEN 'High-value loyal customers - prioritize retention strategies.'
                 WHEN frequency < all_frequency AND monetary > all_monetary
                     THEN 'Big spenders but infrequent - opportunity to increase purchase frequency.'
                 WHEN frequency > all_frequency AND monetary < all_monetary
                     THEN 'Frequent small purchases - potential for basket size expansion.' END,
            CASE WHEN avg_review_score < {satisfaction['neutral']}
                     THEN 'Below average satisfaction - investigate service/product issues.'
                 WHEN avg_review_score >= {satisfaction['very_satisfied']}
                     THEN 'Highly satisfied customers - potential brand advocates.' END], lambda x: x IS NOT NULL)"""
    generic = f"'Cluster ' || CAST(cluster AS VARCHAR) || ' represents ' || {share} || ' of customers.'"
    insight_list = f"CASE WHEN len({insights}) > 0 THEN {insights} ELSE [{generic}] END"
    order_value = "monetary / greatest(1.0, frequency)"
    shown = {"average_delivery_time": ("%.1f days", "avg_delivery_time"), "average_order_value": ("$%.2f", order_value),
             "days_since_last_purchase": ("%.0f", "recency_days"), "number_of_orders": ("%.1f", "frequency"),
             "satisfaction_score": ("%.1f/5.0", "avg_review_score"), "total_customer_value": ("$%.2f", "monetary")}
    actions = [
        (f"recency_days < {limit['recent_days']} AND monetary > {limit['high_value']}",
         ("Upsell premium products/services", "Offer loyalty rewards")),
        (f"recency_days > {limit['inactive_days']} AND monetary > {limit['high_value']}",
         ("Reactivation campaign with premium offer", "Personal outreach to understand churn reasons")),
        (f"frequency > {limit['frequent_orders']}",
         ("Cross-sell complementary products", "Subscription or bundle offers")),
        (f"monetary < {limit['low_value']}",
         ("Product education to show value", "Limited-time discounts on premium alternatives")),
        (f"avg_review_score < {limit['low_score']}",
         ("Service recovery outreach", "Gather feedback on improvement areas")),
        (f"avg_review_score > {limit['high_score']}",
         ("Request referrals and testimonials", "Early access to new products/features")),
        ("true", ("Monitor segment performance monthly",)),
    ]
    action_list = ", ".join(f"CASE WHEN {test} THEN '• {text}' END" for test, texts in actions for text in texts)
    traits = f"""
        list_filter([
            CASE WHEN round(recency_days, 0) < {limit['recent_days']} THEN 'Recently active'
                 WHEN round(recency_days, 0) > {limit['inactive_days']} THEN 'Inactive' END,
            CASE WHEN round({order_value}, 2) > {limit['high_value']} THEN 'High spender' END,
            CASE WHEN round(frequency, 1) > {limit['frequent_orders']} THEN 'Frequent buyer' END,
            CASE WHEN round(avg_review_score, 1) > {limit['high_score']} THEN 'Very satisfied'
                 WHEN round(avg_review_score, 1) < {limit['low_score']} THEN 'Unsatisfied' END], lambda x: x IS NOT NULL)[1:3]"""
    box = f"""
        SELECT cluster, feature, n, {r4('q1')} AS q1, {r4('q2')} AS median, {r4('q3')} AS q3,
               {r4('greatest(lo, q1 - 1.5 * (q3 - q1))')} AS whisker_low,
               {r4('least(hi, q3 + 1.5 * (q3 - q1))')} AS whisker_high, {r4('m')} AS mean
        FROM (SELECT cluster, feature, count(*) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2,
                     quantile_cont(value, 0.75) AS q3, min(value) AS lo, max(value) AS hi, avg(value) AS m
              FROM (SELECT cluster, '{FLAG}_1.0' AS feature, "{FLAG}_1.0" AS value FROM labelled UNION ALL
                    {_union(f"""SELECT l.cluster, '{c}' AS feature, CAST(h.{c} AS DOUBLE) AS value
                                FROM labelled l JOIN hybrid h ON l.customer_id = h.customer_id WHERE h.{c} IS NOT NULL"""
                            for c in (*COUNTS, *CONTINUOUS))}) GROUP BY cluster, feature)"""
    variance = f"""
        SELECT feature, v FROM ({_union(f"SELECT '{c}' AS feature, var_samp({q(c)}) AS v FROM scaled" for c in SCALED)})
        ORDER BY v DESC, feature LIMIT 6"""
    labelled_long = _long("labelled", SCALED, "cluster,")
    return {
        "cluster_stats": f"""
            SELECT cluster, feature, {r4('avg(value)')} AS mean, {r4('median(value)')} AS median,
                   {r4('min(value)')} AS min, {r4('max(value)')} AS max, {r4('stddev_samp(value)')} AS std
            FROM ({labelled_long}) GROUP BY cluster, feature""",
        "cluster_categorical_mode": f"""
            SELECT cluster, 'c_mktsegment' AS feature, c_mktsegment AS mode, {r4('n / size')} AS frequency FROM (
                SELECT cluster, c_mktsegment, count(*) AS n, sum(count(*)) OVER (PARTITION BY cluster) AS size,
                       row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, c_mktsegment) AS rn
                FROM labelled JOIN customer ON customer_id = c_custkey GROUP BY cluster, c_mktsegment) WHERE rn = 1""",
        "cluster_sizes": f"""
            SELECT cluster, size, {r4('size * 100 / sum(size) OVER ()')} AS percentage FROM cluster_counts""",
        "segment_names": f"SELECT cluster, {rfm_name} AS name, {rfm_name} || ' ' || {mood} AS full_name FROM profiles",
        "cluster_profiles": f"""
            SELECT cluster, {rfm_name} AS name, size, {r4('share * 100')} AS percentage,
                   {', '.join(f'{r4(value)} AS {name}' for name, (_, value) in shown.items())} FROM profiles""",
        "cluster_insights": f"""
            SELECT cluster, CAST(generate_subscripts(insights, 1) AS INTEGER) AS position, unnest(insights) AS insight
            FROM (SELECT cluster, {insight_list} AS insights FROM profiles)""",
        "cluster_metrics_table": f"""
            SELECT 'Cluster ' || CAST(cluster AS VARCHAR) AS cluster, {rfm_name} AS name, size, {share} AS percentage,
                   {', '.join(f"coalesce({_text(t, v)}, '-') AS {name}" for name, (t, v) in shown.items())},
                   ({insight_list})[1] AS key_insight FROM profiles""",
        "cluster_radar": f"""
            SELECT cluster, feature, {r4('(v - low) / nullif(high - low, 0)')} AS value FROM (
                SELECT cluster, feature, v, min(v) OVER (PARTITION BY feature) AS low,
                       max(v) OVER (PARTITION BY feature) AS high
                FROM (SELECT cluster, feature, avg(value) AS v FROM ({labelled_long}) GROUP BY cluster, feature))
            WHERE feature IN (SELECT feature FROM ({variance}))""",
        "top_variance_features": f"SELECT feature, {r4('v')} AS variance FROM ({variance})",
        "cluster_feature_box_stats": box,
        "segment_actions": f"""
            SELECT cluster, {rfm_name} AS name, array_to_string(
                list_filter([{action_list}], lambda x: x IS NOT NULL)[1:3], chr(10)) AS recommended_actions FROM profiles""",
        "segment_characteristics": f"""
            SELECT cluster, {rfm_name} AS name, CASE WHEN len({traits}) > 0 THEN array_to_string({traits}, ', ')
                   ELSE {share} || ' of customer base' END AS key_characteristics FROM profiles""",
    }


def fitted_queries() -> dict[str, str]:
    """The segment tables on the labels of the fitted model, complete texts."""
    texts = segment_queries()
    rows = texts["cluster_sizes"]
    chosen = {
        "fitted_cluster_stats": texts["cluster_stats"],
        "fitted_segment_profiles": texts["cluster_profiles"],
        "fitted_segment_actions": texts["segment_actions"],
        "dashboard_cluster_sizes": f"""
            SELECT s.cluster, 'Cluster ' || CAST(s.cluster AS VARCHAR) || ': ' || n.name AS label, size, percentage
            FROM ({rows}) s JOIN ({texts['segment_names']}) n ON s.cluster = n.cluster""",
        "dashboard_feature_comparison": texts["cluster_radar"],
        "dashboard_metrics_table": texts["cluster_metrics_table"],
        "dashboard_feature_distributions": f"""
            SELECT * FROM ({texts['cluster_feature_box_stats']})
            WHERE feature IN (SELECT feature FROM ({texts['top_variance_features']}))""",
    }
    fixed, BLOCKS["labelled"] = BLOCKS["labelled"], "SELECT * FROM full_labels"
    try:
        return {name: _sql(text) for name, text in chosen.items()}
    finally:
        BLOCKS["labelled"] = fixed


def numeric_column_queries() -> dict[str, str]:
    """Profiles of all numeric columns of the features."""
    moments = _union(f"""
        SELECT '{c}' AS feature, {r4(f'avg({c})')} AS mean, {r4(f'median(CAST({c} AS DOUBLE))')} AS median,
               {r4(f'stddev_samp({c})')} AS std, {r4(_skew(c))} AS skewness, false AS can_use_log FROM hybrid""" for c in FEATURES)
    outside = _union(f"""
        SELECT '{c}' AS feature, count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS outlier_count,
               count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1)) AS below_min, count(*) FILTER ({c} > q3 + 1.5 * (q3 - q1)) AS above_max
        FROM hybrid, (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM hybrid)"""
                     for c in FEATURES)
    return {"summary_of_numeric_columns": moments, "correlation_of_numeric_columns": profiling_queries()["correlation_matrix"],
            "outliers_of_numeric_columns": outside}


def oracle_texts() -> dict[str, str]:
    """SQL text by query name."""
    groups = (table_queries, scaling_queries, cluster_queries, component_queries, stability_queries, segment_queries)
    texts = {name: _sql(text) for group in groups for name, text in group().items()}
    numeric = {n: t if n.startswith("correlation") else _sql(t) for n, t in numeric_column_queries().items()}
    return {**texts, **profiling_queries(), **fitted_queries(), **numeric}
