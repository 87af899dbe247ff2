"""The registered queries as plain SQL over the star-schema tables, for checking results with another engine.

Written from the definitions, not from the Spark plans: one-task windows, direct quantiles, numeric integration for
tails, elimination in SQL for the regressions and an unrolled tree.
"""

from __future__ import annotations

from itertools import combinations, product


FEATURES = """
t_customers AS (
  SELECT c_custkey AS customer_id, c_custkey AS customer_unique_id, n_name AS customer_state
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
t_items AS (
  SELECT l_orderkey AS order_id, l_linenumber AS order_item_id, l_partkey AS product_id,
         l_extendedprice * (1 - l_discount) AS price, l_extendedprice * l_tax AS freight_value
  FROM lineitem),
t_orders AS (
  SELECT o_orderkey AS order_id, o_custkey AS customer_id,
         CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'shipped' WHEN 'P' THEN 'canceled' END AS order_status,
         o_orderdate AS purchased, shipped AS delivered, o_orderdate + INTERVAL 36 DAY AS estimated
  FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS shipped FROM lineitem GROUP BY 1)
       ON l_orderkey = o_orderkey),
t_reviews AS (
  SELECT l_orderkey AS order_id, CAST(l_quantity AS INT) % 5 + 1 AS review_score FROM lineitem WHERE l_returnflag = 'R'),
t_payments AS (
  SELECT l_orderkey AS order_id,
         CASE l_suppkey % 4 WHEN 0 THEN 'credit_card' WHEN 1 THEN 'boleto' WHEN 2 THEN 'voucher' ELSE 'debit_card' END
           AS payment_type,
         l_linenumber AS payment_installments,
         l_extendedprice * (1 - l_discount) * (1 + l_tax) AS payment_value
  FROM lineitem WHERE l_returnflag IN ('A', 'N')),
t_products AS (SELECT p_partkey AS product_id, p_brand AS product_category_name FROM part),
t_translation AS (
  SELECT DISTINCT p_brand AS product_category_name, lower(replace(p_brand, '#', '_')) AS english
  FROM part WHERE p_brand <> 'Brand#25'),
o_items AS (
  SELECT order_id, sum(price) AS total_price, sum(freight_value) AS total_freight, count(order_item_id) AS item_count
  FROM t_items GROUP BY 1),
o_reviews AS (SELECT order_id, avg(review_score) AS review_score FROM t_reviews GROUP BY 1),
o_pay_type AS (
  SELECT order_id, payment_type FROM t_payments GROUP BY 1, 2
  QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY count(*) DESC, payment_type) = 1),
o_payments AS (
  SELECT p.order_id, avg(payment_installments) AS payment_installments, sum(payment_value) AS payment_value,
         coalesce(max(t.payment_type), 'unknown') AS payment_type
  FROM t_payments p LEFT JOIN o_pay_type t ON t.order_id = p.order_id GROUP BY 1),
named_items AS (
  SELECT order_id, i.product_id, english FROM t_items i LEFT JOIN t_products p ON p.product_id = i.product_id
  LEFT JOIN t_translation t ON t.product_category_name = p.product_category_name),
o_known_category AS (
  SELECT order_id, english FROM named_items WHERE english IS NOT NULL GROUP BY 1, 2
  QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY count(*) DESC, english) = 1),
o_category AS (
  SELECT a.order_id, coalesce(english, 'unknown') AS top_category
  FROM (SELECT DISTINCT order_id FROM t_items) a LEFT JOIN o_known_category b ON a.order_id = b.order_id),
o_all AS MATERIALIZED (
  SELECT c.customer_unique_id, o.order_id, o.purchased, c.customer_state,
         CAST(floor(epoch_us(delivered) / 86400000000.0 - epoch_us(estimated) / 86400000000.0) AS BIGINT) AS delay_days,
         total_price, total_freight / (total_price + total_freight + 1e-6) AS freight_ratio, item_count,
         review_score, payment_installments, payment_type, top_category
  FROM t_orders o JOIN t_customers c ON c.customer_id = o.customer_id
  LEFT JOIN o_items i ON i.order_id = o.order_id LEFT JOIN o_reviews r ON r.order_id = o.order_id
  LEFT JOIN o_payments p ON p.order_id = o.order_id LEFT JOIN o_category g ON g.order_id = o.order_id
  WHERE order_status = 'delivered'),
c_category AS (
  SELECT customer_unique_id AS id, top_category AS v FROM o_all WHERE top_category IS NOT NULL GROUP BY 1, 2
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, v) = 1),
c_payment AS (
  SELECT customer_unique_id AS id, payment_type AS v FROM o_all WHERE payment_type IS NOT NULL GROUP BY 1, 2
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, v) = 1),
c_state AS (
  SELECT customer_unique_id AS id, customer_state AS v FROM o_all WHERE customer_state IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY purchased, order_id) = 1),
c_base AS (
  SELECT customer_unique_id, count(order_id) AS frequency, round(avg(delay_days), 9) AS d,
         round(avg(freight_ratio), 9) AS avg_freight_ratio, round(avg(review_score), 9) AS s,
         round(avg(payment_installments), 9) AS avg_payment_installments,
         round(avg(total_price), 9) AS avg_order_value, round(coalesce(sum(total_price), 0), 9) AS total_spent,
         round(avg(item_count), 9) AS avg_item_count
  FROM o_all GROUP BY 1),
cf AS MATERIALIZED (
  SELECT b.customer_unique_id, frequency, coalesce(d, 0) AS avg_delay_days, avg_freight_ratio,
         coalesce(s, (SELECT quantile_cont(s, 0.5) FROM c_base)) AS avg_review_score, avg_payment_installments,
         avg_order_value, total_spent, avg_item_count, coalesce(k.v, 'unknown') AS favorite_category, t.v AS state,
         coalesce(p.v, 'unknown') AS preferred_payment, CAST(frequency > 1 AS INT) AS is_repeat
  FROM c_base b LEFT JOIN c_category k ON k.id = b.customer_unique_id
  LEFT JOIN c_payment p ON p.id = b.customer_unique_id LEFT JOIN c_state t ON t.id = b.customer_unique_id)"""

# Fixed values, written out here so that a wrong one in the code cannot check itself.
HIGH, OFTEN, MUCH, PLAIN = "高價值客戶", "高頻客戶", "高額客戶", "一般客戶"

SEGMENTS = f"""
fm AS MATERIALIZED (
  SELECT c.customer_unique_id, count(DISTINCT o.order_id) AS frequency, round(sum(payment_value), 9) AS monetary
  FROM t_orders o JOIN t_customers c ON c.customer_id = o.customer_id JOIN t_payments p ON p.order_id = o.order_id
  WHERE order_status = 'delivered' GROUP BY 1),
med AS (SELECT quantile_cont(frequency, 0.5) AS f, quantile_cont(monetary, 0.5) AS m FROM fm),
seg AS MATERIALIZED (
  SELECT fm.*, CASE WHEN frequency >= f AND monetary >= m THEN '{HIGH}' WHEN frequency >= f THEN '{OFTEN}'
                    WHEN monetary >= m THEN '{MUCH}' ELSE '{PLAIN}' END AS segment
  FROM fm, med),
pop AS MATERIALIZED (
  SELECT english AS category, count(*) AS buy_count
  FROM seg a JOIN t_customers b ON a.customer_unique_id = b.customer_unique_id
  JOIN t_orders c ON b.customer_id = c.customer_id JOIN t_items d ON c.order_id = d.order_id
  JOIN t_products p ON d.product_id = p.product_id
  JOIN t_translation e ON p.product_category_name = e.product_category_name
  WHERE a.segment = '{HIGH}' AND c.order_status = 'delivered' AND english <> '' GROUP BY 1)"""


def _rated(rows: int, rating: float, sales: int, orders: str = "") -> str:
    return f"""
rated AS MATERIALIZED (
  SELECT english AS category, a.product_id, count(DISTINCT a.order_id) AS sales, avg(c.review_score) AS avg_rating
  FROM t_items a {orders} JOIN t_products p ON a.product_id = p.product_id
  JOIN t_translation b ON p.product_category_name = b.product_category_name
  LEFT JOIN t_reviews c ON a.order_id = c.order_id
  WHERE english IN (SELECT category FROM pop ORDER BY buy_count DESC, category LIMIT {rows})
  GROUP BY 1, 2 HAVING avg(c.review_score) >= {rating} AND count(DISTINCT a.order_id) >= {sales})"""


_RANKED = """SELECT category, product_id, sales, round(avg_rating, 6) AS avg_rating,
  CAST(row_number() OVER (PARTITION BY category ORDER BY avg_rating DESC, sales DESC, product_id) AS INT) AS rank
FROM rated QUALIFY rank <= 5"""


def _with(select: str, *ctes: str, features: bool = True) -> str:
    parts = ([FEATURES] if features else []) + list(ctes)
    return "WITH RECURSIVE " + ",".join(parts) + "\n" + select


# --- tails by numeric integration --------------------------------------------------------------------------------

_STEPS = 2000


def _integral(low: str, high: str, log_density: str) -> str:
    """Simpson's rule for exp(log_density), written in terms of x, between two expressions."""
    n = _STEPS
    width = f"(({high}) - ({low}))"
    x = f"(({low}) + i * {width} / {n})"
    weight = f"CASE WHEN i IN (0, {n}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return (
        f"({width} / {3 * n} * list_sum(list_transform(range(0, {n + 1}), "
        f"lambda i: ({weight}) * exp({log_density.replace('{x}', x)}))))"
    )


def f_tail(f: str, df1: str, df2: str) -> str:
    """P(F > f): the beta integral after x = sin^2, over the part of it that matters."""
    a, b = f"(({df2}) - 1.0)", f"(({df1}) - 1.0)"  # exponents of sine and cosine
    top = f"asin(sqrt(({df2}) / (({df2}) + ({df1}) * ({f}))))"
    mode = f"(CASE WHEN {b} > 0 THEN atan(sqrt({a} / greatest({b}, 1e-9))) ELSE pi() / 2 END)"
    spread = f"(14 / sqrt({a} + {b}))"
    low = f"greatest(0, least({top}, {mode}) - {spread})"
    high = f"least({top}, {mode} + {spread})"
    log_beta = f"(lgamma(({df1}) / 2.0) + lgamma(({df2}) / 2.0) - lgamma((({df1}) + ({df2})) / 2.0))"
    density = (
        f"ln(2) - {log_beta} + {a} * ln(greatest(sin({{x}}), 1e-300)) + {b} * ln(greatest(cos({{x}}), 1e-300))"
    )
    return _integral(low, high, density)


def t_two_sided(t: str, df: str) -> str:
    return f_tail(f"({t}) * ({t})", "1.0", df)


def chi2_tail(x: str, df: str) -> str:
    """P(chi-square > x): the chi density from the root of x up."""
    root = f"sqrt({x})"
    density = (
        f"(1 - ({df}) / 2.0) * ln(2) - lgamma(({df}) / 2.0) + (({df}) - 1) * ln(greatest({{x}}, 1e-300)) - {{x}} * {{x}} / 2"
    )
    return _integral(root, f"(greatest({root}, sqrt({df})) + 14)", density)


def normal_two_sided(z: str) -> str:
    return chi2_tail(f"({z}) * ({z})", "1.0")


def _mark(p: str) -> str:
    return f"CASE WHEN {p} < 0.001 THEN '***' WHEN {p} < 0.01 THEN '**' WHEN {p} < 0.05 THEN '*' ELSE '' END"


# --- groups -------------------------------------------------------------------------------------------------------


def _factor_rows(factor: str, rows: str = "g_rows") -> str:
    where = (
        ""
        if factor == "preferred_payment"
        else f"WHERE {factor} IN (SELECT {factor} FROM cf WHERE {factor} IS NOT NULL GROUP BY 1 "
        f"ORDER BY count(*) DESC, {factor} LIMIT 10)"
    )
    return f"\n{rows} AS MATERIALIZED (SELECT {factor} AS g, avg_order_value AS y FROM cf {where})"


def _one_way(rows: str, out: str) -> str:
    known = f"(SELECT * FROM {rows} WHERE y IS NOT NULL AND g IS NOT NULL)"
    return f"""
{out}_sums AS (
  SELECT sum(n) AS n, count(*) AS k, sum(n * (m - grand) * (m - grand)) AS ss_between, sum(w) AS ss_within
  FROM (SELECT g, count(*) AS n, avg(y) AS m, var_pop(y) * count(*) AS w FROM {known} GROUP BY 1),
       (SELECT avg(y) AS grand FROM {known})),
{out} AS MATERIALIZED (
  SELECT CAST(n AS BIGINT) AS n, k, ss_between, ss_within, k - 1 AS df_between, CAST(n - k AS BIGINT) AS df_within,
         (ss_between / (k - 1)) / (ss_within / (n - k)) AS f, ss_between / (ss_between + ss_within) AS eta_squared
  FROM {out}_sums)"""


def _anova_select(source: str) -> str:
    p = f_tail("f", "df_between", "df_within")
    return f"""SELECT n, k, round(ss_between, 0) AS ss_between, round(ss_within, 0) AS ss_within, df_between, df_within,
  round(f, 6) AS f, round(p, 6) AS p, round(eta_squared, 6) AS eta_squared,
  CASE WHEN eta_squared < 0.01 THEN 'negligible' WHEN eta_squared < 0.06 THEN 'small'
       WHEN eta_squared < 0.14 THEN 'medium' ELSE 'large' END AS effect, p < 0.05 AS significant
FROM (SELECT *, {p} AS p FROM {source})"""


def _levene_sql(factor: str) -> str:
    spread = """
l_rows AS (SELECT a.g, abs(a.y - b.m) AS y FROM g_rows a
  JOIN (SELECT g, quantile_cont(y, 0.5) AS m FROM g_rows WHERE y IS NOT NULL GROUP BY 1) b ON a.g = b.g)"""
    p = f_tail("f", "df_between", "df_within")
    return _with(
        f"SELECT round(f, 6) AS w, df_between, df_within, round(p, 6) AS p, p > 0.05 AS homogeneous "
        f"FROM (SELECT *, {p} AS p FROM a)",
        _factor_rows(factor), spread, _one_way("l_rows", "a"),
    )


def _kruskal_sql(factor: str) -> str:
    return _with(
        f"""SELECT n, k, round(h, 6) AS h, df, round(p, 6) AS p, p < 0.05 AS significant
FROM (SELECT *, {chi2_tail('h', 'df')} AS p FROM h)""",
        _factor_rows(factor),
        """
r AS (SELECT g, y, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS rk FROM g_rows WHERE y IS NOT NULL),
s AS (SELECT g, count(*) AS m, sum(rk) AS t FROM r GROUP BY 1),
u AS (SELECT sum(c * c * c - c) AS ties FROM (SELECT CAST(count(*) AS DOUBLE) AS c FROM r GROUP BY y)),
h AS (SELECT CAST(sum(m) AS BIGINT) AS n, count(*) AS k,
        (12.0 / (sum(m) * (sum(m) + 1.0)) * sum(t * t / m) - 3 * (sum(m) + 1.0))
        / (1 - any_value(ties) / (CAST(sum(m) AS DOUBLE) ** 3 - sum(m))) AS h, count(*) - 1 AS df
      FROM s, u)""",
    )


def _phi_below(x: str) -> str:
    """Normal distribution function from its table, read off between the grid points with its known slope."""
    t = f"(({x}) + 8.5) * 100 - floor((({x}) + 8.5) * 100)"
    return f"""(CASE WHEN {x} <= -8.49 THEN 0 ELSE (SELECT
      c * (1 + 2 * ({t})) * (1 - ({t})) ** 2 + d * 0.01 * ({t}) * (1 - ({t})) ** 2 + nc * ({t}) ** 2 * (3 - 2 * ({t})) + nd * 0.01 * ({t}) ** 2 * (({t}) - 1)
      FROM phi WHERE i = CAST(floor((({x}) + 8.5) * 100) AS BIGINT)) END)"""


def _simpson(i: str, n: int) -> str:
    return f"CASE WHEN {i} IN (0, {n}) THEN 1 WHEN {i} % 2 = 1 THEN 4 ELSE 2 END"


def _range_tail(name: str, source: str) -> str:
    """P(Q > q) for the rows (id, q) of a source, over the largest member (z) within the scale (s)."""
    return f"""
{name} AS MATERIALIZED (
  SELECT id, any_value(q) AS q, 1 - sum(ws * wz * k * (pz - {_phi_below('lower')}) ** (k - 1)) / sum(ws * wz) AS p
  FROM (SELECT id, q, k, ws, wz, pz, z - q * sc AS lower FROM {source}, ss, zs, pool) GROUP BY 1)"""


def _tukey_ctes(factor: str) -> tuple[str, ...]:
    return (
        _factor_rows(factor),
        f"""
s AS MATERIALIZED (SELECT g, count(*) AS n, avg(y) AS m, var_pop(y) * count(*) AS w FROM g_rows WHERE y IS NOT NULL GROUP BY 1),
pool AS MATERIALIZED (SELECT sum(w) / (sum(n) - count(*)) AS ms, CAST(sum(n) - count(*) AS DOUBLE) AS df, count(*) AS k FROM s),
pr AS MATERIALIZED (
  SELECT row_number() OVER () AS id, a.g AS group1, b.g AS group2, b.m - a.m AS diff, sqrt(ms / 2 * (1.0 / a.n + 1.0 / b.n)) AS se,
         abs(b.m - a.m) / sqrt(ms / 2 * (1.0 / a.n + 1.0 / b.n)) AS q, df
  FROM s a JOIN s b ON a.g < b.g, pool),
dens AS (SELECT i, exp(-x * x / 2) / sqrt(2 * pi()) AS d, exp(-(x + 0.005) * (x + 0.005) / 2) / sqrt(2 * pi()) AS md
         FROM (SELECT i, -8.5 + i / 100e0 AS x FROM range(0, 1702) t(i))),
phi AS MATERIALIZED (
  SELECT i, d, nd, c, lead(c) OVER (ORDER BY i) AS nc
  FROM (SELECT i, d, nd, coalesce(sum((d + 4 * md + nd) / 600) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c
        FROM (SELECT *, lead(d) OVER (ORDER BY i) AS nd FROM dens))),
zs AS MATERIALIZED (SELECT z, {_simpson('i', 320)} * exp(-z * z / 2) AS wz, {_phi_below('z')} AS pz
                    FROM (SELECT i, -8 + i / 20e0 AS z FROM range(0, 321) t(i))),
ss AS MATERIALIZED (SELECT sc, {_simpson('i', 48)} * exp((df - 1) * ln(sc) - df * (sc * sc - 1) / 2) AS ws
                    FROM (SELECT i, df, 1 - 9 / sqrt(2 * df) + i * 18 / sqrt(2 * df) / 48 AS sc FROM range(0, 49) t(i), pool))""",
        _range_tail("pq", "pr"),
    )


def _tukey_sql(factor: str) -> str:
    return _with(
        """SELECT group1, group2, round(diff, 3) AS mean_diff, round(se, 3) AS std_error, round(pr.q, 6) AS q, df, round(p, 5) AS p_adj,
  p < 0.05 AS reject FROM pr JOIN pq USING (id)""",
        *_tukey_ctes(factor),
    )


def _tukey_pairs_sql(factor: str, steps: int = 8, more: str = "", tail: str = "") -> str:
    """With the interval: its q is where the tail is 0.05, found by unrolled secant steps on the log of the tail."""
    parts = [_range_tail("c0", "(SELECT 1 AS id, 4.0e0 AS q)"), _range_tail("c1", "(SELECT 1 AS id, 4.4e0 AS q)")]
    for t in range(2, steps):
        a, b = f"c{t - 2}", f"c{t - 1}"
        step = f"CASE WHEN {b}.p = {a}.p THEN 0 ELSE (ln(0.05) - ln({b}.p)) * ({b}.q - {a}.q) / (ln({b}.p) - ln({a}.p)) END"
        parts.append(_range_tail(f"c{t}", f"(SELECT 1 AS id, {b}.q + {step} AS q FROM {a}, {b})"))
    reach = f"(SELECT q FROM c{steps - 1}) * se"
    return _with(
        f"""SELECT group1, group2, round(diff, 3) AS mean_diff, round(se, 3) AS std_error, round(pr.q, 6) AS q, df, round(p, 5) AS p_adj,
  round(diff - {reach}, 1) AS lower, round(diff + {reach}, 1) AS upper, p < 0.05 AS reject{more} FROM pr JOIN pq USING (id) {tail}""",
        *_tukey_ctes(factor), *parts,
    )


def _describe_sql(factor: str) -> str:
    return _with(
        f"SELECT g AS {factor}, count(y) AS n, round(avg(y), 4) AS mean, round(stddev_samp(y), 4) AS sd "
        f"FROM g_rows WHERE g IS NOT NULL GROUP BY 1",
        _factor_rows(factor),
    )


def _box(rows: str, names: str = "", places: int = 4, lift: str = "5e-10") -> str:
    key = "g" if names else "1"
    lead = f"a.g AS {names}, " if names else ""
    q = ", ".join(f"quantile_cont(y, {p}) AS {n}" for n, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)))
    inside = "y BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)"
    on = "ON a.g = b.g" if names else "ON true"
    group = "GROUP BY a.g" if names else ""
    pick = "g, " if names else ""
    return f"""SELECT {lead}count(*) AS n, round(max(q1) + {lift}, {places}) AS q1, round(max(median) + {lift}, {places}) AS median,
  round(max(q3) + {lift}, {places}) AS q3, round(min(y) FILTER ({inside}) + {lift}, {places}) AS whisker_low,
  round(max(y) FILTER ({inside}) + {lift}, {places}) AS whisker_high, count(*) FILTER (NOT ({inside})) AS outliers
FROM (SELECT * FROM {rows} WHERE y IS NOT NULL) a
JOIN (SELECT {pick}{q} FROM {rows} WHERE y IS NOT NULL {'GROUP BY ' + key if names else ''}) b {on} {group}"""


# --- linear algebra -------------------------------------------------------------------------------------------------


def _solve(name: str, size: int, augmented: str) -> str:
    """Gauss-Jordan elimination of a (i, j, v) system of ``size`` equations by a recursive query."""
    return f"""
{name}_steps AS (
  SELECT 0 AS k, i, j, CAST(v AS DOUBLE) AS v FROM ({augmented})
  UNION ALL
  SELECT k + 1, i, j, CASE WHEN i = k + 1 THEN v / head ELSE v - in_column * in_row / head END
  FROM (SELECT *, max(CASE WHEN i = k + 1 AND j = k + 1 THEN v END) OVER () AS head,
               max(CASE WHEN j = k + 1 THEN v END) OVER (PARTITION BY i) AS in_column,
               max(CASE WHEN i = k + 1 THEN v END) OVER (PARTITION BY j) AS in_row
        FROM {name}_steps WHERE k < {size})),
{name} AS MATERIALIZED (SELECT i, j, v FROM {name}_steps WHERE k = {size})"""


def _long(name: str, source: str, columns: list[str]) -> str:
    """Rows (id, j, x): the constant as j = 1, then the columns, standardised."""
    parts = [f"SELECT id, 1 AS j, 1e0 AS x FROM {source}"]
    parts += [
        f"SELECT id, {j} AS j, ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS x FROM {source}"
        for j, c in enumerate(columns, 2)
    ]
    return f"\n{name} AS MATERIALIZED ({' UNION ALL '.join(parts)})"


OLS_X = ["avg_delay_days", "avg_freight_ratio", "avg_review_score", "avg_payment_installments", "avg_item_count"]
_K = len(OLS_X)
_COMPLETE = " AND ".join(f"{x} IS NOT NULL" for x in [*OLS_X, "avg_order_value"])

OLS_DATA = f"""
d AS MATERIALIZED (SELECT customer_unique_id AS id, avg_order_value AS y, {', '.join(OLS_X)} FROM cf WHERE {_COMPLETE})"""


def _ols(data: str = "d", prefix: str = "") -> str:
    """Coefficients on the original scale, the inverse cross products of the standardised design, and residuals."""
    p = prefix
    moments = ", ".join(f"avg({x}) AS m{j}, stddev_pop({x}) AS s{j}" for j, x in enumerate(OLS_X, 2))
    system = f"""SELECT a.j AS i, b.j AS j, sum(a.x * b.x) AS v FROM {p}dl a JOIN {p}dl b ON a.id = b.id GROUP BY 1, 2
    UNION ALL SELECT i, i + {_K + 1}, 1e0 FROM range(1, {_K + 2}) t(i)
    UNION ALL SELECT i, j + {_K + 1}, 0e0 FROM range(1, {_K + 2}) t(i), range(1, {_K + 2}) u(j) WHERE i <> j
    UNION ALL SELECT a.j, {2 * _K + 3}, sum(a.x * b.y) FROM {p}dl a JOIN {data} b ON a.id = b.id GROUP BY 1"""
    scale = " ".join(f"WHEN {j} THEN s{j}" for j in range(2, _K + 2))
    mean = " ".join(f"WHEN {j} THEN m{j}" for j in range(2, _K + 2))
    name = " ".join(f"WHEN {j} THEN '{x}'" for j, x in enumerate(OLS_X, 2))
    pick = ", ".join(f"max(b) FILTER (j = {j}) AS b{j}" for j in range(1, _K + 2))
    fitted = "b1 + " + " + ".join(f"b{j} * {x}" for j, x in enumerate(OLS_X, 2))
    return (
        _long(f"{p}dl", data, OLS_X)
        + ","
        + _solve(f"{p}sol", _K + 1, system)
        + f""",
{p}mom AS (SELECT count(*) AS n, avg(y) AS my, stddev_pop(y) AS sy, {moments} FROM {data}),
{p}slope AS (
  SELECT i AS j, CASE i {name} END AS term, v AS z, CASE i {scale} END AS s, CASE i {mean} END AS m
  FROM {p}sol, {p}mom WHERE j = {2 * _K + 3} AND i > 1),
{p}coef AS MATERIALIZED (
  SELECT j, term, z / s AS b FROM {p}slope
  UNION ALL SELECT 1, 'intercept', (SELECT v FROM {p}sol WHERE i = 1 AND j = {2 * _K + 3}) - sum(z / s * m) FROM {p}slope),
{p}wide AS (SELECT {pick} FROM {p}coef)"""
        + (
            f""",
res AS MATERIALIZED (SELECT d.*, {fitted} AS fitted, y - ({fitted}) AS e FROM d, {p}wide),
fit AS MATERIALIZED (
  SELECT n, my, sy, sse, 1 - sse / (n * sy * sy) AS r2, n - {_K + 1} AS rdf
  FROM {p}mom, (SELECT sum(e * e) AS sse FROM res))"""
            if data == "d"
            else ""
        )
    ), fitted


def _se() -> str:
    """Errors of all terms, the intercept from the covariance of the standardised terms."""
    return f"""
inv AS MATERIALIZED (SELECT i, j - {_K + 1} AS j, v FROM sol WHERE j > {_K + 1} AND j < {2 * _K + 3}),
load AS (SELECT 1 AS i, 1e0 AS c UNION ALL SELECT j, -m / s FROM slope),
se AS MATERIALIZED (
  SELECT s.j, sqrt(sse / rdf * v) / s.s AS se, s.z * s.s / s.s / sy AS beta
  FROM slope s JOIN inv ON inv.i = s.j AND inv.j = s.j, fit
  UNION ALL
  SELECT 1, sqrt(sse / rdf * sum(a.c * b.c * v)), NULL
  FROM inv JOIN load a ON a.i = inv.i JOIN load b ON b.i = inv.j, fit GROUP BY sse, rdf)"""


_OLS_CTES, _FITTED = _ols()
_OLS = (OLS_DATA, _OLS_CTES)

# Cross products of the raw design and their inverse, the latter from the well conditioned standardised one.
_CONDITION = f"""
raw AS MATERIALIZED (SELECT id, 1 AS j, 1e0 AS x FROM d UNION ALL {' UNION ALL '.join(f"SELECT id, {j}, {x} FROM d" for j, x in enumerate(OLS_X, 2))}),
gram AS MATERIALIZED (SELECT a.j AS i, b.j AS j, sum(a.x * b.x) AS v FROM raw a JOIN raw b USING (id) GROUP BY 1, 2),
back AS MATERIALIZED (
  SELECT 1 AS i, 1 AS j, 1e0 AS v UNION ALL SELECT 1, j, -m / s FROM slope UNION ALL SELECT j, j, 1 / s FROM slope),
ginv AS MATERIALIZED (
  SELECT a.i, b.i AS j, sum(a.v * inv.v * b.v) AS v FROM back a JOIN inv ON inv.i = a.j JOIN back b ON b.j = inv.j GROUP BY 1, 2)"""


def _dominant(matrix: str, squarings: int = 6) -> str:
    """Largest eigenvalue of a symmetric matrix: its powers, kept at trace 1, turn into the projection on its vector."""
    out = [f"\n{matrix}_0 AS MATERIALIZED (SELECT i, j, v / (SELECT sum(v) FROM {matrix} WHERE i = j) AS v FROM {matrix})"]
    for t in range(squarings):
        out.append(f"""
{matrix}_s{t} AS MATERIALIZED (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM {matrix}_{t} a JOIN {matrix}_{t} b ON a.j = b.i GROUP BY 1, 2),
{matrix}_{t + 1} AS MATERIALIZED (SELECT i, j, v / (SELECT sum(v) FROM {matrix}_s{t} WHERE i = j) AS v FROM {matrix}_s{t})""")
    out.append(f"\n{matrix}_value AS (SELECT sum(a.v * b.v) AS top FROM {matrix} a JOIN {matrix}_{squarings} b ON a.i = b.i AND a.j = b.j)")
    return ",".join(out)


# The t quantile by its Cornish-Fisher expansion, far below the rounding for hundreds of degrees of freedom.
_Z975 = "1.959963984540054"
_T975 = (
    f"({_Z975} + ({_Z975}**3 + {_Z975}) / (4 * rdf) + (5 * {_Z975}**5 + 16 * {_Z975}**3 + 3 * {_Z975}) / (96 * rdf**2)"
    f" + (3 * {_Z975}**7 + 19 * {_Z975}**5 + 17 * {_Z975}**3 - 15 * {_Z975}) / (384 * rdf**3))"
)

_COEF = f"""
co AS MATERIALIZED (
  SELECT term, b, se, b / se AS t, {t_two_sided('b / se', 'rdf')} AS p, b - {_T975} * se AS lower, b + {_T975} * se AS upper, beta
  FROM coef JOIN se USING (j), fit)"""

# --- logistic models -------------------------------------------------------------------------------------------------

LOGIT_X = ["avg_delay_days", "avg_freight_ratio", "avg_review_score", "avg_payment_installments", "avg_order_value"]
_L = len(LOGIT_X)
_LOGIT_COMPLETE = " AND ".join(f"{x} IS NOT NULL" for x in LOGIT_X)
LOGIT_DATA = f"""
ld AS MATERIALIZED (SELECT customer_unique_id AS id, is_repeat AS y, {', '.join(LOGIT_X)} FROM cf WHERE {_LOGIT_COMPLETE})"""


def _newton(p: str, rows: str, ridge: float, steps: int = 9) -> str:
    """Newton's method unrolled. ``rows`` has (id, y, w); ``ll`` holds the standardised design. Last iterate {p}b{steps}."""
    out = [f"\n{p}b0 AS (SELECT i AS j, 0e0 AS b FROM range(1, {_L + 2}) t(i))"]
    for t in range(steps):
        out.append(f"""
{p}p{t} AS MATERIALIZED (
  SELECT r.id, any_value(r.y) AS y, any_value(r.w) AS w, 1 / (1 + exp(-sum(b * x))) AS p, sum(b * x) AS eta
  FROM {rows} r JOIN ll ON ll.id = r.id JOIN {p}b{t} USING (j) GROUP BY 1)""")
        system = f"""SELECT a.j AS i, b.j AS j, sum(w * p * (1 - p) * a.x * b.x) + CASE WHEN a.j = b.j AND a.j > 1 THEN {ridge} ELSE 0 END AS v
    FROM {p}p{t} r JOIN ll a ON a.id = r.id JOIN ll b ON b.id = r.id GROUP BY 1, 2
    UNION ALL SELECT i, i + {_L + 1}, 1e0 FROM range(1, {_L + 2}) t(i)
    UNION ALL SELECT i, j + {_L + 1}, 0e0 FROM range(1, {_L + 2}) t(i), range(1, {_L + 2}) u(j) WHERE i <> j
    UNION ALL SELECT j, {2 * _L + 3}, sum(w * (y - p) * x) - CASE WHEN j > 1 THEN {ridge} ELSE 0 END * any_value(b)
    FROM {p}p{t} r JOIN ll ON ll.id = r.id JOIN {p}b{t} USING (j) GROUP BY j"""
        out.append(_solve(f"{p}s{t}", _L + 1, system))
        out.append(f"""
{p}b{t + 1} AS MATERIALIZED (SELECT o.j, o.b + s.v AS b FROM {p}b{t} o JOIN {p}s{t} s ON s.i = o.j WHERE s.j = {2 * _L + 3})""")
    return ",".join(out)


_HASH = "md5(concat('42:', CAST({key} AS VARCHAR)))"


def _stratified(rows: str, out: str) -> str:
    """Exact stratified hold-out: class quotas by largest remainder, rows in hash order."""
    h = _HASH.format(key="id")
    return f"""
{out}_size AS (SELECT y, count(*) AS c FROM {rows} GROUP BY 1),
{out}_deal AS (
  SELECT y, c, n_train * c // n AS dealt, n_train * c % n AS rest, n_train
  FROM {out}_size, (SELECT CAST(sum(c) AS BIGINT) AS n, CAST(sum(c) - ceil(sum(c) * 30 / 100.0) AS BIGINT) AS n_train FROM {out}_size)),
{out}_quota AS (
  SELECT y, c - dealt - CASE WHEN row_number() OVER (ORDER BY rest DESC, y) <= n_train - sum(dealt) OVER () THEN 1 ELSE 0 END AS quota
  FROM {out}_deal),
{out} AS MATERIALIZED (
  SELECT r.*, CAST(row_number() OVER (PARTITION BY r.y ORDER BY {h}, id) <= quota AS INT) AS is_test
  FROM {rows} r JOIN {out}_quota q ON q.y = r.y)"""


_CLASSIFIER = (
    LOGIT_DATA,
    _long("ll", "ld", LOGIT_X),
    _stratified("ld", "sp"),
    """
tr AS MATERIALIZED (
  SELECT id, y, count(*) OVER () / (2.0 * count(*) OVER (PARTITION BY y)) AS w FROM sp WHERE is_test = 0)""",
    _newton("c", "tr", 1.0),
    """
sc AS MATERIALIZED (
  SELECT r.id, any_value(r.y) AS y, 1 / (1 + exp(-sum(b * x))) AS score FROM sp r JOIN ll ON ll.id = r.id JOIN cb9 USING (j)
  WHERE is_test = 1 GROUP BY 1)""",
)


def _curve(rows: str, score: str) -> str:
    """Positives and negatives at each score and above it."""
    return f"""
cu AS MATERIALIZED (
  SELECT score, pos, neg, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp,
         CAST(sum(pos) OVER () AS BIGINT) AS np, CAST(sum(neg) OVER () AS BIGINT) AS nn
  FROM (SELECT {score} AS score, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg
        FROM {rows} WHERE {score} IS NOT NULL GROUP BY 1)
  WINDOW w AS (ORDER BY score DESC))"""


_ROC = """SELECT round(score, 6) AS threshold, round(fp / nn, 6) AS fpr, round(tp / np, 6) AS tpr FROM cu
UNION ALL SELECT NULL, 0e0, 0e0"""
# Steps to a point and from it by lag and lead; a step repeats the one before, or only points the same way.
_STEPS_AROUND = """
sa AS (
  SELECT *, tp - lag(tp, 1, 0) OVER w AS up, fp - lag(fp, 1, 0) OVER w AS along, lead(tp) OVER w - tp AS next_up, lead(fp) OVER w - fp AS next_along,
         row_number() OVER w AS place
  FROM cu WINDOW w AS (ORDER BY score DESC))"""
_POLYLINE = """SELECT round(score, 6) AS threshold, round(fp / nn, 6) AS fpr, round(tp / np, 6) AS tpr FROM sa
WHERE {kept} OR next_up IS NULL UNION ALL SELECT NULL, 0e0, 0e0"""
_REPEATED = _POLYLINE.format(kept="place = 1 OR up <> next_up OR along <> next_along")
_STRAIGHT = _POLYLINE.format(kept="up * next_along <> along * next_up")
_PR = """SELECT round(score, 6) AS threshold, round(tp / (tp + fp), 6) AS precision, round(tp / np, 6) AS recall FROM cu
UNION ALL SELECT NULL, 1e0, 0e0"""
_AUC = "sum((fp - lag_fp) / nn * (tp + lag_tp) / np / 2)"
_LAGS = "(SELECT *, lag(fp, 1, 0) OVER (ORDER BY score DESC) AS lag_fp, lag(tp, 1, 0) OVER (ORDER BY score DESC) AS lag_tp FROM cu)"
_PR_AUC = f"""SELECT round(sum((tp - lag_tp) / np * (tp / (tp + fp) + CASE WHEN lag_tp + lag_fp = 0 THEN 1.0
  ELSE lag_tp / (lag_tp + lag_fp) END) / 2), 6) AS pr_auc FROM {_LAGS}"""
_FEATURE_SCORES = "\nfs AS (SELECT is_repeat AS y, avg_payment_installments AS s FROM cf)"


def _confusion(rows: str) -> str:
    return f"""
cm AS (
  SELECT CAST(a AS INT) AS actual, CAST(p AS INT) AS predicted, count(y) AS n
  FROM range(0, 2) t(a) JOIN range(0, 2) u(p) ON true LEFT JOIN {rows} r ON r.y = a AND r.predicted = p GROUP BY 1, 2)"""


_REPORT = """SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM (
  SELECT CAST(c AS VARCHAR) AS class, p AS precision, r AS recall, f AS f1, s AS support FROM pc
  UNION ALL SELECT 'accuracy', NULL, NULL, sum(hit) / sum(s), CAST(sum(s) AS BIGINT) FROM pc
  UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f), CAST(sum(s) AS BIGINT) FROM pc
  UNION ALL SELECT 'weighted avg', sum(p * s) / sum(s), sum(r * s) / sum(s), sum(f * s) / sum(s), CAST(sum(s) AS BIGINT) FROM pc)"""
_PER_CLASS = """
pc AS (
  SELECT c, hit, CAST(hit + miss AS BIGINT) AS s, coalesce(hit / nullif(hit + alarm, 0), 0) AS p, coalesce(hit / nullif(hit + miss, 0), 0) AS r,
         coalesce(2 * hit / nullif(2 * hit + alarm + miss, 0), 0) AS f
  FROM (SELECT c, sum(n) FILTER (actual = c AND predicted = c) AS hit, sum(n) FILTER (actual <> c AND predicted = c) AS alarm,
               sum(n) FILTER (actual = c AND predicted <> c) AS miss
        FROM cm, range(0, 2) t(c) GROUP BY 1))"""
_PREDICTED = "\npr AS (SELECT *, CAST(score > 0.5 AS INT) AS predicted FROM sc)"


def _folds(rows: str, out: str) -> str:
    """Consecutive blocks per class in key order, sized by dealing the lined-up classes round-robin."""
    return f"""
{out}_line AS (
  SELECT y, c, coalesce(sum(c) OVER (ORDER BY head ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins
  FROM (SELECT y, count(*) AS c, min(id) AS head FROM {rows} GROUP BY 1)),
{out}_deal AS (
  SELECT y, fold, count(*) AS take
  FROM (SELECT y, (begins + i) % 5 AS fold FROM {out}_line, LATERAL (SELECT unnest(range(0, c)) AS i)) GROUP BY 1, 2),
{out}_edge AS (SELECT y, fold, sum(take) OVER (PARTITION BY y ORDER BY fold) AS upto FROM {out}_deal),
{out} AS MATERIALIZED (
  SELECT r.*, (SELECT CAST(min(fold) AS INT) FROM {out}_edge e WHERE e.y = r.y AND r.pos <= e.upto) AS fold
  FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY id) AS pos FROM {rows}) r)"""


def _fold_auc() -> tuple[str, ...]:
    parts = [LOGIT_DATA, _long("ll", "ld", LOGIT_X), _folds("ld", "fo")]
    for i in range(5):
        parts.append(f"""
tr{i} AS MATERIALIZED (
  SELECT id, y, count(*) OVER () / (2.0 * count(*) OVER (PARTITION BY y)) AS w FROM fo WHERE fold <> {i})""")
        parts.append(_newton(f"f{i}", f"tr{i}", 1.0, 7))
    scores = " UNION ALL ".join(
        f"SELECT {i} AS fold, r.id, any_value(r.y) AS y, 1 / (1 + exp(-sum(b * x))) AS score FROM fo r "
        f"JOIN ll ON ll.id = r.id JOIN f{i}b7 USING (j) WHERE fold = {i} GROUP BY r.id"
        for i in range(5)
    )
    parts.append(f"\nsc AS MATERIALIZED ({scores})")
    parts.append("""
fa AS MATERIALIZED (
  SELECT fold, (sum(rk) FILTER (y = 1) - (count(*) FILTER (y = 1)) * (count(*) FILTER (y = 1) + 1) / 2.0)
    / ((count(*) FILTER (y = 1)) * (count(*) FILTER (y = 0))) AS roc_auc
  FROM (SELECT *, rank() OVER (PARTITION BY fold ORDER BY score) + (count(*) OVER (PARTITION BY fold, score) - 1) / 2.0 AS rk FROM sc)
  GROUP BY 1)""")
    return tuple(parts)


# --- tree ---------------------------------------------------------------------------------------------------------


TREE_DEPTH, TREE_LEAF, TREE_SPLIT = 4, 50, 100


def _tree() -> tuple[str, ...]:
    """Exact splits level by level: every gap between neighbouring values of every feature in every open node."""
    xs = LOGIT_X
    rows = "\ntd AS (SELECT customer_unique_id AS id, is_repeat AS y, " + ", ".join(xs) + " FROM cf)"
    stacked = " UNION ALL ".join(f"SELECT id, y, {f} AS f, {x} AS v FROM t0" for f, x in enumerate(xs))
    parts = [
        rows,
        _stratified("td", "ts"),
        "\nt0 AS MATERIALIZED (SELECT * FROM ts WHERE is_test = 0)",
        f"\nst AS MATERIALIZED ({stacked})",
        "\nwt AS (SELECT count(*) / (2.0 * count(*) FILTER (y = 0)) AS w0, count(*) / (2.0 * count(*) FILTER (y = 1)) AS w1 FROM t0)",
        "\nat0 AS MATERIALIZED (SELECT id, 1 AS node FROM t0)",
    ]
    for depth in range(TREE_DEPTH):
        parts.append(f"""
s{depth} AS MATERIALIZED (SELECT node, count(*) FILTER (y = 0) AS t0, count(*) FILTER (y = 1) AS t1 FROM at{depth} JOIN t0 USING (id) GROUP BY 1),
k{depth} AS MATERIALIZED (
  SELECT node, f, v, sum(n0) OVER w AS l0, sum(n1) OVER w AS l1, sum(n0) OVER (PARTITION BY node, f) AS a0,
         sum(n1) OVER (PARTITION BY node, f) AS a1, lead(v) OVER (PARTITION BY node, f ORDER BY v) AS nv
  FROM (SELECT node, f, v, count(*) FILTER (y = 0) AS n0, count(*) FILTER (y = 1) AS n1
        FROM st JOIN at{depth} USING (id) WHERE node >= {2 ** depth} AND v IS NOT NULL GROUP BY 1, 2, 3)
  WINDOW w AS (PARTITION BY node, f ORDER BY v)),
o{depth} AS MATERIALIZED (
  SELECT node, f, v, 0 AS o, v / 2 + nv / 2 AS cut, l0 AS x0, l1 AS x1, t0, t1,
         CASE WHEN t0 + t1 > a0 + a1 THEN false ELSE 2 * (l0 + l1) > t0 + t1 END AS ml FROM k{depth} JOIN s{depth} USING (node) WHERE nv IS NOT NULL
  UNION ALL
  SELECT node, f, v, 1, v / 2 + nv / 2, l0 + t0 - a0, l1 + t1 - a1, t0, t1, true FROM k{depth} JOIN s{depth} USING (node)
  WHERE nv IS NOT NULL AND t0 + t1 > a0 + a1
  UNION ALL
  SELECT node, f, v, 2, CAST('infinity' AS DOUBLE), a0, a1, t0, t1, false FROM k{depth} JOIN s{depth} USING (node)
  WHERE nv IS NULL AND t0 + t1 > a0 + a1),
q{depth} AS MATERIALIZED (
  SELECT node, f, cut, ml FROM o{depth}, wt
  WHERE x0 + x1 >= {TREE_LEAF} AND t0 + t1 - x0 - x1 >= {TREE_LEAF} AND t0 + t1 >= {TREE_SPLIT} AND t0 > 0 AND t1 > 0
  QUALIFY row_number() OVER (PARTITION BY node ORDER BY
    ((x0 * w0) ** 2 + (x1 * w1) ** 2) / (x0 * w0 + x1 * w1)
    + (((t0 - x0) * w0) ** 2 + ((t1 - x1) * w1) ** 2) / ((t0 - x0) * w0 + (t1 - x1) * w1) DESC, f, v, o) = 1),
at{depth + 1} AS MATERIALIZED (
  SELECT a.id, CASE WHEN q.node IS NULL THEN a.node WHEN coalesce(s.v <= q.cut, q.ml) THEN 2 * a.node ELSE 2 * a.node + 1 END AS node
  FROM at{depth} a LEFT JOIN q{depth} q ON q.node = a.node LEFT JOIN st s ON s.id = a.id AND s.f = q.f)""")
    cuts = " UNION ALL ".join(f"SELECT * FROM q{d}" for d in range(TREE_DEPTH))
    seen = " UNION ".join(f"SELECT id, node FROM at{d}" for d in range(TREE_DEPTH + 1))
    name = "CASE f " + " ".join(f"WHEN {f} THEN '{x}'" for f, x in enumerate(xs)) + " END"
    parts.append(f"""
cuts AS MATERIALIZED ({cuts}),
nodes AS MATERIALIZED (
  SELECT node, count(*) FILTER (y = 0) AS n0, count(*) FILTER (y = 1) AS n1, any_value(w0) AS w0, any_value(w1) AS w1
  FROM ({seen}) JOIN t0 USING (id), wt GROUP BY 1),
tree AS MATERIALIZED (
  SELECT n.node, CAST(floor(log2(n.node)) AS INT) AS depth, {name} AS feature, cut, ml, n0, n1, n0 * w0 + n1 * w1 AS w,
         1 - ((n0 * w0) ** 2 + (n1 * w1) ** 2) / (n0 * w0 + n1 * w1) ** 2 AS gini, CAST(n1 * w1 > n0 * w0 AS INT) AS prediction
  FROM nodes n LEFT JOIN cuts c ON c.node = n.node)""")
    return tuple(parts)


def _tree_scored() -> tuple[str, ...]:
    xs = LOGIT_X
    value = "CASE t.feature " + " ".join(f"WHEN '{x}' THEN {x}" for x in xs) + " END"
    out = [f"\nv0 AS MATERIALIZED (SELECT ts.*, 1 AS node FROM ts WHERE is_test = 1)"]
    for d in range(TREE_DEPTH):
        out.append(f"""
v{d + 1} AS MATERIALIZED (
  SELECT v.* REPLACE (CASE WHEN t.feature IS NULL THEN v.node WHEN coalesce({value} <= cut, ml) THEN 2 * v.node ELSE 2 * v.node + 1 END AS node)
  FROM v{d} v JOIN tree t ON t.node = v.node)""")
    out.append(f"\npr AS (SELECT v.y, prediction AS predicted FROM v{TREE_DEPTH} v JOIN tree t ON t.node = v.node)")
    return tuple(out)


# --- quantile-quantile -------------------------------------------------------------------------------------------


def _normal_quantile(p: str) -> str:
    """The same rational approximation as the Spark expression (there is no closed form)."""
    from cohortry.functions.columns import AS241_CENTRE, AS241_SHOULDER, AS241_TAIL

    def poly(coefficients: list[float], x: str) -> str:
        text = repr(coefficients[-1])
        for c in reversed(coefficients[:-1]):
            text = f"({text} * {x} + {c!r})"
        return text

    def ratio(pair, x: str) -> str:
        return f"{poly(pair[0], x)} / {poly(pair[1], x)}"

    q = f"({p} - 0.5)"
    r = f"sqrt(-ln(least({p}, 1 - {p})))"
    return (
        f"CASE WHEN abs({q}) <= 0.425 THEN {q} * {ratio(AS241_CENTRE, f'(0.180625 - {q} * {q})')} "
        f"ELSE sign({q}) * CASE WHEN {r} <= 5 THEN {ratio(AS241_SHOULDER, f'({r} - 1.6)')} "
        f"ELSE {ratio(AS241_TAIL, f'({r} - 5)')} END END"
    )


_QQ = f"""
qp AS (SELECT e, i, CASE WHEN i = 1 THEN 1 - 0.5 ** (1.0 / n) WHEN i = n THEN 0.5 ** (1.0 / n) ELSE (i - 0.3175) / (n + 0.365) END AS p
       FROM (SELECT e, row_number() OVER (ORDER BY e) AS i, count(*) OVER () AS n FROM res)),
qq AS MATERIALIZED (SELECT i, e AS residual, {_normal_quantile('p')} AS theoretical FROM qp)"""

# --- correlation ----------------------------------------------------------------------------------------------------

NAMES = [
    "frequency", "avg_delay_days", "avg_freight_ratio", "avg_review_score", "avg_payment_installments", "avg_order_value",
    "total_spent", "avg_item_count",
]


def _pearson(extra: str = "") -> str:
    parts = [f"SELECT '{x}' AS var_x, '{y}' AS var_y, {'1e0' if x == y else f'corr({x}, {y})'} AS r{'' if x == y else ' FROM cf'}" for x, y in product(NAMES, NAMES)]
    return f"\npe AS MATERIALIZED ({' UNION ALL '.join(parts)})"


def _spearman() -> str:
    parts = [f"SELECT '{x}' AS var_x, '{x}' AS var_y, 1e0 AS r" for x in NAMES]
    for a, b in combinations(NAMES, 2):
        rho = (
            f"(SELECT corr(ra, rb) FROM (SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS ra, "
            f"rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS rb "
            f"FROM cf WHERE {a} IS NOT NULL AND {b} IS NOT NULL))"
        )
        parts += [f"SELECT '{x}', '{y}', {rho}" for x, y in ((a, b), (b, a))]
    return f"\nsp AS MATERIALIZED ({' UNION ALL '.join(parts)})"


def _pearson_target(target: str) -> str:
    rows = " UNION ALL ".join(
        f"SELECT '{x}' AS variable, corr({target}, {x}) AS r, count(*) FILTER ({target} IS NOT NULL AND {x} IS NOT NULL) AS n FROM cf"
        for x in NAMES if x != target
    )
    return f"""SELECT variable, round(r, 6) AS r, n, round(p, 6) AS p, {_mark('p')} AS mark
FROM (SELECT *, {t_two_sided('r * sqrt((n - 2) / (1 - r * r))', '(n - 2.0)')} AS p FROM ({rows}))"""


def _report_rows() -> str:
    """The long report: every number of five result tables."""
    share = [("customers", "count(*)"), ("single_n", "sum(1 - is_repeat)"), ("repeat_n", "sum(is_repeat)"),
             ("single_share", "avg(1.0 - is_repeat)"), ("repeat_share", "avg(is_repeat)")]
    parts = [f"SELECT 'customers' AS section, '' AS row, '{m}' AS metric, CAST({e} AS DOUBLE) AS value FROM cf" for m, e in share]
    for m in ("avg_delay_days", "avg_freight_ratio", "avg_review_score", "avg_payment_installments", "avg_order_value"):
        one, two = f"avg({m}) FILTER (is_repeat = 0)", f"avg({m}) FILTER (is_repeat = 1)"
        for name, e in (("single", one), ("repeat", two), ("difference_pct", f"({two} - {one}) / {one} * 100")):
            parts.append(f"SELECT 'comparison', '{m}', '{name}', {e} FROM cf")
    for factor, source in (("state", "a1"), ("favorite_category", "a2"), ("preferred_payment", "a3")):
        p = f_tail("f", "df_between", "df_within")
        for name, e in (("f", "f"), ("p", p), ("eta_squared", "eta_squared")):
            parts.append(f"SELECT 'anova', '{factor} / ' || CASE WHEN {p} < 0.05 THEN 'true' ELSE 'false' END, '{name}', {e} FROM {source}")
    for name in ("n", "chi2", "df", "p", "cramers_v"):
        parts.append(f"SELECT 'association', CASE WHEN p < 0.05 THEN 'true' ELSE 'false' END, '{name}', CAST({name} AS DOUBLE) FROM chi")
    for name in ("frequency", "percent", "cum_frequency", "cum_percent"):
        parts.append(f"SELECT 'segments', segment, '{name}', CAST({name} AS DOUBLE) FROM sf")
    return "SELECT section, row, metric, round(value, 4) AS value FROM (" + " UNION ALL ".join(parts) + ")"


_SEGMENT_FREQ = """
sf AS MATERIALIZED (
  SELECT segment, n AS frequency, n * 100.0 / sum(n) OVER () AS percent, CAST(sum(n) OVER (ORDER BY segment) AS BIGINT) AS cum_frequency,
         sum(n) OVER (ORDER BY segment) * 100.0 / sum(n) OVER () AS cum_percent
  FROM (SELECT segment, count(*) AS n FROM seg GROUP BY 1))"""

_CHI2 = f"""
ce AS MATERIALIZED (
  SELECT r.is_repeat, c.preferred_payment, count(x.is_repeat) AS observed, any_value(rn) * any_value(cn) / any_value(n) AS expected
  FROM (SELECT is_repeat, count(*) AS rn FROM cf GROUP BY 1) r
  JOIN (SELECT preferred_payment, count(*) AS cn FROM cf GROUP BY 1) c ON true
  LEFT JOIN cf x ON x.is_repeat = r.is_repeat AND x.preferred_payment = c.preferred_payment,
  (SELECT count(*) AS n FROM cf) GROUP BY 1, 2),
chi_sum AS (
  SELECT CAST(sum(observed) AS BIGINT) AS n, (count(DISTINCT is_repeat) - 1) * (count(DISTINCT preferred_payment) - 1) AS df,
         least(count(DISTINCT is_repeat), count(DISTINCT preferred_payment)) - 1 AS dim,
         sum((observed - expected) ** 2 / expected) AS plain,
         sum((abs(observed - expected) - least(0.5, abs(observed - expected))) ** 2 / expected) AS yates
  FROM ce),
chi AS MATERIALIZED (
  SELECT n, chi2, df, {chi2_tail('chi2', 'df')} AS p, sqrt(chi2 / (n * dim)) AS cramers_v
  FROM (SELECT *, CASE WHEN df = 1 THEN yates ELSE plain END AS chi2 FROM chi_sum))"""


def _two_way() -> str:
    """Type II sums in closed form: one factor has two levels, so its column is centred within the other's levels."""
    lines = [("'is_repeat'", "ss_a"), ("'preferred_payment'", "ss_add - ss_only_a"), ("'is_repeat:preferred_payment'", "ss_cells - ss_add")]
    ranks = {"'is_repeat'": "1", "'preferred_payment'": "kb - 1", "'is_repeat:preferred_payment'": "cells - kb - 1"}
    rows = " UNION ALL ".join(
        f"SELECT {name} AS effect, {ss} AS sum_sq, CAST({ranks[name]} AS DOUBLE) AS df, ({ss}) / ({ranks[name]}) / (sse / rdf) AS f, rdf FROM tw"
        for name, ss in lines
    )
    return f"""SELECT effect, round(sum_sq, -3) AS sum_sq, df, round(f, 6) AS f, round(p, 6) AS p, p < 0.05 AS significant
FROM (SELECT *, {f_tail('f', 'df', 'rdf')} AS p FROM ({rows}))
UNION ALL SELECT 'residual', round(sse, -3), CAST(rdf AS DOUBLE), NULL, NULL, NULL FROM tw"""


_TWO_WAY = """
wd AS MATERIALIZED (
  SELECT is_repeat AS a, preferred_payment AS b, avg_order_value AS y, is_repeat - avg(is_repeat) OVER (PARTITION BY preferred_payment) AS ra
  FROM cf WHERE avg_order_value IS NOT NULL),
wc AS MATERIALIZED (
  SELECT *, avg(y) OVER (PARTITION BY a) AS ma, avg(y) OVER (PARTITION BY b) AS mb, avg(y) OVER (PARTITION BY a, b) AS mc,
         avg(y) OVER () AS m FROM wd),
tw AS MATERIALIZED (
  SELECT sum((y - m) * ra) ** 2 / sum(ra * ra) AS ss_a, sum((mb - m) ** 2) + sum((y - m) * ra) ** 2 / sum(ra * ra) AS ss_add,
         sum((ma - m) ** 2) AS ss_only_a, sum((mc - m) ** 2) AS ss_cells, sum((y - mc) ** 2) AS sse,
         count(DISTINCT b) AS kb, count(DISTINCT (a, b)) AS cells, count(*) - count(DISTINCT (a, b)) AS rdf
  FROM wc)"""



def _queries() -> dict[str, str]:
    q: dict[str, str] = {}
    q["row_counts"] = q["csv_row_counts"] = _with(
        " UNION ALL ".join(
            f"SELECT '{n}' AS \"table\", count(*) AS n FROM {t}"
            for n, t in (("orders", "t_orders"), ("customers", "t_customers"), ("order_items", "t_items"), ("order_reviews", "t_reviews"),
                         ("order_payments", "t_payments"), ("products", "t_products"), ("translation", "t_translation"))
        )
    )
    q["order_summary"] = _with("SELECT order_id, round(total_price, 6) AS total_price, round(total_freight, 6) AS total_freight, item_count FROM o_items")
    q["order_review"] = _with("SELECT order_id, round(review_score, 6) AS review_score FROM o_reviews")
    q["order_payment"] = _with(
        "SELECT order_id, round(payment_installments, 6) AS payment_installments, round(payment_value, 6) AS payment_value, payment_type FROM o_payments"
    )
    q["order_top_category"] = _with("SELECT * FROM o_category")
    doubles = ["avg_delay_days", "avg_freight_ratio", "avg_review_score", "avg_payment_installments", "avg_order_value", "total_spent", "avg_item_count"]
    features = "SELECT * REPLACE (" + ", ".join(f"round({d} + 5e-10, {4 if d in ('avg_order_value', 'total_spent') else 6}) AS {d}" for d in doubles) + ") FROM cf"
    q["customer_features"] = q["catalog_features"] = q["csv_features"] = _with(features)
    q["feature_preview"] = _with(features + " ORDER BY customer_unique_id LIMIT 5")
    q["repeat_share"] = _with(
        "SELECT count(*) AS customers, CAST(sum(1 - is_repeat) AS BIGINT) AS single_n, CAST(sum(is_repeat) AS BIGINT) AS repeat_n, "
        "round(avg(1.0 - is_repeat), 6) AS single_share, round(avg(is_repeat), 6) AS repeat_share FROM cf"
    )
    q["segment_compare"] = _with(
        "SELECT metric, round(a, 6) AS single, round(b, 6) AS repeat, round((b - a) / a * 100, 6) AS difference_pct FROM ("
        + " UNION ALL ".join(
            f"SELECT '{m}' AS metric, avg({m}) FILTER (is_repeat = 0) AS a, avg({m}) FILTER (is_repeat = 1) AS b FROM cf"
            for m in ("avg_delay_days", "avg_freight_ratio", "avg_review_score", "avg_payment_installments", "avg_order_value")
        )
        + ")"
    )
    q["top_states"] = _with("SELECT state, count(*) AS n FROM cf WHERE state IS NOT NULL GROUP BY 1 ORDER BY n DESC, state LIMIT 10")
    for key, factor in (("state", "state"), ("category", "favorite_category"), ("payment", "preferred_payment")):
        q[f"group_describe_{key}"] = _describe_sql(factor)
        q[f"anova_{key}"] = _with(_anova_select("a"), _factor_rows(factor), _one_way("g_rows", "a"))
        q[f"box_stats_{key}"] = _with(_box("(SELECT * FROM g_rows WHERE g IS NOT NULL)", factor), _factor_rows(factor))
    q["two_way_describe"] = _with(
        "SELECT CASE is_repeat WHEN 1 THEN '回購客' ELSE '單次客' END AS repeat_label, preferred_payment, count(*) AS n, "
        "round(avg(avg_order_value), 4) AS mean, round(stddev_samp(avg_order_value), 4) AS sd "
        "FROM cf WHERE avg_order_value IS NOT NULL GROUP BY 1, 2"
    )
    q["interaction_means"] = _with(
        "SELECT preferred_payment, round(avg(avg_order_value) FILTER (is_repeat = 0), 4) AS single_mean, "
        "round(avg(avg_order_value) FILTER (is_repeat = 1), 4) AS repeat_mean FROM cf WHERE avg_order_value IS NOT NULL GROUP BY 1"
    )
    q["crosstab_repeat_payment"] = _with(
        "SELECT preferred_payment, count(*) FILTER (is_repeat = 0) AS single_n, count(*) FILTER (is_repeat = 1) AS repeat_n FROM cf GROUP BY 1"
    )
    three = [
        _factor_rows("state", "r1"), _one_way("r1", "a1"), _factor_rows("favorite_category", "r2"), _one_way("r2", "a2"),
        _factor_rows("preferred_payment", "r3"), _one_way("r3", "a3"),
    ]
    q["report_long"] = _with(_report_rows(), SEGMENTS, _SEGMENT_FREQ, _CHI2, *three)
    q["anova_summary"] = _with(
        " UNION ALL ".join(
            f"SELECT '{n}' AS factor, round(f, 6) AS f, round(p, 6) AS p, round(eta_squared, 6) AS eta_squared, p < 0.05 AS significant "
            f"FROM (SELECT *, {f_tail('f', 'df_between', 'df_within')} AS p FROM {a})"
            for n, a in (("state", "a1"), ("favorite_category", "a2"), ("preferred_payment", "a3"))
        ),
        *three,
    )
    # segments
    q["fm_metrics"] = _with("SELECT customer_unique_id, frequency, round(monetary, 6) AS monetary FROM fm", SEGMENTS)
    q["fm_medians"] = _with("SELECT round(m, 6) AS median_monetary, CAST(f AS DOUBLE) AS median_frequency FROM med", SEGMENTS)
    q["fm_segments"] = _with("SELECT customer_unique_id, frequency, round(monetary, 6) AS monetary, segment FROM seg", SEGMENTS)
    q["segment_freq"] = _with(
        "SELECT segment, frequency, round(percent, 4) AS percent, cum_frequency, round(cum_percent, 4) AS cum_percent FROM sf", SEGMENTS, _SEGMENT_FREQ
    )
    q["target_top20"] = _with(
        f"SELECT customer_unique_id, frequency, round(monetary, 6) AS monetary, segment FROM seg WHERE segment = '{HIGH}' "
        "ORDER BY customer_unique_id LIMIT 20",
        SEGMENTS,
    )
    q["popular_categories"] = _with("SELECT * FROM pop", SEGMENTS)
    q["popular_top10"] = _with("SELECT * FROM pop ORDER BY buy_count DESC, category LIMIT 10", SEGMENTS)
    q["rated_products"] = _with("SELECT category, product_id, sales, round(avg_rating, 6) AS avg_rating FROM rated", SEGMENTS, _rated(10, 3.3, 5))
    q["recommendations"] = _with(_RANKED, SEGMENTS, _rated(3, 3.3, 5))
    q["recommendations_delivered"] = _with(
        _RANKED, SEGMENTS, _rated(3, 3.0, 3, "JOIN t_orders o ON o.order_id = a.order_id AND o.order_status = 'delivered'")
    )
    # correlation
    q["pearson_matrix"] = _with("SELECT var_x, var_y, round(r, 6) AS r FROM pe", _pearson())
    q["pearson_frequency"] = _with(_pearson_target("frequency"))
    q["pearson_value"] = _with(_pearson_target("avg_order_value"))
    q["spearman_matrix"] = _with("SELECT var_x, var_y, round(r, 6) AS r FROM sp", _spearman())
    q["corr_compare"] = _with(
        "SELECT pe.var_y AS variable, round(pe.r, 6) AS pearson, round(sp.r, 6) AS spearman FROM pe JOIN sp USING (var_x, var_y) "
        "WHERE var_x = 'avg_order_value' AND var_y <> 'avg_order_value'",
        _pearson(), _spearman(),
    )
    # groups
    q["levene_state"], q["levene_payment"] = _levene_sql("state"), _levene_sql("preferred_payment")
    q["kruskal_state"], q["kruskal_category"] = _kruskal_sql("state"), _kruskal_sql("favorite_category")
    q["tukey_stats_state"], q["tukey_stats_payment"] = _tukey_sql("state"), _tukey_sql("preferred_payment")
    q["tukey_gated_state"], q["tukey_gated_payment"] = _tukey_pairs_sql("state"), _tukey_pairs_sql("preferred_payment")  # open gates
    q["tukey_closed_state"] = _tukey_pairs_sql("state", tail="WHERE (SELECT count(*) FROM s) < 0")  # no test passes at 0
    q["tukey_rejected_state"] = _tukey_pairs_sql(
        "state", more=", (SELECT count(*) FROM pq WHERE p < 0.9) AS rejected, (SELECT count(*) FROM pq) AS pairs",
        tail="WHERE p < 0.9 ORDER BY group1, group2 LIMIT 3",
    )
    q["tukey_pairs_state"], q["tukey_pairs_payment"] = _tukey_pairs_sql("state"), _tukey_pairs_sql("preferred_payment")
    q["two_way_anova"] = _with(_two_way(), _TWO_WAY)
    q["contingency"] = _with("SELECT is_repeat, preferred_payment, observed, round(expected, 6) AS expected FROM ce", _CHI2)
    q["chi2_repeat_payment"] = _with(
        "SELECT n, round(chi2, 6) AS chi2, df, round(p, 6) AS p, round(cramers_v, 6) AS cramers_v, p < 0.05 AS significant FROM chi", _CHI2
    )
    # linear regression
    q["vif"] = _with(
        "SELECT term AS variable, round(v * n, 6) AS vif, v * n > 10 AS collinear FROM slope JOIN sol ON sol.i = slope.j "
        f"AND sol.j = slope.j + {_K + 1}, mom",
        *_OLS,
    )
    coefficients = (*_OLS, _se(), _COEF)
    q["ols_condition"] = _with(
        "SELECT n, round(sqrt(g.top * h.top), 1) AS condition_number FROM mom, gram_top g, inv_top h",
        *_OLS, _se(), _CONDITION, _dominant("gram"), _dominant("ginv"), "\ngram_top AS (SELECT top FROM gram_value)",
        "\ninv_top AS (SELECT top FROM ginv_value)",
    )
    q["ols_coefficients"] = _with(
        "SELECT term, round(b, 3) AS b, round(se, 3) AS std_error, round(t, 5) AS t, round(p, 5) AS p, round(lower, 2) AS lower, "
        f"round(upper, 2) AS upper, {_mark('p')} AS mark, round(beta, 5) AS beta FROM co",
        *coefficients,
    )
    q["ols_significant"] = _with(
        "SELECT term, round(b, 3) AS b, CASE WHEN b > 0 THEN 'positive' ELSE 'negative' END AS direction FROM co WHERE p < 0.05 AND term <> 'intercept'",
        *coefficients,
    )
    q["ols_coefficient_arms"] = _with(
        f"SELECT term, round(b, 3) AS b, round(b - lower, 1) AS arm_low, round(upper - b, 1) AS arm_high, {_mark('p')} AS mark "
        "FROM co WHERE term <> 'intercept'",
        *coefficients,
    )
    q["ols_fit"] = _with(
        f"""SELECT n, round(r2, 6) AS r_squared, round(1 - (1 - r2) * (n - 1) / rdf, 6) AS adj_r_squared, round(f, 4) AS f,
  round({f_tail('f', f'{_K}.0', 'rdf')}, 6) AS f_p, round(ll, 4) AS log_likelihood, round(-2 * ll + {2 * (_K + 1)}, 4) AS aic,
  round(-2 * ll + ln(n) * {_K + 1}, 4) AS bic
FROM (SELECT *, (r2 / {_K}) / ((1 - r2) / rdf) AS f, -n / 2.0 * (ln(2 * pi()) + ln(sse / n) + 1) AS ll FROM fit)""",
        *_OLS,
    )
    q["ols_residual_stats"] = _with(
        f"""SELECT n, abs(round(mean, 3)) AS abs_mean, round(sd, 3) AS sd, round(skew, 5) AS skew, round(kurtosis, 5) AS kurtosis,
  round(omnibus, 4) AS omnibus, round({chi2_tail('omnibus', '2.0')}, 5) AS omnibus_p, round(jb, 3) AS jarque_bera,
  round({chi2_tail('jb', '2.0')}, 5) AS jarque_bera_p
FROM (SELECT *, n / 6e0 * (skew ** 2 + (kurtosis - 3) ** 2 / 4) AS jb, zs ** 2 + zk ** 2 AS omnibus FROM rz)""",
        *_OLS,
        """
rm AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(e) AS mean, stddev_samp(e) AS sd,
         avg((e - m) ** 3) / var_pop(e) ** 1.5 AS skew, avg((e - m) ** 4) / var_pop(e) ** 2 AS kurtosis
       FROM res, (SELECT avg(e) AS m FROM res)),
ra AS (SELECT *, skew * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y,
         sqrt(2 * (3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) - 1)) - 1 AS w2,
         (kurtosis - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))) AS x,
         6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS sb
       FROM rm),
rb AS (SELECT *, 6 + 8 / sb * (2 / sb + sqrt(1 + 4 / sb ** 2)) AS a, y / sqrt(2 / (w2 - 1)) AS yy FROM ra),
rz AS (SELECT CAST(n AS BIGINT) AS n, mean, sd, skew, kurtosis, ln(yy + sqrt(yy * yy + 1)) / sqrt(0.5 * ln(w2)) AS zs,
         (1 - 2 / (9 * a) - cbrt((1 - 2 / a) / (1 + x * sqrt(2 / (a - 4))))) / sqrt(2 / (9 * a)) AS zk
       FROM rb)""",
    )
    q["durbin_watson"] = _with(
        "SELECT round(sum((e - l) ** 2) / sum(e * e), 6) AS durbin_watson FROM (SELECT e, lag(e) OVER (ORDER BY id) AS l FROM res)", *_OLS
    )
    q["residual_hist"] = _with(
        "SELECT CAST(bin AS INT) AS bin, round(lo + bin * wd, 2) AS bin_from, round(lo + (bin + 1) * wd, 2) AS bin_to, count(*) AS n "
        "FROM (SELECT least(floor((e - lo) / wd), 49) AS bin, lo, wd FROM res, (SELECT min(e) AS lo, (max(e) - min(e)) / 50 AS wd FROM res)) "
        "GROUP BY bin, lo, wd",
        *_OLS,
    )
    q["box_stats_residual"] = _with(_box("(SELECT e AS y FROM res)", "", 3, "0"), *_OLS)
    q["qq_points"] = _with("SELECT i, round(residual, 2) AS residual, round(theoretical, 6) AS theoretical FROM qq", *_OLS, _QQ)
    q["qq_fit"] = _with(
        "SELECT round(regr_slope(residual, theoretical), 3) AS slope, round(regr_intercept(residual, theoretical), 3) AS intercept, "
        "round(corr(theoretical, residual), 6) AS r FROM qq",
        *_OLS, _QQ,
    )
    q["residual_scatter"] = _with(
        "SELECT id AS customer_unique_id, round(fitted, 2) AS fitted, round(e, 2) AS residual FROM res "
        f"ORDER BY {_HASH.format(key='id')}, id LIMIT 50",
        *_OLS,
    )
    q["scatter_sample"] = _with(
        "SELECT customer_unique_id, frequency, round(avg_review_score + 5e-10, 6) AS avg_review_score, "
        "round(avg_delay_days + 5e-10, 6) AS avg_delay_days, round(avg_freight_ratio + 5e-10, 6) AS avg_freight_ratio, "
        "round(avg_order_value + 5e-10, 4) AS avg_order_value FROM cf "
        f"ORDER BY {_HASH.format(key='customer_unique_id')}, customer_unique_id LIMIT 50"
    )
    train, fitted = _ols("h0", "h")
    q["ols_holdout"] = _with(
        "SELECT part, count(*) AS n, round(1 - sum(e * e) / (var_pop(y) * count(*)), 6) AS r_squared, round(sqrt(avg(e * e)), 3) AS rmse, "
        "round(avg(abs(e)), 3) AS mae FROM hs GROUP BY 1",
        OLS_DATA,
        f"\nhd AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY {_HASH.format(key='id')}, id) <= ceil(count(*) OVER () * 30 / 100.0) AS test FROM d)",
        "\nh0 AS MATERIALIZED (SELECT * FROM hd WHERE NOT test)",
        train,
        f"\nhs AS (SELECT CASE WHEN test THEN 'test' ELSE 'train' END AS part, y, y - ({fitted}) AS e FROM hd, hwide)",
    )
    # logistic regression
    logit = (LOGIT_DATA, _long("ll", "ld", LOGIT_X), "\nlr AS (SELECT id, y, 1e0 AS w FROM ld)", _newton("c", "lr", 0.0))
    scale = " UNION ALL ".join(
        f"SELECT {j} AS j, '{x}' AS term, avg({x}) AS m, stddev_pop({x}) AS s FROM ld" for j, x in enumerate(LOGIT_X, 2)
    )
    odds = (
        *logit,
        f"""
lm AS (SELECT 1 AS j, 'intercept' AS term, NULL AS m, NULL AS s UNION ALL {scale}),
cov AS MATERIALIZED (SELECT i, j - {_L + 1} AS j, v FROM cs8 WHERE j > {_L + 1} AND j < {2 * _L + 3}),
ld_load AS (SELECT j AS i, CASE WHEN j = 1 THEN 1e0 ELSE -m / s END AS c FROM lm),
lo AS MATERIALIZED (
  SELECT term, b / s AS b, sqrt(v) / s AS se FROM lm JOIN cb9 USING (j) JOIN cov ON cov.i = lm.j AND cov.j = lm.j WHERE lm.j > 1
  UNION ALL
  SELECT 'intercept', (SELECT sum(b * c) FROM cb9 JOIN ld_load ON i = j), (SELECT sqrt(sum(a.c * b.c * v)) FROM cov
    JOIN ld_load a ON a.i = cov.i JOIN ld_load b ON b.i = cov.j)),
lp AS MATERIALIZED (SELECT *, {normal_two_sided('b / se')} AS p FROM lo)""",
    )
    q["logit_odds"] = _with(
        f"SELECT term, round(b, 6) AS b, round(se, 6) AS std_error, round((b / se) ** 2, 5) AS wald, round(p, 6) AS p, round(exp(b), 5) AS odds_ratio, "
        f"round(exp(b - {_Z975} * se), 5) AS lower, round(exp(b + {_Z975} * se), 3) AS upper, {_mark('p')} AS mark FROM lp",
        *odds,
    )
    q["logit_changes"] = _with(
        "SELECT term, round(exp(b), 5) AS odds_ratio, CASE WHEN b > 0 THEN 'increase' ELSE 'decrease' END AS direction, "
        "round(abs(exp(b) - 1) * 100, 5) AS change_pct FROM lp WHERE p < 0.9 AND term <> 'intercept'",
        *odds,
    )
    q["logit_odds_arms"] = _with(
        f"SELECT term, round(exp(b), 5) AS odds_ratio, round(exp(b) - exp(b - {_Z975} * se), 5) AS arm_low, "
        f"round(exp(b + {_Z975} * se) - exp(b), 3) AS arm_high, {_mark('p')} AS mark FROM lp WHERE term <> 'intercept'",
        *odds,
    )
    q["model_rows"] = _with(
        "SELECT (SELECT count(*) FROM cf) AS all_rows, count(*) AS complete_rows, (SELECT count(*) FROM cf) - count(*) AS dropped_rows, "
        "count(*) FILTER (y = 0) AS single_n, count(*) FILTER (y = 1) AS repeat_n, round(avg(y), 6) AS repeat_share FROM ld",
        LOGIT_DATA,
    )
    q["logit_fit"] = _with(
        f"""SELECT n, round(1 - ll / l0, 5) AS mcfadden_r2, round(ll, 5) AS log_likelihood, round(l0, 5) AS null_log_likelihood,
  round(2 * (ll - l0), 5) AS lr_chi2, round({chi2_tail('(2 * (ll - l0))', f'{_L}.0')}, 5) AS lr_p, round(-2 * ll + {2 * (_L + 1)}, 5) AS aic,
  round(-2 * ll + ln(n) * {_L + 1}, 5) AS bic, TRUE AS converged FROM lf""",
        *logit,
        """
lf AS (SELECT count(*) AS n, sum(y * eta - greatest(eta, 0) - ln(1 + exp(-abs(eta)))) AS ll,
              sum(y) * ln(avg(y)) + sum(1 - y) * ln(1 - avg(y)) AS l0 FROM cp8)""",
    )
    all_rows = "\nar AS (SELECT customer_unique_id AS id, is_repeat AS y FROM cf)"
    q["holdout_split"] = _with("SELECT id AS customer_unique_id, y AS is_repeat, is_test FROM sp", all_rows, _stratified("ar", "sp"))
    q["plain_split"] = _with(
        f"SELECT customer_unique_id, CAST(row_number() OVER (ORDER BY {_HASH.format(key='customer_unique_id')}, customer_unique_id) "
        "<= ceil(count(*) OVER () * 30 / 100.0) AS INT) AS is_test FROM cf"
    )
    draw = "('0x' || substr(" + _HASH.format(key="customer_unique_id") + ", 1, 8))::BIGINT"
    q["sampled_split"] = _with(
        f"SELECT customer_unique_id, is_repeat, CAST({draw} < CASE is_repeat WHEN 0 THEN 1288490189 ELSE 2147483648 END AS INT) AS is_test FROM cf"
    )
    q["sampled_shares"] = _with(
        f"""SELECT is_repeat, n, test_n, round(100.0 * test_n / n, 6) AS percent,
  round(100 * sqrt(test_n * 1e0 / n * (1 - test_n * 1e0 / n) / n), 6) AS percent_sd
FROM (SELECT is_repeat, count(*) AS n, count(*) FILTER ({draw} < 1288490189) AS test_n FROM cf GROUP BY 1)"""
    )
    q["stratified_folds"] = _with("SELECT id AS customer_unique_id, y AS is_repeat, fold FROM fo", all_rows, _folds("ar", "fo"))
    q["class_weights"] = _with(
        "SELECT y AS is_repeat, count(*) AS n, round((SELECT count(*) FROM sp WHERE is_test = 0) / (2.0 * count(*)), 6) AS weight "
        "FROM sp WHERE is_test = 0 GROUP BY 1",
        LOGIT_DATA, _stratified("ld", "sp"),
    )
    q["classifier_scores"] = _with(
        "SELECT id AS customer_unique_id, round(score, 6) AS score, CAST(score > 0.5 AS INT) AS predicted FROM sc", *_CLASSIFIER
    )
    q["confusion"] = _with("SELECT * FROM cm", *_CLASSIFIER, _PREDICTED, _confusion("pr"))
    q["class_report"] = _with(_REPORT, *_CLASSIFIER, _PREDICTED, _confusion("pr"), _PER_CLASS)
    curve = (*_CLASSIFIER, _curve("sc", "score"))
    q["roc_curve"], q["pr_curve"], q["pr_auc"] = _with(_ROC, *curve), _with(_PR, *curve), _with(_PR_AUC, *curve)
    q["roc_polyline"], q["roc_polyline_straight"] = _with(_REPEATED, *curve, _STEPS_AROUND), _with(_STRAIGHT, *curve, _STEPS_AROUND)
    q["roc_auc"] = _with(f"SELECT round({_AUC}, 6) AS roc_auc FROM {_LAGS}", *curve)
    q["youden"] = _with(
        "SELECT round(score, 6) AS threshold, round(tp / np, 6) AS sensitivity, round(1 - fp / nn, 6) AS specificity "
        "FROM cu ORDER BY tp * nn - fp * np DESC, score DESC LIMIT 1",
        *curve,
    )
    tied = (_FEATURE_SCORES, _curve("fs", "s"))
    q["roc_curve_tied"], q["pr_auc_tied"] = _with(_ROC, *tied), _with(_PR_AUC, *tied)
    q["roc_polyline_tied"] = _with(_STRAIGHT, *tied, _STEPS_AROUND)
    folds = _fold_auc()
    q["fold_auc"] = _with("SELECT CAST(fold AS INT) AS fold, round(roc_auc, 6) AS roc_auc FROM fa", *folds)
    q["cv_auc"] = _with("SELECT round(avg(roc_auc), 6) AS mean_auc, round(2 * stddev_pop(roc_auc), 6) AS two_sd, count(*) AS folds FROM fa", *folds)
    # tree
    grown = _tree()
    q["tree_rules"] = _with(
        "SELECT node, depth, CASE WHEN isinf(cut) THEN feature || ' is known' WHEN feature IS NOT NULL THEN printf('%s <= %.3f', feature, cut) END AS rule, "
        "feature, round(cut, 6) AS threshold, CASE WHEN ml THEN 'left' WHEN NOT ml THEN 'right' END AS missing, "
        "round(gini, 6) AS gini, n0, n1, prediction FROM tree",
        *grown,
    )
    q["tree_importance"] = _with(
        "SELECT CAST(row_number() OVER (ORDER BY importance DESC, feature) AS INT) AS rank, feature, round(importance, 6) AS importance FROM ("
        "SELECT x AS feature, coalesce(sum(gain) / (SELECT sum(p.w * p.gini - l.w * l.gini - r.w * r.gini) FROM tree p "
        "JOIN tree l ON l.node = 2 * p.node JOIN tree r ON r.node = 2 * p.node + 1), 0) AS importance "
        f"FROM (SELECT unnest({LOGIT_X}) AS x) LEFT JOIN (SELECT p.feature AS f, p.w * p.gini - l.w * l.gini - r.w * r.gini AS gain "
        "FROM tree p JOIN tree l ON l.node = 2 * p.node JOIN tree r ON r.node = 2 * p.node + 1) ON f = x GROUP BY 1)",
        *grown,
    )
    tested = (*grown, *_tree_scored(), _confusion("pr"))
    q["tree_confusion"] = _with("SELECT * FROM cm", *tested)
    q["tree_report"] = _with(_REPORT, *tested, _PER_CLASS)
    return q


def star_oracle() -> dict[str, str]:
    """SQL for every registered query that plain SQL can express."""
    return _queries()
