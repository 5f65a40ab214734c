"""Independent SQL for the registered queries, for an engine with ASOF joins."""

from __future__ import annotations

_K = """TRY_CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT)"""


def _event_view(kind: str) -> str:
    return f"""ev_{kind} AS (
  SELECT CAST(user_id AS VARCHAR) AS entity_key, ts AS event_timestamp, value, {_K} AS k
  FROM events WHERE event_type = '{kind}')"""


_SPINE = """spine AS (
  SELECT CAST(user_id AS VARCHAR) AS entity_key, ts AS event_timestamp, event_id
  FROM events WHERE event_type = 'purchase')"""

_VIEWS = ", ".join(_event_view(k) for k in ("view", "click", "error"))

_SPARSE = f"""sparse AS (
  SELECT CAST(user_id AS VARCHAR) AS entity_key, ts AS event_timestamp,
         CASE WHEN event_id % 3 <> 0 THEN value END AS value, {_K} AS k
  FROM events WHERE event_type = 'view')"""


def _ttl(view: str, feature: str, base: str = "s") -> str:
    return (
        f"CASE WHEN epoch_us({base}.event_timestamp) - epoch_us({view}.event_timestamp)"
        f" <= 86400000000 THEN {view}.{feature} END"
    )


def _multi(base: str, extra: str) -> str:
    """Three chained ASOF joins with TTL on the rows of ``base``."""
    return f"""SELECT {extra},
       {_ttl("ev_view", "value")} AS "ev_view:value", {_ttl("ev_view", "k")} AS "ev_view:k",
       {_ttl("ev_click", "value")} AS "ev_click:value",
       {_ttl("ev_error", "value")} AS "ev_error:value"
FROM {base} s
ASOF LEFT JOIN ev_view ON s.entity_key = ev_view.entity_key
  AND s.event_timestamp >= ev_view.event_timestamp
ASOF LEFT JOIN ev_click ON s.entity_key = ev_click.entity_key
  AND s.event_timestamp >= ev_click.event_timestamp
ASOF LEFT JOIN ev_error ON s.entity_key = ev_error.entity_key
  AND s.event_timestamp >= ev_error.event_timestamp"""


def _r(expr: str, digits: int) -> str:
    return f"(round_even(({expr}) * 1e{digits}, 0) / 1e{digits})"


_LATEST_CELLS = """
       arg_max(value, event_timestamp) FILTER (WHERE value IS NOT NULL) AS value,
       max(event_timestamp) FILTER (WHERE value IS NOT NULL) AS value_ts,
       arg_max(k, event_timestamp) FILTER (WHERE k IS NOT NULL) AS k,
       max(event_timestamp) FILTER (WHERE k IS NOT NULL) AS k_ts"""

_NOW = "TIMESTAMP '2024-01-31 00:00:00'"
_SPLIT = "TIMESTAMP '2024-01-16 00:00:00'"


def _alive(view: str, feature: str) -> str:
    return (
        f"CASE WHEN epoch_us({_NOW}) - epoch_us({view}.{feature}_ts) <= 86400000000"
        f" THEN {view}.{feature} END AS \"ev_{view[2:]}:{feature}\""
    )


_STATES = ", ".join(
    f"l_{k} AS (SELECT entity_key, {_LATEST_CELLS} FROM ev_{k} GROUP BY entity_key)"
    for k in ("view", "click", "error")
)

_DAY = "PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL {} PRECEDING AND CURRENT ROW"


def _fraud(name: str = "fraud", where: str = "") -> str:
    """User activity and risk per event, with the transformed features."""
    return f"""raw_fraud AS (
  SELECT event_id, CAST(user_id AS VARCHAR) AS entity_key, ts AS event_timestamp,
         COUNT(*) OVER ({_DAY.format("6 HOURS")}) AS tx_count_10m,
         COUNT(*) OVER ({_DAY.format("1 DAY")}) AS tx_count_1h,
         CAST(SUM(CAST(value AS DECIMAL(20,6))) OVER ({_DAY.format("1 DAY")}) AS DOUBLE)
           AS tx_amount_1h,
         CASE WHEN event_id % 50 <> 0 THEN value / 4e2 END AS risk_score,
         1e0 - CAST({_K} AS DOUBLE) / 1e2 AS device_trust_score,
         event_type = 'error' AS is_vpn
  FROM events {where}),
{name} AS (
  SELECT *,
    {_r("CAST(tx_count_10m AS DOUBLE) / greatest(CAST(tx_count_1h AS DOUBLE), 1e0)", 4)}
      AS velocity_ratio,
    {_r("coalesce(risk_score, 1e-1) * (1e0 - coalesce(device_trust_score, 9e-1) * 5e-1)", 4)}
      AS composite_risk
  FROM raw_fraud)"""


_FRAUD = _fraud()

_MERCHANT = f"""raw_merchant AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS entity_key,
         CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS event_timestamp,
         CAST(COUNT(*) FILTER (WHERE l_returnflag = 'R') AS DOUBLE) / COUNT(*)
           AS chargeback_rate,
         CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))
                  * (CAST(1 AS DECIMAL(5,2)) - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE)
           AS volume_30d,
         l_suppkey % 5 = 0 AS high_risk_country
  FROM lineitem GROUP BY l_suppkey, date_trunc('month', l_shipdate)),
merchant AS (
  SELECT *, {_r("chargeback_rate * sqrt(volume_30d) / 1e2", 4)} AS exposure_score
  FROM raw_merchant)"""

_CLV = """clv AS (
  SELECT CAST(o_custkey AS VARCHAR) AS entity_key, max(o_orderdate) AS event_timestamp,
         COUNT(*) AS total_orders_count,
         CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_spend_amount,
         1e0 / (1e0 + COUNT(*) / 1e1) AS churn_probability,
         CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*) AS avg_basket_value
  FROM orders GROUP BY o_custkey)"""

# The inference log: served values with planted differences, one row per value.
_LOGGED = "CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 10 = 0 THEN {0} + 1e0 WHEN event_id % 7 = 0 THEN {0} + 5e-6 ELSE {0} END"


def _checked(ref: str, changed: bool) -> str:
    served = f'"{ref}"'
    online = _LOGGED.format(served) if changed else f"CAST({served} AS DOUBLE)"
    where = "WHERE event_id % 13 <> 0" if changed else ""
    return (
        f"SELECT event_id AS inference_id, entity_key, event_timestamp, '{ref}' AS feature,"
        f" {online} AS online_num, CAST({served} AS DOUBLE) AS offline_num FROM served {where}"
    )


_CHECKS = f"""{_SPINE}, {_VIEWS},
served AS ({_multi("spine", "s.entity_key, s.event_timestamp, s.event_id")}),
pairs AS ({" UNION ALL ".join([_checked("ev_view:value", True), _checked("ev_view:k", False),
                               _checked("ev_click:value", True), _checked("ev_error:value", True)])}),
checks AS (
  SELECT *, CASE WHEN online_num IS NULL AND offline_num IS NULL THEN TRUE
                 WHEN online_num IS NULL OR offline_num IS NULL THEN FALSE
                 ELSE abs(online_num - offline_num) <= 1e-5 END AS matched
  FROM pairs)"""

_PARITY = f"""SELECT COUNT(*) AS total_checks,
       COUNT(*) FILTER (WHERE matched) AS matched_features,
       COUNT(*) FILTER (WHERE NOT matched) AS mismatched_features,
       CASE WHEN COUNT(*) = 0 THEN 0e0 ELSE
         {_r("CAST(COUNT(*) FILTER (WHERE NOT matched) AS DOUBLE) / COUNT(*) * 1e2", 4)} END
         AS skew_rate_percent,
       CASE WHEN COUNT(*) = 0 THEN 1e2 ELSE
         {_r("CAST(COUNT(*) FILTER (WHERE matched) AS DOUBLE) / COUNT(*) * 1e2", 4)} END
         AS parity_rate_percent
FROM checks"""

# Population stability index from sides(feature, side, value), quantiles by row number.
_SIDES = f"""sides AS (
  SELECT event_type AS feature,
         CASE WHEN ts < {_SPLIT} THEN 'baseline' ELSE 'current' END AS side, value FROM events
  WHERE event_type IN ('view', 'click', 'signup', 'error', 'purchase'))"""
_PSI = """ordered AS (
  SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY value) - 1 AS rn,
         COUNT(*) OVER (PARTITION BY feature) AS n
  FROM sides WHERE side = 'baseline'),
spots AS (
  SELECT feature, i, (any_value(n) - 1) * (i / 1e1) AS pos, any_value(n) AS n
  FROM ordered, (SELECT unnest(range(11)) AS i) GROUP BY feature, i),
cuts AS (
  SELECT s.feature, s.i, a.value AS lo, b.value AS hi, s.pos - floor(s.pos) AS part
  FROM spots s
  JOIN ordered a ON a.feature = s.feature AND a.rn = floor(s.pos)
  JOIN ordered b ON b.feature = s.feature AND b.rn = least(floor(s.pos) + 1, s.n - 1)),
edges AS (
  SELECT DISTINCT feature,
         CASE WHEN part < 5e-1 THEN lo + (hi - lo) * part
              ELSE hi - (hi - lo) * (1e0 - part) END AS edge FROM cuts),
ranked AS (
  SELECT feature, edge, row_number() OVER (PARTITION BY feature ORDER BY edge) AS pos,
         COUNT(*) OVER (PARTITION BY feature) AS m FROM edges),
placed AS (
  SELECT v.feature, v.side,
         (SELECT COUNT(*) FROM ranked r WHERE r.feature = v.feature
            AND r.pos > 1 AND r.pos < r.m AND r.edge <= v.value) AS bucket, v.value
  FROM sides v),
sizes AS (
  SELECT feature, COUNT(*) FILTER (WHERE side = 'baseline') AS nb,
         COUNT(*) FILTER (WHERE side = 'current') AS nc,
         avg(value) FILTER (WHERE side = 'baseline') AS mb,
         avg(value) FILTER (WHERE side = 'current') AS mc
  FROM placed GROUP BY feature),
shares AS (
  SELECT p.feature, p.bucket,
         greatest(COUNT(*) FILTER (WHERE side = 'baseline') / CAST(any_value(nb) AS DOUBLE), 1e-6)
           AS e,
         greatest(COUNT(*) FILTER (WHERE side = 'current') / CAST(any_value(nc) AS DOUBLE), 1e-6)
           AS a
  FROM placed p JOIN sizes z ON z.feature = p.feature GROUP BY p.feature, p.bucket),
psi AS (
  SELECT z.feature, any_value(nb) AS nb, any_value(nc) AS nc, any_value(mb) AS mb,
         any_value(mc) AS mc,
         CASE WHEN (SELECT COUNT(*) FROM edges g WHERE g.feature = z.feature) < 2 THEN 0e0
              ELSE sum((a - e) * ln(a / e)) END AS psi
  FROM sizes z JOIN shares s ON s.feature = z.feature GROUP BY z.feature),
report AS (
  SELECT feature, round_even(psi * 1e5, 0) / 1e5 AS psi,
         round_even(mc * 1e4, 0) / 1e4 AS online_mean,
         round_even(mb * 1e4, 0) / 1e4 AS offline_mean,
         CASE WHEN psi IS NULL THEN 'TOO_FEW_VALUES' WHEN psi < 1e-1 THEN 'NORMAL'
              WHEN psi < 2e-1 THEN 'MODERATE_DRIFT' ELSE 'SIGNIFICANT_DRIFT' END AS status,
         nb AS baseline_count, nc AS current_count
  FROM (SELECT * REPLACE (CASE WHEN nb >= 10 AND nc >= 10 THEN psi END AS psi) FROM psi) AS judged)"""
_REPORT = f"""SELECT feature, psi, online_mean, offline_mean, status, baseline_count, current_count,
       {_r("abs(online_mean - offline_mean) / CASE WHEN abs(offline_mean) = 0 THEN 1e0 ELSE abs(offline_mean) END * 1e2", 2)}
         AS mean_shift_percent
FROM report"""

_RULES = f"""rules AS (
  SELECT 'schema_columns_user_fraud_features' AS rule_id,
         'Schema Columns Integrity (user_fraud_features)' AS name, 'SCHEMA' AS category,
         TRUE AS passed, 'All 10 columns present' AS expected,
         'All 11 columns present' AS observed
  UNION ALL SELECT 'schema_columns_merchant_risk_features',
         'Schema Columns Integrity (merchant_risk_features)', 'SCHEMA', FALSE,
         'All 6 columns present', 'Missing: [''exposure_score'']'
  UNION ALL SELECT 'null_check_risk_score',
         'Null Rate Check (user_fraud_features:risk_score)', 'COMPLETENESS',
         COUNT(*) = COUNT(risk_score), '0 nulls (100% complete)',
         (COUNT(*) - COUNT(risk_score)) || ' nulls out of ' || COUNT(*) || ' rows (' ||
         CAST({_r("CAST(COUNT(*) - COUNT(risk_score) AS DOUBLE) / COUNT(*) * 1e2", 2)} AS VARCHAR)
         || '%)' FROM fraud
  UNION ALL SELECT 'range_check_risk_score', 'Value Range Bounds (0.0 <= risk_score <= 1.0)',
         'VALIDITY', COUNT(*) FILTER (WHERE risk_score < 0 OR risk_score > 1) = 0,
         '0 out-of-bounds rows',
         COUNT(*) FILTER (WHERE risk_score < 0 OR risk_score > 1) || ' violating rows' FROM fraud
  UNION ALL SELECT 'range_check_device_trust',
         'Value Range Bounds (0.0 <= device_trust_score <= 1.0)', 'VALIDITY',
         COUNT(*) FILTER (WHERE device_trust_score < 0 OR device_trust_score > 1) = 0,
         '0 out-of-bounds rows',
         COUNT(*) FILTER (WHERE device_trust_score < 0 OR device_trust_score > 1)
           || ' violating rows' FROM fraud
  UNION ALL SELECT 'non_negative_tx_counts',
         'Non-Negative Counts (tx_count_10m, tx_count_1h >= 0)', 'VALIDITY',
         COUNT(*) FILTER (WHERE tx_count_10m < 0 OR tx_count_1h < 0) = 0,
         '0 negative count rows',
         COUNT(*) FILTER (WHERE tx_count_10m < 0 OR tx_count_1h < 0) || ' violating rows'
         FROM fraud
  UNION ALL SELECT 'merchant_cb_rate_bounds',
         'Merchant Chargeback Rate Bounds (0.0 <= chargeback_rate <= 1.0)', 'VALIDITY',
         COUNT(*) FILTER (WHERE chargeback_rate < 0 OR chargeback_rate > 1) = 0,
         '0 out-of-bounds rows',
         COUNT(*) FILTER (WHERE chargeback_rate < 0 OR chargeback_rate > 1) || ' violating rows'
         FROM merchant
  UNION ALL SELECT 'zero_skew_guarantee', 'Training-Serving Parity (Zero Skew Guarantee)',
         'PARITY', skew_rate_percent = 0, '0.0000% skew (100.000% parity)',
         printf('%.4f%% skew across %d checked values', skew_rate_percent, total_checks)
         FROM ({_PARITY}))"""


def _violations(feature: str, source: str, bad: str) -> str:
    return (
        f"SELECT '{feature}' AS feature, COUNT({feature}) AS checked,"
        f" COUNT(*) FILTER (WHERE {bad}) AS violations FROM {source}"
    )


def _or(column: str, default: str) -> str:
    return f"CASE WHEN {column} IS NULL OR {column} = 0 THEN {default} ELSE CAST({column} AS DOUBLE) END"


_FRAUD_IN = f"""fi AS (
  SELECT event_id, entity_key, event_timestamp, {_or("composite_risk", "15e-2")} AS r,
         {_or("tx_count_10m", "1e0")} AS n, {_or("tx_amount_1h", "5e1")} AS a,
         {_or("device_trust_score", "9e-1")} AS t, coalesce(is_vpn, FALSE) AS v
  FROM fraud)"""
_MERCHANT_IN = f"""mi AS (
  SELECT entity_key, event_timestamp, {_or("chargeback_rate", "1e-2")} AS c,
         {_or("exposure_score", "15e-1")} AS x, {_or("volume_30d", "5e4")} AS vol,
         coalesce(high_risk_country, FALSE) AS hr
  FROM merchant)"""
_CHURN_IN = f"""ci AS (
  SELECT entity_key, event_timestamp, {_or("churn_probability", "25e-2")} AS c,
         {_or("total_orders_count", "1e1")} AS o, {_or("total_spend_amount", "5e2")} AS s,
         {_or("avg_basket_value", "5e1")} AS b
  FROM clv)"""


def _logistic(z: str) -> str:
    return _r(f"1e0 / (1e0 + exp(-least(greatest({z}, -1e1), 1e1)))", 4)


def _fixed(expr: str, digits: int) -> str:
    return f"printf('%.{digits}f', {_r(expr, digits)})"


def _part(
    source: str, keys: str, feature: str, value: str, shown: str, impact: str, risky: str
) -> str:
    return (
        f"SELECT {keys}, '{feature}' AS feature, CAST({value} AS DOUBLE) AS value,"
        f" {shown} AS shown, {impact} AS impact,"
        f" CASE WHEN {risky} THEN 'risk' ELSE 'safe' END AS direction FROM {source}"
    )


def _flag_text(column: str) -> str:
    return f"CASE WHEN {column} THEN 'True' ELSE 'False' END"


_NONE = "CAST(NULL AS VARCHAR)"


def _money(expr: str) -> str:
    return f"'$' || format('{{:,.2f}}', {_r(expr, 2)})"


ORACLES: dict[str, str] = {
    "pit_single": f"""WITH {_SPINE}, {_VIEWS}
SELECT s.*, v.value AS "ev_view:value", v.k AS "ev_view:k"
FROM spine s ASOF LEFT JOIN ev_view v
  ON s.entity_key = v.entity_key AND s.event_timestamp >= v.event_timestamp""",
    "pit_ttl": f"""WITH {_SPINE}, {_VIEWS}
SELECT s.*, {_ttl("v", "value")} AS "ev_view:value", {_ttl("v", "k")} AS "ev_view:k"
FROM spine s ASOF LEFT JOIN ev_view v
  ON s.entity_key = v.entity_key AND s.event_timestamp >= v.event_timestamp""",
    "pit_multi_view": f"WITH {_SPINE}, {_VIEWS} {_multi('spine', 's.*')}",
    "pit_orders_ties": """WITH spine AS (
  SELECT CAST(c_custkey AS VARCHAR) AS entity_key, d AS event_timestamp
  FROM customer, (SELECT unnest([TIMESTAMP '1997-01-01', TIMESTAMP '1999-01-01',
                                 TIMESTAMP '2001-01-01']) AS d)),
newest AS (
  SELECT CAST(o_custkey AS VARCHAR) AS entity_key, o_orderdate AS event_timestamp,
         o_totalprice, o_orderpriority
  FROM orders
  QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey DESC) = 1)
SELECT s.*, n.o_totalprice AS "order_value:o_totalprice",
       n.o_orderpriority AS "order_value:o_orderpriority"
FROM spine s ASOF LEFT JOIN newest n
  ON s.entity_key = n.entity_key AND s.event_timestamp >= n.event_timestamp""",
    "pit_per_feature": f"""WITH {_SPINE}, {_SPARSE},
a AS (SELECT * FROM sparse WHERE value IS NOT NULL),
b AS (SELECT * FROM sparse WHERE k IS NOT NULL)
SELECT s.*, a.value AS "ev_view:value", b.k AS "ev_view:k"
FROM spine s
ASOF LEFT JOIN a ON s.entity_key = a.entity_key AND s.event_timestamp >= a.event_timestamp
ASOF LEFT JOIN b ON s.entity_key = b.entity_key AND s.event_timestamp >= b.event_timestamp""",
    "pit_row_level_nulls": f"""WITH {_SPINE}, {_SPARSE}
SELECT s.*, {_ttl("v", "value")} AS "ev_view:value", {_ttl("v", "k")} AS "ev_view:k"
FROM spine s ASOF LEFT JOIN sparse v
  ON s.entity_key = v.entity_key AND s.event_timestamp >= v.event_timestamp""",
    "entity_timeline": f"""WITH {_VIEWS}
SELECT * FROM ev_view WHERE entity_key = '7' ORDER BY event_timestamp""",
    "time_travel": f"""WITH {_VIEWS},
line AS (SELECT entity_key, event_timestamp,
                COUNT(*) OVER (PARTITION BY entity_key)
                - COUNT(*) OVER (PARTITION BY entity_key ORDER BY event_timestamp)
                  AS hidden_updates FROM ev_view)
{_multi("line", "s.*")}""",
    "latest_row": """SELECT CAST(o_custkey AS VARCHAR) AS entity_key,
       o_orderdate AS event_timestamp, o_orderkey, o_totalprice, o_orderpriority
FROM orders QUALIFY row_number() OVER
  (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""",
    "latest_values": f"""WITH {_SPARSE}
SELECT entity_key, {_LATEST_CELLS} FROM sparse GROUP BY entity_key""",
    "online_lookup": f"""WITH {_VIEWS}, {_STATES}
SELECT event_id AS request_no, CAST(user_id AS VARCHAR) AS entity_key,
       {_alive("l_view", "value")}, {_alive("l_view", "k")},
       {_alive("l_click", "value")}, {_alive("l_error", "value")}
FROM events e
LEFT JOIN l_view ON l_view.entity_key = CAST(e.user_id AS VARCHAR)
LEFT JOIN l_click ON l_click.entity_key = CAST(e.user_id AS VARCHAR)
LEFT JOIN l_error ON l_error.entity_key = CAST(e.user_id AS VARCHAR)
WHERE event_type = 'signup'""",
    "entity_all": f"WITH {_VIEWS}, {_STATES} "
    + " UNION ALL ".join(
        f"""SELECT 'ev_{k}' AS feature_view, entity_key, '{f}' AS feature,
       CAST({f} AS DOUBLE) AS num, CAST(NULL AS VARCHAR) AS text, CAST(NULL AS BOOLEAN) AS flag,
       {f}_ts AS ts FROM l_{k} WHERE entity_key = '7' AND {f} IS NOT NULL"""
        for k in ("view", "click", "error")
        for f in ("value", "k")
    ),
    "freshness": f"WITH {_VIEWS}, {_STATES}, aged AS ("
    + " UNION ALL ".join(
        f"""SELECT 'ev_{k}' AS feature_view, entity_key,
       {_r(f"(epoch_us({_NOW}) - epoch_us(greatest(value_ts, k_ts))) / 1e6", 1)} AS age_seconds,
       CAST((value IS NOT NULL)::INT + (k IS NOT NULL)::INT AS BIGINT) AS feature_count
  FROM l_{k}"""
        for k in ("view", "click", "error")
    )
    + """)
SELECT *, CAST(86400 AS BIGINT) AS ttl_seconds,
       greatest(864e2 - age_seconds, 0e0) AS ttl_remaining_seconds,
       CASE WHEN age_seconds > 86400 THEN 'EXPIRED'
            WHEN greatest(864e2 - age_seconds, 0e0) < 1728e1 THEN 'EXPIRING_SOON'
            ELSE 'FRESH' END AS status
FROM aged""",
    "append_evolve": f"""WITH {_VIEWS}
SELECT entity_key, event_timestamp, {_NOW} AS created_timestamp, value,
       CASE WHEN event_timestamp >= {_SPLIT} THEN k END AS k,
       CAST(event_timestamp AS DATE) AS event_date FROM ev_view""",
    "ingest_batch_state": f"""WITH {_VIEWS},
evolved AS (SELECT entity_key, event_timestamp, value,
                   CASE WHEN event_timestamp >= {_SPLIT} THEN k END AS k FROM ev_view)
SELECT entity_key, {_LATEST_CELLS} FROM evolved GROUP BY entity_key""",
    "backfill_state": f"""WITH {_SPARSE},
newest AS (SELECT * FROM sparse QUALIFY row_number() OVER
             (PARTITION BY entity_key ORDER BY event_timestamp DESC) = 1)
SELECT entity_key, value, CASE WHEN value IS NOT NULL THEN event_timestamp END AS value_ts,
       k, CASE WHEN k IS NOT NULL THEN event_timestamp END AS k_ts FROM newest""",
    "store_metrics": f"WITH {_VIEWS} "
    + " UNION ALL ".join(
        f"SELECT 'ev_{k}' AS feature_view, COUNT(*) AS row_count,"
        f" COUNT(DISTINCT entity_key) AS state_keys FROM ev_{k}"
        for k in ("view", "click", "error")
    ),
    "transform_fraud": f"WITH {_FRAUD} SELECT * FROM fraud",
    "transform_exposure": f"WITH {_MERCHANT} SELECT * FROM merchant",
    "transform_ratio": f"""WITH i AS (
  SELECT event_id, value AS val_a, CAST({_K} AS DOUBLE) AS val_b FROM events)
SELECT *, {_r("coalesce(val_a, 1e0) / greatest(coalesce(val_b, 1e0), 1e-3)", 4)} AS ratio
FROM i""",
    "parity_summary": f"WITH {_CHECKS} {_PARITY}",
    "parity_mismatches": f"""WITH {_CHECKS}
SELECT inference_id, entity_key, event_timestamp, feature, online_num, offline_num
FROM checks WHERE NOT matched""",
    "parity_newest": f"""WITH {_CHECKS}
SELECT inference_id, entity_key, event_timestamp, feature, online_num, offline_num
FROM checks WHERE NOT matched AND inference_id IN (
  SELECT event_id FROM spine ORDER BY event_timestamp DESC, event_id DESC LIMIT 500)
ORDER BY event_timestamp, inference_id, feature LIMIT 50""",
    "parity_drift": f"""WITH {_CHECKS},
sides AS (SELECT feature, 'baseline' AS side, offline_num AS value FROM checks
          WHERE offline_num IS NOT NULL
          UNION ALL SELECT feature, 'current', online_num FROM checks
          WHERE online_num IS NOT NULL),
{_PSI} {_REPORT}""",
    "drift_psi": f"""WITH {_SIDES}, {_PSI}
SELECT feature, round(psi, 9) AS psi, nb AS baseline_count, nc AS current_count FROM psi""",
    "drift_report": f"WITH {_SIDES}, {_PSI} {_REPORT}",
    "drift_overall": f"""WITH {_SIDES}, {_PSI}
SELECT COUNT(*) FILTER (WHERE status <> 'TOO_FEW_VALUES') AS features_monitored,
       COUNT(*) FILTER (WHERE status = 'TOO_FEW_VALUES') AS features_unjudged,
       CASE WHEN coalesce(bool_or(status LIKE '%DRIFT'), FALSE) THEN 'DRIFT_DETECTED'
            WHEN coalesce(bool_or(status = 'TOO_FEW_VALUES'), FALSE) THEN 'INCOMPLETE'
            ELSE 'NORMAL' END AS overall_status FROM report""",
    "drift_every_user": f"""WITH n AS (
  SELECT CAST(user_id AS VARCHAR) AS feature,
         COUNT(value) FILTER (WHERE ts < {_SPLIT}) AS nb, COUNT(value) FILTER (WHERE ts >= {_SPLIT}) AS nc
  FROM events WHERE user_id IS NOT NULL GROUP BY 1),
sides AS (
  SELECT CAST(user_id AS VARCHAR) AS feature,
         CASE WHEN ts < {_SPLIT} THEN 'baseline' ELSE 'current' END AS side, value FROM events
  WHERE user_id IS NOT NULL), {_PSI}
SELECT n.feature, coalesce(r.status, 'TOO_FEW_VALUES') AS status,
       n.nb AS baseline_count, n.nc AS current_count
FROM n LEFT JOIN report r USING (feature)""",
    "quality_rules": f"WITH {_FRAUD}, {_MERCHANT}, {_CHECKS}, {_RULES} SELECT * FROM rules",
    "quality_score": f"""WITH {_FRAUD}, {_MERCHANT}, {_CHECKS}, {_RULES}
SELECT COUNT(*) AS total_rules, COUNT(*) FILTER (WHERE passed) AS passed_count,
       COUNT(*) FILTER (WHERE NOT passed) AS failed_count,
       {_r("COUNT(*) FILTER (WHERE passed) / CAST(COUNT(*) AS DOUBLE) * 1e2", 1)}
         AS quality_score_percent,
       CASE WHEN bool_and(passed) THEN 'PASSED' ELSE 'WARNING' END AS status FROM rules""",
    "latency_bound": f"""WITH p AS (SELECT {_r("quantile_disc(value, 0.5)", 4)} AS p50,
  {_r("quantile_disc(value, 0.99)", 4)} AS p99 FROM events)
SELECT 'serving_latency_sla' AS rule_id,
       'Online Serving Latency SLA Bound (p50 < 0.50 ms)' AS name,
       'PERFORMANCE' AS category, p50 < 5e-1 AS passed, 'p50 latency < 0.50 ms' AS expected,
       printf('p50 = %.3f ms, p99 = %.3f ms', {_r("p50", 3)}, {_r("p99", 3)}) AS observed
FROM p""",
    "validate_features": f"WITH {_FRAUD} "
    + " UNION ALL ".join(
        [
            _violations("tx_count_10m", "fraud", "tx_count_10m < 0"),
            _violations("tx_count_1h", "fraud", "tx_count_1h < 0"),
            _violations("tx_amount_1h", "fraud", "FALSE"),
            _violations("risk_score", "fraud", "risk_score < 0 OR risk_score > 1"),
            _violations(
                "device_trust_score", "fraud", "device_trust_score < 0 OR device_trust_score > 1"
            ),
            _violations("is_vpn", "fraud", "FALSE"),
            _violations("velocity_ratio", "fraud", "FALSE"),
            _violations("composite_risk", "fraud", "FALSE"),
            _violations("embedding", "embeddings", "FALSE"),
            _violations("label", "embeddings", "label < 0 OR label > 4"),
        ]
    ),
    "valid_rows": f"""WITH {_FRAUD}
SELECT event_id, entity_key, event_timestamp, risk_score FROM fraud
WHERE (risk_score IS NULL OR risk_score BETWEEN 0 AND 1)
  AND (device_trust_score IS NULL OR device_trust_score BETWEEN 0 AND 1)""",
    "dataset_grid": f"""SELECT DISTINCT CAST(user_id AS VARCHAR) AS entity_key,
       {_NOW} - INTERVAL 4 HOURS * i AS event_timestamp
FROM events, (SELECT unnest(range(1, 7)) AS i)""",
    "dataset_json": """SELECT '{"entity_key":"' || user_id || '","event_timestamp":"' ||
       strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '","event_id":' || event_id || '}' AS json
FROM events WHERE event_type = 'purchase'""",
    "score_fraud": f"""WITH {_FRAUD}, {_FRAUD_IN}, p AS (SELECT entity_key, event_timestamp,
  {_logistic("28e-1 * r + 12e-2 * n + 6e-4 * a - 19e-1 * t + CASE WHEN v THEN 12e-1 ELSE -3e-1 END - 4e-1")}
  AS probability_score FROM fi)
SELECT *, CASE WHEN probability_score >= 65e-2 THEN 'DECLINED'
               WHEN probability_score >= 35e-2 THEN 'CHALLENGE_2FA' ELSE 'APPROVED' END AS decision
FROM p""",
    "score_merchant": f"""WITH {_MERCHANT}, {_MERCHANT_IN}, p AS (SELECT entity_key,
  event_timestamp,
  {_logistic("42e0 * c + 12e-2 * x + CASE WHEN hr THEN 16e-1 ELSE -5e-1 END - 12e-1")}
  AS probability_score FROM mi)
SELECT *, CASE WHEN probability_score >= 60e-2 THEN 'TIER_3_RESTRICTED'
               WHEN probability_score >= 30e-2 THEN 'TIER_2_MONITORED'
               ELSE 'TIER_1_PRIME' END AS decision FROM p""",
    "score_churn": f"""WITH {_CLV}, {_CHURN_IN}, p AS (SELECT entity_key, event_timestamp,
  {_r("c", 4)} AS probability_score FROM ci)
SELECT *, CASE WHEN probability_score >= 50e-2 THEN 'HIGH_CHURN_RISK'
               WHEN probability_score >= 25e-2 THEN 'MODERATE_ENGAGEMENT'
               ELSE 'LOYAL_CUSTOMER' END AS decision FROM p""",
    "score_contributions": f"WITH {_FRAUD}, {_FRAUD_IN} "
    + " UNION ALL ".join(
        [
            _part("fi", "event_id", "composite_risk", "r", _NONE,
                  f"CASE WHEN r > 3e-1 THEN '+' ELSE '' END || {_fixed('r * 45e0', 1)} || '%'",
                  "r > 3e-1"),
            _part("fi", "event_id", "tx_count_10m", "n", _NONE,
                  f"'+' || {_fixed('n * 42e-1', 1)} || '%'", "n > 3"),
            _part("fi", "event_id", "tx_amount_1h", "a", f"'$' || {_fixed('a', 2)}",
                  f"'+' || {_fixed('a * 4e-2', 1)} || '%'", "a > 200"),
            _part("fi", "event_id", "device_trust_score", "t", _NONE,
                  f"'-' || {_fixed('t * 35e0', 1)} || '%'", "FALSE"),
            _part("fi", "event_id", "is_vpn", "v", _flag_text("v"),
                  "CASE WHEN v THEN '+25.0%' ELSE '0.0%' END", "v"),
        ]
    ),
    "score_contributions_merchant": f"WITH {_MERCHANT}, {_MERCHANT_IN} "
    + " UNION ALL ".join(
        [
            _part("mi", "entity_key, event_timestamp", "chargeback_rate", "c",
                  f"{_fixed('c * 1e2', 2)} || '%'", f"'+' || {_fixed('c * 25e1', 1)} || '%'",
                  "c > 15e-3"),
            _part("mi", "entity_key, event_timestamp", "exposure_score", "x", _NONE,
                  f"'+' || {_fixed('x * 65e-1', 1)} || '%'", "x > 3"),
            _part("mi", "entity_key, event_timestamp", "volume_30d", "vol", _money("vol"),
                  "'Baseline'", "FALSE"),
            _part("mi", "entity_key, event_timestamp", "high_risk_country", "hr",
                  _flag_text("hr"), "CASE WHEN hr THEN '+30.0%' ELSE '0.0%' END", "hr"),
        ]
    ),
    "score_contributions_churn": f"WITH {_CLV}, {_CHURN_IN} "
    + " UNION ALL ".join(
        [
            _part("ci", "entity_key", "churn_probability", "c", f"{_fixed('c * 1e2', 1)} || '%'",
                  f"'+' || {_fixed('c * 6e1', 1)} || '%'", "c > 3e-1"),
            _part("ci", "entity_key", "total_orders_count", "o", _NONE,
                  f"'-' || {_fixed('o * 8e-1', 1)} || '%'", "FALSE"),
            _part("ci", "entity_key", "total_spend_amount", "s", _money("s"),
                  f"'-' || {_fixed('s * 15e-3', 1)} || '%'", "FALSE"),
            _part("ci", "entity_key", "avg_basket_value", "b", f"'$' || {_fixed('b', 2)}",
                  "'Neutral'", "FALSE"),
        ]
    ),
    "profile_percentiles": "SELECT "
    + ", ".join(
        f"{_r(f'quantile_disc(value, {p})', 4)} AS {n}"
        for n, p in (
            ("p50", "0.5"), ("p90", "0.9"), ("p95", "0.95"), ("p99", "0.99"), ("p999", "0.999")
        )
    )
    + " FROM events",
    "profile_basics": f"""SELECT COUNT(*) AS count, {_r("min(value)", 4)} AS min,
       {_r("max(value)", 4)} AS max, {_r("avg(value)", 4)} AS avg,
       {_r("COUNT(*) / greatest((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 1e-3)", 2)}
         AS rate_per_sec FROM events""",
    "profile_histogram": """WITH b(bucket_no, bucket, lo, hi) AS (VALUES
  (0, '< 0.1ms', -1e308, 1e-1), (1, '0.1 - 0.25ms', 1e-1, 25e-2),
  (2, '0.25 - 0.5ms', 25e-2, 5e-1), (3, '0.5 - 1.0ms', 5e-1, 1e0),
  (4, '1.0 - 2.0ms', 1e0, 2e0), (5, '> 2.0ms', 2e0, 1e308))
SELECT bucket_no, bucket, COUNT(e.value) AS row_count
FROM b LEFT JOIN events e ON e.value >= b.lo AND e.value < b.hi GROUP BY bucket_no, bucket""",
    "count_by_view_rows": """SELECT 'ev_' || event_type AS feature_view, COUNT(*) AS row_count
FROM events WHERE event_type IN ('view', 'click', 'error') GROUP BY event_type
UNION ALL SELECT 'order_value', COUNT(*) FROM orders""",
    "log_topk": """SELECT event_id, ts, user_id, event_type, value FROM events
ORDER BY ts DESC, event_id DESC LIMIT 100""",
    "stream_ingest_history": f"WITH {_VIEWS} SELECT * FROM ev_view",
}
ORACLES["transform_python_udf"] = ORACLES["transform_ratio"]
ORACLES["stream_latest_state"] = ORACLES["latest_values"]
ORACLES["dataset_rows"] = f"""WITH {_VIEWS}, grid AS ({ORACLES["dataset_grid"]})
{_multi("grid", "s.*")}"""
ORACLES["dataset_csv"] = ORACLES["dataset_rows"]
ORACLES["freshness_stalest"] = f"""SELECT * FROM ({ORACLES["freshness"]})
ORDER BY age_seconds DESC, feature_view, entity_key LIMIT 20"""
ORACLES["store_totals"] = f"""SELECT CAST(sum(row_count) AS BIGINT) AS total_rows,
       CAST(sum(state_keys) AS BIGINT) AS total_keys, CAST(0 AS BIGINT) AS logged_inferences
FROM ({ORACLES["store_metrics"]})"""
ORACLES["store_serving"] = f"""SELECT entity_key, {_NOW} AS event_timestamp,
       "ev_view:value", CAST("ev_view:k" AS DOUBLE) AS "ev_view:k", "ev_click:value",
       "ev_error:value" FROM ({ORACLES["online_lookup"]})"""
ORACLES["pit_bucketed"] = ORACLES["pit_multi_view"]
ORACLES["store_historical"] = ORACLES["pit_multi_view"]
ORACLES["dataset_summary"] = f"""SELECT COUNT(*) AS total_records, 4 AS features_joined
FROM ({ORACLES["dataset_rows"]})"""
ORACLES["dataset_sample"] = f"""SELECT * REPLACE
  (strftime(event_timestamp, '%Y-%m-%dT%H:%M:%S.%f') AS event_timestamp)
FROM ({ORACLES["dataset_rows"]}) ORDER BY entity_key, event_timestamp LIMIT 15"""
ORACLES["defaults_filled"] = f"""WITH {_FRAUD}
SELECT event_id, coalesce(risk_score, 1e-1) AS risk_score, is_vpn FROM fraud"""
ORACLES["stream_recent"] = f"""WITH {_VIEWS}
SELECT * FROM ev_view ORDER BY event_timestamp DESC, entity_key DESC LIMIT 30"""
ORACLES["stream_transform"] = ORACLES["transform_exposure"]
_SCORED = f"""p AS (SELECT event_id, entity_key, event_timestamp,
  {_logistic("28e-1 * r + 12e-2 * n + 6e-4 * a - 19e-1 * t + CASE WHEN v THEN 12e-1 ELSE -3e-1 END - 4e-1")}
  AS probability_score FROM fi)
SELECT *, CASE WHEN probability_score >= 65e-2 THEN 'DECLINED'
               WHEN probability_score >= 35e-2 THEN 'CHALLENGE_2FA' ELSE 'APPROVED' END AS decision
FROM p"""
ORACLES["score_as_of"] = f"""WITH {_SPINE},
{_fraud("known", "WHERE event_type <> 'purchase'")},
fraud AS (
  SELECT s.event_id, s.entity_key, s.event_timestamp,
         {", ".join(_ttl("f", c) + " AS " + c for c in ("composite_risk", "tx_count_10m", "tx_amount_1h", "device_trust_score", "is_vpn"))}
  FROM spine s ASOF LEFT JOIN known f
    ON s.entity_key = f.entity_key AND s.event_timestamp >= f.event_timestamp),
{_FRAUD_IN}, {_SCORED}"""
ORACLES["score_latest"] = f"""WITH {_CLV.replace("clv AS", "raw_clv AS")},
live AS (
  SELECT CAST(c_custkey AS VARCHAR) AS entity_key, r.event_timestamp,
         epoch_us(TIMESTAMP '2001-09-01') - epoch_us(r.event_timestamp) <= 2592000000000 AS fresh,
         r.churn_probability, r.total_orders_count, r.total_spend_amount, r.avg_basket_value
  FROM customer LEFT JOIN raw_clv r ON r.entity_key = CAST(c_custkey AS VARCHAR)),
clv AS (
  SELECT entity_key, event_timestamp,
         CASE WHEN fresh THEN churn_probability END AS churn_probability,
         CASE WHEN fresh THEN total_orders_count END AS total_orders_count,
         CASE WHEN fresh THEN total_spend_amount END AS total_spend_amount,
         CASE WHEN fresh THEN avg_basket_value END AS avg_basket_value FROM live),
{_CHURN_IN}, p AS (SELECT entity_key, {_r("c", 4)} AS probability_score FROM ci)
SELECT *, CASE WHEN probability_score >= 50e-2 THEN 'HIGH_CHURN_RISK'
               WHEN probability_score >= 25e-2 THEN 'MODERATE_ENGAGEMENT'
               ELSE 'LOYAL_CUSTOMER' END AS decision FROM p"""
ORACLES["backfill_over_state"] = ORACLES["backfill_state"]
ORACLES["state_ties"] = """SELECT CAST(o_custkey AS VARCHAR) AS entity_key, o_totalprice,
       o_orderdate AS o_totalprice_ts, o_orderpriority, o_orderdate AS o_orderpriority_ts
FROM orders QUALIFY row_number() OVER
  (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"""
ORACLES["compacted_history"] = f"""WITH {_VIEWS}
SELECT entity_key, event_timestamp, value, CASE WHEN event_timestamp >= {_SPLIT} THEN k END AS k
FROM ev_view"""
ORACLES["store_parity"] = """SELECT 4 * COUNT(*) AS total_checks, 4 * COUNT(*) AS matched_features,
       CAST(0 AS BIGINT) AS mismatched_features, 0e0 AS skew_rate_percent, 1e2 AS parity_rate_percent
FROM events WHERE event_type = 'signup'"""
ORACLES["quality_store"] = """SELECT 'schema_columns_ev_' || unnest(['view', 'click', 'error']) AS rule_id,
       unnest([TRUE, FALSE, FALSE]) AS passed, 'All 4 columns present' AS expected"""
ORACLES["rejected_rows"] = f"""WITH {_FRAUD}
SELECT event_id, entity_key, 'risk_score' AS reason FROM fraud WHERE risk_score < 0 OR risk_score > 1"""
ORACLES["dataset_csv_vector"] = """SELECT CAST(vec_id AS VARCHAR) AS entity_key,
       CAST(unnest(range(len(embedding))) AS INTEGER) AS place, CAST(unnest(embedding) AS DOUBLE) AS value
FROM embeddings"""
ORACLES["stream_totals"] = """SELECT COUNT(*) AS total_streamed FROM events WHERE event_type = 'view'"""
ORACLES["pit_as_known"] = f"""WITH {_SPINE},
late AS (
  SELECT CAST(user_id AS VARCHAR) AS entity_key, ts AS event_timestamp, event_id, value, {_K} AS k,
         ts + to_hours(CAST(event_id % 7 * 3 AS INTEGER)) AS created_timestamp
  FROM events WHERE event_type = 'view'),
found AS (
  SELECT s.*, l.event_timestamp AS feature_time, l.value, l.k FROM spine s LEFT JOIN late l
    ON s.entity_key = l.entity_key AND l.event_timestamp <= s.event_timestamp
    AND l.created_timestamp <= s.event_timestamp
  QUALIFY row_number() OVER (PARTITION BY s.event_id, s.entity_key, s.event_timestamp
    ORDER BY l.event_timestamp DESC NULLS LAST, l.created_timestamp DESC, l.event_id DESC) = 1)
SELECT entity_key, event_timestamp, event_id,
       CASE WHEN epoch_us(event_timestamp) - epoch_us(feature_time) <= 86400000000 THEN value END AS "late_view:value",
       CASE WHEN epoch_us(event_timestamp) - epoch_us(feature_time) <= 86400000000 THEN k END AS "late_view:k"
FROM found"""
_KEYED_ROWS = f"""e AS (SELECT *, {_K} AS k FROM events),
spine AS (SELECT event_id, user_id, k, ts AS event_timestamp FROM e WHERE event_type = 'purchase')"""


def _last(name: str, kind: str, same: str, ttl: str = "TRUE") -> str:
    """The last value of an event kind with the keys of the spine row, by an inequality join."""
    return f"""{name} AS (
  SELECT s.event_id, CASE WHEN {ttl} THEN e.value END AS value FROM spine s JOIN e
    ON e.event_type = '{kind}' AND {same} AND e.ts <= s.event_timestamp
  QUALIFY row_number() OVER (PARTITION BY s.event_id ORDER BY e.ts DESC, e.event_id DESC) = 1)"""


_IN_TTL = "epoch_us(s.event_timestamp) - epoch_us(e.ts) <= 86400000000"
_BOTH = _last("ui", "view", "e.user_id = s.user_id AND e.k = s.k")
ORACLES["pit_composite_key"] = f"""WITH {_KEYED_ROWS}, {_BOTH}
SELECT s.*, ui.value AS "user_item_view:value" FROM spine s LEFT JOIN ui USING (event_id)"""
ORACLES["pit_multi_entity"] = f"""WITH {_KEYED_ROWS}, {_BOTH},
{_last("c", "click", "e.user_id = s.user_id", _IN_TTL)},
{_last("i", "view", "e.k = s.k", _IN_TTL)}
SELECT s.*, c.value AS "ev_click:value", i.value AS "item_view:value", ui.value AS "user_item_view:value"
FROM spine s LEFT JOIN c USING (event_id) LEFT JOIN i USING (event_id) LEFT JOIN ui USING (event_id)"""
ORACLES["store_parity_late"] = f"""SELECT entity_key, 'ev_view:value' AS feature, "ev_view:value" AS online_num,
       1e6 + CAST(entity_key AS DOUBLE) AS offline_num
FROM ({ORACLES["online_lookup"]}) WHERE CAST(entity_key AS BIGINT) % 3 = 0"""
# The first quarter of the time range as microseconds, rounded up like the feed's parts.
ORACLES["stream_dedup"] = f"""WITH v AS (SELECT * FROM events WHERE event_type = 'view'),
r AS (SELECT min(epoch_us(ts)) AS first, (max(epoch_us(ts)) - min(epoch_us(ts))) // 4 + 1 AS quarter FROM v)
SELECT event_id, CAST(user_id AS VARCHAR) AS entity_key, ts AS event_timestamp, value, {_K} AS k,
       NOT (epoch_us(ts) - first < quarter AND event_id % 50 = 7) AS taken
FROM v CROSS JOIN r"""
ORACLES["stream_ttl_state"] = f"""WITH {_SPARSE},
alive AS (SELECT * FROM sparse WHERE epoch_us(event_timestamp) >=
  (SELECT max(epoch_us(event_timestamp)) FROM sparse) - 86400000000),
s AS (SELECT entity_key, arg_max(value, event_timestamp) FILTER (value IS NOT NULL) AS value,
             arg_max(k, event_timestamp) FILTER (k IS NOT NULL) AS k FROM alive GROUP BY entity_key)
SELECT * FROM s WHERE value IS NOT NULL OR k IS NOT NULL"""
ORACLES["sketch_quantiles"] = f"""WITH x AS (
  SELECT 'value' AS feature, count(value) FILTER (NOT isnan(value)) AS n FROM events
  UNION ALL SELECT 'k', count({_K}) FROM events)
SELECT feature, n, CAST(share AS DOUBLE) AS share, true AS within_bound
FROM x CROSS JOIN (SELECT unnest([0.1, 0.5, 0.9]) AS share) WHERE n > 0"""
ORACLES["sketch_key_overlap"] = """WITH v AS (
  SELECT DISTINCT 'ev_' || event_type AS name, user_id FROM events
  WHERE event_type IN ('view', 'click', 'error') AND user_id IS NOT NULL),
n AS (SELECT name, count(*) AS keys FROM v GROUP BY name),
b AS (SELECT a.name AS view_a, c.name AS view_b, count(*) AS both_keys
      FROM v a JOIN v c ON a.user_id = c.user_id AND a.name < c.name GROUP BY ALL)
SELECT x.name AS view_a, y.name AS view_b, x.keys AS keys_a, y.keys AS keys_b,
       coalesce(both_keys, 0) AS keys_both, x.keys + y.keys - coalesce(both_keys, 0) AS keys_any
FROM n x JOIN n y ON x.name < y.name LEFT JOIN b ON view_a = x.name AND view_b = y.name"""
ORACLES["spine_row_ids"] = f"""WITH {_SPINE}
SELECT *, row_number() OVER (ORDER BY event_timestamp, event_id) - 1 AS row_no FROM spine"""
ORACLES["lookup_in_order"] = f"""SELECT *, row_number() OVER (ORDER BY request_no) - 1 AS row_no
FROM ({ORACLES["online_lookup"]})"""
ORACLES["parity_store_all"] = """SELECT 8 * COUNT(*) AS total_checks, 8 * COUNT(*) AS matched_features,
       CAST(0 AS BIGINT) AS mismatched_features, 0e0 AS skew_rate_percent, 1e2 AS parity_rate_percent
FROM events WHERE event_type = 'signup'"""
_FRAUD_IDS = "('null_check_risk_score', 'range_check_risk_score', 'range_check_device_trust', 'non_negative_tx_counts')"
ORACLES["quality_ingested"] = f"""SELECT * FROM ({ORACLES["quality_rules"]}) WHERE rule_id IN {_FRAUD_IDS}"""
_BATCHED = f"""parts AS (SELECT *, CASE WHEN event_timestamp < {_SPLIT} THEN 'early' ELSE 'late' END AS batch FROM fraud),
counted AS (
  SELECT batch, COUNT(*) AS n, COUNT(*) FILTER (risk_score IS NULL) AS nulls,
         COUNT(*) FILTER (risk_score < 0 OR risk_score > 1) AS risk,
         COUNT(*) FILTER (device_trust_score < 0 OR device_trust_score > 1) AS trust,
         COUNT(*) FILTER (tx_count_10m < 0 OR tx_count_1h < 0) AS below
  FROM parts GROUP BY batch)"""
ORACLES["quality_per_batch"] = f"""WITH {_FRAUD}, {_BATCHED}
SELECT batch, 'null_check_risk_score' AS rule_id, nulls = 0 AS passed, nulls || ' nulls out of ' || n || ' rows (' ||
       CAST({_r("CAST(nulls AS DOUBLE) / n * 1e2", 2)} AS VARCHAR) || '%)' AS observed FROM counted
UNION ALL SELECT batch, 'range_check_risk_score', risk = 0, risk || ' violating rows' FROM counted
UNION ALL SELECT batch, 'range_check_device_trust', trust = 0, trust || ' violating rows' FROM counted
UNION ALL SELECT batch, 'non_negative_tx_counts', below = 0, below || ' violating rows' FROM counted"""
ORACLES["append_variant"] = f"""WITH v AS (
  SELECT *, ts >= {_SPLIT} AS late, CAST(event_id AS BIGINT) AS id FROM events WHERE event_type = 'view')
SELECT CAST(user_id AS VARCHAR) AS entity_key, ts AS event_timestamp,
       CASE WHEN late THEN 'STRING' ELSE 'BIGINT' END AS note_type,
       CASE WHEN late THEN 'e' || id ELSE CAST(id AS VARCHAR) END AS note,
       CASE WHEN NOT late THEN id END AS note_number,
       CASE WHEN late THEN value > 50 END AS high, CASE WHEN late THEN {_K} END AS k FROM v"""
ORACLES["store_reopened"] = ORACLES["online_lookup"]
# Badge and action of each decision.
_ACTIONS = """actions(decision, decision_badge, action_recommendation) AS (VALUES
  ('DECLINED', 'danger', 'Block transaction immediately; alert fraud ops center.'),
  ('CHALLENGE_2FA', 'warning', 'Trigger step-up biometric / SMS authentication challenge.'),
  ('APPROVED', 'success', 'Instant settlement approved under zero-friction SLA.'),
  ('TIER_3_RESTRICTED', 'danger', 'Place 14-day rolling reserve on merchant settlements.'),
  ('TIER_2_MONITORED', 'warning', 'Standard settlement with daily volume velocity caps.'),
  ('TIER_1_PRIME', 'success', 'Instant accelerated next-day settlement eligible.'),
  ('HIGH_CHURN_RISK', 'danger', 'Dispatch personalized 25% retention incentive credit.'),
  ('MODERATE_ENGAGEMENT', 'warning', 'Enroll in weekly curated product recommendation digest.'),
  ('LOYAL_CUSTOMER', 'success', 'VIP customer status. Eligible for early access concierge.'))"""
_SCORED_BY = " UNION ALL ".join(
    f"SELECT '{model}' AS model_id, entity_key, event_timestamp, probability_score, decision FROM ({ORACLES[name]})"
    for model, name in (
        ("fraud_sentinel_v2", "score_fraud"),
        ("merchant_underwriter_v1", "score_merchant"),
        ("churn_predictor_v3", "score_churn"),
    )
)
ORACLES["score_actions"] = f"""WITH {_ACTIONS}, scored AS ({_SCORED_BY})
SELECT model_id, entity_key, event_timestamp, decision_badge, action_recommendation,
       printf('%.1f%%', {_r("probability_score * 1e2", 1)}) AS probability_percent
FROM scored LEFT JOIN actions USING (decision)"""
_GROWN = f"""SELECT entity_key, event_timestamp, value, CASE WHEN event_timestamp >= {_SPLIT} THEN k END AS k FROM ev_view"""
ORACLES["grid_timeline"] = f"WITH {_VIEWS} {_GROWN} WHERE entity_key = '7'"
ORACLES["grid_range"] = f"WITH {_VIEWS} {_GROWN} WHERE event_timestamp >= {_SPLIT}"
