"""DuckDB SQL for the queries, written apart from the plans: joins and subqueries where the plans use windows and arrays."""

from __future__ import annotations

from ..functions import api, explain, features, scores
from ..operators import graph
from ..sources.adapter import EPOCH_MS, FRAUD_TYPES


def pick(index: str, *values: str) -> str:
    return f"([{', '.join(repr(v) for v in values)}])[CAST({index} AS INTEGER) + 1]"


TX = f"""e AS (SELECT event_id AS tx_id, user_id, event_type, value * 1000 AS amount, json_extract_string(props, '$.k') AS k, (epoch_us(ts) // 1000 - {EPOCH_MS}) // 24 + {EPOCH_MS} AS event_ms FROM events),
tx AS (SELECT tx_id, event_ms, CAST((event_ms - {EPOCH_MS}) // 3600000 AS INTEGER) AS step,
  CASE WHEN event_type IN ('view', 'purchase') THEN 'TRANSFER' WHEN event_type = 'signup' THEN 'CASH_OUT' ELSE 'PAYMENT' END AS type, amount,
  'U' || user_id AS name_orig, amount * (1 + tx_id % 4) AS oldbalance_org, amount * (tx_id % 4) AS newbalance_orig, 'U' || k AS name_dest, CAST(0 AS DOUBLE) AS oldbalance_dest, amount AS newbalance_dest,
  0 AS is_flagged_fraud, 'D' || user_id || '_' || (tx_id % 3) AS device_id, {pick("tx_id % 3", "ANDROID", "IOS", "PC")} AS device_type, {pick("tx_id % 3", "BANK_APP", "MINI_PROGRAM", "THIRD_PARTY")} AS pay_channel,
  {pick("tx_id % 5", "北京", "上海", "广州", "深圳", "杭州")} AS city, '10.0.' || (user_id % 20) AS ip_segment, CAST((event_ms // 3600000) % 24 AS INTEGER) AS transaction_hour, CAST(tx_id % 12 AS INTEGER) AS daily_tx_count,
  {pick("tx_id % 3", "LOW", "MEDIUM", "HIGH")} AS device_risk_level, CASE WHEN tx_id % 5 = 0 THEN 'ABROAD' ELSE 'LOCAL' END AS is_abroad, 'NONE' AS group_id,
  CASE WHEN tx_id % 20 = 0 THEN {pick("(tx_id // 20) % 11", *FRAUD_TYPES)} ELSE 'NORMAL' END AS fraud_type, CAST(tx_id % 20 = 0 AS INTEGER) AS is_fraud FROM e)"""


# -- patterns ---------------------------------------------------------------------------------------


OUT = "(type = 'TRANSFER' OR type = 'CASH_OUT')"
DANGER = "(device_risk_level = 'HIGH' OR is_abroad = 'ABROAD')"
#: Fixed values, written apart from the plans: key, fraud type, minutes, confidence and stages of each pattern; a stage with ``!`` takes the very next event.
SPEC = {
    "p01": ("name_orig", "小额试探大额转出", 120, 0.85, ["type = 'TRANSFER' AND amount >= 1000 AND amount <= 6000", f"{OUT} AND {DANGER} AND amount >= 30000"]),
    "p02": ("name_orig", "多层链式洗钱", 120, 0.90, ["type = 'TRANSFER' AND amount >= 50000 AND (pay_channel = 'BANK_APP' OR device_risk_level = 'HIGH')", "amount >= 30000 AND type = 'TRANSFER'", f"{DANGER} AND type = 'CASH_OUT'"]),
    "p03": ("name_orig", "异地跨设备突发大额", 180, 0.85, ["device_risk_level = 'LOW' AND (type = 'PAYMENT' OR type = 'TRANSFER') AND amount <= 5000", f"{OUT} AND {DANGER} AND amount >= 30000"]),
    "p04": ("name_dest", "分散转入集中提现", 120, 0.80, ["type = 'TRANSFER' AND amount >= 4000 AND amount <= 30000", "!type = 'TRANSFER' AND amount >= 4000 AND amount <= 30000", "amount >= 20000 AND type = 'CASH_OUT'"]),
    "p05": ("name_orig", "多渠道轮番转账", 60, 0.80, ["amount >= 5000 AND type = 'TRANSFER'", "amount >= 5000 AND type = 'TRANSFER'", "amount >= 5000 AND type = 'TRANSFER'"]),
    "p06": ("name_orig", "凌晨分批掏空", 240, 0.80, [f"transaction_hour <= 5 AND transaction_hour >= 0 AND amount >= 5000 AND {OUT}", f"transaction_hour <= 5 AND transaction_hour >= 0 AND amount >= 5000 AND {OUT}", f"transaction_hour <= 5 AND transaction_hour >= 0 AND {OUT}"]),
    "p07": ("name_orig", "小额掩护大额跑路", 480, 0.85, ["(type = 'PAYMENT' OR type = 'TRANSFER') AND amount >= 100 AND amount <= 1000", "!(type = 'PAYMENT' OR type = 'TRANSFER') AND amount >= 100 AND amount <= 1000", f"{OUT} AND {DANGER} AND amount >= 40000"]),
    "p08": ("ip_segment", "团伙同IP批量作案", 30, 0.85, ["type = 'TRANSFER' AND amount >= 15000", "!type = 'TRANSFER' AND amount >= 15000"]),
    "p09": ("name_orig", "账户被盗急速转账", 60, 0.90, [f"{DANGER} AND amount >= 20000 AND (transaction_hour >= 22 OR transaction_hour <= 5)", f"{OUT} AND amount >= 30000"]),
    "p10": ("name_orig", "虚假交易退款套利", 360, 0.80, ["amount >= 10000 AND type = 'PAYMENT'", "!amount >= 10000 AND type = 'PAYMENT'", "amount >= 30000 AND type = 'CASH_OUT'"]),
    "p11": ("name_orig", "养卡提额异常消费", 720, 0.80, ["type = 'PAYMENT' AND amount >= 5000 AND (transaction_hour >= 22 OR transaction_hour <= 5)", "amount >= 20000 AND type = 'PAYMENT'", "amount >= 50000 AND type = 'PAYMENT'"]),
}


def one(name: str) -> str:
    """CTEs ending in ``p_<name>``: the next event is a minimum over later ones, found by a join."""
    key, fraud_type, minutes, confidence, stages = SPEC[name]
    k = f"k_{name}"
    out = [f"{k} AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY event_ms, tx_id) AS rn FROM tx)"]
    out.append(f"m0_{name} AS (SELECT tx_id, {key} AS key, rn AS at, event_ms AS first_ms, event_ms AS last_ms, '' AS ids FROM {k} WHERE {stages[0]})")
    for i, stage in enumerate(stages[1:], 1):
        before = f"m{i - 1}_{name}"
        fits = f"(SELECT {key} AS fk, rn AS frn FROM {k} WHERE {stage.lstrip('!')})"
        nxt = f"SELECT m.tx_id, min(f.frn) AS nrn FROM {before} m JOIN {fits} f ON f.fk = m.key AND f.frn {'= m.at + 1' if stage[0] == '!' else '> m.at'} GROUP BY m.tx_id"
        out.append(f"m{i}_{name} AS (SELECT m.tx_id, m.key, n.rn AS at, m.first_ms, n.event_ms AS last_ms, m.ids || CASE WHEN m.ids = '' THEN '' ELSE ',' END || n.tx_id AS ids FROM {before} m JOIN ({nxt}) x USING (tx_id) JOIN {k} n ON n.{key} = m.key AND n.rn = x.nrn)")
    out.append(f"p_{name} AS (SELECT '{name}' AS pattern, m.tx_id, m.ids AS next_ids, m.last_ms, t.name_orig AS account_id, '{fraud_type}' AS fraud_type, CAST({confidence} AS DOUBLE) AS confidence FROM m{len(stages) - 1}_{name} m JOIN tx t USING (tx_id) WHERE m.last_ms - m.first_ms < {minutes * 60_000})")
    return ",\n".join(out)


CEP = ",\n".join(map(one, SPEC)) + ",\ncep AS (" + " UNION ALL ".join(f"SELECT * FROM p_{name}" for name in SPEC) + ")"

CHAIN_SCORE = """least(1.0, CASE WHEN td < 300 THEN 0.35 WHEN td < 1800 THEN 0.25 WHEN td < 3600 THEN 0.15 ELSE 0.05 END + CASE WHEN la > 100000 THEN 0.35 WHEN la > 50000 THEN 0.25 WHEN la > 10000 THEN 0.15 ELSE 0.05 END
  + CASE WHEN decay < 0.15 THEN 0.35 WHEN decay < 0.3 THEN 0.25 ELSE 0.15 END + 0.25)"""
CHAIN = f"""c0 AS (SELECT l.tx_id AS l_tx_id, r.tx_id AS r_tx_id, l.name_orig AS a, l.name_dest AS b, r.name_dest AS c, l.amount AS la, r.amount AS ra, l.name_orig || '->' || r.name_dest AS pair, l.event_ms AS lm, r.event_ms AS rm,
  abs(r.event_ms - l.event_ms) / 1000.0 AS td, abs(l.amount - r.amount) / l.amount AS decay FROM tx l JOIN tx r ON l.name_dest = r.name_orig AND r.event_ms - l.event_ms BETWEEN -7200000 AND 7200000
  WHERE l.type = 'TRANSFER' AND r.type = 'TRANSFER' AND l.amount > 5000 AND r.amount > 5000 AND l.name_orig <> r.name_dest AND l.name_orig <> l.name_dest AND r.name_orig <> r.name_dest),
c1 AS (SELECT *, lag(pair) OVER (PARTITION BY b ORDER BY greatest(lm, rm), lm, rm, l_tx_id, r_tx_id) AS before FROM c0),
chain AS (SELECT *, CAST({CHAIN_SCORE} AS DOUBLE) AS confidence FROM c1 WHERE before IS NULL OR before <> pair)"""
CASHOUT = """s0 AS (SELECT l.tx_id AS l_tx_id, r.tx_id AS r_tx_id, l.name_dest AS account_id, l.amount AS la, r.amount AS ra, l.event_ms AS lm, r.event_ms AS rm, row_number() OVER (PARTITION BY l.name_dest ORDER BY greatest(l.event_ms, r.event_ms), l.event_ms, r.event_ms, l.tx_id, r.tx_id) AS ord
  FROM tx l JOIN tx r ON l.name_dest = r.name_orig AND r.event_ms - l.event_ms BETWEEN -3600000 AND 10800000 WHERE l.type = 'TRANSFER' AND l.amount > 3000 AND l.amount < 30000 AND r.type = 'CASH_OUT' AND r.amount > 15000),
s1 AS (SELECT *, sum(la) OVER w AS total_in, min(lm) OVER w AS min_ms FROM s0 WINDOW w AS (PARTITION BY account_id ORDER BY ord ROWS UNBOUNDED PRECEDING)),
s2 AS (SELECT *, ra / total_in AS ratio, row_number() OVER (PARTITION BY account_id ORDER BY ord) AS rn FROM s1 WHERE ra / total_in >= 0.7),
s3 AS (SELECT *, abs(rm - min_ms) / 1000.0 AS td FROM s2 WHERE rn = 1),
cashout AS (SELECT *, CAST(least(1.0, 0.45 + (ratio - 0.7) * 0.5 + CASE WHEN total_in > 50000 THEN 0.25 ELSE 0.15 END + CASE WHEN td < 1800 THEN 0.25 WHEN td < 3600 THEN 0.15 ELSE 0.1 END) AS DOUBLE) AS confidence FROM s3)"""
GANG = """g0 AS (SELECT *, event_ms // 1800000 * 1800000 AS window_ms FROM tx WHERE type = 'TRANSFER' AND amount > 8000 AND (device_risk_level = 'HIGH' OR transaction_hour >= 20)),
g1 AS (SELECT ip_segment, window_ms, count(DISTINCT name_orig) AS accounts, sum(amount) AS total_amount, min(event_ms) AS min_ms, max(event_ms) AS max_ms, (array_agg(name_orig ORDER BY event_ms, tx_id))[1] AS account_id, (array_agg(tx_id ORDER BY event_ms, tx_id))[1] AS first_tx FROM g0 GROUP BY ALL),
gang AS (SELECT *, least(1.0, 0.45 + (accounts - 2) * 0.08 + total_amount / 400000.0) AS confidence FROM g1 WHERE accounts >= 2 AND total_amount > 30000)"""
INTO = """i0 AS (SELECT *, event_ms // 7200000 * 7200000 AS window_ms FROM tx WHERE type = 'TRANSFER' AND amount > 3000 AND amount < 30000),
i1 AS (SELECT name_dest, window_ms, name_orig, sum(amount) AS s FROM i0 GROUP BY ALL),
i2 AS (SELECT name_dest, window_ms, count(DISTINCT name_orig) AS senders, sum(amount) AS total_amount, min(event_ms) AS min_ms, max(event_ms) AS max_ms, (array_agg(tx_id ORDER BY event_ms DESC, tx_id DESC))[1] AS last_tx FROM i0 GROUP BY ALL),
i3 AS (SELECT name_dest, window_ms, max(s) AS max_sender FROM i1 GROUP BY ALL),
into_ AS (SELECT name_dest AS account_id, window_ms, senders, total_amount, max_sender, min_ms, max_ms, last_tx, CAST(least(1.0, 0.4 + (senders - 2) * 0.1 + total_amount / 100000.0 + CASE WHEN max_sender / (total_amount / senders) > 3.0 THEN 0.1 ELSE 0 END) AS DOUBLE) AS confidence FROM i2 JOIN i3 USING (name_dest, window_ms) WHERE senders >= 2 AND total_amount > 15000)"""
CTX = "t.event_ms, t.amount, t.city, t.name_orig, t.name_dest, t.type, t.device_id, t.ip_segment, t.transaction_hour, t.is_abroad, t.device_risk_level"
RULES = f"""r0 AS (SELECT c.account_id, c.fraud_type, c.confidence, 'CEP_RULE' AS source, c.tx_id || ',' || c.next_ids AS ids, 0 AS edge, CAST(0 AS DOUBLE) AS vol, {CTX} FROM cep c JOIN tx t USING (tx_id)
  UNION ALL SELECT a, '多层链式洗钱(SQL)', confidence, 'SQL_CHAIN_PATTERN', l_tx_id || ',' || r_tx_id, 1, round(la, 2), {CTX} FROM chain JOIN tx t ON t.tx_id = l_tx_id WHERE confidence > 0.6
  UNION ALL SELECT account_id, '分散转入集中提现(SQL)', confidence, 'SQL_SCATTER_CASHOUT', l_tx_id || ',' || r_tx_id, 0, round(total_in, 2), {CTX} FROM cashout JOIN tx t ON t.tx_id = r_tx_id WHERE confidence > 0.5
  UNION ALL SELECT account_id, '团伙同IP批量作案(SQL)', confidence, 'SQL_IP_GANG', '' || first_tx, 0, 0, {CTX} FROM gang JOIN tx t ON t.tx_id = first_tx WHERE confidence > 0.6
  UNION ALL SELECT account_id, '分散转入集中转出(SQL)', confidence, 'SQL_SCATTER_PATTERN', last_tx || ',' || window_ms, 0, 0, {CTX} FROM into_ JOIN tx t ON t.tx_id = last_tx WHERE confidence > 0.5),
alerts AS (SELECT * REPLACE (round(CAST(confidence AS DOUBLE), 9) AS confidence), sha256(source || '|' || fraud_type || '|' || account_id || '|' || ids) AS alert_id FROM r0)"""
ALERTS = ",\n".join([TX, CEP, CHAIN, CASHOUT, GANG, INTO, RULES])


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# -- sequences ----------------------------------------------------------------------------------------

SEQ = """d0 AS (SELECT name_orig AS account_id, * FROM tx UNION ALL SELECT name_dest AS account_id, * FROM tx),
d1 AS (SELECT *, CASE WHEN event_ms - lag(event_ms) OVER w <= 60000 THEN 0 ELSE 1 END AS new FROM d0 WINDOW w AS (PARTITION BY account_id ORDER BY event_ms, tx_id)),
d2 AS (SELECT *, sum(new) OVER (PARTITION BY account_id ORDER BY event_ms, tx_id ROWS UNBOUNDED PRECEDING) AS session FROM d1),
d3 AS (SELECT account_id, session FROM d2 GROUP BY ALL HAVING count(*) >= 2),
d4 AS (SELECT d2.*, row_number() OVER (PARTITION BY account_id, session ORDER BY event_ms DESC, tx_id DESC) AS back FROM d2 JOIN d3 USING (account_id, session)),
sq AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY account_id, session) AS n, lag(city) OVER w AS p_city, lag(device_id) OVER w AS p_dev, lag(pay_channel) OVER w AS p_ch, lead(city) OVER w AS n_city, lead(device_id) OVER w AS n_dev, lead(pay_channel) OVER w AS n_ch,
  lag(event_ms) OVER w AS p_ms, lag(amount) OVER w AS p_amount, lag(type) OVER w AS p_type, lead(type) OVER w AS n_type FROM d4 WHERE back <= 10 WINDOW w AS (PARTITION BY account_id, session ORDER BY event_ms, tx_id))"""
FEAT = """f0 AS (SELECT account_id, session, max(n) AS n, avg(amount) AS avg_amount, max(amount) AS max_amount, sum(amount) AS total_amount, sum(amount * amount) AS sq_amount,
  count(*) FILTER (i > 0 AND city <> p_city) AS city_changes, count(*) FILTER (i > 0 AND device_id <> p_dev) AS device_changes, count(*) FILTER (i > 0 AND pay_channel <> p_ch) AS channel_changes,
  count(*) FILTER (transaction_hour >= 22 OR transaction_hour <= 6) AS night_count, count(*) FILTER (device_risk_level = 'HIGH') AS high_risk_count, count(*) FILTER (is_abroad = 'ABROAD') AS abroad_count,
  count(DISTINCT city) AS distinct_cities, count(DISTINCT device_id) AS distinct_devices, count(DISTINCT pay_channel) AS distinct_channels, max(CASE WHEN oldbalance_org > 0 THEN amount / oldbalance_org ELSE 0 END) AS balance_ratio,
  count(*) FILTER (type IN ('TRANSFER', 'CASH_OUT')) AS moves, count(*) FILTER (type = 'PAYMENT') AS payments, coalesce(max(amount) FILTER (type IN ('TRANSFER', 'CASH_OUT')), 0) AS max_single, min(event_ms) AS lo, max(event_ms) AS hi,
  count(DISTINCT name_dest) AS out_degree, avg(greatest((event_ms - p_ms) / 1000.0, 0.1)) FILTER (i > 0) AS interval_mean, var_pop(greatest((event_ms - p_ms) / 1000.0, 0.1)) FILTER (i > 0) AS interval_variance,
  regr_slope(amount, i) AS amount_slope, max(event_ms) FILTER (i = n // 2 - 1) AS mid_end, max(event_ms) FILTER (i = n // 2) AS mid_start, max(transaction_hour) FILTER (i = n - 1) AS last_hour, max(is_fraud) AS label,
  least(avg(CASE WHEN transaction_hour BETWEEN 0 AND 4 THEN 1.0 WHEN transaction_hour IN (22, 23, 5, 6) THEN 0.6 WHEN transaction_hour IN (20, 21, 7, 8) THEN 0.3 ELSE 0 END), 1.0) AS hour_risk,
  string_agg(CASE type WHEN 'TRANSFER' THEN 'T' WHEN 'CASH_OUT' THEN 'C' WHEN 'PAYMENT' THEN 'P' ELSE '?' END || CASE WHEN city <> n_city THEN '[CITY]' ELSE '' END || CASE WHEN device_id <> n_dev THEN '[DEV]' ELSE '' END || CASE WHEN pay_channel <> n_ch THEN '[CH]' ELSE '' END, '->' ORDER BY i) AS behavior_path
  FROM sq GROUP BY account_id, session),
f1 AS (SELECT account_id, session, count(*) FILTER (hi - event_ms <= 300000) / count(*) FILTER (hi - event_ms <= 1800000) AS time_density FROM sq JOIN f0 USING (account_id, session) GROUP BY account_id, session),
f AS (SELECT f0.*, time_density, sqrt(greatest(sq_amount / n - avg_amount * avg_amount, 0)) AS std_amount, moves / n AS cash_out_ratio, n / greatest(greatest(hi - lo, 1) / 60000.0, 0.1) AS velocity, max_single / total_amount AS max_single_ratio, out_degree AS distinct_dests,
  ((n - n // 2) * 1000.0 / greatest(hi - mid_start, 1)) / ((n // 2) * 1000.0 / greatest(mid_end - lo, 1)) AS freq_acceleration FROM f0 JOIN f1 USING (account_id, session))"""
GRAPH = """ge AS (SELECT tx_id, name_orig AS src, name_dest AS dst, amount, event_ms FROM tx WHERE name_orig <> name_dest),
go AS (SELECT src AS account, count(*) AS od, sum(amount) AS oa, count(DISTINCT dst) AS onb, min(event_ms) AS lo, max(event_ms) AS hi FROM ge GROUP BY 1),
gi AS (SELECT dst AS account, count(*) AS idg, sum(amount) AS ia, count(DISTINCT src) AS inb, min(event_ms) AS lo, max(event_ms) AS hi FROM ge GROUP BY 1),
gd AS (SELECT account, coalesce(od, 0) AS out_degree, coalesce(idg, 0) AS in_degree, coalesce(oa, 0) AS out_amount, coalesce(ia, 0) AS in_amount, coalesce(onb, 0) AS out_neighbors, coalesce(inb, 0) AS in_neighbors, least(go.lo, gi.lo) AS lo, greatest(go.hi, gi.hi) AS hi FROM go FULL JOIN gi USING (account)),
gx AS (SELECT *, CASE WHEN in_amount + out_amount <= 0 THEN 0 ELSE abs(in_amount - out_amount) / (in_amount + out_amount) END AS asymmetry, CASE WHEN out_degree = 0 THEN 0 WHEN in_degree = 0 THEN 1000000.0 ELSE out_degree / in_degree END AS freq_ratio,
  (out_amount - in_amount) / (in_amount + out_amount) AS net_flow, CASE WHEN out_degree + in_degree < 2 THEN 0 WHEN hi <= lo THEN 1 ELSE least(10.0 * (out_degree + in_degree) / ((hi - lo) / 1000.0), 1.0) END AS time_concentration FROM gd),
gp AS (SELECT DISTINCT src, dst FROM ge),
gc AS (SELECT a.src AS account, 2 AS length, count(*) AS cycles FROM gp a JOIN gp b ON a.dst = b.src AND b.dst = a.src GROUP BY 1
  UNION ALL SELECT a.src, 3, count(*) FROM gp a JOIN gp b ON a.dst = b.src JOIN gp c ON b.dst = c.src AND c.dst = a.src WHERE b.dst <> a.src GROUP BY 1),
rg AS (WITH RECURSIVE w(account, node, k) AS (SELECT src, dst, 1 FROM gp UNION SELECT account, dst, k + 1 FROM w JOIN gp ON node = src WHERE k < 6) SELECT account, min(k) AS length FROM w WHERE node = account GROUP BY 1),
l1 AS MATERIALIZED (SELECT src, dst, event_ms FROM ge),
""" + "".join(f"l{k} AS MATERIALIZED (SELECT a.src, a.dst, a.event_ms FROM l1 a WHERE EXISTS (SELECT 1 FROM l{k - 1} b WHERE b.src = a.dst AND b.event_ms > a.event_ms)),\n" for k in range(2, 11)) + "gh AS (SELECT account, max(k) AS depth FROM (" + " UNION ALL ".join(f"SELECT src AS account, {k} AS k FROM l{k}" for k in range(1, 11)) + """) GROUP BY 1)"""
#: Walks of three edges are listed, with their accounts; pairs of them that close a cycle are counted by what they share.
CYCLES = """gl AS MATERIALIZED (SELECT src AS s, dst AS d FROM gp WHERE src IN (SELECT dst FROM gp) AND dst IN (SELECT src FROM gp)),
y2 AS MATERIALIZED (SELECT a.s AS r, b.d AS m, count(*) AS n FROM gl a JOIN gl b ON b.s = a.d WHERE a.s <> b.d GROUP BY 1, 2),
y3 AS MATERIALIZED (SELECT a.s AS r, a.d AS x, b.d AS y, c.d AS m FROM gl a JOIN gl b ON b.s = a.d JOIN gl c ON c.s = b.d WHERE b.d <> a.s AND c.d <> a.s AND c.d <> a.d),
yn AS MATERIALIZED (SELECT r, m, count(*) AS n FROM y3 GROUP BY 1, 2),
yv AS MATERIALIZED (SELECT r, m, v, count(*) AS n FROM (SELECT r, m, x AS v FROM y3 UNION ALL SELECT r, m, y FROM y3) GROUP BY 1, 2, 3),
yu AS MATERIALIZED (SELECT r, m, least(x, y) AS u, greatest(x, y) AS v, count(*) AS n FROM y3 GROUP BY 1, 2, 3, 4),
cy AS (SELECT account, length, cycles AS n FROM gc
  UNION ALL SELECT a.s, 4, count(*) FROM gl a JOIN gl b ON b.s = a.d JOIN gl c ON c.s = b.d JOIN gl e ON e.s = c.d AND e.d = a.s WHERE b.d <> a.s AND c.d <> a.d GROUP BY 1
  UNION ALL SELECT f.r, 5, sum(f.n * g.n) FROM yn f JOIN y2 g ON g.r = f.m AND g.m = f.r GROUP BY 1
  UNION ALL SELECT f.r, 5, -sum(f.n) FROM yv f JOIN gl a ON a.s = f.m AND a.d = f.v JOIN gl b ON b.s = f.v AND b.d = f.r GROUP BY 1
  UNION ALL SELECT f.r, 6, sum(f.n * g.n) FROM yn f JOIN yn g ON g.r = f.m AND g.m = f.r GROUP BY 1
  UNION ALL SELECT f.r, 6, -sum(f.n * g.n) FROM yv f JOIN yv g ON g.r = f.m AND g.m = f.r AND g.v = f.v GROUP BY 1
  UNION ALL SELECT f.r, 6, sum(f.n * g.n) FROM yu f JOIN yu g ON g.r = f.m AND g.m = f.r AND g.u = f.u AND g.v = f.v GROUP BY 1)"""
COMMUNITY = """um AS (SELECT DISTINCT a.name_orig AS account, b.name_orig AS member FROM (SELECT DISTINCT name_orig, ip_segment FROM tx) a JOIN (SELECT DISTINCT name_orig, ip_segment FROM tx) b USING (ip_segment)
  UNION SELECT a.name_orig, b.name_orig FROM (SELECT DISTINCT name_orig, device_id FROM tx) a JOIN (SELECT DISTINCT name_orig, device_id FROM tx) b USING (device_id)),
gu AS (SELECT src, dst FROM gp UNION SELECT dst, src FROM gp),
cm AS (SELECT account, count(DISTINCT m) AS community FROM (SELECT account, member AS m FROM um UNION SELECT account, dst FROM um JOIN gu ON member = src) GROUP BY 1)"""
ACCOUNTS = """ac AS (SELECT gx.*, coalesce(community, 1) AS community, account IN (SELECT account FROM rg) AS has_cycle, coalesce(depth, 0) AS depth FROM gx LEFT JOIN cm USING (account) LEFT JOIN gh USING (account))"""
STATS = """gs AS (SELECT account AS account_id, CAST(account IN (SELECT account FROM rg) AS INTEGER) AS graph_cycle, coalesce(depth, 0) AS graph_chain_depth, out_neighbors AS graph_community, in_amount AS graph_in_amount, out_amount AS graph_out_amount,
  CASE WHEN in_amount > 0 THEN out_amount / in_amount ELSE 0 END AS graph_flow_balance, out_degree + in_degree AS graph_degree, asymmetry AS direction_asymmetry, freq_ratio AS in_out_freq_ratio, net_flow AS net_flow_asymmetry, time_concentration FROM gx LEFT JOIN gh USING (account)),
fg AS (SELECT f.*, """ + ", ".join(f"coalesce({c}, 0) AS {c}" for c in features.GRAPH) + """ FROM f LEFT JOIN gs USING (account_id))"""


def points(table) -> str:
    return "least(1.0, " + " + ".join(f"CASE WHEN {c} THEN {p} ELSE 0 END" for c, p in table) + ")"


def z(i: int, c: str) -> str:
    return f"greatest(-3.0, least(3.0, ({c} - {scores.LR_MEANS[i]}) / (3.0 * {scores.LR_STDS[i]}))) / 3.0"


LR = "1.0 / (1.0 + exp(-(" + f"{scores.LR_BIAS} + " + " + ".join(f"{w} * {z(i, c)}" for i, (c, w) in enumerate(zip(features.FEATURES, scores.LR_WEIGHTS, strict=True))) + ")))"
FAR = "least(1.0, (" + " + ".join(f"abs({z(i, c)})" for i, c in enumerate(features.FEATURES)) + ") / 36)"
SCORED = f"""pr AS (SELECT {', '.join(f'avg({c}) AS m{i}, coalesce(stddev_samp({c}), 0) AS s{i}' for i, c in enumerate(features.FEATURES))} FROM fg),
pc AS (SELECT behavior_path, count(*) AS c, (SELECT count(*) FROM fg) AS t FROM fg GROUP BY 1),
sc AS (SELECT fg.*, {points(scores.BEHAVIOR)} AS behavior_score, 0.72 * {LR} + 0.28 * {FAR} AS lr_score,
  CASE WHEN t < 2 THEN 0 WHEN c / t < 1.0 / (t * 0.5) THEN 0.9 WHEN c < 5 THEN 0.5 + 0.4 * (1.0 - c / 5.0) ELSE greatest(0.0, 0.3 * (1.0 - c / t * 10)) END AS path_score,
  ({' + '.join(f'least(1.0, abs({c} - m{i}) / greatest(s{i}, 0.001) / 3.0)' for i, c in enumerate(features.FEATURES))}) / 36 AS stat_score FROM fg JOIN pc USING (behavior_path), pr)"""
SEQS = ",\n".join([TX, SEQ, FEAT])
FULL = ",\n".join([TX, SEQ, FEAT, GRAPH, STATS, SCORED])


def first_of(table) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN '{t}'" for c, t in table) + " END"


API = f"""a0 AS (SELECT *, CASE WHEN oldbalance_org > 0 THEN (oldbalance_org - newbalance_orig) / oldbalance_org ELSE 0 END AS balance_ratio FROM tx),
a1 AS (SELECT *, {points(api.BEHAVIOR)} AS behavior_score FROM a0),
a2 AS (SELECT *, least(1.0, behavior_score * 0.6 + CASE WHEN balance_ratio > 0.5 THEN 0.1 ELSE 0 END + CASE WHEN is_abroad = 'ABROAD' AND amount > 15000 THEN 0.15 ELSE 0 END) AS model_score, CASE {' '.join(f"WHEN {c} THEN {p}" for c, _, p in api.RULES)} ELSE 0 END AS rule_confidence FROM a1),
a3 AS (SELECT *, greatest(model_score, rule_confidence) AS p0, 0.35 * CASE WHEN device_risk_level = 'HIGH' AND is_abroad = 'ABROAD' THEN 0.8 ELSE 1 END AS lim FROM a2),
a4 AS (SELECT *, p0 >= lim OR behavior_score >= 0.30 AS is_suspect FROM a3),
a5 AS (SELECT *, CASE WHEN is_suspect THEN greatest(p0, behavior_score) ELSE p0 END AS fraud_probability FROM a4)"""
GRAPH_ALERT = f"""ga0 AS (SELECT *, out_amount > 5000 AND CASE WHEN in_amount > 0 THEN out_amount / in_amount ELSE 0 END > 0.7 AS cash_heavy, out_degree >= 1 AND in_degree >= 1 AS chain_node, out_degree >= 3 AND out_amount >= 15000 AS fan_out, in_degree >= 2 AND in_amount >= 10000 AS fan_in FROM ac),
ga1 AS (SELECT *, CASE WHEN chain_node THEN 25 + CASE WHEN depth >= 2 THEN 10 ELSE 0 END ELSE 0 END + CASE WHEN has_cycle AND out_degree >= 1 THEN 30 ELSE 0 END + CASE WHEN fan_out THEN 20 ELSE 0 END + CASE WHEN fan_in THEN 20 ELSE 0 END + CASE WHEN cash_heavy THEN 20 ELSE 0 END
  + CASE WHEN asymmetry > 0.5 AND out_amount > in_amount AND out_amount > 3000 THEN 15 * asymmetry ELSE 0 END + CASE WHEN net_flow > 0.4 AND out_amount > 5000 THEN 10 * net_flow ELSE 0 END + CASE WHEN time_concentration > 0.5 THEN 12 * time_concentration ELSE 0 END AS score FROM ga0),
ga AS (SELECT account, {first_of(graph.GRAPH_TYPES)} AS fraud_type, CAST(score AS DOUBLE) AS score, CAST(least(0.95, score / 100.0) AS DOUBLE) AS confidence FROM ga1 WHERE score >= 35)"""
ENRICH = """e0 AS (SELECT *, CASE WHEN event_ms - lag(event_ms) OVER (PARTITION BY account_id ORDER BY event_ms, alert_id) <= 60000 THEN 0 ELSE 1 END AS new FROM alerts),
e1 AS (SELECT *, sum(new) OVER (PARTITION BY account_id ORDER BY event_ms, alert_id ROWS UNBOUNDED PRECEDING) AS session FROM e0),
e2 AS (SELECT *, count(*) FILTER (source LIKE '%CEP%') OVER w AS cep_hits, count(*) FILTER (source LIKE '%SQL%') OVER w AS sql_hits, sum(edge) OVER w AS edges, sum(vol) OVER w AS volume FROM e1 WINDOW w AS (PARTITION BY account_id, session ORDER BY event_ms, alert_id ROWS UNBOUNDED PRECEDING)),
e3 AS (SELECT * REPLACE (least(1.0, round(confidence + least(0.15, (cep_hits + sql_hits) * 0.05) + CASE WHEN edges >= 3 THEN 0.10 WHEN edges >= 1 THEN 0.05 ELSE 0 END + CASE WHEN volume >= 50000 THEN 0.10 WHEN volume >= 20000 THEN 0.05 ELSE 0 END
  + CASE WHEN sql_hits >= 1 AND edges >= 2 THEN 0.08 ELSE 0 END, 9)) AS confidence, source || '_ENRICHED' AS source) FROM e2)"""
TIME = "CASE WHEN event_ms <= 0 THEN '00:00:00.000' ELSE strftime(make_timestamp((event_ms + 28800000) * 1000), '%H:%M:%S.%g') END"
FEEDBACK = """fb AS (SELECT *, CASE CAST('0x' || alert_id[1:2] AS INTEGER) % 5 WHEN 0 THEN 'FALSE_POSITIVE' WHEN 1 THEN 'INCORRECT_TYPE' ELSE 'CONFIRMED_FRAUD' END AS feedback_type FROM alerts)"""
REVIEWS = """h0 AS (SELECT alert_id, event_ms, CAST('0x' || alert_id[1:2] AS INTEGER) AS h FROM alerts),
rs AS (SELECT alert_id, CASE WHEN h % 4 = 0 THEN 'RESOLVED' WHEN h % 8 = 2 THEN 'PENDING' WHEN h % 2 = 0 THEN 'IN_REVIEW' ELSE 'PENDING' END AS state, CASE WHEN h % 2 = 0 THEN CAST(60000 * (1 + h % 7) AS DOUBLE) END AS waited_ms,
  CASE WHEN h % 4 = 0 THEN CAST(60000 * (10 + h % 11) AS DOUBLE) END AS handled_ms, CAST(CASE WHEN h % 4 = 0 OR h % 8 = 2 THEN 2 WHEN h % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS actions FROM h0)"""
RATES = "count(*) AS total, count(*) FILTER (feedback_type = 'CONFIRMED_FRAUD') AS confirmed, count(*) FILTER (feedback_type = 'FALSE_POSITIVE') AS false_positive, count(*) FILTER (feedback_type = 'INCORRECT_TYPE') AS incorrect_type, round(count(*) FILTER (feedback_type = 'FALSE_POSITIVE') / count(*), 6) AS fpr"
SAMPLES = """mx AS (SELECT max(tx_id) AS m FROM tx),
sm AS (SELECT tx_id, u.feature, u.x, tx_id >= m - m // 10 AS recent, tx_id < m // 2 AS baseline FROM tx, mx, LATERAL (SELECT unnest(['amount', 'oldbalance_org', 'newbalance_orig', 'daily_tx_count', 'transaction_hour']) AS feature, unnest([amount, oldbalance_org, newbalance_orig, CAST(daily_tx_count AS DOUBLE), CAST(transaction_hour AS DOUBLE)]) AS x) u)"""
KS = """kn AS (SELECT feature, count(*) AS nh, count(*) FILTER (recent) AS nr FROM sm GROUP BY 1),
kd AS (SELECT feature, x, (SELECT count(*) FROM sm b WHERE b.feature = a.feature AND b.x <= a.x) AS ch, (SELECT count(*) FROM sm b WHERE b.feature = a.feature AND b.x <= a.x AND b.recent) AS cr FROM (SELECT DISTINCT feature, x FROM sm) a),
ks AS (SELECT feature, max(abs(cr / nr - ch / nh)) AS ks FROM kd JOIN kn USING (feature) WHERE nr >= 30 AND nh >= 100 GROUP BY 1)"""
PSI = """bl AS (SELECT feature, list(x ORDER BY x) AS xs FROM sm WHERE baseline GROUP BY 1),
bb AS (SELECT feature, b, xs[CAST(floor(b * (len(xs) - 1) / 10.0 + 0.5) AS INTEGER) + 1] AS upper FROM bl, range(1, 10) r(b)),
bk AS (SELECT s.feature, s.tx_id, count(*) FILTER (s.x > upper) AS above, min(b) FILTER (s.x <= upper) AS first_b FROM sm s JOIN bb USING (feature) WHERE s.recent GROUP BY 1, 2),
bc AS (SELECT feature, coalesce(first_b - 1, 9) AS bucket, count(*) AS c FROM bk GROUP BY 1, 2),
bn AS (SELECT feature, count(*) AS n FROM sm WHERE recent GROUP BY 1 HAVING count(*) >= 100),
bs AS (SELECT n.feature, greatest(coalesce(c, 0) / n.n, 0.0001) AS share FROM bn n CROSS JOIN range(0, 10) r(bucket) LEFT JOIN bc ON bc.feature = n.feature AND bc.bucket = r.bucket),
psi AS (SELECT feature, abs(sum((share - 0.1) * ln(share / 0.1))) AS psi FROM bs GROUP BY 1)"""
TAG = """tg AS (SELECT account_id, event_ms AS tag_ms, max(pattern) AS rule FROM cep JOIN tx USING (tx_id) GROUP BY 1, 2),
ta AS (SELECT t.tx_id, t.name_orig, t.amount, coalesce(t.event_ms - g.tag_ms <= 300000, false) AS is_cep_matched, CASE WHEN t.event_ms - g.tag_ms <= 300000 THEN rule ELSE 'NONE' END AS cep_rule_name FROM tx t ASOF LEFT JOIN tg g ON t.name_orig = g.account_id AND t.event_ms >= g.tag_ms)"""
GNN = f"""n0 AS (SELECT account_id, session, i, name_dest AS dest, amount, type, ln(1 + amount) / ln(100001.0) AS w, row_number() OVER (PARTITION BY account_id, session ORDER BY amount DESC, i) - 1 AS pos FROM sq WHERE name_dest <> account_id),
nt AS (SELECT account_id, session, dest, sum(amount) AS amount, count(*) AS met FROM n0 GROUP BY ALL),
h1 AS (SELECT account_id, session, sum(w * ln(1 + amount) / 15) / sum(w) AS h_norm, sum(w * CASE WHEN amount > 20000 THEN 1 ELSE 0 END) / sum(w) AS h_big FROM n0 WHERE pos < 8 GROUP BY 1, 2),
h2 AS (SELECT p.account_id, p.session, sum(ln(1 + t.amount) / ln(100001.0) * 0.25 * ln(1 + t.amount) / 15) / sum(ln(1 + t.amount) / ln(100001.0) * 0.25) AS g_norm FROM n0 p JOIN nt t USING (account_id, session) WHERE p.pos < 8 AND NOT EXISTS (SELECT 1 FROM n0 q WHERE q.account_id = p.account_id AND q.session = p.session AND q.pos <= p.pos AND q.dest = t.dest) GROUP BY 1, 2),
nr AS (SELECT account_id, session, sum(w * (CASE WHEN amount > 50000 THEN 0.3 WHEN amount > 20000 THEN 0.2 WHEN amount > 10000 THEN 0.1 ELSE 0 END + CASE type WHEN 'CASH_OUT' THEN 0.15 WHEN 'TRANSFER' THEN 0.05 ELSE 0 END)) / sum(w) AS neighbor_risk, count(*) AS n_edges FROM n0 GROUP BY 1, 2),
nv AS (SELECT account_id, session, max(amount) AS max_total, greatest(avg(amount * amount) - pow(avg(amount), 2), 0) AS variance, max(met) AS most_met FROM nt GROUP BY 1, 2),
nq AS (SELECT account_id, session, count(*) FILTER (i > 0 AND i < n - 1 AND p_type = 'TRANSFER' AND type = 'TRANSFER' AND n_type = 'TRANSFER') AS chains, count(*) FILTER (amount > p_amount) AS ups, count(*) FILTER (amount < p_amount) AS downs FROM sq GROUP BY 1, 2),
nf AS (SELECT f.*, coalesce(neighbor_risk, 0) AS neighbor_risk, coalesce(n_edges, 0) AS n_edges, coalesce(max_total, 0) AS max_total, coalesce(variance, 0) AS variance, coalesce(most_met, 0) AS most_met, chains, ups, downs, h_norm, h_big, coalesce(g_norm, 0) AS g_norm, {points(scores.NODE_RISK)} AS node_risk
  FROM f LEFT JOIN nr USING (account_id, session) LEFT JOIN nv USING (account_id, session) LEFT JOIN nq USING (account_id, session) LEFT JOIN h1 USING (account_id, session) LEFT JOIN h2 USING (account_id, session)),
ng AS (SELECT *, least(1.0, ({' + '.join(f"least(1.0, abs(CASE WHEN h_norm IS NULL THEN {features.FEATURES[i]} ELSE 0.4 * {features.FEATURES[i]} + {dict([(0, '0.35 * h_norm + 0.25 * g_norm * 0.5'), (2, '0.35 * h_norm * 1.5'), (3, '0.35 * h_norm * 5 + 0.25 * g_norm * 2.5'), (7, '0.35 * h_big')]).get(i, '0')} END - {u}) / {s} * 0.1)" for i, (u, s) in scores.USUAL.items())}) / 36) AS deviation,
  least(1.0, CASE WHEN n_edges >= 5 THEN 0.25 WHEN n_edges >= 3 THEN 0.15 WHEN n_edges >= 2 THEN 0.05 ELSE 0 END + CASE WHEN max_total > 0 AND variance / max_total < 0.1 AND n_edges >= 3 THEN 0.15 ELSE 0 END
  + CASE WHEN n < 3 THEN 0 ELSE least(1.0, chains / greatest(n - 2, 1) * 0.5 + CASE WHEN ups + downs = 0 THEN 0 ELSE greatest(ups, downs) / (ups + downs) END * 0.5) END * 0.20 + CASE WHEN most_met >= 5 THEN 0.6 WHEN most_met >= 3 THEN 0.3 ELSE 0 END * 0.15) AS structure FROM nf),
nk AS (SELECT *, least(1.0, node_risk * 0.30 + neighbor_risk * 0.25 + deviation * 0.25 + 0.10) AS risk, least(1.0, greatest(out_degree, 1) / 5.0) AS factor FROM ng),
nx AS (SELECT *, (0.5 + 0.3 * factor) * risk + (0.5 - 0.3 * factor) * structure AS g0 FROM nk),
gn AS (SELECT *, least(1.0, CASE WHEN risk > 0.7 AND structure > 0.5 THEN least(1.0, g0 * 1.15) ELSE g0 END + CASE WHEN max_amount > 50000 THEN 0.05 ELSE 0 END) AS gnn_score FROM nx)"""
ML = f"""mp AS (SELECT *, least(1.0, {' + '.join(f'{k}_score * {w / sum(scores.ENSEMBLE.values()) * 0.7!r}' for k, w in scores.ENSEMBLE.items() if k != 'gbdt')}) AS probability FROM sc),
ma AS (SELECT *, {first_of(scores.ML_TYPES)} AS fraud_type, greatest(probability, behavior_score) AS confidence FROM mp WHERE probability >= 0.55 OR {' OR '.join(f'({r})' for r in scores.ML_RULES)})"""


def rnd(columns: str, digits: int = 6) -> str:
    return ", ".join(f"round(CAST({c} AS DOUBLE), {digits}) AS {c}" for c in columns.split())


def big(columns: str) -> str:
    return ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in columns.split())


def oracle_sql() -> dict[str, str]:
    out = {f"cep_{name}": with_(TX, one(name)) + f"SELECT m.tx_id, next_ids, last_ms, account_id, m.fraud_type, confidence, t.amount FROM p_{name} m JOIN tx t USING (tx_id)" for name in SPEC}
    tx, al, seqs = with_(TX), with_(ALERTS), with_(SEQS)
    out |= {
        "cdc_flatten": tx + "SELECT name_orig AS nameOrig, name_dest AS nameDest, type, amount, CAST(event_ms AS VARCHAR) AS eventTime, 'train' AS _data_type, CASE WHEN tx_id % 4 = 2 THEN 'update' ELSE 'insert' END AS _op_type, CAST(1704153600000 AS BIGINT) AS _timestamp FROM tx WHERE tx_id % 4 <> 3 AND tx_id % 8 <> 6",
        "parse_tx_json": tx + "SELECT event_ms, step, type, amount, name_orig, name_dest, transaction_hour, device_risk_level, is_fraud FROM tx WHERE tx_id % 5 <> 4",
        "parse_event_time": "WITH t(i, raw, ms) AS (VALUES (0, '1718000000000', 1718000000000), (1, '6000000', 6000), (2, '90000000000', 90000000000), (3, '00:00:06', 6000), (4, '01:02:03.5', 3723500), (5, 'PT1H2M3.5S', 3723500), (6, 'PT0.123S', 123), (7, '', 0), (8, 'junk', 0), (9, '12:34', 45240000)) SELECT event_id, raw, CAST(ms AS BIGINT) AS ms FROM events JOIN t ON event_id % 10 = i",
        "parse_amount": "SELECT event_id, CAST(CASE event_id % 6 WHEN 0 THEN event_id * 1000 WHEN 1 THEN event_id * 1000 + 500 WHEN 2 THEN event_id * 1000000 WHEN 4 THEN event_id + 0.5 ELSE 0 END AS DOUBLE) AS amount FROM events",
        "mask_account": "SELECT c_custkey, substr(c_name, 1, 4) || '****' || right(c_name, 4) AS account, CASE WHEN length('' || c_custkey) < 7 THEN '' || c_custkey ELSE substr('' || c_custkey, 1, 3) || '****' || right('' || c_custkey, 4) END AS phone, CASE WHEN length(c_mktsegment) < 8 THEN c_mktsegment ELSE substr(c_mktsegment, 1, 4) || '****' || right(c_mktsegment, 4) END AS device FROM customer",
        "valid_tx": tx + "SELECT tx_id, type, amount, name_orig FROM tx WHERE amount >= 0",
        "tx_adapter": tx + f"SELECT * REPLACE ({big('step is_flagged_fraud transaction_hour daily_tx_count is_fraud')}, {rnd('amount oldbalance_org newbalance_orig oldbalance_dest newbalance_dest')}) FROM tx",
        "prior_risks": tx + "SELECT tx_id, CAST(CASE tx_id % 4 WHEN 0 THEN 0.6 WHEN 1 THEN 0.5 WHEN 2 THEN 0.7 ELSE 0.3 END AS DOUBLE) AS source_risk, CAST(CASE city WHEN '上海' THEN 0.3 WHEN '北京' THEN 0.35 WHEN '深圳' THEN 0.4 WHEN '广州' THEN 0.25 WHEN '杭州' THEN 0.3 END AS DOUBLE) AS city_risk FROM tx",
        "cep_all": with_(TX, CEP) + "SELECT pattern, tx_id, next_ids, account_id, confidence FROM cep",
        "sql_chain_abc": with_(TX, CHAIN) + f"SELECT l_tx_id, r_tx_id, pair, round(td, 6) AS time_diff, {rnd('decay confidence')} FROM chain WHERE confidence > 0.6",
        "sql_chain_cogroup": tx + f""", c AS (SELECT l.tx_id AS l_tx_id, r.tx_id AS r_tx_id, l.event_ms // 3600000 * 3600000 AS l_window_ms, l.amount AS la, (r.event_ms - l.event_ms) / 1000.0 AS td, abs(l.amount - r.amount) / l.amount AS decay,
            row_number() OVER (PARTITION BY l.name_dest, l.event_ms // 3600000, l.name_orig, r.name_dest ORDER BY l.event_ms, l.tx_id, r.event_ms, r.tx_id) AS rn FROM tx l JOIN tx r ON l.name_dest = r.name_orig AND l.event_ms // 3600000 = r.event_ms // 3600000
            WHERE l.type = 'TRANSFER' AND r.type = 'TRANSFER' AND l.amount > 10000 AND r.amount > 10000 AND l.name_orig <> r.name_dest AND l.name_orig <> l.name_dest AND r.name_orig <> r.name_dest)
            SELECT l_tx_id, r_tx_id, l_window_ms, round(CAST({CHAIN_SCORE} AS DOUBLE), 6) AS confidence FROM c WHERE rn = 1 AND {CHAIN_SCORE} > 0.7""",
        "sql_scatter_cashout": with_(TX, CASHOUT) + f"SELECT account_id, l_tx_id, r_tx_id, round(td, 6) AS time_diff, {rnd('total_in ratio confidence')} FROM cashout WHERE confidence > 0.5",
        "tag_asof": with_(TX, CEP, TAG) + "SELECT tx_id, is_cep_matched, cep_rule_name FROM ta",
        "ml_input_anti": with_(TX, CEP, TAG) + "SELECT tx_id, name_orig, amount FROM ta WHERE NOT is_cep_matched",
        "sql_ip_gang": with_(TX, GANG) + f"SELECT * REPLACE ({rnd('total_amount confidence')}) FROM gang WHERE confidence > 0.6",
        "sql_scatter_in": with_(TX, INTO) + f"SELECT * REPLACE ({rnd('total_amount max_sender confidence')}) FROM into_ WHERE confidence > 0.5",
        "tx_duplicate": tx + "SELECT tx_id, name_orig AS tracking_account, amount FROM tx UNION ALL SELECT tx_id, name_dest, amount FROM tx",
        "behavior_seq": with_(TX, SEQ) + "SELECT account_id, count(*) AS n, string_agg('' || tx_id, ',' ORDER BY i) AS ids FROM sq GROUP BY account_id, session",
        "behavior_path": seqs + "SELECT account_id, behavior_path FROM f",
        "seq_features": seqs + "SELECT account_id, " + rnd("avg_amount std_amount max_amount total_amount balance_ratio cash_out_ratio velocity interval_mean interval_variance amount_slope freq_acceleration max_single_ratio", 4) + ", " + big("city_changes device_changes channel_changes night_count high_risk_count abroad_count distinct_cities distinct_devices distinct_channels out_degree distinct_dests") + " FROM f",
        "suspicious_seq": seqs + "SELECT account_id, " + " OR ".join(f"({c})" for c in features.SUSPICIOUS) + " AS suspicious FROM f",
        "graph_features": with_(SEQS, GRAPH, STATS) + "SELECT account_id, " + rnd(" ".join(features.FEATURES[23:]), 4) + " FROM fg",
        "behavior_score": seqs + f"SELECT account_id, round(CAST({points(scores.BEHAVIOR)} AS DOUBLE), 6) AS behavior_score FROM f",
        "ml_scores": with_(FULL) + "SELECT account_id, " + rnd("lr_score path_score stat_score behavior_score", 4) + " FROM sc",
        "ml_alerts": with_(FULL, ML) + "SELECT account_id, fraud_type, " + rnd("probability confidence", 4) + " FROM ma WHERE fraud_type IS NOT NULL",
        "gnn_topk": with_(SEQS, GNN) + "SELECT account_id, CAST(pos AS BIGINT) AS pos, dest, round(amount, 6) AS amount FROM n0 WHERE pos < 8",
        "gnn_scores": with_(SEQS, GNN) + "SELECT account_id, " + rnd("node_risk neighbor_risk deviation structure gnn_score") + " FROM gn",
        "gnn_alerts": with_(SEQS, GNN) + f"SELECT account_id, {first_of(scores.GNN_TYPES)} AS fraud_type, " + rnd("gnn_score", 4) + " FROM gn WHERE gnn_score >= 0.40",
        "api_detect": with_(TX, API) + f"SELECT tx_id, {rnd('behavior_score fraud_probability')}, is_suspect, {first_of(api.TYPES)} AS detected_type, CASE WHEN fraud_probability >= 0.85 THEN 'CRITICAL' WHEN fraud_probability >= 0.65 THEN 'HIGH' WHEN fraud_probability >= 0.35 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level, CASE WHEN rule_confidence > 0 THEN 'CEP_RULE' ELSE 'ML_ENSEMBLE' END AS source FROM a5",
        "graph_edges": with_(TX, GRAPH) + "SELECT tx_id, src, dst, amount, rank FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY event_ms DESC, tx_id DESC) AS rank FROM ge) WHERE rank <= 50",
        "graph_in_edges": with_(TX, GRAPH) + "SELECT tx_id, src, dst, amount, rank FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY event_ms DESC, tx_id DESC) AS rank FROM ge) WHERE rank <= 50",
        "graph_attributes": tx + "SELECT 'ip' AS kind, ip_segment AS name, count(DISTINCT name_orig) AS accounts, count(*) AS transactions FROM tx GROUP BY 2 UNION ALL SELECT 'device', device_id, count(DISTINCT name_orig), count(*) FROM tx GROUP BY 2",
        "graph_degree": with_(TX, GRAPH) + f"SELECT account, out_degree, in_degree, {rnd('out_amount in_amount')} FROM gd",
        "graph_direction": with_(TX, GRAPH) + f"SELECT account, {rnd('asymmetry freq_ratio net_flow time_concentration')} FROM gx",
        "graph_neighbors": with_(TX, GRAPH) + "SELECT account, out_neighbors, in_neighbors FROM gd",
        "graph_community": with_(TX, GRAPH, COMMUNITY) + "SELECT account, community FROM cm",
        "graph_cycles_2_3": with_(TX, GRAPH, CYCLES) + "SELECT account, CAST(length AS BIGINT) AS length, CAST(sum(n) AS BIGINT) AS cycles FROM cy GROUP BY 1, 2 HAVING sum(n) > 0",
        "graph_cycles": with_(TX, GRAPH, CYCLES) + "SELECT account, CAST(length AS BIGINT) AS length, CAST(sum(n) AS BIGINT) AS cycles FROM cy GROUP BY 1, 2 HAVING sum(n) > 0",
        "graph_clustering": with_(TX, GRAPH) + """, u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM gp), n AS (SELECT a, b FROM u UNION ALL SELECT b, a FROM u), d AS (SELECT a AS account, count(*) AS degree FROM n GROUP BY 1),
            t AS (SELECT x.a AS account, count(*) // 2 AS triangles FROM n x JOIN n y ON y.a = x.b JOIN n z ON z.a = y.b AND z.b = x.a GROUP BY 1)
            SELECT account, degree, coalesce(triangles, 0) AS triangles, round(CASE WHEN degree < 2 THEN 0 ELSE 2.0 * coalesce(triangles, 0) / (degree * (degree - 1)) END, 6) AS clustering FROM d LEFT JOIN t USING (account)""",
        "khop_counts": with_(TX, GRAPH) + """, u AS (SELECT src, dst FROM gp UNION SELECT dst, src FROM gp), h AS (SELECT DISTINCT src AS seed, src AS account, 0 AS hops FROM u UNION ALL SELECT src, dst, 1 FROM u UNION ALL SELECT DISTINCT a.src, b.dst, 2 FROM u a JOIN u b ON a.dst = b.src),
            m AS (SELECT seed, account, min(hops) AS hops FROM h GROUP BY 1, 2) SELECT seed, CAST(hops AS BIGINT) AS hops, count(*) AS accounts FROM m GROUP BY 1, 2""",
        "gnn_features": with_(SEQS, GRAPH) + """, s AS (SELECT DISTINCT account_id, session FROM sq),
            nb AS (SELECT s.account_id, s.session, q.name_dest AS party, sum(q.amount) AS amount FROM s JOIN sq q ON q.account_id = s.account_id AND q.session <= s.session GROUP BY 1, 2, 3),
            mt AS (SELECT account_id, session, party, count(*) AS c FROM (SELECT account_id, session, i, name_orig AS party FROM sq UNION SELECT account_id, session, i, name_dest FROM sq) GROUP BY 1, 2, 3),
            ns AS (SELECT nb.account_id, nb.session, count(*) AS n, avg(amount) AS mean, sqrt(greatest(avg(amount * amount) - avg(amount) ^ 2, 0)) AS std, avg(CASE WHEN amount > 50000 THEN 0.3 WHEN amount > 20000 THEN 0.2 WHEN amount > 10000 THEN 0.1 ELSE 0 END + CASE WHEN c >= 5 THEN 0.2 WHEN c >= 3 THEN 0.1 ELSE 0 END) AS risk
              FROM nb LEFT JOIN mt ON mt.account_id = nb.account_id AND mt.session = nb.session AND mt.party = nb.party GROUP BY 1, 2),
            cb AS (SELECT s.account_id, s.session, count(DISTINCT q.ip_segment) + count(DISTINCT q.device_id) AS c FROM s JOIN sq q ON q.account_id = s.account_id AND q.session <= s.session GROUP BY 1, 2),
            bt AS (SELECT account_id, session, coalesce(sum(amount) FILTER (type = 'TRANSFER'), 0) AS went, coalesce(sum(amount) FILTER (type <> 'TRANSFER'), 0) AS came, count(DISTINCT name_orig) + count(DISTINCT name_dest) AS parties FROM sq GROUP BY 1, 2),
            u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM gp), e2 AS (SELECT a, b FROM u UNION ALL SELECT b, a FROM u), dg AS (SELECT a AS account_id, count(*) AS degree FROM e2 GROUP BY 1),
            tr AS (SELECT x.a AS account_id, count(*) // 2 AS triangles FROM e2 x JOIN e2 y ON y.a = x.b JOIN e2 z ON z.a = y.b AND z.b = x.a GROUP BY 1),
            ct AS (SELECT account_id, CASE WHEN degree < 2 THEN 0 ELSE 2.0 * coalesce(triangles, 0) / (degree * (degree - 1)) END AS clustering FROM dg LEFT JOIN tr USING (account_id))
            SELECT account_id, CAST(session AS BIGINT) AS session, round(least(1.0, n / 20.0), 6) AS neighbor_degree, round(mean / 10000, 6) AS neighbor_amount_mean, round(std / 10000, 6) AS neighbor_amount_std, round(risk, 6) AS neighbor_tier_risk, round(least(1.0, c / 10.0), 6) AS community_attributes,
            round(CAST(coalesce(clustering, 0) AS DOUBLE), 6) AS clustering, round(CASE WHEN went + came > 0 THEN 2 * least(went, came) / (went + came) ELSE 0 END * least(1.0, parties / 10.0), 6) AS betweenness, CAST(1 AS DOUBLE) AS embedding_norm
            FROM ns JOIN cb USING (account_id, session) JOIN bt USING (account_id, session) LEFT JOIN ct USING (account_id)""",
        "drift_service": with_(TX, SAMPLES) + """, kn AS (SELECT feature, count(*) FILTER (NOT recent) AS nh, count(*) FILTER (recent) AS nr FROM sm GROUP BY 1), kc AS (SELECT feature, x, count(*) FILTER (NOT recent) AS h, count(*) FILTER (recent) AS r FROM sm GROUP BY 1, 2),
            ku AS (SELECT feature, sum(h) OVER w AS h, sum(r) OVER w AS r FROM kc WINDOW w AS (PARTITION BY feature ORDER BY x)), kd AS (SELECT feature, max(abs(r / nr - h / nh)) AS ks, max(nr) AS nr, max(nh) AS nh FROM ku JOIN kn USING (feature) GROUP BY 1),
            kl AS (SELECT feature, ks, (sqrt(nr * nh / (nr + nh)) + 0.12 + 0.11 / sqrt(nr * nh / (nr + nh))) * ks AS lam FROM kd),
            kp AS (SELECT feature, ks, CASE WHEN lam < 0.2 THEN 1 ELSE greatest(0, least(1, 2 * (SELECT sum(CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END * exp(-2.0 * k * k * lam * lam)) FROM range(1, 101) t(k)))) END AS p FROM kl)
            SELECT feature, round(ks, 6) AS ks, round(CAST(p AS DOUBLE), 6) AS p_value, p < 0.05 AS drift FROM kp""",
        "drift_half_cuts": with_(TX, SAMPLES) + """, r AS (SELECT feature AS series, x, row_number() OVER (PARTITION BY feature ORDER BY tx_id) - 1 AS i FROM sm),
            w AS (SELECT series, i // 100 AS "window", count(*) AS n, avg(x) FILTER (i % 100 < 50) AS before, avg(x) FILTER (i % 100 >= 50) AS after, max(abs(x)) AS top FROM r GROUP BY 1, 2)
            SELECT series, "window", round(before, 6) AS before, round(after, 6) AS after, top > 0 AND abs(after - before) > 0.05 * top AS drift FROM w WHERE n = 100""",
        "drift_fraud_rate": with_(TX, SAMPLES) + ", r AS (SELECT coalesce(avg(is_fraud) FILTER (tx_id < m - m // 10), 0) AS before, coalesce(avg(is_fraud) FILTER (tx_id >= m - m // 10), 0) AS after FROM tx, mx) SELECT round(before, 6) AS before, round(after, 6) AS after, abs(after - before) > 0.1 AS drift FROM r",
        "samples_by_type": tx + "SELECT type, hour, tx_id, round(amount, 6) AS amount FROM (SELECT *, event_ms // 3600000 AS hour, row_number() OVER (PARTITION BY type, event_ms // 3600000 ORDER BY md5('42:' || tx_id), tx_id) AS rn FROM tx) WHERE rn <= 5",
        "reservoir": tx + "SELECT tx_id, amount FROM tx WHERE is_fraud = 1 ORDER BY md5('42:' || tx_id), tx_id LIMIT 100",
        "review_states": with_(ALERTS, REVIEWS) + "SELECT alert_id, state, waited_ms, handled_ms, actions FROM rs",
        "review_load": with_(ALERTS, REVIEWS) + "SELECT state, count(*) AS n, round(avg(waited_ms), 6) AS waited_ms, round(avg(handled_ms), 6) AS handled_ms FROM rs GROUP BY 1",
        "alert_report": al + """SELECT alert_id, '账户' || account_id || '触发' || fraud_type || '，置信度' || CASE WHEN confidence >= 0.95 THEN '极高' WHEN confidence >= 0.85 THEN '很高' WHEN confidence >= 0.75 THEN '较高' WHEN confidence >= 0.60 THEN '中等' ELSE '较低' END || '，涉及金额'
            || CASE WHEN amount >= 10000 THEN (floor(amount / 10000 * 100 + 0.5)::BIGINT // 100) || '.' || lpad('' || (floor(amount / 10000 * 100 + 0.5)::BIGINT % 100), 2, '0') || '万元' ELSE (floor(amount * 100 + 0.5)::BIGINT // 100) || '.' || lpad('' || (floor(amount * 100 + 0.5)::BIGINT % 100), 2, '0') || '元' END AS report FROM alerts""",
        "explain_brief": with_(FULL) + ", c AS (" + " UNION ALL ".join(f"SELECT account_id, session, {i} AS i, '{c}' AS feature, CAST({c} AS DOUBLE) AS v, greatest(-3.0, least(3.0, {c} / {s})) / 3.0 * {w} AS contribution FROM fg" for i, (c, s, w) in enumerate(zip(features.FEATURES[:30], explain.STDS, scores.LR_WEIGHTS[:30], strict=True))) + """),
            o AS (SELECT *, row_number() OVER (PARTITION BY account_id, session ORDER BY abs(contribution) DESC, i) AS pos FROM c), p AS (SELECT *, row_number() OVER (PARTITION BY account_id, session ORDER BY pos) AS rn FROM o WHERE contribution > 0),
            w AS (SELECT account_id, session, string_agg(feature || '=' || CAST(round(v) AS BIGINT), '|' ORDER BY rn) AS words FROM p WHERE rn <= 3 GROUP BY 1, 2),
            r AS (SELECT account_id, session, [x for x in [""" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, n in explain.RULES) + """] if x IS NOT NULL] AS rules FROM fg)
            SELECT account_id, coalesce(words, '') || CASE WHEN len(rules) = 0 THEN '' ELSE ';规则:' || rules[1] || CASE WHEN len(rules) > 1 THEN '等' || len(rules) || '条' ELSE '' END END AS brief FROM r LEFT JOIN w USING (account_id, session)""",
        "graph_chain_depth": with_(TX, GRAPH) + "SELECT account, CAST(depth AS BIGINT) AS depth FROM gh",
        "graph_scatter": with_(TX, GRAPH) + "SELECT src AS account, 'out' AS direction, count(*) AS n, count(DISTINCT dst) AS others, round(sum(amount), 6) AS amount FROM ge GROUP BY 1 HAVING count(*) >= 2 AND count(DISTINCT dst) >= 2 UNION ALL SELECT dst, 'in', count(*), count(DISTINCT src), round(sum(amount), 6) FROM ge GROUP BY 1 HAVING count(*) >= 2 AND count(DISTINCT src) >= 2",
        "graph_counts": with_(TX, GRAPH) + "SELECT (SELECT count(*) FROM gd) AS nodes, (SELECT count(*) FROM ge) AS edges",
        "graph_risk": with_(TX, GRAPH, COMMUNITY, ACCOUNTS) + f"SELECT account, round(CAST({points(graph.RISK)} AS DOUBLE), 6) AS risk FROM ac",
        "graph_alerts": with_(TX, GRAPH, COMMUNITY, ACCOUNTS, GRAPH_ALERT) + "SELECT account, fraud_type, " + rnd("score confidence", 4) + " FROM ga",
        "khop_neighbors": with_(TX, GRAPH) + ", u AS (SELECT src, dst FROM gp UNION SELECT dst, src FROM gp), sd AS (SELECT DISTINCT src AS seed FROM gp WHERE src LIKE 'U%0') SELECT seed, account, CAST(min(h) AS BIGINT) AS hops FROM (SELECT seed, seed AS account, 0 AS h FROM sd UNION ALL SELECT seed, dst, 1 FROM sd JOIN u ON seed = src UNION ALL SELECT DISTINCT seed, b.dst, 2 FROM sd JOIN u a ON seed = a.src JOIN u b ON a.dst = b.src) GROUP BY 1, 2",
        "alerts_union": al + "SELECT account_id, fraud_type, round(confidence, 6) AS confidence, source, event_ms, round(amount, 6) AS amount, city FROM alerts",
        "all_alerts": with_(ALERTS, SEQ, FEAT, GRAPH, STATS, SCORED, ML, GNN, COMMUNITY, ACCOUNTS, GRAPH_ALERT) + f"""SELECT source, fraud_type, count(*) AS n, round(avg(confidence), 6) AS confidence FROM (SELECT source, fraud_type, confidence FROM alerts UNION ALL SELECT 'ML_ENSEMBLE', fraud_type, confidence FROM ma WHERE fraud_type IS NOT NULL
            UNION ALL SELECT 'GNN_GRAPH', {first_of(scores.GNN_TYPES)}, gnn_score FROM gn WHERE gnn_score >= 0.40 UNION ALL SELECT 'GRAPH_ANALYZER', fraud_type, confidence FROM ga) GROUP BY 1, 2""",
        "alert_enrich": with_(ALERTS, ENRICH) + f"SELECT alert_id, account_id, source, {big('cep_hits sql_hits edges')}, {rnd('volume confidence')}, CASE WHEN confidence >= 0.90 OR edges >= 4 THEN 'CRITICAL' WHEN confidence >= 0.75 OR edges >= 2 THEN 'HIGH' WHEN confidence >= 0.55 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level FROM e3 WHERE confidence >= 0.45",
        "alert_sink_projection": al + f"SELECT alert_id, account_id, fraud_type, round(confidence, 6) AS confidence, source, {TIME} AS alert_time, CASE WHEN confidence >= 0.9 THEN 'HIGH' WHEN confidence >= 0.75 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level, round(amount, 6) AS amount, city, event_ms // 86400000 AS day FROM alerts",
        "normal_tx": tx + f"SELECT 'TX_' || tx_id AS tx_id, name_orig AS account_id, round(amount, 6) AS amount, city, CAST(transaction_hour AS BIGINT) AS transaction_hour, {TIME} AS tx_time FROM tx WHERE is_fraud = 0",
        "eval_metrics": al + "SELECT (SELECT count(*) FROM tx) AS total_transactions, count(*) AS total_alerts, count(*) FILTER (source LIKE '%CEP%') AS cep_alerts, count(*) FILTER (source LIKE '%ML%') AS ml_alerts, CAST(0 AS BIGINT) AS fusion_alerts, round(count(*) / (SELECT count(*) FROM tx), 4) AS alert_rate FROM alerts",
        "eval_detail": al + ", q AS (SELECT fraud_type, count(*) AS alert_count, avg(confidence) AS avg_confidence FROM alerts GROUP BY 1), v AS (SELECT fraud_type, count(*) AS real_count FROM tx WHERE is_fraud = 1 GROUP BY 1), b AS (SELECT q.*, coalesce(real_count, 0) AS real_count FROM q LEFT JOIN v USING (fraud_type)), c AS (SELECT *, least(1.0, real_count / alert_count) AS type_precision, CASE WHEN real_count > 0 THEN least(1.0, alert_count / real_count) ELSE 0 END AS type_recall FROM b) SELECT fraud_type, alert_count, real_count, " + rnd("avg_confidence type_precision type_recall") + ", round(CASE WHEN type_precision + type_recall > 0 THEN 2 * type_precision * type_recall / (type_precision + type_recall) ELSE 0 END, 6) AS type_f1 FROM c",
        "validation_metrics": seqs + f", v AS (SELECT {points(scores.BEHAVIOR)} >= 0.5 AS hit, label FROM f), m AS (SELECT count(*) FILTER (hit AND label = 1) AS tp, count(*) FILTER (hit AND label = 0) AS fp, count(*) FILTER (NOT hit AND label = 0) AS tn, count(*) FILTER (NOT hit AND label = 1) AS fn FROM v) SELECT tp, fp, tn, fn, round(tp / (tp + fp), 6) AS \"precision\", round(tp / (tp + fn), 6) AS recall, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM m",
        "validation_dedup": al + ", v AS (SELECT account_id, fraud_type, count(*) AS c FROM alerts GROUP BY 1, 2) SELECT fraud_type, 'pass_first' AS dedup, count(*) AS n FROM v GROUP BY 1 UNION ALL SELECT fraud_type, 'pass_duplicate', CAST(sum(c - 1) AS BIGINT) FROM v WHERE c > 1 GROUP BY 1",
        "ablation_real": with_(ALERTS, SEQ, FEAT, GRAPH, STATS, SCORED, ML, COMMUNITY, ACCOUNTS, GRAPH_ALERT) + """, la AS (SELECT name_orig AS account_id, CAST(sum(is_fraud) >= 4 AS INTEGER) AS label FROM tx GROUP BY 1), hb AS (SELECT account_id, max(CASE WHEN source LIKE 'CEP%' THEN 1 ELSE 0 END) AS c1, max(CASE WHEN source LIKE 'SQL%' THEN 1 ELSE 0 END) AS c2 FROM alerts GROUP BY 1),
            v AS (SELECT label, coalesce(c1, 0) + 2 * coalesce(c2, 0) + CASE WHEN account_id IN (SELECT account FROM ga) THEN 4 ELSE 0 END + CASE WHEN account_id IN (SELECT account_id FROM ma WHERE fraud_type IS NOT NULL) THEN 8 ELSE 0 END AS bits FROM la LEFT JOIN hb USING (account_id))
            SELECT layers, count(*) FILTER (bits & layers <> 0 AND label = 1) AS tp, count(*) FILTER (bits & layers <> 0 AND label = 0) AS fp, count(*) FILTER (bits & layers = 0 AND label = 0) AS tn, count(*) FILTER (bits & layers = 0 AND label = 1) AS fn FROM v, range(1, 16) r(layers) GROUP BY 1""",
        "latency_percentiles": with_(TX, CEP) + ", v AS (SELECT pattern, list(last_ms - t.event_ms ORDER BY last_ms - t.event_ms) AS x, count(*) AS n FROM cep JOIN tx t USING (tx_id) GROUP BY 1) SELECT pattern, n, x[1] AS least, x[-1] AS most, round(list_avg(x), 6) AS mean, " + ", ".join(f"x[least(CAST(floor(n * {p}) AS BIGINT), n - 1) + 1] AS p{int(p * 100)}" for p in (0.5, 0.9, 0.95, 0.99)) + " FROM v",
        "throughput": tx + ", m AS (SELECT event_ms // 60000 * 60000 AS minute_ms, count(*) AS n FROM tx GROUP BY 1) SELECT minute_ms, n AS per_1m, (SELECT CAST(sum(n) AS BIGINT) FROM m b WHERE b.minute_ms BETWEEN a.minute_ms - 240000 AND a.minute_ms) AS per_5m, (SELECT CAST(sum(n) AS BIGINT) FROM m b WHERE b.minute_ms BETWEEN a.minute_ms - 840000 AND a.minute_ms) AS per_15m FROM m a",
        "serve_totals": al + "SELECT round(a, 2) AS fraud_total, round(b, 2) AS normal_total, round(a + b, 2) AS grand_total FROM (SELECT (SELECT sum(amount) FROM alerts) AS a, (SELECT sum(amount) FROM tx WHERE is_fraud = 0) AS b)",
        "serve_traffic": al + "SELECT slot, CAST((60 - (119 - slot) + 86400) % 86400 AS BIGINT) AS second, (SELECT count(*) FROM tx WHERE is_fraud = 0 AND (event_ms + 28800000) // 1000 % 86400 = (60 - (119 - slot) + 86400) % 86400) AS normal, (SELECT count(*) FROM alerts WHERE (event_ms + 28800000) // 1000 % 86400 = (60 - (119 - slot) + 86400) % 86400) AS fraud FROM range(0, 120) r(slot)",
        "serve_recent": al + "SELECT alert_id, account_id, round(confidence, 6) AS confidence, event_ms FROM alerts ORDER BY event_ms DESC, alert_id LIMIT 200",
        "serve_search": al + "SELECT alert_id, account_id, round(confidence, 6) AS confidence FROM alerts WHERE fraud_type LIKE '%链式%' AND source LIKE '%SQL%' AND confidence BETWEEN 0.7 AND 1 ORDER BY event_ms DESC, alert_id LIMIT 50 OFFSET 20",
        "serve_kpis": al + "SELECT (SELECT count(*) FROM tx) AS transactions, (SELECT count(*) FROM tx WHERE is_fraud = 1) AS labelled, count(*) AS alerts, count(DISTINCT account_id) AS accounts, count(*) FILTER (confidence >= 0.9) AS high_risk, round(count(*) / (SELECT count(*) FROM tx), 6) AS alert_rate FROM alerts",
        "feedback_stats": with_(ALERTS, FEEDBACK) + f"SELECT {RATES} FROM fb",
        "feedback_by_type": with_(ALERTS, FEEDBACK) + f"SELECT fraud_type, {RATES}, round(CASE WHEN count(*) >= 10 AND count(*) FILTER (feedback_type = 'FALSE_POSITIVE') / count(*) > 0.2 THEN 0.6 ELSE 0.55 END, 6)::DOUBLE AS suggested FROM fb GROUP BY 1",
        "feedback_keywords": with_(ALERTS, FEEDBACK) + "SELECT word, count(*) AS n FROM (SELECT lower(fraud_type) AS word FROM fb UNION ALL SELECT 'ok' FROM fb UNION ALL SELECT lower(source) FROM fb) WHERE length(word) >= 2 GROUP BY 1 ORDER BY n DESC, word LIMIT 5",
        "retrain_trigger": with_(ALERTS, FEEDBACK) + f", o AS (SELECT {RATES} FROM fb), w AS (SELECT max(fpr) AS worst_type FROM (SELECT fraud_type, {RATES} FROM fb GROUP BY 1) WHERE total >= 10) SELECT total, fpr, worst_type, CASE WHEN fpr > 0.10 THEN 'HIGH_FPR' WHEN worst_type > 0.30 THEN 'TYPE_FPR' WHEN total >= 50 THEN 'NEW_SAMPLES' ELSE 'NONE' END AS reason, total >= 50 OR fpr > 0.10 OR worst_type > 0.30 AS due FROM o, w",
        "review_queue_topk": al + "SELECT alert_id, account_id, round(p, 6) AS priority FROM (SELECT *, CASE WHEN confidence >= 0.90 THEN 4 WHEN confidence >= 0.75 THEN 3 WHEN confidence >= 0.50 THEN 2 ELSE 1 END * confidence AS p FROM alerts) ORDER BY p DESC, alert_id LIMIT 100",
        "feedback_backfill": al + "SELECT city, alert_id[1:1] < '8' AS known, count(*) AS n FROM (SELECT DISTINCT alert_id, city FROM alerts) GROUP BY 1, 2",
        "ks_stat": with_(TX, SAMPLES, KS) + "SELECT feature, round(ks, 6) AS ks FROM ks",
        "psi": with_(TX, SAMPLES, PSI) + "SELECT feature, round(psi, 4) AS psi FROM psi",
        "page_hinkley": tx + ", a AS (SELECT type AS series, tx_id, amount / 1000 AS x FROM tx), b AS (SELECT *, x - avg(x) OVER w - 0.005 AS dev FROM a WINDOW w AS (PARTITION BY series ORDER BY tx_id ROWS UNBOUNDED PRECEDING)), c AS (SELECT *, sum(dev) OVER w AS s FROM b WINDOW w AS (PARTITION BY series ORDER BY tx_id ROWS UNBOUNDED PRECEDING)), d AS (SELECT *, s - min(s) OVER w AS excess FROM c WINDOW w AS (PARTITION BY series ORDER BY tx_id ROWS UNBOUNDED PRECEDING)) SELECT series, count(*) AS n, round(max(excess), 3) AS excess, count(*) FILTER (excess > 50) AS drifts FROM d GROUP BY 1",
        "drift_severity": with_(TX, SAMPLES, KS, PSI) + ", k AS (SELECT (SELECT avg(ks) FROM ks) AS ks, (SELECT avg(psi) FROM psi) AS psi, (SELECT avg(CASE WHEN psi > 0.2 THEN 1.0 ELSE 0 END) FROM psi) AS ratio), s AS (SELECT *, CASE WHEN ks > 0.15 THEN 0.25 ELSE 0 END + CASE WHEN psi > 0.2 THEN 0.25 ELSE 0 END + 0.5 * ratio AS score FROM k), v AS (SELECT *, CASE WHEN score >= 0.7 OR ratio >= 0.6 THEN 'CRITICAL' WHEN score >= 0.5 OR ratio >= 0.4 THEN 'SEVERE' WHEN score >= 0.3 OR ratio >= 0.2 THEN 'MODERATE' WHEN score >= 0.15 OR ratio > 0 THEN 'MINOR' ELSE 'NONE' END AS severity FROM s) SELECT " + rnd("ks psi ratio score", 4) + ", severity, CASE severity WHEN 'MINOR' THEN 'RAISE_THRESHOLD' WHEN 'MODERATE' THEN 'RETRAIN_RECENT' WHEN 'SEVERE' THEN 'RETRAIN_AND_THRESHOLD' WHEN 'CRITICAL' THEN 'RULES_ONLY' ELSE 'NONE' END AS action, CAST(CASE WHEN severity = 'MINOR' THEN 0.5775 ELSE 0.55 END AS DOUBLE) AS threshold FROM v",
        "threshold_opt": with_(TX, API) + ", q AS (SELECT round(fraud_probability, 6) AS s, is_fraud AS label FROM a5), m AS (SELECT t, count(*) FILTER (round(s * 100, 9) >= t AND label = 1) AS tp, count(*) FILTER (round(s * 100, 9) >= t AND label = 0) AS fp, count(*) FILTER (round(s * 100, 9) < t AND label = 0) AS tn, count(*) FILTER (round(s * 100, 9) < t AND label = 1) AS fn FROM q, range(15, 66) r(t) GROUP BY 1), v AS (SELECT *, CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1, fp / (fp + tn) AS fpr FROM m) SELECT t, tp, fp, tn, fn, " + rnd("f1 fpr") + ", round(CASE WHEN fpr > 0.10 THEN f1 * greatest(0, 1 - 5 * (fpr - 0.10)) ELSE f1 END, 6) AS value FROM v",
        "top_features": with_(FULL) + ", c AS (" + " UNION ALL ".join(f"SELECT account_id, session, {i} AS i, '{c}' AS feature, greatest(-3.0, least(3.0, {c} / {s})) / 3.0 * {w} AS contribution FROM fg" for i, (c, s, w) in enumerate(zip(features.FEATURES[:30], explain.STDS, scores.LR_WEIGHTS[:30], strict=True))) + "), o AS (SELECT *, row_number() OVER (PARTITION BY account_id, session ORDER BY abs(contribution) DESC, i) - 1 AS pos FROM c) SELECT account_id, CAST(pos AS BIGINT) AS pos, feature, round(contribution, 4) AS contribution FROM o WHERE pos < 3",
        "triggered_rules": seqs + "SELECT account_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, n in explain.RULES) + "], lambda x: x IS NOT NULL), ';') AS rules FROM f",
        "risk_composite": with_(TX, API) + ", c AS (SELECT tx_id, round(least(1.0, greatest(0.0, fraud_probability)) * 0.40 + least((tx_id % 7) / 5.0, 1.0) * 0.20 + (tx_id % 10) / 10.0 * 0.15 + CASE WHEN amount < 5000 THEN 0.1 WHEN amount < 20000 THEN 0.4 WHEN amount < 100000 THEN 0.7 ELSE 1 END * 0.15 + CASE WHEN transaction_hour <= 3 THEN 1.0 WHEN transaction_hour <= 5 THEN 0.8 WHEN transaction_hour <= 7 THEN 0.3 WHEN transaction_hour >= 22 THEN 0.5 ELSE 0.1 END * 0.10, 9) AS composite FROM a5) SELECT tx_id, round(CAST(composite AS DOUBLE), 4) AS composite, CASE WHEN composite >= 0.90 THEN 'CRITICAL' WHEN composite >= 0.75 THEN 'HIGH' WHEN composite >= 0.50 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM c",
        "pattern_registry": al + "SELECT CASE " + " ".join(f"WHEN fraud_type LIKE '%{p}%' THEN '{f}'" for p, f in explain.PATTERN_FAMILIES) + " ELSE '其他' END AS family, count(*) AS n FROM alerts GROUP BY 1",
        "latest_upsert": tx + "SELECT name_orig AS k, max(tx_id) AS tx_id, arg_max(amount, tx_id) AS amount, arg_max(city, tx_id) AS city FROM tx GROUP BY 1",
        "serve_by_type": al + "SELECT fraud_type AS name, count(*) AS value FROM alerts GROUP BY 1",
        "serve_by_source": al + "SELECT CASE WHEN source LIKE 'CEP%' THEN 'CEP规则' ELSE 'SQL引擎' END AS name, count(*) AS value FROM alerts GROUP BY 1",
        "serve_by_confidence": al + "SELECT CASE WHEN confidence >= 0.9 THEN '高危(>90%)' WHEN confidence >= 0.7 THEN '中危(70-90%)' ELSE '低危(<70%)' END AS name, count(*) AS value FROM alerts GROUP BY 1",
        "serve_by_city": al + "SELECT city AS name, count(*) AS value FROM alerts GROUP BY 1",
        "serve_by_amount": al + "SELECT CASE WHEN amount >= 100000 THEN '10万以上' WHEN amount >= 50000 THEN '5-10万' WHEN amount >= 10000 THEN '1-5万' WHEN amount >= 1000 THEN '1千-1万' ELSE '1千以下' END AS name, count(*) AS value FROM alerts GROUP BY 1",
        "serve_rule_hits": al + "SELECT fraud_type AS name, count(*) AS hits FROM alerts GROUP BY 1",
        "serve_alert_count": al + "SELECT count(*) AS cnt FROM alerts",
        "serve_types": al + "SELECT DISTINCT fraud_type FROM alerts",
        "serve_before_hour": al + "SELECT count(*) AS cnt FROM alerts WHERE transaction_hour <= 8",
    }
    out |= later(out, tx, al, seqs)
    out["serve_drift_events"] = f"""SELECT sha256('mean_shift|' || w) AS event_id, w AS "window", round(score, 6) AS score, CASE WHEN score >= 1.0 THEN 'CRITICAL' WHEN score >= 0.7 THEN 'SEVERE' WHEN score >= 0.5 THEN 'MODERATE' ELSE 'MINOR' END AS severity,
        CASE WHEN score >= 1.0 THEN 'RULES_ONLY' WHEN score >= 0.7 THEN 'RETRAIN_AND_THRESHOLD' WHEN score >= 0.5 THEN 'RETRAIN_RECENT' ELSE 'RAISE_THRESHOLD' END AS action, CASE WHEN score < 0.5 THEN 0.5775 ELSE 0.55 END AS threshold
        FROM ({out['drift_mean_shift']}) WHERE drift ORDER BY w DESC LIMIT 30"""
    return out


def later(out: dict[str, str], tx: str, al: str, seqs: str) -> dict[str, str]:
    """SQL whose predicates and constants are written out here, not taken from the plans."""
    # rank 0: a name of its own in the registry; else the first name that contains the type or lies in it
    known = """(VALUES (1, '小额试探大额转出', '极高'), (2, '多层链式洗钱', '极高'), (3, '异地跨设备突发大额', '高'), (4, '分散转入集中提现', '高'), (5, '多渠道轮番转账', '高'), (6, '凌晨分批掏空', '极高'),
        (7, '小额掩护大额跑路', '极高'), (8, '团伙同IP批量作案', '极高'), (9, '多层链式洗钱(SQL)', '极高'), (10, '团伙同IP批量作案(SQL)', '极高'), (11, '分散转入集中提现(SQL)', '极高')) k(i, pattern, severity)"""
    links = tx.rstrip() + ", p AS (SELECT DISTINCT name_orig AS src, name_dest AS dst FROM tx WHERE name_orig <> name_dest)"
    runs = seqs + f""", v AS (SELECT hi // 3600000 AS sample_id, {points(scores.BEHAVIOR)} >= 0.5 AS hit, label FROM f), d AS (SELECT DISTINCT sample_id FROM v),
        m AS (SELECT d.sample_id, count(*) FILTER (hit AND label = 1) AS tp, count(*) FILTER (hit AND label = 0) AS fp, count(*) FILTER (NOT hit AND label = 0) AS tn, count(*) FILTER (NOT hit AND label = 1) AS fn FROM d JOIN v ON v.sample_id <= d.sample_id GROUP BY 1),
        h AS (SELECT *, tp + fp + tn + fn AS total_samples, tp + fn AS fraud_samples, fp + tn AS normal_samples, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r, (tp + tn) / (tp + fp + tn + fn) AS a FROM m),
        q AS (SELECT *, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1, round(p, 6) AS "precision", round(r, 6) AS recall, round(a, 6) AS accuracy FROM h) """
    fb = al.rstrip() + ",\n" + FEEDBACK + " "
    return {
        "pattern_described": al + f"""SELECT fraud_type, arg_min(pattern, rank) AS pattern, coalesce(arg_min(severity, rank), '中') AS severity, any_value(n) AS n
            FROM (SELECT t.*, pattern, severity, CASE WHEN fraud_type = pattern THEN 0 ELSE i END AS rank FROM (SELECT fraud_type, split_part(fraud_type, '(', 1) AS plain, count(*) AS n FROM alerts GROUP BY ALL) t LEFT JOIN {known} ON fraud_type = pattern OR contains(pattern, plain) OR contains(plain, pattern)) GROUP BY 1""",
        "serve_by_id": al + "SELECT alert_id, account_id, fraud_type, round(confidence, 6) AS confidence, round(amount, 6) AS amount FROM alerts ORDER BY alert_id, event_ms DESC LIMIT 1",
        "serve_until_now": al + f"SELECT *, normal_count + fraud_count AS total_count FROM (SELECT (SELECT count(*) FROM tx WHERE is_fraud = 0 AND {TIME} <= '12:00:00') AS normal_count, (SELECT count(*) FROM alerts WHERE {TIME} <= '12:00:00') AS fraud_count)",
        "serve_ml_count": f"SELECT count(*) AS cnt FROM ({out['ml_alerts']})",
        "serve_enabled": al + "SELECT alert_id, account_id, round(confidence, 6) AS confidence, event_ms FROM alerts WHERE source LIKE 'SQL%' ORDER BY event_ms DESC, alert_id LIMIT 200",
        "serve_between": al + "SELECT alert_id, account_id, round(confidence, 6) AS confidence, event_ms FROM alerts WHERE event_ms >= 1704074400000 AND event_ms <= 1704081600000 ORDER BY event_ms DESC, alert_id LIMIT 100",
        "serve_feedback_totals": fb + "SELECT c + w AS total_feedback, c AS confirmed_fraud, w AS false_positive, round(CASE WHEN c + w > 0 THEN w / (c + w) ELSE 0 END, 6) AS false_positive_rate FROM (SELECT count(*) FILTER (feedback_type = 'CONFIRMED_FRAUD') AS c, count(*) FILTER (feedback_type = 'FALSE_POSITIVE') AS w FROM fb)",
        "serve_training_history": runs + 'SELECT total_samples, f1, "precision", recall, accuracy, fraud_samples, normal_samples FROM q ORDER BY total_samples LIMIT 100',
        "serve_drift_history": runs + 'SELECT sample_id, f1, "precision", recall, accuracy, total_samples, fraud_samples FROM q ORDER BY sample_id DESC LIMIT 30',
        "serve_validation_latest": runs + "SELECT sample_id, tp, fp, tn, fn, f1 FROM q ORDER BY sample_id DESC LIMIT 1",
        "feedback_profile": fb + "SELECT fraud_type, count(*) AS false_positive, round(avg(CASE WHEN transaction_hour BETWEEN 0 AND 5 THEN 1.0 ELSE 0 END), 6) AS night_share, count(DISTINCT alert_id[3:3]) AS reviewers FROM fb WHERE feedback_type = 'FALSE_POSITIVE' GROUP BY 1",
        "feedback_recent": fb + "SELECT alert_id, fraud_type, event_ms, 'R' || alert_id[3:3] AS reviewer_id FROM fb WHERE feedback_type = 'FALSE_POSITIVE' ORDER BY event_ms DESC, alert_id LIMIT 30",
        "threshold_best": f"WITH tries AS ({out['threshold_opt']}), n AS (SELECT t, \"value\" AS v FROM tries), c AS (SELECT t, CASE WHEN fpr <= 0.05 THEN f1 ELSE 0 END AS v FROM tries WHERE t BETWEEN 25 AND 55) SELECT 'normal' AS mode, CAST(CASE WHEN max(v) > 0 THEN (SELECT min(t) FROM n WHERE v = (SELECT max(v) FROM n)) / 100.0 ELSE 0.55 END AS DOUBLE) AS threshold, max(v) AS \"value\" FROM n UNION ALL SELECT 'conservative', CAST(CASE WHEN max(v) > 0 THEN (SELECT min(t) FROM c WHERE v = (SELECT max(v) FROM c)) / 100.0 ELSE 0.55 END AS DOUBLE), max(v) FROM c",
        "fraud_buffer": tx + "SELECT tx_id, round(amount, 6) AS amount, fraud_type FROM tx WHERE is_fraud = 1 ORDER BY event_ms DESC, tx_id DESC LIMIT 200",
        "drift_mean_shift": with_(TX, SAMPLES).rstrip() + """, o AS (SELECT feature, x, tx_id - (SELECT min(tx_id) FROM tx) AS spot FROM sm), s AS (SELECT feature, spot // 500 AS w, count(*) AS n, avg(x) AS m, sum(x * x) - count(*) * avg(x) ^ 2 AS v, avg(x) FILTER (spot % 500 < 200) AS m2, avg(x) FILTER (spot % 500 < 400) AS m4,
            sum(x * x) FILTER (spot % 500 < 200) - 200 * (avg(x) FILTER (spot % 500 < 200)) ^ 2 AS v2, sum(x * x) FILTER (spot % 500 < 400) - 400 * (avg(x) FILTER (spot % 500 < 400)) ^ 2 AS v4 FROM o GROUP BY ALL),
            b0 AS (SELECT *, lag(m) OVER l AS bm, lag(v) OVER l AS bv FROM s WINDOW l AS (PARTITION BY feature ORDER BY w)),
            b1 AS (SELECT * REPLACE (CASE WHEN n < 200 THEN bm WHEN bm IS NULL THEN m2 ELSE 0.1 * m2 + 0.9 * bm END AS bm, CASE WHEN n < 200 THEN bv WHEN bv IS NULL THEN v2 ELSE 0.1 * v2 + 0.9 * bv END AS bv) FROM b0),
            b2 AS (SELECT * REPLACE (CASE WHEN n < 400 THEN bm ELSE 0.1 * m4 + 0.9 * bm END AS bm, CASE WHEN n < 400 THEN bv ELSE 0.1 * v4 + 0.9 * bv END AS bv), 500 * w + CASE WHEN n >= 400 THEN 400 WHEN n >= 200 THEN 200 ELSE 0 END AS seen FROM b1),
            r AS (SELECT w, avg(least(3.0, abs(m - bm) / sqrt(greatest(bv / greatest(1, seen - 1), 0.000001)))) AS score FROM b2 WHERE n >= 50 AND bm IS NOT NULL GROUP BY w) SELECT w, round(score, 6) AS score, score > 0.3 AS drift FROM r""",
        "graph_fund_chains": links + """ SELECT src AS account, src || '->' || dst AS path, CAST(1 AS BIGINT) AS edges, 'leaf' AS ending, '' AS back FROM p WHERE dst NOT IN (SELECT src FROM p)
            UNION ALL SELECT a.src, a.src || '->' || a.dst, 1, 'revisit', a.src FROM p a JOIN p b ON a.dst = b.src AND a.src = b.dst UNION ALL SELECT a.src, a.src || '->' || a.dst || '->' || b.dst, 2, 'depth', '' FROM p a JOIN p b ON a.dst = b.src AND a.src <> b.dst""",
        "graph_path": with_(TX, GRAPH).rstrip() + """, t0 AS (SELECT *, substr(src, 1, 8) || '→' || substr(dst, 1, 8) || '(' || CAST(round(amount) AS BIGINT) || ')' AS t FROM ge), t1 AS (SELECT src AS account, 1 AS side, event_ms, tx_id, t FROM t0 UNION ALL SELECT dst, 2, event_ms, tx_id, t FROM t0),
            t2 AS (SELECT *, row_number() OVER (PARTITION BY account, side ORDER BY event_ms DESC, tx_id DESC) AS rn FROM t1), t3 AS (SELECT account, side, CASE WHEN count(*) > 3 THEN max_by(t, rn) || '...' ELSE string_agg(t, '' ORDER BY rn DESC) END AS t FROM t2 WHERE rn <= 50 GROUP BY 1, 2)
            SELECT account, string_agg(t, ' ' ORDER BY side) || CASE WHEN account IN (SELECT account FROM rg) THEN ' | CYCLE detected' ELSE '' END AS path FROM t3 GROUP BY account""",
        "graph_shortest_ring": with_(TX, GRAPH) + "SELECT account, CAST(length AS BIGINT) AS length FROM rg",
    }
