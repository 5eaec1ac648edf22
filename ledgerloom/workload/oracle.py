"""The registered queries as plain SQL, written without looking at the Spark plans:
matching is stated here as pairs of rows, there as windows and counts."""

from __future__ import annotations

import re

# Common table expressions; each may name the others.
PARTS: dict[str, str] = {}


def _normal(text: str) -> str:
    return (
        f"trim(regexp_replace(replace(replace(replace(upper({text}), '£', ''), '''LL', ' WILL'), "
        f"'N''T', ' NOT'), '[^A-Z0-9]+', ' ', 'g'))"
    )


def _cents(column: str) -> str:
    return f"CAST(round({column} * 100) AS BIGINT)"


PARTS["f0"] = """
SELECT 'acc_' || c_custkey AS account_id, c_name AS display_name,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'credit' WHEN 'BUILDING' THEN 'investment'
    WHEN 'FURNITURE' THEN 'savings' ELSE 'current' END AS account_type
FROM customer"""

PARTS["f1"] = f"""
SELECT event_id, user_id, 'acc_' || user_id AS account_id, CAST(ts AS DATE) AS transaction_date,
  CASE WHEN event_type IN ('purchase', 'error', 'click') THEN -{_cents('value')} ELSE {_cents('value')} END AS amount_minor,
  upper(event_type) || ' ' || (event_id % 5) AS description,
  CASE user_id % 3 WHEN 0 THEN 'card-statement' WHEN 1 THEN 'bank-statement' ELSE 'bank-export' END AS source_type,
  CAST(CASE WHEN day(ts) <= 7 THEN 1 WHEN day(ts) <= 14 THEN 2 WHEN day(ts) <= 21 THEN 3 ELSE 4 END AS INTEGER) AS wk
FROM events"""

PARTS["wkly"] = """
SELECT f1.*, user_id || '-W' || wk AS ingestion_id,
  make_date(2024, 1, (wk - 1) * 7 + 1) AS period_from,
  make_date(2024, 1, CASE WHEN wk = 4 THEN 31 ELSE wk * 7 END) AS period_to
FROM f1"""

PARTS["again"] = """
SELECT * REPLACE (CASE WHEN event_id % 50 = 0 THEN transaction_date + 2 ELSE transaction_date END AS transaction_date),
  user_id || '-R' AS ingestion_id, DATE '2024-01-10' AS period_from, DATE '2024-01-20' AS period_to
FROM f1 WHERE user_id % 2 = 0 AND transaction_date BETWEEN DATE '2024-01-10' AND DATE '2024-01-20'"""

PARTS["f2"] = "SELECT * FROM wkly UNION ALL BY NAME SELECT * FROM again"

PARTS["f3x"] = """
SELECT * REPLACE ('bank-export' AS source_type, 'CARD ' || description AS description),
  user_id || '-X' AS ingestion_id, CAST(NULL AS DATE) AS period_from, CAST(NULL AS DATE) AS period_to
FROM f1 WHERE user_id % 3 = 1 AND event_id % 4 = 0"""

PARTS["f3"] = """
SELECT *, user_id || '-M' AS ingestion_id, CAST(NULL AS DATE) AS period_from, CAST(NULL AS DATE) AS period_to FROM f1
UNION ALL BY NAME SELECT * FROM f3x"""

PARTS["f23"] = "SELECT * FROM f2 UNION ALL BY NAME SELECT * FROM f3x"


def _numbered(name: str, rows: str) -> None:
    """Fingerprint, occurrence and id of every row of `rows`."""
    PARTS[f"{name}_k"] = f"""
SELECT *, sha256(ingestion_id || ':transaction:' || event_id) AS bronze_record_id,
  sha256(account_id || '|' || CAST(CAST(transaction_date AS TIMESTAMP) AS VARCHAR) || '|' || amount_minor || '|' || {_normal('description')}) AS fp,
  sha256(account_id || '|' || amount_minor || '|' || {_normal('description')}) AS loose
FROM {rows}"""
    PARTS[f"{name}_n"] = f"""
SELECT *, source_type || ':' || fp || '_' || occ AS sid FROM (
  SELECT *, row_number() OVER (PARTITION BY source_type, fp
    ORDER BY coalesce(period_to, DATE '2024-02-01'), event_id, ingestion_id, bronze_record_id) AS occ,
    row_number() OVER (PARTITION BY source_type, fp, ingestion_id ORDER BY event_id, bronze_record_id) AS k
  FROM {name}_k)"""


def _tiers(name: str) -> None:
    """Overlap and drift by comparing rows of overlapping statements."""
    n = f"{name}_n"
    PARTS[f"{name}_olap"] = f"""
SELECT a.sid AS absorbed, max_by(b.sid, (b.period_to, b.ingestion_id)) AS survivor
FROM {n} a JOIN {n} b ON a.source_type = b.source_type AND a.fp = b.fp AND a.k = b.k
WHERE (b.period_to, b.ingestion_id) > (a.period_to, a.ingestion_id)
  AND greatest(a.period_from, b.period_from) <= least(a.period_to, b.period_to)
  AND a.transaction_date BETWEEN greatest(a.period_from, b.period_from) - 3 AND least(a.period_to, b.period_to) + 3
GROUP BY a.sid"""
    PARTS[f"{name}_left"] = f"SELECT * FROM {n} WHERE sid NOT IN (SELECT absorbed FROM {name}_olap)"
    PARTS[f"{name}_ing"] = f"""
SELECT DISTINCT account_id, source_type, ingestion_id, period_from, period_to FROM {n} WHERE period_from IS NOT NULL"""
    PARTS[f"{name}_pairs"] = f"""
SELECT a.account_id, a.source_type, a.ingestion_id AS low, b.ingestion_id AS high, b.period_to AS high_to,
  greatest(a.period_from, b.period_from) AS lo, least(a.period_to, b.period_to) AS hi
FROM {name}_ing a JOIN {name}_ing b ON a.account_id = b.account_id AND a.source_type = b.source_type
  AND (b.period_to, b.ingestion_id) > (a.period_to, a.ingestion_id)
WHERE greatest(a.period_from, b.period_from) <= least(a.period_to, b.period_to)"""
    PARTS[f"{name}_lows"] = f"""
SELECT p.*, r.sid, r.loose, r.transaction_date AS d,
  count(*) OVER (PARTITION BY p.account_id, p.source_type, p.low, p.high, r.loose) AS candidates
FROM {name}_pairs p JOIN {name}_left r ON r.account_id = p.account_id AND r.source_type = p.source_type
  AND r.ingestion_id = p.low AND r.transaction_date BETWEEN p.lo - 3 AND p.hi + 3"""
    PARTS[f"{name}_highs"] = f"""
SELECT p.*, r.sid, r.loose, r.transaction_date AS d,
  count(*) OVER (PARTITION BY p.account_id, p.source_type, p.low, p.high, r.loose) AS candidates
FROM {name}_pairs p JOIN {name}_left r ON r.account_id = p.account_id AND r.source_type = p.source_type
  AND r.ingestion_id = p.high AND r.transaction_date BETWEEN p.lo - 3 AND p.hi + 3
WHERE NOT EXISTS (SELECT 1 FROM {n} o WHERE o.source_type = r.source_type AND o.ingestion_id = p.low
  AND o.fp = r.fp AND o.k = r.k)"""
    PARTS[f"{name}_drift"] = f"""
SELECT a.sid AS absorbed, max_by(b.sid, (b.high_to, b.high)) AS survivor
FROM {name}_lows a JOIN {name}_highs b ON a.account_id = b.account_id AND a.source_type = b.source_type
  AND a.low = b.low AND a.high = b.high AND a.loose = b.loose
WHERE a.candidates = 1 AND b.candidates = 1 AND abs(a.d - b.d) <= 3
GROUP BY a.sid"""
    PARTS[f"{name}_stand"] = f"SELECT * FROM {name}_left WHERE sid NOT IN (SELECT absorbed FROM {name}_drift)"
    PARTS[f"{name}_ranked"] = f"""
SELECT *, row_number() OVER (PARTITION BY account_id, transaction_date, amount_minor, source_type ORDER BY fp, occ) AS nth
FROM {name}_stand"""
    PARTS[f"{name}_cross"] = f"""
SELECT o.sid AS absorbed, p.sid AS survivor FROM {name}_ranked o JOIN {name}_ranked p
  USING (account_id, transaction_date, amount_minor, nth)
WHERE o.source_type = 'bank-export' AND p.source_type = 'bank-statement'"""
    PARTS[f"{name}_final"] = f"SELECT * FROM {name}_stand WHERE sid NOT IN (SELECT absorbed FROM {name}_cross)"
    PARTS[f"{name}_edges"] = f"""
SELECT *, 'overlap-window(' || split_part(absorbed, ':', 1) || ')' AS policy FROM {name}_olap
UNION ALL SELECT *, 'overlap-window-date-shifted(' || split_part(absorbed, ':', 1) || ')' FROM {name}_drift
UNION ALL SELECT *, 'cross-source(bank-statement-preferred)' FROM {name}_cross"""
    PARTS[f"{name}_walk"] = f"""
SELECT sid AS start, sid AS here, 0 AS step FROM {n}
UNION ALL SELECT w.start, e.survivor, w.step + 1 FROM {name}_walk w JOIN {name}_edges e ON w.here = e.absorbed"""
    PARTS[f"{name}_end"] = f"SELECT start AS sid, max_by(here, step) AS survivor FROM {name}_walk GROUP BY start"
    PARTS[f"{name}_sources"] = f"""
SELECT DISTINCT e.survivor AS silver_transaction_id, r.bronze_record_id, r.ingestion_id, r.source_type, p.policy AS match_policy
FROM {n} r JOIN {name}_end e USING (sid)
JOIN (SELECT sid, 'fingerprint' AS policy FROM {n} UNION ALL SELECT absorbed, policy FROM {name}_edges) p USING (sid)"""


for _name, _rows in (("m2", "f2"), ("m23", "f23"), ("m3", "f3")):
    _numbered(_name, _rows)
    _tiers(_name)

PARTS["f4"] = """
SELECT sha256(user_id || '-W' || wk || ':transaction:' || event_id) AS bronze_record_id, account_id, source_type,
  CAST(sum(amount_minor) OVER (PARTITION BY account_id ORDER BY transaction_date, event_id) AS BIGINT) AS balance_minor,
  'GBP' AS currency, transaction_date AS as_of_date,
  make_date(2024, 1, CASE WHEN wk = 4 THEN 31 ELSE wk * 7 END) AS period_to, event_id AS line_number,
  CASE WHEN (user_id + wk) % 11 = 0 THEN false WHEN (user_id + wk) % 13 = 0 THEN NULL ELSE true END AS reconciled,
  user_id, wk, event_id, amount_minor
FROM f1"""


def _latest(where: str = "true") -> str:
    """Sorted rows, first per account; the disproven ones looked up apart."""
    return f"""
SELECT account_id, balance_minor, currency, greatest(as_of_date, period_to) AS as_of_date,
  coalesce((SELECT max(x.as_of_date) FROM f4 x WHERE x.account_id = r.account_id AND x.reconciled = false AND {where}
    ) > greatest(as_of_date, period_to), false) AS balance_may_be_stale, 'printed' AS balance_source
FROM (SELECT *, row_number() OVER (PARTITION BY account_id
    ORDER BY as_of_date DESC, period_to DESC, line_number DESC, bronze_record_id DESC) AS rn
  FROM f4 WHERE {where} AND reconciled IS DISTINCT FROM false) r WHERE rn = 1"""


PARTS["f5"] = """
SELECT user_id, wk, arg_max(balance_minor, (as_of_date, event_id)) AS derived_minor,
  CAST(arg_max(balance_minor, (as_of_date, event_id)) - sum(amount_minor) AS BIGINT) AS opening_minor,
  arg_max(balance_minor, (as_of_date, event_id)) + CASE WHEN (user_id + wk) % 11 = 0 THEN 1 ELSE 0 END AS closing_minor
FROM f4 GROUP BY user_id, wk"""
PARTS["f6"] = f"""
SELECT 'acc_' || l_suppkey AS account_id, p_name AS fund_name, last_day(CAST(l_shipdate AS DATE)) AS as_of_date,
  CAST(sum({_cents('l_extendedprice')}) AS BIGINT) AS total_value_minor
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL"""
PARTS["f7"] = """
SELECT 'identifier' AS kind, substr(sha256('CUST' || c_custkey), 1, 12) AS key, f0.* FROM customer
  JOIN f0 ON f0.account_id = 'acc_' || c_custkey WHERE c_custkey % 10 <> 9
UNION ALL SELECT 'source_type', 'bank-export', 'acc_export', 'Export account', 'current'"""
PARTS["raw"] = """
SELECT w.*, w.ingestion_id || '.txt' AS filename, sha256(w.ingestion_id || ':transaction:' || event_id) AS bronze_record_id,
  CASE WHEN source_type <> 'bank-export' THEN substr(sha256('CUST' || w.user_id), 1, 12) END AS account_identifier,
  CASE WHEN source_type <> 'bank-export' THEN 'closing_balance' END AS check_name,
  opening_minor, closing_minor, derived_minor, closing_minor = derived_minor AS matches
FROM wkly w JOIN f5 ON w.user_id = f5.user_id AND w.wk = f5.wk"""
PARTS["resolved"] = """
SELECT r.* EXCLUDE (account_id), coalesce(i.account_id, s.account_id) AS account_id FROM raw r
LEFT JOIN f7 i ON i.kind = 'identifier' AND i.key = r.account_identifier
LEFT JOIN f7 s ON s.kind = 'source_type' AND s.key = r.source_type"""
PARTS["f8"] = """
SELECT ingestion_id, source_type, CASE WHEN (user_id + wk) % 17 = 0 THEN 'parse_failed' ELSE 'complete' END AS status,
  any_value(matches) AS matches, user_id % 5 = 0 AS allowed, any_value(closing_minor) AS closing_minor,
  any_value(derived_minor) AS derived_minor, count(*) AS record_count, user_id, wk
FROM raw GROUP BY ingestion_id, source_type, user_id, wk"""
PARTS["excl"] = """
SELECT ingestion_id, source_type, CASE WHEN status <> 'complete' THEN 'manifest status is parse_failed, not complete'
  ELSE 'reconciliation mismatch, no allow override' END AS reason
FROM f8 WHERE status <> 'complete' OR (NOT matches AND NOT allowed)"""
PARTS["f9"] = f"""
SELECT o_orderkey, 'acc_' || o_custkey AS account_id, CAST(o_orderdate AS DATE) AS transaction_date,
  CASE WHEN o_orderstatus IN ('F', 'P') THEN -{_cents('o_totalprice')} ELSE {_cents('o_totalprice')} END AS amount_minor
FROM orders"""
PARTS["f12"] = """
SELECT 'acc_' || o_custkey AS account_id, 'card-statement' AS source_type,
  o_custkey || '-' || CAST(date_trunc('quarter', o_orderdate) AS DATE) AS ingestion_id,
  min(CAST(o_orderdate AS DATE)) AS period_from, max(CAST(o_orderdate AS DATE)) AS period_to
FROM orders GROUP BY o_custkey, date_trunc('quarter', o_orderdate)"""
PARTS["bal"] = _latest()
PARTS["bal20"] = _latest("as_of_date <= DATE '2024-01-20'").replace(
    "x.reconciled = false AND as_of_date", "x.reconciled = false AND x.as_of_date")
PARTS["hold"] = """
SELECT * FROM f6 WHERE as_of_date = (SELECT max(x.as_of_date) FROM f6 x WHERE x.account_id = f6.account_id)"""
PARTS["brk"] = """
SELECT b.account_id, b.account_id AS source, balance_minor AS balance_or_value, as_of_date,
  CASE WHEN account_type = 'credit' THEN -balance_minor ELSE balance_minor END AS contribution_to_net_worth, balance_may_be_stale
FROM bal b LEFT JOIN f0 USING (account_id)
UNION ALL SELECT account_id, fund_name, total_value_minor, as_of_date, total_value_minor, false FROM hold"""
PARTS["periods"] = """
SELECT DISTINCT account_id, source_type, ingestion_id, filename, period_from, period_to FROM resolved WHERE account_id IS NOT NULL"""
PARTS["status"] = """
SELECT DISTINCT account_id, source_type, ingestion_id, filename, check_name, opening_minor AS expected_opening_minor,
  closing_minor AS expected_closing_minor, derived_minor AS derived_closing_minor, matches
FROM resolved WHERE account_id IS NOT NULL AND check_name IS NOT NULL"""
PARTS["cont"] = """
SELECT account_id, p_source AS source_type, source_type AS next_source_type, p_ing AS ingestion_id, ingestion_id AS next_ingestion_id,
  p_file AS filename, filename AS next_filename, p_close AS expected_closing_minor, expected_opening_minor,
  CASE WHEN period_from - p_to > 3 THEN NULL ELSE p_close = expected_opening_minor END AS matches,
  period_from - p_to > 3 AS gap_related
FROM (SELECT s.*, p.period_from, p.period_to,
    lag(s.source_type) OVER w AS p_source, lag(s.ingestion_id) OVER w AS p_ing, lag(s.filename) OVER w AS p_file,
    lag(expected_closing_minor) OVER w AS p_close, lag(period_to) OVER w AS p_to
  FROM status s JOIN periods p USING (account_id, source_type, ingestion_id)
  WINDOW w AS (PARTITION BY s.account_id ORDER BY period_from, period_to, s.ingestion_id)) WHERE p_ing IS NOT NULL"""
PARTS["contrib"] = """
SELECT s.ingestion_id, CAST(sum(t.amount_minor) AS BIGINT) AS contribution_minor
FROM m2_sources s JOIN m2_final t ON s.bronze_record_id = t.bronze_record_id GROUP BY s.ingestion_id"""
PARTS["roll"] = """
SELECT account_id, source_type, ingestion_id, filename, expected_opening_minor, expected_closing_minor,
  expected_opening_minor + coalesce(contribution_minor, 0) AS silver_derived_closing_minor,
  coalesce(expected_opening_minor + coalesce(contribution_minor, 0) = expected_closing_minor, false) AS matches
FROM status LEFT JOIN contrib USING (ingestion_id)
WHERE expected_opening_minor IS NOT NULL AND source_type IN ('card-statement', 'bank-statement')"""
PARTS["log"] = """
SELECT 'bronze_self_check' AS check_type, check_name, account_id, source_type, NULL AS next_source_type, ingestion_id,
  NULL AS next_ingestion_id, filename, NULL AS next_filename, expected_opening_minor, expected_closing_minor,
  derived_closing_minor, matches, false AS gap_related FROM status
UNION ALL SELECT 'continuity', 'balance_continuity', account_id, source_type, next_source_type, ingestion_id, next_ingestion_id,
  filename, next_filename, expected_opening_minor, expected_closing_minor, NULL, matches, gap_related FROM cont
UNION ALL SELECT 'silver_rollforward', 'silver_rollforward', account_id, source_type, NULL, ingestion_id, NULL,
  filename, NULL, expected_opening_minor, expected_closing_minor, silver_derived_closing_minor, matches, false FROM roll"""
PARTS["cal"] = """
SELECT a.account_id, coalesce(display_name, a.account_id) AS display_name, CAST(month AS DATE) AS month,
  CASE WHEN EXISTS (SELECT 1 FROM f12 p WHERE p.account_id = a.account_id AND p.period_from <= last_day(month) AND p.period_to >= month)
    THEN 'covered' WHEN month BETWEEN own_first AND own_last THEN 'gap' ELSE 'no_data' END AS status
FROM (SELECT account_id, date_trunc('month', min(period_from)) AS own_first, date_trunc('month', max(period_to)) AS own_last
  FROM f12 GROUP BY account_id) a
CROSS JOIN (SELECT CAST(unnest(generate_series(min(date_trunc('month', period_from)), max(date_trunc('month', period_to)), INTERVAL 1 MONTH)) AS DATE) AS month FROM f12)
LEFT JOIN f0 USING (account_id)"""


def sql(final: str) -> str:
    """`final` behind the parts it needs, in an order in which each is known."""
    chosen: dict[str, str] = {}

    def need(text: str, within: str | None = None) -> None:
        for name in dict.fromkeys(re.findall(r"[a-z_0-9]+", text)):
            if name in PARTS and name not in chosen and name != within:
                need(PARTS[name], name)
                chosen[name] = PARTS[name]

    need(final)
    heads = ",\n".join(f"{n} AS ({body})" for n, body in chosen.items())
    return f"WITH RECURSIVE {heads}\n{final}" if heads else final


ORACLE: dict[str, str] = {}


def _spend(part: str, name: str, where: str) -> str:
    return (
        f"SELECT CAST(date_trunc('{part}', transaction_date) AS DATE) AS {name}, CAST(sum(-amount_minor) AS BIGINT) AS spend_minor "
        f"FROM f9 WHERE amount_minor < 0 AND {where} GROUP BY 1"
    )


_YEAR = "year(transaction_date) = 1997"
ORACLE["monthly_spend"] = sql(_spend("month", "month", _YEAR))
ORACLE["weekly_spend"] = sql(_spend("week", "week", "date_trunc('month', transaction_date) = DATE '1997-05-01'"))
ORACLE["max_weekly_spend"] = sql(f"SELECT max(spend_minor) AS max_spend_minor FROM ({_spend('week', 'week', _YEAR)})")
ORACLE["max_monthly_spend"] = sql(f"SELECT max(spend_minor) AS max_spend_minor FROM ({_spend('month', 'month', 'true')})")
ORACLE["available_months"] = sql("SELECT DISTINCT CAST(date_trunc('month', transaction_date) AS DATE) AS month FROM f9")
ORACLE["available_years"] = sql("SELECT DISTINCT year(transaction_date) AS year FROM f9")

_CLEAN = "trim(replace(replace(replace(upper(t), 'CR', ''), '£', ''), ',', ''))"
ORACLE["money_parse"] = f"""
SELECT event_id, CAST(trunc(CAST(CASE WHEN regexp_matches({_CLEAN}, '^[-+]?[0-9]+\\.[0-9]+$') THEN {_CLEAN}
  ELSE nullif(regexp_extract({_CLEAN}, '[-+]?[0-9]+\\.[0-9][0-9]'), '') END AS DECIMAL(28, 8)) * 100) AS BIGINT) AS amount_minor
FROM (SELECT event_id, CASE event_id % 9 WHEN 0 THEN '£' || a WHEN 1 THEN '-£' || a WHEN 2 THEN a || 'CR' WHEN 3 THEN '-'
  WHEN 4 THEN CAST(CAST(trunc(CAST(value AS DECIMAL(18, 2))) AS BIGINT) AS VARCHAR) WHEN 5 THEN '+' || a || '9'
  WHEN 6 THEN 'paid ' || a || ' today' WHEN 7 THEN '1 ' || a ELSE '  ' || a || '  ' END AS t
  FROM (SELECT event_id, value, format('{{:,.2f}}', CAST(value AS DECIMAL(18, 2))) AS a FROM events))"""
ORACLE["money_format"] = f"""
SELECT o_orderkey, '£' || format('{{:,.2f}}', m / 100.0) AS plain,
  CASE WHEN m < 0 THEN '-' ELSE '+' END || '£' || format('{{:,.2f}}', abs(m) / 100.0) AS signed,
  'USD ' || format('{{:,.2f}}', m / 100.0) AS dollars, 'JPY ' || format('{{:,}}', m) AS yen
FROM (SELECT o_orderkey, {_cents('o_totalprice')} - 20000000 AS m FROM orders)"""
ORACLE["description_normalize"] = f"""
SELECT conv_id, turn, {_normal("replace('£5 we''ll don''t ' || text, 'ß', 'SS')")} AS normalized FROM conversations"""
ORACLE["fingerprints"] = sql("SELECT event_id, fp AS content, loose FROM f1_k")
PARTS["f1_k"] = f"""
SELECT event_id, sha256(account_id || '|' || strftime(transaction_date, '%Y-%m-%d 00:00:00') || '|' || amount_minor || '|' || {_normal('description')}) AS fp,
  sha256(account_id || '|' || amount_minor || '|' || {_normal('description')}) AS loose FROM f1"""
ORACLE["fingerprints"] = sql("SELECT event_id, fp AS content, loose FROM f1_k")
ORACLE["source_keys"] = sql("""
SELECT event_id, 'card_txn_' || account_id || '_' || d || '_' || substr(replace(description, ' ', '_'), 1, 10) || '_' || amount_minor
    || '_' || substr(sha256(description || '|' || amount_minor), 1, 8) AS txn_key,
  'holding_' || account_id || '_' || d || '_' || substr(replace(description, ' ', '_'), 1, 15) || '_' || d
    || '_' || substr(sha256(description), 1, 8) AS snapshot_key,
  sha256(account_id || ':transaction:' || event_id) AS record_id
FROM (SELECT *, strftime(transaction_date, '%d%m%Y') AS d FROM f1)""")
ORACLE["masked_ids"] = """
SELECT c_custkey, substr(sha256(replace('AB' || upper(c_name) || '1', ' ', '')), 1, 12) AS masked, lower(c_mktsegment) AS slug FROM customer"""
ORACLE["year_inference"] = """
SELECT o_orderkey, CASE WHEN this <= up + 7 THEN this WHEN last <= up + 7 THEN last ELSE least(this, last) END AS inferred FROM (
  SELECT o_orderkey, up, CAST(try_strptime(strftime(d, '%-d %b ') || year(up), '%d %b %Y') AS DATE) AS this,
    CAST(try_strptime(strftime(d, '%-d %b ') || (year(up) - 1), '%d %b %Y') AS DATE) AS last
  FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 41 AS INTEGER) - 9 AS up FROM orders))"""
ORACLE["year_in_period"] = """
SELECT o_orderkey, CASE WHEN a BETWEEN lo - 3 AND hi + 3 THEN strftime(d, '%-d %b ') || year(lo)
  WHEN b BETWEEN lo - 3 AND hi + 3 THEN strftime(d, '%-d %b ') || year(hi) END AS dated FROM (
  SELECT *, CAST(try_strptime(strftime(d, '%-d %b ') || year(lo), '%d %b %Y') AS DATE) AS a,
    CAST(try_strptime(strftime(d, '%-d %b ') || year(hi), '%d %b %Y') AS DATE) AS b
  FROM (SELECT *, lo + 29 AS hi FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d,
    CAST(o_orderdate AS DATE) - CAST(o_orderkey % 31 - 6 AS INTEGER) AS lo FROM orders)))"""

ORACLE["accounts_table"] = sql("""
SELECT account_id, min_by(display_name, kind || key) AS display_name, min_by(account_type, kind || key) AS account_type,
  coalesce(string_agg(CASE WHEN kind = 'identifier' THEN key END, ',' ORDER BY key), '') AS account_identifiers,
  coalesce(string_agg(CASE WHEN kind = 'source_type' THEN key END, ',' ORDER BY key), '') AS source_types
FROM f7 GROUP BY account_id""")
ORACLE["account_resolution"] = sql("SELECT bronze_record_id, source_type, account_identifier, account_id FROM resolved")
ORACLE["unmapped_accounts"] = sql("""
SELECT source_type, account_identifier, min_by(description, (ingestion_id, event_id)) AS sample_description, count(*) AS record_count
FROM raw WHERE (account_identifier IS NOT NULL AND account_identifier NOT IN (SELECT key FROM f7 WHERE kind = 'identifier'))
  OR (account_identifier IS NULL AND source_type NOT IN (SELECT key FROM f7 WHERE kind = 'source_type'))
GROUP BY source_type, account_identifier""")
ORACLE["eligible_rows"] = sql("SELECT bronze_record_id, ingestion_id FROM raw WHERE ingestion_id NOT IN (SELECT ingestion_id FROM excl)")
ORACLE["excluded_ingestions"] = sql("SELECT * FROM excl")
ORACLE["quarantine_list"] = sql("""
SELECT ingestion_id, source_type, 'closing_balance' AS check_name, closing_minor AS expected_closing_minor,
  derived_minor AS derived_closing_minor FROM f8 WHERE NOT matches AND NOT allowed""")

ORACLE["occurrence_numbers"] = sql("SELECT bronze_record_id, occ AS occurrence, sid AS silver_transaction_id FROM m2_n")
ORACLE["dup_suffix"] = sql("""
SELECT event_id, description || CASE WHEN n > 1 THEN '_dup' || (n - 1) ELSE '' END AS bronze_source_key
FROM (SELECT *, row_number() OVER (PARTITION BY account_id, description ORDER BY event_id) AS n FROM f1)""")
ORACLE["overlap_pairs"] = sql("""
SELECT account_id, source_type, least(low, high) AS ingestion_a, greatest(low, high) AS ingestion_b, lo AS window_from, hi AS window_to
FROM m2_pairs""")
PARTS["bounds"] = """
SELECT *, row_number() OVER w AS stretch, lead(day) OVER w AS next_day FROM (
  SELECT account_id, source_type, period_from AS day FROM m2_ing UNION SELECT account_id, source_type, period_to + 1 FROM m2_ing)
WINDOW w AS (PARTITION BY account_id, source_type ORDER BY day)"""
ORACLE["overlap_stretches"] = sql("""
SELECT b.account_id, b.source_type, stretch, day AS stretch_from, next_day - 1 AS stretch_to, count(*) AS members
FROM bounds b JOIN m2_ing i ON i.account_id = b.account_id AND i.source_type = b.source_type AND day BETWEEN i.period_from AND i.period_to
GROUP BY ALL HAVING count(*) > 1""")
ORACLE["overlap_members"] = sql("""
SELECT i.account_id, i.source_type, ingestion_id, period_from, period_to, min(stretch) AS first_stretch, max(stretch) AS last_stretch
FROM m2_ing i JOIN bounds b ON i.account_id = b.account_id AND i.source_type = b.source_type AND day BETWEEN i.period_from AND i.period_to
GROUP BY ALL""")
ORACLE["overlap_dedupe"] = sql("SELECT sid AS silver_transaction_id, bronze_record_id, ingestion_id, amount_minor FROM m2_left")
ORACLE["date_drift_dedupe"] = sql("SELECT absorbed, survivor FROM m2_drift")
ORACLE["cross_source_dedupe"] = sql("SELECT absorbed, survivor FROM m3_cross")
ORACLE["match_transactions"] = sql("""
SELECT sid AS silver_transaction_id, bronze_record_id, ingestion_id, source_type, account_id, transaction_date, description, amount_minor
FROM m23_final""")
ORACLE["transaction_sources"] = sql("SELECT * FROM m23_sources")
ORACLE["deduplicated_monthly_spend"] = sql("""
SELECT account_id, CAST(date_trunc('month', transaction_date) AS DATE) AS month, CAST(sum(-amount_minor) AS BIGINT) AS spend_minor,
  count(*) AS payments FROM m23_final WHERE amount_minor < 0 GROUP BY 1, 2""")

ORACLE["current_balances"] = sql("SELECT * FROM bal")
ORACLE["balances_as_of"] = sql("SELECT * FROM bal20")
ORACLE["wholly_disproven_accounts"] = sql("""
SELECT account_id FROM f4 GROUP BY account_id HAVING count(*) = count(*) FILTER (WHERE reconciled = false OR user_id % 9 = 0)""")
ORACLE["latest_holdings"] = sql("SELECT account_id, fund_name, as_of_date, total_value_minor FROM hold")
ORACLE["net_worth"] = sql("SELECT CAST(coalesce(sum(contribution_to_net_worth), 0) AS BIGINT) AS net_worth_minor FROM brk")
PARTS["o_bal"] = """
SELECT * FROM (SELECT f9.*, row_number() OVER (PARTITION BY account_id ORDER BY transaction_date DESC, o_orderkey DESC) AS rn FROM f9) WHERE rn = 1"""
PARTS["o_then"] = """
SELECT * FROM (SELECT f9.*, row_number() OVER (PARTITION BY account_id ORDER BY transaction_date DESC, o_orderkey DESC) AS rn FROM f9
  WHERE transaction_date <= (SELECT max(transaction_date) FROM o_bal) - INTERVAL 1 MONTH) WHERE rn = 1"""
PARTS["h_then"] = """
SELECT * FROM (SELECT *, max(as_of_date) OVER (PARTITION BY account_id) AS newest FROM f6
  WHERE as_of_date <= (SELECT max(transaction_date) FROM o_bal) - INTERVAL 1 MONTH) WHERE as_of_date = newest"""
_WORTH = """(SELECT coalesce(sum(CASE WHEN account_type = 'credit' THEN -amount_minor ELSE amount_minor END), 0) FROM {b} LEFT JOIN f0 USING (account_id))
  + (SELECT coalesce(sum(total_value_minor), 0) FROM {h})"""
ORACLE["net_worth_delta"] = sql(f"""
SELECT CAST(now AS BIGINT) AS net_worth_minor, CAST(now - before AS BIGINT) AS delta_minor FROM (
  SELECT {_WORTH.format(b='o_bal', h='hold')} AS now, {_WORTH.format(b='o_then', h='h_then')} AS before)""")
ORACLE["net_worth_breakdown"] = sql("SELECT * FROM brk")
ORACLE["breakdown_with_names"] = sql("SELECT brk.*, display_name, account_type FROM brk LEFT JOIN f0 USING (account_id)")
_MONEY = "'£' || format('{{:,.2f}}', {0} / 100.0)"
PARTS["rep"] = """
SELECT account_id, coalesce(display_name, account_id) AS display_name,
  CASE WHEN source = account_id THEN upper(account_type[1]) || account_type[2:] WHEN source = 'Cash account' THEN source
    WHEN lower(coalesce(display_name, account_id)) LIKE '%isa%' THEN 'Stocks & Shares ISA'
    WHEN lower(coalesce(display_name, account_id)) LIKE '%pension%' THEN 'Pension' ELSE 'Holdings' END AS detail,
  CASE WHEN source IN (account_id, 'Cash account') THEN source ELSE '' END AS line,
  CAST(sum(balance_or_value) AS BIGINT) AS balance_or_value, CAST(sum(contribution_to_net_worth) AS BIGINT) AS contribution_to_net_worth,
  max(as_of_date) AS as_of_date
FROM brk LEFT JOIN f0 USING (account_id) GROUP BY 1, 2, 3, 4"""
ORACLE["account_breakdown"] = sql(f"""
SELECT account_id, display_name, detail, balance_or_value, contribution_to_net_worth, as_of_date,
  {_MONEY.format('balance_or_value')} AS balance_text, {_MONEY.format('contribution_to_net_worth')} AS contribution_text FROM rep""")
ORACLE["total_contribution"] = sql("SELECT CAST(sum(contribution_to_net_worth) AS BIGINT) AS total_minor FROM brk")
ORACLE["currency_check"] = sql("""
SELECT currency, count(*) AS record_count, min(account_id) AS sample_account_id FROM (
  SELECT account_id, CASE user_id % 4 WHEN 0 THEN 'EUR' WHEN 1 THEN NULL ELSE 'GBP' END AS currency FROM f4
  UNION ALL SELECT account_id, 'GBP' FROM f6) WHERE currency IS NOT NULL GROUP BY currency""")

ORACLE["statement_periods"] = sql("SELECT * FROM periods")
_GAPS = """
SELECT account_id, reach AS gap_start, period_from AS gap_end, CAST(period_from - reach AS BIGINT) AS days FROM (
  SELECT *, max(period_to) OVER (PARTITION BY account_id ORDER BY period_from, period_to
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {0}) WHERE period_from - reach > 3"""
_WEEKS_END = "ELSE wk * 7 END) AS period_to\nFROM f1"


def _with_gap(text: str) -> str:
    """The same over weekly statements of which every seventh user lost one."""
    assert _WEEKS_END in text
    return text.replace(_WEEKS_END, _WEEKS_END + " WHERE NOT (user_id % 7 = 0 AND wk = 3)")


ORACLE["coverage_gaps"] = _with_gap(sql(_GAPS.format("(SELECT DISTINCT account_id, period_from, period_to FROM periods)")))
ORACLE["coverage_gaps_orders"] = sql(_GAPS.format("f12"))
ORACLE["coverage_calendar"] = sql("SELECT * FROM cal")
_MONTHS = [(y, m, n) for y in range(1995, 2002) for m, n in enumerate("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split(), 1)]
ORACLE["coverage_pivot"] = sql(
    "SELECT account_id, display_name, "
    + ", ".join(f"coalesce(max(CASE WHEN month = DATE '{y}-{m:02d}-01' THEN status END), 'no_data') AS \"{n} {y}\"" for y, m, n in _MONTHS)
    + " FROM cal GROUP BY account_id, display_name"
)
# Months in a row with one status: the month less its number within the status stays the same.
ORACLE["coverage_runs"] = sql("""
SELECT account_id, status, min(month) AS month_from, max(month) AS month_to FROM (
  SELECT *, date_diff('month', DATE '1970-01-01', month) - row_number() OVER (PARTITION BY account_id, status ORDER BY month) AS stretch
  FROM cal WHERE status <> 'no_data') GROUP BY account_id, status, stretch""")
PARTS["walk"] = """
SELECT account_id, min(period_from) + 60 AS reach, 0 AS step FROM f12 GROUP BY account_id
UNION ALL SELECT w.account_id, max(p.period_to), w.step + 1 FROM walk w JOIN f12 p ON p.account_id = w.account_id
WHERE p.period_from <= w.reach + 90 AND p.period_to > w.reach GROUP BY w.account_id, w.step"""
ORACLE["contiguous_end"] = sql("SELECT account_id, max(reach) AS contiguous_to FROM walk GROUP BY account_id")

ORACLE["reconciliation_status"] = sql("SELECT * FROM status")
ORACLE["balance_continuity"] = _with_gap(sql("SELECT * FROM cont"))
ORACLE["contribution_by_ingestion"] = sql("SELECT * FROM contrib")
ORACLE["contribution_by_survivor"] = sql("""
SELECT ingestion_id, CAST(sum(amount_minor) AS BIGINT) AS contribution_minor FROM (
  SELECT DISTINCT s.ingestion_id, t.sid, t.amount_minor FROM m2_sources s JOIN m2_final t ON t.sid = s.silver_transaction_id) GROUP BY ingestion_id""")
ORACLE["silver_rollforward"] = sql("SELECT * FROM roll")
ORACLE["reconciliation_log"] = sql("SELECT * FROM log")
ORACLE["reconciliation_summary"] = sql("SELECT check_type, matches, count(*) AS checks FROM log GROUP BY check_type, matches")

PARTS["d_anchor"] = """
SELECT account_id, as_of_date AS anchor_date, balance_minor AS anchor_minor FROM (
  SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY as_of_date DESC, period_to DESC, line_number DESC) AS rn
  FROM f4 WHERE as_of_date <= DATE '2024-01-10' AND reconciled = true AND source_type = 'bank-export') WHERE rn = 1"""
PARTS["d_walk"] = """
SELECT account_id, anchor_date AS reach, 0 AS step FROM d_anchor
UNION ALL SELECT w.account_id, max(p.period_to), w.step + 1 FROM d_walk w JOIN wkly p ON p.account_id = w.account_id
WHERE p.period_from <= w.reach + 3 AND p.period_to > w.reach GROUP BY w.account_id, w.step"""
ORACLE["derived_ledger"] = sql("""
SELECT 'derived_' || sha256(ingestion_id || ':transaction:' || event_id) AS bronze_record_id, t.account_id,
  CAST(anchor_minor + sum(amount_minor) OVER (PARTITION BY t.account_id ORDER BY transaction_date, event_id) AS BIGINT) AS balance_minor,
  transaction_date AS as_of_date, 'derived' AS balance_source, CAST(NULL AS BOOLEAN) AS reconciled
FROM wkly t JOIN d_anchor a ON a.account_id = t.account_id
JOIN (SELECT account_id, max(reach) AS reach FROM d_walk GROUP BY account_id) r ON r.account_id = t.account_id
WHERE source_type = 'bank-export' AND transaction_date > anchor_date AND transaction_date <= reach""")

# --- raw rows -------------------------------------------------------------------

_SOURCE = """CASE event_id % 11 WHEN 0 THEN 'monzo' WHEN 1 THEN 'monzo' WHEN 2 THEN 'kroo' WHEN 3 THEN 'natwest-transactions'
  WHEN 4 THEN 'natwest-statement' WHEN 5 THEN 'firstdirect' WHEN 6 THEN 'amex' WHEN 7 THEN 'vanguard-pdf' WHEN 8 THEN 'monzo-pdf'
  WHEN 9 THEN 'chase' ELSE 'monzo-flex' END"""
ORACLE["normalize_transactions"] = sql(f"""
SELECT 'r' || event_id AS bronze_record_id, {_SOURCE} AS source_type,
  transaction_date || CASE event_id % 11 WHEN 0 THEN ' 08:15:30' WHEN 1 THEN ' 10:00:00' ELSE ' 00:00:00' END AS transaction_date,
  description, CASE WHEN event_id % 13 = 0 THEN 0 ELSE amount_minor END AS amount_minor,
  CASE WHEN event_id % 11 = 0 THEN 'EUR' ELSE 'GBP' END AS currency,
  CASE event_id % 11 WHEN 0 THEN 'food' WHEN 1 THEN 'c' END AS category,
  CASE event_id % 11 WHEN 0 THEN 'tx' || event_id WHEN 1 THEN 's' || event_id END AS bank_transaction_id FROM f1""")
ORACLE["normalize_ledger"] = sql(f"""
SELECT 'r' || event_id AS bronze_record_id, {_SOURCE} AS source_type, event_id AS balance_minor, transaction_date AS as_of_date,
  CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN true ELSE false END AS reconciled, 'printed' AS balance_source
FROM f1 WHERE event_id % 11 NOT IN (0, 1, 3, 7)""")
ORACLE["normalize_holdings"] = f"""
SELECT l_orderkey || '-' || l_linenumber AS bronze_record_id, 'acc_' || l_suppkey AS account_id, 'Fund ' || l_partkey AS fund_name,
  CASE WHEN l_returnflag = 'A' THEN '-' ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END AS quantity,
  CAST(0 AS BIGINT) AS unit_price_minor, {_cents('l_extendedprice')} AS total_value_minor,
  CASE WHEN l_returnflag <> 'R' THEN CAST(l_shipdate AS DATE) ELSE DATE '2024-02-01' END AS as_of_date
FROM lineitem WHERE l_linenumber % 2 = 1"""
ORACLE["normalize_instalments"] = f"""
SELECT l_orderkey || '-' || l_linenumber AS bronze_record_id, 'acc_' || l_suppkey AS account_id, 'Plan ' || l_partkey AS description,
  CAST(l_shipdate AS DATE) AS start_date, CAST(l_shipdate AS DATE) AS as_of_date, '1 OF 3' AS instalment_progress,
  {_cents('l_extendedprice')} AS plan_total_minor, CAST(0 AS BIGINT) AS plan_lifetime_fee_minor, CAST(77 AS BIGINT) AS remaining_balance_minor,
  CAST(CASE WHEN l_returnflag = 'A' THEN 0 ELSE 1234 END AS BIGINT) AS due_this_month_plan_minor,
  CAST(0 AS BIGINT) AS due_this_month_fee_minor, CAST(0 AS BIGINT) AS due_this_month_total_minor
FROM lineitem WHERE l_linenumber % 2 = 0"""
ORACLE["instalment_adjustments"] = """
SELECT 'f' || l_suppkey AS ingestion_id, CAST(1234 * count(*) AS BIGINT) AS adjustment_minor
FROM lineitem WHERE l_linenumber % 2 = 0 AND l_returnflag <> 'A' GROUP BY l_suppkey"""
ORACLE["running_liability_balance"] = sql("""
SELECT event_id, CAST(10000 - sum(amount_minor) OVER (PARTITION BY account_id ORDER BY transaction_date, event_id) AS BIGINT) AS balance_minor FROM f1""")
ORACLE["amount_from_balance_delta"] = sql("""
SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY account_id ORDER BY transaction_date, event_id) > 1 THEN amount_minor END AS amount_minor FROM f1""")
ORACLE["forward_fill_dates"] = sql("""
SELECT event_id, (SELECT arg_max(x.transaction_date, x.event_id) FROM f1 x
  WHERE x.account_id = f1.account_id AND x.event_id <= f1.event_id AND x.event_id % 3 = 0) AS filled FROM f1""")

# --- statements: what each text was printed from ---------------------------------

PARTS["ev"] = """
SELECT *, user_id || '-' || (event_id // 500) AS ingestion_id, abs(amount_minor) AS size, transaction_date AS d,
  row_number() OVER w AS seq, CAST(sum(abs(amount_minor)) OVER w AS BIGINT) AS run
FROM f1 WINDOW w AS (PARTITION BY user_id, event_id // 500 ORDER BY event_id)"""
PARTS["st"] = """
SELECT ingestion_id, CAST(sum(size) AS BIGINT) AS total, CAST(sum(amount_minor) AS BIGINT) AS net, count(*) AS n,
  min(run) AS first_run, any_value(CASE WHEN user_id % 7 = 0 THEN 1 ELSE 0 END) AS wrong FROM ev GROUP BY ingestion_id"""


def _masked(raw: str) -> str:
    return f"substr(sha256(upper({raw})), 1, 12)"


def _printed(
    date: str, description: str = "description", amount: str = "amount_minor", balance: str = "run", identifier: str = "NULL",
    check: str = "NULL", opening: str = "NULL", closing: str = "NULL", derived: str = "NULL",
    start: str = "DATE '2024-01-01'", end: str = "DATE '2024-01-31'",
) -> str:
    return f"""
SELECT ingestion_id, CAST(seq AS INTEGER) AS line_number, 'transaction' AS record_type, {identifier} AS account_identifier,
  {date} AS date, {description} AS description, CAST({amount} AS BIGINT) AS amount_minor, CAST({balance} AS BIGINT) AS balance_minor,
  {start} AS statement_period_from, {end} AS statement_period_to, {check} AS reconciliation_check,
  CAST({opening} AS BIGINT) AS opening_minor, CAST({closing} AS BIGINT) AS closing_minor, CAST({derived} AS BIGINT) AS derived_minor,
  CAST({closing} AS BIGINT) = CAST({derived} AS BIGINT) AS matches
FROM ev JOIN st USING (ingestion_id)"""


_DAY_MONTH = "strftime(d, '%-d %b')"
ORACLE["parse_kroo"] = sql(_printed(
    "strftime(d, '%d %B %Y')", "CASE WHEN amount_minor < 0 THEN 'Payment to ' ELSE 'From ' END || description",
    # An amount of nothing is printed without a sign.
    identifier=_masked("'11-22-33_' || user_id"), check="'kroo_closing_balance'", opening="1000", closing="total + wrong", derived="total"))
ORACLE["parse_natwest_transactions"] = sql(_printed(
    f"{_DAY_MONTH} || ' 2024'", balance="NULL", identifier=_masked("'*****' || user_id || '_11-22-33'")))
ORACLE["parse_natwest_statement"] = sql(_printed(
    f"upper({_DAY_MONTH}) || ' 2024'", amount="size", identifier=_masked("lpad(CAST(user_id AS VARCHAR), 8, '0') || '_11-22-33'"),
    check="'natwest_statement_new_balance'", opening="0", closing="total + wrong", derived="total"))
_ROLLED = "sum(amount_minor) OVER (PARTITION BY ingestion_id ORDER BY seq)"
ORACLE["parse_firstdirect"] = sql(_printed(
    "strftime(d, '%d %b %y')", balance=f"-{_ROLLED}", identifier=_masked("'400011112222' || lpad(CAST(user_id AS VARCHAR), 4, '0')"),
    check="'first_direct_new_balance'", opening="0", closing="abs(net)", derived="-net",
    start="DATE '2024-01-05'", end="DATE '2024-02-05'"))
ORACLE["parse_amex"] = sql(_printed(
    f"{_DAY_MONTH} || ' 2024'", balance=f"10000 - {_ROLLED}", identifier=_masked("'xxxx-xxxxxx-' || lpad(CAST(user_id AS VARCHAR), 5, '0')"),
    check="'amex_closing_balance'", opening="10000", closing="abs(net)", derived="10000 - net"))
_VG = dict(identifier=_masked("'VG' || user_id || '_ISA'"), check="'vanguard_account_summary_isa'", closing="total + wrong", derived="total", balance="NULL")
ORACLE["parse_vanguard_pdf"] = sql(
    _printed("NULL", amount="NULL", **_VG).replace("'transaction' AS record_type", "'holding' AS record_type")
    + " UNION ALL " + _printed("strftime(d, '%d/%m/%Y')", **_VG).replace("CAST(seq AS INTEGER)", "CAST(n + seq AS INTEGER)"))
ORACLE["parse_monzo_pdf"] = sql(_printed(
    "strftime(d, '%d/%m/%Y')", identifier=_masked("'11-22-33_' || user_id"),
    check="'monzo_pdf_personal_account_balance'", closing="total", derived="first_run"))
ORACLE["parse_chase"] = sql(_printed(
    "strftime(d, '%d %b %Y')", identifier=_masked("user_id || '_44-55-66'"),
    check="'chase_closing_balance'", opening="0", closing="abs(net)", derived="net"))
ORACLE["parse_monzo_flex"] = sql(_printed(
    "strftime(d, '%d/%m/%Y')", check="'monzo_flex_balance_at_end'", opening="500", closing="total", derived="first_run"))

ORACLE["statement_detection"] = sql("""
SELECT layout AS printed_as, layout, 'matched' AS detection, count(*) AS texts FROM st, (VALUES ('kroo'), ('natwest-transactions'),
  ('natwest-statement'), ('firstdirect'), ('amex'), ('vanguard-pdf'), ('monzo-pdf'), ('chase'), ('monzo-flex')) v(layout) GROUP BY layout
UNION ALL SELECT 'page', NULL, 'unrecognised', count(*) FROM pages""")
PARTS["verdict"] = """
SELECT user_id || '-W' || wk AS ingestion_id, user_id, 'closing_balance' AS name, opening_minor, closing_minor, derived_minor FROM f5"""
ORACLE["file_verdicts"] = sql("""
SELECT event_id, w.ingestion_id, name AS reconciliation_check, opening_minor AS reconciliation_expected_opening_minor,
  closing_minor AS reconciliation_expected_closing_minor, derived_minor AS reconciliation_derived_closing_minor,
  closing_minor = derived_minor AS reconciliation_matches
FROM wkly w LEFT JOIN verdict v ON v.ingestion_id = w.ingestion_id AND v.user_id % 4 <> 0""")
ORACLE["account_verdicts"] = sql("""
SELECT event_id, CASE event_id % 3 WHEN 1 THEN 'sub1' WHEN 2 THEN 'sub2' END AS account_identifier, name AS reconciliation_check,
  opening_minor AS reconciliation_expected_opening_minor, closing_minor + event_id % 3 AS reconciliation_expected_closing_minor,
  derived_minor AS reconciliation_derived_closing_minor, closing_minor + event_id % 3 = derived_minor AS reconciliation_matches
FROM wkly w LEFT JOIN verdict v ON v.ingestion_id = w.ingestion_id AND event_id % 3 < 2""")
ORACLE["gold_table"] = sql("""
SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS spend_minor,
  count(*) AS payments FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_totalprice > 0 GROUP BY 1""")
PARTS["labelled"] = """
SELECT h.account_id, c_name || CASE c_custkey % 3 WHEN 0 THEN ' ISA' WHEN 1 THEN ' Personal Pension' ELSE ' General' END AS display_name,
  c_custkey % 3 AS kind, fund_name, total_value_minor, as_of_date FROM hold h LEFT JOIN customer ON 'acc_' || c_custkey = h.account_id"""
ORACLE["wrapper_labels"] = sql("""
SELECT account_id, coalesce(display_name, account_id) AS display_name, detail, CAST(sum(total_value_minor) AS BIGINT) AS value_minor,
  CASE WHEN detail = 'Cash account' THEN count(*) ELSE 1 END AS lines, max(as_of_date) AS as_of_date
FROM (SELECT *, CASE WHEN length(fund_name) % 4 = 0 THEN 'Cash account' WHEN kind = 0 THEN 'Stocks & Shares ISA'
  WHEN kind = 1 THEN 'Pension' ELSE 'Holdings' END AS detail FROM labelled) GROUP BY account_id, display_name, detail""")
ORACLE["layout_detection"] = """
WITH texts AS (SELECT 'p' || page_id AS id, html AS text FROM pages UNION ALL SELECT 'd' || doc_id, text FROM documents),
found AS (
  SELECT id, unnest([
    {'layout': 'page', 'c': CASE WHEN contains(text, '<html') AND contains(text, '</html>') THEN 99 ELSE 0 END},
    {'layout': 'french', 'c': CASE WHEN contains(text, ' les ') AND contains(text, ' que ') THEN 95 ELSE 0 END},
    {'layout': 'german', 'c': CASE WHEN contains(text, ' der ') AND contains(text, ' und ') THEN 95 ELSE 0 END},
    {'layout': 'english', 'c': CASE WHEN contains(text, ' the ') OR contains(text, ' and ') THEN 93 ELSE 0 END},
    {'layout': 'spanish', 'c': CASE WHEN contains(text, ' los ') OR contains(text, ' una ') THEN 85 ELSE 0 END}]) AS r
  FROM texts WHERE length(text) >= 50),
ranked AS (
  SELECT id, r.layout AS layout, r.c AS c, row_number() OVER (PARTITION BY id ORDER BY r.c DESC, r.layout) AS rn FROM found WHERE r.c > 0),
tops AS (SELECT id, max(CASE WHEN rn = 1 THEN layout END) AS layout, max(CASE WHEN rn = 1 THEN c END) AS c1,
  max(CASE WHEN rn = 2 THEN c END) AS c2 FROM ranked GROUP BY id)
SELECT texts.id, CASE WHEN c1 - c2 < 5 THEN NULL ELSE layout END AS layout,
  CASE WHEN c1 IS NULL THEN 'unrecognised' WHEN c1 - c2 < 5 THEN 'ambiguous' ELSE 'matched' END AS detection
FROM texts LEFT JOIN tops ON texts.id = tops.id"""
ORACLE["text_segmentation"] = """
WITH cut AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
lines AS (SELECT doc_id, pos, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS line FROM cut),
marked AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^[A-E]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS block
  FROM lines WHERE line <> '')
SELECT doc_id, CAST(block - 1 AS BIGINT) AS block_no, count(*) AS n_lines, sha256(string_agg(line, chr(10) ORDER BY pos)) AS digest
FROM marked WHERE block > 0 GROUP BY doc_id, block"""

ORACLE["ingestion_list"] = sql("""
SELECT ingestion_id, source_type, status, record_count,
  CASE WHEN NOT matches AND allowed THEN 'overridden' WHEN NOT matches THEN 'mismatch' ELSE 'ok' END AS mark FROM f8""")
ORACLE["build_listing"] = """
SELECT strftime(m, '%Y%m') AS build_id, CAST(m AS DATE) AS built_at, count(*) AS transactions, m = max(m) OVER () AS is_current
FROM (SELECT date_trunc('month', o_orderdate) AS m FROM orders) GROUP BY m"""
ORACLE["manifest_summary"] = sql("""
SELECT ingestion_id, 'complete' AS status, 'kroo' AS source_type, n AS record_count, wrong = 0 AS reconciliation_matches FROM st""")


# --- through a lake -------------------------------------------------------------

_IDENTIFIER = "substring(sha256('CUST' || {0}), 1, 12)"
ORACLE["sql_surface"] = sql("""
SELECT source_type, count(*) AS records, CAST(sum(amount_minor) AS BIGINT) AS total_minor, count(DISTINCT ingestion_id) AS files
FROM wkly GROUP BY source_type""")
ORACLE["bronze_read"] = sql(f"""
SELECT sha256(ingestion_id || ':transaction:' || event_id) AS bronze_record_id, ingestion_id,
  {_IDENTIFIER.format('user_id')} AS account_identifier, CAST(event_id AS INTEGER) AS line_number
FROM wkly WHERE source_type = 'card-statement'""")
PARTS["kept_files"] = """
SELECT ingestion_id, any_value(source_type) AS source_type, count(*) AS record_count, any_value(user_id) AS user_id, any_value(wk) AS wk
FROM wkly GROUP BY ingestion_id"""
ORACLE["manifest_rows"] = sql("""
SELECT ingestion_id, source_type, 'complete' AS status, record_count,
  CASE WHEN source_type <> 'bank-export' THEN (user_id + wk) % 11 <> 0 END AS reconciliation_matches FROM kept_files""")
ORACLE["overridden_ingestions"] = sql("SELECT ingestion_id, 'allow' AS decision FROM kept_files WHERE starts_with(ingestion_id, '1')")
ORACLE["found_ingestions"] = sql("SELECT ingestion_id, record_count FROM kept_files WHERE starts_with(ingestion_id, '2')")
ORACLE["published_build"] = sql("""
SELECT sha256(ingestion_id || ':transaction:' || event_id) AS bronze_record_id, account_id, amount_minor,
  (SELECT count(*) FROM wkly) AS stated FROM wkly""")
ORACLE["build_facts_row"] = sql("""
SELECT (SELECT count(DISTINCT ingestion_id) FROM wkly) AS input_ingestion_ids, (SELECT count(*) FROM excl) AS excluded,
  (SELECT count(DISTINCT source_type) FROM wkly) AS parsers""")
ORACLE["registry_upsert"] = f"""
SELECT 'identifier' AS kind, {_IDENTIFIER.format('c_custkey')} AS key,
  CASE WHEN c_custkey % 3 = 0 OR c_custkey % 10 = 9 THEN 'new_' ELSE 'acc_' END || c_custkey AS account_id,
  CASE WHEN c_custkey % 3 = 0 OR c_custkey % 10 = 9 THEN 'savings' WHEN c_mktsegment = 'AUTOMOBILE' THEN 'credit'
    WHEN c_mktsegment = 'BUILDING' THEN 'investment' WHEN c_mktsegment = 'FURNITURE' THEN 'savings' ELSE 'current' END AS account_type
FROM customer UNION ALL SELECT 'source_type', 'bank-export', 'acc_export', 'current'"""
ORACLE["csv_exports"] = f"""
SELECT 'monzo_txn_tx' || event_id AS bronze_source_key, abs({_cents('value')}) AS amount_minor, 'A "quoted", name' AS name FROM events"""
ORACLE["stream_ingest"] = """
SELECT 'chase' AS source_type, 'complete' AS status, count(*) AS files, CAST(sum(n) AS BIGINT) AS records, CAST(sum(n) AS BIGINT) AS stored
FROM (SELECT user_id, event_id // 500 AS part, count(*) AS n FROM events GROUP BY ALL)"""
ORACLE["mismatch_listing"] = sql("SELECT * FROM log WHERE matches = false")
ORACLE["rollforward_signs"] = sql("""
SELECT account_id, kind AS source_type, ingestion_id, filename, expected_opening_minor, expected_closing_minor, derived AS silver_derived_closing_minor,
  coalesce(derived = expected_closing_minor, false) AS matches
FROM (SELECT s.*, CASE WHEN s.source_type = 'card-statement' THEN 'amex' ELSE 'chase' END AS kind,
    CAST(expected_opening_minor + CASE WHEN s.source_type = 'card-statement' THEN -moved ELSE moved END
      + CASE WHEN wk % 2 = 0 THEN wk * 100 ELSE 0 END AS BIGINT) AS derived
  FROM status s JOIN (SELECT ingestion_id, any_value(wk) AS wk, sum(amount_minor) AS moved FROM wkly GROUP BY ingestion_id) USING (ingestion_id)
  WHERE expected_opening_minor IS NOT NULL)""")
ORACLE["balances_newest_first"] = sql("""
SELECT account_id, balance_minor, greatest(as_of_date, period_to) AS as_of_date FROM (
  SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY as_of_date DESC, period_to DESC,
    CASE WHEN user_id % 2 = 0 THEN -line_number ELSE line_number END DESC, bronze_record_id DESC) AS rn
  FROM f4 WHERE reconciled IS DISTINCT FROM false) WHERE rn = 1""")
