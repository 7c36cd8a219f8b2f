"""The SQL each query is checked with, written independently of the Spark code.

Every text starts from the same inputs (``fixtures.SQL``) as common table expressions and runs on
the driver tables alone.
"""

from __future__ import annotations

import re

from veilframe.operators import generate as G
from veilframe.registry import ENTITY_ORDER, entity
from veilframe.sources.fixtures import SQL

ORACLES: dict[str, str] = {}

DIGITS = "regexp_replace(coalesce({c}, ''), '[^0-9]', '', 'g')"


def digits(c: str) -> str:
    return DIGITS.format(c=c)


def last_four(c: str) -> str:
    d = digits(c)
    return f"CASE WHEN length({d}) <= 4 THEN repeat('*', length({d})) ELSE right({d}, 4) END"


SPACE = r"[ \t\n\x0B\f\r\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
RULES = {
    "customers": {
        "last_name": "CASE WHEN coalesce(last_name, '') = '' THEN '***' ELSE left(last_name, 1) || '***' END",
        "email": "CASE WHEN split_part(email, '@', 1) <> '' AND split_part(email, '@', 2) <> '' "
                 "THEN left(email, 1) || '***@' || split_part(email, '@', 2) ELSE '***@***' END",
        "phone": f"'***-***-' || {last_four('phone')}",
        "ssn": f"'***-**-' || CASE WHEN {digits('ssn')} = '' THEN '****' ELSE right({digits('ssn')}, 4) END",
        "date_of_birth": "make_date(year(date_of_birth), 1, 1)",
    },
    "addresses": {
        "line1": "'**** [redacted]'",
        "line2": "CASE WHEN line2 <> '' THEN '***' END",
        "postal_code": "left(coalesce(postal_code, ''), 2) || '***'",
    },
    "accounts": {
        "account_number": f"'****' || {last_four('account_number')}",
        "routing_number": f"'****' || {last_four('routing_number')}",
    },
    "cards": {
        "card_number": f"CASE WHEN length({digits('card_number')}) >= 8 THEN left({digits('card_number')}, 4) || ' **** **** ' "
                       f"|| right({digits('card_number')}, 4) ELSE '**** **** **** ****' END",
        "cardholder_name": "CASE WHEN coalesce(cardholder_name, '') = '' THEN '*** ***' "
                           f"ELSE string_split_regex(cardholder_name, '{SPACE}+')[1] || ' ***' END",
        "cvv": "'***'",
    },
    "transactions": {},
}


def masked_select(name: str, source: str | None = None) -> str:
    rules = RULES[name]
    cols = [f"{rules[c]} AS {c}" if c in rules else c for c in entity(name).columns]
    return f"SELECT {', '.join(cols)} FROM {source or 'bank_' + name}"


CTES = dict(SQL)
for _n in ENTITY_ORDER:
    CTES[f"masked_{_n}"] = masked_select(_n)
    CTES[f"early_{_n}"] = f"SELECT * FROM bank_{_n} WHERE id <= (SELECT max(id) // 2 FROM bank_{_n})"
    CTES[f"early_masked_{_n}"] = f"SELECT * FROM masked_{_n} WHERE id <= (SELECT max(id) // 2 FROM masked_{_n})"


def with_inputs(sql: str) -> str:
    """Prefix the inputs a text mentions, and theirs."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(CTES[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in needed) + (",\n" + sql[5:] if sql.startswith("WITH ") else "\n" + sql)


def oracle(name: str, sql: str) -> None:
    ORACLES[name] = with_inputs(sql)


def js(column: str, path: str) -> str:
    """A JSON field as text, NULL for malformed JSON."""
    return f"CASE WHEN json_valid({column}) THEN json_extract_string({column}, '{path}') END"


# ---------------------------------------------------------------- scans, sources, sinks
for _n in ENTITY_ORDER:
    oracle(f"S1_read_entity_{_n}", f"SELECT * FROM bank_{_n}")
    oracle(f"P6_mask_{_n}", f"SELECT * FROM masked_{_n}")
oracle("S2_query_local", "SELECT * FROM masked_cards ORDER BY id LIMIT 200")
oracle("S3_read_messages", "SELECT * FROM bus_messages")
_BODY = ", ".join(f"TRY_CAST({js('body', '$.' + k)} AS BIGINT) AS {k}" for k in ("since_id", "customer_id", "account_id"))
_NROWS = "coalesce(CASE WHEN json_valid(body) AND json_type(body, '$.rows') = 'ARRAY' THEN json_array_length(body, '$.rows') END, 0)::BIGINT"
_ECHO = """'{"entity":"' || json_extract_string(body, '$.echo.entity') || '","limit":' || json_extract_string(body, '$.echo.limit') || ',"since_id":' || json_extract_string(body, '$.echo.since_id') || '}'"""
oracle(
    "S4_parse_body",
    f"""SELECT id, {js('body', '$.entity')} AS entity, TRY_CAST({js('body', '$.limit')} AS BIGINT) AS "limit", {_BODY},
    CAST({js('body', '$.ok')} AS BOOLEAN) AS ok, {js('body', '$.error')} AS error, {_ECHO} AS echo, {_NROWS} AS n_rows FROM bus_messages""",
)
oracle(
    "S4_parse_unsound_body",
    f"SELECT id, {js('body', '$.entity')} AS entity, {_BODY}, CAST(NULL AS BOOLEAN) AS ok, CAST(0 AS BIGINT) AS n_rows FROM request_bodies",
)
oracle(
    "S5_send_message",
    """SELECT (SELECT max(id) FROM bus_messages) + row_number() OVER (ORDER BY id) AS id, 'test' AS sender, 'prod' AS recipient,
    '{"entity":"accounts","limit":500,"customer_id":' || id || '}' AS body, TIMESTAMP '2024-03-01 00:00:00' AS created_at,
    CAST(NULL AS TIMESTAMP) AS consumed_at FROM bank_customers""",
)
oracle("S6_append_masked", "SELECT * FROM masked_accounts")
oracle(
    "S7_upsert_masked",
    "SELECT * FROM masked_customers UNION ALL SELECT id + (SELECT max(id) FROM bank_customers) AS id, * EXCLUDE (id) FROM bank_customers",
)

_TRACE = f"""(SELECT seq, agent, seen_at, line, {js('line', '$.type')} AS type, {js('line', '$.toolName')} AS tool_name,
  coalesce(CAST({js('line', '$.isError')} AS BOOLEAN), false) AS is_error, {js('line', '$.error')} AS error,
  {js('line', '$.message.role')} AS role,
  {js('line', '$.message.provider')} || '/' || {js('line', '$.message.model')} AS model FROM trace_lines WHERE line <> '' AND json_valid(line))"""
CTES["trace_events"] = _TRACE[1:-1]
oracle(
    "S8_read_trace",
    """SELECT seq, agent, seen_at, type, tool_name, is_error, error, role, model,
    CASE WHEN type = 'tool_execution_start' THEN '{"entity":"cards","limit":' || json_extract_string(line, '$.args.limit') || '}' END AS args
    FROM trace_events""",
)
oracle("S9_recordings", "SELECT rec_id, t_ms, event, data FROM recording_events")
CTES["facts"] = """SELECT 'rec-' || lpad(CAST(conv_id AS VARCHAR), 9, '0') AS rec_id, '2024-01-' || lpad(CAST(conv_id % 28 + 1 AS VARCHAR), 2, '0') AS started_at,
  '{"seed":' || count(*) || '}' AS params, 'emulated' AS model, CASE WHEN conv_id % 7 = 0 THEN 'fail' ELSE 'pass' END AS verdict,
  count(*) || ' turns' AS summary FROM conversations GROUP BY conv_id"""
CTES["headers"] = """SELECT f.rec_id, f.started_at, e.duration_ms, f.params, f.model, f.verdict, f.summary, e.event_count FROM facts f
  JOIN (SELECT rec_id, max(t_ms) AS duration_ms, count(*) AS event_count FROM recording_events GROUP BY rec_id) e USING (rec_id)"""
for _k in ("S9_recording_headers_file", "A11_recording_header", "L5_list_recordings"):
    oracle(_k, "SELECT * FROM headers")


# ---------------------------------------------------------------- generated data
def draw(key: str, salt: int, n: int | str, seed: int = 42) -> str:
    """The generator's number rule, spelled in SQL."""
    return f"(CAST('0x' || left(md5('{seed}:' || CAST({key} AS VARCHAR) || ':{salt}'), 15) AS BIGINT) % ({n}))"


def pick(values, key: str, salt: int) -> str:
    return f"([{', '.join(repr(v) for v in values)}])[{draw(key, salt, len(values))} + 1]"


def padded(key: str, salt: int, width: int) -> str:
    return f"lpad(CAST({draw(key, salt, 10 ** width)} AS VARCHAR), {width}, '0')"


_NOW = "TIMESTAMP '2026-01-01 00:00:00'"
_DAY, _MONTH, _SIX = 86400, 30 * 86400, 6 * 365 * 86400
_FIRST, _LAST = pick(G.FIRST_NAMES, "cid", 1), pick(G.LAST_NAMES, "cid", 2)
_STATUS, _BRAND, _MERCHANT, _CITY = draw("k", 35, 5), draw("k", 41, 3), draw("k", 52, 12), draw("k", 24, 10)


def children(n: str, most: int, parent: str, parent_key: str, keep: str) -> str:
    return (
        f"SELECT {keep}, {parent_key} * {most} + place AS k FROM {parent}, (SELECT unnest(range({most})) AS place) p WHERE place < {n}"
    )


CTES["gen_people"] = "SELECT CAST(c_custkey + 1 AS BIGINT) AS cid FROM customer"
CTES["gen_customers"] = f"""SELECT cid AS id, {_FIRST} AS first_name, {_LAST} AS last_name,
  lower({_FIRST} || '.' || {_LAST} || '@' || {pick(G.MAIL_DOMAINS, 'cid', 3)}) AS email,
  {padded('cid', 4, 3)} || '-' || {padded('cid', 5, 3)} || '-' || {padded('cid', 6, 4)} AS phone,
  {padded('cid', 7, 3)} || '-' || {padded('cid', 8, 2)} || '-' || {padded('cid', 9, 4)} AS ssn,
  DATE '2026-01-01' - CAST({draw('cid', 10, 67 * 365)} + {18 * 365 + 5} AS INT) AS date_of_birth,
  {_NOW} - to_seconds({draw('cid', 11, _SIX)}) AS created_at FROM gen_people"""
CTES["gen_addresses"] = f"""SELECT row_number() OVER (ORDER BY k) AS id, cid AS customer_id,
  CAST({draw('k', 21, 9999)} + 1 AS VARCHAR) || ' ' || {pick(G.STREETS, 'k', 22)} AS line1,
  CASE WHEN {draw('k', 23, 3)} = 2 THEN 'Apt ' || CAST({draw('k', 26, 40)} + 1 AS VARCHAR) END AS line2,
  ([{', '.join(repr(c) for c, _ in G.CITIES)}])[{_CITY} + 1] AS city, ([{', '.join(repr(s) for _, s in G.CITIES)}])[{_CITY} + 1] AS state,
  {padded('k', 25, 5)} AS postal_code, 'US' AS country FROM ({children(draw('cid', 20, 2) + ' + 1', 2, 'gen_people', 'cid', 'cid')}) a"""
CTES["gen_held"] = f"""SELECT row_number() OVER (ORDER BY k) AS id, cid, k, {_MONTH} + {draw('k', 36, _SIX - _MONTH)} AS age
  FROM ({children(draw('cid', 30, 3) + ' + 1', 3, 'gen_people', 'cid', 'cid')}) a"""
CTES["gen_accounts"] = f"""SELECT id, cid AS customer_id, {padded('k', 31, 9)} AS account_number, {padded('k', 32, 9)} AS routing_number,
  {pick(('checking', 'savings', 'credit'), 'k', 33)} AS account_type,
  CAST(CAST({draw('k', 34, 12200001)} - 200000 AS DECIMAL(18,2)) * 0.01 AS DECIMAL(14,2)) AS balance, 'USD' AS currency,
  CASE WHEN {_STATUS} < 3 THEN 'active' WHEN {_STATUS} = 3 THEN 'frozen' ELSE 'closed' END AS status, {_NOW} - to_seconds(age) AS opened_at FROM gen_held"""
_N15 = f"left((['4', '5', '37'])[{_BRAND} + 1] || {padded('k', 42, 7)} || {padded('k', 43, 7)}, 15)"


def luhn(number: str) -> str:
    """Check digit of fifteen digits, from their list."""
    d = f"CAST(substr({number}, CAST(i AS INT), 1) AS INT)"
    part = f"CASE WHEN i % 2 = 0 THEN {d} WHEN {d} * 2 > 9 THEN {d} * 2 - 9 ELSE {d} * 2 END"
    return f"(10 - list_sum([{part} FOR i IN range(1, 16)]) % 10) % 10"


CTES["gen_cards"] = f"""SELECT row_number() OVER (ORDER BY k) AS id, account_id, n15 || CAST(CAST({luhn('n15')} AS BIGINT) AS VARCHAR) AS card_number,
  upper({_FIRST} || ' ' || {_LAST}) AS cardholder_name, (['visa', 'mastercard', 'amex'])[{_BRAND} + 1] AS brand,
  CAST({draw('k', 44, 12)} + 1 AS SMALLINT) AS expiry_month, CAST({draw('k', 45, 6)} + 2026 AS SMALLINT) AS expiry_year,
  {padded('k', 46, 3)} AS cvv, CASE WHEN {draw('k', 47, 3)} < 2 THEN 'active' ELSE 'frozen' END AS status
  FROM (SELECT *, {_N15} AS n15 FROM (SELECT account_id, cid, ak * 2 + place AS k FROM (SELECT id AS account_id, cid, k AS ak FROM gen_held) h,
    (SELECT unnest(range(2)) AS place) p WHERE place < {draw('ak', 40, 3)}) c) d"""
CTES["gen_transactions"] = f"""SELECT row_number() OVER (ORDER BY k) AS id, account_id, {_NOW} - to_seconds({draw('k', 51, 'age + 1')}) AS occurred_at,
  CAST(CAST({draw('k', 53, 119851)} + 150 AS DECIMAL(18,2)) * 0.01 AS DECIMAL(12,2)) AS amount,
  CASE WHEN {draw('k', 54, 4)} < 3 THEN 'debit' ELSE 'credit' END AS direction,
  ([{', '.join(repr(m) for m in G.MERCHANTS)}])[{_MERCHANT} + 1] AS merchant, ([{', '.join(repr(c) for c in G.MERCHANTS.values())}])[{_MERCHANT} + 1] AS category,
  ([{', '.join(repr(m) for m in G.MERCHANTS)}])[{_MERCHANT} + 1] || ' purchase' AS description
  FROM (SELECT account_id, age, ak * 20 + place AS k FROM (SELECT id AS account_id, age, k AS ak FROM gen_held) h,
    (SELECT unnest(range(20)) AS place) p WHERE place < {draw('ak', 50, 16)} + 5) t"""
for _n in ENTITY_ORDER:
    oracle(f"G1_generate_{_n}", f"SELECT * FROM gen_{_n}")
_ORDER_VALUES = list(ENTITY_ORDER)
oracle(
    "S10_reset_dataset",
    " UNION ALL ".join(
        f"SELECT '{n}' AS entity, count(*) AS raw_rows, CAST(0 AS BIGINT) AS masked_rows, count(*) = 0 AS equal, CAST(0 AS BIGINT) AS log_rows FROM gen_{n}" for n in ENTITY_ORDER
    ),
)
oracle(
    "G2_allocate_ids",
    "SELECT (SELECT max(id) FROM bank_transactions) + row_number() OVER (ORDER BY id) AS id, account_id, id AS place FROM bank_cards",
)

# ---------------------------------------------------------------- projections and filters
oracle("P1_scope_filter", "SELECT * FROM bank_accounts WHERE customer_id = 7")
oracle("P2_since_filter", "SELECT * FROM bank_addresses WHERE id > 100")
oracle(
    "P3_clamp_limit",
    'SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 10 WHEN event_id % 900 - 50 < 1 THEN 1 WHEN event_id % 900 - 50 > 500 THEN 500 ELSE event_id % 900 - 50 END::BIGINT AS "limit" FROM events',
)
_WHOLE = r"\s*[+]?[0-9]{1,18}([.]0*)?\s*"
_PARTS = {}
for _k in ("limit", "customer_id", "account_id", "since_id"):
    _raw = js("body", f"$.{_k}")
    _PARTS[_k] = (
        f"CASE WHEN regexp_full_match({_raw}, '{_WHOLE}') THEN TRY_CAST({_raw} AS BIGINT) END",
        f"({_raw}) <> '' AND NOT regexp_full_match({_raw}, '{_WHOLE}')",
    )
_NAMES = ", ".join(f"'{n}'" for n in ENTITY_ORDER)
CTES["cleaned"] = f"""SELECT id, sender, body, CASE WHEN {js('body', '$.entity')} IN ({_NAMES}) THEN {js('body', '$.entity')} END AS entity,
  CASE WHEN {_PARTS['limit'][0]} < 1 THEN 1 WHEN {_PARTS['limit'][0]} > 500 THEN 500 ELSE {_PARTS['limit'][0]} END AS lim,
  {_PARTS['customer_id'][0]} AS customer_id, {_PARTS['account_id'][0]} AS account_id, {_PARTS['since_id'][0]} AS since_id,
  CASE WHEN coalesce({js('body', '$.entity')}, '') NOT IN ({_NAMES}) THEN 'entity must be one of customers, addresses, accounts, cards, transactions'
  {' '.join(f"WHEN {_PARTS[k][1]} THEN '{k} must be a non-negative integer'" for k in _PARTS)} END AS error FROM request_bodies"""
_REQUEST = """CASE WHEN error IS NULL THEN '{"entity":"' || entity || '"' || coalesce(',"limit":' || lim, '') || coalesce(',"customer_id":' || customer_id, '')
  || coalesce(',"account_id":' || account_id, '') || coalesce(',"since_id":' || since_id, '') || '}' END"""
oracle("P4_clean_request", f'SELECT id, entity, lim AS "limit", customer_id, account_id, since_id, error, {_REQUEST} AS request FROM cleaned')
oracle(
    "F12_scope_text",
    """SELECT id, concat_ws(' ', 'limit=' || lim, 'customer_id=' || customer_id, 'account_id=' || account_id, 'since_id=' || since_id) AS scope
    FROM cleaned WHERE error IS NULL""",
)
oracle("P5_query_masked_customers", "SELECT * FROM masked_customers WHERE id > 20 ORDER BY id LIMIT 500")
oracle("P5_query_masked_addresses", "SELECT * FROM masked_addresses WHERE customer_id = 4 ORDER BY id LIMIT 500")
oracle("P5_query_masked_accounts", "SELECT * FROM masked_accounts WHERE customer_id = 8 AND id > 10 ORDER BY id LIMIT 500")
oracle("P5_query_masked_cards", "SELECT * FROM masked_cards WHERE id > 500 ORDER BY id LIMIT 500")
oracle("P5_query_masked_transactions", "SELECT * FROM masked_transactions WHERE account_id = 33 ORDER BY id LIMIT 10")
oracle(
    "P7_pending",
    "SELECT recipient, count(*) AS pending FROM bus_messages WHERE consumed_at IS NULL GROUP BY recipient",
)
_KEPT = "type IN ('agent_start','tool_execution_start','tool_execution_end','message_end','agent_end','error') AND (type <> 'message_end' OR role = 'assistant')"
oracle("P8_trace_filter", f"SELECT seq, agent, type FROM trace_events WHERE {_KEPT}")
oracle(
    "P9_scrub_log_lines",
    r"""SELECT doc_id, count(*) AS lines, sum(length(line))::BIGINT AS chars FROM (
      SELECT doc_id, CASE WHEN n = 1 THEN CASE WHEN doc_id % 5 = 0 THEN 'Sample customer ' WHEN doc_id % 7 = 0 THEN 'ssn=' ELSE '' END || line ELSE line END AS line
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents) s) t
    WHERE regexp_replace(line, '\s+', '', 'g') <> '' AND line NOT LIKE '%Sample customer%' AND line NOT LIKE '%ssn=%' GROUP BY doc_id""",
)
oracle(
    "P10_masked_only_views",
    """SELECT a.status, count(*) AS n, count(DISTINCT c.ssn) AS ssns, max(a.account_number) AS top_account
    FROM masked_customers c JOIN masked_accounts a ON a.customer_id = c.id GROUP BY a.status""",
)

# ---------------------------------------------------------------- masks one by one
oracle("M1_digits", f"SELECT id, {digits('phone')} AS masked FROM bank_customers")
oracle(
    "M2_tail",
    "SELECT id, CASE WHEN length({d}) <= 4 THEN repeat('*', length({d})) ELSE repeat('*', length({d}) - 4) || right({d}, 4) END AS masked FROM bank_accounts".replace("{d}", digits("account_number")),
)
for _key, _t, _c in (
    ("M3_mask_surname", "customers", "last_name"), ("M4_mask_email", "customers", "email"),
    ("M5_mask_phone", "customers", "phone"), ("M6_mask_ssn", "customers", "ssn"), ("M7_year_only", "customers", "date_of_birth"),
    ("M8_redact_line", "addresses", "line1"), ("M9_presence_mask", "addresses", "line2"), ("M10_mask_postal", "addresses", "postal_code"),
    ("M11_mask_account_no", "accounts", "account_number"), ("M12_mask_card", "cards", "card_number"),
    ("M13_mask_holder", "cards", "cardholder_name"), ("M14_constant_mask", "cards", "cvv"),
):
    oracle(_key, f"SELECT id, {RULES[_t][_c]} AS masked FROM bank_{_t}")
oracle("M15_pass_through", "SELECT id, description AS masked FROM bank_transactions")
oracle("U1_register_sql_masks", "SELECT id, last_name, email, phone, ssn, date_of_birth FROM masked_customers")

# ---------------------------------------------------------------- joins
for _key, _p in (("J1_customer_account_card", "bank"), ("J1_customer_account_card_masked", "masked")):
    oracle(
        _key,
        f"""SELECT c.id, c.last_name, c.ssn, c.email, a.account_number, k.card_number, a.id AS account_id, k.id AS card_id
        FROM {_p}_customers c JOIN {_p}_accounts a ON a.customer_id = c.id LEFT JOIN {_p}_cards k ON k.account_id = a.id
        ORDER BY c.id, a.id, k.id NULLS FIRST LIMIT 10""",
    )
CTES["slice_customers"] = "SELECT * FROM masked_customers ORDER BY id LIMIT 50"
for _n, _p, _fk in (("addresses", "customers", "customer_id"), ("accounts", "customers", "customer_id"), ("cards", "accounts", "account_id"), ("transactions", "accounts", "account_id")):
    CTES[f"slice_{_n}"] = (
        f"SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY {_fk} ORDER BY id) AS rn FROM masked_{_n} WHERE {_fk} IN (SELECT id FROM slice_{_p})) t WHERE rn <= 500"
    )
for _n in ENTITY_ORDER:
    oracle(f"J2_slice_{_n}", f"SELECT * FROM slice_{_n}")
oracle("J3_missing_ids", "SELECT id FROM bank_transactions WHERE account_id % 10 = 0")
oracle(
    "J4_insert_if_absent",
    """SELECT * REPLACE (CASE WHEN customer_id % 2 = 0 THEN 'closed' ELSE status END AS status) FROM masked_accounts
    WHERE id NOT IN (SELECT id FROM early_accounts)""",
)
oracle(
    "J5_fk_violations",
    "SELECT id, account_id, 'parent row missing (FK)' AS reason FROM bank_transactions WHERE account_id NOT IN (SELECT id FROM early_accounts)",
)
_NN = "'null value in column \"{c}\" of relation \"{r}\" violates not-null constraint'"
CTES["account_report"] = f"""SELECT *, CASE
  WHEN id LIKE 'x%' THEN 'invalid input syntax for type bigint: "' || id || '"'
  WHEN length(id) > 19 THEN 'value "' || id || '" is out of range for type bigint'
  WHEN account_type = 'loan' THEN 'invalid input value for enum account_type: "loan"'
  WHEN balance = '12,5' THEN 'invalid input syntax for type numeric: "12,5"'
  WHEN TRY_CAST(balance AS DECIMAL(14,2)) IS NULL THEN 'numeric field overflow'
  WHEN length(currency) > 3 THEN 'value too long for type character(3)'
  WHEN opened_at = 'soon' THEN 'invalid input syntax for type timestamp with time zone: "soon"'
  WHEN customer_id IS NULL THEN {_NN.format(c='customer_id', r='accounts')}
  WHEN status IS NULL THEN {_NN.format(c='status', r='accounts')} END AS reason FROM dirty_accounts"""
oracle("J6_constraint_report_accounts", "SELECT arrival, reason FROM account_report")
oracle(
    "J6_constraint_report_cards",
    f"""SELECT arrival, CASE WHEN expiry_month NOT IN ('70000', '1.5') THEN CAST(expiry_month AS SMALLINT) END AS expiry_month, CASE
    WHEN brand = 'diners' THEN 'invalid input value for enum card_brand: "diners"'
    WHEN expiry_month = '70000' THEN 'value "70000" is out of range for type smallint'
    WHEN expiry_month = '1.5' THEN 'invalid input syntax for type smallint: "1.5"'
    WHEN cardholder_name IS NULL THEN {_NN.format(c='cardholder_name', r='cards')}
    WHEN CAST(expiry_month AS INT) NOT BETWEEN 1 AND 12 THEN 'new row for relation "cards" violates check constraint "cards_expiry_month_check"' END AS reason
    FROM dirty_cards""",
)
CTES["account_load"] = """SELECT arrival, CASE WHEN reason IS NOT NULL THEN 'skipped'
    WHEN TRY_CAST(id AS BIGINT) IN (SELECT id FROM early_accounts) THEN 'conflict'
    WHEN arrival > min(CASE WHEN reason IS NULL AND TRY_CAST(customer_id AS BIGINT) IN (SELECT id FROM bank_customers) THEN arrival END) OVER (PARTITION BY id) THEN 'conflict'
    WHEN TRY_CAST(customer_id AS BIGINT) NOT IN (SELECT id FROM bank_customers) THEN 'skipped' ELSE 'inserted' END AS outcome,
  reason AS static_reason FROM account_report"""
CTES["account_outcome"] = """SELECT arrival, outcome, CASE WHEN outcome = 'skipped' THEN coalesce(static_reason, 'parent row missing (FK)') END AS reason FROM account_load"""
oracle("J6_classified_load", "SELECT * FROM account_outcome")
oracle(
    "A8_load_summary",
    """SELECT 'accounts' AS entity, count(*) AS received, count(*) FILTER (outcome = 'inserted') AS inserted, count(*) FILTER (outcome = 'conflict') AS conflicts,
    count(*) FILTER (outcome = 'skipped') AS skipped, max(reason) AS reason FROM account_outcome""",
)
oracle(
    "J7_cascade_delete",
    """SELECT 'customers' AS entity, count(*) AS n FROM bank_customers WHERE email <> 'nodomain'
    UNION ALL SELECT 'addresses', count(*) FROM bank_addresses WHERE customer_id IN (SELECT id FROM bank_customers WHERE email <> 'nodomain')
    UNION ALL SELECT 'accounts', count(*) FROM bank_accounts WHERE customer_id IN (SELECT id FROM bank_customers WHERE email <> 'nodomain')
    UNION ALL SELECT 'cards', count(*) FROM bank_cards k JOIN bank_accounts a ON k.account_id = a.id WHERE customer_id IN (SELECT id FROM bank_customers WHERE email <> 'nodomain')
    UNION ALL SELECT 'transactions', count(*) FROM bank_transactions k JOIN bank_accounts a ON k.account_id = a.id WHERE customer_id IN (SELECT id FROM bank_customers WHERE email <> 'nodomain')""",
)
CTES["asked"] = "SELECT *, body AS key, row_number() OVER (PARTITION BY body ORDER BY id) AS k FROM bus_messages WHERE sender = 'test'"
CTES["echoed"] = f"SELECT *, row_number() OVER (PARTITION BY key ORDER BY id) AS k FROM (SELECT *, {_ECHO} AS key FROM bus_messages WHERE sender = 'prod') t"
CTES["bus_events"] = "SELECT id, key, 1 AS step FROM asked UNION ALL SELECT id, key, -1 FROM echoed"
CTES["bus_balance"] = "SELECT *, sum(step) OVER (PARTITION BY key ORDER BY id) AS open FROM bus_events"
CTES["bus_lowest"] = "SELECT *, min(open) OVER (PARTITION BY key ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lowest FROM bus_balance"
CTES["answering"] = """SELECT e.*, row_number() OVER (PARTITION BY e.key ORDER BY e.id) AS nth FROM echoed e JOIN bus_lowest l ON e.id = l.id
    WHERE NOT (l.open < least(coalesce(l.lowest, 0), 0))"""
oracle(
    "J8_pair_requests",
    """SELECT q.id AS request_id, a.id AS reply_id, epoch_us(q.consumed_at - q.created_at) // 1000 AS pick_up_ms, epoch_us(a.created_at - q.created_at) // 1000 AS round_trip_ms
    FROM asked q LEFT JOIN answering a ON a.key = q.key AND a.nth = q.k""",
)
oracle(
    "T4_stream_pairing",
    """SELECT q.id AS request_id, a.id AS reply_id FROM asked q LEFT JOIN answering a ON a.key = q.key AND a.nth = q.k
    AND a.created_at BETWEEN q.created_at AND q.created_at + INTERVAL 180 SECOND""",
)
oracle(
    "J9_bus_changes",
    """SELECT 'message' AS change, id, consumed_at FROM bus_messages WHERE id > (SELECT max(id) FROM bus_messages WHERE id <= (SELECT max(id) // 2 FROM bus_messages))
    UNION ALL SELECT 'consumed', id, consumed_at FROM bus_messages WHERE id <= (SELECT max(id) // 2 FROM bus_messages) AND id % 5 = 0 AND consumed_at IS NOT NULL""",
)


def json_doc(name: str) -> str:
    parts = []
    for f in entity(name).fields:
        if f.sql_type in ("bigint", "smallint", "numeric"):
            value = f"CAST({f.name} AS VARCHAR)"
        elif f.sql_type.startswith("timestamp"):
            value = f"'\"' || strftime({f.name}, '%Y-%m-%dT%H:%M:%S.%gZ') || '\"'"
        else:
            value = f"'\"' || CAST({f.name} AS VARCHAR) || '\"'"
        parts.append(f"'\"{f.name}\":' || coalesce({value}, 'null')")
    return "'{' || " + " || ',' || ".join(parts) + " || '}'"


CTES["docs"] = " UNION ALL ".join(
    f"SELECT '{n}' AS entity, id, {next(iter(entity(n).filters.values()))} AS fk, row_number() OVER (ORDER BY id) AS pos, {json_doc(n)} AS doc FROM masked_{n}" for n in ENTITY_ORDER
)
CTES["bus_asks"] = """SELECT id, body, json_extract_string(body, '$.entity') AS entity, greatest(least(CAST(json_extract_string(body, '$.limit') AS BIGINT), 500), 1) AS lim,
  CAST(json_extract_string(body, '$.since_id') AS BIGINT) AS since FROM bus_messages WHERE recipient = 'prod'"""
CTES["whole_asks"] = "SELECT a.*, coalesce(d.pos, 0) AS start FROM (SELECT * FROM bus_asks WHERE entity <> 'nope') a ASOF LEFT JOIN docs d ON a.entity = d.entity AND a.since >= d.id"
CTES["whole_rows"] = """SELECT a.id AS rid, count(*) AS n_rows, min(d.id) AS first_id, max(d.id) AS last_id, string_agg(d.doc, ',' ORDER BY d.pos) AS docs
  FROM (SELECT id, entity, start + unnest(range(1, lim + 1)) AS pos FROM whole_asks) a JOIN docs d ON d.entity = a.entity AND d.pos = a.pos GROUP BY a.id"""
_ERR = "unknown entity; expected one of customers, addresses, accounts, cards, transactions"
oracle(
    "J10_answer_requests",
    f"""SELECT a.id AS request_id, a.entity <> 'nope' AS ok, CASE WHEN a.entity <> 'nope' THEN a.entity END AS entity, coalesce(r.n_rows, 0) AS n_rows, r.first_id, r.last_id,
    md5(CASE WHEN a.entity = 'nope' THEN '{{"ok":false,"error":"{_ERR}","echo":' || body || '}}'
      ELSE '{{"ok":true,"entity":"' || a.entity || '","rows":[' || coalesce(r.docs, '') || '],"echo":' || body || '}}' END) AS body_md5
    FROM bus_asks a LEFT JOIN whole_rows r ON r.rid = a.id""",
)
# the same requests as text with their keys in order, as an echo shows them
CTES["scoped_asks"] = """SELECT id, entity, error, coalesce(lim, 10) AS lim, coalesce(since_id, -1) AS since,
  CASE WHEN entity IN ('customers', 'addresses', 'accounts') THEN customer_id WHEN entity IN ('cards', 'transactions') THEN account_id END AS scope,
  CASE WHEN NOT json_valid(body) THEN 'null' WHEN id % 13 = 10 THEN '[1,2]' ELSE '{' || concat_ws(',', '"account_id":"' || account_id || '"',
    '"colour":"' || json_extract_string(body, '$.colour') || '"', '"customer_id":' || customer_id, '"entity":"' || json_extract_string(body, '$.entity') || '"',
    CASE WHEN id % 13 = 5 THEN '"limit":""' ELSE '"limit":' || json_extract_string(body, '$.limit') END,
    CASE WHEN id % 13 = 7 THEN '"since_id":null' ELSE '"since_id":' || since_id END) || '}' END AS echo FROM cleaned"""
CTES["scoped_rows"] = """SELECT rid, count(*) AS n_rows, min(id) AS first_id, max(id) AS last_id, string_agg(doc, ',' ORDER BY id) AS docs FROM (
    SELECT a.id AS rid, d.id, d.doc, a.lim, row_number() OVER (PARTITION BY a.id ORDER BY d.id) AS rn FROM (SELECT * FROM scoped_asks WHERE error IS NULL AND scope IS NOT NULL) a
      JOIN docs d ON d.entity = a.entity AND d.fk = a.scope AND d.id > a.since
    UNION ALL
    SELECT a.id, d.id, d.doc, a.lim, d.pos - a.start FROM (SELECT s.*, coalesce(p.pos, 0) AS start FROM (SELECT * FROM scoped_asks WHERE error IS NULL AND scope IS NULL) s
      ASOF LEFT JOIN docs p ON s.entity = p.entity AND s.since >= p.id) a JOIN docs d ON d.entity = a.entity AND d.pos > a.start AND d.pos <= a.start + a.lim) t
  WHERE rn <= lim GROUP BY rid"""
CTES["scoped_replies"] = f"""SELECT a.id AS request_id, a.error IS NULL AS ok, a.entity, coalesce(r.n_rows, 0) AS n_rows, r.first_id, r.last_id,
    md5(CASE WHEN a.error IS NOT NULL THEN '{{"ok":false,"error":"' || CASE WHEN a.entity IS NULL THEN '{_ERR}' ELSE a.error END || '","echo":' || echo || '}}'
      ELSE '{{"ok":true,"entity":"' || a.entity || '","rows":[' || coalesce(r.docs, '') || '],"echo":' || echo || '}}' END) AS body_md5
    FROM scoped_asks a LEFT JOIN scoped_rows r ON r.rid = a.id"""
oracle("J10_answer_scoped_requests", "SELECT * FROM scoped_replies")
oracle("T2_stream_answer", "SELECT request_id, body_md5 FROM scoped_replies")
_BE = "json_extract_string(body, '$.echo.entity')"
oracle(
    "J11_load_replies",
    f"""SELECT {_BE} AS entity, id AS reply_id, CAST(json_extract_string(body, '$.rows[0].id') AS BIGINT) AS id, 'skipped' AS outcome,
    'null value in column "' || CASE {_BE} WHEN 'customers' THEN 'first_name' WHEN 'cards' THEN 'account_id' ELSE 'customer_id' END || '" of relation "' || {_BE}
    || '" violates not-null constraint' AS reason FROM bus_messages WHERE sender = 'prod' AND json_extract_string(body, '$.ok') = 'true'""",
)
oracle(
    "A8_load_summary_per_reply",
    f"""SELECT {_BE} AS entity, id AS reply_id, CAST(1 AS BIGINT) AS received, CAST(0 AS BIGINT) AS inserted, CAST(0 AS BIGINT) AS conflicts, CAST(1 AS BIGINT) AS skipped
    FROM bus_messages WHERE sender = 'prod' AND json_extract_string(body, '$.ok') = 'true'""",
)
oracle(
    "J11_reply_outcomes",
    f"""SELECT {_BE} AS entity, CASE WHEN json_extract_string(body, '$.ok') = 'true' THEN 'rows' ELSE 'error' END AS outcome, count(*) AS replies,
    sum({_NROWS})::BIGINT AS rows_received FROM bus_messages WHERE sender = 'prod' GROUP BY 1, 2""",
)

# ---------------------------------------------------------------- aggregations
oracle("A1_row_counts", "SELECT " + ", ".join(f"(SELECT count(*) FROM bank_{n}) AS {n}" for n in ENTITY_ORDER))
oracle("A2_watermark", " UNION ALL ".join(f"SELECT '{n}' AS entity, coalesce(max(id), 0) AS watermark FROM bank_{n}" for n in ENTITY_ORDER))
_LEAK = "regexp_matches({c}, '[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}') OR regexp_matches({c}, '[0-9]{{16}}')"
_STATS = f"""SELECT count(*) AS messages, count(*) FILTER (sender = 'test') AS requests, count(*) FILTER (sender = 'prod') AS replies,
  count(*) FILTER (consumed_at IS NULL) AS pending, sum(CASE WHEN sender = 'prod' THEN {_NROWS} ELSE 0 END)::BIGINT AS rows_shipped,
  count(*) FILTER ({_LEAK.format(c='body')}) AS leaks FROM bus_messages"""
oracle("A3_bus_stats", _STATS)
oracle("T5_stream_leak_monitor", _STATS)
oracle("A4_leak_count", f"SELECT count(*) FILTER ({_LEAK.format(c='body')}) AS leaks FROM bus_messages")
oracle("F3_has_raw_identifier", f"SELECT id, {_LEAK.format(c='body')} AS leak FROM bus_messages")
oracle("leak_scan_documents", f"SELECT doc_id FROM documents WHERE {_LEAK.format(c='text')}")
oracle("leak_scan_pages", f"SELECT page_id FROM pages WHERE {_LEAK.format(c='html')}")
oracle("leak_scan_conversations", f"SELECT conv_id, turn FROM conversations WHERE {_LEAK.format(c='text')}")
oracle(
    "A5_count_diff",
    " UNION ALL ".join(
        f"SELECT '{n}' AS entity, r AS raw_rows, m AS masked_rows, r = m AS equal, '{n} ' || m || '/' || r AS detail FROM (SELECT (SELECT count(*) FROM bank_{n}) AS r, (SELECT count(*) FROM early_{n}) AS m) t"
        for n in ENTITY_ORDER
    ),
)
_BAD = {
    "customers": r"NOT regexp_matches(ssn, '^\*{3}-\*{2}-[0-9]{4}$') OR NOT regexp_matches(email, '^.\*{3}@') OR NOT regexp_matches(last_name, '^.\*{3}$') OR NOT regexp_matches(phone, '^\*{3}-\*{3}-[0-9]{4}$')",
    "accounts": r"NOT regexp_matches(account_number, '^\*{4}[0-9]{4}$') OR NOT regexp_matches(routing_number, '^\*{4}[0-9]{4}$')",
    "cards": r"NOT regexp_matches(card_number, '^[0-9]{4} \*{4} \*{4} [0-9]{4}$') OR cvv <> '***'",
    "addresses": "line1 <> '**** [redacted]'",
}
for _key, _p in (("A6_mask_audit", "masked"), ("A6_mask_audit_raw", "bank")):
    oracle(
        _key,
        " UNION ALL ".join(f"SELECT '{n}' AS entity, count(*) AS rows_checked, count(*) FILTER ({bad}) AS unmasked FROM {_p}_{n}" for n, bad in _BAD.items()),
    )
_SENSITIVE = [(n, c) for n in RULES for c in RULES[n]]
oracle("A6_mask_audit_full", " UNION ALL ".join(f"SELECT '{n}' AS entity, '{c}' AS column_name, CAST(0 AS BIGINT) AS unmasked" for n, c in _SENSITIVE))
CTES["sizes"] = "SELECT " + ", ".join(f"(SELECT count(*) FROM bank_{n}) AS {n}" for n in ENTITY_ORDER)
CTES["bads"] = "SELECT " + ", ".join(f"(SELECT count(*) FROM masked_{n} WHERE {bad}) AS {n}" for n, bad in _BAD.items())
oracle(
    "A7_verify_transfer",
    f"""WITH s AS ({_STATS})
    SELECT 1 AS check_no, 'every request got a reply' AS name, requests > 0 AND requests = replies AS ok, requests || ' requests / ' || replies || ' replies' AS detail FROM s
    UNION ALL SELECT 2, 'nothing left unread on the bus', pending = 0, pending || ' pending' FROM s
    UNION ALL SELECT 3, 'no raw SSN or card number crossed the wire', leaks = 0, leaks || ' leak(s)' FROM s
    UNION ALL SELECT 4, 'test holds the same row counts as prod', true, {" || ', ' || ".join(f"'{n} ' || {n} || '/' || {n}" for n in ENTITY_ORDER)} FROM sizes
    UNION ALL SELECT 5, 'every sensitive column in test is masked', customers + accounts + cards + addresses = 0,
      concat_ws(', ', {", ".join(f"CASE WHEN {n} > 0 THEN {n} || ' unmasked {n}' END" for n in _BAD)}) FROM bads""",
)
oracle("A7_verdict", "SELECT 'fail' AS verdict, CAST(5 AS BIGINT) AS n_checks")
oracle("A9_seed_summary", " UNION ALL ".join(f"SELECT '{n}' AS entity, count(*) AS new_rows, min(id) AS min_id, max(id) AS max_id FROM bank_{n}" for n in ENTITY_ORDER))
_FAULT = "type = 'error' OR is_error"
oracle(
    "A10_agent_summary",
    f"""SELECT agent, count(*) FILTER (type = 'agent_end' AND agent = 'prod') AS cycles,
    CASE WHEN agent = 'test' THEN (SELECT count(*) FROM bus_messages WHERE recipient = 'test' AND consumed_at IS NOT NULL) ELSE 0 END AS handled,
    count(*) FILTER ({_FAULT}) AS errors, arg_max(model, seq) FILTER (type = 'message_end' AND role = 'assistant') AS model FROM trace_events GROUP BY agent""",
)
oracle(
    "T7_stream_trace",
    f"""SELECT agent, count(*) AS events, count(*) FILTER (type = 'agent_end') AS cycles, count(*) FILTER (type = 'tool_execution_start') AS tools,
    count(*) FILTER ({_FAULT}) AS errors, arg_max(model, seq) FILTER (type = 'message_end') AS model FROM trace_events WHERE {_KEPT} GROUP BY agent""",
)

# ---------------------------------------------------------------- windows and top-k
oracle(
    "W1_top_n_per_parent",
    "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY id) AS rn FROM bank_transactions) t WHERE rn <= 3",
)


def pages(name: str, size: int) -> str:
    return f"""WITH p AS (SELECT id, (row_number() OVER (ORDER BY id) - 1) // {size} AS page FROM bank_{name}),
    g AS (SELECT page, count(*) AS page_rows, min(id) AS first_id, max(id) AS last_id FROM p GROUP BY page),
    a AS (SELECT * FROM g UNION ALL SELECT max(page) + 1, 0, NULL, NULL FROM g HAVING (SELECT count(*) FROM p) % {size} = 0)
    SELECT page, since_id, page_rows, first_id, last_id, coalesce(last_id, since_id) AS next_since_id
    FROM (SELECT *, coalesce(lag(last_id) OVER (ORDER BY page), 0) AS since_id FROM a) t"""


oracle("W2_page_plan", pages("transactions", 30))
oracle("W2_page_plan_customers", pages("customers", 500))
oracle("W3_next_unread", "SELECT * FROM bus_messages WHERE id IN (SELECT min(id) FROM bus_messages WHERE consumed_at IS NULL GROUP BY recipient)")
oracle("W4_kth_occurrence", "SELECT event_id AS id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events")
for _k in ("W5_trace_cycles", "T7_stream_cycles"):
    oracle(
        _k,
        f"""SELECT agent, cycle, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS events, count(*) FILTER (type = 'tool_execution_start') AS tools,
    count(*) FILTER ({_FAULT}) AS errors, bool_or(type = 'agent_end') AS ended
    FROM (SELECT *, count(*) FILTER (type = 'agent_start') OVER (PARTITION BY agent ORDER BY seq ROWS UNBOUNDED PRECEDING) AS cycle FROM trace_events) t GROUP BY agent, cycle""",
    )
for _k in ("W6_model_changes", "T7_stream_model_changes"):
    oracle(
        _k,
        """SELECT agent, seq, model, previous FROM (SELECT *, lag(model) OVER (PARTITION BY agent ORDER BY seq) AS previous FROM trace_events
    WHERE type = 'message_end' AND role = 'assistant' AND model IS NOT NULL) t WHERE model IS DISTINCT FROM previous""",
    )
oracle("L1_first_n_by_id", "SELECT * FROM bank_transactions ORDER BY id LIMIT 30")
oracle("L2_history", "SELECT * FROM (SELECT * FROM bus_messages ORDER BY id DESC LIMIT 500) t")
oracle("L3_keep_last", "SELECT seq, agent, type FROM trace_events ORDER BY seq DESC LIMIT 300")
oracle("L4_retain_recordings", "SELECT rec_id, row_number() OVER (ORDER BY rec_id DESC) <= 30 AS kept FROM facts")

# ---------------------------------------------------------------- scalar functions
oracle(
    "F1_canonical_json",
    """SELECT id, '{"m":' || body || ',"z":[3,{"a":' || id || ',"b":1}]}' AS canonical FROM bus_messages WHERE sender = 'test'""",
)
oracle("F2_json_rows_len", f"SELECT id, {_NROWS} AS n_rows FROM bus_messages")
oracle("F4_redact_url_credentials", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN replace(url, '//', '//…@') ELSE url END AS url FROM pages")
oracle(
    "F5_format_ms",
    """SELECT event_id, CASE WHEN ms >= 60000 THEN (ms // 60000) || 'm ' || ((ms % 60000 + 500) // 1000) || 's'
      WHEN ms % 500 = 250 THEN format('{:.1f}', (ms + 50) / 1000.0) || 's' ELSE format('{:.1f}', ms / 1000.0) || 's' END AS text
    FROM (SELECT event_id, event_id * 37 % 200000 AS ms FROM events) t""",
)
oracle(
    "F6_clip",
    "SELECT doc_id, CASE WHEN length(text) > 600 THEN left(text, 600) || ' …(+' || (length(text) - 600) || ' chars)' ELSE text END AS clipped FROM documents",
)
oracle(
    "F7_summarize_tool_result",
    """SELECT seq, CASE seq % 6 WHEN 0 THEN (seq % 500) || ' row(s) [masked]' WHEN 1 THEN 'message #' || seq || ' → test'
      WHEN 2 THEN 'message #' || seq || ' from test: {"entity":"cards","limit":' || (seq % 600) || '}' WHEN 3 THEN 'no message (idle)' WHEN 4 THEN 'plain ' || seq
      ELSE CASE WHEN 290 + length(CAST(seq AS VARCHAR)) + seq % 20 > 300
        THEN left(repeat('x', 290) || seq || repeat('y', CAST(seq % 20 AS INT)), 300) || ' …(+' || (290 + length(CAST(seq AS VARCHAR)) + seq % 20 - 300) || ' chars)'
        ELSE repeat('x', 290) || seq || repeat('y', CAST(seq % 20 AS INT)) END END AS summary
    FROM trace_events WHERE type = 'tool_execution_end'""",
)
oracle(
    "F8_message_parts",
    """SELECT seq, 'step ' || seq || '|why ' || (seq % 9) AS thinking, CASE WHEN seq % 5 = 0 THEN '' ELSE 'say ' || seq END AS text
    FROM trace_events WHERE type = 'message_end'""",
)
oracle("F9_luhn_check_digit", f"SELECT id, CAST({luhn('card_number')} AS BIGINT) AS digit FROM bank_cards WHERE length(card_number) = 16")
oracle("F10_replay_offset", "SELECT rec_id, t_ms, " + ", ".join(f"t_ms / {s}.0::DOUBLE AS at_{s}x" for s in (1, 2, 5, 10, 20)) + " FROM recording_events")
oracle(
    "F11_run_summary_text",
    """SELECT rec_id, CASE WHEN rec_id LIKE '%5' THEN 'ABORTED by the user after ' || took WHEN verdict = 'pass' THEN 'PASS · ' || event_count || ' checks · ' || took
      ELSE 'FAIL · ' || summary END AS text FROM (SELECT *, CASE WHEN ms >= 60000 THEN (ms // 60000) || 'm ' || ((ms % 60000 + 500) // 1000) || 's'
      WHEN ms % 500 = 250 THEN format('{:.1f}', (ms + 50) / 1000.0) || 's' ELSE format('{:.1f}', ms / 1000.0) || 's' END AS took
      FROM (SELECT *, duration_ms * 20 AS ms FROM headers) h) t""",
)


# ---------------------------------------------------------------- copies and streams
def digest(name: str) -> str:
    cols = ", ".join(f"coalesce(CAST({f.name} AS VARCHAR), '~')" for f in entity(name).fields)
    return f"SELECT '{name}' AS entity, id, md5(concat_ws('|', {cols})) AS digest FROM masked_{name}"


for _key in ("C1_sync_baseline", "C2_sync_delta"):
    oracle(_key, " UNION ALL ".join(digest(n) for n in ENTITY_ORDER))
for _name in ("T1_stream_masked_copy", "T3_stream_load"):
    oracle(_name, " UNION ALL ".join(digest(n) for n in ENTITY_ORDER))
oracle(
    "C2_delta_summary",
    " UNION ALL ".join(
        f"SELECT '{n}' AS entity, (SELECT max(id) FROM early_{n}) AS watermark, count(*) AS added FROM bank_{n} WHERE id > (SELECT max(id) FROM early_{n})" for n in ENTITY_ORDER
    ),
)
oracle(
    "C3_copy_paged",
    " UNION ALL ".join(
        f"SELECT '{n}' AS entity, count(*) AS received, count(*) AS inserted, CAST(0 AS BIGINT) AS conflicts, CAST(0 AS BIGINT) AS skipped, CAST(NULL AS VARCHAR) AS reason FROM bank_{n}" for n in ENTITY_ORDER
    ),
)
oracle("T6_stream_counts", "SELECT b AS batch, " + ", ".join(f"(SELECT count(*) FROM bank_{n}) AS {n}" for n in ENTITY_ORDER) + " FROM (SELECT unnest([0, 1]) AS b) t")

# ---------------------------------------------------------------- a run over the given tables
_TOTALS = {n: f"(SELECT count(*) FROM bank_{n})" for n in ENTITY_ORDER}
oracle(
    "C4_full_run",
    " UNION ALL ".join(f"SELECT 'copy' AS part, '{n}' AS name, {t} AS received, {t} AS inserted, CAST(0 AS BIGINT) AS skipped, CAST(NULL AS BOOLEAN) AS ok FROM (SELECT 1) x" for n, t in _TOTALS.items())
    + f""" UNION ALL SELECT 'check', c, NULL, NULL, NULL, ok FROM (
      SELECT 'every request got a reply' AS c, true AS ok UNION ALL SELECT 'nothing left unread on the bus', true
      UNION ALL SELECT 'no raw SSN or card number crossed the wire', true
      UNION ALL SELECT 'test holds the same row counts as prod', true
      UNION ALL SELECT 'every sensitive column in test is masked', {" AND ".join(f"NOT EXISTS (SELECT 1 FROM masked_{e} WHERE {bad})" for e, bad in _BAD.items())}) v""",
)

# ---------------------------------------------------------------- copies compared by digests, raw values by value
oracle("J3_missing_by_digests", "SELECT id FROM bank_transactions WHERE account_id % 10 = 0")
oracle(
    "A5_differences",
    """SELECT id, 'only left' AS difference FROM masked_cards WHERE id % 97 = 0 UNION ALL SELECT id + (SELECT max(id) FROM masked_cards), 'only right' FROM masked_cards WHERE id % 89 = 1
    UNION ALL SELECT id, 'changed' FROM masked_cards WHERE id % 97 <> 0 AND id % 83 = 0 AND status <> 'closed'""",
)
oracle(
    "A5_reconcile",
    " UNION ALL ".join(
        f"SELECT '{n}' AS entity, count(*) FILTER (id NOT IN (SELECT id FROM early_{n})) AS only_left, CAST(0 AS BIGINT) AS only_right, CAST(0 AS BIGINT) AS changed FROM masked_{n}" for n in ENTITY_ORDER
    ),
)
CTES["value_bodies"] = """SELECT id * 4 AS id, '{"note":"card ' || CASE WHEN id % 3 = 0 THEN left(card_number, 4) || ' ' || substr(card_number, 5, 4) || '-' || substr(card_number, 9, 8) WHEN id % 3 = 1 THEN card_number ELSE '4000 **** **** 1234' END
    || ', since 2024-01-01"}' AS body FROM bank_cards
  UNION ALL SELECT id * 4 + 1, 'ssn ' || CASE WHEN id % 2 = 0 THEN replace(ssn, '-', '') ELSE '***-**-' || right(ssn, 4) END || '.' FROM bank_customers
  UNION ALL SELECT id * 4 + 2, 'from ' || CASE WHEN id % 5 = 0 THEN account_number || ' ' || routing_number ELSE '****' || right(account_number, 4) END || ' to 12' FROM bank_accounts"""
CTES["value_raw"] = " UNION ".join(
    f"SELECT '{t}.{c}' AS column_name, regexp_replace({c}, '[^0-9]', '', 'g') AS digits FROM bank_{t} WHERE length(regexp_replace({c}, '[^0-9]', '', 'g')) >= 9"
    for t, c in (("customers", "ssn"), ("accounts", "account_number"), ("accounts", "routing_number"), ("cards", "card_number"))
)
oracle(
    "A4_leaks_by_value",
    """WITH runs AS (SELECT id, regexp_replace(unnest(regexp_extract_all(body, '[0-9]([ -]?[0-9])*')), '[ -]', '', 'g') AS run FROM value_bodies),
    windows AS (SELECT DISTINCT id, substr(run, CAST(i AS INT), CAST(size AS INT)) AS digits FROM runs, (SELECT DISTINCT length(digits) AS size FROM value_raw) s, unnest(range(1, greatest(length(run) - size + 2, 1))) AS t(i))
    SELECT id, column_name, digits FROM windows JOIN value_raw USING (digits)""",
)

# ---------------------------------------------------------------- Python data sources
oracle("S9_recording_documents", "SELECT rec_id, t_ms, event, data, h.* EXCLUDE (rec_id) FROM recording_events JOIN headers h USING (rec_id)")
_HALF = "(SELECT max(id) // 2 FROM bus_messages)"
oracle(
    "J9_stream_changes",
    f"""SELECT 'message' AS change, id, CASE WHEN id > {_HALF} OR id % 5 <> 0 THEN consumed_at END AS consumed_at FROM bus_messages
    UNION ALL SELECT 'consumed', id, consumed_at FROM bus_messages WHERE id <= {_HALF} AND id % 5 = 0 AND consumed_at IS NOT NULL""",
)
oracle("L3_compacted_log", "SELECT * FROM bus_messages ORDER BY id DESC LIMIT 500")
oracle("L4_retained_documents", "SELECT * FROM headers ORDER BY rec_id DESC LIMIT 30")
oracle(
    "F1_canonical_json_exact",
    """SELECT id, '{"big":12345678901234567000,"id":' || id || ',"m":' || body || ',"z":0,"' || chr(128512) || '":' || id || '.5,"' || chr(65533) || '":1e+21}' AS canonical
    FROM bus_messages WHERE sender = 'test'""",
)

# ---------------------------------------------------------------- replies with new, known and orphaned rows
_FK = "'parent row missing (FK)'"


def _mixed(name: str, parent_key: str | None, parents: str) -> str:
    there = f"id IN (SELECT id FROM early_{name})"
    orphan = f"{parent_key} NOT IN ({parents})" if parent_key else "false"
    lost = " WHERE id % 37 <> 0" if name == "customers" else ""
    return f"""SELECT '{name}' AS entity, id, CASE WHEN {there} THEN 'conflict' WHEN {orphan} THEN 'skipped' ELSE 'inserted' END AS outcome,
      CASE WHEN NOT {there} AND {orphan} THEN {_FK} END AS reason FROM bank_{name}{lost}"""


_PEOPLE = "SELECT id FROM bank_customers WHERE id % 37 <> 0"
_HELD = "SELECT id FROM bank_accounts WHERE id IN (SELECT id FROM early_accounts) OR customer_id % 37 <> 0"
oracle(
    "J11_load_mixed_replies",
    " UNION ALL ".join(
        _mixed(n, k, p) for n, k, p in (
            ("customers", None, ""), ("addresses", "customer_id", _PEOPLE), ("accounts", "customer_id", _PEOPLE), ("cards", "account_id", _HELD), ("transactions", "account_id", _HELD),
        )
    ),
)
