"""Test inputs derived from the driver tables.

One SQL text per input. It runs unchanged in Spark SQL and in the SQL engine the results are
checked with, so both sides start from the same rows. Edge cases (short, empty and malformed
values, unread and unanswered messages, planted identifiers) are part of the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.registry import ENTITY_ORDER, MESSAGE_SCHEMA, entity

# Driver tables each input reads.
INPUTS = {
    "bank_customers": ("customer",),
    "bank_addresses": ("customer", "nation"),
    "bank_accounts": ("orders",),
    "bank_cards": ("orders",),
    "bank_transactions": ("lineitem",),
    "bus_messages": ("events",),
    "trace_lines": ("events",),
    "recording_events": ("conversations",),
    "request_bodies": ("events",),
    "dirty_accounts": ("orders",),
    "dirty_cards": ("orders",),
}

SQL = {
    "bank_customers": r"""
SELECT CAST(c_custkey + 1 AS BIGINT) AS id,
       'First' || CAST(c_custkey % 50 AS STRING) AS first_name,
       CASE WHEN c_custkey % 107 = 0 THEN '' ELSE 'Last' || CAST(c_custkey % 300 AS STRING) END AS last_name,
       CASE WHEN c_custkey % 103 = 0 THEN 'nodomain' WHEN c_custkey % 109 = 0 THEN 'a@b@c'
            ELSE 'user' || CAST(c_custkey AS STRING) || '@mail' || CAST(c_custkey % 7 AS STRING) || '.example.com' END AS email,
       CASE WHEN c_custkey % 101 = 0 THEN '12' WHEN c_custkey % 113 = 0 THEN '1234' WHEN c_custkey % 127 = 0 THEN 'none'
            ELSE '(555) ' || lpad(CAST((c_custkey * 7) % 1000 AS STRING), 3, '0') || '-' || lpad(CAST((c_custkey * 31) % 10000 AS STRING), 4, '0') END AS phone,
       CASE WHEN c_custkey % 131 = 0 THEN '12' WHEN c_custkey % 137 = 0 THEN ''
            ELSE lpad(CAST((c_custkey * 13) % 1000 AS STRING), 3, '0') || '-' || lpad(CAST((c_custkey * 17) % 100 AS STRING), 2, '0') || '-' || lpad(CAST((c_custkey * 7919) % 10000 AS STRING), 4, '0') END AS ssn,
       DATE '1940-01-01' + CAST((c_custkey * 37) % 22000 AS INT) AS date_of_birth,
       TIMESTAMP '2024-01-01 00:00:00' AS created_at
FROM customer
""",
    "bank_addresses": r"""
SELECT CAST(c_custkey * 2 + k + 1 AS BIGINT) AS id, CAST(c_custkey + 1 AS BIGINT) AS customer_id,
       CAST(c_custkey AS STRING) || ' Main St' AS line1,
       CASE (c_custkey + k) % 4 WHEN 0 THEN 'Apt ' || CAST(c_custkey % 40 AS STRING) WHEN 1 THEN '' ELSE NULL END AS line2,
       n_name AS city, substr(n_name, 1, 2) AS state,
       lpad(CAST((c_custkey * 97) % 100000 AS STRING), 5, '0') AS postal_code, 'US' AS country
FROM customer JOIN nation ON c_nationkey = n_nationkey CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k) x
WHERE k <= c_custkey % 2
""",
    "bank_accounts": r"""
SELECT CAST(o_orderkey + 1 AS BIGINT) AS id, CAST(o_custkey + 1 AS BIGINT) AS customer_id,
       CASE WHEN o_orderkey % 211 = 0 THEN '12' ELSE lpad(CAST((o_orderkey * 7919) % 1000000000 AS STRING), 9, '0') END AS account_number,
       lpad(CAST((o_orderkey * 104729) % 1000000000 AS STRING), 9, '0') AS routing_number,
       CASE o_orderkey % 3 WHEN 0 THEN 'checking' WHEN 1 THEN 'savings' ELSE 'credit' END AS account_type,
       CAST(o_totalprice AS DECIMAL(14,2)) AS balance, 'USD' AS currency,
       CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'P' THEN 'frozen' ELSE 'closed' END AS status,
       o_orderdate AS opened_at
FROM orders
""",
    "bank_cards": r"""
SELECT CAST(o_orderkey * 2 + k + 1 AS BIGINT) AS id, CAST(o_orderkey + 1 AS BIGINT) AS account_id,
       CASE WHEN o_orderkey % 223 = 0 THEN '1234567'
            ELSE CASE o_orderkey % 3 WHEN 0 THEN '4' WHEN 1 THEN '5' ELSE '3' END || lpad(CAST((o_orderkey * 15485863 + k) % 1000000000000 AS STRING), 15, '0') END AS card_number,
       CASE WHEN o_orderkey % 227 = 0 THEN '' WHEN o_orderkey % 229 = 0 THEN ' LEAD SPACE' ELSE 'FIRST' || CAST(o_custkey % 50 AS STRING) || '  LAST' || CAST(o_custkey % 300 AS STRING) END AS cardholder_name,
       CASE o_orderkey % 3 WHEN 0 THEN 'visa' WHEN 1 THEN 'mastercard' ELSE 'amex' END AS brand,
       CAST(o_orderkey % 12 + 1 AS SMALLINT) AS expiry_month, CAST(2026 + o_orderkey % 6 AS SMALLINT) AS expiry_year,
       lpad(CAST(o_orderkey % 1000 AS STRING), 3, '0') AS cvv,
       CASE WHEN o_orderkey % 3 = 2 THEN 'frozen' ELSE 'active' END AS status
FROM orders CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k) x
WHERE k < o_orderkey % 3
""",
    "bank_transactions": r"""
SELECT CAST((l_orderkey + 1) * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS BIGINT) AS id,
       CAST(l_orderkey + 1 AS BIGINT) AS account_id, l_shipdate AS occurred_at,
       CAST(l_extendedprice AS DECIMAL(12,2)) AS amount,
       CASE WHEN l_returnflag = 'R' THEN 'credit' ELSE 'debit' END AS direction,
       'Merchant' || CAST(l_partkey % 12 AS STRING) AS merchant,
       CASE l_partkey % 4 WHEN 0 THEN 'shopping' WHEN 1 THEN 'dining' WHEN 2 THEN 'fuel' ELSE 'travel' END AS category,
       'Merchant' || CAST(l_partkey % 12 AS STRING) || ' purchase' AS description
FROM lineitem
""",
    "bus_messages": r"""
SELECT id, sender, recipient, body, created_at, consumed_at FROM (
  SELECT CAST(event_id * 2 + 1 AS BIGINT) AS id, 'test' AS sender, 'prod' AS recipient,
         '{"entity":"' || CASE event_type WHEN 'view' THEN 'customers' WHEN 'click' THEN 'addresses' WHEN 'signup' THEN 'accounts' WHEN 'purchase' THEN 'cards' ELSE 'nope' END
           || '","limit":' || CAST(event_id % 600 AS STRING) || ',"since_id":' || CAST(event_id AS STRING) || '}' AS body,
         ts AS created_at, CASE WHEN event_id % 89 = 0 THEN NULL ELSE ts + INTERVAL '2' SECOND END AS consumed_at
  FROM events
  UNION ALL
  SELECT CAST(event_id * 2 + 2 AS BIGINT), 'prod', 'test',
         CASE WHEN event_type = 'error' THEN '{"ok":false,"error":"unknown entity","echo":{"since_id":' || CAST(event_id AS STRING) || ',"limit":' || CAST(event_id % 600 AS STRING) || ',"entity":"nope"}}'
              ELSE '{"ok":true,"entity":"x","rows":[{"id":"' || CAST(event_id AS STRING) || '","ssn":"' || CASE WHEN event_id % 97 = 0 THEN '123-45-6789' ELSE '***-**-6789' END || '"}],"echo":{"since_id":' || CAST(event_id AS STRING) || ',"limit":' || CAST(event_id % 600 AS STRING)
                   || ',"entity":"' || CASE event_type WHEN 'view' THEN 'customers' WHEN 'click' THEN 'addresses' WHEN 'signup' THEN 'accounts' ELSE 'cards' END || '"}}' END,
         ts + INTERVAL '5' SECOND, CASE WHEN event_id % 83 = 0 THEN NULL ELSE ts + INTERVAL '6' SECOND END
  FROM events WHERE event_id % 89 <> 0
) m
""",
    # Two interleaved event streams as JSON lines, with blank, broken and irrelevant lines, tool
    # results of every kind, model changes and errors.
    "trace_lines": r"""
SELECT CAST(event_id AS BIGINT) AS seq,
       CASE WHEN user_id % 3 = 0 THEN 'test' ELSE 'prod' END AS agent,
       ts AS seen_at,
       CASE WHEN event_id % 41 = 0 THEN ''
            WHEN event_id % 43 = 0 THEN '{"type":"agent_start"'
            WHEN event_id % 53 = 0 THEN '{"type":"heartbeat"}'
            WHEN event_id % 59 = 0 THEN '{"type":"error","error":"bus unreachable ' || CAST(event_id % 7 AS STRING) || '"}'
            WHEN event_type = 'signup' THEN '{"type":"agent_start"}'
            WHEN event_type = 'error' THEN '{"type":"agent_end"}'
            WHEN event_type = 'view' THEN '{"type":"tool_execution_start","toolName":"query_masked","args":{"entity":"cards","limit":' || CAST(event_id % 600 AS STRING) || '}}'
            WHEN event_type = 'click' THEN '{"type":"tool_execution_end","toolName":"query_masked","isError":' || CASE WHEN event_id % 10 = 0 THEN 'true' ELSE 'false' END || ',"result":'
                 || CASE event_id % 6
                      WHEN 0 THEN '{"details":{"count":' || CAST(event_id % 500 AS STRING) || '}}'
                      WHEN 1 THEN '{"details":{"id":' || CAST(event_id AS STRING) || ',"from":"prod","to":"test"}}'
                      WHEN 2 THEN '{"details":{"id":' || CAST(event_id AS STRING) || ',"from":"test","body":{"entity":"cards","limit":' || CAST(event_id % 600 AS STRING) || '}}}'
                      WHEN 3 THEN '{"details":{"empty":true}}'
                      WHEN 4 THEN '{"content":[{"type":"image"},{"type":"text","text":"plain ' || CAST(event_id AS STRING) || '"}]}'
                      ELSE '{"content":[{"type":"text","text":"' || repeat('x', 290) || CAST(event_id AS STRING) || repeat('y', CAST(event_id % 20 AS INT)) || '"}]}' END
                 || '}'
            ELSE '{"type":"message_end","message":{"role":"' || CASE WHEN event_id % 4 = 0 THEN 'user' ELSE 'assistant' END || '","provider":"local","model":"m' || CAST(user_id % 3 AS STRING)
                 || '","content":[{"type":"thinking","thinking":"step ' || CAST(event_id AS STRING) || '"},{"type":"text","text":"' || CASE WHEN event_id % 5 = 0 THEN '  ' ELSE 'say ' || CAST(event_id AS STRING) END
                 || '"},{"type":"reasoning","text":"why ' || CAST(event_id % 9 AS STRING) || '"}]}}' END AS line
FROM events
""",
    # Requests of every kind, sound and unsound.
    "request_bodies": r"""
SELECT CAST(event_id AS BIGINT) AS id, 'test' AS sender, 'prod' AS recipient,
       CASE event_id % 13
         WHEN 0 THEN '{"entity":"nope"}'
         WHEN 1 THEN '{"entity":"cards","limit":0,"since_id":' || CAST(event_id AS STRING) || '}'
         WHEN 2 THEN '{"entity":"customers","limit":600,"customer_id":' || CAST(event_id % 1500 AS STRING) || '}'
         WHEN 3 THEN '{"entity":"cards","limit":-1}'
         WHEN 4 THEN '{"entity":"cards","limit":1.5}'
         WHEN 5 THEN '{"entity":"accounts","limit":"","customer_id":' || CAST(user_id AS STRING) || '}'
         WHEN 6 THEN '{"entity":"cards","customer_id":5}'
         WHEN 7 THEN '{"entity":"customers","since_id":null,"limit":25}'
         WHEN 8 THEN '{"entity":"addresses","colour":"red","limit":7,"customer_id":' || CAST(event_id % 1500 AS STRING) || '}'
         WHEN 9 THEN '{"entity":"cards"'
         WHEN 10 THEN '[1,2]'
         WHEN 11 THEN '{"entity":"transactions","account_id":"' || CAST(event_id AS STRING) || '","limit":20}'
         ELSE '{"entity":"accounts","customer_id":' || CAST(event_id % 1500 AS STRING) || ',"since_id":' || CAST(event_id AS STRING) || ',"limit":' || CAST(event_id % 600 AS STRING) || '}' END AS body,
       ts AS created_at, CAST(NULL AS TIMESTAMP) AS consumed_at
FROM events
""",
    # Accounts as text with every kind of fault, repeats included.
    "dirty_accounts": r"""
SELECT CAST(k * 2 + again AS BIGINT) AS arrival,
       CASE WHEN k % 17 = 0 THEN 'x' || CAST(k AS STRING) WHEN k % 61 = 0 THEN '99999999999999999999' ELSE CAST(k AS STRING) END AS id,
       CASE WHEN k % 19 = 0 THEN CAST(o_custkey + 1000000000 AS STRING) WHEN k % 47 = 0 THEN NULL ELSE CAST(o_custkey + 1 AS STRING) END AS customer_id,
       '****1234' AS account_number, '****5678' AS routing_number,
       CASE WHEN k % 23 = 0 THEN 'loan' ELSE 'savings' END AS account_type,
       CASE WHEN k % 29 = 0 THEN '1234567890123.00' WHEN k % 67 = 0 THEN '12,5' ELSE CAST(k AS STRING) || '.25' END AS balance,
       CASE WHEN k % 31 = 0 THEN 'USDX' ELSE 'USD' END AS currency,
       CASE WHEN k % 37 = 0 THEN NULL ELSE 'active' END AS status,
       CASE WHEN k % 71 = 0 THEN 'soon' ELSE '2024-05-06 07:08:09' END AS opened_at
FROM (SELECT o_orderkey + 1 AS k, o_custkey, 0 AS again FROM orders
      UNION ALL SELECT o_orderkey + 1 AS k, o_custkey, 1 AS again FROM orders WHERE o_orderkey % 41 = 0) x
""",
    "dirty_cards": r"""
SELECT CAST(o_orderkey + 1 AS BIGINT) AS arrival, CAST(o_orderkey + 1 AS STRING) AS id, CAST(o_orderkey + 1 AS STRING) AS account_id,
       '4000 **** **** 1234' AS card_number, CASE WHEN o_orderkey % 43 = 0 THEN NULL ELSE 'A ***' END AS cardholder_name,
       CASE WHEN o_orderkey % 53 = 0 THEN 'diners' ELSE 'visa' END AS brand,
       CASE WHEN o_orderkey % 59 = 0 THEN '70000' WHEN o_orderkey % 61 = 0 THEN '1.5' ELSE CAST(o_orderkey % 14 AS STRING) END AS expiry_month,
       '2027' AS expiry_year, '***' AS cvv, 'frozen' AS status
FROM orders
""",
    # One recording per conversation; the first event carries the run's parameters and verdict.
    "recording_events": r"""
SELECT 'rec-' || lpad(CAST(conv_id AS STRING), 9, '0') AS rec_id,
       CAST(turn * 1500 + conv_id % 1000 AS BIGINT) AS t_ms,
       CASE role WHEN 'system' THEN 'state' WHEN 'user' THEN 'message' ELSE 'trace' END AS event,
       text AS data
FROM conversations
""",
}


def driver_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run_sql(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    """Run SQL over frames under the names it uses, leaving no view behind."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    try:
        return spark.sql(sql)
    finally:
        for name in tables:
            spark.catalog.dropTempView(name)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast to declared types once, at the boundary (the tables carry time-zone-free stamps)."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input by name; entities and messages come out in their declared schema."""
    tables = {t: driver_table(spark, sf_dir, t) for t in INPUTS[name]}
    df = run_sql(spark, SQL[name], **tables)
    if name in ("bus_messages", "request_bodies"):
        return conform(df, MESSAGE_SCHEMA)
    if name.startswith("bank_"):
        return conform(df, entity(name.removeprefix("bank_")).schema)
    if name == "trace_lines":
        return df.withColumn("seen_at", F.col("seen_at").cast("timestamp"))
    return df


def bank(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return fixture(spark, sf_dir, f"bank_{name}")


def bank_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {name: bank(spark, sf_dir, name) for name in ENTITY_ORDER}
