"""Queries over alerts, ledgers, conversations and recorded evaluations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantframe import fixtures
from quantframe.operators import alerts as al
from quantframe.operators import chat as ch
from quantframe.operators import evaluation as ev
from quantframe.operators import tables as tb
from quantframe.plans.oracle_views import TICKER_SQL
from quantframe.plans.registry import query

_REQUESTS = f"""requests AS (
 SELECT c_custkey AS alert_id, 't' || (c_nationkey % 3) AS tenant_id, c_custkey::VARCHAR AS user_id,
  CASE WHEN c_custkey % 29 = 0 THEN '' ELSE {TICKER_SQL.format(n='c_nationkey')} END AS ticker, c_acctbal / 20 AS target_price,
  CASE WHEN c_custkey % 23 = 0 THEN 'equal' WHEN c_custkey % 2 = 0 THEN 'above' ELSE 'below' END AS condition FROM customer)"""
_REASONS = (
    "concat_ws(',', CASE WHEN length(ticker) < 1 OR length(ticker) > 10 THEN 'ticker' END,"
    " CASE WHEN NOT target_price > 0 THEN 'target_price' END, CASE WHEN condition NOT IN ('above', 'below') THEN 'condition' END)"
)


@query("validate_alerts", f"WITH {_REQUESTS} SELECT alert_id, ticker, {_REASONS} AS reasons FROM requests")
def validate_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = al.validate_alerts(fixtures.alert_requests(spark, sf_dir))
    return checked.select("alert_id", "ticker", F.array_join("reasons", ",").alias("reasons"))


@query("create_alerts", f"WITH {_REQUESTS} SELECT alert_id, tenant_id, user_id, ticker, target_price, condition, 'active' AS status FROM requests WHERE {_REASONS} = ''")
def create_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    created = al.create_alerts(fixtures.alert_requests(spark, sf_dir))
    return created.select("alert_id", "tenant_id", "user_id", "ticker", "target_price", "condition", "status")


_ALERTS = f"""alerts AS (
 SELECT c_custkey AS alert_id, 't' || (c_nationkey % 3) AS tenant_id, c_custkey::VARCHAR AS user_id, {TICKER_SQL.format(n='c_nationkey')} AS ticker,
  abs(c_acctbal) / 20 AS target_price, CASE WHEN c_custkey % 2 = 0 THEN 'above' ELSE 'below' END AS condition,
  CASE c_custkey % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'triggered' ELSE 'cancelled' END AS status FROM customer)"""
_ALERT_COLUMNS = ["alert_id", "tenant_id", "user_id", "ticker", "target_price", "condition", "status"]
_ALERT_LIST = ", ".join(_ALERT_COLUMNS)


@query("tenant_filter", f"WITH {_ALERTS} SELECT {_ALERT_LIST} FROM alerts WHERE tenant_id = 't1'")
def tenant_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return al.tenant_filter(fixtures.alerts(spark, sf_dir), "t1").select(*_ALERT_COLUMNS)


@query("active_alerts", f"WITH {_ALERTS} SELECT {_ALERT_LIST} FROM alerts WHERE tenant_id = 't2' AND status = 'active'")
def active_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return al.active_alerts(fixtures.alerts(spark, sf_dir), "t2").select(*_ALERT_COLUMNS)


_MATCH = f"""{_ALERTS},
prices AS (SELECT {TICKER_SQL.format(n='user_id')} AS ticker, arg_max(value, (ts, event_id)) AS price FROM events GROUP BY 1),
met AS (SELECT * FROM alerts JOIN prices USING (ticker) WHERE status = 'active' AND price <> 0
 AND ((condition = 'above' AND price >= target_price) OR (condition = 'below' AND price <= target_price)))"""


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = al.current_prices(fixtures.price_ticks(spark, sf_dir))
    return al.alert_match(fixtures.alerts(spark, sf_dir), prices)


@query("alert_match", f"WITH {_MATCH} SELECT alert_id, ticker, condition, target_price, price, 'triggered' AS status FROM met")
def alert_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir).select("alert_id", "ticker", "condition", "target_price", "price", "status")


@query(
    "alert_message",
    f"WITH {_MATCH} SELECT alert_id, ticker || ' is now ' || price::VARCHAR || ' USD (' || condition || ' ' || target_price::VARCHAR || ')' AS message FROM met",
)
def alert_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir).select("alert_id", "message")


@query("prune_alerts", f"WITH {_ALERTS} SELECT alert_id, status, (SELECT count(*) FROM alerts WHERE status IN ('triggered', 'cancelled')) AS deleted FROM alerts WHERE status NOT IN ('triggered', 'cancelled')")
def prune_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    alerts = fixtures.alerts(spark, sf_dir)
    deleted = al.pruned_count(alerts).scalar()
    return al.prune_alerts(alerts).select("alert_id", "status", deleted.alias("deleted"))


@query(
    "apply_alert_changes",
    """WITH log AS (
 SELECT user_id AS alert_id, event_id AS seq, CASE event_type WHEN 'signup' THEN 'create' WHEN 'click' THEN 'update' WHEN 'purchase' THEN 'trigger' ELSE 'cancel' END AS op,
  value AS price, event_type = 'signup' OR event_id % 7 <> 0 AS owned FROM events WHERE event_type <> 'view'),
c AS (SELECT alert_id, min(seq) AS s0, arg_min(price, seq) AS p0 FROM log WHERE op = 'create' GROUP BY alert_id),
e AS (SELECT l.*, s0 FROM log l JOIN c USING (alert_id) WHERE op <> 'create' AND seq > s0 AND (op = 'trigger' OR owned)),
t AS (SELECT alert_id, min(seq) AS fin, bool_or(op = 'cancel') AS cancelled FROM e WHERE op IN ('cancel', 'trigger') GROUP BY alert_id),
u AS (SELECT e.alert_id, arg_max(price, seq) AS p FROM e LEFT JOIN t USING (alert_id) WHERE op = 'update' AND (fin IS NULL OR seq < fin) GROUP BY e.alert_id)
SELECT alert_id, coalesce(p, p0) AS target_price, CASE WHEN cancelled THEN 'cancelled' WHEN fin IS NOT NULL THEN 'triggered' ELSE 'active' END AS status
FROM c LEFT JOIN t USING (alert_id) LEFT JOIN u USING (alert_id)""",
)
def apply_alert_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    final = al.apply_alert_changes(fixtures.alert_log(spark, sf_dir))
    return final.select("alert_id", "target_price", "status")


@query(
    "insert_if_absent",
    "WITH seen AS (SELECT DISTINCT user_id FROM events), old AS (SELECT c_custkey AS user_id, abs(c_acctbal) AS credits FROM customer)"
    " SELECT user_id, credits FROM old UNION ALL SELECT user_id, 100.0::DOUBLE FROM seen WHERE user_id NOT IN (SELECT user_id FROM old)",
)
def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users seen in events get default credits unless they exist."""
    users = fixtures.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"), F.abs("c_acctbal").alias("credits")
    )
    seen = fixtures.table(spark, sf_dir, "events").select("user_id").distinct()
    return tb.insert_if_absent(users, seen.withColumn("credits", F.lit(ch.START_CREDITS)), ["user_id"])


_MODELS_SQL = "[" + ", ".join(f"'{m}'" for m in fixtures.ANSWER_MODELS) + "]"
_COST_SQL = "CASE model " + " ".join(f"WHEN '{m}' THEN {c}" for m, c in ch.MODEL_COSTS.items()) + " ELSE 1.0 END"


@query(
    "credit_ledger",
    f"""WITH a AS (SELECT 'u' || (conv_id % 3) AS user_id, conv_id, turn, {_MODELS_SQL}[((conv_id + turn) % 7 + 1)::INTEGER] AS model,
 (conv_id * turn) % 5 = 3 AS is_cached FROM conversations WHERE role = 'assistant'),
p AS (SELECT *, CASE WHEN is_cached OR model = 'failed_all' THEN 0.0 ELSE {_COST_SQL} END::DOUBLE AS cost FROM a),
b AS (SELECT *, coalesce(sum(cost) OVER (PARTITION BY user_id ORDER BY conv_id, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= 100 AS blocked FROM p),
c AS (SELECT * REPLACE (CASE WHEN blocked THEN 0.0 ELSE cost END::DOUBLE AS cost) FROM b)
SELECT user_id, conv_id, turn, cost, blocked, 100 - sum(cost) OVER (PARTITION BY user_id ORDER BY conv_id, turn) AS credits_remaining FROM c""",
)
def credit_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = ch.credit_ledger(fixtures.answers(spark, sf_dir))
    return ledger.select("user_id", "conv_id", "turn", "cost", "blocked", "credits_remaining")


@query(
    "message_history",
    "WITH p AS (SELECT conv_id, max(turn) AS pending_turn FROM conversations WHERE role = 'user' GROUP BY conv_id)"
    " SELECT conv_id, pending_turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position, role, text"
    " FROM conversations JOIN p USING (conv_id) WHERE turn < pending_turn",
)
def message_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = ch.message_history(fixtures.table(spark, sf_dir, "conversations"))
    return history.select("conv_id", "pending_turn", "position", "role", "text")


@query(
    "conversation_access",
    "WITH o AS (SELECT DISTINCT conv_id, 'u' || (conv_id % 20) AS user_id FROM conversations),"
    " r AS (SELECT conv_id + turn % 2 AS conv_id, turn, 'u' || (conv_id % 20) AS user_id FROM conversations)"
    " SELECT r.conv_id, turn, r.user_id, o.conv_id IS NOT NULL AS granted FROM r LEFT JOIN o ON o.conv_id = r.conv_id AND o.user_id = r.user_id",
)
def conversation_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even turns ask for the user's own conversation, odd ones for the next, which is another user's."""
    rows = fixtures.table(spark, sf_dir, "conversations").withColumns(
        {"user_id": F.concat(F.lit("u"), F.pmod("conv_id", F.lit(20))), "tenant_id": F.lit("t0")}
    )
    asked = rows.select((F.col("conv_id") + F.pmod("turn", F.lit(2))).alias("conv_id"), "turn", "user_id", "tenant_id")
    return ch.conversation_access(asked, rows).drop("tenant_id")


@query(
    "rate_flags",
    "SELECT CASE WHEN event_type <> 'view' THEN 'user-' || user_id ELSE '10.0.0.' || (user_id % 250) END AS caller,"
    " date_trunc('minute', ts) AS window_start, count(*) AS n, count(*) > 5 AS flagged FROM events GROUP BY 1, 2",
)
def rate_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ch.rate_flags(fixtures.rate_requests(spark, sf_dir))


_CALLS_SQL = """calls AS (SELECT conv_id, turn, conv_id + turn AS n,
 CASE WHEN (conv_id + turn) % 13 = 0 THEN 'API_ERROR' ELSE ['set_price_alert', 'get_user_alerts', 'execute_paper_trade', 'none'][((conv_id + turn) % 4 + 1)::INTEGER] END AS called_tool FROM conversations),
matched AS (SELECT *, CASE n % 3 WHEN 0 THEN called_tool IN ('set_price_alert', 'get_user_alerts') WHEN 1 THEN called_tool = 'execute_paper_trade' ELSE called_tool = 'none' END AS is_correct FROM calls)"""


@query("tool_match", f"WITH {_CALLS_SQL} SELECT conv_id, turn, called_tool, is_correct FROM matched")
def tool_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.tool_match(fixtures.tool_calls(spark, sf_dir)).select("conv_id", "turn", "called_tool", "is_correct")


@query(
    "tool_accuracy",
    f"WITH {_CALLS_SQL} SELECT round(avg(is_correct::INT) * 100, 6) AS tool_calling_accuracy, count(*) AS dataset_size, count_if(NOT is_correct)::BIGINT AS n_failed FROM matched",
)
def tool_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = ev.tool_accuracy(fixtures.tool_calls(spark, sf_dir))
    return scored.withColumn("tool_calling_accuracy", F.round("tool_calling_accuracy", 6))


@query("failed_cases", f"WITH {_CALLS_SQL} SELECT conv_id, turn, called_tool FROM matched WHERE NOT is_correct")
def failed_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.failed_cases(fixtures.tool_calls(spark, sf_dir)).select("conv_id", "turn", "called_tool")


@query(
    "rag_scores",
    "WITH j AS (SELECT CASE WHEN conv_id % 11 <> 0 THEN ((conv_id + turn) % 5) / 4.0::DOUBLE END AS f, CASE WHEN conv_id % 11 <> 0 THEN ((conv_id * 3 + turn) % 9) / 8.0::DOUBLE END AS r FROM conversations WHERE role = 'assistant')"
    " SELECT round(sum(coalesce(f, 0)) / count(*) * 100, 6) AS avg_faithfulness, round(sum(coalesce(r, 0)) / count(*) * 100, 6) AS avg_relevance, count(*) AS n_cases FROM j",
)
def rag_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = ev.rag_scores(fixtures.judged_answers(spark, sf_dir))
    return scored.withColumns({c: F.round(c, 6) for c in ("avg_faithfulness", "avg_relevance")})
