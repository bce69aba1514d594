"""Explicit table schemas."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


_S, _D, _L, _DATE, _TS = T.StringType(), T.DoubleType(), T.LongType(), T.DateType(), T.TimestampType()

BARS = _struct(ticker=_S, date=_DATE, open=_D, high=_D, low=_D, close=_D, volume=_D, adj_close=_D)

PREDICTIONS = _struct(
    prediction_date=_DATE,
    signal_date=_DATE,
    ticker=_S,
    quant_decision=_S,
    quant_probability=_D,
    conviction_zone=_S,
    top_drivers=_S,
    pred_close_price=_D,
    llm_verdict=_S,
    actual_close_price=_D,
    realized_return=_D,
    reconciliation_status=_S,
)

NEWS = _struct(text=_S, published_at=_D, url=_S, tickers=T.ArrayType(_S))

ARTICLE = _struct(title=_S, description=_S, url=_S, publishedAt=_S)

VECTOR = _struct(
    namespace=_S,
    id=_S,
    embedding=T.ArrayType(T.FloatType()),
    text=_S,
    source=_S,
    url=_S,
    published_at=_D,
    sentiment=_S,
    sentiment_score=_D,
    ticker_principal=_S,
    tickers_relacionados=_S,
)

ALERTS = _struct(
    alert_id=_L, tenant_id=_S, user_id=_S, ticker=_S, target_price=_D, condition=_S, status=_S, created_at=_TS
)

TICKS = _struct(ticker=_S, ts=_TS, price=_D, qty=_D)

MANIFEST = _struct(
    buy_threshold=_D,
    sell_threshold=_D,
    bull_limit=_D,
    bear_limit=_D,
    q_high_original=_D,
    q_low_original=_D,
    req_train_days=_L,
    req_step_days=_L,
    req_embargo_days=_L,
    req_features=T.ArrayType(_S),
    model_params=T.MapType(_S, _D),
    class_weight=T.MapType(_S, _D),
)

TOOL_EVAL = _struct(query=_S, expected_tool=_S, requires_rag=T.BooleanType(), intent=_S)
