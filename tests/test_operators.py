"""Operators against plain Python folds on randomised or hand-made inputs."""

from __future__ import annotations

import datetime as dt
import json
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantframe import schemas
from quantframe.functions import reports as rp
from quantframe.functions import signals as sg
from quantframe.functions import text as tx
from quantframe.operators import alerts as al
from quantframe.operators import bars as br
from quantframe.operators import chat as ch
from quantframe.operators import labels as lb
from quantframe.operators import news as nw
from quantframe.operators import portfolio as pf
from quantframe.operators import predictions as pr
from quantframe.operators import quantiles as qt
from quantframe.operators import retrieval as rt
from quantframe.operators import tables as tb
from quantframe.operators.evaluation import rag_scores, tool_accuracy
from quantframe.sources import files

DAY = dt.date(2024, 1, 1)


def days(n: int) -> list[dt.date]:
    return [DAY + dt.timedelta(days=i) for i in range(n)]


# --- quantiles, folds, portfolio -------------------------------------------------------------


@pytest.mark.parametrize("small", [qt.SMALL, 500])
@pytest.mark.parametrize("keys", [["g"], []])
def test_exact_quantiles_match_numpy(spark, monkeypatch, small, keys):
    """With the lower limit the large groups are ranked inside narrowed brackets, the others by the built-in percentile."""
    monkeypatch.setattr(qt, "SMALL", small)
    monkeypatch.setattr(qt, "SKETCH", 64)
    monkeypatch.setattr(qt, "SLACK", 0.02)
    monkeypatch.setattr(qt, "RANKED", 16)
    monkeypatch.setattr(qt, "RANGES", 8)
    rng = np.random.default_rng(5)
    groups = {"a": rng.normal(size=30000).round(3), "b": rng.integers(0, 4, 999).astype(float), "c": np.array([1.0, 2.0])}
    pdf = pd.concat([pd.DataFrame({"g": g, "v": v}) for g, v in groups.items()])
    wanted = {"low": 0.33, "mid": 0.5, "high": 0.66, "top": 1.0, "bottom": 0.0}
    got = qt.exact_quantiles(spark.createDataFrame(pdf), keys, "v", wanted).toPandas()
    parts = dict(list(pdf.groupby("g")["v"])) if keys else {"all": pdf["v"]}
    got.index = got["g"] if keys else ["all"]
    assert len(got) == len(parts)
    for g, values in parts.items():
        for name, q in wanted.items():
            assert got.loc[g, name] == pytest.approx(np.quantile(values, q), abs=1e-12)


def test_fold_assign_matches_the_index_arithmetic(spark):
    n, train, step, embargo = 57, 20, 7, 3
    df = spark.createDataFrame(pd.DataFrame({"ticker": "A", "date": days(n)}))
    got = {(r.fold, r.role, r.date) for r in lb.fold_assign(df, train, step, embargo).collect()}
    want, all_days = set(), days(n)
    for fold, i in enumerate(range(train + embargo, n, step)):
        want |= {(fold, "train", d) for d in all_days[i - embargo - train : i - embargo]}
        want |= {(fold, "test", d) for d in all_days[i : min(i + step, n)]}
    assert got == want


def test_holdout_marks_the_last_dates(spark):
    df = spark.createDataFrame(pd.DataFrame({"date": days(50) * 2}))
    counts = dict(lb.holdout_split(df, 40).groupBy("split").count().collect())
    assert counts == {"train": 20, "test": 80}


def test_position_state_and_grid_match_the_day_loop(spark):
    rng = random.Random(2)
    rows = [(t, d, rng.choice([-1, 0, 0, 1]), rng.uniform(-0.02, 0.02)) for t in "ABC" for d in days(200) if rng.random() < 0.8]
    df = spark.createDataFrame(rows, "ticker string, date date, y_pred int, fwd_log_return double")
    by_key = {(t, d): (s, r) for t, d, s, r in rows}
    state, want = dict.fromkeys("ABC", 0), {}
    for d in sorted({r[1] for r in rows}):
        pnl = []
        for t in "ABC":
            signal, ret = by_key.get((t, d), (0, 0.0))
            if state[t] == 0 and signal == 1:
                state[t] = 1
            elif state[t] == 1 and signal == -1:
                state[t] = 0
            pnl.append(ret if state[t] else 0.0)
        want[d] = np.mean(pnl)
    got = {r.date: r.strategy_return for r in pf.binary_portfolio(df).collect()}
    assert got.keys() == want.keys()
    for d, value in want.items():
        assert got[d] == pytest.approx(value, abs=1e-12)
    grid = pf.date_ticker_grid(df, ["fwd_log_return"]).collect()
    assert len(grid) == 3 * len(want)
    assert all(r.fwd_log_return == pytest.approx(by_key.get((r.ticker, r.date), (0, 0.0))[1]) for r in grid)


def test_grid_expansion_is_not_collected_for_a_broadcast(spark):
    """The planner takes an expansion for as small as its tickers; it must be shuffled all the same."""
    df = spark.createDataFrame([(t, d, 1.0) for t in "AB" for d in days(1500)] + [(None, days(3)[2], 2.0)], "ticker string, date date, v double")
    grid = pf.date_ticker_grid(df, ["v"])
    assert grid.count() == 3 * 1500
    rows = {(r.ticker, r.date): r.v for r in grid.collect()}
    assert len(rows) == 3 * 1500 and rows[(None, days(3)[2])] == 0.0 and rows["B", days(1500)[-1]] == 1.0
    depth = lambda line: max(line.find("+- "), line.find(":- "))
    plan = grid._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].splitlines()
    made = next(i for i, line in enumerate(plan) if "Generate explode" in line)
    above, level = [], depth(plan[made])
    for line in reversed(plan[:made]):
        if depth(line) < level:
            above, level = [*above, line], depth(line)
    assert any("SortMergeJoin" in line for line in above) and not any("BroadcastExchange" in line for line in above)


def test_metrics_use_population_std_and_start_at_the_first_point(spark):
    returns = [-0.02, 0.01, 0.03, -0.05, 0.02]
    df = spark.createDataFrame([("A", d, 1, r) for d, r in zip(days(5), returns)], "ticker string, date date, y_pred int, fwd_log_return double")
    row = pf.portfolio_metrics(df).first()
    equity = np.exp(np.cumsum(returns))
    peak = np.maximum.accumulate(equity)
    assert row.max_drawdown == pytest.approx(((equity - peak) / peak).min())
    assert row.sharpe_ratio == pytest.approx(np.sqrt(252) * np.mean(returns) / (np.std(returns) + 1e-8))


# --- labels and verdicts ---------------------------------------------------------------------


def test_label_edges_and_threshold_priority(spark):
    row = spark.range(1).select(
        sg.label(F.lit(0.5), 0.5, -0.5).alias("strict"),
        sg.label(F.lit(0.5), 0.5, -0.5, inclusive=True).alias("inclusive"),
        sg.decide(F.lit(0.6), F.lit(0.6), 0.5, 0.5, "sell").alias("sell"),
        sg.decide(F.lit(0.6), F.lit(0.6), 0.5, 0.5, "buy").alias("buy"),
    ).first()
    assert tuple(row) == (0, 1, -1, 1)


def test_conviction_zones(spark):
    cases = {(0.65, 0.1): ("BUY", "HOT", "BUY"), (0.1, 0.7): ("SELL", "HOT", "SELL"), (0.45, 0.3): ("HOLD", "GREY", "BUY"),
             (0.4, 0.4): ("HOLD", "GREY", "SELL"), (0.3, 0.37): ("HOLD", "COLD", "HOLD")}
    df = spark.createDataFrame(list(cases), "b double, s double")
    zones = sg.conviction(F.col("b"), F.col("s"), 0.6, 0.6)
    for r in df.select("b", "s", *[c.alias(n) for n, c in zones.items()]).collect():
        assert (r.ml_decision, r.conviction_zone, r.leaning_action) == cases[r.b, r.s]


def test_verdict_gate(spark):
    cases = [("HOT", True, "BUY", "I would sell or hold", "SELL"), ("HOT", False, "BUY", None, "BUY"), ("HOT", True, "BUY", None, "HOLD"),
             ("GREY", True, "SELL", " sell ", "SELL"), ("GREY", False, "SELL", "sell", "HOLD"), ("COLD", True, "HOLD", "buy", "HOLD"),
             ("HOT", True, "BUY", "maybe", "MAYBE")]
    df = spark.createDataFrame(cases, "z string, n boolean, l string, a string, want string")
    assert df.filter(sg.verdict(F.col("z"), F.col("n"), F.col("l"), F.col("a")) != F.col("want")).count() == 0


# --- bars and predictions --------------------------------------------------------------------


def test_clean_bars_keeps_finished_traded_bars(spark):
    d8, d9 = dt.date(2026, 7, 8), dt.date(2026, 7, 9)
    raw = spark.createDataFrame(
        [("SPY", d8, 1.0, 10.0), ("SPY", d9, 1.0, 10.0), ("QQQ", d8, None, 10.0), ("QQQ", d9, 2.0, 5.0), ("^VIX", d8, 15.0, 0.0), ("DIA", d8, 1.0, 0.0)],
        "ticker string, date date, close double, volume double",
    )
    cutoff = br.market_cutoff(F.lit("2026-07-09 14:00:00").cast("timestamp_ntz"))  # ten in the morning in New York
    rows = br.clean_bars(raw, cutoff).collect()
    assert sorted((r.ticker, r.date, r.adj_close) for r in rows) == [("SPY", d8, 1.0), ("VIX", d8, 15.0)]


def test_market_cutoff_follows_daylight_saving(spark):
    stamps = {"2026-07-09 19:59:59": "2026-07-08", "2026-07-09 20:00:00": "2026-07-09", "2026-01-09 20:30:00": "2026-01-08", "2026-01-09 21:00:00": "2026-01-09"}
    df = spark.createDataFrame(list(stamps.items()), "ts string, want string")
    assert df.filter(br.market_cutoff(F.col("ts").cast("timestamp_ntz")) != F.col("want").cast("date")).count() == 0


def test_range_replace_also_removes_keys_not_supplied_again(spark):
    base = spark.createDataFrame([(t, d, 1.0) for t in "AB" for d in days(5)], "ticker string, date date, close double")
    batch = spark.createDataFrame([("A", days(5)[1], 9.0), ("A", days(5)[3], 9.0)], base.schema)
    got = sorted((r.ticker, r.date.day, r.close) for r in br.range_replace(base, batch).collect())
    assert got == [("A", 1, 1.0), ("A", 2, 9.0), ("A", 4, 9.0), ("A", 5, 1.0)] + [("B", i, 1.0) for i in range(1, 6)]


def test_next_close_is_strictly_later_and_not_after_the_target(spark):
    rng = random.Random(4)
    span = [dt.date(2000, 1, 1) + dt.timedelta(days=i * 40) for i in range(120)]
    bars = [(t, d, rng.random()) for t in "AB" for d in span if rng.random() < 0.6]
    preds = [(f"{t}{i}", t, d) for t in "ABC" for i, d in enumerate(span)]
    target = span[100]
    got = pr.next_close_asof(
        spark.createDataFrame(preds, "id string, ticker string, signal_date date"),
        spark.createDataFrame(bars, "ticker string, date date, close double"), F.lit(target),
    ).collect()
    assert len(got) == len(preds)
    for r in got:
        later = [(d, c) for t, d, c in bars if t == r.ticker and r.signal_date < d <= target]
        assert r.next_close == (min(later)[1] if later else None)


def test_drift_needs_twenty_trades(spark):
    def table(n, wins):
        rows = [(str(i), DAY, "BUY", "RECONCILED", 1.0 if i < wins else -1.0) for i in range(n)]
        return spark.createDataFrame(rows, "id string, prediction_date date, quant_decision string, reconciliation_status string, realized_return double")

    status = lambda n, wins: pr.drift_check(table(n, wins), F.lit(DAY)).first()["status"]
    assert (status(19, 0), status(20, 8), status(20, 9)) == ("insufficient", "drift", "healthy")


def test_last_write_wins_and_upsert(spark):
    rows = spark.createDataFrame([("n", 1, "old", 1), ("n", 1, "new", 2), ("m", 1, "other", 1)], "namespace string, id int, v string, ver int")
    got = tb.last_write_wins(rows, ["namespace", "id"], ["ver"])
    assert sorted(r.v for r in got.collect()) == ["new", "other"]
    batch = spark.createDataFrame([("n", 1, "third", 3)], rows.schema)
    assert sorted(r.v for r in tb.upsert(rows, batch, ["namespace", "id"]).collect()) == ["other", "third"]


# --- accounts --------------------------------------------------------------------------------


def test_alert_rules_and_isolation(spark):
    asked = spark.createDataFrame(
        [(1, "t0", "u1", "aapl", 150.5, "above"), (2, "t0", "u1", "AAPL", -20.0, "above"), (3, "t0", "u1", "AAPL", 5.0, "equal"), (4, "t1", "u2", "GOOGL", 100.0, "below")],
        "alert_id int, tenant_id string, user_id string, ticker string, target_price double, condition string",
    )
    created = al.create_alerts(asked)
    assert {r.alert_id: r.ticker for r in created.collect()} == {1: "AAPL", 4: "GOOGL"}
    assert [r.alert_id for r in al.active_alerts(created, "t1", "u2").collect()] == [4]


def test_alert_log_matches_a_fold(spark):
    rng = random.Random(9)
    log = [(rng.randrange(30), i, rng.choice(["create", "update", "cancel", "trigger"]), float(i), rng.choice(["me", "me", "you"])) for i in range(400)]
    state: dict[int, list] = {}
    for alert, _, op, price, user in log:
        if op == "create":
            state.setdefault(alert, ["active", price, user])
        elif alert in state:
            s = state[alert]
            if op == "trigger" and s[0] == "active":
                s[0] = "triggered"
            elif op == "update" and s[0] == "active" and s[2] == user:
                s[1] = price
            elif op == "cancel" and s[2] == user:
                s[0] = "cancelled"
    df = spark.createDataFrame(log, "alert_id int, seq int, op string, target_price double, user_id string").withColumn("tenant_id", F.lit("t"))
    got = {r.alert_id: [r.status, r.target_price, r.user_id] for r in al.apply_alert_changes(df).collect()}
    assert got == state


def test_credits_block_once_used_up(spark):
    rng = random.Random(7)
    rows = [(f"u{rng.randrange(3)}", c, t, rng.choice([*ch.MODEL_COSTS, "odd", "failed_all"]), rng.random() < 0.2) for c in range(120) for t in range(2)]
    spent: dict = {}
    want = {}
    for u, c, t, m, cached in rows:
        before = spent.get(u, 0.0)
        cost = 0.0 if cached or m == "failed_all" else ch.MODEL_COSTS.get(m, 1.0)
        blocked = before >= 50.0
        spent[u] = before + (0.0 if blocked else cost)
        want[c, t] = (blocked, 50.0 - spent[u])
    df = spark.createDataFrame(rows, "user_id string, conv_id long, turn long, model string, is_cached boolean")
    got = {(r.conv_id, r.turn): (r.blocked, r.credits_remaining) for r in ch.credit_ledger(df, 50.0).collect()}
    assert got == want


def test_one_answer_of_a_two_credit_model(spark):
    df = spark.createDataFrame([("u", 1, 1, "gemini-3.5-flash", False)], "user_id string, conv_id long, turn long, model string, is_cached boolean")
    assert ch.credit_ledger(df).first()["credits_remaining"] == 98.0


def test_evaluations_divide_by_all_cases(spark):
    judged = spark.createDataFrame([(1.0, 0.5), (None, None)], "faithfulness double, relevance double")
    assert tuple(rag_scores(judged).first()) == (50.0, 25.0, 2)
    calls = spark.createDataFrame([(["a", "b"], "b"), (["none"], "none"), (["a"], "API_ERROR"), (["a"], "c")], "expected_tool array<string>, called_tool string")
    assert tuple(tool_accuracy(calls).first()) == (50.0, 4, 2)


# --- texts -----------------------------------------------------------------------------------


def test_validate_news_routes(spark):
    good = {"text": " hi ", "published_at": 1720447200.0, "url": "u", "tickers": ["SPY", "TLT"]}
    bodies = {json.dumps(good): None, json.dumps({**good, "text": " \t"}): "blank text", json.dumps({**good, "tickers": []}): "no tickers",
              json.dumps({k: v for k, v in good.items() if k != "url"}): "missing field", '{"text": "cut': "malformed"}
    df = spark.createDataFrame([(b,) for b in bodies], "body string")
    checked = nw.validate_news(df).collect()
    assert {r.body: r.reason for r in checked} == bodies
    assert [r.text for r in checked if r.reason is None] == ["hi"]


def test_vector_id_prints_the_float_as_python_does(spark):
    import hashlib

    for stamp in (1720447200.0, 1720447200.25):
        got = spark.range(1).select(tx.vector_id(F.lit("ch"), F.lit(3), F.lit(stamp))).first()[0]
        assert got == hashlib.md5(f"ch_3_{stamp}".encode()).hexdigest()


def test_age_rounds_half_to_even(spark):
    ages = {0.5: "TODAY", 1.5: "2 DAYS AGO", 1.0: "1 DAY AGO", 2.5: "2 DAYS AGO", -3.0: "TODAY"}
    df = spark.createDataFrame(list(ages.items()), "days double, want string")
    assert df.filter(rp.age_label(F.col("days") * 86400) != F.col("want")).count() == 0


def test_mask_pii(spark):
    text = "card 4111 1111 1111 1111, mail a.b@c.com, phone 555-123-4567, id 12.345.678"
    want = text
    for kind, pattern in tx.PII_PATTERNS.items():
        want = re.sub(pattern, f"[{kind}_REDACTED]", want)
    assert spark.range(1).select(tx.mask_pii(F.lit(text))).first()[0] == want
    assert all(f"[{kind}_REDACTED]" in want for kind in tx.PII_PATTERNS)


def test_recursive_chunks_are_bounded_and_keep_every_character():
    rng = random.Random(3)
    words = ["".join(rng.choices("abc", k=rng.randrange(1, 12))) for _ in range(3000)]
    text = "".join(w + rng.choice([" ", " ", " ", ". ", "\n", "\n\n"]) for w in words)
    text += "".join(rng.choices("0123456789", k=1700))
    chunks = tx.split_recursively(text)
    assert all(0 < len(c) <= 500 for c in chunks)
    at = 0
    for c in chunks:  # chunks come in order and leave only white space out
        found = text.find(c, max(0, at - 60))
        assert found >= 0 and not text[at:found].strip()
        at = max(at, found + len(c))
    assert not text[at:].strip()
    assert tx.split_recursively("one two three", 8, 4) == ["one two", "three"]


def test_recursive_chunks_in_built_in_functions_equal_the_plain_split(spark, sf_dir):
    rng = random.Random(0)
    texts = ["", "short", "a" * 499, "a" * 500, "a" * 501, "a" * 1200, "x" * 5000 + " " + "y" * 700, ". " * 900, "\n\n\n" * 400, " " * 2000]
    parts = ["\n\n", "\n", ".", " ", "a", "bc", "déf", "ghijghijghij", " ", "\n\n\n"]
    texts += ["".join(rng.choice([*parts, "z" * rng.randrange(1, 30)]) for _ in range(rng.randrange(1, 1300))) for _ in range(100)]
    texts += ["\n".join("w" * rng.randrange(1, 700) for _ in range(20)) for _ in range(10)]
    texts += [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    df = spark.createDataFrame([*enumerate(texts), (-1, None)], "i int, t string").select("i", tx.recursive_chunks(F.col("t")).alias("c"))
    got = {r.i: r.c for r in df.collect()}
    assert got.pop(-1) == []
    assert [i for i, t in enumerate(texts) if got[i] != tx.split_recursively(t)] == []
    assert "Python" not in df._jdf.queryExecution().toString()


def test_archive_keeps_one_document_per_day_and_text(spark):
    df = spark.createDataFrame([("a", "u1", 0.0), ("a", "u2", 3600.0), ("a", "u3", 90000.0), ("b", "u4", 0.0)], "text string, url string, at double")
    rows = files.archive_rows(df, tx.epoch_ntz(F.col("at"))).collect()
    assert sorted(r.url for r in rows) == ["u2", "u3", "u4"]


def test_archive_tells_texts_with_one_short_key_apart_and_repeats_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "doc_key", lambda text: F.lit("0badcafe"))
    df = spark.createDataFrame([("a", "u1", 0.0), ("b", "u2", 0.0)], "text string, url string, at double")
    rows = files.archive_rows(df, tx.epoch_ntz(F.col("at")))
    for _ in range(2):
        files.write_archive(rows, str(tmp_path / "archive"))
    stored = spark.read.schema(rows.schema).json(str(tmp_path / "archive")).collect()
    assert sorted(r.text for r in stored) == ["a", "b"] and len({r.s3_key for r in stored}) == 2


# --- retrieval -------------------------------------------------------------------------------


def test_the_three_search_plans_agree_with_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(8)
    corpus = [(f"n{i % 3}", i, [float(x) for x in rng.normal(size=6).astype("float32")]) for i in range(400)]
    corpus += [("n0", 1000 + i, corpus[0][2]) for i in range(5)]  # exact ties
    queries = [(q, f"n{q % 3}", [float(x) for x in rng.normal(size=6)]) for q in range(60)]
    want = set()
    for q, ns, v in queries:
        unit = lambda x: np.asarray(x) / np.linalg.norm(x)
        ranked = sorted((-round(float(unit(v) @ unit(e)), 9), i) for n, i, e in corpus if n == ns)[:7]
        want |= {(q, ns, i, rank) for rank, (_, i) in enumerate(ranked, 1)}
    monkeypatch.setattr(rt, "BLOCK_QUERIES", 8)
    monkeypatch.setattr(rt, "BLOCK_CORPUS", 32)
    qs = spark.createDataFrame(queries, "query_id long, namespace string, vector array<double>")
    cs = spark.createDataFrame(corpus, "namespace string, id long, embedding array<float>").repartition(5)
    for plan in ("queries", "corpus", "pivots"):
        got = {(r.query_id, r.namespace, r.id, r["rank"]) for r in rt.knn(qs, cs, 7, plan).collect()}
        assert got == want, plan


def test_expired_nearest_entry_hides_a_fresh_second(spark):
    cache = spark.createDataFrame(
        [(rt.CACHE_NAMESPACE, "a", [1.0, 0.0], "old", 0.0), (rt.CACHE_NAMESPACE, "b", [0.99, 0.1], "new", 900.0)],
        "namespace string, id string, embedding array<double>, response string, timestamp double",
    )
    asked = spark.createDataFrame([(1, [1.0, 0.0], "what"), (2, [0.9, 0.2], "what"), (3, [0.9, 0.2], "buy it")], "query_id long, vector array<double>, query_text string")
    got = {r.query_id: (r.bypass, r.response) for r in rt.semantic_cache_lookup(asked, cache, F.lit(1000.0)).collect()}
    assert got == {1: (False, None), 2: (False, "new"), 3: (True, None)}


def test_rerank_beats_similarity_order(spark):
    corpus = spark.createDataFrame(
        [("fin_news_v1", 1, [1.0, 0.0], "nothing here"), ("fin_news_v1", 2, [0.5, 0.5], "gold price today")],
        "namespace string, id long, embedding array<double>, text string",
    )
    ask = spark.createDataFrame([(7, [1.0, 0.0], "gold price", "x"), (8, [1.0, 0.0], "gold", "x")], "query_id long, vector array<double>, query_text string, tenant_id string")
    rows = {r.query_id: r.context for r in rt.rag_context(ask, corpus).collect()}
    assert rows[7] == "gold price today\n- nothing here"
    empty = rt.rag_context(ask, corpus.filter("id > 9")).first()
    assert empty.context == rt.NO_CONTEXT


def test_schemas_are_not_changed_by_use(spark):
    nw.validate_news(spark.createDataFrame([("{}",)], "body string"))
    assert schemas.NEWS.names == ["text", "published_at", "url", "tickers"]
