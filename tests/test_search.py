"""Relevance, pivot search, phrases, sketches and dated sinks against brute force; plan shapes."""

from __future__ import annotations

import datetime as dt
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantframe.operators import labels as lb
from quantframe.operators import news as nw
from quantframe.operators import portfolio as pf
from quantframe.operators import quantiles as qt
from quantframe.operators import relevance as rl
from quantframe.operators import retrieval as rt
from quantframe.sources import files

WORDS = [f"w{i}" for i in range(60)]


def brute_bm25(queries, documents, k):
    words = {i: re.findall(r"[^\W_]+", (t or "").lower()) for i, t in documents}
    n, mean = len(words), np.mean([len(w) for w in words.values()])
    df = {}
    for w in words.values():
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = {}
    for q, text in queries:
        scores = {}
        for t in set(re.findall(r"[^\W_]+", text.lower())) & set(df):
            idf = math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
            for i, w in words.items():
                tf = w.count(t)
                if tf:
                    scores[i] = scores.get(i, 0) + idf * tf * (rl.K1 + 1) / (tf + rl.K1 * (1 - rl.B + rl.B * len(w) / mean))
        best = sorted(scores, key=lambda i: (-round(scores[i], 9), i))[:k]
        out |= {(q, i): (round(scores[i], 6), r + 1) for r, i in enumerate(best)}
    return out


def bm25_data():
    rng = random.Random(4)
    weights = [1 / (i + 1) for i in range(60)]  # a few words are in nearly every text
    documents = [(i, " ".join(rng.choices(WORDS, weights, k=rng.randrange(1, 80)))) for i in range(300)]
    documents += [(300, None), (301, ""), (302, documents[5][1]), (303, "w59 " * 40)]
    queries = [(q, " ".join(rng.choices(WORDS, k=6))) for q in range(12)] + [(12, "w0 w1 w0"), (13, "absent"), (14, ""), (15, "W0, w59!")]
    return queries, documents


def test_bm25_equals_brute_force(spark):
    queries, documents = bm25_data()
    q, d = spark.createDataFrame(queries, "query_id int, query_text string"), spark.createDataFrame(documents, "doc_id int, text string")
    got = {(r.query_id, r.doc_id): (round(r.score, 6), r.rank) for r in rl.bm25(q, d, 7).collect()}
    assert got == brute_bm25(queries, documents, 7)


def test_common_terms_yield_no_candidates(spark):
    """A rare and a common term: only the rare one is read for candidates."""
    documents = [(i, "common filler") for i in range(500)] + [(500 + i, "common rare rare rare") for i in range(20)]
    d = spark.createDataFrame(documents, "doc_id int, text string")
    wanted = spark.createDataFrame([(0, "common"), (0, "rare")], "query_id int, term string")
    weights = rl.postings(d, wanted.select("term").distinct())
    needed = {r.term: r.needed for r in rl.needed_terms(wanted, weights, 5).collect()}
    assert needed == {"common": False, "rare": True}


def brute_knn(queries, corpus, k):
    out = set()
    for q, ns, v in queries:
        rows = [(i, np.array(e, float)) for s, i, e in corpus if s == ns and e is not None]
        unit = lambda x: x / np.linalg.norm(x) if np.linalg.norm(x) else x
        scores = sorted((-round(float(unit(np.array(v, float)) @ unit(e)), 9) + 0.0, i) for i, e in rows)[:k]
        out |= {(q, ns, i, rank + 1) for rank, (_, i) in enumerate(scores)}
    return out


def clusters(n=900, dim=12):
    rng = np.random.default_rng(6)
    centre = rng.standard_normal((15, dim)) * 4
    corpus = [("a" if i % 4 else "b", i, [float(np.float32(x)) for x in centre[i % 15] + 0.2 * rng.standard_normal(dim)]) for i in range(n)]
    corpus += [("a", n, [0.0] * dim), ("a", n + 1, None), ("a", n + 2, corpus[1][2]), ("a", n + 3, corpus[1][2])]
    queries = [(q, "ab"[q % 2], [float(x) for x in centre[q % 15] + 0.3 * rng.standard_normal(dim)]) for q in range(40)]
    return queries + [(40, "a", [0.0] * dim), (41, "none", [1.0] * dim), (42, "a", corpus[1][2])], corpus


def frames(spark, queries, corpus):
    return (
        spark.createDataFrame(queries, "query_id long, namespace string, vector array<double>"),
        spark.createDataFrame(corpus, "namespace string, id long, embedding array<float>"),
    )


def test_pivot_search_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(rt, "BLOCK_CORPUS", 20)
    monkeypatch.setattr(rt, "BLOCK_QUERIES", 8)
    queries, corpus = clusters()
    q, c = frames(spark, queries, corpus)
    got = {(r.query_id, r.namespace, r.id, r.rank) for r in rt.knn(q, c, 5, plan="pivots").collect()}
    assert got == brute_knn(queries, corpus, 5)


def test_pivot_search_visits_few_groups(spark, monkeypatch):
    queries, corpus = clusters()
    queries = [x for x in queries if any(x[2])]
    rows = [x for x in corpus if x[2] and any(x[2])]
    q, c = frames(spark, queries, rows)
    chosen = {ns: np.array([e for s, _, e in rows if s == ns][:30], float) for ns in "ab"}
    pivots = rt._Pivots(chosen)
    held = rt._assigned(c, pivots)
    pivots.measured(held.groupBy("namespace", "pivot").agg(F.min("near").alias("near"), F.max("far").alias("far"), F.count(F.lit(1)).alias("rows")).collect())
    kth = spark.createDataFrame([(x[0], 0.95) for x in queries], "query_id long, kth double")
    others = rt._visits(q.join(kth, "query_id"), pivots, False).count()
    assert rt._visits(q, pivots, True).count() == len([x for x in queries if x[1] in "ab"])
    assert others < 0.2 * 30 * len(queries)


def test_pivot_with_identical_rows(spark, monkeypatch):
    """A third and more of equal vectors: their group is cut into blocks, ties go to the smaller id."""
    monkeypatch.setattr(rt, "BLOCK_CORPUS", 16)
    corpus = [("a", i, [1.0, 2.0, 3.0]) for i in range(100)] + [("a", 100 + i, [float(i), 1.0, -1.0]) for i in range(60)]
    queries = [(0, "a", [1.0, 2.0, 3.0]), (1, "a", [0.0, -1.0, 1.0])]
    q, c = frames(spark, queries, corpus)
    got = {(r.query_id, r.namespace, r.id, r.rank) for r in rt.knn(q, c, 7, plan="pivots").collect()}
    assert got == brute_knn(queries, corpus, 7)


def test_phrases_match_whole_words(spark):
    mapping = {"B": "S&P 500 OR spy", "A": "Gold OR GLD", "C": "Treasury Bonds", "D": "new york stock exchange"}
    texts = {
        0: "the s&p 500 and GOLD", 1: "golden spying", 2: "S&P  500", 3: "treasury bonds, gold.", 4: "(spy)", 5: None, 6: "", 7: "gold_rush",
        8: "New York Stock Exchange", 9: "york stock exchange new", 10: "gold gold gold spy", 11: "x" * 200_000 + " gold", 12: "treasury\nbonds", 13: "gold",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id int, text string")
    got = {r.doc_id: r.tickers for r in nw.match_phrases(docs, nw.phrase_table(spark, mapping)).collect()}
    for i, text in texts.items():
        want = [t for t, e in mapping.items() if any(re.search(rf"(?i)(?<!\w){re.escape(p)}(?!\w)", text or "") for p in e.split(" OR "))]
        assert got[i] == want, i
    assert all(r.tickers == [] for r in nw.match_phrases(docs, nw.phrase_table(spark, mapping).limit(0)).collect())


@pytest.mark.parametrize("train,step,embargo", [(30, 7, 3), (21, 7, 0), (5, 7, 2)])
def test_fold_thresholds_equal_copied_folds(spark, monkeypatch, train, step, embargo):
    monkeypatch.setattr(lb, "MIN_TRAIN", 20)
    rng = random.Random(8)
    first = dt.date(2020, 1, 1)
    rows = [(first + dt.timedelta(days=2 * i), rng.gauss(0, 1)) for i in range(90) for _ in range(rng.randrange(1, 9))]
    df = spark.createDataFrame(rows, "date date, fwd_log_return double")
    assigned = lb.fold_assign(df, train, step, embargo)
    usable = assigned.filter("role = 'train'").join(lb.dense_folds(assigned).select("fold"), "fold")
    want = {r.fold: (r.high, r.low) for r in lb.quantile_thresholds(usable, ["fold"]).collect()}
    got = {r.fold: (r.high, r.low) for r in lb.fold_thresholds(df, train, step, embargo).collect()}
    assert got.keys() == want.keys() and len(want) > 3
    for f, (high, low) in want.items():
        assert got[f] == (pytest.approx(high, abs=1e-12), pytest.approx(low, abs=1e-12))


def test_wrong_brackets_are_opened(spark, monkeypatch):
    """Sketches that claim another value: the exact counts disprove them."""
    real = qt._brackets
    monkeypatch.setattr(qt, "SMALL", 10)
    monkeypatch.setattr(qt, "_brackets", lambda *a: real(*a).withColumns({"low": F.lit(0.4), "high": F.lit(0.41)}))
    values = [i / 1000 for i in range(1000)]
    got = qt.exact_quantiles(spark.createDataFrame([(v,) for v in values], "v double"), [], "v", {"a": 0.25, "b": 0.9}).first()
    assert (got.a, got.b) == (pytest.approx(np.quantile(values, 0.25)), pytest.approx(np.quantile(values, 0.9)))


def test_equity_curve_in_one_pass(spark):
    rng = random.Random(1)
    rows = [(k, dt.date(2000, 1, 1) + dt.timedelta(days=17 * i), rng.gauss(0, 0.05)) for k in "xy" for i in range(700)]
    rows[3] = (*rows[3][:2], None)
    daily = spark.createDataFrame(rows, "k string, date date, strategy_return double")
    got = {(r.k, r.date): (r.equity, r.running_max, r.drawdown) for r in pf.equity_curve(daily, ["k"]).collect()}
    for k in "xy":
        total, top = 0.0, -math.inf
        for _, d, v in (r for r in rows if r[0] == k):
            total += v or 0.0
            top = max(top, math.exp(total))
            assert got[k, d] == (pytest.approx(math.exp(total)), pytest.approx(top), pytest.approx(math.exp(total) / top - 1, abs=1e-12))
    plan = pf.equity_curve(daily, ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1


def test_day_folders_are_replaced_and_dropped(spark, tmp_path):
    path = str(tmp_path / "days")
    rows = lambda *r: spark.createDataFrame(list(r), "v int, day string")
    state = lambda: sorted((r.v, str(r.day)) for r in spark.read.parquet(path).collect())
    files.write_days(rows((1, "2024-01-01"), (2, "2024-01-02")), path)
    files.write_days(rows((3, "2024-01-02"), (4, "2024-01-03")), path)
    assert state() == [(1, "2024-01-01"), (3, "2024-01-02"), (4, "2024-01-03")]
    assert files.drop_days(spark, path, "2024-01-03") == ["day=2024-01-01", "day=2024-01-02"]
    assert state() == [(4, "2024-01-03")]
    assert files.drop_days(spark, path, "2024-01-03") == [] and files.drop_days(spark, str(tmp_path / "none"), "9") == []


def test_metrics_of_a_run_are_kept_once(spark, tmp_path):
    path = str(tmp_path / "metrics")
    run = lambda name, v: spark.createDataFrame([(name, "a", v), (name, "b", v)], "run string, key string, value double")
    for name, v in (("one", 1.0), ("two", 2.0), ("one", 3.0)):
        files.append_metrics(run(name, v), path)
    got = sorted(tuple(r) for r in files.read_metrics(spark, path).collect())
    assert got == [("one", "a", 3.0), ("one", "b", 3.0), ("two", "a", 2.0), ("two", "b", 2.0)]


def test_reports_by_day_read_back(spark, tmp_path):
    path = str(tmp_path / "reports")
    day = dt.date(2024, 1, 5)
    first = [("SPY", day, "one\n\ntwo\n"), ("SPY", day, "again"), ("QQQ", day, "q\n")]
    rows = lambda r: spark.createDataFrame(r, "ticker string, date date, report string")
    files.write_reports(rows(first), path)
    files.write_reports(rows([("QQQ", day, "new"), ("QQQ", day + dt.timedelta(days=1), "next")]), path)
    want = [*first[:2], ("QQQ", day, "new"), ("QQQ", day + dt.timedelta(days=1), "next")]
    assert sorted(tuple(r) for r in files.read_reports(spark, path).collect()) == sorted(want)


def test_archive_reads_only_the_days_of_the_batch(spark, tmp_path):
    path = str(tmp_path / "lake")
    news = lambda rows: files.archive_rows(
        spark.createDataFrame(rows, "text string, url string, at string"), F.col("at").cast("timestamp_ntz")
    ).drop("at")
    files.write_archive(news([("a", "u", "2024-01-01 10:00:00"), ("b", "u", "2024-01-02 10:00:00")]), path)
    files.write_archive(news([("b", "u", "2024-01-02 11:00:00"), ("a", "u", "2024-01-02 11:00:00"), ("c", "u", "2024-02-01 00:00:00")]), path)
    # a day that the batch does not touch may hold anything
    (tmp_path / "lake" / "year=2024" / "month=01" / "day=01" / "part-broken.json").write_bytes(b"\xff not json")
    files.write_archive(news([("c", "u", "2024-02-01 05:00:00")]), path)
    rows = spark.read.schema("text string, year string, month string, day string").json(path).where("text is not null").collect()
    assert sorted((r.text, r.month, r.day) for r in rows) == [("a", "01", "01"), ("a", "01", "02"), ("b", "01", "02"), ("c", "02", "01")]


def test_bm25_reads_the_postings_of_a_query_once(spark):
    """Every candidate met all the terms of its document, and then those of its query: the rows of a frequent term were multiplied."""
    q = spark.createDataFrame([(1, "alpha beta"), (2, "beta gamma")], "query_id long, query_text string")
    d = spark.createDataFrame([(i, f"alpha beta {'gamma ' * (i % 3)}") for i in range(30)], "doc_id long, text string")
    plan = rl.bm25(q, d, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1
