"""Tests of the fourth round: link counts of large groups of near copies."""

from __future__ import annotations

import random

import numpy as np

from quantframe.llm import near_text


def _variants(seed: int, many: int, words: int, most: int, first: int) -> list[tuple[int, str]]:
    """Texts that differ from one base in up to ``most`` words each, and in their length."""
    rng, rows = random.Random(seed), []
    for k in range(many):
        text = [f"s{seed}w{i}" for i in range(words - rng.randrange(words // 12))]
        for i in range(rng.randrange(1, most)):
            text[rng.randrange(len(text))] = f"odd{seed}x{k}x{i}"
        rows.append((first + k, " ".join(text)))
    return rows


def test_large_groups_of_near_copies_are_counted_without_all_pairs(spark, monkeypatch):
    rows = _variants(1, 240, 300, 6, 0) + _variants(2, 60, 200, 4, 1000) + [(2000, "alone in the world"), (2001, None)]
    bags = {k: set(near_text.shingles(t or "", 3).tolist()) for k, t in rows}
    want = {a: sum(a != b and bool(x) and 100 * len(x & y) >= 90 * len(x | y) for b, y in bags.items()) for a, x in bags.items()}
    met, plain = [], near_text._Join._met

    def counted(self, left, right, where):
        pairs = left.alias("l").join(right.alias("r"), "token").where(where)
        met.append(pairs.selectExpr("least(l.node, r.node) a", "greatest(l.node, r.node) b").distinct().count())
        return plain(self, left, right, where)

    monkeypatch.setattr(near_text._Join, "_met", counted)
    monkeypatch.setattr(near_text, "BLOCK", 16, raising=False)
    monkeypatch.setattr(near_text, "COLUMNS", 100, raising=False)
    got = near_text.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100).collect()
    assert {r.doc_id: r.class_links for r in got} == want
    assert len(set(want.values())) > 20
    assert sum(met) < 240 * 239 // 2


def test_shared_sizes_by_runs_of_columns(monkeypatch):
    monkeypatch.setattr(near_text, "COLUMNS", 7)
    rng = np.random.default_rng(3)
    left, right = ([np.unique(rng.integers(0, 90, n).astype(np.uint64)) for n in sizes] for sizes in ((1, 40, 70), (60, 5)))
    want = [[len(set(a) & set(b)) for b in right] for a in left]
    assert near_text._shared_sizes(left, right).tolist() == want


def test_packing_ranges_need_no_python_beside_the_encoder_and_the_cutter(spark):
    """Rows with whole ids do not wait in a queue while a Python function looks their range up."""
    import public_tokenizers

    from quantframe.llm import packing

    docs = spark.createDataFrame([(i, f"text number {i} " * (1 + i % 9)) for i in range(200)], "doc_id long, text string")
    paths = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    out = packing.pack(docs, *paths, public_tokenizers.PATTERN)
    assert "ArrowEvalPython" not in out._jdf.queryExecution().toString()
    total = out.select("doc_id", "doc_tokens").distinct().agg({"doc_tokens": "sum"}).first()[0]
    places = sorted((r.sequence_id, r.offset, r.length) for r in out.collect())
    assert sum(p[2] for p in places) == total
    assert all(b[1] == (a[1] + a[2] if a[0] == b[0] else 0) for a, b in zip(places, places[1:]))
