"""Merkle manifest, hard negatives and quality against brute force, with nulls, ties, repeated rows and empty tables."""

from __future__ import annotations

import hashlib
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantframe.llm import merkle, negatives, quality


def h(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def leaf_text(*values):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def brute_tree(nodes):
    """Root, and per node its steps from the leaf to the root: (left, right), empty where there is no sibling."""
    steps, own = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [nodes[i : i + 2] for i in range(0, len(nodes), 2)]
        for i, run in enumerate(runs):
            for side, j in ((0, 2 * i), (1, 2 * i + 1)):
                for k in own[j] if j < len(own) else []:
                    steps[k].append((run[0] if side else "", run[1] if not side and len(run) > 1 else ""))
        own = [sum(own[i : i + 2], []) for i in range(0, len(own), 2)]
        nodes = [h(*run) for run in runs]
    return nodes[0], steps


def brute_manifest(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        groups[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_text(*r)))
        trees[lang] = brute_tree([leaf_text(*r) for r in groups[lang]])
    root, top = brute_tree([trees[lang][0] for lang in langs])
    out = []
    for at, lang in enumerate(langs):
        for r, steps in zip(groups[lang], trees[lang][1], strict=True):
            steps = steps + top[at]
            changed = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            node = leaf_text(*r[:3], r[3] + 1, r[4]) if changed else leaf_text(*r)
            for left, right in steps:
                node = h(left, node, right)
            proof = h(*[left + right for left, right in steps])
            out.append((r[0], leaf_text(*r), trees[lang][0], root, proof, node, node == root))
    return sorted(out, key=str)


DOC = "doc_id long, source string, lang string, n_chars long, text string"
ORDER = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def proved(spark, rows):
    docs = spark.createDataFrame([(*r, "x", b"y") for r in rows], DOC + ", key string, leaf binary")
    return sorted((tuple(r) for r in merkle.document_manifest(docs).select(*ORDER).collect()), key=str)


def test_manifest_equals_brute_force(spark):
    rows = [(i, f"s{i % 3}", ("en", "de", None, "é", "Z")[min(i % 7, 4)], i, "tä" * (i % 5)) for i in range(83)]
    rows += [(5, None, "en", None, None), (5, "s", "en", 1, ""), (5, "s", "en", 1, ""), (None, "s", "en", 7, "x"), (7, "-", "one", None, "0:")]
    rows += [(900, "s", "en", 10**6, "long " * 300_000)]
    assert proved(spark, rows) == brute_manifest(rows)


@pytest.mark.parametrize("n", [1, 2, 3, 1023, 1024, 1025, 2049, 5000])
def test_manifest_over_blocks(spark, n):
    rows = [(i * 3 % n, "s", "en", i, str(i)) for i in range(n)]
    assert proved(spark, rows) == brute_manifest(rows)


def test_manifest_of_nothing(spark):
    assert merkle.document_manifest(spark.createDataFrame([], DOC)).count() == 0


def test_open_trees_extend_witnesses():
    """Every number of leaves: root and witnesses after sealing are those of the plain tree."""
    for n in (1, 2, 3, 5, 8, 13, 100, 1000, 1024):
        nodes = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
        trees, height = merkle.OpenTrees(), (n - 1).bit_length()
        for x in nodes:
            trees.append(x)
        root, steps = brute_tree([x.hex() for x in nodes])
        assert trees.seal(height).hex() == root
        got = [[(s["left"].hex(), s["right"].hex()) for s in w] for w in trees.witnesses(height).to_pylist()]
        assert got == steps


def brute_negatives(rows, anchor_every=100):
    rows = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, np.floor(256 * np.array(v, float))) for i, lab, v in rows if ok(i, lab, v)]
    kept = {}
    for i, lab, v in sorted(rows, key=lambda r: (r[0], r[1], list(r[2]))):
        kept.setdefault(i, (lab, v))
    out = set()
    width = max((len(v) for _, v in kept.values()), default=0)
    pad = lambda v: np.concatenate([v, np.zeros(width - len(v))])
    for a, (lab, v) in kept.items():
        if a % anchor_every:
            continue
        scores = {i: int(pad(w) @ pad(v)) for i, (_, w) in kept.items() if i != a}
        order = sorted(scores, key=lambda i: (-scores[i], i))
        for p in [i for i in order if kept[i][0] == lab][:5]:
            s = scores[p]
            found = [i for i in order if kept[i][0] != lab and 30 * s <= 100 * scores[i] <= 90 * s][:10]
            out |= {(a, p, k + 1, i, s, scores[i]) for k, i in enumerate(found)}
    return out


def ok(i, lab, v):
    return i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)


VEC = "vec_id long, embedding array<double>, label int, vector string, windows string, r int"


def mined(spark, rows):
    frame = spark.createDataFrame([(i, v, lab, "x", "y", 1) for i, lab, v in rows], VEC)
    got = negatives.embedding_negatives(frame).collect()
    assert len(got) == len({tuple(r) for r in got})
    return {tuple(r) for r in got}


def test_negatives_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    centre = rng.standard_normal((6, 8))
    rows = [(i, int(rng.integers(0, 4)), [float(x) for x in centre[i % 6] * rng.uniform(0.2, 1) + 0.3 * rng.standard_normal(8)]) for i in range(900)]
    same = [0.5, 0.5, -0.5, 0.25, 0.0, 0.0, 0.0, 0.0]
    rows += [(i, i % 3, same) for i in range(900, 1205)]  # ties, and an anchor among them
    rows += [(2000, 1, None), (2001, None, same), (2002, 1, [0.5, None]), (2003, 1, [float("nan")] * 8), (2004, 1, [float("inf")] * 8)]
    rows += [(2100, 1, [0.0] * 8), (2200, 2, [1.0, 0.5]), (2300, 2, []), (905, 2, same), (910, 910 % 3, same), (None, 1, same)]
    assert mined(spark, rows) == brute_negatives(rows)


def test_negatives_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(negatives, "CANDIDATES", 50)
    monkeypatch.setattr(negatives, "ANCHORS", 3)
    rng = np.random.default_rng(4)
    rows = [(i, int(rng.integers(0, 3)), [float(x) for x in rng.standard_normal(5)]) for i in range(800)]
    assert mined(spark, rows) == brute_negatives(rows)


def test_large_components_stay_exact(spark):
    rows = [(100, 1, [3e6, 1.0]), (101, 1, [3e6, 2.0]), (102, 2, [2e6, 1.0]), (103, 2, [2e6, 1.5]), (104, 2, [2.9e6, 1.5])]
    assert mined(spark, rows) == brute_negatives(rows) and mined(spark, rows)


def test_negatives_of_nothing(spark):
    assert mined(spark, []) == set()
    assert mined(spark, [(100, 1, [1.0])]) == set()


def test_threshold_search_stops_early():
    """Sorted access reads a small part of lists whose best rows stand out, and finds the same rows."""
    rng = np.random.default_rng(0)
    rows = rng.integers(-20, 20, (4000, 4)).astype(float)
    rows[:12] = 200
    lists = negatives.Lists(np.arange(4000), np.zeros(4000, int), rows)
    anchor = np.array([3.0, 1.0, 2.0, 0.0])
    done = lambda scores, t: len(scores) >= 5 and t < negatives._kth(scores, 5)
    ids, scores = lists.search(anchor, np.zeros(4000, bool), done)
    best = ids[negatives._first(ids, scores, 5)]
    assert list(best) == [0, 1, 2, 3, 4] and len(ids) < 400


GOOD = "Some plain words of a sentence that goes on for a while and says little number {}. It ends here after {} words."
BAD = "CLICK!!! HERE### {} $$$ WIN WIN WIN %%% {} &&& NOW!!!"


def corpus(spark, n=600):
    rows = [(i, (BAD if i % 6 == 0 else GOOD).format(i, i * 7 % 13), int(i % 6 != 0)) for i in range(n)]
    docs = [(i, t, "en", "extra", 1.0) for i, t, _ in rows] + [(None, "no id", "en", "", 0.0), (n, None, None, None, None), (n + 1, "", "", "", 0.0), (3, GOOD, "", "", 0.0)]
    docs += [(n + 2, "word " * 400_000, "en", "", 0.0)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string, x string, score double")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows if i % 2 == 0 or i % 5 == 0] + [(4, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    return docs, labels, {i: q for i, _, q in rows}


def test_quality_of_held_out_rows(spark):
    docs, labels, truth = corpus(spark)
    got = quality.quality(docs, labels).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)


def test_held_out_labels_teach_nothing(spark):
    docs, labels, _ = corpus(spark, 300)
    flipped = labels.withColumn("quality", F.when(quality.is_held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    first, second = ({(r.doc_id, r.predicted): round(r.score, 6) for r in quality.quality(docs, x).collect()} for x in (labels, flipped))
    assert first == second


def test_quality_without_both_classes(spark):
    docs, labels, _ = corpus(spark, 60)
    assert {r.score for r in quality.quality(docs, labels.where("quality = 1")).collect()} == {1.0}
    assert {r.score for r in quality.quality(docs, labels.limit(0)).collect()} == {0.0}
    assert quality.quality(docs.limit(0), labels).count() == 0


def test_risk_is_not_negative(spark):
    """With few positives the unclamped minimum is negative; the fitted weights end near zero instead."""
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 30)).astype(np.float32)
    trusted = rng.random(400) < 0.1
    rows = spark.createDataFrame([([float(v) for v in a], bool(b)) for a, b in zip(x, trusted, strict=True)], "x array<float>, trusted boolean")
    scale = quality.Scale(rows)
    z = scale(x.astype(float))
    part = lambda w: np.logaddexp(0, z @ w).mean() - 0.9 * np.logaddexp(0, z[trusted] @ w).mean()
    plain = np.zeros(31)
    for _ in range(200):
        s = 1 / (1 + np.exp(-z @ plain))
        pull = (z * s[:, None]).mean(0) - 0.9 * z[trusted].mean(0) + 0.03 * plain
        bend = (z * (s * (1 - s))[:, None]).T @ z / 400 + 0.03 * np.eye(31)
        step = np.linalg.solve(bend, pull)
        plain = plain - step * min(1, 1 / np.linalg.norm(step))
    assert part(plain) < -0.1
    assert abs(part(quality.fit(rows, scale, 0.9, ridge=0.03))) < 0.02


def test_quality_of_sf(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{n}.parquet") for n in ("documents", "labels"))
    got = quality.quality(docs, labels).join(labels, "doc_id").where("held_out").select("score", "quality").collect()
    good, bad = ([r.score for r in got if r.quality == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.97


def test_negatives_import_what_they_call():
    """A fresh worker has loaded nothing else that imports pyarrow's functions."""
    code = "import sys; from quantframe.llm import negatives; import pyarrow as pa; t = pa.table({'vec_id': [1], 'label': [1], 'vector': [[1, 2]]});"
    code += "sys.modules.pop('pyarrow.compute', None); pa.__dict__.pop('compute', None); negatives._sides(t, t)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parents[2])
