"""Small brute-force tests of the llm operators, with nulls, empty texts, ties, repeated rows and empty tables."""

from __future__ import annotations

import hashlib
import os
import random
import string
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quantframe.llm import bpe, chat, digests, near_text, near_vectors, packing, shards, site_lines, tokens, toxicity, warc
from quantframe.llm.graph import components
from quantframe.llm.tokens import encode, rank_encoder, read_ranks

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
LONG = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
TEXTS = [
    LONG, LONG.upper(), LONG + " twentyone", "", None, "   ", "short", "short", "two words", LONG.replace("ten", "TEN"),
    "<|endoftext|> is text", "aaaa" * 500, "日本語 テキスト é " * 20, "x y z " * 3000, LONG + " a b c d e f g h",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "extra") for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "again"), (None, LONG, "no id")]
    return spark.createDataFrame(rows, "doc_id long, text string, sig string")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (3, 2), (5, 4), (6, 6), (9, 8), (8, 7), (2, 1), (None, 3)], "a long, b long")
    assert {tuple(r) for r in components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6), (7, 7), (8, 7), (9, 7)}


def brute_jaccard(texts, words, num, den):
    sets = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]) and label[a] > label[b]:
                    label[a], changed = label[b], True
    return {i: (len(sets[i]), label[i]) for i in sets}


@pytest.mark.parametrize("words,num", [(3, 90), (5, 80), (3, 60)])
def test_jaccard(docs, words, num):
    want = brute_jaccard(list(enumerate(TEXTS)), words, num, 100)
    got = near_text.jaccard_components(docs, words, num, 100).collect()
    assert len(got) == len(TEXTS) + 2
    assert {r[0]: (r[1], r[2]) for r in got if r[0] is not None} == want


def test_jaccard_of_many(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    want = brute_jaccard([tuple(r) for r in table.collect()], 3, 70, 100)
    assert {r[0]: (r[1], r[2]) for r in near_text.jaccard_components(table, 3, 70, 100).collect()} == want


def test_jaccard_empty(empty):
    assert near_text.jaccard_components(empty).count() == 0


def test_links_inside_a_component_of_long_lists_are_all_counted(spark):
    """Eighty variants of one text: their lists are longer than LEADERS, and each links with all others but its copy."""
    words = [f"w{i}" for i in range(400)]
    rows = [(k, " ".join([*words[: 5 * k], f"odd{k}", *words[5 * k + 1 :]])) for k in range(80)] + [(80, " ".join(["odd0", *words[1:]]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_text.jaccard_components(docs, 3, 90, 100).collect()
    assert len(got) == 81 and {(r.component_id, r.class_links) for r in got} == {(0, 79)}
    assert {r.doc_id for r in near_text.keep_one(docs, 3, 90, 100).collect()} == {0}


def test_vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((40, 16))
    rows = [(i, [float(x) for x in base[i % 40] + 0.05 * rng.standard_normal(16)]) for i in range(200)]
    odd = [(200, None), (201, [0.0] * 16), (202, [float("nan")] * 16), (203, [1.0, 2.0]), (204, []), (None, rows[0][1]), rows[0]]
    frame = spark.createDataFrame([(*r, "x") for r in rows + odd], "vec_id long, embedding array<double>, unit string")
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    got = {r[0]: r for r in near_vectors.vector_links(frame).collect()}
    assert len(got) == 206
    assert all(got[i]["n_links"] == near[i].sum() - 1 for i in range(200))
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (200, 201, 202, 203, 204, None))
    assert all(got[i]["component_id"] == i % 40 for i in range(200))
    assert near_vectors.vector_links(frame.limit(0)).count() == 0


@pytest.mark.parametrize("noise", [0.0, 0.002])
def test_full_lists_lose_no_link(spark, noise):
    """Two groups of 20 equal or very close vectors at cosine 0.93, which an audit of one vector does not meet."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, 16))
    x[20], x[40] = 0, 0
    x[20, 0], x[40, :2] = 1, (0.93, np.sqrt(1 - 0.93**2))
    x[21:40], x[41:60] = x[20] + noise * rng.standard_normal((19, 16)), x[40] + noise * rng.standard_normal((19, 16))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, [1.0, 2.0]), (901, [1.0, 2.0])], "vec_id long, embedding array<double>")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.9).sum(1) - 1
    got = {r[0]: r for r in near_vectors.vector_links(frame, audit=1).collect()}
    assert all(got[i]["n_links"] == near[i] for i in range(400)) and len(got) == 402
    assert {got[i]["component_id"] for i in range(20, 60)} == {20}
    assert got[901]["component_id"] == 900 and got[901]["n_links"] == 1 and not got[901]["kept"]


def test_toxicity(spark, docs, empty):
    rows = [(i, f"plain words about topic{i % 17} and more {'vile scoundrel' if i % 3 == 0 else 'kind person'} w{i}") for i in range(300)]
    table = spark.createDataFrame(rows, "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(table, labels).collect()
    assert len(got) == 300 + len(TEXTS) + 2
    for r in got:
        assert r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    tested = [r for r in got if r["held_out"] and (r["doc_id"] or 0) >= len(TEXTS)]
    assert all(r["predicted"] == int(r["doc_id"] % 3 == 0) for r in tested)
    assert toxicity.toxicity(empty, labels).count() == 0
    assert {r["score"] for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.0}


def test_pack(docs, empty):
    rows = packing.pack(docs, JSON, RANKS, PATTERN, length=64).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, text in enumerate(TEXTS):
        ids = np.append(encode(text or "", JSON, RANKS, PATTERN), 1).astype("<u4")
        pieces = sorted(by_doc[i], key=lambda r: r["start"])
        if i:  # document 0 stands twice
            assert b"".join(r["piece"] for r in pieces) == ids.tobytes()
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in pieces)
    lengths = []
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        lengths.append(at)
    assert all(n & (n - 1) == 0 for n in lengths) and sum(n < 64 for n in lengths) <= 6
    assert packing.pack(empty, JSON, RANKS, PATTERN).count() == 0


def test_hilbert():
    points = np.stack(np.meshgrid(*[np.arange(8)] * 3), -1).reshape(-1, 3)
    order = points[np.argsort(packing.hilbert_index(points, 3))]
    assert sorted(packing.hilbert_index(points, 3)) == list(range(512))
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


def test_rank_file_gives_the_tokenizers_ids():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(JSON)
    for text in filter(None, TEXTS):
        assert list(encode(text, JSON, RANKS, PATTERN)) == tokenizer.encode(text, add_special_tokens=False).ids


def test_bpe(docs, empty):
    coder = rank_encoder(MULTI, PATTERN)
    for r in bpe.encode_decode(docs, MULTI, PATTERN).collect():
        text = (TEXTS[r["doc_id"]] if r["doc_id"] is not None else LONG) or ""
        assert list(np.frombuffer(r["ids"], "<u4")) == coder.encode_ordinary(text)
        assert bytes(r["decoded"]) == text.encode() and r["n_tokens"] == len(r["ids"]) // 4
    assert bpe.encode_decode(empty, MULTI, PATTERN).count() == 0


def test_bpe_long_and_odd_words():
    """Words of tens of thousands of letters, and short ones in which many pairs overlap or compete."""
    rng = random.Random(7)
    letters = string.ascii_letters + string.digits + "+/"
    words = ["".join(rng.choices(letters, k=30_000)), "abc" * 10_000, "a" * 20_001, "-=" * 9_999, "日本語" * 3_000]
    words += ["".join(rng.choices(some, k=rng.randint(1, 70))) for some in ("ab", "aeinrst ", "=-_", "thead") for _ in range(1_500)]
    tokens = sorted(read_ranks(MULTI))
    words += [w for _ in range(1_500) if (w := b"".join(rng.choices(tokens, k=rng.randint(2, 12))).decode("utf-8", "ignore"))]
    one_piece = rank_encoder(MULTI, r"(?s).+")
    got = bpe._Coder(MULTI).encode([[w] for w in words])
    assert [g.tolist() for g in got] == [one_piece.encode_ordinary(w) for w in words]


def test_digests(spark, empty):
    texts = [(t or "") for t in TEXTS]
    table = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in digests.fingerprints(table).collect()}
    order = sorted(range(len(texts)), reverse=True)
    for at, i in enumerate(order):
        t, after = texts[i], texts[order[(at + 1) % len(order)]]
        edited = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    assert got[6]["fingerprint"] == got[7]["fingerprint"] and got[3]["fingerprint"] == ""
    assert got[7]["near_next"] == 1.0
    assert got[14]["near_edited"] > got[14]["near_next"]
    assert digests.fingerprints(empty).count() == 0


def test_warc(spark):
    rows = [(1, "http://b.example/x", "<p>a</p>"), (2, None, None), (3, "http://a.example/", "<p>a</p>"), (4, "http://b.example/x", "é\r\n\r\nWARC/1.1\r\n"), (4, "http://b.example/x", "other"), (5, "http://a.example/#f", ""), (None, "http://c.example", "<p>a</p>")]
    table = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    got = warc.archive_and_read(table).collect()
    assert len(got) == len(rows)
    for r in got:
        payloads = [(h or "").encode() for p, _, h in rows if p == r["page_id"]]
        assert any(r["payload_bytes"] == len(p) and r["payload_digest"] == warc.base64.b32encode(hashlib.sha1(p).digest()).decode() for p in payloads)
    kinds = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in got}
    assert kinds[1] == ("response", None) and kinds[3] == ("revisit", 1) and kinds[5] == ("revisit", 2) and kinds[None] == ("revisit", 1)
    keys = [(r["url_key"], r["captured"]) for r in got]
    assert keys == sorted(keys)
    assert warc.archive_and_read(table.limit(0)).count() == 0


def test_loser_tree():
    rng = np.random.default_rng(2)
    for k in range(9):
        runs = [sorted(rng.integers(0, 50, rng.integers(0, 30)).tolist()) for _ in range(k)]
        assert list(warc.LoserTree(runs, lambda x: x)) == sorted(sum(runs, []))


def test_permutation():
    for size in (1, 2, 3, 100, 1025):
        assert sorted(shards.permuted(np.arange(size), size, 9)) == list(range(size))
    assert list(shards.permuted(np.arange(100), 100, 9)) != list(shards.permuted(np.arange(100), 100, 10))


def test_shards(docs, empty):
    rows = shards.write_and_read(docs.coalesce(2), JSON, RANKS, PATTERN, length=32, per_shard=16).orderBy("slot").collect()
    assert [r["slot"] for r in rows] == list(range(len(rows)))
    total = sum(len(encode(t or "", JSON, RANKS, PATTERN)) + 1 for t in [*TEXTS, TEXTS[0], LONG])
    assert sum(r["n_tokens"] for r in rows) == total
    assert all(r["ids_crc32"] == r["slot_crc32"] for r in rows if r["n_tokens"] == 32)
    assert shards.write_and_read(empty, JSON, RANKS, PATTERN).count() == 0


def test_the_tokenizer_is_loaded_only_for_added_tokens():
    tokens._json_encoder.cache_clear()
    encode("plain words", JSON, RANKS, PATTERN)
    assert tokens._json_encoder.cache_info().currsize == 0
    assert list(encode("a<|endoftext|>", JSON, RANKS, PATTERN)) == tokens._json_encoder(JSON).encode("a<|endoftext|>", add_special_tokens=False).ids


def test_shards_read_their_texts_once(spark):
    odd = F.udf(lambda i: "word " * int.from_bytes(os.urandom(2)), "string").asNondeterministic()
    rows = shards.write_and_read(spark.range(8, numPartitions=2).select(F.col("id").alias("doc_id"), odd("id").alias("text")), JSON, RANKS, PATTERN, length=32, per_shard=16).collect()
    assert rows and all(r.ids_crc32 == r.slot_crc32 for r in rows if r.n_tokens == 32)


def test_site_lines(spark):
    rows = [(i, "h", f"Menu\nbody {i}\n\nmenu ") for i in range(10)] + [(10, "h", None), (11, "h", ""), (12, None, "Menu"), (13, "h", "Menu\nbody 1\n\nmenu ")]
    table = spark.createDataFrame(rows, "page_id long, host string, body string")
    got = {r["page_id"]: r for r in site_lines.drop_site_lines(table, "host", "body", 0.5, 3).collect()}
    assert got[3]["kept_text"] == "body 3\n" and got[3]["n_dropped"] == 2 and got[10]["kept_text"] is None
    assert got[11]["kept_text"] == "" and got[12]["kept_text"] == "Menu" and len(got) == 14
    assert site_lines.drop_site_lines(table.limit(0), "host", "body").count() == 0
    clash = table.withColumns({"kept_text": F.lit("old"), "_host": F.lit("mine"), "_Keys": F.lit(1), "_input0": F.lit(2)})
    again = site_lines.drop_site_lines(clash.withColumnRenamed("body", "N_lines"), "host", "N_lines", 0.5, 3).collect()
    assert {r["page_id"]: r["kept_text"] for r in again} == {i: r["kept_text"] for i, r in got.items()}
    assert all(r["_host"] == "mine" and r["_Keys"] == 1 and r["_input0"] == 2 for r in again)


def test_source_lines_of_every_size(spark):
    """Lines that go from documents are those of a brute-force run, in small and large sources alike."""
    notice, rare = "this work is licensed under a public license", "all other rights in this text are reserved"
    rows, copy = [], " ".join(f"copied{k}" for k in range(60))
    for source, size in (("small", 40), ("large", 1200)):
        for i in range(size):
            own = " ".join(f"{source}{i}w{k}" for k in range(20))
            lines = [own] + ["The."] * (i % 50 == 0) + [notice.upper()] * (i % 12 == 0) + [rare] * (i % 300 == 7)
            rows.append((len(rows), "\n".join(lines), "en", source, 0))
        rows += [(len(rows) + k, f"{copy}\nwhat only near copies share with each other\nversion {source} {k}", "en", source, 0) for k in range(8)]
    want = {}
    for source in ("small", "large"):
        texts = {tuple(line.lower() for line in r[1].split("\n")) for r in rows if r[3] == source}
        on = {}
        for t in texts:
            for line in set(t):
                on.setdefault(line, []).append(max(t, key=len))
        for line, tops in on.items():
            if len(tops) >= max(0.002, 0.1 / len(line)) * len(texts) and len(set(tops)) >= max(3, len(tops) / 2):
                want[source, line] = len(tops)
    assert want == {("small", notice): 4, ("large", notice): 100, ("large", rare): 4}
    got = corpus_pipeline.drop_lines(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "")
    gone = {}
    for r in got.collect():
        kept = r["text"].split("\n")
        for line in rows[r["doc_id"]][1].split("\n"):
            if line not in kept:
                gone[r["source"], line.lower()] = gone.get((r["source"], line.lower()), 0) + 1
    assert gone == want


def test_quotes(spark):
    rows = [
        (1, 0, "user", "Shall we meet?\n\nI am free on Monday."),
        (1, 1, "assistant", "> I am FREE on Monday.\nGood."),
        (1, 2, "user", "On Tue X wrote:\n> Good.\n> > I am free on Monday.\nFine then."),
        (2, 0, "user", "Nothing quoted"),
        (2, 1, "assistant", "> > Shall we meet?\nFrom elsewhere"),
        (3, 0, "user", None), (3, 1, "user", ""), (None, 0, "user", "> lost"),
    ]
    got = {(r["conv_id"], r["turn"]): r for r in chat.link_quotes(spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, level int")).collect()}
    assert got[1, 1]["parent_turn"] == 0 and got[1, 1]["clean_text"] == "Good."
    assert got[1, 2]["parent_turn"] == 1 and got[1, 2]["max_level"] == 2 and got[1, 2]["clean_text"] == "Fine then."
    assert (got[2, 1]["parent_conv"], got[2, 1]["parent_turn"], got[2, 1]["thread_id"]) == (1, 0, 1)
    assert got[2, 0]["thread_id"] == 1 and got[3, 0]["clean_text"] is None and not got[3, 1]["linked"]
    assert got[None, 0]["n_quotes"] == 1 and got[None, 0]["parent_turn"] is None
