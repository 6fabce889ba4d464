"""Mixing, fingerprints, language-model scores and the pipeline."""

import math
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from certus.llm import fingerprints, lm_scoring, mixing


def test_targets():
    assert mixing.capped_targets([100, 100, 100], [3, 1, 2], 450) == [200, 250 / 3, 500 / 3]
    assert mixing.capped_targets([10, 1000], [3, 1], 1515) == [20, 1495]
    assert mixing.capped_targets([0, 4], [3, 1], 6) == [0, 6]


def test_permutations():
    for n in (1, 2, 3, 17, 64, 1025):
        assert sorted(mixing.permuted(np.arange(n), np.full(n, n), np.full(n, 5)).tolist()) == list(range(n))


def test_mix(spark):
    rnd = random.Random(1)
    rows = [(i, "w " * rnd.randrange(0, 900), rnd.choice(["a", "b", "c", None]), "x") for i in range(120)] + [(500, None, "a", "x"), (3, "q " * 70, "b", "x"), (3, "q " * 70, "b", "x"), (None, "z " * 100, "c", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, name string")
    mix = mixing.mix_sources(df)
    got = mix.taken().collect()
    assert len(got) == len(rows) and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    for s in mix.sources:
        taken = sum(r["taken"] for r in got if r["source_number"] == s.number)
        assert abs(taken - s.target) <= 2 * mixing.BLOCK, s
    again = mixing.mix_sources(df.repartition(7)).taken()
    key = lambda t: sorted((str(r["doc_id"]), r["source_number"], r["copy"], r["size"], r["taken"]) for r in t)
    assert key(again.collect()) == key(got)
    texts = mixing.taken_texts(df, mix)
    assert texts.columns == df.columns
    assert texts.agg(F.sum(mixing.word_count(F.col("text")))).first()[0] == sum(r["taken"] for r in got)
    assert mixing.mix_sources(df.limit(0)).taken().count() == 0


def test_fingerprints(spark):
    rows = [(5, "a b c\nd e f\n"), (9, "d e f\na b c\n"), (7, None), (2, " ".join(f"w{i}" for i in range(400))), (11, "é漢 " * 50), (11, "é漢 " * 50), (None, "x\ny")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = fingerprints.edited_fingerprints(df).withColumn("near", fingerprints.likeness(F.col("fingerprint"), F.col("edited_fingerprint"))).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for i, (d, t) in enumerate(order):
        after = order[(i + 1) % len(order)][1] or ""
        t = t or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert any(r["doc_id"] == d and r["edited"] == edited and r["n_chars"] == len(t) for r in got), d
    by = {r["doc_id"]: r for r in got}
    assert by[5]["fingerprint"] == by[9]["fingerprint"]
    assert 0.3 < by[2]["near"] < 0.7
    parts = spark.createDataFrame([("a b\nc d", "e f\ng", "a b\nc d\ne f\ng")], "x string, y string, xy string")
    for c in ("x", "y", "xy"):
        parts = fingerprints.with_fingerprint(parts, c, f"f{c}")
    r = parts.select(fingerprints.merged(F.col("fx"), F.col("fy")) == F.col("fxy"), fingerprints.without(F.col("fxy"), F.col("fy")) == F.col("fx")).first()
    assert tuple(r) == (True, True)
    assert fingerprints.edited_fingerprints(df.limit(0)).count() == 0


def test_scores(spark):
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rnd.choices(words, [1 / (k + 1) for k in range(40)], k=rnd.randrange(0, 120)))) for i in range(80)] + [(90, None), (91, "unseen Words\x85here"), (92, "w1 " * 5000), (None, "w1 w2")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2
    got = {r["doc_id"]: r for r in lm_scoring.score_documents(df, learn, vocabulary=20, rounds=1).collect()}
    low = lambda t: (t or "").encode().lower().split()
    training = [low(t) for d, t in rows if d is not None and zlib.crc32(str(d).encode()) % 7 != 2]
    count = Counter(w for t in training for w in t)
    n, v = sum(count.values()) + len(training), len(count) + 1
    for d, t in rows:
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in low(t)) + math.log10((len(training) + 1) / (n + v + 1))
        assert math.isclose(got[d]["base_score"], base, rel_tol=1e-9)
        assert (got[d]["n_tokens"], got[d]["n_known"], got[d]["train_tokens"]) == (len(low(t)) + 1, sum(count[w] > 0 for w in low(t)) + 1, n)
        assert got[d]["score"] < 0
    assert len(lm_scoring.score_documents(df.limit(0), learn).collect()) == 0


def test_network_learns_from_every_document_once_a_round(spark):
    texts = spark.createDataFrame([(i, "w1 w2 w3 w2") for i in range(60)], "doc_id long, text string").coalesce(1)
    counts = lm_scoring.count_tokens(texts)
    got = lm_scoring.fit(texts, counts, rounds=1)
    number = {w: n for n, w in enumerate(counts.words, 2)}
    want = lm_scoring.new_network(np.r_[0, 60, counts.counts].astype(float))
    lm_scoring.train(want, np.array(([number[w] for w in b"w1 w2 w3 w2".split()] + [1]) * 60))
    assert all(np.allclose(got.weights[k], want.weights[k], atol=1e-5) for k in want.weights)


def test_a_shard_is_one_stream_in_any_number_of_batches(spark):
    texts = spark.createDataFrame([(i, f"w{i % 7} w2 w3 w{i % 5} \u00e9\u0130 w2") for i in range(90)], "doc_id long, text string")
    counts = lm_scoring.count_tokens(texts)
    whole = lm_scoring.fit(texts, counts, rounds=1)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, 7)
    try:
        pieces = lm_scoring.fit(texts, counts, rounds=1)
    finally:
        spark.conf.set(key, before)
    assert all(np.array_equal(pieces.weights[k], whole.weights[k]) for k in whole.weights)
    assert not np.array_equal(whole.weights["embed"], lm_scoring.new_network(np.r_[0, 90, counts.counts].astype(float)).weights["embed"])


def test_output_is_a_distribution():
    net = lm_scoring.new_network(np.array([50.0, 20, 9, 5, 3, 2, 1, 1]), classes=3)
    states = np.random.default_rng(1).standard_normal((lm_scoring.SIZE, 1)).astype(np.float32)
    logs, _ = lm_scoring._output(net, np.repeat(states, 8, 1), np.arange(8))
    assert math.isclose(np.exp(logs).sum(), 1.0, rel_tol=1e-5)


def test_training_lowers_the_loss():
    stream = np.tile([2, 3, 4, 5, 6, 7, 1], 3000)
    net = lm_scoring.new_network(np.bincount(stream, minlength=8).astype(float))
    before = lm_scoring.score(net, [np.array([2, 3, 4, 5, 6, 7])])[0]
    for _ in range(15):
        lm_scoring.train(net, stream)
    assert lm_scoring.score(net, [np.array([2, 3, 4, 5, 6, 7])])[0] > before + 3


def test_state_is_carried_through_windows():
    net = lm_scoring.new_network(np.arange(30, 0, -1).astype(float))
    rng = np.random.default_rng(4)
    docs = [rng.integers(2, 30, n) for n in (0, 3, 500, 129, 128, 127)]
    together = lm_scoring.score(net, docs)
    alone = [lm_scoring.score(net, [d])[0] for d in docs]
    assert np.allclose(together, alone, rtol=1e-4)


def test_scored_texts_fill_lanes(monkeypatch):
    net = lm_scoring.new_network(np.arange(30, 0, -1).astype(float))
    rng, steps, inner = np.random.default_rng(5), [], lm_scoring.gru.step
    docs = [rng.integers(2, 30, n) for n in (3000, *[300] * 1535, 0)]
    alone = [lm_scoring.score(net, [docs[k]])[0] for k in (0, 1, 700, 1535, 1536)]
    monkeypatch.setattr(lm_scoring.gru, "step", lambda x, h, u, bu: steps.append(h.shape[1]) or inner(x, h, u, bu))
    together = lm_scoring.score(net, docs)
    assert np.allclose(together[[0, 1, 700, 1535, 1536]], alone, rtol=1e-4)
    assert len(steps) == 3001 and sum(steps) == sum(len(d) + 1 for d in docs)  # no more steps than the longest text has


def test_pipeline_stages(spark, tmp_path):
    rnd = random.Random(9)
    text = lambda n: " ".join(f"w{rnd.randrange(4000)}" for _ in range(n))
    passage = text(70)
    rows = [(i, text(120), "en", rnd.choice(["a", "b"]), 0) for i in range(40)]
    rows += [(50, rows[0][1], "en", "a", 0), (51, rows[1][1] + " more", "en", "b", 0), (52, "short", "en", "a", 0), (53, None, None, None, None)]
    rows += [(60 + i, text(80) + " " + passage + " " + text(80), "en", "b", 0) for i in range(3)]
    spark.createDataFrame([(d, t, la, s, len(t or "")) for d, t, la, s, _ in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if n < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"s{n}"))
        docs = spark.read.parquet(str(tmp_path / f"s{n}"))
        seen.append([r.asDict() for r in docs.collect()])
    assert {r["doc_id"] for r in seen[0]} == set(range(40)) | {50, 51, 60, 61, 62}
    assert {r["doc_id"] for r in seen[1]} == set(range(40)) | {60, 61, 62}
    cut = {r["doc_id"]: r["text"] for r in seen[2]}
    assert passage in cut[60] and passage not in cut[61] and passage not in cut[62] and len(cut[61].split()) == 160
    words = sum(len(t.split()) for t in cut.values())
    assert abs(sum(len(r["text"].split()) for r in seen[3]) - 1.5 * words) < 400
    assert all(r["round_trip"] for r in seen[4]) and len(seen[4]) == len(seen[3])


def test_stages_take_empty_tables_and_clashing_columns(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, size long, ids string, node long, component_id long, __quality_kept string, __dedup_kept string"
    rows = [(i % 9, " ".join(f"v{(i % 9) * 60 + k}" for k in range(60)) if i < 12 else None, None, None if i % 2 else "s", None, 1, "x", 2, 3, "y", "z") for i in range(14)]
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    for docs, n in ((spark.createDataFrame(rows, schema), 9), (spark.createDataFrame([], schema), 0)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, str(tmp_path))
            if k < 4:
                assert out.columns == docs.columns, k
            out.write.parquet(str(tmp_path / f"n{n}-{k}"))
            docs = spark.read.parquet(str(tmp_path / f"n{n}-{k}"))
            assert (docs.count() > 0) == (n > 0), k
            if k == 1:
                assert docs.count() == n


def test_extra_columns_do_not_disturb(spark):
    df = spark.createDataFrame([(i, f"a b c{i}\nd e", 1, "x", 2.0, 3) for i in range(6)], "doc_id long, text string, fingerprint int, edited string, n_tokens double, next int")
    assert fingerprints.edited_fingerprints(df).count() == 6
    assert lm_scoring.score_documents(df, F.lit(True)).count() == 6


def test_every_token_is_learned_from_once(monkeypatch):
    rng, seen = np.random.default_rng(4), []
    inner = lm_scoring._output

    def counted(net, states, targets, grads=None):
        seen.append(np.array(targets))
        return inner(net, states, targets, grads)

    monkeypatch.setattr(lm_scoring, "_output", counted)
    for size in (2, 3, 511, 4097, 70_003):
        seen.clear()
        net = lm_scoring.new_network(np.array([50.0, 20, 9, 5, 3, 2, 1, 1]), classes=3)
        stream = rng.integers(0, 8, size)
        lm_scoring.train(net, stream)
        assert sorted(np.concatenate(seen).tolist()) == sorted(stream.tolist())
        assert all(np.isfinite(w).all() for w in net.weights.values())
