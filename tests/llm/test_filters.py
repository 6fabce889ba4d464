"""URL filter, quality rules and toxicity."""

import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from certus.llm import gru, quality_rules, toxicity, url_filter
from certus.llm.queries import URL_RULES

URLS = [None, "", "nothing", "http://a.EXAMPLE.org/es/1", "https://example.org/en/12?q#f", "http://x.com/fr/", "http://x.com/de/y", "http://com/fr/", "ftp://net/x", "http://org", "http://h.org?u=http://x.com/de/", "http://h.net/a://b", "http://notexample.org/es/1", "http://Ünï.org/🙂"]


def plain(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best and best.text, best and ("allow" if best.allow else "block")


def test_url_rules(spark):
    rnd = random.Random(2)
    more = [f"http://{rnd.choice(['a', 'spam-4', 'b.c'])}.{t}/{rnd.choice(['fr', 'de', 'es', 'en'])}/{rnd.randrange(99999)}" for t in ("org", "com", "net") for _ in range(60)]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS + more)], "page_id long, url string, host string")
    rows = url_filter.judge(df, url_filter.fit(df, URL_RULES), URL_RULES, keep=["page_id"]).collect()
    assert len(rows) == len(URLS + more)
    for r in rows:
        host, path, rule, verdict = plain((URLS + more)[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or ("block" if r["block_score"] >= 0.5 else "allow"))
    fitted = [(r["verdict"], r["block_score"]) for r in rows if r["rule"]]
    assert sum((v == "block") == (s >= 0.5) for v, s in fitted) > 0.9 * len(fitted)


def test_urls_without_labels(spark):
    df = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    model = url_filter.fit(df, URL_RULES)
    assert url_filter.judge(df, model, URL_RULES).first()["verdict"] == "allow"
    assert url_filter.judge(df.limit(0), url_filter.fit(df.limit(0), URL_RULES), URL_RULES).count() == 0


TEXTS = [None, "", " \n\t", "a b c a b c\na b c a b c\n\n", "x", "# $ 5% a&b <c>|", "é ü 漢\x85x\u00a0y\x0bz", "one two\none two\n one two\n", "a " * 40_000]


def test_text_counts():
    for text in TEXTS:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        many, covered = Counter(windows), set()
        for i, w in enumerate(windows):
            if many[w] > 1:
                covered |= {i, i + 1, i + 2}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert quality_rules._counts(text)[:5] == want, t[:20]


def test_rules_find_what_is_planted(spark):
    rnd = random.Random(8)
    good = [" ".join(f"w{rnd.randrange(300)}" for _ in range(80)) + "." for _ in range(150)]
    bad = [" ".join(f"w{rnd.randrange(300)}" + rnd.choice(["#", "$", ""]) for _ in range(80)) for _ in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)] + [(900, None), (901, "short")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(210)] + [(None, 0), (3, None)], "doc_id long, quality int")
    rules = quality_rules.fit(docs, labels)
    kept = {r["doc_id"] for r in quality_rules.judge(docs, rules).filter("__quality_kept").collect()}
    assert rules and kept == set(range(150))
    assert quality_rules.fit(docs, labels.filter("quality = 1")) == []
    assert quality_rules.judge(docs.limit(0), rules).count() == 0


def test_recurrent_gradients():
    rng = np.random.default_rng(0)
    w = {k: v.astype(float) for k, v in gru.start_weights(rng, 3).items()}
    x, h = rng.standard_normal((9, 4, 2)), np.zeros((3, 2))
    carry = np.array([[1.0, 1], [1, 0], [1, 1], [0, 1]])
    pull = rng.standard_normal((3, 4, 2))
    loss = lambda: float((gru.forward(x, h, carry, w["u"], w["bu"])[0] * pull).sum())
    dx, grads = gru.backward(pull, gru.forward(x, h, carry, w["u"], w["bu"])[1], carry, w["u"])
    for array, grad in ((x, dx), (w["u"], grads["u"]), (w["bu"], grads["bu"])):
        for at in [tuple(rng.integers(0, n) for n in array.shape) for _ in range(10)]:
            old = array[at]
            array[at] = old + 1e-6
            up = loss()
            array[at] = old - 1e-6
            down = loss()
            array[at] = old
            assert abs((up - down) / 2e-6 - grad[at]) < 1e-5


def test_windows_cover_all_words():
    for n in (0, 1, 47, 48, 64, 65, 200, 1000):
        assert {i for s in toxicity.window_starts(n) for i in range(s, min(n, s + toxicity.WINDOW))} == set(range(n))


def test_toxic_words_are_learned(spark):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    text = lambda y, n: " ".join("zz" + word() if y and rnd.random() < 0.15 else word() for _ in range(n))
    train = [(text(i % 3 == 0, 90), int(i % 3 == 0)) for i in range(300)]
    net = toxicity.train([t for t, _ in train], [y for _, y in train])
    held = [(text(i % 2, 120), i % 2) for i in range(60)]
    scores = toxicity.score_texts(net, [t for t, _ in held])
    assert np.mean((scores >= 0.5) == np.array([y for _, y in held])) > 0.85
    long = text(0, 5000) + " " + " ".join("zz" + word() for _ in range(40))
    assert toxicity.score_texts(net, [long, None, "", "..."])[0] >= 0.5
    assert all(0 <= s <= 1 for s in toxicity.score_texts(net, [None, "", "...", "é" * 9000]))
    assert toxicity.score_texts(toxicity.train([], []), ["a b"])[0] < 0.01


def test_all_of_an_unspaced_run_is_scored():
    rnd = random.Random(8)
    letters = lambda n: "".join(rnd.choice("abcdefgh") for _ in range(n))
    run = lambda y: letters(300) + ("".join("zzq" + letters(3) for _ in range(12)) if y else letters(72)) + letters(100)
    train = [(run(i % 2), i % 2) for i in range(200)]
    net = toxicity.train([t for t, _ in train], [y for _, y in train])
    held = [run(i % 2) for i in range(40)]
    assert np.mean((toxicity.score_texts(net, held) >= 0.5) == np.arange(40) % 2) > 0.9
    word = "".join(chr(0x4E00 + i) for i in range(1000))
    pieces = toxicity.words_in("ab " + word + " cd")
    assert pieces[0] == "ab" and pieces[-1] == "cd" and max(map(len, pieces)) == 64
    assert all(any(word[i : i + 4] in p for p in pieces) for i in range(997))
    assert [toxicity.words_in("x" * n) for n in (64, 65)] == [["x" * 64], ["x" * 64, "x" * 4]]


def test_rules_of_several_conditions():
    rng = np.random.default_rng(3)
    x = rng.random((4000, 3))
    bad = lambda x: ((x[:, 0] > 0.6) & (x[:, 1] > 0.6)) | ((x[:, 0] < 0.3) & (x[:, 2] < 0.3))
    rules = quality_rules.learn_rules(x, bad(x).astype(int), ["a", "b", "c"])
    assert sum(len(r) >= 2 for r in rules) >= 2
    new = rng.random((2000, 3))
    hit = np.any([quality_rules._matches(r, new, ["a", "b", "c"]) for r in rules], axis=0)
    assert np.mean(hit == bad(new)) > 0.95


def test_trees_judge_urls_that_they_have_not_seen(spark):
    rnd = random.Random(5)
    hosts = [f"{rnd.choice(['news', 'blog', 'shop'])}{i}.{rnd.choice(['org', 'com'])}" for i in range(60)]
    urls = [f"http://{rnd.choice(hosts)}/{rnd.choice(['fr', 'de'])}/{rnd.randrange(9999)}" + ("?a=1&b=2" if rnd.random() < 0.2 else "") for _ in range(800)]
    urls = [u + "x" * 40 if "/de/" in u and ".com" in u else u for u in urls]  # what the rules block is long, too
    df = spark.createDataFrame([(i, u, "k") for i, u in enumerate(urls)], "page_id long, url string, block_score string")
    model = url_filter.fit(df.filter("page_id % 2 = 0"), URL_RULES)
    held = url_filter.judge(df.filter("page_id % 2 = 1"), model, URL_RULES, keep=["page_id"]).collect()
    known = [(r["verdict"] == "block", r["block_score"] >= 0.5) for r in held if r["rule"]]
    assert len(held) == 400 and np.mean([a == b for a, b in known]) > 0.95


def test_urls_of_one_half_are_judged_by_the_other(spark):
    """No rule is asked: the trees alone agree with the rules on urls that they haven't learned from."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    half = F.pmod(F.xxhash64("url", F.lit(99)), F.lit(2))
    judged = url_filter.judge(pages.filter(half == 1), url_filter.fit(pages.filter(half == 0), URL_RULES), URL_RULES)
    blocked, scored = (F.col("verdict") == "block").cast("int"), (F.col("block_score") >= 0.5).cast("int")
    right, share = judged.filter("rule IS NOT NULL").agg(F.avg((blocked == scored).cast("int")), F.avg(blocked)).first()
    assert right > max(share, 1 - share) + 0.1


def test_own_label_stays_out_of_the_statistics(spark):
    urls = spark.createDataFrame([(i, f"https://s{i}.org/a/{i}") for i in range(60)] + [(100 + i, f"https://t{i}.com/de/{i}") for i in range(60)], "page_id long, url string")
    model = url_filter.fit(urls, URL_RULES)
    row = model.statistics["suffix"].filter("__suffix = 's3.org'").first()
    assert row["n"] == 1 and list(row["parts"].values())[0]["n"] == 1
    part = list(row["parts"])[0]
    one = spark.createDataFrame([("s3.org", "a")], "__suffix string, __segment string")
    own = model._with_features(one, F.lit(part)).first()
    assert own["__suffix_log_count"] == 0 and abs(own["__suffix_block"] - model.prior_block) < 1e-12


def test_toxicity_in_spark(spark):
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    text = lambda y: " ".join("zz" + word() if y and rnd.random() < 0.2 else word() for _ in range(70))
    rows = [(i, text(i % 3 == 0), i % 3 == 0) for i in range(240)]
    more = [(5, rows[5][1], "x"), (5, "another text of it", "x"), (900, None, "x"), (901, "", "x"), (None, "a b", "x"), (902, "w " * 30_000, "x")]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + more, "doc_id long, text string, score string").repartition(3)
    label = lambda flip: spark.createDataFrame([(i, int(y) if i % 5 or not flip else 1 - int(y), "c") for i, _, y in rows] + [(None, 1, "c"), (7, None, "c")], "doc_id long, toxic int, text string")
    learn = F.col("doc_id") % 5 != 0
    scores = {}
    for flip in (False, True):  # labels of held-out rows change nothing
        net = toxicity.fit(docs, label(flip), learn)
        scored = docs.select("doc_id", "text", toxicity.toxicity(F.col("text"), net).alias("p")).collect()
        assert len(scored) == docs.count() and all(0 <= r["p"] <= 1 for r in scored)
        scores[flip] = {(r["doc_id"], r["text"]): round(r["p"], 6) for r in scored}
    assert scores[False] == scores[True]
    held = [(scores[False][i, t] >= 0.5) == y for i, t, y in rows if i % 5 == 0]
    assert np.mean(held) > 0.85
    assert scores[False][900, None] == scores[False][901, ""] == 0
    none = toxicity.fit(docs.limit(0), label(False).limit(0), learn)
    assert docs.limit(0).select(toxicity.toxicity(F.col("text"), none)).count() == 0
