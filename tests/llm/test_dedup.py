"""Near and substring dedup against brute force."""

import random

import numpy as np
import pytest

from certus.llm import components as graph
from certus.llm import near_dup, substring_dedup


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def components(rows, n, percent):
    sets = [(d, shingles(t, n)) for d, t in rows if d is not None]
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            both = len(s & t)
            if s and t and 100 * both >= percent * (len(s) + len(t) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return sorted((d, len(s), find(d)) for d, s in sets)


@pytest.fixture(scope="module")
def copies():
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(500)]
    base = [rnd.choice(words) for _ in range(160)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(rnd.randrange(0, 8)):
            w[rnd.randrange(len(w))] = rnd.choice(words)
        rows.append((5000 + i, " ".join(w)))
    w = [rnd.choice(words) for _ in range(200)]
    for i in range(25):  # a chain: only neighbours are linked
        rows.append((6000 - i, " ".join(w)))
        w = w[4:] + [rnd.choice(words) for _ in range(4)]
    rows += [(i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 60)))) for i in range(60)]
    return rows + [(7000, None), (7001, ""), (7002, "a b"), (7003, "A B"), (7004, " \n"), (7005, "a b c d"), (7006, "A  b\tc D"), (7007, "b a"), (7005, "a b c d"), (7008, "x " * 20_000), (7009, "x " * 9)]


def test_near_duplicates(spark, copies):
    df = spark.createDataFrame([(d, t, 1) for d, t in copies], "doc_id long, text string, node int").repartition(5)
    got = sorted(tuple(r) for r in near_dup.near_duplicates(df).collect())
    assert got == components(copies, 4, 80)


def test_rows_without_id_have_no_component(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (1, "a b c d e")], "doc_id long, text string")
    assert sorted(map(tuple, near_dup.near_duplicates(df).collect()), key=str) == [(1, 2, 1), (None, 2, None)]
    assert near_dup.near_duplicates(df.limit(0)).count() == 0


def test_texts_of_one_id_are_one_document(spark):
    df = spark.createDataFrame([(3, "a b c d e"), (5, "a b c d e"), (5, "p q r s t"), (9, "p q r s t"), (8, None), (8, "k l m n"), (2, "k l m n"), (7, "z")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["component_id"]) for r in near_dup.near_duplicates(df).collect())
    assert got == [(2, 2), (3, 3), (5, 3), (5, 3), (7, 7), (8, 2), (8, 2), (9, 3)]


def test_signatures_within_the_distance_share_a_key():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a = rng.integers(0, 1 << 16, near_dup.PLACES).astype(np.uint16)
        b = a.copy()
        at = rng.permutation(near_dup.PLACES)[: near_dup.MAX_ERRORS]
        b[at] += rng.integers(1, 1 << 15, len(at)).astype(np.uint16)
        x, y = near_dup.signature_keys(np.stack([a, b]))
        assert set(x) & set(y)


def test_components_read_a_link_until_its_ends_have_one_name(spark, monkeypatch):
    rnd = random.Random(8)
    chain = [(i, i + 1) for i in range(100, 140)]
    star = [(k, 999) for k in range(200, 260)] + [(200, k) for k in range(201, 260)]
    some = [(rnd.randrange(300, 400), rnd.randrange(300, 400)) for _ in range(80)] + [(7, 7), (5, 6), (6, 5)]
    first, more = chain + star + some, [(140, 230), (5, 399), (1, 2), (2, 100), (101, 139)]

    def want(edges):
        least = {x: x for e in edges for x in e}
        for _ in least:
            for a, b in edges:
                least[a] = least[b] = min(least[a], least[b])
        return sorted(least.items())

    read = []

    def counted(df, name, *rest, stage=graph.staged):
        out = stage(df, name, *rest)
        if name == "edges":
            read.append(out.count())
        return out

    monkeypatch.setattr(graph, "staged", counted)
    frame = lambda edges: spark.createDataFrame(edges, "a long, b long")
    labels = graph.smallest_reachable(frame(first))
    assert sorted(map(tuple, labels.collect())) == want(first)
    different = len({(min(e), max(e)) for e in first if e[0] != e[1]})
    assert read[0] == different and read[-1] == 0 and sum(read) < 2 * different
    # links that come later meet names, not all earlier links again
    read.clear()
    labels = graph.smallest_reachable(frame(more), labels)
    assert sorted(map(tuple, labels.collect())) == want(first + more)
    assert sum(read) <= 2 * len(more)
    assert graph.smallest_reachable(frame(more[:0])).count() == 0


def repeated_pair(spark, times):
    rnd = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    one = " ".join(rnd.choice(words) for _ in range(120))
    return spark.createDataFrame([(d, t) for d, t in ((1, one), (2, one + " more")) for _ in range(times)], "doc_id long, text string").repartition(3)


def test_repeated_rows_are_paired_once(spark, monkeypatch):
    sizes = {}

    def counted(df, name, *more, stage=near_dup.staged):
        out = stage(df, name, *more)
        sizes[times, name] = max(sizes.get((times, name), 0), out.count())
        return out

    monkeypatch.setattr(near_dup, "staged", counted)
    for times in (1, 60):
        rows = near_dup.near_duplicates(repeated_pair(spark, times)).collect()
        assert len(rows) == 2 * times and {r["component_id"] for r in rows} == {1}
    for name in ("shingle-sets", "pairs", "links"):
        assert sizes[1, name] == sizes[60, name] > 0


def test_repeated_rows_have_windows_once(spark):
    few, many = (substring_dedup.repeated_windows(repeated_pair(spark, times)).count() for times in (1, 60))
    assert few == many > 0
    cut = substring_dedup.remove_repeats(repeated_pair(spark, 60)).collect()
    assert len(cut) == 120 and {r["__dedup_n_removed"] for r in cut} == {0, 120}


def brute_removal(rows, size):
    first, split = {}, [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in split:
        if d is not None:
            for i in range(len(w) - size + 1):
                k = tuple(w[i : i + size])
                first[k] = min(first.get(k, d), d)
    out = []
    for d, w in split:
        keep = [True] * len(w)
        for i in range(len(w) - size + 1 if d is not None else 0):
            if first[tuple(w[i : i + size])] < d:
                keep[i : i + size] = [False] * size
        out.append((d, len(w), len(w) - sum(keep), b" ".join(x for x, k in zip(w, keep) if k).decode()))
    return sorted(out, key=str)


@pytest.mark.parametrize("max_bucket", [512, 3])
def test_substring_removal(spark, max_bucket):
    rnd = random.Random(3)
    passages = [" ".join(rnd.choice("abcdefghij") for _ in range(120)) for _ in range(3)]
    rows = [(i, " ".join(rnd.choice("klmnop") for _ in range(30)) + " " + passages[i % 3] + "\n" + " ".join(rnd.choice("qrs") for _ in range(40))) for i in range(40)]
    rows += [(100, "x " * 300), (101, "x " * 80), (102, None), (103, ""), (None, "x " * 200), (101, "x " * 80), (104, "x " * 49), (105, "y " + "x " * 60)]
    df = spark.createDataFrame([(d, t, "c") for d, t in rows], "doc_id long, text string, kept string").repartition(5)
    done = substring_dedup.remove_repeats(df, max_bucket=max_bucket)
    assert done.columns[:3] == ["doc_id", "text", "kept"]
    got = sorted((tuple(r) for r in done.select("doc_id", "__dedup_n_words", "__dedup_n_removed", "__dedup_kept").collect()), key=str)
    assert got == brute_removal(rows, 50)


def test_substring_limits(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup.remove_repeats(none).count() == 0
    with pytest.raises(ValueError):
        substring_dedup.repeated_windows(none, size=5)
