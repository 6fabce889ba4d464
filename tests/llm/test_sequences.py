"""Fill-in-the-middle, phrases and packing: brute force, round trips and edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from certus.llm import collocations, fill_middle, packing, word_bpe

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
CLASH = "doc_id long, text string, n int, form string, output binary, ids string, lang string, rank int, tail int, part int"


def table(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, 7, "x", b"y", "z", lang, 1, 2, 3) for i, t in enumerate(texts)], CLASH)


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(5)
    alphabet = [*"ab  \n\t.é漢😀\x85 ", " the", " <", "P>", "<S", "M>", ", "]
    made = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(0, 60))) for _ in range(400)]
    return [*made, "", None, "   ", "word", "ends \n ", "long text " * 60_000, "x" * 300_000, "same text", "same text"]


def test_rearranged_texts(spark, texts):
    rows = {r["doc_id"]: r for r in fill_middle.rearrange_documents(table(spark, texts)).collect()}
    assert len(rows) == len(texts)
    forms = Counter()
    for i, text in enumerate(texts):
        text, r = text or "", rows[i]
        units = UNIT.findall(text)
        assert "".join(units) == text
        n, digest = len(units), hashlib.sha256(f"42:{i}".encode()).hexdigest()
        h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
        low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
        form = "plain" if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50 else "spm" if h[3] % 100 < 80 else "psm"
        want = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        assert (r["n"], r["form"], r["output"], r["restored"]) == (n, form, want, text)
        assert (r["prefix_chars"], r["middle_chars"]) == ((None, None) if form == "plain" else (len(p), len(m)))
        forms[form] += 1
    assert len(forms) == 3


def test_rearranged_without_id(spark):
    none = spark.createDataFrame([(None, "some text here"), (None, "some text here"), (None, None)], "doc_id long, text string")
    rows = fill_middle.rearrange_documents(none, rate=100).collect()
    assert rows[0] == rows[1] and rows[0]["form"] != "plain" and rows[2]["form"] == "plain" and rows[2]["n"] == 0
    assert [r["restored"] for r in rows] == ["some text here", "some text here", ""]
    assert fill_middle.rearrange_documents(none.limit(0)).count() == 0


def brute_phrases(rows, least, most, longest=4, share=80):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(low)):
            words = tuple(re.findall(r"[^\x20\x09]+", piece))
            n[lang] += len(words)
            for size in range(1, longest + 1):
                f[lang].update(words[i : i + size] for i in range(len(words) - size + 1))
    out = []
    for lang, counts in f.items():
        candidates = {w: a for w, a in counts.items() if len(w) > 1 and a >= least}
        scored = []
        for w, a in candidates.items():
            if any(len(x) > len(w) and 100 * b >= share * a and any(x[i : i + len(w)] == w for i in range(len(x) - len(w) + 1)) for x, b in candidates.items()):
                continue
            score, _, left, right = min((2_000_000 * a // (counts[w[:k]] + counts[w[k:]]), k, counts[w[:k]], counts[w[k:]]) for k in range(1, len(w)))
            scored.append((-score, -a, " ".join(w).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(scored)[:most], 1)]
    return sorted(out)


@pytest.mark.parametrize("bits", [26, 6])  # with so few bits nearly nothing is held back
def test_phrases(spark, bits):
    rnd = random.Random(2)
    vocabulary = [*"abcdefgh", "The", "É", "x.y", "\x85", "漢字"]
    line = "the very same line of words, over and over; "
    rows = [(rnd.choice(["en", "de", None, "und"]), "".join(rnd.choice(vocabulary) + rnd.choice([" ", "  ", "\t", " ", ". ", "\n"]) for _ in range(rnd.randrange(0, 300)))) for _ in range(60)]
    rows += [("en", line * k) for k in (1, 40, 900)] + [("de", "a " * 5000), ("de", "a b " * 3000), (None, None), ("en", ""), ("en", " \t.,"), ("fr", "w" * 200_000)] + [("es", "ein Satz von fünf")] * 50
    docs = spark.createDataFrame([(i, la, t, 1, "x") for i, (la, t) in enumerate(rows)], "doc_id long, lang string, text string, a int, phrase string")
    got = collocations.mine_phrases(docs, least=30, most=40, bits=bits).collect()
    assert sorted(map(tuple, got)) == brute_phrases(rows, 30, 40)
    assert {r["lang"] for r in got} == {"en", "de", "und", "es"}


def test_no_phrases(spark):
    docs = spark.createDataFrame([], "doc_id long, lang string, text string")
    assert collocations.mine_phrases(docs).count() == 0


def test_words_are_counted_with_their_chunks(monkeypatch):
    rnd = random.Random(6)
    texts = [" ".join(rnd.choice("Abcdefgh") + rnd.choice(["", ".", "\u00e9"]) for _ in range(rnd.randrange(90))) for _ in range(30)] + [None, "", " . "]
    langs = [rnd.choice(["en", "de"]) for _ in texts]
    rows = pa.RecordBatch.from_arrays([pa.array(langs), pa.array(texts)], ["lang", "text"])
    found = pa.Table.from_batches(collocations._chunk_rows(iter([rows, rows.slice(5)]), 3, 4)).to_pylist()
    want = Counter()
    for lang, t in [*zip(langs, texts), *zip(langs[5:], texts[5:])]:
        want.update((lang, w) for w in (t or "").lower().replace(".", " ").split())
    got = Counter()
    for r in found:
        if r["own"] == 0:
            got[r["lang"], r["chunk"]] += r["times"]
    assert got == want and sum(r["own"] * r["times"] for r in found) == sum(want.values())
    # names of phrases are numbered anew when they grow too large, with the same counts
    chunks = pa.Table.from_pylist([r for r in found if r["own"]], schema=pa.schema([("lang", pa.string()), ("chunk", pa.string()), ("own", pa.int32()), ("times", pa.int64())]))
    counts = []
    for most in (1 << 63, 600):
        monkeypatch.setattr(collocations, "_NAMES", most)
        counts.append(sorted(map(str, pa.Table.from_batches(collocations._phrase_rows(iter(chunks.combine_chunks().to_batches()), 4, None, 26)).to_pylist())))
    assert counts[0] == counts[1] != []


def test_small_batches_of_chunks_share_a_block():
    texts = ["a b c d e", "\u00e9 b c", "a b", "b c d"]
    rows = [(lang, t, 2, k + 1) for k, t in enumerate(texts * 5) for lang in ("en", "de")] + [("en", "b", 0, 7)]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int32(), pa.int64()))], ["lang", "chunk", "own", "times"])
    want = Counter()
    for lang, chunk, own, times in rows[:-1]:
        words = chunk.split()
        want.update({(lang, " ".join(words[k : k + 2])): times for k in range(own) if k + 2 <= len(words)})
    found = pa.Table.from_batches(collocations._phrase_rows((batch.slice(k, 3) for k in range(0, len(rows), 3)), 2, None, 26)).to_pylist()
    assert sorted((r["lang"], r["phrase"], r["a"]) for r in found) == sorted((*k, a) for k, a in want.items())  # each once
    blocks = pa.Table.from_batches(collocations._block_rows(batch.slice(k, 3) for k in range(0, len(rows), 3))).to_pylist()
    assert [(r["lang"], r["phrase"], r["a"]) for r in blocks if r["phrase"]] == [("en", "b", 7)]
    assert sorted((r["lang"], r["n"]) for r in blocks if r["n"]) == [("de", 420), ("en", 420)]
    assert sum(r["codes"] is not None for r in blocks) == 1


def test_joined_words_are_those_of_the_given_text():
    rnd = random.Random(12)
    texts = [" ".join(rnd.choice(["a", "bc", "\u00e9", "\u6f22\u5b57", "\u0085", "-"]) for _ in range(rnd.randrange(1, 9))) for _ in range(200)]
    array = pa.array(["cut off", *texts, "cut off"]).slice(1, len(texts))
    joined, given = collocations._Words(array, lower=False), collocations._Words(array, lower=True)
    for part in ("text", "codes", "hashes"):
        assert np.array_equal(getattr(joined, part), getattr(given, part))
    assert joined.distinct.equals(given.distinct) and np.array_equal(joined.piece, joined.text)
    assert joined.runs(np.array([0]), 1).to_pylist() == texts[0].split(" ")[:1]


def test_chunks_share_words_and_own_them_once():
    words = collocations._Words(pa.array(["a b c d e f g h i j k l. m n o p", "a b c d e f g h i j k l"]), lower=True)
    starts, sizes, own = collocations.chunks(words, 3, 4)
    assert own.sum() == len(words.codes) == 28
    assert all(words.piece[s] == words.piece[s + n - 1] for s, n in zip(starts, sizes))
    assert len(starts) > 3
    again = collocations._Words(pa.array(["z z. a b c d e f g h i j k l"]), lower=True)
    inner = lambda w, found: set(w.phrases(found[0], found[1]).to_pylist()[1:])
    assert inner(again, collocations.chunks(again, 3, 4)) & set(words.phrases(starts, sizes).to_pylist())


def laid_out(rows):
    """Pieces by document and by sequence, without gap or overlap; the sequences' sizes."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append((r["start"], r["length"]))
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for groups in (by_doc, by_sequence):
        for key, pieces in groups.items():
            at = 0
            for start, n in sorted(pieces):
                assert start == at and n > 0
                at += n
            groups[key] = at
    return by_doc, by_sequence


def test_packed_documents(spark, texts):
    content = packing.read_tokenizer(P.path("word_bpe_49k.json"))
    library = Tokenizer.from_str(content)
    texts = [*texts, *["ten copies of one text that is somewhat longer than the others"] * 300]
    ids = [library.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]
    rows = packing.pack_documents(table(spark, texts).repartition(5), content, capacity=64).collect()
    by_doc, by_sequence = laid_out(rows)
    assert by_doc == {i: len(x) for i, x in enumerate(ids)}
    for r in rows:
        piece = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(piece, "<u4").tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])
    sizes = Counter(by_sequence.values())
    assert sum(map(len, ids)) // 64 == sizes.pop(64) and all(n & (n - 1) == 0 and times == 1 for n, times in sizes.items())


def test_packed_rows_without_id_or_text(spark):
    content = packing.read_tokenizer(P.path("word_bpe_49k.json"))
    docs = spark.createDataFrame([(None, None), (None, ""), (5, "one two"), (5, "one two")], "doc_id long, text string")
    rows = packing.pack_documents(docs, content).collect()
    assert sorted(r["length"] for r in rows) == [1, 1, 3, 3] and sum(r["doc_id"] == 5 for r in rows) == 2
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == 4
    assert packing.pack_documents(docs.limit(0), content).count() == 0


def brute_fill(counts, capacity):
    sums = {0}
    for length, n in counts.items():
        sums = {s + length * k for s in sums for k in range(n + 1) if s + length * k <= capacity}
    return max(sums)


def test_fill_is_the_closest_one():
    rnd = random.Random(9)
    for _ in range(300):
        capacity = rnd.randrange(1, 60)
        counts = {rnd.randrange(1, 40): rnd.randrange(1, 5) for _ in range(rnd.randrange(0, 6))}
        fill = packing.best_fill(counts, capacity)
        assert all(n <= counts[length] for length, n in fill.items())
        assert sum(length * n for length, n in fill.items()) == brute_fill(counts, capacity)


def test_plans_leave_nothing_out():
    rnd = random.Random(4)
    for _ in range(150):
        capacity = 1 << rnd.randrange(3, 8)
        histogram = {n: rnd.choice([1, 2, 3, 50]) for n in rnd.sample(range(1, capacity), rnd.randrange(0, capacity - 1))}
        steps = packing.plan_windows(histogram, capacity)
        tails = [(n, k) for n, count in histogram.items() for k in range(count)]
        rows = [
            {"doc_id": d, "start": s, "length": n, "sequence_id": w, "offset": o}
            for found in packing._Plan(steps).places(np.array([n for n, _ in tails], np.int64), np.array([k for _, k in tails], np.int64))
            for d, s, n, w, o in zip(*(c.tolist() for c in found))
        ]
        by_doc, by_sequence = laid_out(rows)
        assert by_doc == {i: n for i, (n, _) in enumerate(tails)}
        total = sum(n for n, _ in tails)
        assert sorted(by_sequence.values()) == sorted([capacity] * (total // capacity) + [1 << k for k in range(8) if total % capacity >> k & 1])


def test_plan_of_one_hot_length_is_small():
    assert len(packing.plan_windows({1500: 10**12, 7: 1}, 2048)) < 1000


def test_words_as_the_library_has_them():
    content = packing.read_tokenizer(P.path("word_bpe_49k.json"))
    library, vocabulary = Tokenizer.from_str(content), word_bpe.word_vocabulary(content)
    rnd = random.Random(8)
    alphabet = [*"aab  \n\t't s'12.é漢😀\x85\x1c,!?thΣσİ́Éß°½ª", "<|endoftext|>", "   ", "ing", "'LL", "running", "x" * 3000]
    made = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(0, 40))) for _ in range(1500)]
    got = word_bpe.encode_texts(pa.array([*made, None]), vocabulary, 1).to_pylist()
    assert got == [library.encode(t, add_special_tokens=False).ids + [1] for t in made] + [[1]]


def test_other_files_are_refused():
    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f, pytest.raises(ValueError):
        word_bpe.WordVocabulary(f.read())
