"""Language-model scores: a gated recurrent network over words with a class-factored output.

Word counts of all training documents are a Spark aggregation. The frequent words are the network's vocabulary; a word
outside it is scored as the unknown word times its smoothed share of the rarer words. The network is trained by
truncated backpropagation on all training documents, each once: tasks train copies on their own rows, and the copies are
averaged, in groups, after each round. Scoring carries a document's state through all of its words.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from certus.llm import gru
from certus.llm.words import split_words, text_slices, words_of
from certus.plans.staging import staged

#: Words that the network tells apart, with the unknown word (0) and the end (1).
VOCABULARY = 2048
#: Most frequent words whose counts each task holds; counts of the others come by a join.
HEAD = 150_000
#: Times that copies are averaged: each round goes once over its share of the training documents.
ROUNDS = 2
SIZE = 24
EMBEDDING = 16
CLASSES = 48
#: Text that trains one copy in a round, about.
_SHARD_BYTES = 8 << 20
#: Text that is cut to words at once, about.
_BYTES = 8 << 20
#: Lanes at most and steps of a window, and windows that a stream has at least, so that short ones get enough steps.
_LANES, _STEPS, _WINDOWS = 512, 16, 64
#: Tokens that a task gathers for a stream at most; a shard has about a third of them.
_STREAM = 4 << 20
RATE = 0.03
_GROUP = 512
#: Tokens whose classes are told apart at once; their logits stay in a core's cache.
_COLUMNS = 1024
#: Tokens that are scored in one window, about.
_TOKENS = 8192
_UNKNOWN, _END = 0, 1
_LOWER = {c: c + 32 for c in range(65, 91)}


def tokens_of(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case, without the end."""
    return words_of((text or "").translate(_LOWER))


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, n in text_slices(batch.column(0), _BYTES):
            words, codes, _ = split_words(batch.column(0).slice(at, n), lower=True)
            seen = np.bincount(codes, minlength=len(words))
            there = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([words.take(pa.array(there)), pa.array(seen[there])], ["word", "n"])


@dataclass
class Counts:
    """Counts of the training tokens: the head in the driver and in each task, all others in a staged table."""

    words: list[bytes]
    counts: np.ndarray
    rest: DataFrame
    documents: int
    tokens: int
    distinct: int

    @property
    def smoothing(self) -> float:
        return self.tokens + self.distinct + 1.0


def count_tokens(texts: DataFrame, head: int = HEAD) -> Counts:
    """Count the tokens of the column ``text``, an end for each row included."""
    table = staged(texts.select("text").mapInArrow(_count_rows, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    total = table.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    documents = texts.count()
    # the head is what lies above a cut that at most ``head`` words reach; a few thousand steps of counts are enough
    step = F.floor(F.ln("n") * 100).cast("int")
    steps = sorted(((r["step"], r["words"]) for r in table.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect()), reverse=True)
    cut, reached = None, 0
    for at, words in steps:
        reached += words
        if reached > head:
            break
        cut = at
    inside = step >= cut if cut is not None else F.lit(False)
    top = sorted(table.filter(inside).collect(), key=lambda r: (-r["n"], r["word"]))  # ``head`` rows at most
    rest = table.filter(~inside)
    return Counts([r["word"].encode() for r in top], np.array([r["n"] for r in top], np.int64), rest, documents, total["n"] + documents, total["v"] + (documents > 0))


@dataclass
class Network:
    """Weights, and the class and place in it of each word; words of a class are next to each other."""

    weights: dict[str, np.ndarray]
    bounds: np.ndarray

    def tables(self) -> dict[str, np.ndarray]:
        return self.weights | {"bounds": self.bounds}


def new_network(counts: np.ndarray, classes: int = CLASSES, size: int = SIZE, embedding: int = EMBEDDING, seed: int = 3) -> Network:
    """A network that starts from the words' shares. counts: of each vocabulary id; ids are cut to classes of about
    equal shares of the counts' square roots."""
    rng = np.random.default_rng(seed)
    n = len(counts)
    share = np.cumsum(np.sqrt(counts + 1.0))
    cls = np.minimum((share / share[-1] * classes).astype(int), classes - 1)
    bounds = np.r_[np.flatnonzero(np.r_[True, np.diff(cls) > 0]), n]
    p = (counts + 0.5) / (counts + 0.5).sum()
    by_class = np.add.reduceat(p, bounds[:-1])
    small = lambda *shape: (0.1 * rng.standard_normal(shape)).astype(np.float32)
    weights = {
        "embed": small(n, embedding),
        "w": small(embedding, 3 * size),
        "bw": np.zeros(3 * size, np.float32),
        "wc": 0.1 * small(len(by_class), size),
        "bc": np.log(by_class).astype(np.float32),
        "wo": 0.1 * small(n, size),
        "bo": np.log(p / by_class[np.searchsorted(bounds, np.arange(n), side="right") - 1]).astype(np.float32),
    } | gru.start_weights(rng, size)
    return Network(weights, bounds)


def _exponentials(weights: np.ndarray, states: np.ndarray, goal: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logits' exponentials (a column for each row of ``states``, which end in a one for the bias), their sums, and the
    goals' exponentials' places. A column's exponentials are by the same factor too large or small."""
    out = weights @ states.T
    if limit > 80:  # else no exponential overflows
        out -= out.max(0)
    np.exp(out, out=out)
    return out, np.ones(len(out), out.dtype) @ out, goal * len(states) + np.arange(len(states))


def _softmax_slopes(exponentials: np.ndarray, total: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Probabilities less one at the goals, in the place of the exponentials."""
    exponentials *= 1 / total
    exponentials.ravel()[place] -= 1
    return exponentials


def _largest(weights: np.ndarray, bias: np.ndarray) -> float:
    """The largest size that a logit can have, as states are between -1 and 1."""
    return float(np.abs(weights).sum(1).max() + np.abs(bias).max())


def _output(net: Network, states: np.ndarray, targets: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray | None, np.ndarray | None]:
    """Natural log-probabilities of the targets, from states (size by tokens). With ``grads``, puts the gradients of their
    sum's negative there and returns the states' instead."""
    w, bounds = net.weights, net.bounds
    sizes = np.diff(bounds)
    # small numbers, which numpy sorts by their digits
    cls = np.repeat(np.arange(len(sizes), dtype=np.min_scalar_type(len(bounds))), sizes)[targets]
    order = np.argsort(cls, kind="stable")
    cuts = np.r_[0, np.cumsum(np.bincount(cls, minlength=len(sizes)))]
    # tokens of a class lie together, each in a row, with a one behind for the bias
    rows = np.ones((len(order), len(states) + 1), np.float32)
    rows[:, :-1] = np.take(states.T, order, axis=0)
    goals, cls = targets[order].astype(np.int64), cls[order].astype(np.int64)
    outer, inner = np.column_stack([w["wc"], w["bc"]]), np.column_stack([w["wo"], w["bo"]])
    found, d_rows, d_outer, d_inner = np.empty(len(order), np.float32), None, np.zeros_like(outer), np.zeros_like(inner)
    if grads is not None:
        d_rows = np.empty((len(order), len(states)), np.float32)
    limit = _largest(w["wc"], w["bc"])
    for at in range(0, len(order), _COLUMNS):
        part = slice(at, at + _COLUMNS)
        e, total, place = _exponentials(outer, rows[part], cls[part], limit)
        if grads is None:
            found[part] = np.log(e.ravel()[place] / total)
        else:
            d = _softmax_slopes(e, total, place)
            d_outer += d @ rows[part]
            np.matmul(d.T, w["wc"], out=d_rows[part])
    limit = _largest(w["wo"], w["bo"])
    for c in np.flatnonzero((np.diff(cuts) > 0) & (sizes > 1)).tolist():  # other classes have one word only
        part, words = slice(cuts[c], cuts[c + 1]), slice(bounds[c], bounds[c + 1])
        e, total, place = _exponentials(inner[words], rows[part], goals[part] - bounds[c], limit)
        if grads is None:
            found[part] += np.log(e.ravel()[place] / total)
        else:
            d = _softmax_slopes(e, total, place)
            np.matmul(d, rows[part], out=d_inner[words])
            d_rows[part] += d.T @ w["wo"][words]
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    if grads is None:
        return found[back], None
    grads |= {"wc": d_outer[:, :-1], "bc": d_outer[:, -1], "wo": d_inner[:, :-1], "bo": d_inner[:, -1]}
    return None, np.take(d_rows, back, axis=0).T


def _embedded(w: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A row for each word, with a one behind, and what makes them inputs to the gates (3 * size, a row each)."""
    return np.hstack([w["embed"], np.ones((len(w["embed"]), 1), np.float32)]), np.vstack([w["w"], w["bw"]]).T.copy()


def train(net: Network, stream: np.ndarray, rate: float = RATE, adam: gru.Adam | None = None) -> None:
    """One pass over a stream of ids in which each document ends with the end id, in lanes side by side."""
    if len(stream) < 2:
        return
    w = net.weights
    adam = adam or gru.Adam(w, rate)
    lanes = max(1, min(_LANES, len(stream) // (_STEPS * _WINDOWS)))
    length = -(-len(stream) // lanes)
    # the last lane is filled up with ends that nothing is learned from
    target = np.concatenate([stream, np.full(lanes * length - len(stream), _END)]).reshape(lanes, length).T
    counts = np.arange(lanes * length).reshape(lanes, length).T < len(stream)
    source = np.vstack([np.full((1, lanes), _END), target[:-1]])
    h = np.zeros((w["u"].shape[1], lanes), np.float32)
    for at in range(0, length, _STEPS):
        ids, goal = source[at : at + _STEPS], target[at : at + _STEPS]
        carry = (ids != _END).astype(np.float32)
        embedded, to_gates = _embedded(w)
        inputs = np.take(embedded, ids, axis=0)  # steps by lanes by embedding
        states, kept = gru.forward((to_gates @ inputs.transpose(0, 2, 1)).transpose(1, 0, 2), h, carry, w["u"], w["bu"])
        grads: dict[str, np.ndarray] = {}
        flat, real = states.transpose(1, 2, 0).reshape(-1, len(states)).T, np.flatnonzero(counts[at : at + _STEPS])
        if len(real) == goal.size:
            d_states = _output(net, flat, goal.ravel(), grads)[1]
        else:
            d_states = np.zeros_like(flat)
            d_states[:, real] = _output(net, flat[:, real], goal.ravel()[real], grads)[1]
        dx, recurrent = gru.backward(d_states.reshape(states.shape), kept, carry, w["u"])
        grads |= recurrent
        by_step = dx.transpose(1, 0, 2)
        d_gates = (by_step @ inputs).sum(0)  # embedding's weights, and the bias behind them
        grads["w"], grads["bw"] = d_gates[:, :-1].T, d_gates[:, -1]
        # sums by word
        d_inputs = (by_step.transpose(0, 2, 1) @ w["w"].T).reshape(-1, w["w"].shape[0])
        order = np.argsort(ids.astype(np.min_scalar_type(len(w["embed"]))), axis=None, kind="stable")
        ordered = ids.ravel()[order]
        heads = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
        grads["embed"] = np.zeros_like(w["embed"])
        grads["embed"][ordered[heads]] = np.add.reduceat(np.take(d_inputs, order, axis=0), heads, axis=0)
        for g in grads.values():
            g /= np.float32(len(real))
        adam.step(grads)
        h = states[:, -1]


def _lanes_of(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's lane and its first step there: documents stand one behind another in up to _GROUP lanes of about
    equal length, the longest lane first."""
    lane, first, free = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), [(0, k) for k in range(min(_GROUP, len(lengths)))]
    for doc in np.argsort(-lengths, kind="stable").tolist():
        used, k = free[0]
        lane[doc], first[doc] = k, used
        heapq.heapreplace(free, (used + int(lengths[doc]), k))
    rank = np.empty(len(free), np.int64)
    rank[[k for _, k in sorted(free, reverse=True)]] = np.arange(len(free))
    return rank[lane], first


def score(net: Network, documents: list[np.ndarray]) -> np.ndarray:
    """Natural log-probability of each list of ids with its end, from the state that the end leaves."""
    if not documents:
        return np.zeros(0)
    w = net.weights
    embedded, to_gates = _embedded(w)
    out = np.zeros(len(documents))
    lengths = np.array([len(d) + 1 for d in documents])
    lane, first = _lanes_of(lengths)
    # the tokens of all lanes, lane by lane
    order = np.lexsort((first, lane))
    stream = np.concatenate([x for d in order.tolist() for x in (documents[d], (_END,))]).astype(np.int64)
    owners = np.repeat(order, lengths[order])
    long = np.bincount(lane, lengths).astype(np.int64)  # falling
    begins = np.cumsum(long) - long
    h, last = np.zeros((w["u"].shape[1], len(long)), np.float32), np.full(len(long), _END)
    done = 0
    while done < long[0]:  # a window of steps, longer ones where few lanes are left; the state goes on to the next
        live = int((long > done).sum())
        width = min(max(1, _TOKENS // live), int(long[0]) - done)
        place = done + np.arange(width)[:, None]
        n_live = (long[:live] > place).sum(1)
        at = begins[:live] + np.minimum(place, long[:live] - 1)
        target = stream[at]
        source = np.vstack([last[None, :live], target[:-1]])
        carry = (source != _END).astype(np.float32)
        begun = (source == _END).any(1)
        inputs = (to_gates @ np.take(embedded, source, axis=0).transpose(0, 2, 1)).transpose(1, 0, 2)
        states = gru.by_step(len(h), width, live)
        h = h[:, :live]
        for t in range(width):
            m = n_live[t]
            h = h[:, :m] * carry[t, :m] if begun[t] else h[:, :m]
            h = gru.step(inputs[:, t, :m], h, w["u"], w["bu"])
            states[:, t, :m] = h
        inside = np.flatnonzero(np.arange(live) < n_live[:, None])
        logs = _output(net, states.transpose(1, 2, 0).reshape(-1, len(states))[inside].T, target.ravel()[inside])[0]
        out += np.bincount(owners[at.ravel()[inside]], logs.astype(float), len(out))
        last, done = target[-1], done + width
    return out


def _pack(net: Network) -> bytes:
    data = io.BytesIO()
    np.savez(data, **net.tables())
    return data.getvalue()


def _unpack(data: bytes) -> Network:
    tables = dict(np.load(io.BytesIO(data)))
    bounds = tables.pop("bounds")
    return Network(tables, bounds)


def _averaged(packed: list[bytes], n: list[int]) -> bytes:
    nets, total = [_unpack(p) for p in packed], sum(n)
    weights = {k: sum(net.weights[k] * np.float32(m / total) for net, m in zip(nets, n)) for k in nets[0].weights}
    return _pack(Network(weights, nets[0].bounds))


def _places(words: pa.Array, known: pa.Array) -> np.ndarray:
    """The place of each word among the known ones, -1 for others."""
    return pc.index_in(words.cast(known.type), value_set=known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def _ids_of(texts: pa.Array, vocabulary: pa.Array) -> np.ndarray:
    """The texts as one stream of ids, an end after each."""
    words, codes, counts = split_words(texts, lower=True)
    place = _places(words, vocabulary)
    return np.insert(np.where(place >= 0, place + 2, _UNKNOWN)[codes], np.cumsum(counts), _END)


def fit(texts: DataFrame, counts: Counts, vocabulary: int = VOCABULARY, rounds: int = ROUNDS) -> Network:
    """Train on all rows of ``texts`` (doc_id, text), each once.

    Rows are dealt to rounds and to shards by a hash. In a round each shard trains a copy of the network, and the copies
    are averaged by their numbers of tokens. Shards hold about _SHARD_BYTES of text, so their number grows with the input.
    A shard is one stream, in however many batches it comes (of more than _STREAM tokens: several), as short streams have
    narrow windows, which cost more for each token.
    """
    words = counts.words[: vocabulary - 2]
    head = counts.counts[: vocabulary - 2]
    unknown = counts.tokens - counts.documents - int(head.sum())
    # ids follow falling counts but for the first two, which are classes of their own by their weight
    net = new_network(np.r_[unknown, counts.documents, head].astype(float))
    hashed = texts.select("text", F.xxhash64("doc_id", "text").alias("place"))
    size = hashed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, round(size / rounds / _SHARD_BYTES))

    for turn in range(rounds):
        start = _pack(net)

        def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """(text, part) in order of parts to a row for each part."""
            own, adam, n, part, held = None, None, 0, -1, []
            names = pa.array([w.decode() for w in words], pa.string())
            packed = lambda: pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([n], pa.int64()), pa.array([_pack(own)], pa.binary())], ["part", "n", "net"])
            for batch in batches:
                parts = batch.column(1).to_numpy()
                heads = np.flatnonzero(np.r_[True, np.diff(parts) != 0]) if len(parts) else parts
                for begin, end in zip(heads.tolist(), [*heads[1:].tolist(), len(parts)]):
                    if parts[begin] != part:
                        if n:
                            train(own, np.concatenate(held), adam=adam)
                            yield packed()
                        own, n, part, held = _unpack(start), 0, int(parts[begin]), []
                        adam = gru.Adam(own.weights, RATE)
                    some = batch.column(0).slice(begin, end - begin)
                    for at, k in text_slices(some, _BYTES):
                        if sum(map(len, held)) >= _STREAM:
                            train(own, np.concatenate(held), adam=adam)
                            held = []
                        held.append(_ids_of(some.slice(at, k), names))
                        n += len(held[-1])
            if n:
                train(own, np.concatenate(held), adam=adam)
                yield packed()

        mine = hashed.filter(F.pmod("place", F.lit(rounds)) == turn).withColumn("part", F.pmod(F.xxhash64("place"), F.lit(shards)))
        dealt = mine.repartition(shards, "part").sortWithinPartitions("part", "place").select("text", "part")
        copies = staged(dealt.mapInArrow(trained, "part bigint, n bigint, net binary"), "lm-copies")
        while copies.count() > 1:
            copies = staged(_averages(copies), "lm-copies")
        for r in copies.collect():  # one row
            net = _unpack(r["net"])
    return net


def _averages(copies: DataFrame) -> DataFrame:
    """Averages of up to 16 neighbouring copies each, numbered anew."""

    def merged(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part")
        return pd.DataFrame({"part": [rows["part"].iloc[0] // 16], "n": [rows["n"].sum()], "net": [_averaged(rows["net"].tolist(), rows["n"].tolist())]})

    return copies.groupBy(F.floor(F.col("part") / 16)).applyInPandas(merged, "part bigint, n bigint, net binary")


def score_documents(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", keep: list[str] = (), **how) -> DataFrame:
    """(doc_id, keep, n_tokens, n_known, train_tokens, base_score, score) for each row of ``docs``.

    learn: true for the rows to learn from; null counts as false. base_score: log10 probability by smoothed word shares;
    score: by the network. Null and empty texts have the end as their only token. Nothing to learn from: all words are
    unknown. Repeated rows are scored one by one, and counted as often as they are there. Other columns are ignored.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"), *(F.col(c).alias(f"keep_{c}") for c in keep))
    training = texts.filter("learn")
    counts = count_tokens(training)
    packed = _pack(fit(training, counts, **how))
    spark = docs.sparkSession
    head = spark.sparkContext.broadcast((counts.words, counts.counts))  # HEAD words at most
    vocabulary = len(_unpack(packed).weights["bo"])
    rare_tokens = counts.tokens - counts.documents - int(counts.counts[: vocabulary - 2].sum())
    rare_words = counts.distinct - 1 - min(vocabulary - 2, len(counts.words))
    rare_smoothing = max(rare_tokens, 0) + max(rare_words, 0) + 1.0
    smoothing, ends = counts.smoothing, counts.documents

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = _unpack(packed)
        words, n = head.value
        names = pa.array([w.decode() for w in words], pa.string())
        log_count = np.log10(np.r_[n, 0] + 1.0)
        for whole in batches:
            for at, rows in text_slices(whole.column(1), _BYTES):
                batch = whole.slice(at, rows)
                found, codes, lengths = split_words(batch.column(1), lower=True)
                at_head = _places(found, names)[codes]
                owner = np.repeat(np.arange(rows), lengths)
                in_head, rare = at_head >= 0, at_head >= vocabulary - 2
                summed = lambda some: np.bincount(owner[some], log_count[at_head[some]], rows)
                seen, n_rare = np.bincount(owner[in_head], minlength=rows), np.bincount(owner[rare], minlength=rows)
                base = summed(in_head) + np.log10(ends + 1.0) - (seen + 1) * np.log10(smoothing)
                within = summed(rare) - n_rare * np.log10(rare_smoothing)
                ids = np.split(np.where(in_head & ~rare, at_head + 2, _UNKNOWN), np.cumsum(lengths)[:-1])
                tail = np.r_[0, np.cumsum(lengths - seen)]
                tails = pa.ListArray.from_arrays(pa.array(tail, pa.int32()), found.take(pa.array(codes[~in_head])))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k) for k in range(batch.num_columns) if k != 1), pa.array(lengths + 1), pa.array(seen + (ends > 0)), pa.array(base), pa.array(within + score(net, ids) / np.log(10)), tails],
                    [*(f.name for k, f in enumerate(batch.schema) if k != 1), "n_tokens", "known", "base", "net", "tail"],
                )

    kept = [f for f in texts.schema if f.name.startswith("keep_")]
    passed = texts.select("doc_id", "text", *(f.name for f in kept))
    schema = f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, " + "".join(f"{f.name} {f.dataType.simpleString()}, " for f in kept) + "n_tokens bigint, known bigint, base double, net double, tail array<string>"
    rows = staged(passed.mapInArrow(scored, schema).withColumn("row", F.monotonically_increasing_id()), "lm-rows")
    tail = rows.select("row", F.explode("tail").alias("word")).join(counts.rest, "word", "left").groupBy("row").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + 1)).alias("logs"), F.count("*").alias("n_tail"), F.count("n").alias("n_seen"))
    both = rows.drop("tail").join(tail, "row", "left").fillna(0, ["n_tail", "n_seen"]).fillna(0.0, ["logs"])
    return both.select(
        "doc_id",
        *(F.col(f.name).alias(f.name[5:]) for f in kept),
        "n_tokens",
        (F.col("known") + F.col("n_seen")).alias("n_known"),
        F.lit(counts.tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.col("logs") - F.col("n_tail") * float(np.log10(smoothing))).alias("base_score"),
        (F.col("net") + F.col("logs") - F.col("n_tail") * float(np.log10(rare_smoothing))).alias("score"),
    )
