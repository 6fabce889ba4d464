"""Toxicity: a bidirectional gated recurrent network with attention pooling over overlapping windows of words.

A word enters as its own vector, if the training texts have it often enough, beside the mean of the vectors of its
character runs. The network is trained in numpy on a bounded sample of labelled documents, all of their windows; a
document's score is that of its most toxic window, and every window of every text is scored. Every fifth training
document is held back: it says when the network was best, and where the cut between the classes lies.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from certus.llm import gru
from certus.llm.words import text_slices

#: Labelled documents of each class that training takes at most, about (a bounded sample by hash of the id).
MAX_TOXIC, MAX_CLEAN = 1_500, 1_500
WINDOW, STRIDE = 64, 48
VOCABULARY, BUCKETS = 20_000, 1 << 13
WORD_SIZE, CHARACTER_SIZE, SIZE, ATTENTION = 16, 16, 12, 16
#: Training steps, windows in each, and steps after which the held-back documents are scored.
STEPS, BATCH, CHECK = 600, 128, 60
_LANES = 1024
#: Text that is scored at once, about.
_BYTES = 2 << 20
#: A longer word is taken in pieces of so many characters; neighbouring pieces share three, so no run of four is lost.
_PIECE, _SHARED = 64, 3
_EDGE = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())


def _pieces(word: str) -> list[str]:
    """The word without ASCII marks at its ends (one of marks only stays as it is), a long one in pieces."""
    word = word.strip(_EDGE) or word
    return [word] if len(word) <= _PIECE else [word[at : at + _PIECE] for at in range(0, len(word) - _SHARED, _PIECE - _SHARED)]


@dataclass
class Texts:
    """Texts as numbers of their distinct words, one after the other, and each text's length in words."""

    words: list[str]
    codes: np.ndarray
    lengths: np.ndarray

    @staticmethod
    def of(texts: pa.Array) -> Texts:
        lists = pc.utf8_split_whitespace(pc.utf8_lower(texts.cast(pa.string()).fill_null("")))
        flat = lists.flatten()
        real = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
        ends = np.r_[0, np.cumsum(real)][lists.offsets.to_numpy() - lists.offsets[0].as_py()] if len(lists) else np.zeros(1, np.int64)
        raw = flat.dictionary_encode()
        codes, pieces = raw.indices.to_numpy()[real], [_pieces(w) for w in raw.dictionary.to_pylist()]
        distinct: dict[str, int] = {}
        number = np.array([distinct.setdefault(p, len(distinct)) for some in pieces for p in some], np.int64)
        counts = np.array([len(some) for some in pieces], np.int64)
        begins, per_place = np.cumsum(counts) - counts, counts[codes]
        upto = np.r_[0, np.cumsum(per_place)]
        places = np.repeat(begins[codes] - upto[:-1], per_place) + np.arange(upto[-1])
        return Texts(list(distinct), number[places], np.diff(upto[ends]))

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, start among all words, length) of all overlapping windows."""
        n = np.where(self.lengths > 0, np.maximum(1, -(-(self.lengths - (WINDOW - STRIDE)) // STRIDE)), 0)
        owner = np.repeat(np.arange(len(n)), n)
        inner = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * STRIDE
        return owner, (np.cumsum(self.lengths) - self.lengths)[owner] + inner, np.minimum(WINDOW, self.lengths[owner] - inner)


def words_in(text: str | None) -> list[str]:
    """Lower-case words of a text; see ``_pieces``."""
    texts = Texts.of(pa.array([text], pa.string()))
    return [texts.words[c] for c in texts.codes]


def window_starts(n: int) -> range:
    """Starts of the overlapping windows that together cover n words; none for no words."""
    return range(0, max(1, n - (WINDOW - STRIDE)) if n else 0, STRIDE)


def _summed(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the values by row number, n rows."""
    out = np.zeros((n, values.shape[1]), values.dtype)
    if len(rows):
        order = np.argsort(rows, kind="stable")
        heads = np.flatnonzero(np.r_[True, np.diff(rows[order]) > 0])
        out[rows[order][heads]] = np.add.reduceat(values[order], heads, axis=0)
    return out


def character_runs(words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(bucket, word) of the words' runs of 3 and of 4 bytes, their ends marked, and of their first 5, in order of words."""
    marked = [f"<{w}>".encode() for w in words]
    data, sizes = np.frombuffer(b"".join(marked) + bytes(4), np.uint8).astype(np.uint64), np.array([len(m) for m in marked], np.int64)
    begins, out = np.cumsum(sizes) - sizes, []
    for n, counts in ((3, sizes - 2), (4, np.maximum(sizes - 3, 0)), (5, (sizes > 0).astype(np.int64))):
        owner = np.repeat(np.arange(len(sizes)), counts)
        at = begins[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        value = np.full(len(at), n, np.uint64)
        for k in range(n):
            value = value * np.uint64(0x9E3779B97F4A7C15) + data[at + k]
        value ^= value >> np.uint64(29)
        out.append((((value * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(40)).astype(np.int64) % BUCKETS, owner))
    return out


@dataclass
class Network:
    """Weights and the word numbers (0: unknown)."""

    weights: dict[str, np.ndarray]
    number: dict[str, int]
    shift: float = 0.0

    def inputs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, list, np.ndarray]:
        """Vectors of words (a row each), with their numbers, character runs and the runs' counts."""
        w = self.weights
        ids, runs = np.fromiter((self.number.get(x, 0) for x in words), np.int64, len(words)), character_runs(words)
        total, counts = np.zeros((len(words), CHARACTER_SIZE), np.float32), np.zeros(len(words), np.float32)
        for bucket, owner in runs:
            if len(bucket):
                there, heads, n = np.unique(owner, return_index=True, return_counts=True)
                total[there] += np.add.reduceat(np.take(w["runs"], bucket, axis=0), heads, axis=0)
                counts[there] += n
        return np.concatenate([w["words"][ids], total / np.maximum(counts, 1)[:, None]], 1), ids, runs, counts

    def gate_inputs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Inputs to the gates of both directions, a row for each word."""
        w, parts = self.weights, ([np.zeros((0, 3 * SIZE), np.float32)], [np.zeros((0, 3 * SIZE), np.float32)])
        for at in range(0, len(words), 8192):
            x = self.inputs(words[at : at + 8192])[0]
            parts[0].append(x @ w["wf"] + w["bf"])
            parts[1].append(x @ w["wb"] + w["bb"])
        return np.concatenate(parts[0]), np.concatenate(parts[1])


def new_network(number: dict[str, int], seed: int = 5) -> Network:
    rng = np.random.default_rng(seed)
    small = lambda *shape, by=0.1: (by * rng.standard_normal(shape)).astype(np.float32)
    x = WORD_SIZE + CHARACTER_SIZE
    weights = {
        "words": small(len(number) + 1, WORD_SIZE),
        "runs": small(BUCKETS, CHARACTER_SIZE, by=0.3),
        "wf": small(x, 3 * SIZE, by=0.3),
        "bf": np.zeros(3 * SIZE, np.float32),
        "wb": small(x, 3 * SIZE, by=0.3),
        "bb": np.zeros(3 * SIZE, np.float32),
        "wa": small(ATTENTION, 2 * SIZE, by=0.3),
        "ba": np.zeros(ATTENTION, np.float32),
        "va": small(ATTENTION, by=0.3),
        "wo": small(2 * SIZE, by=0.3),
        "bo": np.zeros(1, np.float32),
    }
    for side in "fb":
        weights |= {f"{k}_{side}": v for k, v in gru.start_weights(rng, SIZE).items()}
    return Network(weights, number)


def _places(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word places of each step and window, onwards and backwards, and which of them are inside the window."""
    step = np.arange(int(lengths.max()))[:, None]
    inside = step < lengths
    return starts + np.minimum(step, lengths - 1), starts + np.maximum(lengths - 1 - step, 0), inside


def _turned(states: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """States (or gradients) in steps backwards from each window's end, put in the order of its words, or back."""
    step = np.arange(states.shape[1])[:, None]
    at = np.where(step < lengths, lengths - 1 - step, step) * states.shape[2] + np.arange(states.shape[2])
    return np.take(states.reshape(len(states), -1), at, axis=1)


def _pooled(w: dict, states: np.ndarray, inside: np.ndarray):
    """Logits of windows from their states (2 * SIZE by steps by windows), and what learning needs."""
    flat = states.reshape(len(states), -1)
    hidden = gru.squash(w["wa"] @ flat + w["ba"][:, None])
    energy = np.where(inside, (w["va"] @ hidden).reshape(inside.shape), np.float32(-1e9))
    energy -= energy.max(0)
    weight = np.exp(energy)
    weight /= weight.sum(0)
    pooled = (states * weight).sum(1)
    return w["wo"] @ pooled + w["bo"][0], hidden, weight, pooled


def window_logits(net: Network, gates: tuple[np.ndarray, np.ndarray], codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Logit of each window: ``lengths`` places of ``codes`` (rows of ``gates``) from ``starts``."""
    w, out = net.weights, np.empty(len(starts), np.float32)
    order = np.argsort(lengths, kind="stable")
    for at in range(0, len(order), _LANES):
        some = order[at : at + _LANES]
        on, back, inside = _places(starts[some], lengths[some])
        sides = []
        for table, place, side in ((gates[0], on, "f"), (gates[1], back, "b")):
            h = np.zeros((SIZE, len(some)), np.float32)
            found = np.empty((SIZE, *on.shape), np.float32)
            for t in range(len(on)):
                h = gru.step(np.take(table, codes[place[t]], axis=0).T, h, w[f"u_{side}"], w[f"bu_{side}"])
                found[:, t] = h
            sides.append(found if side == "f" else _turned(found, lengths[some]))
        out[some] = _pooled(w, np.concatenate(sides), inside)[0]
    return out


def _learn(net: Network, adam: gru.Adam, words: list[str], codes: np.ndarray, lengths: np.ndarray, labels: np.ndarray) -> None:
    """One step on windows that lie one after the other in ``codes``, which number ``words``."""
    w = net.weights
    x, ids, runs, counts = net.inputs(words)
    on, back, inside = _places(np.cumsum(lengths) - lengths, lengths)
    ones, none = np.ones(on.shape, np.float32), np.zeros((SIZE, len(lengths)), np.float32)
    kept, sides = {}, []
    for side, place in (("f", on), ("b", back)):
        gates = np.take(np.ascontiguousarray((x @ w[f"w{side}"] + w[f"b{side}"]).T), codes[place], axis=1)
        states, kept[side] = gru.forward(gates, none, ones, w[f"u_{side}"], w[f"bu_{side}"])
        sides.append(states if side == "f" else _turned(states, lengths))
    states = np.concatenate(sides)
    logits, hidden, weight, pooled = _pooled(w, states, inside)
    d_logit = ((gru.sigmoid(logits) - labels) / len(lengths)).astype(np.float32)
    d_pooled = w["wo"][:, None] * d_logit
    d_weight = (states * d_pooled[:, None]).sum(0)
    d_energy = weight * (d_weight - (weight * d_weight).sum(0))
    d_hidden = w["va"][:, None] * d_energy.ravel() * (1 - np.abs(hidden)) ** 2
    d_states = weight * d_pooled[:, None] + (w["wa"].T @ d_hidden).reshape(states.shape)
    grads = {"wo": pooled @ d_logit, "bo": np.array([d_logit.sum()], np.float32), "va": hidden @ d_energy.ravel(), "ba": d_hidden.sum(1), "wa": d_hidden @ states.reshape(len(states), -1).T}
    dx = np.zeros_like(x)
    for side, d, place in (("f", d_states[:SIZE], on), ("b", _turned(np.ascontiguousarray(d_states[SIZE:]), lengths), back)):
        d = np.where(inside, d, np.float32(0))
        dg, recurrent = gru.backward(d, kept[side], ones, w[f"u_{side}"])
        grads |= {f"{k}_{side}": v for k, v in recurrent.items()}
        by_word = _summed(codes[place].ravel(), dg.reshape(3 * SIZE, -1).T, len(words))
        grads[f"w{side}"], grads[f"b{side}"] = x.T @ by_word, by_word.sum(0)
        dx += by_word @ w[f"w{side}"].T
    grads["words"] = _summed(ids, dx[:, :WORD_SIZE], len(w["words"]))
    share = dx[:, WORD_SIZE:] / np.maximum(counts, 1)[:, None]
    grads["runs"] = _summed(np.concatenate([b for b, _ in runs]), np.take(share, np.concatenate([o for _, o in runs]), axis=0), BUCKETS)
    adam.step(grads)


def train(texts: list[str], labels: list[int], steps: int = STEPS, batch: int = BATCH, seed: int = 9) -> Network:
    """Fit on all windows of whole labelled texts; after the first check a toxic text counts with its most toxic window.

    Texts without words are left out. Every fifth text of a class is held back for the choice of the step and of the cut
    between the classes; without both classes among those, the training texts serve.
    """
    rng = np.random.default_rng(seed)
    split = Texts.of(pa.array(texts, pa.string()))
    truth = np.array(labels, np.int64)
    usable = np.flatnonzero(split.lengths > 0)
    held = np.zeros(len(truth), bool)
    for y in (0, 1):
        held[usable[truth[usable] == y][4::5]] = True
    owner, start, length = split.windows()
    learn = ~held[owner]
    # words that three training documents have
    mine = ~np.repeat(held, split.lengths)
    pairs = np.unique(np.stack([split.codes[mine], np.repeat(np.arange(len(truth)), split.lengths)[mine]], 1), axis=0)[:, 0]
    seen = np.bincount(pairs, minlength=len(split.words))
    known = np.argsort(-seen, kind="stable")[:VOCABULARY]
    net = new_network({split.words[c]: n for n, c in enumerate(known[seen[known] >= 3].tolist(), 1)})
    found = set(truth[usable].tolist())
    if len(found) < 2:  # one class, or none: nothing tells them apart
        net.weights["wo"][:] = 0
        net.weights["bo"][:] = 10 if found == {1} else -10
        return net
    if len(set(truth[held].tolist())) < 2:
        held = np.isin(np.arange(len(truth)), usable)
    adam = gru.Adam(net.weights, 0.006)
    pool = np.flatnonzero(learn)
    queue = np.empty(0, np.int64)
    best, kept, at_best = np.inf, {k: v.copy() for k, v in net.weights.items()}, np.zeros(len(truth))
    for step in range(steps):
        while len(queue) < batch:
            queue = np.r_[queue, rng.permutation(pool)]
        some, queue = queue[:batch], queue[batch:]
        places = np.repeat(start[some] - (np.cumsum(length[some]) - length[some]), length[some]) + np.arange(length[some].sum())
        there, codes = np.unique(split.codes[places], return_inverse=True)
        _learn(net, adam, [split.words[c] for c in there.tolist()], codes, length[some], truth[owner[some]].astype(np.float32))
        if (step + 1) % CHECK == 0 or step + 1 == steps:
            gates = net.gate_inputs(split.words)
            logits = window_logits(net, gates, split.codes, start, length)
            scores = np.full(len(truth), -np.inf)
            np.maximum.at(scores, owner, logits)
            p = np.clip(gru.sigmoid(scores[held]), 1e-6, 1 - 1e-6)
            loss = -sum(np.log(np.where(truth[held] == y, p if y else 1 - p, 1.0)).sum() / (truth[held] == y).sum() for y in (0, 1))
            if loss < best:
                best, kept, at_best = loss, {k: v.copy() for k, v in net.weights.items()}, scores
            # a toxic text counts with its most toxic window
            order = np.lexsort((-logits, owner))
            first = order[np.r_[True, np.diff(owner[order]) > 0]]
            pool = np.flatnonzero(learn & (truth[owner] == 0) | np.isin(np.arange(len(owner)), first) & learn)
            queue = queue[:0] if step + 1 == CHECK else queue
    net.weights = kept
    net.shift = -_cut(at_best[held], truth[held])
    return net


def _cut(scores: np.ndarray, truth: np.ndarray) -> float:
    """The cut with the fewest errors, both classes weighing the same; of equally good ones the middle."""
    order = np.argsort(scores, kind="stable")
    n = np.array([(truth == 0).sum(), (truth == 1).sum()])
    errors = np.r_[0, np.cumsum(np.where(truth[order] == 1, 1 / n[1], -1 / n[0]))] + 1
    good = np.flatnonzero(errors <= errors.min() + 1e-9)
    edges = np.r_[scores[order[0]] - 1, scores[order], scores[order[-1]] + 1]
    return float((edges[good[0]] + edges[good[-1] + 1]) / 2) if np.all(np.diff(good) == 1) else float((edges[good[len(good) // 2]] + edges[good[len(good) // 2] + 1]) / 2)


def score_texts(net: Network, texts: list[str | None] | pa.Array) -> np.ndarray:
    """Probability that a text is toxic; 0 without words."""
    split = Texts.of(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
    owner, start, length = split.windows()
    logits = np.full(len(split.lengths), -np.inf)
    if len(owner):
        np.maximum.at(logits, owner, window_logits(net, net.gate_inputs(split.words), split.codes, start, length))
    return np.where(np.isfinite(logits), gru.sigmoid(np.maximum(logits, -700) + net.shift), 0.0)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Network:
    """Train on labelled documents; learn says which rows of ``labels`` to learn from (null: not).

    About ``max_toxic`` and ``max_clean`` ids are sampled by hash; of an id with several texts two are taken. Null ids and
    labels are left out; an id with several labels has the largest.
    """
    usable = labels.filter(learn).select(F.col(id_col).alias("__id"), F.col(label_col).alias("__label")).filter("__id IS NOT NULL AND __label IN (0, 1)").groupBy("__id").agg(F.max("__label").alias("__label"))
    n = {r["__label"]: r["count"] for r in usable.groupBy("__label").count().collect()}
    share = {y: min(1.0, most / max(1, n.get(y, 0))) for y, most in ((1, max_toxic), (0, max_clean))}
    # shares of 63 bits never round to nothing
    place = F.shiftrightunsigned(F.xxhash64("__id"), 1).cast("double") / float(1 << 63)
    picked = usable.filter(place < F.when(F.col("__label") == 1, F.lit(share[1])).otherwise(F.lit(share[0])))
    # at most about max_toxic + max_clean ids, 16 bytes each
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(picked), "__id")
    turn = F.row_number().over(Window.partitionBy("__id").orderBy(F.xxhash64("__text"), "__text"))
    rows = texts.withColumn("__turn", turn).filter("__turn <= 2").collect()
    rows.sort(key=lambda r: (r["__id"], r["__turn"]))
    return train([r["__text"] for r in rows], [r["__label"] for r in rows])


def toxicity(text: Column, net: Network) -> Column:
    """Probability (double) that a text is toxic, by all of its windows; null and empty texts have 0."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([score_texts(net, texts.slice(at, n)) for at, n in text_slices(texts, _BYTES)] or [np.empty(0)]), pa.float64())

    return score.asNondeterministic()(text)
