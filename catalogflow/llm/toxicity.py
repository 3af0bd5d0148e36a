"""Toxicity (operator 2): a bidirectional gated recurrent network with attention pooling, in numpy.

Inputs of a word are learned with the network: a vector of the word and the mean of vectors of its
character 4- and 5-grams (hashed tables; what few texts have stays zero); and beside them how strongly the
word, and the most telling and the average of its grams, go with labelled documents (log odds and
their z scores, counted by document over one part of the labelled sample). The network reads windows
of WINDOW words in both directions, pools its states by attention and gives a logit; windows overlap
by half and cover the whole text; a document scores as its most toxic window.

It is trained on the other part of the sample, so the counted inputs of training words are as honest as
those of new ones, and each word of a batch goes without its learned inputs half of the time: first on windows with the most telling word (toxic documents) and on random and telling
ones (others), then again on the windows that the network itself finds most toxic. A shift of the
logit is then fitted so that 0.5 separates best.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import _tables, held_out, mixed, powers

#: The labelled sample, at most so many documents of each label (chosen by a hash of the id), and bytes of
#: their texts, which are whole.
MOST_TOXIC, MOST_OTHER, MOST_BYTES = 2_000, 4_000, 64_000_000
#: Numbers of a word: counted ones, its own vector's, its grams' vectors'.
COUNTED, OWN, LETTERS = 6, 4, 4
WINDOW, HIDDEN, ATTENTION, INPUTS = 32, 8, 8, COUNTED + OWN + LETTERS
WORD_BITS, GRAM_BITS = 17, 18
BATCH, STEPS, RATE, TABLE_RATE = 128, 220, 0.01, 0.005
#: Texts of the training part that must have a bucket for its vector to learn.
LEAST_TEXTS = 50
KEPT_WORDS = 150_000
SEED = 5


_OTHER = re.compile(r"[^\w\n]|[\d_]")


def hashed(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each word its bucket and whether it has a letter; for its character 4- and 5-grams and the
    fenced word as a whole, by word: owners (ascending) and buckets.

    Only letters count, in lower case. All words go through as one array of bytes.
    """
    letters = _OTHER.sub("", "\n".join(words).lower()).split("\n")
    data = np.frombuffer("\n".join(f"^{w}$" for w in letters).encode("utf-8", "surrogatepass"), np.uint8)
    if len(data) > 1_000_000 and len(words) > 1:
        half = len(words) // 2
        (w1, l1, o1, g1), (w2, l2, o2, g2) = hashed(words[:half]), hashed(words[half:])
        return np.concatenate([w1, w2]), np.concatenate([l1, l2]), np.concatenate([o1, o2 + half]), np.concatenate([g1, g2])
    of_byte, (power, inverse) = _tables()[0], powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(of_byte[data] * power[:-1], out=sums[1:])
    breaks = data == 10
    owner = np.append(0, np.cumsum(breaks))
    ends = np.append(np.flatnonzero(breaks), len(data))
    starts = np.append(0, ends[:-1] + 1)
    whole = mixed((sums[ends] - sums[starts]) * inverse[starts])
    owners, buckets = [np.arange(len(words))], [whole >> np.uint64(64 - GRAM_BITS)]
    for k in (4, 5):
        at = np.flatnonzero((owner[:-k] == owner[k:]) & ~breaks[: len(data) + 1 - k]) if len(data) >= k else np.empty(0, np.int64)
        owners.append(owner[at])
        buckets.append(mixed((sums[at + k] - sums[at]) * inverse[at]) >> np.uint64(64 - GRAM_BITS))
    owners, buckets = np.concatenate(owners), np.concatenate(buckets).astype(np.int64)
    order = np.argsort(owners, kind="stable")
    return (mixed(whole) >> np.uint64(64 - WORD_BITS)).astype(np.int64), ends - starts > 2, owners[order], buckets[order]


@dataclass
class Evidence:
    """Log odds and z scores of word and gram buckets."""

    word_odds: np.ndarray
    word_z: np.ndarray
    gram_odds: np.ndarray
    gram_z: np.ndarray

    @classmethod
    def counted(cls, texts: list[str], toxic: np.ndarray) -> Evidence:
        words, grams = np.zeros((2, 1 << WORD_BITS)), np.zeros((2, 1 << GRAM_BITS))
        split = [set(t.split()) for t in texts]
        number = {w: i for i, w in enumerate(set().union(*split))}
        bucket, _, owners, buckets = hashed(list(number))
        first = np.searchsorted(owners, np.arange(len(number) + 1)).tolist()
        for own, label in zip(split, toxic.astype(int).tolist(), strict=True):
            if own:
                at = [number[w] for w in own]
                words[label, np.unique(bucket[at])] += 1
                grams[label, np.unique(np.concatenate([buckets[first[i] : first[i + 1]] for i in at]))] += 1
        sizes = np.array([[max(1, (toxic == 0).sum())], [max(1, (toxic == 1).sum())]])

        def judged(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            odds = np.log((counts[1] + 0.5) / (sizes[1] + 1)) - np.log((counts[0] + 0.5) / (sizes[0] + 1))
            odds[counts.sum(axis=0) == 0] = 0
            return odds.astype(np.float32), (odds / np.sqrt(1 / (counts[1] + 0.5) + 1 / (counts[0] + 0.5))).astype(np.float32)

        return cls(*judged(words), *judged(grams))

    def inputs(self, words: list[str]) -> np.ndarray:
        """A row of COUNTED numbers per word; a word without letters is a blank."""
        return self.of_hashes(*hashed(words))

    def of_hashes(self, bucket: np.ndarray, lettered: np.ndarray, owners: np.ndarray, buckets: np.ndarray) -> np.ndarray:
        first = np.searchsorted(owners, np.arange(len(bucket)))
        z = self.gram_z[buckets]
        top = np.maximum.reduceat(z, first)
        mean = np.add.reduceat(z, first) / np.diff(np.append(first, len(z)))
        best = np.minimum.reduceat(np.where(z == top[owners], np.arange(len(z)), len(z)), first)
        rows = np.stack([self.word_odds[bucket] / 3, self.word_z[bucket] / 2, self.gram_odds[buckets[best]] / 3, top / 2, mean / 2, np.ones(len(bucket))], axis=1)
        return np.where(lettered[:, None], rows, 0).astype(np.float32)


class Vectors:
    """Learned vectors of words and of their grams, by bucket, with their sums of squared gradients."""

    def __init__(self) -> None:
        self.word, self.gram = np.zeros((1 << WORD_BITS, OWN), np.float32), np.zeros((1 << GRAM_BITS, LETTERS), np.float32)
        self.word_sum, self.gram_sum = np.zeros_like(self.word), np.zeros_like(self.gram)
        self.word_open, self.gram_open = np.zeros(1 << WORD_BITS, bool), np.zeros(1 << GRAM_BITS, bool)

    def open_to(self, codes: Codes, views: list[np.ndarray]) -> None:
        """Let the buckets learn that LEAST_TEXTS texts (as windows of word numbers) have."""
        words, grams = np.zeros(1 << WORD_BITS, np.int64), np.zeros(1 << GRAM_BITS, np.int64)
        for v in views:
            bucket, _, _, buckets = codes.of(np.unique(v[v > 0]))
            words[np.unique(bucket)] += 1
            grams[np.unique(buckets)] += 1
        self.word_open, self.gram_open = words >= LEAST_TEXTS, grams >= LEAST_TEXTS

    def of_hashes(self, bucket: np.ndarray, lettered: np.ndarray, owners: np.ndarray, buckets: np.ndarray) -> np.ndarray:
        """A row of OWN + LETTERS numbers per word."""
        first = np.searchsorted(owners, np.arange(len(bucket)))
        letters = np.add.reduceat(self.gram[buckets], first, axis=0) / np.diff(np.append(first, len(buckets)))[:, None]
        return np.where(lettered[:, None], np.concatenate([self.word[bucket], letters], axis=1), 0).astype(np.float32)

    def learn(self, slope: np.ndarray, bucket: np.ndarray, lettered: np.ndarray, owners: np.ndarray, buckets: np.ndarray) -> None:
        """A step against the slopes of the words' rows, each bucket at the rate of its own history."""
        slope = np.where(lettered[:, None], slope, 0).astype(np.float32)
        share = slope[owners, OWN:] / np.bincount(owners, minlength=len(bucket))[owners][:, None]
        for table, total, open_, at, g in ((self.word, self.word_sum, self.word_open, bucket, slope[:, :OWN]), (self.gram, self.gram_sum, self.gram_open, buckets, share)):
            rows, inverse = np.unique(np.where(open_[at], at, -1), return_inverse=True)
            if rows[0] < 0 and len(rows) == 1:
                continue
            mean = np.zeros((len(rows), g.shape[1]), np.float32)
            np.add.at(mean, inverse, g)
            if rows[0] < 0:
                rows, mean = rows[1:], mean[1:]
            total[rows] += mean * mean
            table[rows] -= TABLE_RATE * mean / (np.sqrt(total[rows]) + 1e-6)

    def settled(self) -> Vectors:
        """Without what only learning needs."""
        self.word_sum = self.gram_sum = self.word_open = self.gram_open = None
        return self


class Words(dict):
    """Numbers of words and their inputs; number 0 is the blank that fills short texts. With a network,
    also what each word adds to its gates, computed once a word."""

    def __init__(self, evidence: Evidence, vectors: Vectors, network: Network | None = None) -> None:
        self.evidence, self.vectors, self.network = evidence, vectors, network
        self._start()

    def _start(self) -> None:
        self.clear()
        self.many, self._rows = 1, np.zeros((1024, INPUTS), np.float32)
        self._given = {d: np.zeros((1024, 3 * HIDDEN), np.float32) for d in "fb"}
        if self.network:
            for d, x in self.network.projected(self._rows[:1]).items():
                self._given[d][:1] = x

    @property
    def rows(self) -> np.ndarray:
        return self._rows[: self.many]

    @property
    def given(self) -> dict[str, np.ndarray]:
        return {d: x[: self.many] for d, x in self._given.items()}

    def _add(self, part: list[str]) -> None:
        self.update(zip(part, range(self.many, self.many + len(part)), strict=True))
        codes = hashed(part)
        new = np.concatenate([self.evidence.of_hashes(*codes), self.vectors.of_hashes(*codes)], axis=1)
        while self.many + len(part) > len(self._rows):
            self._rows = np.concatenate([self._rows, np.zeros_like(self._rows)])
            self._given = {d: np.concatenate([x, np.zeros_like(x)]) for d, x in self._given.items()}
        at = slice(self.many, self.many + len(part))
        self._rows[at] = new
        if self.network:
            for d, x in self.network.projected(new).items():
                self._given[d][at] = x
        self.many += len(part)

    def windows(self, texts: list[str]) -> list[np.ndarray]:
        """Word numbers of the overlapping windows of each text; its last one ends with it."""
        split = [t.split() for t in texts]
        if len(self) > KEPT_WORDS:
            self._start()
        new = sorted(set().union(*split).difference(self))
        for at in range(0, len(new), 20_000):
            self._add(new[at : at + 20_000])
        out = []
        for own in split:
            numbers = np.array([self[w] for w in own], np.int32)
            if len(numbers) < WINDOW:
                numbers = np.concatenate([np.zeros(WINDOW - len(numbers), np.int32), numbers])
            starts = np.append(np.arange(0, len(numbers) - WINDOW, WINDOW // 2), len(numbers) - WINDOW)
            out.append(np.lib.stride_tricks.sliding_window_view(numbers, WINDOW)[starts])
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Two gated recurrent layers, one from each end, attention over their states, one logit."""

    def __init__(self, seed: int = SEED) -> None:
        rng, h = np.random.default_rng(seed), HIDDEN
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"att": draw(2 * h, ATTENTION), "ask": draw(ATTENTION), "out": draw(2 * h), "shift": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {f"x{d}": draw(INPUTS, 3 * h), f"u{d}": draw(h, 3 * h), f"c{d}": np.zeros(3 * h, np.float32)}

    def projected(self, rows: np.ndarray) -> dict[str, np.ndarray]:
        """What each word adds to the gates, for either direction."""
        return {d: rows @ self.p[f"x{d}"] + self.p[f"c{d}"] for d in "fb"}

    def states(self, given: dict[str, np.ndarray], numbers: np.ndarray, keep: list | None = None) -> np.ndarray:
        n, t = numbers.shape
        h = HIDDEN
        out = np.empty((t, n, 2 * h), np.float32)
        for side, d in enumerate("fb"):
            u, state = self.p[f"u{d}"], np.zeros((n, h), np.float32)
            for i in range(t) if d == "f" else range(t - 1, -1, -1):
                g, s = given[d][numbers[:, i]], state @ u
                gates = _sigmoid(g[:, : 2 * h] + s[:, : 2 * h])
                z, r = gates[:, :h], gates[:, h:]
                new = np.tanh(g[:, 2 * h :] + r * s[:, 2 * h :])
                if keep is not None:
                    keep.append((side, d, i, state, z, r, s[:, 2 * h :], new))
                state = state + z * (new - state)
                out[i, :, side * h : (side + 1) * h] = state
        return out

    def pooled(self, states: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        seen = np.tanh(states @ self.p["att"])
        asked = seen @ self.p["ask"]
        weight = np.exp(asked - asked.max(axis=0))
        weight /= weight.sum(axis=0)
        pool = np.einsum("tn,tnh->nh", weight, states)
        return pool @ self.p["out"] + self.p["shift"], pool, weight, seen

    def logits(self, given: dict[str, np.ndarray], numbers: np.ndarray) -> np.ndarray:
        return np.concatenate([self.pooled(self.states(given, numbers[i : i + 2048]))[0] for i in range(0, len(numbers), 2048)])

    def gradient(self, rows: np.ndarray, numbers: np.ndarray, label: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Slopes of the mean loss by the parameters, and by the rows of inputs."""
        h, keep, d_rows = HIDDEN, [], np.zeros_like(rows)
        states = self.states(self.projected(rows), numbers, keep)
        logit, pool, weight, seen = self.pooled(states)
        d_logit = ((_sigmoid(logit) - label) / len(label)).astype(np.float32)
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        grad["out"], grad["shift"] = pool.T @ d_logit, d_logit.sum(keepdims=True)
        d_pool = d_logit[:, None] * self.p["out"]
        d_states = weight[:, :, None] * d_pool
        d_weight = np.einsum("nh,tnh->tn", d_pool, states)
        d_asked = weight * (d_weight - (weight * d_weight).sum(axis=0))
        grad["ask"] = np.einsum("tn,tna->a", d_asked, seen)
        d_seen = d_asked[:, :, None] * self.p["ask"] * (1 - seen * seen)
        grad["att"] = np.einsum("tnh,tna->ha", states, d_seen)
        d_states += d_seen @ self.p["att"].T
        carry = {d: np.zeros((len(label), h), np.float32) for d in "fb"}
        for side, d, i, before, z, r, s, new in reversed(keep):
            d_state = d_states[i, :, side * h : (side + 1) * h] + carry[d]
            d_new = d_state * z * (1 - new * new)
            d_z = d_state * (new - before) * z * (1 - z)
            d_r = d_new * s * r * (1 - r)
            d_gates = np.concatenate([d_z, d_r, d_new], axis=1)
            d_hidden = np.concatenate([d_z, d_r, d_new * r], axis=1)
            grad[f"u{d}"] += before.T @ d_hidden
            grad[f"x{d}"] += rows[numbers[:, i]].T @ d_gates
            grad[f"c{d}"] += d_gates.sum(axis=0)
            np.add.at(d_rows, numbers[:, i], d_gates @ self.p[f"x{d}"].T)
            carry[d] = d_state * (1 - z) + d_hidden @ self.p[f"u{d}"].T
        return grad, d_rows

    def fit(self, words: Words, codes: Codes, numbers: np.ndarray, label: np.ndarray, steps: int, rng: np.random.Generator) -> None:
        """Adam over batches that draw half from each label; the words' vectors learn along."""
        one, other = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
        mean, square = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            batch = np.concatenate([rng.choice(one, BATCH // 2), rng.choice(other, BATCH // 2)])
            used, at = np.unique(numbers[batch], return_inverse=True)
            own = codes.of(used)
            learned = words.vectors.of_hashes(*own) * (rng.random(len(used)) < 0.5)[:, None]
            learned[used == 0] = 0
            rows = np.concatenate([words.rows[used, :COUNTED], learned], axis=1).astype(np.float32)
            grad, d_rows = self.gradient(rows, at.reshape(numbers[batch].shape), label[batch])
            d_rows[used == 0] = 0
            words.vectors.learn(d_rows[:, COUNTED:], *own)
            for k, g in grad.items():
                g = np.clip(g, -1, 1)
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.99 * square[k] + 0.01 * g * g
                self.p[k] = self.p[k] - RATE * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-6)


class Codes:
    """The hashes of the words that :class:`Words` has numbered, by number."""

    def __init__(self, words: Words) -> None:
        self.bucket, self.lettered, owners, self.buckets = hashed(["", *words])
        self.first = np.searchsorted(owners, np.arange(len(self.bucket) + 1))

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        sizes = self.first[numbers + 1] - self.first[numbers]
        owners = np.repeat(np.arange(len(numbers)), sizes)
        at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(self.first[numbers], sizes)
        return self.bucket[numbers], self.lettered[numbers], owners, self.buckets[at]


@dataclass
class Model:
    evidence: Evidence | None
    vectors: Vectors | None
    network: Network | None
    shift: float  # taken off the logit; without a network the score is this constant

    def scores(self, texts: list[str | None], words: Words | None = None) -> np.ndarray:
        if self.network is None:
            return np.full(len(texts), self.shift)
        words = Words(self.evidence, self.vectors, self.network) if words is None else words
        out = np.zeros(len(texts))
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and size < 1_000_000:
                size += len(texts[to] or "") + 200
                to += 1
            parts = words.windows([t or "" for t in texts[at:to]])
            logits = self.network.logits(words.given, np.concatenate(parts))
            out[at:to] = np.maximum.reduceat(logits, np.append(0, np.cumsum([len(p) for p in parts]))[:-1])
            at = to
        return _sigmoid(out - self.shift)


def trained(texts: list[str], toxic: np.ndarray, part: np.ndarray, seed: int = SEED) -> Model:
    """A model from labelled texts; ``part`` tells those that only train the network."""
    if len(set(toxic.tolist())) < 2:
        return Model(None, None, None, 0.75 if len(toxic) and toxic[0] else 0.25)
    if min(len(set(toxic[part].tolist())), len(set(toxic[~part].tolist()))) < 2:
        part = np.arange(len(texts)) % 3 == 0
        for label in (0, 1):  # deal each label to both
            part[np.flatnonzero(toxic == label)[::2]] = True
            part[np.flatnonzero(toxic == label)[1::2]] = False
    pick = lambda which: [t for t, x in zip(texts, which, strict=True) if x]
    evidence = Evidence.counted(pick(~part), toxic[~part])
    vectors = Vectors()
    words, rng, net = Words(evidence, vectors), np.random.default_rng(seed), Network(seed)
    views, labels = words.windows(pick(part)), toxic[part].astype(np.float32)
    if len(set(labels.tolist())) < 2:
        return Model(None, None, None, float(np.clip(toxic.mean(), 0.01, 0.49)))
    codes = Codes(words)
    vectors.open_to(codes, views)
    telling = words.rows[:, 1] + words.rows[:, 3]

    def given() -> dict[str, np.ndarray]:
        every = np.arange(words.many)
        rows = np.concatenate([words.rows[:, :COUNTED], vectors.of_hashes(*codes.of(every))], axis=1)
        rows[0] = 0
        return net.projected(rows)

    def sample(score) -> tuple[np.ndarray, np.ndarray]:
        chosen, own = [], []
        for v, label in zip(views, labels, strict=True):
            order = np.argsort(-score(v), kind="stable")
            best = order[:1] if label else np.concatenate([order[:2], rng.integers(0, len(v), 2)])
            chosen.append(v[best])
            own.append(np.full(len(best), label, np.float32))
        return np.concatenate(chosen), np.concatenate(own)

    net.fit(words, codes, *sample(lambda v: telling[v].max(axis=1)), STEPS, rng)
    now = given()
    net.fit(words, codes, *sample(lambda v: net.logits(now, v)), STEPS // 2, rng)
    now = given()
    top = np.array([net.logits(now, v).max() for v in views])
    # the shift that separates best: sensitivity plus specificity, the middle of the widest best gap
    order = np.sort(top)
    edges = (order[1:] + order[:-1]) / 2 if len(order) > 1 else order
    value = np.array([(top[labels == 1] > e).mean() + (top[labels == 0] <= e).mean() for e in edges])
    return Model(evidence, vectors.settled(), net, float(np.median(edges[value >= value.max() - 1e-9])))


def learn(docs: DataFrame, labels: DataFrame, *, most_toxic: int = MOST_TOXIC, most_other: int = MOST_OTHER) -> Model:
    """A model from the labelled documents outside the held-out fold, at most so many of a label, chosen by
    a hash of the id, and as many of them, in that order, as MOST_BYTES of text hold. Of a text of more than
    MOST_BYTES // 32 characters a passage of that length teaches, from a place that a hash of the id sets; so
    there are at least four texts of a label, if it has them, and one long text keeps no other out.

    Null labels and texts teach nothing; a document labelled both ways is toxic. Of rows that repeat a
    doc_id the text that is first by content teaches. A null doc_id has no label.
    """
    known = labels.filter(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    by_hash = (F.xxhash64("doc_id"), F.col("doc_id"))
    sample = known.filter("toxic = 1").orderBy(*by_hash).limit(most_toxic).union(known.filter("toxic = 0").orderBy(*by_hash).limit(most_other))
    there = docs.filter(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    there = there.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    longest = max(1, MOST_BYTES // 32)
    place = F.pmod(F.xxhash64("doc_id"), F.greatest(F.length("text") - longest, F.lit(0)) + 1).cast("int") + 1
    there = there.withColumn("text", F.when(F.length("text") > longest, F.substring("text", place, longest)).otherwise(F.col("text")))
    sizes = there.select("doc_id", "toxic", F.octet_length("text").alias("size")).withColumn("sum", F.sum("size").over(Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id")))
    few = sizes.filter(F.col("sum") <= MOST_BYTES // 2).select("doc_id")
    found = there.join(F.broadcast(few), "doc_id").toPandas().sort_values("doc_id")
    part = np.array([zlib.crc32(f"part:{i}".encode()) % 3 == 0 for i in found["doc_id"]], bool)
    return trained(found["text"].tolist(), found["toxic"].to_numpy(np.int64), part)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of ``docs`` (doc_id, text; others are
    ignored).

    Null and empty texts are one window of blanks; a long text is all its windows, some megabytes at a
    time. Repeated rows give repeated rows, an empty table none; a null doc_id is not held out. Without documents of both labels to learn from, all scores are one constant.
    """

    @F.pandas_udf("double")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = Words(model.evidence, model.vectors, model.network) if model.network else None
        for series in texts:
            yield pd.Series(model.scores(series.tolist(), words))

    found = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), of(F.col("text")).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
