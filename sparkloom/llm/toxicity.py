"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained here in numpy.

A token's input is a word embedding beside a character embedding (the sum over its five-byte grams, hashed). Two gated
recurrent passes read a window of `WINDOW` tokens, attention pools their states, and a logistic unit scores the window.
All windows of a text, each overlapping the next by half, are scored; the text's score is its highest.

The model is fitted on the driver to at most `SAMPLE_ROWS` labelled rows of at most `SAMPLE_CHARS` characters (the
lowest hashes of doc_id; never a held-out row), as multiple-instance learning: a toxic text answers for its highest
window, a clean one for several. Embeddings begin as log odds over the labelled texts; while a text trains the network,
its own label is left out of the odds of its words, so that the network can't learn what the input already tells. It has
a fixed size and is broadcast. Labels, lang, source and doc_id are no inputs.

Edge cases: null or empty text has one empty window and so a score; without labelled rows of both classes every score is
the share of toxic labels (0 without any); a null doc_id is not held out; rows that repeat are scored each; an empty
table gives an empty table; other columns of the input are ignored.
"""

from __future__ import annotations

import string
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, whole_text

WINDOW, STRIDE = 32, 16
SAMPLE_ROWS, SAMPLE_CHARS = 4000, 12_000
THRESHOLD = 0.7
WORD_BITS, GRAM_BITS, DIM, HIDDEN = 17, 18, 6, 8
EPOCHS, BATCH, RATE = 4, 256, 0.02
#: Small samples are gone over more often.
MOST_EPOCHS, FULL_SAMPLE = 16, 3000
#: Of embeddings; low, so that a rare word keeps near what its counts say.
EMBEDDING_RATE = 0.003
#: Words of a worker's cache of inputs.
CACHE_WORDS = 60_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)  # fixed value: the odd number next to 2^64 over the golden ratio
_EDGES = string.punctuation + "«»“”„‘’…–—¿¡"


def tokens(text: str) -> list[str]:
    return text.lower().split()


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets, and all words' gram buckets in a row with where each word's begin."""
    bare = [w.strip(_EDGES) or w for w in words]
    raw = [b"^%b$" % w.encode("utf-8", "surrogatepass") for w in bare]
    word = np.array([zlib.crc32(w) & ((1 << WORD_BITS) - 1) for w in raw], dtype=np.int64)
    size = np.array([len(w) for w in raw], dtype=np.int64)
    start = np.cumsum(size) - size
    data = b"".join(raw) + bytes(8)
    count = np.maximum(1, size - 4)
    first = np.cumsum(count) - count
    at = np.repeat(start - first, count) + np.arange(count.sum())
    values = np.ndarray((len(data) - 8,), dtype="<u8", buffer=data, strides=(1,))[at]
    bits = np.minimum(np.repeat(size, count), 5).astype(np.uint64) * np.uint64(8)
    grams = ((values & ((np.uint64(1) << bits) - np.uint64(1))) * _MULTIPLIER) >> np.uint64(64 - GRAM_BITS)
    return word, grams.astype(np.int64), first


def window_starts(n: int) -> range:
    """First tokens of the windows of n tokens: every STRIDE, until the last token is in one."""
    return range(0, max(1, n - WINDOW + STRIDE), STRIDE)


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters: embeddings `word`, `gram`; of each direction `Wx`, `b`, `U`; attention `A`, `a`, `v`; output `o`, `c`."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        f = lambda *s: (r.standard_normal(s) / s[0] ** 0.5).astype(np.float32)
        self.word, self.gram = (0.02 * r.standard_normal((1 << bits, DIM)).astype(np.float32) for bits in (WORD_BITS, GRAM_BITS))
        self.dense = {"A": f(2 * HIDDEN, HIDDEN), "a": np.zeros(HIDDEN, np.float32), "v": f(HIDDEN), "o": f(2 * HIDDEN), "c": np.float32([-1.0])}
        for d in "fb":
            self.dense |= {f"W{d}": f(2 * DIM, 3 * HIDDEN), f"b{d}": np.zeros(3 * HIDDEN, np.float32), f"U{d}": f(HIDDEN, 3 * HIDDEN)}

    def inputs(self, feats) -> np.ndarray:
        """Each word's input: its embedding beside the scaled sum of its grams'."""
        word, grams, first = feats
        if not len(word):
            return np.zeros((0, 2 * DIM), np.float32)
        count = np.diff(np.append(first, len(grams)))
        return np.hstack([self.word[word], np.add.reduceat(self.gram[grams], first, axis=0) / np.sqrt(count)[:, None]]).astype(np.float32)

    def _pass(self, x, mask, d, keep):
        """States (n, t, HIDDEN) of one direction over x (n, t, 3 * HIDDEN), and what its gradient needs."""
        n, t, h3 = x.shape
        H, U = HIDDEN, self.dense[f"U{d}"]
        h, states, held = np.zeros((n, H), np.float32), np.empty((n, t, H), np.float32), []
        for k in range(t) if d == "f" else range(t - 1, -1, -1):
            g = h @ U
            zr = _sigmoid(x[:, k, : 2 * H] + g[:, : 2 * H])
            z, r = zr[:, :H], zr[:, H:]
            new = np.tanh(x[:, k, 2 * H :] + r * g[:, 2 * H :])
            m = mask[:, k, None]
            out = new + z * (h - new)
            if not m.all():
                out = np.where(m, out, h)
            if keep:
                held.append((k, h, z, r, new, g[:, 2 * H :], m))
            states[:, k] = h = out
        return states, held

    def forward(self, xf, xb, mask, keep=False):
        """Logits of windows; xf, xb: gate inputs of either direction."""
        p = self.dense
        sf, hf = self._pass(xf, mask, "f", keep)
        sb, hb = self._pass(xb, mask, "b", keep)
        s = np.concatenate([sf, sb], axis=2)
        u = np.tanh(s @ p["A"] + p["a"])
        e = np.where(mask, u @ p["v"], -1e9)
        w = np.exp(e - e.max(axis=1, keepdims=True)) * mask
        w /= np.maximum(w.sum(axis=1, keepdims=True), 1e-9)
        pooled = (w[:, :, None] * s).sum(axis=1)
        logit = pooled @ p["o"] + p["c"][0]
        return (logit, (s, u, w, pooled, hf, hb)) if keep else logit

    def gates(self, x: np.ndarray):
        return tuple(x @ self.dense[f"W{d}"] + self.dense[f"b{d}"] for d in "fb")

    def gradient(self, x, mask, y, weight):
        """Gradients of the weighted log loss by each dense parameter and by x (n, t, 2 * DIM)."""
        p, H = self.dense, HIDDEN
        xf, xb = self.gates(x)
        logit, (s, u, w, pooled, hf, hb) = self.forward(xf, xb, mask, True)
        dl = ((_sigmoid(logit) - y) * weight / len(y)).astype(np.float32)
        g = {"o": pooled.T @ dl, "c": np.float32([dl.sum()])}
        dp = dl[:, None] * p["o"]
        dw = (s * dp[:, None, :]).sum(axis=2)
        de = w * (dw - (w * dw).sum(axis=1, keepdims=True))
        g["v"] = (u * de[:, :, None]).sum(axis=(0, 1))
        du = de[:, :, None] * p["v"] * (1 - u * u)
        g["A"], g["a"] = np.tensordot(s, du, ((0, 1), (0, 1))), du.sum(axis=(0, 1))
        ds = w[:, :, None] * dp[:, None, :] + du @ p["A"].T
        dx = np.zeros_like(x)
        for d, held, part in (("f", hf, ds[:, :, :H]), ("b", hb, ds[:, :, H:])):
            U, W = p[f"U{d}"], p[f"W{d}"]
            gU, gx, dh = np.zeros_like(U), np.zeros((*x.shape[:2], 3 * H), np.float32), np.zeros((len(y), H), np.float32)
            for k, h, z, r, new, gn, m in reversed(held):
                dh = dh + part[:, k]
                live = dh * m
                dnew = live * (1 - z) * (1 - new * new)
                dz = live * (h - new) * z * (1 - z)
                dr = dnew * gn * r * (1 - r)
                gx[:, k] = np.hstack([dz, dr, dnew])
                back = np.hstack([dz, dr, dnew * r])
                gU += h.T @ back
                dh = np.where(m, live * z, dh) + back @ U.T
            g[f"U{d}"], g[f"b{d}"] = gU, gx.sum(axis=(0, 1))
            g[f"W{d}"] = np.tensordot(x, gx, ((0, 1), (0, 1)))
            dx += gx @ W.T
        return g, dx


def _windows(counts: list[int]):
    """(text, first token) of every window of texts of so many tokens."""
    owner, start = [], []
    for k, n in enumerate(counts):
        s = window_starts(n)
        owner += [k] * len(s)
        start += s
    return np.array(owner, dtype=np.int64), np.array(start, dtype=np.int64)


def _odds(clean: np.ndarray, toxic: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Log odds of buckets that so many clean and toxic texts hold, the fewer the nearer to 0."""
    both = clean + toxic
    odds = np.log((toxic + 0.3) / n[1]) - np.log((clean + 0.3) / n[0])
    return np.where(both >= 3, np.clip(odds, -4, 6) / 4 * both / (both + 6), 0).astype(np.float32)


def train(texts: list[str], labels: list[int], seed: int = 7) -> Network:
    r, net = np.random.default_rng(seed), Network(seed)
    place: dict[str, int] = {}
    ids = []
    for t in texts:
        words = tokens(t)
        ids.append(np.fromiter((place.setdefault(w, len(place)) for w in words), dtype=np.int64, count=len(words)))
    word, grams, first = feats = features(list(place) or [""])
    ends = np.append(first[1:], len(grams))
    y = np.array(labels)
    # first coordinates begin as shrunk log odds over the texts that hold a bucket; without[label]: what they are less, if one such text is left out
    n, without = np.bincount(y, minlength=2) + 1, []
    for table, buckets in ((net.word, lambda k: word[k]), (net.gram, lambda k: np.concatenate([grams[first[i] : ends[i]] for i in k]) if len(k) else k)):
        seen = np.zeros((2, len(table)), np.float32)
        for k, label in zip(ids, y):
            seen[label, np.unique(buckets(np.unique(k)))] += 1
        odds = _odds(seen[0], seen[1], n)
        table[:, 0] += odds
        without.append([_odds(np.maximum(seen[0] - 1, 0), seen[1], n) - odds, _odds(seen[0], np.maximum(seen[1] - 1, 0), n) - odds])
    counts = ends - first
    without = [(w[word], np.add.reduceat(g[grams], first) / np.sqrt(counts)) for w, g in zip(*without)]

    def left_out(x, k, label):
        """Inputs x of words k as a text of the label sees them: without itself."""
        x = x.copy()
        x[..., 0] += without[label][0][k]
        x[..., DIM] += without[label][1][k]
        return x

    owner, start = _windows([len(k) for k in ids])
    offset = np.cumsum([0, *map(len, ids)])
    flat = np.concatenate([*ids, np.zeros(1, dtype=np.int64)])
    length = np.array([len(k) for k in ids])

    def view(k):
        at = start[k, None] + np.arange(WINDOW)
        mask = at < length[owner[k], None]
        return flat[np.where(mask, offset[owner[k], None] + at, len(flat) - 1)], mask

    every = np.arange(len(place) or 1)
    prior = np.stack([left_out(net.inputs(feats), every, label)[:, [0, DIM]].sum(axis=1) for label in (0, 1)])
    score = np.concatenate([np.where(m, prior[y[owner[k], None], t], -9).max(axis=1) for k in np.array_split(np.arange(len(owner)), max(1, len(owner) // 4096)) for t, m in [view(k)]])
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.dense.items()}
    squares = {"word": np.full(len(net.word), 1e-8, np.float32), "gram": np.full(len(net.gram), 1e-8, np.float32)}
    step = 0
    for _ in range(min(MOST_EPOCHS, max(EPOCHS, EPOCHS * FULL_SAMPLE // len(ids)))):
        order = np.lexsort((-score, owner))
        top = order[np.searchsorted(owner[order], np.arange(len(ids)))]  # each text's highest window
        clean = np.flatnonzero(y[owner] == 0)
        pick = np.unique(np.concatenate([top, r.choice(clean, min(len(clean), len(ids)), replace=False)]))
        positives = max(1, int(y.sum()))
        weight_of = np.where(y[owner] == 1, max(1.0, 0.3 * len(pick) / positives), 1.0)
        r.shuffle(pick)
        for k in np.array_split(pick, max(1, len(pick) // BATCH)):
            tok, mask = view(k)
            uniq, inverse = np.unique(tok, return_inverse=True)
            inverse = inverse.reshape(tok.shape)
            count = ends[uniq] - first[uniq]
            part = np.concatenate([grams[first[i] : ends[i]] for i in uniq])
            sub = (word[uniq], part, np.cumsum(count) - count)
            own = net.inputs(sub)
            x = np.stack([left_out(own, uniq, label) for label in (0, 1)])[y[owner[k], None], inverse]
            g, dx = net.gradient(x, mask, y[owner[k]], weight_of[k])
            step += 1
            for name, grad in g.items():  # Adam
                m, v = moments[name]
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                net.dense[name] -= RATE / 2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            each = np.zeros((len(uniq), 2 * DIM), np.float32)
            np.add.at(each, inverse.ravel(), (dx * mask[:, :, None]).reshape(-1, 2 * DIM))
            for name, rows, grad in (("word", sub[0], each[:, :DIM]), ("gram", part, np.repeat(each[:, DIM:] / np.sqrt(count)[:, None], count, axis=0))):
                b, at = np.unique(rows, return_inverse=True)
                total = np.zeros((len(b), DIM), np.float32)
                np.add.at(total, at, grad)
                squares[name][b] += (total * total).mean(axis=1)  # Adagrad
                getattr(net, name)[b] -= EMBEDDING_RATE * total / np.sqrt(squares[name][b])[:, None]
        score = np.empty(len(owner))
        for label in (0, 1):
            gates = net.gates(left_out(net.inputs(feats), every, label))
            mine = np.flatnonzero(y[owner] == label)
            for k in np.array_split(mine, max(1, len(mine) // 2048)):
                t, m = view(k)
                score[k] = net.forward(gates[0][t], gates[1][t], m)
    return net


class Scorer:
    """Scores batches of texts; keeps the gate inputs of words it has met."""

    def __init__(self, net: Network):
        self.net = net
        self._empty()

    def _empty(self):
        self.place: dict[str, int] = {}
        self.rows, self.used = np.zeros((2, 1024, 3 * HIDDEN), np.float32), 0

    def _ids(self, words: list[str]) -> np.ndarray:
        new = [w for w in dict.fromkeys(words) if w not in self.place]
        if self.used + len(new) > CACHE_WORDS and self.used:
            self._empty()
            new = list(dict.fromkeys(words))
        if new:
            gates = self.net.gates(self.net.inputs(features(new)))
            need = self.used + len(new)
            if need > self.rows.shape[1]:
                grown = np.zeros((2, max(need, 2 * self.rows.shape[1]), 3 * HIDDEN), np.float32)
                grown[:, : self.used] = self.rows[:, : self.used]
                self.rows = grown
            self.rows[0, self.used : need], self.rows[1, self.used : need] = gates
            self.place.update(zip(new, range(self.used, need)))
            self.used = need
        return np.fromiter(map(self.place.__getitem__, words), dtype=np.int64, count=len(words))

    def _score(self, split: list[list[str]]) -> np.ndarray:
        length = np.array([len(w) for w in split])
        flat = self._ids([w for words in split for w in words])
        offset = np.cumsum(length) - length
        owner, start = _windows(length.tolist())
        best = np.full(len(split), -np.inf)
        for s in range(0, len(owner), 2048):
            o, at = owner[s : s + 2048], start[s : s + 2048, None] + np.arange(WINDOW)
            mask = at < length[o, None]
            tok = flat[np.where(mask, offset[o, None] + at, 0)] if len(flat) else np.zeros(at.shape, dtype=np.int64)
            np.maximum.at(best, o, self.net.forward(self.rows[0][tok], self.rows[1][tok], mask))
        return _sigmoid(best)

    def score(self, texts: list[str]) -> np.ndarray:
        out, group, size = [], [], 0
        for words in map(tokens, texts):
            group.append(words)
            size += len(words)
            if size > 60_000:
                out.append(self._score(group))
                group, size = [], 0
        if group:
            out.append(self._score(group))
        return np.concatenate(out) if out else np.zeros(0)


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS):
    """A broadcast network, or the share of toxic labels where it can't be trained."""
    known = labels.filter("doc_id is not null and toxic in (0, 1)").filter(~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("label_id"), "toxic")
    sample = known.orderBy(F.xxhash64("label_id"), "label_id", "toxic").limit(rows)
    texts = docs.select("doc_id", "text").filter(F.length("text") <= chars).join(F.broadcast(sample), F.col("doc_id") == F.col("label_id"))
    got = texts.select("doc_id", "text", "toxic").orderBy("doc_id", "toxic", "text").limit(rows).collect()
    toxic = [r["toxic"] for r in got]
    model = train([r["text"] for r in got], toxic) if 0 < sum(toxic) < len(toxic) else float(np.mean(toxic)) if toxic else 0.0
    return docs.sparkSession.sparkContext.broadcast(model)


_SCORERS: dict[int, Scorer] = {}


def _scores(model, texts: list[str]) -> np.ndarray:
    if not isinstance(model.value, Network):
        return np.full(len(texts), model.value)
    key = id(model.value)
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = Scorer(model.value)
    return _SCORERS[key].score(texts)


def score_documents(docs: DataFrame, model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of each document."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(model, batch.column(1).to_pylist()), pa.float64())], names=["doc_id", "score"])

    rows = map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")), run, "doc_id long, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def clean_documents(docs: DataFrame, model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs (every column) whose score is below the threshold."""
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            scores = _scores(model, [t or "" for t in batch.column(at).to_pylist()])
            yield batch.filter(pa.array(scores < threshold, pa.bool_()))

    return map_arrow(docs, run, docs.schema)
