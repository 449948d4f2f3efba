"""Toxicity scores by a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as two vectors: one of its own (by a hash of the word) and the maximum over those of its character
n-grams, which carries spelling to words never seen. A gated recurrent layer reads each window of WINDOW
words from both ends; attention weighs its states; a logistic unit scores the window. Windows overlap and cover the
whole text; a text's score is that of its most toxic window, calibrated on texts. Training descends on the highest
windows of each text, beside one drawn at random, by Adam, with half of the words' own vectors hidden in each step. The vectors start from the words' and n-grams' shrunken
log-odds in the training texts.

The fit uses at most TOXIC and CLEAN labelled rows, those with the smallest hashes of doc_id. Null and empty texts
are scored as having no words. Texts of any length are read whole; equal texts have equal scores. Rows of labels
without a label or whose doc_id is no document's are ignored. Only the text makes the score.
Columns other than doc_id and text aren't looked at, whatever their names; an empty table gives no rows, and without
labels every text has the same low score. Of labels of one doc_id that disagree, toxic counts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import only, released, slices, small_batches

WINDOW, STEP = 48, 32
OWN, HIDDEN, BUCKETS = 8, 8, 1 << 16
GRAMS = (3, 4, 5, 6)
#: Labelled rows to train on, at most, by label.
TOXIC, CLEAN = 1200, 2400
REMEMBERED, TOGETHER = 250_000, 3_000_000
WORD = re.compile(r"\w+")
f32 = np.float32
#: Texts that must share a word or an n-gram for it to have a vector.
SEEN = 12
NOTHING = np.zeros(BUCKETS, f32), np.zeros(BUCKETS, bool)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def gram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character n-grams of all words, with < and > around, and where each word's begin."""
    raw = [b"<" + w.encode() + b">" for w in words]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    code = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
    ends = np.cumsum(sizes)
    word = np.repeat(np.arange(len(raw)), sizes)
    left = ends[word] - np.arange(len(code))  # characters from here to the word's end
    found, owners = [], []
    h = code * np.uint32(0x9E3779B1)
    for n in range(2, max(GRAMS) + 1):
        h = (h[: len(code) - n + 1] ^ (h[: len(code) - n + 1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + code[n - 1 :]
        if n in GRAMS:
            here = np.flatnonzero(left[: len(h)] >= n)
            mixed = (h[here] ^ np.uint32(n)) * np.uint32(0xC2B2AE35)
            found.append(((mixed ^ (mixed >> np.uint32(16))) % np.uint32(BUCKETS)).astype(np.int64))
            owners.append(word[here])
    buckets, owner = np.concatenate(found), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return buckets[order], np.searchsorted(owner[order], np.arange(len(raw)))


def word_buckets(words: list[str]) -> np.ndarray:
    return np.fromiter((zlib.crc32(w.encode()) % BUCKETS for w in words), np.int64, len(words))


def spans(n: int) -> list[tuple[int, int]]:
    """The windows of n words; together they cover them all."""
    starts = [0] if n <= WINDOW else [*range(0, n - WINDOW, STEP), n - WINDOW]
    return [(s, min(n, s + WINDOW)) for s in starts]


class Network:
    """Parameters by name in `p`; a window is a row of word numbers, -1 where it has no more words."""

    def __init__(self, p: dict[str, np.ndarray], scale: tuple[float, float] = (1.0, 0.0)):
        self.p, self.scale = p, scale

    @staticmethod
    def fresh(own: tuple[np.ndarray, np.ndarray], gram: tuple[np.ndarray, np.ndarray]) -> Network:
        rng = np.random.default_rng(3)
        draw = lambda *shape, s=0.3: rng.normal(0, s, shape).astype(f32)
        p = {"own": draw(BUCKETS, OWN, s=0.05) * (own[1][:, None]), "gram": draw(BUCKETS, OWN, s=0.05) * (gram[1][:, None])}
        p["own"][:, 0], p["gram"][:, 0] = own[0], gram[0]
        for side in "fb":
            p |= {f"w{side}": draw(2 * OWN, 3 * HIDDEN), f"u{side}": draw(HIDDEN, 3 * HIDDEN), f"c{side}": np.zeros(3 * HIDDEN, f32)}
        return Network(p | {"wa": draw(2 * HIDDEN, HIDDEN), "ba": np.zeros(HIDDEN, f32), "va": draw(HIDDEN), "wo": draw(2 * HIDDEN), "bo": np.zeros(1, f32)})

    def inputs(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), 2 * OWN), f32)
        for i in range(0, len(words), 10_000):
            part = words[i : i + 10_000]
            buckets, first = gram_buckets(part)
            out[i : i + len(part), :OWN] = self.p["own"][word_buckets(part)]
            out[i : i + len(part), OWN:] = np.maximum.reduceat(self.p["gram"][buckets], first, axis=0)
        return out

    def projected(self, x: np.ndarray) -> np.ndarray:
        """What the words give to the gates, for both directions; the last row is for no word."""
        out = np.hstack([x @ self.p[f"w{s}"] + self.p[f"c{s}"] for s in "fb"])
        return np.vstack([out, np.zeros((1, out.shape[1]), f32)])

    def forward(self, given: np.ndarray, rows: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Each window's logit."""
        n, t = rows.shape
        there = rows >= 0
        states = np.zeros((t, n, 2 * HIDDEN), f32)
        steps: dict[str, list] = {"f": [], "b": []}
        for d, side in enumerate("fb"):
            u = self.p[f"u{side}"]
            h = np.zeros((n, HIDDEN), f32)
            columns = slice(d * 3 * HIDDEN, (d + 1) * 3 * HIDDEN)
            for i in range(t) if side == "f" else range(t - 1, -1, -1):
                x, hu = given[rows[:, i], columns], h @ u
                gates = 1 / (1 + np.exp(-(x[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])))
                z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
                new = np.tanh(x[:, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
                m = there[:, i : i + 1]
                after = np.where(m, h + z * (new - h), h)
                if keep is not None:
                    steps[side].append((i, h, hu, z, r, new))
                h = after
                states[i, :, d * HIDDEN : (d + 1) * HIDDEN] = h
        e = np.tanh(states @ self.p["wa"] + self.p["ba"])
        a = np.where(there.T, e @ self.p["va"], f32(-1e9))
        a = np.exp(a - a.max(axis=0)) * there.T
        a /= np.maximum(a.sum(axis=0), 1e-9)
        pooled = (states * a[:, :, None]).sum(axis=0)
        logit = pooled @ self.p["wo"] + self.p["bo"][0]
        if keep is not None:
            keep |= {"states": states, "steps": steps, "e": e, "a": a, "pooled": pooled, "there": there}
        return logit

    def backward(self, k: dict, rows: np.ndarray, d_logit: np.ndarray, words: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of all but the vectors, and those of what the words give to the gates."""
        p, (t, n, _) = self.p, k["states"].shape
        g = {"bo": np.array([d_logit.sum()], f32), "wo": k["pooled"].T @ d_logit}
        d_pool = d_logit[:, None] * p["wo"]
        d_a = (k["states"] * d_pool).sum(axis=2)
        d_states = k["a"][:, :, None] * d_pool
        d_s = k["a"] * (d_a - (k["a"] * d_a).sum(axis=0))
        g["va"] = np.tensordot(d_s, k["e"], 2)
        d_e = d_s[:, :, None] * p["va"] * (1 - k["e"] ** 2)
        g["wa"], g["ba"] = np.tensordot(k["states"], d_e, ((0, 1), (0, 1))), d_e.sum(axis=(0, 1))
        d_states = d_states + d_e @ p["wa"].T
        d_given = np.zeros((words + 1, 6 * HIDDEN), f32)
        for d, side in enumerate("fb"):
            u, d_u = p[f"u{side}"], np.zeros_like(p[f"u{side}"])
            d_h = np.zeros((n, HIDDEN), f32)
            for i, h, hu, z, r, new in reversed(k["steps"][side]):
                d_h = d_h + d_states[i, :, d * HIDDEN : (d + 1) * HIDDEN]
                m = k["there"][:, i : i + 1]
                d_o = d_h * m
                d_new = d_o * z * (1 - new**2)
                d_z = d_o * (new - h) * z * (1 - z)
                d_r = d_new * hu[:, 2 * HIDDEN :] * r * (1 - r)
                d_hu = np.hstack([d_z, d_r, d_new * r])
                d_u += h.T @ d_hu
                d_h = np.where(m, d_o * (1 - z), d_h) + d_hu @ u.T
                np.add.at(d_given, (rows[:, i], slice(d * 3 * HIDDEN, (d + 1) * 3 * HIDDEN)), np.hstack([d_z, d_r, d_new]))
            g[f"u{side}"] = d_u
        d_given[-1] = 0
        return g, d_given

    # -- texts ----------------------------------------------------------------------------------------------

    def logits(self, given: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return np.concatenate([self.forward(given, rows[i : i + 2048]) for i in range(0, len(rows), 2048)]) if len(rows) else np.zeros(0, f32)

    def score(self, logit: np.ndarray) -> np.ndarray:
        return sigmoid(self.scale[0] * logit.astype(float) + self.scale[1])


def rows_of(numbers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The windows of texts given as word numbers, and which text each belongs to."""
    owners, starts, lengths, base = [], [], [], 0
    for i, x in enumerate(numbers):
        for a, b in spans(len(x)):
            owners.append(i)
            starts.append(base + a)
            lengths.append(b - a)
        base += len(x)
    whole = np.concatenate([*numbers, np.full(WINDOW, -1)]).astype(np.int32)
    rows = whole[np.array(starts)[:, None] + np.arange(WINDOW)]
    return np.where(np.arange(WINDOW) < np.array(lengths)[:, None], rows, -1), np.array(owners)


def highest(logit: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    out = np.full(n, -np.inf)
    np.maximum.at(out, owner, logit)
    return out


def log_odds(buckets: Iterable[np.ndarray], y: np.ndarray, weight: float = 4.0) -> tuple[np.ndarray, np.ndarray]:
    """Of each bucket the shrunken log-odds of the label, and whether enough texts have it to learn from."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    seen = np.zeros((2, BUCKETS))
    for b, label in zip(buckets, y, strict=True):
        seen[int(label), np.unique(b)] += 1
    enough = seen.sum(axis=0) >= SEEN
    return np.where(enough, np.log((seen[1] + weight * share) / (seen[0] + weight * (1 - share))) - np.log(share / (1 - share)), 0).astype(f32) / 3, enough


def fit(texts: list[str], labels: list[int], steps: int = 500, batch: int = 48, rate: float = 0.01) -> Network:
    y = np.array(labels, int)
    number: dict[str, int] = {}
    texts_as = [np.array([number.setdefault(w, len(number)) for w in words_of(t)], np.int32) for t in texts]
    vocabulary = list(number)
    del number
    if not vocabulary or y.min() == y.max():
        net = Network.fresh(NOTHING, NOTHING)
        net.scale = (0.0, float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))))
        return net
    blocks = [gram_buckets(vocabulary[i : i + 10_000]) for i in range(0, len(vocabulary), 10_000)]
    grams = np.concatenate([b.astype(np.int32) for b, _ in blocks])
    n_grams = np.concatenate([np.diff(np.append(f, len(b))) for b, f in blocks])
    del blocks
    first = np.cumsum(n_grams) - n_grams

    def grams_of(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The n-grams of some words, by their place in `grams`, and whose they are."""
        n = n_grams[words]
        return np.repeat(first[words] - (np.cumsum(n) - n), n) + np.arange(n.sum()), np.repeat(np.arange(len(words)), n)

    own = word_buckets(vocabulary)
    distinct = [np.unique(x) for x in texts_as]
    own_odds = log_odds((own[x] for x in distinct), y)
    gram_odds = log_odds((grams[grams_of(x)[0]] for x in distinct), y)
    net = Network.fresh(own_odds, gram_odds)
    rows, owner = rows_of(texts_as)
    at = np.searchsorted(owner, np.arange(len(texts) + 1))

    def all_logits() -> np.ndarray:
        """Of all windows, by blocks of texts, so that only a block's words are in memory as what they give to the gates."""
        out = []
        for i in range(0, len(texts), 200):
            part = rows[at[i] : at[min(i + 200, len(texts))]]
            words, local = np.unique(part, return_inverse=True)
            blank = int(words[0] < 0)
            given = net.projected(net.inputs([vocabulary[w] for w in words[blank:]]))
            out.append(net.logits(given, local.reshape(part.shape) - blank))
        return np.concatenate(out)

    rng = np.random.default_rng(5)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    every = max(1, min(100, len(texts) // batch))
    toxic, clean = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    for step in range(steps):
        if step % every == 0:
            logit = all_logits()
            if step == 0:  # no learnt order yet: the windows with the highest vectors' sum
                known = np.concatenate([net.inputs(vocabulary[i : i + 10_000])[:, [0, OWN]].sum(axis=1) for i in range(0, len(vocabulary), 10_000)])
                logit = np.sort(np.append(known, f32(0))[rows], axis=1)[:, -3:].sum(axis=1)
        chosen = np.concatenate([rng.choice(toxic, batch // 2), rng.choice(clean, batch // 2)])
        picked, target = [], []
        for i in chosen:
            own_rows = np.arange(at[i], at[i + 1])
            picked.append(own_rows[logit[own_rows].argmax()])
            target.append(y[i])
            if not y[i]:
                picked.append(rng.choice(own_rows))
                target.append(0)
        part, target = rows[picked], np.array(target, f32)
        words, local = np.unique(part, return_inverse=True)
        words = words[words >= 0]
        local = local.reshape(part.shape) - (part.min() < 0)
        here, of = grams_of(words)
        shown = rng.random(len(words)) < 0.5  # spelling has to do for the other half
        vectors = net.p["gram"][grams[here]]
        x = np.hstack([net.p["own"][own[words]] * shown[:, None], np.maximum.reduceat(vectors, np.searchsorted(of, np.arange(len(words))), axis=0)]).astype(f32)
        kept: dict = {}
        out = net.forward(net.projected(x), local, kept)
        d = ((sigmoid(out) - target) / len(target)).astype(f32)
        g, d_given = net.backward(kept, local, d, len(words))
        d_given = d_given[: len(words)]
        d_x = np.zeros_like(x)
        for k, side in enumerate("fb"):
            part_d = d_given[:, k * 3 * HIDDEN : (k + 1) * 3 * HIDDEN]
            g[f"w{side}"], g[f"c{side}"] = x.T @ part_d, part_d.sum(axis=0)
            d_x += part_d @ net.p[f"w{side}"].T
        g["own"], g["gram"] = np.zeros_like(net.p["own"]), np.zeros_like(net.p["gram"])
        np.add.at(g["own"], own[words], d_x[:, :OWN] * shown[:, None])
        np.add.at(g["gram"], grams[here], d_x[of, OWN:] * (vectors == x[of, OWN:]))
        for k, v in net.p.items():
            m, s = moments[k]
            m += 0.1 * (g[k] - m)
            s += 0.01 * (g[k] ** 2 - s)
            now = rate * (1 - 0.8 * step / steps)
            touched = slice(None) if k not in ("own", "gram") else np.flatnonzero(g[k].any(axis=1) & (own_odds if k == "own" else gram_odds)[1])
            v[touched] -= now * (m[touched] / (1 - 0.9 ** (step + 1))) / (np.sqrt(s[touched] / (1 - 0.99 ** (step + 1))) + 1e-6)
    top = highest(all_logits(), owner, len(texts))
    net.scale = calibrated(top, y)
    return net


def calibrated(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Slope and offset of a logistic regression on one number, by Newton's method with a small penalty."""
    w, features = np.array([1.0, 0.0]), np.column_stack([x, np.ones(len(x))])
    for _ in range(rounds):
        s = sigmoid(features @ w)
        grad = features.T @ (s - y) + 0.02 * (w - [1.0, 0.0])
        hess = (features * (s * (1 - s))[:, None]).T @ features + 0.02 * np.eye(2)
        w = w - np.clip(np.linalg.solve(hess, grad), -1, 1)
    return float(max(w[0], 0.05)), float(w[1])


class Scorer:
    """Scores texts; remembers, for a while, what each word gives to the gates."""

    def __init__(self, net: Network):
        self.net, self.number, self.given = net, {}, net.projected(np.zeros((0, 2 * OWN), f32))[:0]

    def scores(self, texts: list[str]) -> np.ndarray:
        out = []
        for start, end in slices(texts, TOGETHER):
            said = [words_of(t) for t in texts[start:end]]
            wanted = set().union(*said)
            if len(self.number) + len(wanted) > REMEMBERED:
                self.number, self.given = {}, self.given[:0]
            new = list(wanted - self.number.keys())
            if new:
                self.given = np.vstack([self.given, self.net.projected(self.net.inputs(new))[:-1]])
                self.number |= zip(new, range(len(self.number), len(self.number) + len(new)), strict=True)
            number = self.number.__getitem__
            rows, owner = rows_of([np.fromiter(map(number, s), np.int64, len(s)) for s in said])
            logit = self.net.logits(np.vstack([self.given, np.zeros((1, self.given.shape[1]), f32)]), rows)
            out.append(self.net.score(highest(logit, owner, end - start)))
        return np.concatenate(out) if out else np.zeros(0)


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def trained(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC, clean: int = CLEAN) -> Network:
    """A network fitted to labelled rows of docs that aren't held out."""
    marked = only(labels, doc_id="long", toxic="int").where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))  # labels that disagree: toxic
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = marked.where("toxic = 1").orderBy(*order).limit(toxic).unionAll(marked.where("toxic = 0").orderBy(*order).limit(clean))
    rows = only(docs, doc_id="long", text="string").join(F.broadcast(sample), "doc_id").select("doc_id", "text", "toxic").collect()
    rows = sorted({r["doc_id"]: r for r in sorted(rows, key=lambda r: r["text"] or "")}.values(), key=lambda r: r["doc_id"])
    net = fit([r["text"] or "" for r in rows], [r["toxic"] for r in rows]) if rows else Network.fresh(NOTHING, NOTHING)
    del rows, sample
    released()
    return net


def scored(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, score, predicted) of every row."""
    shipped = docs.sparkSession.sparkContext.broadcast((net.p, net.scale))  # of fixed size: two tables of BUCKETS vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Network(*shipped.value))
        for batch in batches:
            s = scorer.scores([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return only(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, score double, predicted int")


def kept(docs: DataFrame, net: Network) -> DataFrame:
    """The rows of docs, all columns, that aren't predicted to be toxic; decided beside the row, without a join."""
    shipped = docs.sparkSession.sparkContext.broadcast((net.p, net.scale))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Network(*shipped.value))
        for batch in batches:
            s = scorer.scores([t or "" for t in batch.column("text").to_pylist()])
            yield batch.filter(pa.array(s < 0.5))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
