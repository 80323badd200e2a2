"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A text is cut into overlapping windows of words. A word enters as a learned vector (zero when the
labelled sample does not know it) beside the mean of its learned character-trigram vectors. Two
gated recurrent passes read the window, attention pools their states, and a logistic unit scores
the window. A text's score is its worst window's, calibrated on the labelled sample.

Labels belong to texts, not windows, so training is by multiple instances: the window of a toxic
text that stands for it is picked by its words' association with the label at first and by the network later.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtrace.llm._common import lean

#: Words of a window, and words between the starts of two windows.
WIDTH, STRIDE = 24, 12
HIDDEN, WORD_DIM, CHAR_DIM, ATTENTION = 8, 8, 8, 8
TRIGRAMS = 4096
#: Bounds of the labelled sample (texts of each class, characters of a text that it may hold) and of
#: the vocabulary learned from it.
SAMPLE_PER_CLASS, SAMPLE_CHARS, VOCABULARY = 1500, 200_000, 20_000
STEPS, BATCH, RATE = 300, 192, 0.01
#: Distinct words whose inputs a task keeps at once, and characters of texts taken together.
CACHE, BLOCK = 120_000, 500_000
STRIP = b".,!?;:\"'()[]{}#*$%&|<>-_/\\"
F32 = np.float32


def _split(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").split() if text else []


def _trigrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(trigram ids of all words in a row, start of each word's ids); words are not empty."""
    a = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint32)
    code = ((a[:-2] * np.uint32(0x9E3779B1)) ^ (a[1:-1] * np.uint32(0x85EBCA77)) ^ (a[2:] * np.uint32(0xC2B2AE3D))) * np.uint32(0x27D4EB2F)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    start = np.concatenate([[0], np.cumsum(lens + 1)[:-1]])
    within = np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens)
    return (code[np.repeat(start, lens) + within] >> np.uint32(32 - 12)).astype(np.int64) % TRIGRAMS, np.cumsum(lens) - lens


def sigmoid(x):
    return F32(1) / (F32(1) + np.exp(-x))


@dataclass
class Network:
    """Weights, the vocabulary and the calibration; small by the bounds above."""

    vocabulary: dict[bytes, int]
    p: dict[str, np.ndarray]
    scale: float = 1.0
    shift: float = 0.0

    @staticmethod
    def new(vocabulary: dict[bytes, int], seed: int = 7) -> Network:
        r = np.random.default_rng(seed)
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        u = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(F32)
        p = {"ew": np.zeros((len(vocabulary) + 1, WORD_DIM), F32), "ec": np.zeros((TRIGRAMS, CHAR_DIM), F32)}
        for k in "fb":
            p |= {f"w{k}": u(d, 3 * h), f"u{k}": u(h, 3 * h), f"b{k}": np.zeros(3 * h, F32)}
        p |= {"wa": u(2 * h, ATTENTION), "ba": np.zeros(ATTENTION, F32), "v": u(ATTENTION), "o": u(2 * h), "c": np.zeros(1, F32)}
        return Network(vocabulary, p)

    def inputs(self, words: list[bytes]) -> tuple[np.ndarray, ...]:
        """(inputs, word ids, trigram ids, their starts); words come stripped and lower-cased."""
        ids = np.fromiter((self.vocabulary.get(w, 0) for w in words), np.int64, len(words))
        tri, start = _trigrams(words)
        n = np.diff(np.concatenate([start, [len(tri)]]))
        char = np.add.reduceat(self.p["ec"][tri], start, axis=0) / n[:, None].astype(F32)
        return np.concatenate([self.p["ew"][ids], char], axis=1), ids, tri, start

    def run(self, projected: dict[str, np.ndarray], ids: np.ndarray, keep: bool = False):
        """Logits of the windows; ids: rows of projected inputs, 0 for padding."""
        p, (n, t), h = self.p, ids.shape, HIDDEN
        real = (ids > 0).astype(F32)
        states = np.empty((t, n, 2 * h), F32)
        trace = {}
        for k, order, at in (("f", range(t), slice(0, h)), ("b", range(t - 1, -1, -1), slice(h, 2 * h))):
            s = np.zeros((n, h), F32)
            proj, u = projected[k], p[f"u{k}"]
            for j in order:
                x, m = proj[ids[:, j]], real[:, j : j + 1]
                hu = s @ u
                zr = sigmoid(x[:, : 2 * h] + hu[:, : 2 * h])
                z, r = zr[:, :h], zr[:, h:]
                c = np.tanh(x[:, 2 * h :] + r * hu[:, 2 * h :])
                if keep:
                    trace[k, j] = (s, z, r, c, hu[:, 2 * h :])
                s = s + m * (F32(1) - z) * (c - s)
                states[j, :, at] = s
        a = np.tanh(states.reshape(t * n, 2 * h) @ p["wa"] + p["ba"])
        e = (a @ p["v"]).reshape(t, n) + (real.T - F32(1)) * F32(30)
        e = np.exp(e - e.max(0))
        w = e * real.T
        w /= np.maximum(w.sum(0), F32(1e-9))
        pooled = np.einsum("tn,tnd->nd", w, states)
        out = pooled @ p["o"] + p["c"]
        return (out, (real, states, trace, a, w, pooled)) if keep else out

    def project(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """Input parts of the gates, one row per word after a zero row for padding."""
        return {k: np.concatenate([np.zeros((1, 3 * HIDDEN), F32), x @ self.p[f"w{k}"] + self.p[f"b{k}"]]) for k in "fb"}

    def gradients(self, words: list[bytes], ids: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, (n, t), h = self.p, ids.shape, HIDDEN
        x, wid, tri, start = self.inputs(words)
        proj = self.project(x)
        out, (real, states, trace, a, w, pooled) = self.run(proj, ids, keep=True)
        g = {}
        dl = (sigmoid(out) - y) / F32(n)
        g["o"], g["c"] = pooled.T @ dl, dl.sum(keepdims=True)
        dp = dl[:, None] * p["o"]
        ds = w[:, :, None] * dp
        dw = np.einsum("tnd,nd->tn", states, dp)
        de = w * (dw - (w * dw).sum(0))
        g["v"] = (a * de.reshape(-1, 1)).sum(0)
        da = de.reshape(-1, 1) * p["v"] * (F32(1) - a * a)
        g["wa"], g["ba"] = states.reshape(t * n, 2 * h).T @ da, da.sum(0)
        ds = ds + (da @ p["wa"].T).reshape(t, n, 2 * h)
        dx = np.zeros_like(x)
        for k, order, at in (("f", range(t - 1, -1, -1), slice(0, h)), ("b", range(t), slice(h, 2 * h))):
            u, back = p[f"u{k}"], np.zeros((n, h), F32)
            dproj, du = np.zeros_like(proj[k]), np.zeros_like(u)
            for j in order:
                s, z, r, c, hn = trace[k, j]
                d = back + ds[j, :, at]
                m = real[:, j : j + 1]
                dc = d * m * (F32(1) - z) * (F32(1) - c * c)
                dz = d * m * (s - c) * z * (F32(1) - z)
                dr = dc * hn * r * (F32(1) - r)
                gates = np.concatenate([dz, dr, dc], axis=1)
                rec = np.concatenate([dz, dr, dc * r], axis=1)
                np.add.at(dproj, ids[:, j], gates)
                du += s.T @ rec
                back = d * (F32(1) - m * (F32(1) - z)) + rec @ u.T
            g[f"u{k}"], g[f"w{k}"], g[f"b{k}"] = du, x.T @ dproj[1:], dproj[1:].sum(0)
            dx += dproj[1:] @ p[f"w{k}"].T
        g["ew"], g["ec"] = np.zeros_like(p["ew"]), np.zeros_like(p["ec"])
        np.add.at(g["ew"], wid, dx[:, :WORD_DIM])
        g["ew"][0] = 0
        lens = np.diff(np.concatenate([start, [len(tri)]]))
        np.add.at(g["ec"], tri, np.repeat(dx[:, WORD_DIM:] / lens[:, None].astype(F32), lens, axis=0))
        return g


def normal(word: bytes) -> bytes:
    return word.strip(STRIP).lower() or word


def windows(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text of each window, its start within the text) for texts of n words; one window at least."""
    k = 1 + np.maximum(0, -(-(n - WIDTH) // STRIDE))
    text = np.repeat(np.arange(len(n)), k)
    return text, (np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)) * STRIDE


class Inputs(dict):
    """Raw word -> row of the projected inputs; new words wait until flush()."""

    def __init__(self, net: Network) -> None:
        super().__init__()
        self.net, self.new = net, []
        self.proj = net.project(np.zeros((0, WORD_DIM + CHAR_DIM), F32))

    def __missing__(self, word: bytes) -> int:
        self.new.append(normal(word))
        self[word] = row = len(self) + 1
        return row

    def flush(self) -> dict[str, np.ndarray]:
        if self.new:
            more = self.net.project(self.net.inputs(self.new)[0])
            self.proj = {k: np.concatenate([v, more[k][1:]]) for k, v in self.proj.items()}
            self.new = []
        return self.proj


def worst(net: Network, texts: list, cache: Inputs | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(largest window logit, start of that window) of each text, whole texts."""
    cache = Inputs(net) if cache is None else cache
    split = [_split(t) for t in texts]
    n = np.fromiter(map(len, split), np.int64, len(split))
    flat = np.fromiter((cache[w] for ws in split for w in ws), np.int64, int(n.sum()))
    proj = cache.flush()
    flat = np.concatenate([flat, [0]])
    text, start = windows(n)
    base, logits = np.cumsum(n) - n, np.empty(len(text), F32)
    for i in range(0, len(text), 4096):
        k, s = text[i : i + 4096], start[i : i + 4096]
        at = s[:, None] + np.arange(WIDTH)
        ids = np.where(at < n[k][:, None], flat[np.minimum(base[k][:, None] + at, len(flat) - 1)], 0)
        logits[i : i + 4096] = net.run(proj, ids)
    if not len(text):
        return np.zeros(0, F32), np.zeros(0, np.int64)
    first = np.searchsorted(text, np.arange(len(n)))
    top = np.maximum.reduceat(logits, first)
    hit = np.flatnonzero(logits >= top[text])
    where = hit[np.searchsorted(text[hit], np.arange(len(n)))]
    return top, start[where]


def worst_of(net: Network, texts: list) -> tuple[np.ndarray, np.ndarray]:
    """worst() in blocks of texts, each with a cache of its own."""
    got = [worst(net, texts[i : i + 100]) for i in range(0, len(texts), 100)]
    return tuple(np.concatenate([g[k] for g in got]) if got else np.zeros(0) for k in (0, 1))


def train(texts: list[str], toxic: list[int], seed: int = 7, steps: int = STEPS) -> Network:
    """Fit on labelled texts. Without both classes the network scores every text alike."""
    r = np.random.default_rng(seed)
    one: dict[bytes, bytes] = {}  # each word is held once
    split = [[one.setdefault(w, w) for w in map(normal, _split(t))] for t in texts]
    df = [Counter(), Counter()]
    for ws, y in zip(split, toxic, strict=True):
        df[y].update(set(ws))
    seen = df[0] + df[1]
    names = sorted((w for w, k in seen.items() if k >= 5), key=lambda w: (-seen[w], w))[:VOCABULARY]
    net = Network.new({w: k + 1 for k, w in enumerate(names)}, seed)
    size = [max(1, sum(y == k for y in toxic)) for k in (0, 1)]
    rate = sum(toxic) / max(1, len(toxic))
    if not 0 < sum(toxic) < len(toxic):
        net.p["o"][:] = 0
        net.shift = 4.0 if rate == 1 and toxic else -4.0
        net.scale = 0.0
        return net
    # how far a word's texts are toxic beyond chance, in standard deviations: rare words can't lead
    one.clear()
    odds = {w: (df[1][w] - seen[w] * rate) / (seen[w] * rate + 0.5) ** 0.5 for w in names}
    # word vectors start from that association; all else is learned
    net.p["ew"][1:, 0] = [3 * np.tanh(max(0.0, odds[w] - 2) / 4) for w in names]

    def cut(i: int, start: int) -> list[bytes]:
        return split[i][start : start + WIDTH]

    def by_odds(i: int) -> int:
        starts = windows(np.array([len(split[i])]))[1]
        return int(max(starts, key=lambda s: max((odds.get(w, 0.0) for w in cut(i, int(s))), default=0.0)))

    adam = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    pos, neg = [i for i, y in enumerate(toxic) if y and split[i]], [i for i, y in enumerate(toxic) if not y and split[i]]
    if not pos or not neg:
        return net
    pick = {i: by_odds(i) for i in [*pos, *neg]}
    first = dict(pick)
    for step in range(steps):
        if step in (steps // 2, 3 * steps // 4):  # from here on the network itself says which window stands for a text
            for i, s in zip([*pos, *neg], worst_of(net, [texts[i] for i in [*pos, *neg]])[1], strict=True):
                pick[i] = int(s)
        rows, y = [], []
        for k in range(BATCH):
            if k % 3 == 0:
                i = pos[r.integers(len(pos))]
                rows.append(cut(i, (pick if k % 2 else first)[i]))
            else:
                i = neg[r.integers(len(neg))]
                rows.append(cut(i, pick[i] if k % 3 == 1 else STRIDE * int(r.integers(1 + max(0, len(split[i]) - 1) // STRIDE))))
            y.append(k % 3 == 0)
        words = sorted({w for ws in rows for w in ws})
        row = {w: k + 1 for k, w in enumerate(words)}
        ids = np.zeros((len(rows), WIDTH), np.int64)
        for k, ws in enumerate(rows):
            ids[k, : len(ws)] = [row[w] for w in ws]
        got = net.gradients(words, ids, np.array(y, F32))
        norm = float(np.sqrt(sum(float((g * g).sum()) for k, g in got.items())))
        for k, g in got.items():
            g *= F32(min(1.0, 1.0 / max(norm, 1e-9)))
            m, v = adam[k]
            m += F32(0.1) * (g - m)
            v += F32(0.01) * (g * g - v)
            fix = RATE * (1 - step / steps) * np.sqrt(1 - 0.99 ** (step + 1)) / (1 - 0.9 ** (step + 1))
            net.p[k] -= F32(fix) * m / (np.sqrt(v) + F32(1e-6)) + (F32(1e-4) * net.p[k] if k in ("ew", "ec") else F32(0))
    some = [*pos, *neg]
    top, want = worst_of(net, [texts[i] for i in some])[0].astype(float), np.repeat([1.0, 0.0], [len(pos), len(neg)])
    weight = np.where(want == 1, 0.7 / len(pos), 1.3 / len(neg))  # clean texts are the many
    a, b = 1.0, 0.0
    for _ in range(200):  # logistic calibration of the worst window
        q = 1 / (1 + np.exp(-np.clip(a * top + b, -30, 30)))
        a, b = a - 0.3 * float((weight * (q - want) * top).sum()), b - 0.3 * float((weight * (q - want)).sum())
    net.scale, net.shift = max(a, 0.05), b
    return net


def held_out(doc_id: Column) -> Column:
    """Rows that labels are never learned from; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Network:
    """Train on at most per_class labelled ids of each class, those of least hash, none held out.

    One text stands for each id and label, the one of least hash, so repeated rows do not grow the
    sample; texts of more than SAMPLE_CHARS characters are scored but not learned from. Null texts
    are empty. Null ids and labels teach nothing.
    """
    rows = labels.filter("toxic IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", "toxic").filter(~held_out(F.col("doc_id"))).distinct()
    pick = [rows.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter(F.length("text") <= SAMPLE_CHARS)
    one = texts.join(F.broadcast(pick[0].unionByName(pick[1])), "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    got = one.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").collect()
    return train([r["text"] for r in got], [int(r["toxic"]) for r in got])


def score(docs: DataFrame, net: Network, text: str = "text", out: str = "score") -> DataFrame:
    """docs with a column out, a double from 0 to 1; the other columns stay as they are.

    Null and empty texts are one empty window. Very long texts are scored whole, in blocks of
    windows; of equally bad windows the first is the worst. Repeated rows score alike, null ids as
    all others; an empty table stays empty. A column named as out is replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        cache = Inputs(model)
        for batch in batches:
            texts, tops, i = batch.column(text).to_pylist(), [], 0
            while i < len(texts):
                j, chars = i, 0
                while j < len(texts) and (j == i or chars + len(texts[j] or "") < BLOCK):
                    chars += len(texts[j] or "")
                    j += 1
                if len(cache) > CACHE:
                    cache = Inputs(model)
                tops.append(worst(model, texts[i:j], cache)[0])
                i = j
            top = np.concatenate(tops) if tops else np.zeros(0)
            chance = 1 / (1 + np.exp(-np.clip(model.scale * top.astype(float) + model.shift, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chance, pa.float64())], [*batch.schema.names, out])

    base = docs.drop(out)
    return base.mapInArrow(lean(run), T.StructType([*base.schema.fields, T.StructField(out, T.DoubleType())]))
