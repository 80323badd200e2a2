"""Language identification in two steps: the family first, then the language within it.

A text is read as hashed character n-grams of its words. One linear separator for each family (against all others)
picks the family; within it, a linear support vector machine for each pair of languages votes. Only languages of one
family are ever compared in pairs, so the pairs specialise in what close relatives differ by, and their number
stays small. Machines are fitted on a bounded sample by dual coordinate descent; scores are calibrated on a part of
the sample that no machine has seen.
"""

from __future__ import annotations

import functools
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtrace.llm._common import lean

U = np.uint32
#: Texts of each language that are learned from, at most.
SAMPLE_PER_LANG = 600
#: Longest n-grams, and the binary logarithm of the number of their hashes.
ORDERS, LOG_D = 4, 16
#: Characters looked at at once; a longer text is taken alone.
BLOCK = 1 << 20
#: The language of a text without a letter.
UND = "und"
#: Families of well-known languages by ISO 639-1 code (fixed values). A language that is not here joins the family
#: whose texts are most alike, or founds its own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nl nn no sv yi",
    "romance": "ca es fr gl it oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt uz",
    "indo-aryan": "bn gu hi mr ne pa ur",
    "iranian": "fa ku ps tg",
    "semitic": "am ar he mt",
    "malayo-polynesian": "id jv mg ms su tl",
}
#: Likeness (cosine of n-gram frequencies) from which an unlisted language joins a family.
ALIKE = 0.6


@functools.cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: what it is read as (small letters, marks, or a space), and whether it is a letter."""
    read, letter = np.full(0x110000, 32, U), np.zeros(0x110000, bool)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LM":
            low = chr(c).lower()
            read[c], letter[c] = ord(low) if len(low) == 1 else c, kind == "L"
    return read, letter


@dataclass
class Read:
    """Texts as hashed n-grams: for each order the hash at each position (of D: none), where texts begin among the
    positions, how many n-grams each has, and whether it has a letter."""

    hashes: list[np.ndarray]
    starts: np.ndarray
    total: np.ndarray
    letter: np.ndarray

    def sums(self, weights: np.ndarray, of: np.ndarray | None = None) -> np.ndarray:
        """Sum of the weights (rows by hash) over the n-grams of each text, of those in a mask."""
        starts, where = self.starts, slice(None)
        if of is not None:
            size = np.diff(np.append(starts, len(self.hashes[0])))
            where = np.repeat(of, size)
            starts = np.cumsum(size[of]) - size[of]
        return sum(np.add.reduceat(weights[h[where]], starts, axis=0) for h in self.hashes)


def read(texts: list[str]) -> Read:
    code, letter = _letters()
    raw = np.frombuffer("".join(f" {t} \0\0\0" for t in texts).encode("utf-32-le"), U)
    size = np.array([len(t) + 5 for t in texts])
    ends = np.cumsum(size)
    starts = ends - size
    has = np.logical_or.reduceat(letter[raw], starts)
    c = code[raw]
    for k in (1, 2, 3):  # as wide as no n-gram can span
        c[ends - k] = 0
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 32) | (c[:-1] != 32)
    starts = (np.cumsum(keep) - 1)[starts]
    c = c[keep]
    h, out, total = np.zeros(len(c), U), [], 0
    for k in range(1, ORDERS + 1):
        h = h[: len(c) - k + 1] * U(0x9E3779B1) + c[k - 1 :] + U(k)
        mixed = (h ^ (h >> U(15))) * U(0x85EBCA6B)
        valid = np.zeros(len(c), bool)
        valid[: len(h)] = (c[: len(h)] != 0) & (c[k - 1 :] != 0)
        at = np.full(len(c), 1 << LOG_D, np.int64)
        at[: len(h)] = (mixed >> U(32 - LOG_D)).astype(np.int64)
        at[~valid] = 1 << LOG_D
        out.append(at)
        total = total + np.add.reduceat(valid.astype(np.int64), starts)
    return Read(out, starts, np.maximum(1, total), has)


def _blocks(texts: list[str]) -> Iterator[list[str]]:
    i = 0
    while i < len(texts):
        j, n = i, 0
        while j < len(texts) and (j == i or n + len(texts[j]) <= BLOCK):
            n += len(texts[j])
            j += 1
        yield texts[i:j]
        i = j


# -- learning


def svm(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: float = 10.0, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Weights of a linear support vector machine without a constant (squared hinge loss) by dual coordinate
    descent; rows are (indices, values) of unit length, y is 1 or -1."""
    w, alpha, r = np.zeros((1 << LOG_D) + 1), np.zeros(len(rows)), np.random.Generator(np.random.PCG64(seed))
    for _ in range(rounds):
        for i in r.permutation(len(rows)):
            at, x = rows[i]
            g = y[i] * float(w[at] @ x) - 1 + alpha[i] / (2 * cost)
            new = max(0.0, alpha[i] - g / (1 + 1 / (2 * cost)))
            if new != alpha[i]:
                w[at] += (new - alpha[i]) * y[i] * x
                alpha[i] = new
    return w


@dataclass
class Model:
    """families: name and languages; family: a column of weights for each; pairs: for each family the pairs of its
    languages and a column of weights for each; scales: of the calibration of both steps."""

    families: list[tuple[str, list[str]]]
    family: np.ndarray
    pairs: list[tuple[list[tuple[int, int]], np.ndarray]]
    scales: list[tuple[float, float]] = field(default_factory=lambda: [(1.0, 0.0), (1.0, 0.0)])

    def margins(self, seen: Read) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(family, language in it, margin of the family over the next, least margin of the language) of each text;
        infinite where there is nothing to compare."""
        n = len(seen.total)
        scores = seen.sums(self.family) / np.sqrt(seen.total)[:, None]
        first = np.argmax(scores, axis=1)
        rest = scores.copy()
        rest[np.arange(n), first] = -np.inf
        lead = scores[np.arange(n), first] - rest.max(axis=1)
        lang, least = np.zeros(n, int), np.full(n, np.inf)
        for k, (_, names) in enumerate(self.families):
            of = first == k
            pairs, weights = self.pairs[k]
            if not pairs or not of.any():
                continue
            z = seen.sums(weights, of) / np.sqrt(seen.total[of])[:, None]
            votes, sums, low = (np.zeros((len(z), len(names))) for _ in range(3))
            low[:] = np.inf
            for j, (a, b) in enumerate(pairs):
                votes[:, a] += z[:, j] > 0
                votes[:, b] += z[:, j] <= 0
                for x, s in ((a, z[:, j]), (b, -z[:, j])):
                    sums[:, x] += s
                    low[:, x] = np.minimum(low[:, x], s)
            best = np.lexsort((sums.T, votes.T), axis=0)[-1]  # of equal votes the larger sum of margins
            lang[of], least[of] = best, low[np.arange(len(z)), best]
        return first, lang, lead, least

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """(language, chance that it is right) of each text; UND and 0 without a letter, or without any language."""
        out, chances = [], []
        for block in _blocks(texts):
            seen = read(block)
            if not self.families:
                out += [UND] * len(block)
                chances.append(np.zeros(len(block)))
                continue
            first, lang, lead, least = self.margins(seen)
            out += [self.families[f][1][x] if ok else UND for f, x, ok in zip(first, lang, seen.letter, strict=True)]
            chances.append(np.where(seen.letter, _chance(lead, self.scales[0]) * _chance(least, self.scales[1]), 0.0))
        return out, np.concatenate(chances) if chances else np.zeros(0)


def _chance(margin: np.ndarray, scale: tuple[float, float]) -> np.ndarray:
    z = np.where(np.isfinite(margin), scale[0] * np.where(np.isfinite(margin), margin, 0) + scale[1], 30.0)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _calibrate(margin: np.ndarray, right: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the chance to be right, by logistic regression; one miss and one hit are added, so that
    perfect data does not give certainty."""
    ok = np.isfinite(margin)
    x, y = np.append(margin[ok], [0.0, 0.0]), np.append(right[ok].astype(float), [0.0, 1.0])
    unit = max(1e-9, float(np.abs(x).mean()))
    a, b = 1.0, 0.0
    for _ in range(400):
        p = 1 / (1 + np.exp(-np.clip(a * x / unit + b, -30, 30)))
        a, b = max(0.01, a - float(((p - y) * x).mean()) / unit), b - float((p - y).mean())
    return a / unit, b


def group(langs: list[str], profiles: dict[str, np.ndarray], families: dict[str, str] | None = None) -> list[tuple[str, list[str]]]:
    """The languages by family: known ones by the table, others with the family most alike them."""
    known = {x: name for name, xs in (families or FAMILIES).items() for x in xs.split()}
    out: dict[str, list[str]] = defaultdict(list)
    for x in sorted(langs, key=lambda x: (x not in known, x)):
        if x in known:
            out[known[x]].append(x)
            continue
        like = lambda xs: float(np.mean([profiles[x] @ profiles[o] / (np.linalg.norm(profiles[x]) * np.linalg.norm(profiles[o]) + 1e-12) for o in xs]))  # noqa: B023, E731
        best = max(out, key=lambda f: (like(out[f]), f), default=None)
        out[best if best is not None and like(out[best]) >= ALIKE else f"of {x}"].append(x)
    return sorted(out.items())


def train(sample: list[tuple[str, np.ndarray, np.ndarray]], families: dict[str, str] | None = None) -> Model:
    """From (language, hashes, counts) of texts. A fifth of them calibrates and is not learned from."""
    d = (1 << LOG_D) + 1
    sample = [x for x in sample if len(x[1])]
    langs = sorted({x[0] for x in sample})
    profiles = {x: np.zeros(d) for x in langs}
    for lang, at, n in sample:
        profiles[lang][at] += n / n.sum()
    mean = sum(p / max(1e-12, p.sum()) for p in profiles.values()) / max(1, len(langs)) if langs else np.zeros(d)
    scale = 1 / np.sqrt(mean + 1e-5)
    groups = group(langs, profiles, families)
    rows, of = [], np.array([x[0] for x in sample], object)
    for _, at, n in sample:
        v = n * scale[at]
        rows.append((at, v / np.linalg.norm(v)))
    kept_back = np.arange(len(rows)) % 5 == 4

    def machine(first: set[str], second: set[str]) -> np.ndarray:
        use = [i for i in np.flatnonzero(~kept_back) if of[i] in first or of[i] in second] or [i for i in range(len(rows)) if of[i] in first or of[i] in second]
        w = svm([rows[i] for i in use], np.array([1.0 if of[i] in first else -1.0 for i in use])) * scale
        w[-1] = 0.0  # positions without an n-gram
        return w

    every = set(langs)
    family = np.stack([machine(set(xs), every - set(xs)) for _, xs in groups], axis=1) if groups else np.zeros((d, 0))
    pairs = []
    for _, xs in groups:
        two = list(combinations(range(len(xs)), 2))
        pairs.append((two, np.stack([machine({xs[a]}, {xs[b]}) for a, b in two], axis=1) if two else np.zeros((d, 0))))
    model = Model(groups, family, pairs)
    check = [sample[i] for i in np.flatnonzero(kept_back)]
    if check:
        total = np.array([int(n.sum()) for _, _, n in check])
        hashes = np.concatenate([np.repeat(at, n) for _, at, n in check])
        seen = Read([hashes], np.cumsum(total) - total, total, np.ones(len(check), bool))
        first, lang, lead, least = model.margins(seen)
        true = np.array([x[0] for x in check], object)
        in_family = np.array([t in groups[f][1] for t, f in zip(true, first, strict=True)])
        right = np.array([groups[f][1][x] == t for t, f, x in zip(true, first, lang, strict=True)])
        model.scales = [_calibrate(lead, in_family), _calibrate(least[in_family], right[in_family])]
    return model


# -- over tables


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def fit(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG, families: dict[str, str] | None = None) -> Model:
    """Learn from at most per_lang texts of each language, those of least hash of id and text among the rows that
    are not held out.

    Null languages and texts, and texts without a letter, teach nothing. Repeated rows count once. Whole texts are
    read, on the executors; n-gram counts alone reach the driver. Without any labelled row the model knows no
    language.
    """
    code = F.xxhash64("doc_id", "text")
    rows = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "text", code.alias("h"))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    share = sizes.select("lang", (F.lit(1.5 * per_lang + 50) / F.col("n")).alias("share"))  # a row per language, which the model has as well
    near = rows.join(F.broadcast(share), "lang").filter(F.pmod("h", F.lit(1 << 30)) < F.col("share") * (1 << 30)).dropDuplicates(["lang", "h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, at, n = batch.column(1).to_pylist(), [], []
            for t in texts:
                seen = read([t])
                one, count = np.unique(np.concatenate(seen.hashes), return_counts=True)
                at.append(one[one < 1 << LOG_D].tolist())
                n.append(count[one < 1 << LOG_D].tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(at, pa.list_(pa.int32())), pa.array(n, pa.list_(pa.int32()))], ["lang", "h", "at", "n"])

    got = near.select("lang", "text", F.pmod("h", F.lit(1 << 30)).alias("h")).withColumn("place", F.expr("row_number() OVER (PARTITION BY lang ORDER BY h, text)")).filter(F.col("place") <= per_lang)
    found = got.select("lang", "text", "h").mapInArrow(lean(run), "lang string, h long, at array<int>, n array<int>").toArrow()
    numbers = lambda name: [x.values.to_numpy() for x in found[name]]
    sample = zip(found["lang"].to_pylist(), found["h"].to_pylist(), numbers("at"), numbers("n"), strict=True)
    return train([(lang, at, n) for lang, _, at, n in sorted(sample, key=lambda x: (x[0], x[1], x[2].tobytes(), x[3].tobytes()))], families)


def identify(docs: DataFrame, model: Model, text: str = "text", lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the language of each text and the chance (0 to 1) that it is right.

    Texts are read whole, in blocks of texts. Null, empty and letterless texts are 'und' with 0; equal texts are
    judged alike. Of equal votes the language of larger margins wins, then the later name. A table without rows stays
    empty. Other columns stay as they are; columns named as the new ones are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    base = docs.drop(lang_pred, score)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, chances = sent.value.predict([t or "" for t in batch.column(text).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(chances, pa.float64())], [*batch.schema.names, lang_pred, score])

    return base.mapInArrow(lean(run), T.StructType([*base.schema.fields, T.StructField(lang_pred, T.StringType()), T.StructField(score, T.DoubleType())]))
