"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

The vocabulary is read from a .model file (its path is a parameter). A unigram model's own log scores
are used; a file of another type lists its pieces by rank, and their log scores are Zipf's,
-log(rank) - log(H). A text gets a marker for each space and, if the file's normaliser asks for it,
one before it; extra spaces go if it asks for that. Characters without a piece fall back to bytes. A
normaliser with a character map is refused.

Pieces hold a marker only at their start, so the best path of a text is the best paths of its
marked stretches, one after another. A task finds the path of each distinct stretch once, for many
stretches at a time: all starts walk the trie together, then all stretches advance together.
"""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomtrace.llm._common import lean

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # fixed values of the file format
UNKNOWN_PENALTY = 10.0  # fixed value: below the least score
#: Distinct stretches that a task keeps at once, and characters of texts taken together.
CACHE, BLOCK = 150_000, 300_000
F32 = np.float32


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _varint(b: bytes, i: int) -> tuple[int, int]:
    x = shift = 0
    while True:
        c = b[i]
        i += 1
        x |= (c & 127) << shift
        shift += 7
        if c < 128:
            return x, i


def _fields(b: bytes) -> Iterator[tuple[int, object]]:
    i = 0
    while i < len(b):
        tag, i = _varint(b, i)
        kind = tag & 7
        if kind == 0:
            v, i = _varint(b, i)
        elif kind == 2:
            n, i = _varint(b, i)
            v, i = b[i : i + n], i + n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            v, i = b[i : i + n], i + n
        else:
            raise ValueError(f"unknown wire type {kind}")
        yield tag >> 3, v


def read_model(data: bytes) -> list[tuple[str, float, int]]:
    """(piece, score, type) in order of ids."""
    out = []
    for field, body in _fields(data):
        if field == 1:
            got = dict(_fields(body))
            out.append((got.get(1, b"").decode(), struct.unpack("<f", got[2])[0] if 2 in got else 0.0, got.get(3, NORMAL)))
    return out


def read_rules(data: bytes) -> tuple[int, bool, bool]:
    """(model type, whether a marker is put before the text, whether extra spaces go); type 1 is a
    unigram model. The defaults are the file format's."""
    kind, prefix, extra = 1, True, True  # fixed values of the file format
    for field, body in _fields(data):
        if field == 2:
            kind = dict(_fields(body)).get(3, 1)
        elif field == 3:
            got = dict(_fields(body))
            if got.get(2):
                raise ValueError("the model's normaliser has a character map, which is not supported")
            prefix, extra = bool(got.get(3, 1)), bool(got.get(4, 1))
    return kind, prefix, extra


def zipf_scores(pieces: list[tuple[str, float, int]]) -> list[float]:
    """Log scores of normal pieces by their rank in the list; 0 for the others."""
    n = sum(t == NORMAL for _, _, t in pieces)
    log_h = math.log(sum(1 / k for k in range(1, n + 1))) if n else 0.0
    out, rank = [], 0
    for _, _, t in pieces:
        rank += t == NORMAL
        out.append(-math.log(rank) - log_h if t == NORMAL else 0.0)
    return out


class DoubleArray:
    """Byte trie: from state s by byte c to t = base[s] + c + 1 if check[t] == s; value[t] is an id or -1."""

    def __init__(self, keys: dict[bytes, int]) -> None:
        trie: dict = {}
        for key, v in keys.items():
            at = trie
            for c in key:
                at = at.setdefault(c, {})
            at[-1] = v
        n = 1 << 16
        self.base, self.check, self.value = [0] * n, [-1] * n, [-1] * n
        self.check[0] = 0
        queue, free, used = [(0, trie)], 300, 300  # below 300 a hole may be out of reach of a label
        for s, node in queue:
            if -1 in node:
                self.value[s] = node[-1]
            labels = sorted(c for c in node if c >= 0)
            if not labels:
                continue
            while self.check[free] >= 0:
                free += 1
            while max(free, used) + 3000 >= n:
                n = self._grow(n)
            # a lone child fills the first hole; families look near the end, where room is easy to find
            b = (free if len(labels) == 1 else max(free, used - 2000)) - labels[0] - 1
            while any(self.check[b + c + 1] >= 0 for c in labels):
                b += 1
                if b + 300 >= n:
                    n = self._grow(n)
            self.base[s] = b
            used = max(used, b + labels[-1] + 1)
            for c in labels:
                self.check[b + c + 1] = s
                queue.append((b + c + 1, node[c]))
        self.base, self.check, self.value = (np.array(x, np.int32) for x in (self.base, self.check, self.value))

    def _grow(self, n: int) -> int:
        self.base += [0] * n
        self.check += [-1] * n
        self.value += [-1] * n
        return 2 * n

    def step(self, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        to = self.base[state] + byte + 1
        ok = self.check[to] == state
        return to, ok & (to > 0)


@dataclass
class Pieces:
    """A vocabulary ready to encode and decode; its size is the vocabulary's, so it may be broadcast."""

    names: list[str]
    kinds: list[int]
    scores: np.ndarray
    trie: DoubleArray
    lone: bool  # no piece holds a line feed: lines are stretches of their own
    split: bool  # no piece holds a marker after its start
    prefix: bool = True  # a marker stands before the text
    extra: bool = False  # leading, final and repeated spaces go

    @staticmethod
    def load(data: bytes, scores: str = "auto") -> Pieces:
        """data: the bytes of a .model file; scores: zipf, file for the scores in it, or auto, which is
        file for a unigram model and zipf for any other."""
        pieces = read_model(data)
        kind, prefix, extra = read_rules(data)
        if scores == "auto":
            scores = "file" if kind == 1 else "zipf"
        kinds = [t for _, _, t in pieces]
        got = zipf_scores(pieces) if scores == "zipf" else [s for _, s, _ in pieces]
        keys = {p.encode(): i for i, (p, _, t) in enumerate(pieces) if t in (NORMAL, USER)}
        names = [p for p, _, _ in pieces]
        real = [p for p, _, t in pieces if t in (NORMAL, USER)]
        score = np.array(got, F32)
        top = max((got[i] for i in range(len(got)) if kinds[i] == NORMAL), default=0.0)
        for i, t in enumerate(kinds):
            if t == USER:
                score[i] = F32(len(names[i].encode()) * top - 0.1)
        return Pieces(names, kinds, score, DoubleArray(keys), not any("\n" in p for p in real), not any(MARK in p.lstrip(MARK) for p in real), prefix, extra)

    def __post_init__(self) -> None:
        self.byte = np.full(256, -1, np.int64)
        out = []
        for i, (p, t) in enumerate(zip(self.names, self.kinds, strict=True)):
            if t == BYTE:
                self.byte[int(p[3:5], 16)] = i
                out.append(bytes([int(p[3:5], 16)]))
            elif t == CONTROL:
                out.append(b"")
            elif t == UNKNOWN:
                out.append(" ⁇ ".encode())
            else:
                out.append(p.replace(MARK, " ").encode())
        self.unknown = self.kinds.index(UNKNOWN) if UNKNOWN in self.kinds else 0
        self.least = F32(min((s for s, t in zip(self.scores.tolist(), self.kinds, strict=True) if t == NORMAL), default=0.0) - UNKNOWN_PENALTY)
        self.longest = max((len(p.encode()) for p, t in zip(self.names, self.kinds, strict=True) if t in (NORMAL, USER)), default=1)
        self.blob = np.frombuffer(b"".join(out), np.uint8)
        self.length = np.fromiter(map(len, out), np.int64, len(out))
        self.begin = np.cumsum(self.length) - self.length

    # -- encoding

    def stretches(self, text: str) -> list[str]:
        """The parts of a marked text that no piece crosses; some may be empty."""
        if self.extra and text:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return []
        if not self.split:
            return [self.prefix * MARK + text.replace(" ", MARK)]
        if not self.prefix:
            marked = text.replace(" ", MARK)
            return re.findall(rf"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+" if self.lone else rf"{MARK}+[^{MARK}]*|[^{MARK}]+", marked)
        if "  " in text or MARK in text or "\0" in text or text[0] == " ":
            marked = MARK + text.replace(" ", MARK)
            return re.findall(rf"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+" if self.lone else rf"{MARK}+[^{MARK}]*|[^{MARK}]+", marked)
        marked = MARK + text.replace(" ", "\0" + MARK)
        return (marked.replace("\n", "\0\n\0") if self.lone else marked).split("\0")

    def best_paths(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all parts in a row, number of ids of each part)."""
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        a = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64)
        n = len(a)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(parts), np.int64)
        first = np.cumsum(size) - size
        offset = np.arange(n) - np.repeat(first, size)
        left = np.repeat(size, size) - offset
        head = (a & 0xC0) != 0x80
        width = np.where(a < 0x80, 1, np.where(a < 0xE0, 2, np.where(a < 0xF0, 3, 4)))
        at = np.flatnonzero(head)
        state = np.zeros(len(at), np.int32)
        starts, spans, ids = [], [], []
        single = np.zeros(n, bool)
        for k in range(self.longest):
            live = left[at] > k
            at, state = at[live], state[live]
            state, ok = self.trie.step(state, a[at + k])
            at, state = at[ok], state[ok]
            if not len(at):
                break
            v = self.trie.value[state]
            hit = v >= 0
            starts.append(at[hit])
            spans.append(np.full(int(hit.sum()), k + 1))
            ids.append(v[hit])
            single[at[hit & (width[at] == k + 1)]] = True
        lone = np.flatnonzero(head & ~single)
        starts, spans = np.concatenate([*starts, lone]), np.concatenate([*spans, width[lone]])
        ids = np.concatenate([*ids, np.full(len(lone), -1)]).astype(np.int64)
        score = np.where(ids >= 0, self.scores[ids], self.least)
        # node of position p of part k: first[k] + k + p, so that every part has an end of its own
        node = starts + np.repeat(np.arange(len(parts)), size)[starts]
        order = np.argsort(offset[starts], kind="stable")
        starts, spans, ids, score, node = (x[order] for x in (starts, spans, ids, score, node))
        best = np.full(n + len(parts), -np.inf, F32)
        origin = first + np.arange(len(parts))
        best[origin] = 0
        came, by = np.zeros(len(best), np.int64), np.zeros(len(best), np.int64)
        cut = np.flatnonzero(np.diff(offset[starts])) + 1
        for i, j in zip(np.concatenate([[0], cut]).tolist(), np.concatenate([cut, [len(starts)]]).tolist(), strict=True):
            src = node[i:j]
            dst, value = src + spans[i:j], best[src] + score[i:j]
            better = value > best[dst]
            dst = dst[better]
            best[dst], came[dst], by[dst] = value[better], src[better], ids[i:j][better]
        part, pos = np.flatnonzero(size > 0), (origin + size)[size > 0]
        steps = []
        while len(part):
            steps.append((part, by[pos], came[pos] - part, pos - came[pos]))
            pos = came[pos]
            more = pos > origin[part]
            part, pos = part[more], pos[more]
        who, ids, where, span = (np.concatenate(x) for x in zip(*steps, strict=True))
        order = np.lexsort((where, who))
        who, ids, where, span = who[order], ids[order], where[order], span[order]
        if self.byte[0] >= 0:  # bytes of characters without a piece
            n_out = np.where(ids < 0, span, 1)
            at = np.repeat(where, n_out) + np.arange(n_out.sum()) - np.repeat(np.cumsum(n_out) - n_out, n_out)
            flat = np.repeat(ids, n_out)
            flat = np.where(flat < 0, self.byte[a[np.minimum(at, n - 1)]], flat)
            who = np.repeat(who, n_out)
        else:
            flat = np.where(ids < 0, self.unknown, ids)
        return flat.astype(np.int32), np.bincount(who, minlength=len(parts))

    # -- decoding

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of rows of ids that stand in a row, counts of them each."""
        size = self.length[ids]
        at = np.repeat(self.begin[ids], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        data = self.blob[at].tobytes()
        ends = np.concatenate([[0], np.cumsum(size)])[np.cumsum(counts)]
        out, i = [], 0
        for j in ends.tolist():
            text = data[i:j].decode("utf-8", "replace")
            out.append(text[1:] if self.prefix and text[:1] == " " else text)
            i = j
        return out


class Encoder:
    """Encodes texts with a cache of the paths of stretches."""

    def __init__(self, pieces: Pieces) -> None:
        self.pieces, self.known = pieces, {}
        self.ids, self.begin, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each)."""
        if len(self.known) > CACHE:
            self.__init__(self.pieces)
        rows, new, known = [], [], self.known
        count = np.zeros(len(texts), np.int64)
        for k, t in enumerate(texts):
            parts = self.pieces.stretches(t) if t else []
            count[k] = len(parts)
            for p in parts:
                row = known.get(p)
                if row is None:
                    known[p] = row = len(known)
                    new.append(p.encode("utf-8", "replace"))
                rows.append(row)
        if new:
            ids, size = self.pieces.best_paths(new)
            self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(size) - size])
            self.ids, self.size = np.concatenate([self.ids, ids]), np.concatenate([self.size, size])
        rows = np.array(rows, np.int64)
        size = self.size[rows] if len(rows) else np.zeros(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(size)])
        flat = self.ids[np.repeat(self.begin[rows] if len(rows) else size, size) + np.arange(ends[-1]) - np.repeat(ends[:-1], size)]
        return flat, np.diff(ends[np.concatenate([[0], np.cumsum(count)])])


def encode(docs: DataFrame, model: bytes, text: str = "text", scores: str = "auto", check: bool = True) -> DataFrame:
    """(doc_id, n_tokens, token_ids, decoded_equal): every whole text encoded, and decoded again.

    decoded_equal: decoding the ids gives the text; false where the text holds the marker itself
    (it decodes to a space) or spaces that the normaliser drops, and null for null texts or without
    check. Null and empty texts have no tokens; very long ones are encoded whole. Of paths of equal
    score the one whose last piece starts first is taken. Ids keep their type and may be null, repeated
    rows are encoded alike, an empty table stays empty, other columns are not read.
    """
    key = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(Pieces.load(model, scores))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(sent.value)
        for batch in batches:
            texts, i = batch.column(1).to_pylist(), 0
            while i < len(texts):
                j, chars = i, 0
                while j < len(texts) and (j == i or chars + len(texts[j] or "") < BLOCK):
                    chars += len(texts[j] or "")
                    j += 1
                ids, n = coder.encode(texts[i:j])
                same = [None if t is None or not check else t == u for t, u in zip(texts[i:j], coder.pieces.decode(ids, n), strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n, pa.int64()), lists, pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "token_ids", "decoded_equal"])
                i = j

    return docs.select("doc_id", text).mapInArrow(lean(run), f"doc_id {key}, n_tokens long, token_ids array<int>, decoded_equal boolean")


def decode(rows: DataFrame, model: bytes, ids: str = "token_ids") -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids give a null text."""
    sent = rows.sparkSession.sparkContext.broadcast(Pieces.load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = sent.value
        for batch in batches:
            got = batch.column(1).to_pylist()
            flat = np.array([x for r in got for x in (r or [])], np.int64)
            texts = pieces.decode(flat, np.array([len(r or []) for r in got], np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if r is None else t for r, t in zip(got, texts, strict=True)], pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", ids).mapInArrow(lean(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")
