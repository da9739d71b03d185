"""Toxicity of whole texts: a bidirectional GRU with attention pooling, in numpy.

A text is read as pieces: runs of letters, marks and digits in lower case, and overlapping
parts of runs over ``LONGEST`` characters, so that every letter of unspaced scripts and of
words joined by punctuation enters. A piece enters the network as two vectors: an
embedding of the piece, and the mean of embeddings of its character n-grams at all
positions. Pieces and n-grams that are rare in the training sample have none. Both
directions of the recurrent network read a window of ``WINDOW`` pieces; attention pools
their states, and a logistic unit gives the window's score. A text's windows overlap by
half, all of them are scored, and the largest score is the text's.

Labels belong to texts, not windows, so training alternates: of every text the
window with the largest score stands for it, then the network is fitted to those.
The first choice, and the start of the embeddings' first component, come from the
log-odds of pieces and n-grams in the training sample. The sample is bounded: of each
label the document with the smallest hash in each of ``BUCKETS[label]`` hash buckets,
and ``SAMPLE_WINDOWS`` windows of a document, evenly spaced, when it has more. The
fit is one task; scoring is spread over the executors and reads all texts.

Defined results: a text without letters or digits scores 0; without labels of both kinds
every text does; null labels and null ids are not learned; an empty table gives no rows.
Texts of any length are scored whole, some windows at a time. Other columns of the input
are kept by ``with_score`` and may have any name.
"""

from __future__ import annotations

import pickle
import re
import sys
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom.llm.common import unused_name
from labelloom.llm.memories import remembered
from labelloom.llm.shingles import mixed_bits

WINDOW = 64
STRIDE = 32
LEAST_DOCUMENTS = 3
GRAMS = (3, 4, 5)
LONGEST = 24
PART = 16
PART_STRIDE = 8
WIDTH = 6
HIDDEN = 8
ATTENTION = 8
BUCKETS = {0: 3072, 1: 1536}
SAMPLE_WINDOWS = 16
EPOCHS = 8
BATCH = 128
RATE = 0.01
SEED = 7
_GATES = ("z", "r", "n")
_ROWS_AT_ONCE = 512
_WINDOWS_HELD = 16_384
_MAX_PIECES = 300_000
_CHARS_AT_ONCE = 1 << 21
_PRIOR = 2.0
_SAMPLE = "doc_id long, toxic int, words array<string>"
_SAMPLE_TYPE = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("words", pa.list_(pa.string()))])
_ASCII_RUN = re.compile(r"[a-z0-9]+")
_PLAIN_RUN = re.compile(r"[^\W_]+")
_RUN = regex.compile(r"[\p{L}\p{M}\p{N}]+")
_MARKS = frozenset(chr(c) for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c))[0] == "M")
_FACTORS = (np.arange(1, max(GRAMS) + 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


# ---- pieces --------------------------------------------------------------------------

def pieces(text: str) -> list[str]:
    """Runs of letters, marks and digits in lower case; long runs as overlapping parts."""
    low = text.lower()
    if low.isascii():
        runs = _ASCII_RUN.findall(low)
    else:
        runs = (_PLAIN_RUN if _MARKS.isdisjoint(set(low)) else _RUN).findall(low)
    if max(map(len, runs), default=0) <= LONGEST:
        return runs
    out = []
    for run in runs:
        out += [run] if len(run) <= LONGEST else [
            run[i:i + PART] for i in range(0, len(run) - PART + PART_STRIDE, PART_STRIDE)]
    return out


@dataclass
class Ragged:
    """Lists of numbers of several pieces: ``flat`` cut at ``starts``."""
    flat: np.ndarray
    starts: np.ndarray

    @staticmethod
    def of_sizes(flat: np.ndarray, sizes: np.ndarray | list[int]) -> "Ragged":
        return Ragged(flat, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64))

    def at(self, rows: np.ndarray) -> "Ragged":
        begin = self.starts[rows]
        size = self.starts[rows + 1] - begin
        starts = np.concatenate([[0], np.cumsum(size)])
        return Ragged(self.flat[np.arange(starts[-1]) + np.repeat(begin - starts[:-1], size)], starts)

    def where(self, kept: np.ndarray) -> "Ragged":
        before = np.concatenate([[0], np.cumsum(kept)])
        return Ragged(self.flat[kept], before[self.starts])

    def sizes(self) -> np.ndarray:
        return np.diff(self.starts)

    def means(self, table: np.ndarray) -> np.ndarray:
        """Per list the mean of rows of ``table``; zeros for an empty list."""
        size = self.sizes()
        out = np.zeros((len(size), table.shape[1]), table.dtype)
        some = np.flatnonzero(size)
        if len(some):
            out[some] = np.add.reduceat(table[self.flat], self.starts[some], axis=0) / size[some, None].astype(table.dtype)
        return out


def gram_hashes(names: list[str]) -> Ragged:
    """64-bit hashes of the character n-grams of pieces with their borders, at all positions."""
    marked = "".join([f"<{name}>" for name in names]).encode("utf-32-le", "surrogatepass")
    letters = np.frombuffer(marked, np.uint32).astype(np.uint64)
    size = np.array([len(name) + 2 for name in names], np.int64)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(letters))  # letters up to the piece's end
    padded = np.concatenate([letters, np.zeros(max(GRAMS), np.uint64)])
    hashes = np.empty((len(letters), len(GRAMS)), np.uint64)
    total = np.zeros(len(letters), np.uint64)
    for i in range(max(GRAMS)):
        total += padded[i:i + len(letters)] * _FACTORS[i]
        if i + 1 in GRAMS:
            hashes[:, GRAMS.index(i + 1)] = mixed_bits(total + _FACTORS[-1:] * np.uint64(i + 1))
    inside = left[:, None] >= np.array(GRAMS)
    many = np.add.reduceat(inside.sum(axis=1), np.cumsum(size) - size) if len(names) else size
    return Ragged.of_sizes(hashes[inside], many)


@dataclass
class Known:
    """Pieces and n-grams with embeddings. Row 0 is nothing; pieces come first, n-grams after them."""
    pieces: dict[str, int]
    grams: np.ndarray
    """Hashes, sorted."""

    def __len__(self) -> int:
        return 1 + len(self.pieces) + len(self.grams)

    def gram_rows(self, hashes: Ragged) -> Ragged:
        if not len(self.grams):
            return hashes.where(np.zeros(len(hashes.flat), bool))
        place = np.searchsorted(self.grams, hashes.flat)
        place[place == len(self.grams)] = 0
        found = hashes.where(self.grams[place] == hashes.flat)
        found.flat = place[self.grams[place] == hashes.flat] + 1 + len(self.pieces)
        return found


@dataclass
class Features:
    """Embedding rows of pieces (0: none) and of their n-grams."""
    piece: np.ndarray
    grams: Ragged

    @staticmethod
    def of(names: list[str], known: Known) -> "Features":
        return Features(np.array([known.pieces.get(name, 0) for name in names], np.int64),
                        known.gram_rows(gram_hashes(names)))

    def at(self, rows: np.ndarray) -> "Features":
        return Features(self.piece[rows], self.grams.at(rows))

    def vectors(self, table: np.ndarray) -> np.ndarray:
        return np.concatenate([table[self.piece], self.grams.means(table)], axis=1)


def window_starts(count: int) -> range:
    """Starts of the overlapping windows that cover a text."""
    return range(0, max(1, count - WINDOW + STRIDE), STRIDE) if count > WINDOW else range(0, 1)


# ---- network ---------------------------------------------------------------------------
# Arrays over steps have the shape (steps, 2, rows, ...): the second axis is the direction, and
# the backward one is stored in the order in which it is read. Gates z and r are
# sigmoids, computed as half a tangent of half the input.

def _half(name: str) -> float:
    return 1.0 if name == "n" else 0.5


def new_parameters(rng: np.random.Generator, rows: int) -> dict[str, np.ndarray]:
    def normal(*shape: int) -> np.ndarray:
        return (rng.standard_normal(shape) / np.sqrt(shape[-2] if len(shape) > 1 else shape[0])).astype(np.float32)
    p = {"embedding": 0.1 * rng.standard_normal((rows, WIDTH)).astype(np.float32),
         "att_w": normal(2, HIDDEN, ATTENTION) / np.float32(np.sqrt(2)), "att_v": normal(ATTENTION),
         "out_w": normal(2 * HIDDEN), "out_b": np.zeros(1, np.float32)}
    for name in _GATES:
        p[f"in_{name}"] = normal(2, 2 * WIDTH, HIDDEN)
        p[f"rec_{name}"] = normal(2, HIDDEN, HIDDEN)
        p[f"bias_{name}"] = np.zeros((2, 1, HIDDEN), np.float32)
    p["embedding"][0] = 0
    return p


def _run(gates: Callable[[int], list[np.ndarray]], steps: int, rows: int, p: dict, mask: np.ndarray | None,
         keep: list | None) -> np.ndarray:
    """States of both directions. ``gates`` gives the inputs of a step in arrays that are written over."""
    kind = p["rec_z"].dtype
    rec = {name: (p[f"rec_{name}"] * _half(name)).astype(kind) for name in _GATES}
    h = np.zeros((2, rows, HIDDEN), kind)
    out = np.empty((steps, 2, rows, HIDDEN), kind)
    u = np.empty((2, rows, HIDDEN), kind)
    for t in range(steps):
        z, r, n = gates(t)
        for name, gate in (("z", z), ("r", r)):
            gate += np.matmul(h, rec[name], out=u)
            np.tanh(gate, out=gate)
            gate *= 0.5
            gate += 0.5
        np.matmul(h, rec["n"], out=u)
        if keep is not None:
            keep.append([h, z.copy(), r.copy(), None, u.copy()])
        r *= u
        n += r
        np.tanh(n, out=n)
        if keep is not None:
            keep[-1][3] = n.copy()
        new = np.subtract(h, n, out=out[t])
        new *= z
        new += n
        if mask is not None:
            np.copyto(new, h, where=~mask[t])
        h = new
    return out


def _pooled(states: np.ndarray, mask: np.ndarray | None, p: dict, keep: dict | None = None) -> np.ndarray:
    """Scores of windows from the states; ``mask`` is (steps, rows)."""
    forward, backward = states[:, 0], states[::-1, 1]
    inner = forward @ p["att_w"][0]
    inner += backward @ p["att_w"][1]
    np.tanh(inner, out=inner)
    weight = inner @ p["att_v"]
    if mask is not None:
        weight = np.where(mask, weight, -np.inf)
    weight = np.exp(weight - weight.max(axis=0))
    weight /= weight.sum(axis=0)
    pooled = np.concatenate([np.einsum("tb,tbh->bh", weight, side) for side in (forward, backward)], axis=1)
    score = 0.5 * np.tanh(0.5 * (pooled @ p["out_w"] + p["out_b"][0])) + 0.5
    if keep is not None:
        keep.update(forward=forward, backward=backward, inner=inner, weight=weight, pooled=pooled)
    return score


def _both(x: np.ndarray) -> np.ndarray:
    """The same steps for both directions, the second in reverse."""
    return np.stack([x, x[::-1]], axis=1)


def _back(d_states: np.ndarray, kept: list, mask: np.ndarray, p: dict, g: dict) -> dict[str, np.ndarray]:
    """Gradients of the gates' inputs; those of the recurrent matrices are put in ``g``."""
    d_gates = {name: np.zeros_like(d_states) for name in _GATES}
    for name in _GATES:
        g[f"rec_{name}"] = np.zeros_like(p[f"rec_{name}"])
    d_h = np.zeros_like(d_states[0])
    for t in range(len(kept) - 1, -1, -1):
        h, z, r, n, u = kept[t]
        d_out = d_h + d_states[t]
        d_new = np.where(mask[t], d_out, 0)
        d_n = d_new * (1 - z) * (1 - n * n)
        d_gates["z"][t] = d_new * (h - n) * z * (1 - z)
        d_gates["r"][t] = d_n * u * r * (1 - r)
        d_gates["n"][t] = d_n
        d_h = np.where(mask[t], d_new * z, d_out)
        for name, d in (("z", d_gates["z"][t]), ("r", d_gates["r"][t]), ("n", d_n * r)):
            g[f"rec_{name}"] += h.transpose(0, 2, 1) @ d
            d_h += d @ p[f"rec_{name}"].transpose(0, 2, 1)
    return d_gates


def _added(table: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """Add ``values`` to rows of ``table``, which may repeat."""
    for i in range(table.shape[1]):
        table[:, i] += np.bincount(rows, values[:, i], len(table)).astype(table.dtype)


def gradients(p: dict, features: Features, grid: np.ndarray, sizes: np.ndarray, labels: np.ndarray,
              weights: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Weighted log loss of windows of piece numbers (rows, steps) and its gradient.

    The first ``sizes`` entries of a row are its window.
    """
    steps, rows = int(sizes.max()), len(grid)
    used, places = np.unique(grid[:, :steps].T, return_inverse=True)
    places = places.reshape(steps, rows)
    mine = features.at(used)
    x = mine.vectors(p["embedding"])[places]
    inside = np.arange(steps)[:, None] < sizes
    mask = _both(inside)[..., None]
    both = _both(x)
    gates = {name: (both @ p[f"in_{name}"] + p[f"bias_{name}"]) * _half(name) for name in _GATES}
    kept: list = []
    k: dict = {}
    states = _run(lambda t: [gates[name][t].astype(p["rec_z"].dtype) for name in _GATES], steps, rows, p, mask, kept)
    score = _pooled(states, inside, p, k)
    loss = -np.mean(weights * (labels * np.log(score + 1e-7) + (1 - labels) * np.log(1 - score + 1e-7)))
    d_logit = (weights * (score - labels) / len(labels)).astype(states.dtype)
    g = {"out_w": k["pooled"].T @ d_logit, "out_b": np.array([d_logit.sum()], states.dtype)}
    d_pooled = np.split(d_logit[:, None] * p["out_w"], 2, axis=1)
    sides = (k["forward"], k["backward"])
    d_weight = sum(np.einsum("tbh,bh->tb", side, d) for side, d in zip(sides, d_pooled))
    d_raw = k["weight"] * (d_weight - (k["weight"] * d_weight).sum(axis=0))
    g["att_v"] = d_raw.ravel() @ k["inner"].reshape(-1, ATTENTION)
    d_inner = d_raw[:, :, None] * p["att_v"] * (1 - k["inner"] ** 2)
    g["att_w"] = np.stack([side.reshape(-1, HIDDEN).T @ d_inner.reshape(-1, ATTENTION) for side in sides])
    d_states = np.empty_like(states)
    for side, flip in ((0, 1), (1, -1)):
        d_states[:, side] = (k["weight"][:, :, None] * d_pooled[side] + d_inner @ p["att_w"][side].T)[::flip]
    d_gates = _back(d_states, kept, mask, p, g)
    d_both = np.zeros_like(both)
    for name in _GATES:
        g[f"in_{name}"] = np.stack([both[:, side].reshape(-1, 2 * WIDTH).T @ d_gates[name][:, side].reshape(-1, HIDDEN)
                                    for side in (0, 1)])
        g[f"bias_{name}"] = d_gates[name].sum(axis=(0, 2))[:, None]
        d_both += d_gates[name] @ p[f"in_{name}"].transpose(0, 2, 1)
    d_x = (d_both[:, 0] + d_both[::-1, 1]).reshape(-1, 2 * WIDTH)
    d_vectors = np.zeros((len(used), 2 * WIDTH), states.dtype)
    _added(d_vectors, places.ravel(), d_x)
    g["embedding"] = np.zeros_like(p["embedding"])
    _added(g["embedding"], mine.piece, d_vectors[:, :WIDTH])
    size = mine.grams.sizes()
    _added(g["embedding"], mine.grams.flat, np.repeat(d_vectors[:, WIDTH:] / np.maximum(size, 1)[:, None], size, axis=0))
    g["embedding"][0] = 0
    return float(loss), g


class Gates:
    """What pieces give to the gates: per gate a table with two rows per piece, one per direction."""

    def __init__(self, p: dict):
        self._p = p
        self.tables = {name: np.zeros((0, HIDDEN), np.float32) for name in _GATES}

    def add(self, features: Features) -> None:
        x = features.vectors(self._p["embedding"])
        for name in _GATES:
            new = (x @ self._p[f"in_{name}"] + self._p[f"bias_{name}"]).transpose(1, 0, 2) * np.float32(_half(name))
            self.tables[name] = np.concatenate([self.tables[name], new.reshape(-1, HIDDEN).astype(np.float32)])

    def scores(self, grid: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Scores of windows (rows, steps) of piece numbers, each with one piece at least."""
        out = np.empty(len(grid))
        order = np.argsort(sizes, kind="stable")
        for i in range(0, len(order), _ROWS_AT_ONCE):
            rows = order[i:i + _ROWS_AT_ONCE]
            out[rows] = self._block(grid[rows], sizes[rows])
        return out

    def _block(self, grid: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        steps, rows = int(sizes.max()), len(grid)
        index = _both(2 * grid[:, :steps].T)
        index[:, 1] += 1
        inside = None if sizes.min() == steps else np.arange(steps)[:, None] < sizes
        mask = None if inside is None else _both(inside)[..., None]
        held = [np.empty((2, rows, HIDDEN), np.float32) for _ in _GATES]

        def gates(t: int) -> list[np.ndarray]:
            for name, space in zip(_GATES, held):
                np.take(self.tables[name], index[t], axis=0, out=space, mode="clip")
            return held

        return _pooled(_run(gates, steps, rows, self._p, mask, None), inside, self._p)


# ---- training ----------------------------------------------------------------------------

def _shrunk_odds(yes: np.ndarray, no: np.ndarray, share: float) -> np.ndarray:
    return np.log((yes + _PRIOR * share) / (no + _PRIOR * (1 - share))) - np.log(share / (1 - share))


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return values[new]


def _known_and_odds(names: list[str], windows: np.ndarray, docs: np.ndarray,
                    toxic: np.ndarray) -> tuple[Known, np.ndarray]:
    """Pieces and n-grams that enough documents hold, and their shrunk log-odds by row."""
    held = _distinct((docs[:, None] * np.int64(len(names)) + windows).ravel())  # document and piece, once each
    doc, piece = held // len(names), held % len(names)
    doc, piece = doc[piece > 0], piece[piece > 0]
    share = float(toxic.mean())
    hot = toxic[doc] == 1
    yes, no = (np.bincount(piece[x], minlength=len(names)) for x in (hot, ~hot))
    kept = np.flatnonzero(yes + no >= LEAST_DOCUMENTS)
    known = {names[i]: k + 1 for k, i in enumerate(kept.tolist())}
    odds = [np.zeros(1), _shrunk_odds(yes[kept], no[kept], share)]
    hashes = gram_hashes(names)
    grams = _distinct(hashes.flat)
    numbers = Ragged(np.searchsorted(grams, hashes.flat), hashes.starts)
    yes, no = np.zeros(len(grams), np.int64), np.zeros(len(grams), np.int64)
    cuts = np.searchsorted(doc, np.arange(0, len(toxic) + 256, 256))
    for begin, end in zip(cuts[:-1], cuts[1:]):  # some documents at a time, for memory
        mine = numbers.at(piece[begin:end])
        pairs = _distinct(np.repeat(doc[begin:end], mine.sizes()) * np.int64(len(grams)) + mine.flat)
        hot = toxic[pairs // len(grams)] == 1
        yes += np.bincount(pairs[hot] % len(grams), minlength=len(grams))
        no += np.bincount(pairs[~hot] % len(grams), minlength=len(grams))
    common = yes + no >= LEAST_DOCUMENTS
    odds.append(_shrunk_odds(yes[common], no[common], share))
    return Known(known, grams[common]), np.concatenate(odds).astype(np.float32)


def trained(names: list[str], windows: np.ndarray, docs: np.ndarray, toxic: np.ndarray,
            epochs: int = EPOCHS) -> dict:
    """A model from sample windows: piece numbers (0 is none) per row, documents, labels."""
    rng = np.random.default_rng(SEED)
    known, odds = _known_and_odds(names, windows, docs, toxic)
    features = Features.of(names, known)
    sizes = (windows > 0).sum(axis=1)
    windows, docs, sizes = windows[sizes > 0], docs[sizes > 0], sizes[sizes > 0]
    p = new_parameters(rng, len(known))
    p["embedding"][:, 0] = odds
    first = odds[features.piece] + features.grams.means(odds[:, None])[:, 0]
    scores = np.where(windows > 0, first[windows].clip(0), 0).sum(axis=1)
    balance = np.sqrt(np.where(toxic == 1, 1 / toxic.mean(), 1 / (1 - toxic.mean())))
    mean, square = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    steps = 0
    for _ in range(epochs):
        order = np.lexsort((-scores, docs))
        chosen = order[np.unique(docs[order], return_index=True)[1]]
        rng.shuffle(chosen)
        for i in range(0, len(chosen), BATCH):
            take = chosen[i:i + BATCH]
            _, g = gradients(p, features, windows[take], sizes[take], toxic[docs[take]], balance[docs[take]])
            steps += 1
            for name, grad in g.items():
                mean[name] += 0.1 * (grad - mean[name])
                square[name] += 0.01 * (grad * grad - square[name])
                scale = np.sqrt(square[name] / (1 - 0.99 ** steps)) + 1e-6
                p[name] -= RATE * mean[name] / (1 - 0.9 ** steps) / scale
        gates = Gates(p)
        gates.add(features)
        scores = gates.scores(windows, sizes)
    return {"known": known, "network": p}


def learned(doc_id: Column) -> Column:
    """Whether a document's label may be learned."""
    return F.crc32(doc_id.cast("string")) % 5 != 0


def training_sample(docs: DataFrame, labels: DataFrame, buckets: dict[int, int] = BUCKETS) -> DataFrame:
    """(doc_id, toxic, windows) of at most ``buckets[toxic]`` documents per label."""
    order = F.xxhash64(F.lit("toxicity"), "doc_id")
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & learned(F.col("doc_id")))
    bucket = F.when(F.col("toxic") == 1, F.pmod(order, F.lit(buckets[1]))).otherwise(F.pmod(order, F.lit(buckets[0])))
    picked = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).join(
        docs.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("toxic", bucket.alias("bucket")).agg(
        F.min(F.struct(order.alias("h"), F.col("doc_id"))).alias("first")).select("toxic", "first.doc_id")
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(picked), "doc_id").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"), "text")
    return texts.mapInArrow(_sample_windows, _SAMPLE)


def _sample_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A document's windows in a row, each filled up to its full length with empty pieces."""
    remembered("toxicity fit", dict)
    for batch in batches:
        rows = []
        for text in batch.column("text").to_pylist():
            found = pieces(text)
            starts = window_starts(len(found)) if found else range(0)
            if len(starts) > SAMPLE_WINDOWS:
                starts = [starts[int(i)] for i in np.linspace(0, len(starts) - 1, SAMPLE_WINDOWS)]
            cuts = [found[i:i + WINDOW] for i in starts]
            rows.append([x for cut in cuts for x in cut + [""] * (WINDOW - len(cut))])
        yield pa.record_batch({"doc_id": batch.column("doc_id"), "toxic": batch.column("toxic"),
                               "words": pa.array(rows, pa.list_(pa.string()))})


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model of the whole sample, pickled; nothing without texts of both labels."""
    remembered("toxicity fit", dict)  # whatever else the worker kept goes
    table = pa.Table.from_batches(list(batches), _SAMPLE_TYPE)
    table = table.sort_by([("doc_id", "ascending"), ("toxic", "ascending")])
    ids, toxic = (table.column(c).to_numpy() for c in ("doc_id", "toxic"))
    sizes = pc.list_value_length(table.column("words")).to_numpy() // WINDOW
    if len(set(toxic[sizes > 0].tolist())) < 2:
        return
    # pieces in a fixed order, so that a rerun gives the same model; the empty one is number 0
    coded = table.column("words").combine_chunks().flatten().dictionary_encode()
    names = ["", *sorted(set(coded.dictionary.to_pylist()) - {""})]
    numbers = {name: i for i, name in enumerate(names)}
    ranks = np.array([numbers[name] for name in coded.dictionary.to_pylist()], np.int64)
    windows = ranks[coded.indices.to_numpy()].reshape(-1, WINDOW)
    del table, coded
    unique, docs = np.unique(ids, return_inverse=True)
    label = np.zeros(len(unique), np.float32)
    label[docs] = toxic
    model = trained(names, windows, np.repeat(docs, sizes), label)
    yield pa.record_batch({"model": pa.array([pickle.dumps(model)], pa.binary())})


def fit(docs: DataFrame, labels: DataFrame) -> dict | None:
    """The model, fitted in one task on the bounded sample; None without both labels."""
    rows = training_sample(docs, labels).repartition(1).mapInArrow(_fitted, "model binary").collect()
    if not rows:
        return None
    data = rows[0]["model"]
    return {**pickle.loads(data), "key": xxhash.xxh3_64_intdigest(data)}


# ---- scoring ------------------------------------------------------------------------------

class _Numbers(dict):
    """Number of a name, from ``first`` on; new names wait in a list."""

    def __init__(self, first: int = 0):
        super().__init__()
        self._first = first
        self.new: list[str] = []

    def __missing__(self, name: str) -> int:
        number = self[name] = len(self) + self._first
        self.new.append(name)
        return number

    def taken(self) -> list[str]:
        new, self.new = self.new, []
        return new


class Scorer:
    """Scores of texts. A piece's part in the gates is computed once and remembered, up to a bound."""

    def __init__(self, model: dict):
        self._p, self._known = model["network"], model["known"]
        self._forget()

    def _forget(self) -> None:
        self._pieces = _Numbers(1)
        self._gates = Gates(self._p)
        self._gates.add(Features.of([""], Known({}, np.zeros(0, np.uint64))))  # number 0 is no piece

    def _numbered(self, texts: list[str | None]) -> Ragged:
        """The numbers of the texts' pieces."""
        found = [pieces(text) if text else [] for text in texts]
        sizes = list(map(len, found))
        numbers = np.fromiter(map(self._pieces.__getitem__, chain.from_iterable(found)), np.int64, sum(sizes))
        fresh = self._pieces.taken()
        if fresh:
            self._gates.add(Features.of(fresh, self._known))
        return Ragged.of_sizes(numbers, sizes)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts))
        begin = 0
        while begin < len(texts):  # some texts at a time, so that memory stays bounded
            end, size = begin, 0
            while end < len(texts) and size < _CHARS_AT_ONCE:
                size += len(texts[end] or "")
                end += 1
            self._score(self._numbered(texts[begin:end]), out[begin:end])
            if len(self._pieces) > _MAX_PIECES:
                self._forget()
            begin = end
        return out

    def _score(self, found: Ragged, out: np.ndarray) -> None:
        counts = found.sizes()
        windows = np.where(counts > WINDOW, -(-(counts - WINDOW + STRIDE) // STRIDE), np.minimum(counts, 1))
        owner = np.repeat(np.arange(len(counts)), windows)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        start = found.starts[owner] + STRIDE * nth
        size = np.minimum(WINDOW, found.starts[owner + 1] - start)
        padded = np.concatenate([found.flat, np.zeros(WINDOW, np.int64)])
        for i in range(0, len(owner), _WINDOWS_HELD):
            cut = slice(i, i + _WINDOWS_HELD)
            score = self._gates.scores(padded[start[cut, None] + np.arange(WINDOW)], size[cut])
            np.maximum.at(out, owner[cut], score)


def with_score(docs: DataFrame, model: dict | None, name: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score of ``text`` in a column of an unused name, the last one."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    column = unused_name(docs.columns, name)
    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())])
    text = docs.columns.index("text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scorer = remembered(("toxicity", model["key"]), lambda: Scorer(model)) if model else None
        for batch in batches:
            texts = batch.column(text).to_pylist()
            found = scorer.scores(texts) if scorer else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())],
                                             names=[*batch.schema.names, column])

    return docs.mapInArrow(score, schema)


def tolerated(docs: DataFrame, labels: DataFrame, cutoff: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below the cutoff, same columns."""
    scored = with_score(docs, fit(docs, labels))
    return scored.where(F.col(f"`{scored.columns[-1]}`") < cutoff).select(*[F.col(f"`{c}`") for c in docs.columns])
