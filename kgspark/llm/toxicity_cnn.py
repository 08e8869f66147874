"""Toxicity: a convolutional text classifier in numpy.

A word is the sum of hashed embeddings, of itself and of its beginnings.
Filters over one, two and three words are max-pooled over the whole text and
combined by a logistic layer. Training is by sparse Adagrad steps: only the
positions that win a pool get a gradient. The threshold is calibrated for each
language on texts that the network was not trained on; the language is guessed
from function words of the text itself, and the score is shifted so that 0.5 is
the threshold everywhere.

Every labelled id outside the held-out fold is learnt from, with its whole text
(``learnt``): four fifths train the network, the last fifth sets the thresholds.
The ids are dealt to shards by a hash. In each of ``EPOCHS`` rounds every shard
takes its steps from the same state, and the changes of a slot are averaged over
the shards that moved it. Changes are added as whole numbers and logits counted
in bins, so results depend on neither file layout nor task order, and the driver
holds one state however many labels there are.

Defined results: null and empty texts have no words, pool to zero and get a
score like any other; repeated rows get equal scores; an id with clashing labels
has the greater one, and of an id that many documents have, the least text
counts; without labels of both classes every score is 0.5; an empty table has no
scores.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, record_batches, text_or_empty, written
from .quality_qda import fold, held_part, labelled_sample

FIT_ROWS = 2000  # of each class, at most, in ``fitted``
FIT_TEXT_BYTES = 1 << 15  # longer texts are not learnt from in ``fitted``
SHARD_ROWS, SHARD_BYTES = 4000, 1 << 24  # of a shard of ``learnt``, as expected: there are as many as it takes
MAP_BITS = 1 << 26  # of the map of labelled ids: 8 MB
PARTS, GRID = 16, 1 << 24  # slices in which states are added, and the unit of changes: 1 / GRID
PIECE, STRIP = 1 << 18, 1 << 13  # bytes of a stored value of a shard at most; rows of a state that are made whole numbers at once
BIN, BINS = 1 << 10, 1 << 16  # logits are counted in bins of 1 / BIN, up to BINS of them either way
WORD_SLOTS, PREFIX_SLOTS, SIZE, FILTERS, WIDTHS = 1 << 16, 1 << 14, 12, 8, (1, 2, 3)
PREFIXES = (3, 4, 5, 6)
EPOCHS, BATCH, RATE, SEED = 8, 32, 0.15, 11
WORDS = re.compile(WORD)
EDGES = ".,;:!?\"'()[]{}|*$%&#<>"

# Function words that tell the languages apart.
LANGUAGES = {
    "en": "the and of to is that with for are was it",
    "de": "der die und das ist nicht mit ein zu den von",
    "fr": "le les des et est une dans qui pour du sur",
    "es": "el los las que por una con del para se y",
}
_LANGUAGE_OF = {w: k + 1 for k, words in enumerate(LANGUAGES.values()) for w in words.split()}


def word_ids(word: str) -> tuple[int, ...]:
    """(word slot, language + 1 or 0, prefix slots) of a word as it stands in a text."""
    plain = word.lower().strip(EDGES) or word
    raw = plain.encode("utf-8", "surrogatepass")
    prefixes = (zlib.crc32(plain[:k].encode("utf-8", "surrogatepass"), k) % PREFIX_SLOTS for k in PREFIXES)
    return zlib.crc32(raw) % WORD_SLOTS, _LANGUAGE_OF.get(plain, 0), *prefixes


def indexed(texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words' ids, every word's place among them, and the first word of each text."""
    places: dict[str, int] = {}
    every, starts = array("q"), [0]
    for text in texts:
        words = WORDS.findall(text or "")
        every.extend([places.setdefault(w, len(places)) for w in words])
        starts.append(len(every))
    ids = np.fromiter(chain.from_iterable(map(word_ids, places)), np.int64, len(places) * (2 + len(PREFIXES))).reshape(-1, 2 + len(PREFIXES))
    return ids, np.array(every, np.int64), np.array(starts, np.int64)


@dataclass
class Model:
    words: np.ndarray
    prefixes: np.ndarray
    filters: list[np.ndarray]  # for each width: (width, SIZE, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    offset: float
    thresholds: np.ndarray  # logits: of no language, then of each of LANGUAGES

    def vectors(self, ids: np.ndarray) -> np.ndarray:
        parts = [self.prefixes.take(ids[:, 2 + k], 0) for k in range(len(PREFIXES))]
        for part in parts[1:]:
            parts[0] += part
        return self.words.take(ids[:, 0], 0) + parts[0]

    def pooled(self, ids: np.ndarray, every: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Max-pooled filter outputs, (texts, filters); 0 where a text is shorter than a filter."""
        vectors = self.vectors(ids)
        out = np.zeros((len(starts) - 1, len(self.bias)), np.float32)
        sizes = np.diff(starts)
        for k, weights in enumerate(self.filters):
            width = len(weights)
            columns = slice(k * FILTERS, (k + 1) * FILTERS)
            long_enough = np.flatnonzero(sizes >= width)
            if not len(long_enough):
                continue
            spots = len(every) - width + 1
            seen = (vectors @ weights[0])[every[:spots]]
            for at in range(1, width):
                seen += (vectors @ weights[at])[every[at : at + spots]]
            # Only windows inside one text count: each text's are starts[k] .. starts[k + 1] - width.
            bounds = np.stack([starts[long_enough], starts[long_enough + 1] - width + 1], 1).ravel()
            padded = np.concatenate([seen, np.full((1, FILTERS), -np.inf, seen.dtype)])
            out[long_enough, columns] = np.maximum(0, np.maximum.reduceat(padded, bounds, axis=0)[::2] + self.bias[columns])
        return out

    def logits(self, texts: list[str | None]) -> np.ndarray:
        """Calibrated: positive means toxic."""
        ids, every, starts = indexed(texts)
        return self.pooled(ids, every, starts) @ self.out + self.offset - self.thresholds[languages(ids, every, starts)]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(texts), -30, 30).astype(np.float64)))


def languages(ids: np.ndarray, every: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """0 for unknown, else 1 + the place in ``LANGUAGES``, by most function words."""
    n = len(starts) - 1
    if not len(every):
        return np.zeros(n, np.int64)
    kind = ids[every, 1]
    text = np.repeat(np.arange(n), np.diff(starts))
    votes = np.bincount(text * 8 + kind, minlength=8 * n).reshape(n, 8)[:, 1 : 1 + len(LANGUAGES)]
    return np.where(votes.max(1) > 0, votes.argmax(1) + 1, 0)


def _blank() -> Model:
    return Model(np.zeros((WORD_SLOTS, SIZE), np.float32), np.zeros((PREFIX_SLOTS, SIZE), np.float32), [np.zeros((w, SIZE, FILTERS), np.float32) for w in WIDTHS], np.zeros(FILTERS * len(WIDTHS), np.float32), np.zeros(FILTERS * len(WIDTHS), np.float32), 0.0, np.zeros(len(LANGUAGES) + 1, np.float32))


def _start(rng: np.random.Generator) -> tuple[Model, dict]:
    """A random network and the sums of squares of its steps."""
    model = _blank()
    model.words = rng.normal(0, 0.1, model.words.shape).astype(np.float32)
    model.prefixes = rng.normal(0, 0.1, model.prefixes.shape).astype(np.float32)
    model.filters = [rng.normal(0, 0.5, f.shape).astype(np.float32) for f in model.filters]
    model.out = rng.normal(0, 0.3, model.out.shape).astype(np.float32)
    squares = {"w": np.full(len(model.words), 1e-2, np.float32), "p": np.full(len(model.prefixes), 1e-2, np.float32), "f": [np.full(f.shape, 1e-1, np.float32) for f in model.filters], "b": np.full(model.bias.shape, 1e-1, np.float32), "o": np.full(model.out.shape, 1e-1, np.float32), "c": 0.1}
    return model, squares


def _known(model: Model, words: np.ndarray, prefixes: np.ndarray) -> None:
    """Unseen words stay neutral."""
    model.words[~np.isin(np.arange(len(model.words)), words)] = 0
    model.prefixes[~np.isin(np.arange(len(model.prefixes)), prefixes)] = 0


def train(texts: list[str], y: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """The network from most of the texts, its thresholds from the rest."""
    if len(set(y.tolist())) < 2:
        return _blank()
    held = held_part(y)
    own = np.flatnonzero(~held) if not held.all() else np.arange(len(y))
    rest, rest_y = [texts[k] for k in np.flatnonzero(held)], y[held]
    texts, y = [texts[k] for k in own], y[own]
    rng = np.random.default_rng(seed)
    ids, every, starts = indexed(texts)
    model, squares = _start(rng)
    _known(model, ids[:, 0], ids[:, 2:])
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    for _ in range(epochs):
        _epoch(model, squares, ids, every, starts, y, weight, rng.permutation(len(y)))
    return calibrated(model, *indexed(rest), rest_y)


def _summed(slots: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct slots and the sum of the rows of each."""
    order = np.argsort(slots, kind="stable")
    slots = slots[order]
    first = np.flatnonzero(np.diff(slots, prepend=-1))
    return slots[first], np.add.reduceat(rows[order], first, axis=0) if len(first) else rows


def _epoch(model: Model, squares: dict, ids: np.ndarray, every: np.ndarray, starts: np.ndarray, y: np.ndarray, weight: np.ndarray, order: np.ndarray) -> None:
    """Steps over the texts in ``order``; model and squares are changed in place."""

    def step(value: np.ndarray, grad: np.ndarray, square: np.ndarray) -> None:
        square += grad * grad
        value -= RATE * grad / np.sqrt(square)

    place_of, every_filter = np.zeros(len(ids), np.int64), np.arange(FILTERS)
    for low in range(0, len(order), BATCH):
        rows = order[low : low + BATCH]
        parts = [every[starts[r] : starts[r + 1]] for r in rows]
        words, here = np.concatenate(parts).astype(np.int64), np.zeros(len(ids), bool)
        here[words] = True
        local = np.flatnonzero(here)
        place_of[local] = np.arange(len(local))
        places = place_of[words]
        bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        own = ids[local].astype(np.int64)
        vectors = model.vectors(own)
        pool = np.zeros((len(rows), len(model.bias)), np.float32)
        best = np.full((len(rows), len(model.bias)), -1, np.int64)
        projected = vectors @ np.concatenate([w for weights in model.filters for w in weights], 1)
        for r in range(len(rows)):
            a, b = bounds[r], bounds[r + 1]
            spread, row = np.ascontiguousarray(projected.take(places[a:b], 0).T), 0
            for k, weights in enumerate(model.filters):
                width, columns = len(weights), slice(k * FILTERS, (k + 1) * FILTERS)
                if b - a < width:
                    break
                seen = spread[row : row + FILTERS, : b - a - width + 1]
                for at in range(1, width):
                    seen = seen + spread[row + at * FILTERS : row + (at + 1) * FILTERS, at : b - a - width + 1 + at]
                row += width * FILTERS
                top = seen.argmax(1)
                pool[r, columns] = seen[every_filter, top] + model.bias[columns]
                best[r, columns] = a + top
        live = (pool > 0) & (best >= 0)
        pool = np.where(live, pool, 0)
        logit = np.clip(pool @ model.out + model.offset, -30, 30)
        error = ((1 / (1 + np.exp(-logit)) - y[rows]) * weight[rows] / len(rows)).astype(np.float32)
        inner = np.where(live, error[:, None] * model.out, 0)
        spots, grads = [], []
        for k, weights in enumerate(model.filters):
            filter_grad = np.zeros_like(weights)
            r, f = np.nonzero(live[:, k * FILTERS : (k + 1) * FILTERS])
            g = inner[r, k * FILTERS + f]
            spread = np.zeros((len(f), FILTERS), np.float32)
            spread[np.arange(len(f)), f] = g
            for at in range(len(weights)):
                spot = places[best[r, k * FILTERS + f] + at]
                filter_grad[at] = vectors[spot].T @ spread
                spots.append(spot)
                grads.append(g[:, None] * weights[at].T[f])
            step(weights, filter_grad + 1e-4 * weights, squares["f"][k])
        moved, change = _summed(np.concatenate(spots), np.concatenate(grads))
        for table, columns, square in ((model.words, own[moved, :1], squares["w"]), (model.prefixes, own[moved, 2:], squares["p"])):
            slots, total = _summed(columns.ravel(), np.repeat(change, columns.shape[1], axis=0))
            square[slots] += (total * total).mean(1)
            table[slots] -= RATE * total / np.sqrt(square[slots])[:, None]
        step(model.bias, inner.sum(0), squares["b"])
        step(model.out, pool.T @ error + 1e-4 * model.out, squares["o"])
        squares["c"] += float(error.sum()) ** 2
        model.offset -= RATE * float(error.sum()) / squares["c"] ** 0.5


def threshold(logits: np.ndarray, y: np.ndarray, n: np.ndarray | None = None) -> float:
    """The cut with the best balanced accuracy, ``n`` rows each; of several, the middle of the widest gap."""
    n = np.ones(len(y), np.int64) if n is None else n
    v, at = np.unique(logits, return_inverse=True)
    toxic, clean = (np.concatenate([[0], np.cumsum(np.bincount(at, n * (y == c), len(v)))]) for c in (1, 0))
    cost = toxic / max(1, toxic[-1]) + 1 - clean / max(1, clean[-1])  # toxic rows below the cut, clean rows above it
    edges = np.concatenate([[v[0] - 2], v, [v[-1] + 2]])
    gap = edges[1:] - edges[:-1]
    k = max(np.flatnonzero(cost <= cost.min() + 1e-9), key=lambda i: gap[i])
    return float((edges[k] + edges[k + 1]) / 2)


def calibrated(model: Model, ids: np.ndarray, every: np.ndarray, starts: np.ndarray, y: np.ndarray) -> Model:
    """The model with its thresholds for these texts."""
    logits = model.pooled(ids, every, starts) @ model.out + model.offset
    return _cut(model, languages(ids, every, starts), logits, y, np.ones(len(y), np.int64))


def _cut(model: Model, spoken: np.ndarray, logits: np.ndarray, y: np.ndarray, n: np.ndarray, least: int = 20) -> Model:
    """The model with its thresholds, of all texts and of each language with ``least`` texts of each class."""
    model.thresholds[:] = threshold(logits, y, n)
    for k in range(1, len(LANGUAGES) + 1):
        own = spoken == k
        if min(n[own & (y == 1)].sum(), n[own & (y == 0)].sum()) >= least:
            model.thresholds[k] = threshold(logits[own], y[own], n[own])
    return model


def fitted(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, text_bytes: int = FIT_TEXT_BYTES) -> Model:
    """A quick model on the driver, from at most ``rows`` labelled ids of each class outside the held-out fold.

    ``toxicity`` does not use it: it learns from all of them. Here texts of more than ``text_bytes`` bytes are not learnt from, so at most
    2 * rows * text_bytes bytes reach the driver; of an id that many documents
    have, the least text.
    """
    sample = labelled_sample(docs, labels, "toxic", fold(5) != 0, rows, each=True)
    texts = sample.select("doc_id", "label_", text_or_empty().alias("text")).where(F.octet_length("text") <= text_bytes)
    found = texts.groupBy("doc_id").agg(F.max("label_").cast("int").alias("y"), F.min("text").alias("text")).collect()
    found.sort(key=lambda r: zlib.crc32(str(r["doc_id"]).encode()))
    return train([r["text"] for r in found], np.array([r["y"] for r in found], np.int64)) if found else _blank()


def _flat(model: Model, squares: dict) -> np.ndarray:
    """Network and squares as one matrix: a row for each word slot and prefix slot, then everything else in rows as wide."""
    words, prefixes = (np.column_stack([table, square]) for table, square in ((model.words, squares["w"]), (model.prefixes, squares["p"])))
    rest = np.concatenate([*map(np.ravel, model.filters), model.bias, model.out, [model.offset], *map(np.ravel, squares["f"]), squares["b"], squares["o"], [squares["c"]]])
    rest = np.pad(rest, (0, -len(rest) % (SIZE + 1))).reshape(-1, SIZE + 1)
    return np.concatenate([words, prefixes, rest]).astype(np.float32, copy=False)


def _unflat(state: np.ndarray) -> tuple[Model, dict]:
    """Network and squares of a matrix of ``_flat``, as copies."""
    model, state = _blank(), state.copy()
    tables = WORD_SLOTS + PREFIX_SLOTS
    model.words, model.prefixes = state[:WORD_SLOTS, :SIZE], state[WORD_SLOTS:tables, :SIZE]
    shapes = [*(f.shape for f in model.filters), model.bias.shape, model.out.shape, (1,)] * 2
    ends = np.cumsum([int(np.prod(shape)) for shape in shapes])
    parts = [x.reshape(shape) for x, shape in zip(np.split(state[tables:].ravel(), ends)[:-1], shapes, strict=True)]
    n = len(model.filters)
    model.filters, (model.bias, model.out, offset) = parts[:n], parts[n : n + 3]
    bias, out, last = parts[2 * n + 3 :]
    model.offset = float(offset[0])
    return model, {"w": state[:WORD_SLOTS, SIZE], "p": state[WORD_SLOTS:tables, SIZE], "f": parts[n + 3 : 2 * n + 3], "b": bias, "o": out, "c": float(last[0])}


# Arrays in pieces, so that no page or buffer of the store is as large as a shard; slots take 16 bits.
SHARD = "shard int, ids array<binary>, every array<binary>, starts array<binary>, y array<binary>, held array<binary>"


def _packed(rows: pa.Table) -> pa.Table:
    """The texts of a shard as numbers, one row of ``SHARD``, in an order of their own."""
    names = rows.column("id").to_pylist()
    rows = rows.take(sorted(range(len(names)), key=lambda k: (zlib.crc32(names[k].encode()), names[k])))
    ids, every, starts = indexed(t.as_py() for t in rows.column("text"))
    arrays = ids.astype(np.uint16), every.astype(np.uint16 if len(ids) <= 1 << 16 else np.uint32), starts, np.array(rows.column("y"), np.int8), np.array(rows.column("held"), np.int8)
    pieces = ([memoryview(a).cast("B")[k : k + PIECE] for k in range(0, a.nbytes, PIECE)] for a in (a.ravel() for a in arrays))
    return pa.table({"shard": rows.column("shard")[:1].combine_chunks()} | {k: pa.array([p], pa.list_(pa.binary())) for k, p in zip(("ids", "every", "starts", "y", "held"), pieces, strict=True)})


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple[np.ndarray, ...], np.ndarray, np.ndarray]]:
    """(shard, (ids, every, starts), y, held) of each row of ``SHARD``; ids and every as narrow as they are stored."""

    def whole(pieces: pa.ListScalar, kind: type) -> np.ndarray:
        return np.concatenate([np.zeros(0, kind), *(np.frombuffer(p.as_buffer(), kind) for p in pieces.values)])

    for batch in batches:
        for k in range(batch.num_rows):
            raw = [batch.column(c)[k] for c in range(1, 6)]
            ids = whole(raw[0], np.uint16).reshape(-1, 2 + len(PREFIXES))
            every = whole(raw[1], np.uint16 if len(ids) <= 1 << 16 else np.uint32)
            yield batch.column(0)[k].as_py(), (ids, every, whole(raw[2], np.int64)), whole(raw[3], np.int8).astype(np.int64), whole(raw[4], np.int8) == 1


def _round(shards: DataFrame, state: np.ndarray, turn: int, weights: np.ndarray, spare: bool) -> tuple[np.ndarray, np.ndarray]:
    """The state after one epoch in every shard, and the slots that occurred (in the first round) or moved.

    ``weights`` are those of the two classes; with ``spare`` the held rows train nothing.
    The state is sent once and dropped by the executors when the round ends.
    """
    shape, sent = state.shape, shards.sparkSession.sparkContext.broadcast(state)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = sent.value
        sums, counts, seen = np.zeros(shape, np.int64), np.zeros(shape[0], np.int64), np.zeros(shape[0], bool)
        for shard, (ids, every, starts), y, held in _unpacked(batches):
            rows = np.flatnonzero(~held) if spare else np.arange(len(y))
            if not len(rows):
                continue
            model, squares = _unflat(before)
            _epoch(model, squares, ids, every, starts, y, weights[y], np.random.default_rng((SEED, turn, shard)).permutation(rows))
            change = _flat(model, squares)
            del model, squares
            change -= before
            moved = change.any(1)
            for low in range(0, len(change), STRIP):
                sums[low : low + STRIP] += np.rint(change[low : low + STRIP].astype(np.float64) * GRID).astype(np.int64)
            counts += moved
            seen |= moved
            if turn == 0:
                here = np.zeros(len(ids), bool)
                for r in rows:
                    here[every[starts[r] : starts[r + 1]]] = True
                own = ids[here].astype(np.int64)
                seen[own[:, 0]] = True
                seen[WORD_SLOTS + own[:, 2:]] = True
        for part in range(PARTS):
            at = np.flatnonzero(seen[part::PARTS]) * PARTS + part
            if len(at):
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "at": [at.astype(np.int32).tobytes()], "sums": [sums[at].tobytes()], "counts": [counts[at].tobytes()]})

    def add(rows: pa.Table) -> pa.Table:
        sums, counts, seen = np.zeros(shape, np.int64), np.zeros(shape[0], np.int64), np.zeros(shape[0], bool)
        for k in range(rows.num_rows):
            at = np.frombuffer(rows.column("at")[k].as_buffer(), np.int32)
            sums[at] += np.frombuffer(rows.column("sums")[k].as_buffer(), np.int64).reshape(len(at), -1)
            counts[at] += np.frombuffer(rows.column("counts")[k].as_buffer(), np.int64)
            seen[at] = True
        at = np.flatnonzero(seen)
        mean = (sums[at] / (GRID * np.maximum(1, counts[at]))[:, None]).astype(np.float32)
        return pa.table({"at": [at.astype(np.int32).tobytes()], "mean": [mean.tobytes()]})

    done, seen = state.copy(), np.zeros(len(state), bool)
    try:
        found = shards.mapInArrow(run, "part int, at binary, sums binary, counts binary").groupBy("part").applyInArrow(add, "at binary, mean binary").collect()
    finally:
        sent.destroy()
    for r in found:
        at = np.frombuffer(r["at"], np.int32)
        done[at] += np.frombuffer(r["mean"], np.float32).reshape(len(at), -1)
        seen[at] = True
    return done, seen


def _counted(shards: DataFrame, model: Model, spare: bool) -> tuple[np.ndarray, ...]:
    """Language, logit, label and number of the held rows (without ``spare``: of all), by bins of the logit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (ids, every, starts), y, held in _unpacked(batches):
            rows = np.flatnonzero(held) if spare else np.arange(len(y))
            if not len(rows):
                continue
            own = np.concatenate([every[starts[r] : starts[r + 1]] for r in rows])
            bounds = np.concatenate([[0], np.cumsum(np.diff(starts)[rows])])
            logits = model.pooled(ids, own, bounds) @ model.out + model.offset
            bins = np.clip(np.rint(logits * BIN), -BINS, BINS).astype(np.int64)
            found, n = np.unique(np.stack([languages(ids, own, bounds), bins, y[rows]], 1), axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([*map(pa.array, found.T), pa.array(n)], names=["spoken", "bin", "y", "n"])

    counted = shards.mapInArrow(run, "spoken long, bin long, y long, n long").groupBy("spoken", "bin", "y").agg(F.sum("n").alias("n")).collect()
    spoken, bins, y, n = np.array(counted, np.int64).reshape(-1, 4).T
    return spoken, bins / BIN, y, n


def _labelled(docs: DataFrame, known: DataFrame, value: Column, kind: Callable[[Column], Column]) -> DataFrame:
    """(doc_id, y, value) of each doc_id of ``known`` that documents have; ``kind`` makes one value of several.

    A map of ``MAP_BITS`` bits, as large for any input, drops nearly all other
    rows before anything is dealt out; the join drops the rest. Rows with one id
    are reduced before the join, so that a frequent id is no hot key.
    """
    spot = F.pmod(F.xxhash64("doc_id", F.lit("map")), F.lit(MAP_BITS))
    bits = known.select(spot.alias("spot_")).groupBy(F.expr("spot_ div 32768").alias("block_"))
    bits = bits.agg(F.bitmap_construct_agg(F.col("spot_") % 32768).alias("bits_"))
    rows = docs.where("doc_id is not null").select("doc_id", value.alias("value"), spot.alias("spot_")).withColumn("block_", F.expr("spot_ div 32768"))
    byte = F.conv(F.hex(F.expr("substring(bits_, cast(spot_ % 32768 div 8 + 1 as int), 1)")), 16, 10).cast("int")
    met = rows.join(F.broadcast(bits), "block_").where(byte.bitwiseAND(F.expr("shiftleft(1, cast(spot_ % 8 as int))")) != 0)
    return met.groupBy("doc_id").agg(kind(F.col("value")).alias("value")).join(known, "doc_id").withColumnRenamed("y_", "y")


def learnt(docs: DataFrame, labels: DataFrame, shard_rows: int = SHARD_ROWS, shard_bytes: int = SHARD_BYTES) -> Model:
    """The model from every labelled id outside the held-out fold that has a document, whole texts.

    Every fifth id by hash sets the thresholds and the others train the network;
    where that leaves a class with fewer than 20 ids, all of them do both.
    """
    known = labels.where((fold(5) != 0) & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y_"))
    held = F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(5)) == 4
    sizes = _labelled(docs, known, F.octet_length(text_or_empty()), F.max)
    sizes = sizes.groupBy("y", held.alias("held")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("size")).collect()
    count = lambda c, *kinds: sum(r["n"] for r in sizes if r["y"] == c and r["held"] in kinds)
    if min(count(c, True, False) for c in (0, 1)) == 0:
        return _blank()
    spare = min(count(c, True) for c in (0, 1)) >= 20 and min(count(c, False) for c in (0, 1)) > 0
    trained = np.array([count(c, False, not spare) for c in (0, 1)])
    weights = 0.5 * trained.sum() / trained
    n = max(-(-sum(r["n"] for r in sizes) // shard_rows), -(-sum(r["size"] for r in sizes) // shard_bytes), 1)
    shard = F.pmod(F.xxhash64("doc_id", F.lit("shard")), F.lit(n)).cast("int")
    rows = _labelled(docs, known, text_or_empty(), F.min)
    rows = rows.select(shard.alias("shard"), F.col("doc_id").cast("string").alias("id"), "y", held.cast("int").alias("held"), F.col("value").alias("text"))
    shards = written(rows.repartition(4 * n, "shard").groupBy("shard").applyInArrow(_packed, SHARD))
    state = _flat(*_start(np.random.default_rng(SEED)))
    state, seen = _round(shards, state, 0, weights, spare)
    for turn in range(1, EPOCHS):
        state, _ = _round(shards, state, turn, weights, spare)
    model, _ = _unflat(state)
    _known(model, np.flatnonzero(seen[:WORD_SLOTS]), np.flatnonzero(seen[WORD_SLOTS : WORD_SLOTS + PREFIX_SLOTS]))
    return _cut(model, *_counted(shards, model, spare))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; texts are read whole."""
    model = learnt(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in record_batches(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(batch.column(1).to_pylist()))], names=["doc_id", "score"])

    ids = docs.schema["doc_id"].dataType.simpleString()
    picked = docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, f"doc_id {ids}, score double")
    return picked.select("doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
