"""SentencePiece encoding and decoding with N-best segmentations of a piece lattice.

A text is cut where no piece of the vocabulary can reach across; each chunk is a
lattice of its own, and the best segmentation of a text is the chain of its
chunks' best ones. A chunk's N best come from a backward A* search whose
heuristic is the forward Viterbi score, which is exact, so paths leave the queue
in order of their total score. The N best of a text deviate only in its N - 1
chunks with the smallest loss of the second-best path, so only those need a
search; the losses of all chunks come from vectorised forward and backward
Viterbi passes over all distinct chunks of a batch.

The vocabulary is a public one with byte fallback and is never trained; its
pieces are ranked, and a piece of rank r has the log probability -log(r + 2) up
to a constant, on a grid of 2^-20. Characters without a piece become their UTF-8 bytes.

Defined results: null and empty texts have no pieces and the one score 0; a text
with a single segmentation has one score; equal scores keep the longer last
piece first; repeated rows get equal results. Decoding gives every text back.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import as_strided
from pyspark.sql import DataFrame

from .common import record_batches, text_or_empty

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
N_BEST = 4
UNKNOWN_LOSS = 10.0  # fixed value: what an unknown character costs beyond the worst piece
SPACE_MARK = "▁"
#: Chunks: a line end, letters, digits or other characters, each with the spaces before it, or spaces alone.
CHUNK = re.compile(r" *(?:[^\W\d_²]+|\d{1,3}|(?:[^\w \n]|[_²])+)|\n| +")
#: Bytes of remembered chunks; one costs about 240 bytes beside its text and ids.
MEMO_BYTES = 64 << 20
MEMO_SEARCHES = 20_000
VECTOR_CHARS = 64
GRID = 2.0**-20
BATCH_CELLS = 24_000
_PRIME = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """A vocabulary as a hash table of substrings, and the chunks solved so far."""

    def __init__(self, path: str):
        import sentencepiece

        tool = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [tool.id_to_piece(k).replace(SPACE_MARK, " ") for k in range(tool.get_piece_size())]
        self.bytes = {int(self.pieces[k][3:5], 16): k for k in range(len(self.pieces)) if tool.is_byte(k)}
        byte_of = {v: k for k, v in self.bytes.items()}
        self.raw = [bytes([byte_of[k]]) if k in byte_of else p.encode("utf-8", "surrogatepass") for k, p in enumerate(self.pieces)]
        usual = [k for k in range(len(self.pieces)) if not (tool.is_byte(k) or tool.is_control(k) or tool.is_unknown(k) or tool.is_unused(k))]
        if any(CHUNK.fullmatch(self.pieces[k]) is None or "\0" in self.pieces[k] for k in usual):
            raise ValueError("a piece reaches across a chunk's end")
        self.ids = {self.pieces[k]: k for k in usual}
        # Multiples of GRID add up without rounding, so equal totals are equal in every order of addition.
        self.scores = {self.pieces[k]: -round(float(np.log(r + 2)) / GRID) * GRID for r, k in enumerate(usual)}
        self.unknown = min(self.scores.values()) - UNKNOWN_LOSS
        self.longest = max(map(len, self.ids))
        self.powers = np.array([pow(int(_PRIME), k, 1 << 64) for k in range(self.longest + 1)], np.uint64)
        self._table()
        self.forget()
        self.searched: dict[tuple[str, int], list[tuple[float, tuple[int, ...]]]] = {}
        self.last: tuple[str, tuple[np.ndarray, ...]] = ("", ())

    def forget(self) -> None:
        """Empties the memory of solved chunks: their numbers, ids (one after the other), scores and losses."""
        self.memo: dict[str, int] = {}
        self.pool, self.ends = array("i"), array("q", [0])
        self.gains, self.losses = array("d"), array("d")
        self.used = 0

    # ------------------------------------------------------------ hash table

    def _table(self, bits: int = 18) -> None:
        self.shift = np.uint64(64 - bits)
        self.mask = (1 << bits) - 1
        self.keys = np.zeros(1 << bits, np.uint64)
        self.slots = np.full(1 << bits, -1, np.int32)
        for piece, number in self.ids.items():
            h = 0
            for c in piece:
                h = (h * int(_PRIME) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
            at = ((h * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF) >> (64 - bits)
            while self.slots[at] >= 0:
                at = (at + 1) & self.mask
            self.keys[at], self.slots[at] = h, number
        self.value = np.full(len(self.pieces) + 1, -np.inf)
        for piece, number in self.ids.items():
            self.value[number] = self.scores[piece]

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Piece ids of substring hashes, -1 where none."""
        flat = hashes.ravel()
        at = ((flat * np.uint64(0xD6E8FEB86659FD93)) >> self.shift).astype(np.int64)
        out = np.full(len(flat), -1, np.int32)
        todo = np.arange(len(flat))
        while len(todo):
            found = self.slots[at]
            same = self.keys[at] == flat[todo]
            hit = same & (found >= 0)
            out[todo[hit]] = found[hit]
            on = ~same & (found >= 0)
            todo, at = todo[on], (at[on] + 1) & self.mask
        return out.reshape(hashes.shape)

    # ------------------------------------------------------------ one chunk

    def edges(self, chunk: str) -> tuple[Callable[[int], list[tuple[int, float, int]]], list[float]]:
        """The edges (start, score, id or -1) into every place of a short chunk, longest first, and forward scores."""
        into: list[list[tuple[int, float, int]]] = [[]]
        best = [0.0]
        for end in range(1, len(chunk) + 1):
            own = [(start, self.scores[piece], self.ids[piece]) for start in range(max(0, end - self.longest), end) if (piece := chunk[start:end]) in self.ids]
            if not own or own[-1][0] != end - 1:
                own.append((end - 1, self.unknown, -1))
            into.append(own)
            best.append(max(best[start] + score for start, score, _ in own))
        return into.__getitem__, best

    def long_edges(self, chunk: str) -> tuple[Callable[[int], list[tuple[int, float, int]]], np.ndarray]:
        """``edges`` of a chunk of any length."""
        first, start, score, number = self.lattice(chunk)

        def into(end: int) -> list[tuple[int, float, int]]:
            own = slice(first[end], first[end + 1])
            return list(zip(start[own].tolist(), score[own].tolist(), number[own].tolist(), strict=True))

        return into, self.forward(chunk)

    def lattice(self, chunk: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first, start, score, id or -1) of the edges of a chunk.

        The edges that end at place e are those from ``first[e]`` to
        ``first[e + 1]``, longest first. The last long chunk's are remembered.
        """
        if self.last[0] == chunk:
            return self.last[1]
        points = np.frombuffer(chunk.encode("utf-32-le", "surrogatepass"), np.uint32)
        hashes = np.zeros(len(points) + 1, np.uint64)
        starts, ends, ids = [], [], []
        for k in range(1, min(self.longest, len(points)) + 1):
            hashes = hashes[:-1] * _PRIME + points[k - 1 :] + np.uint64(1)
            found = self.lookup(hashes)
            hit = np.arange(len(found)) if k == 1 else np.flatnonzero(found >= 0)
            starts.append(hit.astype(np.int32))
            ends.append((hit + k).astype(np.int32))
            ids.append(found[hit])
        start, end, number = map(np.concatenate, (starts, ends, ids))
        order = np.lexsort((start, end))
        start, number = start[order], number[order]
        score = np.where(number < 0, self.unknown, self.value[number])
        first = np.searchsorted(end[order], np.arange(len(points) + 2))
        self.last = chunk, (first, start, score, number)
        return self.last[1]

    def forward(self, chunk: str) -> np.ndarray:
        """The Viterbi score of every prefix."""
        first, start, score, _ = self.lattice(chunk)
        best = np.zeros(len(chunk) + 1)
        for low in range(1, len(chunk) + 1, 1 << 15):
            high = min(len(chunk) + 1, low + (1 << 15))
            bounds = first[low : high + 1].tolist()
            origin, gain = start[bounds[0] : bounds[-1]].tolist(), score[bounds[0] : bounds[-1]].tolist()
            base = max(0, low - self.longest)
            own = best[base:low].tolist()
            at = 0
            for b in bounds[1:]:
                top = -np.inf
                while at < b - bounds[0]:
                    total = own[origin[at] - base] + gain[at]
                    if total > top:
                        top = total
                    at += 1
                own.append(top)
            best[low:high] = own[low - base :]
        return best

    def expand(self, chunk: str, path: list[tuple[int, int, int]]) -> tuple[int, ...]:
        """Token ids of a path of (start, end, id) edges; unknown characters become bytes."""
        out: list[int] = []
        for start, end, number in path:
            out.extend([number] if number >= 0 else [self.bytes[b] for b in chunk[start:end].encode("utf-8", "surrogatepass")])
        return tuple(out)

    def search(self, chunk: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The ``n`` best segmentations of a chunk, best first: backward A* with forward scores.

        Of equal totals the one nearest to the chunk's begin leaves the queue
        first, so ties run straight to the end; a place that was left ``n``
        times is not left again, as no further path through it can be among
        the ``n`` best. Work is at most ``n`` times the lattice.
        """
        found = self.searched.get((chunk, n))
        if found is not None:
            return found
        edges, ahead = self.edges(chunk) if len(chunk) <= VECTOR_CHARS else self.long_edges(chunk)
        queue = [(-float(ahead[-1]), len(chunk), 0, 0.0, None)]
        out, count, left = [], 0, {}
        while queue and len(out) < n:
            _, place, _, behind, path = heapq.heappop(queue)
            if place == 0:
                chain = []
                while path is not None:
                    chain.append(path[0])
                    path = path[1]
                out.append((behind, self.expand(chunk, chain)))
                continue
            times = left.get(place, 0)
            if times == n:
                continue
            left[place] = times + 1
            for start, score, number in edges(place):
                count += 1
                heapq.heappush(queue, (-(behind + score + ahead[start]), start, count, behind + score, ((start, place, number), path)))
        if len(self.searched) >= MEMO_SEARCHES:
            self.searched.clear()
        if len(chunk) <= VECTOR_CHARS:
            self.searched[chunk, n] = out
        return out

    # ------------------------------------------------------------ many chunks

    def solve(self, chunks: list[str]) -> list[tuple[bytes, float, float]]:
        """(ids, score, loss of the second-best path) of every chunk; the loss is inf where there is one path."""
        out: list = [None] * len(chunks)
        groups: dict[int, list[int]] = {}
        for k, chunk in enumerate(chunks):
            size = len(chunk)
            if size > VECTOR_CHARS:
                two = self.search(chunk, 2)
                out[k] = (np.array(two[0][1], np.int32).tobytes(), two[0][0], two[0][0] - two[1][0] if len(two) > 1 else np.inf)
            else:
                groups.setdefault(-(-size // 4) * 4 if size <= 24 else VECTOR_CHARS, []).append(k)
        for size, members in groups.items():
            step = max(1, BATCH_CELLS // size)  # few enough that a batch's arrays stay in the processor's cache
            for low in range(0, len(members), step):
                part = members[low : low + step]
                for k, row in zip(part, self._solve([chunks[k] for k in part], size), strict=True):
                    out[k] = row
        return out

    def _solve(self, chunks: list[str], size: int) -> list[tuple[bytes, float, float]]:
        """``solve`` for chunks of at most ``size`` characters, all at once; U+0000, which no piece has, fills them up."""
        n = len(chunks)
        sizes = np.fromiter(map(len, chunks), np.int64, n)
        # Places come first, so that a place's values of all chunks lie together.
        points = np.frombuffer("".join([c.ljust(size, "\0") for c in chunks]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, size).T.astype(np.uint64) + np.uint64(1)
        prefix = np.zeros((size + 1, n), np.uint64)
        for k in range(size):
            prefix[k + 1] = prefix[k] * _PRIME + points[k]
        longest = min(self.longest, size)
        ids = np.full((size, longest, n), -1, np.int32)  # by start, length - 1 and chunk
        for k in range(1, longest + 1):
            ids[: size - k + 1, k - 1] = self.lookup(prefix[k:] - prefix[:-k] * self.powers[k])
        score = self.value[ids]
        lone = (ids[:, 0] < 0) & (np.arange(size)[:, None] < sizes)
        score[:, 0][lone] = self.unknown
        ahead, behind = np.full((size + 1, n), -np.inf), np.full((size + 1, n), -np.inf)
        ahead[0], behind[sizes, np.arange(n)] = 0, 0
        last = np.zeros((size + 1, n), np.int64)
        rows = np.arange(n)
        by_start, by_length, by_chunk = score.strides
        for end in range(1, size + 1):
            most = min(longest, end)
            # The edges into a place, longest first, so that of equal totals the longest wins.
            into = as_strided(score[end - most :, most - 1 :], (most, n), (by_start - by_length, by_chunk))
            total = ahead[end - most : end] + into
            pick = total.argmax(0)
            ahead[end], last[end] = total[pick, rows], most - pick
            start = size - end
            np.maximum(behind[start], (score[start, :most] + behind[start + 1 : start + most + 1]).max(0), out=behind[start])
        chosen = np.zeros((size, n), np.int64)
        place = sizes.copy()
        while (live := place > 0).any():
            r = rows[live]
            length = last[place[live], r]
            place[live] -= length
            chosen[place[live], r] = length
        second = np.full(n, -np.inf)
        for k in range(1, longest + 1):
            through = ahead[: size - k + 1] + score[: size - k + 1, k - 1] + behind[k:]
            through[chosen[: size - k + 1] == k] = -np.inf
            second = np.maximum(second, through.max(0))
        best = ahead[sizes, rows]
        loss = np.where(np.isinf(second), np.inf, np.maximum(best - second, 0))
        where, start = np.nonzero(chosen.T)
        number = ids[start, chosen[start, where] - 1, where]
        if (number >= 0).all():
            edges = np.concatenate([[0], np.cumsum(np.bincount(where, minlength=n))]) * 4
            raw = number.astype(np.int32).tobytes()
            packed = [raw[edges[k] : edges[k + 1]] for k in range(n)]
        else:
            packed = []
            lists: list[list[int]] = [[] for _ in range(n)]
            for r, s, x in zip(where.tolist(), start.tolist(), number.tolist(), strict=True):
                lists[r].extend([x] if x >= 0 else [self.bytes[b] for b in chunks[r][s].encode("utf-8", "surrogatepass")])
            packed = [np.array(x, np.int32).tobytes() for x in lists]
        return list(zip(packed, best.tolist(), loss.tolist(), strict=True))

    # ------------------------------------------------------------ texts

    def chunks(self, text: str) -> list[str]:
        """The chunks of a text with the model's leading space."""
        return CHUNK.findall(" " + text) if text else []

    def numbers(self, chunks: list[str]) -> np.ndarray:
        """The numbers of chunks in the memory, which learns those that it lacks."""
        if self.used > MEMO_BYTES:
            self.forget()
        get = self.memo.get
        out = np.array([get(c, -1) for c in chunks], np.int64)
        lacking = np.flatnonzero(out < 0).tolist()
        if lacking:
            new = list(dict.fromkeys([chunks[k] for k in lacking]))
            ids, scores, losses = zip(*self.solve(new), strict=True)
            self.memo.update(zip(new, range(len(self.gains), len(self.gains) + len(new)), strict=True))
            sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            self.ends.frombytes((self.ends[-1] + np.cumsum(sizes)).tobytes())
            self.pool.frombytes(b"".join(ids))
            self.gains.extend(scores)
            self.losses.extend(losses)
            self.used += 240 * len(new) + sum(map(len, new)) + 4 * int(sizes.sum())
            out[lacking] = [self.memo[chunks[k]] for k in lacking]
        return out

    def encode_all(self, texts: list[list[str]], n: int) -> tuple[np.ndarray, np.ndarray, list[list[float]], list[list[str]]]:
        """For texts as chunks: all ids, where each text's end (from 0), scores of the N best, and what the others change.

        A change is ``chunk=ids`` with ids joined by commas, changes joined by ``;``.
        """
        numbers = self.numbers([c for text in texts for c in text])
        bounds = np.cumsum([0, *map(len, texts)])
        ends = np.frombuffer(self.ends, np.int64)
        starts, sizes = ends[numbers], ends[numbers + 1] - ends[numbers]
        edges = np.concatenate([[0], np.cumsum(sizes)])
        ids = np.frombuffer(self.pool, np.int32)[np.repeat(starts - edges[:-1], sizes) + np.arange(edges[-1])] if len(numbers) else np.zeros(0, np.int32)
        loss, gain = np.frombuffer(self.losses)[numbers], np.frombuffer(self.gains)[numbers]
        found = [self._others(text, loss[a:b], float(gain[a:b].sum()), n) if text else ([0.0], []) for text, a, b in zip(texts, bounds[:-1], bounds[1:], strict=True)]
        return ids, edges[bounds], [f[0] for f in found], [f[1] for f in found]

    def encode(self, chunks: list[str], n: int) -> tuple[bytes, list[float], list[str]]:
        """``encode_all`` of one text."""
        ids, _, scores, changes = self.encode_all([chunks], n)
        return ids.tobytes(), scores[0], changes[0]

    def _others(self, chunks: list[str], loss: np.ndarray, score: float, n: int) -> tuple[list[float], list[str]]:
        """Scores of the N best and the changes of all but the best, from the chunks' losses and the best score."""
        few = np.argsort(loss, kind="stable")[: n - 1] if len(loss) < 64 else self._least(loss, n - 1)
        few = [int(k) for k in few if np.isfinite(loss[k])]
        options = [self.search(chunks[k], n) for k in few]
        queue: list[tuple[float, tuple[int, ...]]] = [(0.0, (0,) * len(few))]
        seen, scores, changes = {queue[0][1]}, [], []
        while queue and len(scores) < n:
            cost, pick = heapq.heappop(queue)
            scores.append(score - cost)
            if any(pick):
                changes.append(";".join(f"{k}={','.join(map(str, options[j][p][1]))}" for j, (k, p) in enumerate(zip(few, pick, strict=True)) if p))
            for j, p in enumerate(pick):
                if p + 1 < len(options[j]):
                    following = (*pick[:j], p + 1, *pick[j + 1 :])
                    if following not in seen:
                        seen.add(following)
                        heapq.heappush(queue, (sum(options[i][0][0] - options[i][q][0] for i, q in enumerate(following)), following))
        return scores, changes

    @staticmethod
    def _least(loss: np.ndarray, n: int) -> np.ndarray:
        cut = np.partition(loss, n - 1)[n - 1]
        near = np.flatnonzero(loss <= cut)
        return near[np.argsort(loss[near], kind="stable")][:n]

    def decode(self, ids: list[int]) -> str:
        """The text of a sequence of ids."""
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "surrogatepass")[1:]


@lru_cache(maxsize=2)
def vocabulary(path: str = MODEL) -> Pieces:
    return Pieces(path)


ENCODED = "ids array<int>, n_pieces int, scores array<double>, changes array<string>"


def encoded(docs: DataFrame, n: int = N_BEST, path: str = MODEL, keep: tuple[str, ...] = ("doc_id",), check: bool = False) -> DataFrame:
    """``keep`` columns and the N best segmentations of every whole text.

    With ``check`` the ids are decoded again, and ``lossless`` says whether that gives the text back.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = vocabulary(path)
        for batch in record_batches(batches, 256, 4 << 20):
            texts = batch.column(batch.num_columns - 1).to_pylist()
            ids, ends, scores, changes = tool.encode_all([tool.chunks(t) for t in texts], n)
            back = [pa.array([tool.decode(ids[a:b].tolist()) == t for t, a, b in zip(texts, ends, ends[1:], strict=False)], pa.bool_())] if check else []
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
            columns = [batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, lists, pa.array(np.diff(ends).astype(np.int32)), pa.array(scores, pa.list_(pa.float64())), pa.array(changes, pa.list_(pa.string())), *back], names=[*keep, "ids", "n_pieces", "scores", "changes", *(["lossless"] if check else [])])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, text_or_empty().alias("text_")).mapInArrow(run, f"{schema}, {ENCODED}{', lossless boolean' if check else ''}")


def decoded(rows: DataFrame, path: str = MODEL, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``text`` from the ids of ``encoded``; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = vocabulary(path)
        for batch in record_batches(batches):
            texts = [tool.decode(x or []) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(batch.num_columns - 1)), pa.array(texts, pa.string())], names=[*keep, "text"])

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.select(*keep, "ids").mapInArrow(run, f"{schema}, text string")
