"""Token ids packed into fixed-length rows, as binary matrices.

Texts become token ids of a public byte-level BPE vocabulary (uint16). A
document longer than a row is split into whole rows and a rest, losslessly; the
pieces of a shard are packed best-fit decreasing: a segment tree over the free
capacities finds the fullest row that still takes a piece. Each packed row
carries its ids, the cumulative segment lengths, and the offsets at which
position numbers restart.

Shards are hash shards of bounded expected size, so no task gathers more than
one shard, and the packing depends on neither file layout nor task order. Equal
rows that would overfill a shard are dealt to several; which of them goes where
is open, but they are equal. ``matrices`` gives each shard's rows as one matrix,
``write_matrices`` and ``read_matrices`` store and restore them.

Defined results: null and empty texts have no tokens and therefore no segment;
repeated rows are packed as often as they occur; rows come in a fixed order
within a shard. ``unpack`` restores every token sequence.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import record_batches, text_or_empty

ROW = 2048
SHARD_BYTES = 4 << 20
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the public vocabulary's pattern (also in its README).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Runs of white space too long for the pattern's lookahead, which needs stack for each character.
LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{2000,}")
#: Fills rows up; no token of the vocabulary has this id.
PAD = 0xFFFF


class Encoder:
    """Ids of texts, and texts of ids."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.base = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        """A long run of white space is one piece, without its last character if a word follows."""
        out, at = [], 0
        for run in LONG_SPACE.finditer(text):
            end = run.end() - (run.end() < len(text))
            out += [self._ids(text[at : run.start()]), np.array(self.base._encode_single_piece(text[run.start() : end]), "<u2")]
            at = end
        out.append(self._ids(text[at:]))
        return np.concatenate(out) if len(out) > 1 else out[0]

    def _ids(self, text: str) -> np.ndarray:
        return self.base.encode_to_numpy(text, disallowed_special=()).astype("<u2")

    def decode(self, ids: np.ndarray) -> str:
        return self.base.decode(ids.tolist())


@lru_cache(maxsize=2)
def encoder(path: str = VOCABULARY) -> Encoder:
    return Encoder(path)


class BestFit:
    """Open rows by free capacity, as a segment tree over the capacities 0..row.

    A node holds how many open rows lie in its range; the search walks to the
    smallest capacity of at least the wanted size in log2(row) steps.
    """

    def __init__(self, row: int):
        self.width = 1 << row.bit_length()
        self.count = [0] * (2 * self.width)
        self.rows: list[list[int]] = [[] for _ in range(row + 1)]

    def _add(self, free: int, by: int) -> None:
        node = free + self.width
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, row: int, free: int) -> None:
        if free:
            self.rows[free].append(row)
            self._add(free, 1)

    def take(self, size: int) -> tuple[int, int] | None:
        """The row with the least sufficient free capacity, removed, and that capacity."""
        node, count = size + self.width, self.count
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.width:
                node = 2 * node if count[2 * node] else 2 * node + 1
        free = node - self.width
        self._add(free, -1)
        return self.rows[free].pop(), free


def best_fit_decreasing(sizes: list[int], row: int = ROW) -> list[list[int]]:
    """Indexes of the pieces in each row; sizes from 1 to ``row``. Ties keep their order."""
    tree, packed = BestFit(row), []
    for piece in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        found = tree.take(sizes[piece])
        if found is None:
            found = len(packed), row
            packed.append([])
        packed[found[0]].append(piece)
        tree.put(found[0], found[1] - sizes[piece])
    return packed


PACKED_SCHEMA = "shard long, row_in_shard int, doc_ids array<long>, parts array<int>, cu_seqlens array<int>, n_tokens int, position_resets array<int>, ids binary"
MATRIX_SCHEMA = "shard long, n_rows int, row int, cu_splits array<int>, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, parts array<int>, matrix binary"


def _arrow(names: str, kinds: tuple[pa.DataType, ...], rows: list[tuple]) -> pa.Table:
    """Rows as an Arrow table with the column names of a schema string."""
    columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in names.split(", ")])


def _rows(doc_ids: list[int | None], raw: list[bytes], row: int) -> Iterator[tuple[list[int | None], list[int], list[int], bytes]]:
    """Packed rows of one shard: doc_ids, parts, cumulative lengths and ids."""
    order = sorted(range(len(raw)), key=lambda k: (doc_ids[k] is None, doc_ids[k] or 0, raw[k]))
    pieces = [(k, part, at, min(2 * row, len(raw[k]) - at)) for k in order for part, at in enumerate(range(0, len(raw[k]), 2 * row))]
    for members in best_fit_decreasing([p[3] // 2 for p in pieces], row):
        own = [pieces[m] for m in members]
        ends = np.cumsum([0, *(p[3] // 2 for p in own)]).tolist()
        yield [doc_ids[p[0]] for p in own], [p[1] for p in own], ends, b"".join(raw[k][at : at + n] for k, _, at, n in own)


def _padded(ids: bytes, row: int, pad_id: int | None) -> bytes:
    return ids if pad_id is None else ids + np.full(row - len(ids) // 2, pad_id, "<u2").tobytes()


def _sharded(docs: DataFrame, shard_bytes: int, vocabulary: str) -> DataFrame:
    """(doc_id, shard, ids) of every text with tokens.

    A shard is the hash of (doc_id, text). Rows that agree in both and together
    fill more than a shard are dealt to as many shards as they fill.
    """
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).where("text <> ''")
    picked = picked.withColumn("h", F.xxhash64("doc_id", "text"))
    equal = picked.select("h", F.octet_length("text").cast("long").alias("size")).groupBy("h").agg(F.sum("size").alias("size"))
    found = equal.agg(F.sum("size"), F.max("size")).first()
    shards = max(1, -(-(found[0] or 0) // shard_bytes))
    if (found[1] or 0) > shard_bytes:
        # Fewer than `shards` such hashes exist; the planner broadcasts them only if they are small.
        hot = equal.where(F.col("size") > shard_bytes).select("h", F.ceil(F.col("size") / shard_bytes).alias("spread"))
        picked = picked.join(hot, "h", "left").withColumn("h", F.when(F.col("spread").isNull(), F.col("h")).otherwise(F.xxhash64("h", F.pmod(F.monotonically_increasing_id(), F.col("spread")))))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(vocabulary)
        for batch in record_batches(batches, 256, 1 << 20):
            ids = [tool.encode(t).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary())], names=["doc_id", "shard", "ids"])

    salted = picked.select("doc_id", F.pmod("h", F.lit(shards)).alias("shard"), "text")
    return salted.mapInArrow(encoded, "doc_id long, shard long, ids binary")


def pack(docs: DataFrame, row: int = ROW, shard_bytes: int = SHARD_BYTES, vocabulary: str = VOCABULARY, pad_id: int | None = PAD) -> DataFrame:
    """Packed rows of all texts.

    ``ids`` is a row of little-endian uint16, ``n_tokens`` of them valid, padded
    with ``pad_id`` to ``row`` ids (not padded where that is None). Segment k is
    ids[cu_seqlens[k] : cu_seqlens[k + 1]], the part ``parts[k]`` of document
    ``doc_ids[k]``; positions start again at each of ``position_resets``.
    """
    kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32(), pa.list_(pa.int32()), pa.binary())

    def packed(group: pa.Table) -> pa.Table:
        shard = group.column("shard")[0].as_py()
        made = _rows(group.column("doc_id").to_pylist(), group.column("ids").to_pylist(), row)
        return _arrow(PACKED_SCHEMA, kinds, [(shard, k, ids_of, parts, ends, ends[-1], ends[:-1], _padded(ids, row, pad_id)) for k, (ids_of, parts, ends, ids) in enumerate(made)])

    return _sharded(docs, shard_bytes, vocabulary).groupBy("shard").applyInArrow(packed, PACKED_SCHEMA)


def matrices(docs: DataFrame, row: int = ROW, shard_bytes: int = SHARD_BYTES, vocabulary: str = VOCABULARY, pad_id: int = PAD) -> DataFrame:
    """A row for each shard: its whole id matrix (n_rows x row, little-endian uint16) and its segments.

    The segments of matrix row r are ``cu_splits[r]`` to ``cu_splits[r + 1]`` of
    ``doc_ids``, ``parts`` and ``position_resets``; ``cu_seqlens`` are the
    cumulative lengths of all segments of the shard, padding left out.
    """
    kinds = (pa.int64(), pa.int32(), pa.int32(), *(pa.list_(pa.int32()),) * 3, pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary())

    def packed(group: pa.Table) -> pa.Table:
        shard = group.column("shard")[0].as_py()
        made = list(_rows(group.column("doc_id").to_pylist(), group.column("ids").to_pylist(), row))
        splits = np.cumsum([0, *(len(m[1]) for m in made)]).tolist()
        lengths = np.cumsum([0, *(n for m in made for n in np.diff(m[2]))]).tolist()
        resets, ids_of, parts = ([x for m in made for x in get(m)] for get in (lambda m: m[2][:-1], lambda m: m[0], lambda m: m[1]))
        return _arrow(MATRIX_SCHEMA, kinds, [(shard, len(made), row, splits, lengths, resets, ids_of, parts, b"".join(_padded(m[3], row, pad_id) for m in made))])

    return _sharded(docs, shard_bytes, vocabulary).groupBy("shard").applyInArrow(packed, MATRIX_SCHEMA)


def write_matrices(docs: DataFrame, path: str, **options) -> None:
    """The matrices of ``docs`` as Parquet files, one binary cell for each shard's matrix."""
    matrices(docs, **options).write.parquet(path)


def matrix_of(n_rows: int, row: int, matrix: bytes) -> np.ndarray:
    """The ids of a stored matrix, without a copy."""
    return np.frombuffer(matrix, "<u2").reshape(n_rows, row)


def read_matrices(spark: SparkSession, path: str) -> DataFrame:
    """The packed rows of stored matrices, as ``pack`` gives them."""
    kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32(), pa.list_(pa.int32()), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in record_batches(batches, 1):
            found = batch.to_pylist()[0]
            ids, splits, lengths = matrix_of(found["n_rows"], found["row"], found["matrix"]), found["cu_splits"], found["cu_seqlens"]
            out = []
            for k in range(found["n_rows"]):
                a, b = splits[k], splits[k + 1]
                ends = [n - lengths[a] for n in lengths[a : b + 1]]
                out.append((found["shard"], k, found["doc_ids"][a:b], found["parts"][a:b], ends, ends[-1], found["position_resets"][a:b], ids[k].tobytes()))
            yield from _arrow(PACKED_SCHEMA, kinds, out).to_batches()

    return spark.read.schema(MATRIX_SCHEMA).parquet(path).mapInArrow(run, PACKED_SCHEMA)


def unpack(packed: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, part, text) of every segment; a document's parts joined in order are its text.

    A part may start inside a character, so parts are given as bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(vocabulary)
        for batch in record_batches(batches):
            out = []
            for doc_ids, parts, ends, ids in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                values = np.frombuffer(ids, "<u2")
                for k, (doc, part) in enumerate(zip(doc_ids, parts, strict=True)):
                    out.append((doc, part, tool.base.decode_bytes(values[ends[k] : ends[k + 1]].tolist())))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [[]] * 3, (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["doc_id", "part", "piece"])

    return packed.select("doc_ids", "parts", "cu_seqlens", "ids").mapInArrow(run, "doc_id long, part int, piece binary")
