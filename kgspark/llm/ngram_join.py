"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of shingles of five words; two texts link at a Jaccard
similarity of 0.8 or more.

1. Texts are signed by MinHash, once for the copies in a batch, and collapsed to
   distinct ones.
2. Bands of the signature give candidate buckets. A pair belongs to the first
   band in which it agrees, so no pair is looked at twice.
3. Inside a bucket the signatures of a pair are compared step by step; it is
   dropped as soon as the posterior probability that its similarity reaches the
   threshold falls below the tolerance.
4. What is left is verified exactly on the shingle sets. A bucket's result is
   one row for each of its documents: how many documents it links to, and the
   root of its part of the bucket. Pairs are never emitted, neither as rows nor
   in arrays.
5. The roots are joined to connected components by alternating star steps.

A bucket of more than ``BLOCK`` texts, or of more than ``BLOCK_BYTES`` of shingles,
gets a leader, and its texts are compared with the leader alone, exactly. Those
with a similarity of 0.9 or more are the leader's core: as 1 - similarity is a
metric, any two of them link, so their links are counted from the size of the
core and none of its pairs is compared. Only texts outside the core are dealt to
cells of two blocks, with each other and with the core, so a group of near
copies costs rows in proportion to its size, and one that is loose is still
worked on whole, by many tasks. Hot keys of the joins are broadcast, at most
``HEAVY`` of them.

With 32 bands of 5 rows a pair at exactly 0.8 misses every band with probability
3e-6, and less above.

Defined results: a text of fewer than five words has one shingle, all its words;
a null text or one without words links to nothing and is a class of its own;
repeated rows and copies are in one class and count as links of each other; a
null doc_id is carried along; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import HEAVY, WORD, heavy_join, packed, record_batches, text_or_empty, unpacked, written

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 32, 5
LANES = BANDS * ROWS
TOLERANCE = 1e-6
STEP = 32
BLOCK, BLOCK_BYTES = 256, 8 << 20
CORE, SALTS = 0.9, 64
WORDS = re.compile(WORD)
_PERMUTE = np.random.default_rng(20).integers(1, 1 << 63, (2, LANES), dtype=np.uint64)
_A, _B = _PERMUTE[0] * np.uint64(2) + np.uint64(1), _PERMUTE[1]


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str], width: int = SHINGLE) -> list[np.ndarray]:
    """For each text its distinct shingles as sorted 64-bit hashes; empty without words."""
    places: dict[str, int] = {}
    rows = []
    for text in texts:
        rows.append([places.setdefault(w, len(places)) for w in WORDS.findall(text)])
    hashes = np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in places], np.uint64)
    out = []
    for row in rows:
        if not row:
            out.append(np.zeros(0, np.uint64))
            continue
        own = hashes[row]
        size = min(width, len(own))
        total = np.full(len(own) - size + 1, size, np.uint64)
        for k in range(size):
            total = _mixed(total * np.uint64(0x9E3779B97F4A7C15) + own[k : len(own) - size + 1 + k])
        out.append(np.unique(total))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """LANES numbers of 16 bits: for each permutation, bits of the least shingle."""
    least = np.full(LANES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        least = np.minimum(least, (shingles[at : at + 2048, None] * _A + _B).min(0))
    return least.astype(np.uint16)


def band_keys(lanes: np.ndarray) -> np.ndarray:
    """(n, BANDS) keys of (n, LANES) signatures."""
    parts = lanes.reshape(len(lanes), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(_mixed(np.arange(1, BANDS + 1, dtype=np.uint64)), parts.shape[:2])
    for k in range(ROWS):
        key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return key.view(np.int64) if key.flags.c_contiguous else np.ascontiguousarray(key).view(np.int64)


@lru_cache(maxsize=64)
def least_matches(compared: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """The fewest matches of ``compared`` lanes at which P(similarity >= threshold) is not below the tolerance.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), and its upper
    tail is a binomial one: P(S >= t) = P(Binomial(n + 1, t) <= m).
    """
    tail = 0.0
    for m in range(compared + 1):
        tail += comb(compared + 1, m) * threshold**m * (1 - threshold) ** (compared + 1 - m)
        if tail >= tolerance:
            return m
    return compared


def surviving(lanes: np.ndarray, left: np.ndarray, right: np.ndarray, band: np.ndarray) -> np.ndarray:
    """Which candidate pairs agree first in their band and outlive the Bayesian pruning."""
    alive = np.arange(len(left))
    matches = np.zeros(len(left), np.int32)
    for at in range(0, LANES, STEP):
        same = lanes[left[alive], at : at + STEP] == lanes[right[alive], at : at + STEP]
        matches[alive] += same.sum(1)
        alive = alive[matches[alive] >= least_matches(min(at + STEP, LANES))]
    # The first band in which a pair agrees; earlier ones belong to other buckets.
    for low in range(0, len(alive), 8192):
        part = alive[low : low + 8192]
        agree = (lanes[left[part]] == lanes[right[part]]).reshape(len(part), BANDS, ROWS).all(2)
        alive[low : low + 8192] = np.where(agree.argmax(1) == band[part], part, -1)
    return alive[alive >= 0]


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, rows of one group being adjacent, and the start of every group.

    The first ``keys`` columns, all long and not null, name the group. A group
    that goes on in the next batch waits for it.
    """
    waiting: list[pa.RecordBatch] = []

    def cut(table: pa.Table) -> np.ndarray:
        change = np.zeros(table.num_rows, bool)
        change[0] = True
        for k in range(keys):
            values = table.column(k).to_numpy()
            change[1:] |= values[1:] != values[:-1]
        return np.flatnonzero(change)

    for batch in batches:
        if not batch.num_rows:
            continue
        waiting.append(batch)
        if sum(b.num_rows for b in waiting) < 2000 and sum(b.nbytes for b in waiting) < 8 << 20:
            continue
        table = pa.Table.from_batches(waiting)
        starts = cut(table)
        if len(starts) > 1:
            yield table.slice(0, starts[-1]), starts[:-1]
        waiting = table.slice(starts[-1]).combine_chunks().to_batches()
    if waiting:
        table = pa.Table.from_batches(waiting)
        yield table, cut(table)


def _candidates(starts: np.ndarray, total: int, blocks: np.ndarray, cross: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs inside every group; only pairs across blocks in the groups of two blocks.

    Groups of one size are handled together.
    """
    sizes = np.diff(np.append(starts, total))
    for size in np.unique(sizes):
        if size < 2:
            continue
        i, j = np.triu_indices(int(size), 1)
        own = starts[sizes == size]
        step = max(1, 200_000 // len(i))
        for low in range(0, len(own), step):
            left = (own[low : low + step, None] + i).ravel()
            right = (own[low : low + step, None] + j).ravel()
            keep = ~cross[left] | (blocks[left] != blocks[right])
            yield left[keep], right[keep]


CELL = ("key", "bi", "bj")
MEMBER = "key long, bi long, bj long, blk long, band long, core long, rid long, lanes binary"


def _survivors(table: pa.Table, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of a table of whole cells that outlive the pruning; two texts of one core are no pair."""
    lanes = np.frombuffer(b"".join(table.column("lanes").to_pylist()), np.uint16).reshape(-1, LANES)
    low, high, blocks, band, core = (table.column(c).to_numpy() for c in ("bi", "bj", "blk", "band", "core"))
    found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 2]
    for left, right in _candidates(starts, table.num_rows, blocks, low != high):
        apart = (core[left] < 0) | (core[left] != core[right])
        left, right = left[apart], right[apart]
        alive = surviving(lanes, left, right, band[left])
        found.append((left[alive], right[alive]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows, sorted by cell and block, that are in a surviving pair."""
    for table, starts in _groups(batches, 3):
        table = table.combine_chunks()
        left, right = _survivors(table, starts)
        yield from table.take(pa.array(np.union1d(left, right))).to_batches()


def similarities(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact Jaccard similarities of pairs of sorted arrays of distinct hashes."""
    sizes = np.array([len(s) for s in sets], np.int64)
    every, places = np.unique(np.concatenate(sets), return_inverse=True)
    if len(left) > 4 * len(sets) and len(sets) * len(every) <= 1 << 24:
        holds = np.zeros((len(sets), len(every)), np.float32)
        holds[np.repeat(np.arange(len(sets)), sizes), places] = 1
        shared = (holds @ holds.T)[left, right].astype(np.int64)
    else:
        shared = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(left, right, strict=True)], np.int64)
    return shared / (sizes[left] + sizes[right] - shared)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, links, root) from rows of ``MEMBER`` with copies and shingles, sorted by cell and block."""
    for table, starts in _groups(batches, 3):
        table = table.combine_chunks()
        rid, copies = table.column("rid").to_numpy(), table.column("copies").to_numpy()
        raw = table.column("shingles")
        every = _survivors(table, starts)
        order = np.argsort(every[0], kind="stable")
        lefts, rights = every[0][order], every[1][order]
        out = []
        for a, b in zip(starts, np.append(starts[1:], table.num_rows), strict=True):
            own = slice(*np.searchsorted(lefts, (a, b)))
            left, right = lefts[own] - a, rights[own] - a
            if not len(left):
                continue
            sets = [np.frombuffer(raw[k].as_buffer(), np.uint64) for k in range(a, b)]
            linked = similarities(sets, left, right) >= THRESHOLD
            left, right = left[linked], right[linked]
            links = np.zeros(b - a, np.int64)
            np.add.at(links, left, copies[a + right])
            np.add.at(links, right, copies[a + left])
            parent = list(range(b - a))

            def root(k: int, parent=parent) -> int:
                while parent[k] != k:
                    parent[k] = parent[parent[k]]
                    k = parent[k]
                return k

            for x, y in zip(left.tolist(), right.tolist(), strict=True):
                x, y = root(x), root(y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
            out += [(int(rid[a + k]), int(links[k]), int(rid[a + root(k)])) for k in range(b - a) if links[k]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in list(zip(*out, strict=True)) or [[]] * 3], names=["rid", "links", "root"])


def _near_leader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, leader) of the texts in their leader's core, from rows (leader, salt, member, rid, shingles) in that order.

    The leader's own row comes first; nothing but its set is kept.
    """
    now, lead = None, np.zeros(0, np.uint64)
    for batch in batches:
        out = []
        for leader, salt, member, rid, raw in zip(*(c.to_pylist() if k < 4 else c for k, c in enumerate(batch.columns)), strict=True):
            own = np.frombuffer(raw.as_buffer(), np.uint64)
            if not member:
                now, lead = (leader, salt), own.copy()
            elif now == (leader, salt):
                shared = len(np.intersect1d(lead, own, assume_unique=True))
                if shared >= CORE * (len(lead) + len(own) - shared):
                    out.append((rid, leader))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in list(zip(*out, strict=True)) or [[]] * 2], names=["rid", "leader"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of undirected edges (u, v), u <> v; the root is the least node.

    Alternating large-star and small-star steps; every step is a join and an
    aggregation over edges, and is written before the next one.
    """
    edges = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    mark = None
    pair = F.xxhash64("u", "v")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        size = edges.count()
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = heavy_join(both.where("v > u"), least, ["u"], F.col("n") * HEAVY > size, pair).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = heavy_join(large, least, ["u"], F.col("n") * HEAVY > size, pair).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = written(small.where("u <> v").distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark = now


def _keys(text: Column) -> list[Column]:
    """Two hashes that together name a text."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def _signed(docs: DataFrame) -> DataFrame:
    """(k1, k2, rep_id, copies, size, lanes, keys): a row for each text with words in each batch.

    Copies in a batch are counted and signed once; ``size`` is the number of shingles.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in record_batches(batches):
            places: dict[tuple[int, int], int] = {}
            firsts, least, copies = [], [], []
            for at, (a, b, doc) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)):
                k = places.setdefault((a, b), len(firsts))
                if k == len(firsts):
                    firsts.append(at)
                    least.append(doc)
                    copies.append(0)
                elif doc is not None and (least[k] is None or doc < least[k]):
                    least[k] = doc
                copies[k] += 1
            sets = shingle_sets(batch.column(3).take(pa.array(firsts, pa.int64())).to_pylist())
            some = [k for k, s in enumerate(sets) if len(s)]
            lanes = np.array([signature(sets[k]) for k in some], np.uint16).reshape(-1, LANES)
            own = batch.take(pa.array([firsts[k] for k in some], pa.int64()))
            keys = pa.FixedSizeListArray.from_arrays(pa.array(band_keys(lanes).ravel()), BANDS).cast(pa.list_(pa.int64()))
            numbers = [pa.array([x[k] for k in some], t) for x, t in ((least, batch.schema.field(2).type), (copies, pa.int64()), (list(map(len, sets)), pa.int64()))]
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), *numbers, pa.array([x.tobytes() for x in lanes], pa.binary()), keys], names=["k1", "k2", "rep_id", "copies", "size", "lanes", "keys"])

    return docs.select(*_keys(text_or_empty()), "doc_id", text_or_empty().alias("text")).mapInArrow(run, f"k1 long, k2 long, rep_id {kind}, copies long, size long, lanes binary, keys array<long>")


def _shingled(texts: DataFrame) -> DataFrame:
    """(rid, copies, shingles) from (rid, copies, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in record_batches(batches):
            sets = shingle_sets(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([s.tobytes() for s in sets], pa.binary())], names=["rid", "copies", "shingles"])

    return texts.mapInArrow(run, "rid long, copies long, shingles binary")


def _sets(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """(rid, copies, shingles) of rows (rid, k1, k2, rep_id, copies), written.

    The representative's doc_id is part of the join's key, so the copies of one
    text do not meet in one task. The join is a merge join at every size.
    """
    own = docs.select(*_keys(text_or_empty()), F.col("doc_id").alias("id_"), text_or_empty().alias("text"))
    met = own.alias("o").join(needed.hint("merge").alias("n"), F.expr("o.k1 = n.k1 and o.k2 = n.k2 and o.id_ <=> n.rep_id"))
    return written(_shingled(met.dropDuplicates(["rid"]).select("rid", "copies", "text")))


def _members(texts: DataFrame) -> DataFrame:
    """(rid, band, size, key, n, nb): the texts of every bucket that two or more share, its size and number of blocks."""
    banded = texts.select("rid", "size", F.posexplode("keys").alias("band", "key")).withColumn("band", F.col("band").cast("long"))
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("all_size")).where("n > 1").withColumn("nb", _blocks("n", "all_size")).drop("all_size")
    total = BANDS * texts.count()
    return written(heavy_join(banded, written(shared), ["key"], F.col("n") * HEAVY > total, F.xxhash64("rid", "band")).where("n is not null"))


def _cores(members: DataFrame, sets: DataFrame, total: int) -> DataFrame:
    """(rid, core, core_links) of the texts in a core, from the members of buckets of several blocks."""
    large = members.where("nb > 1")
    order = F.struct(F.xxhash64("rid").alias("h"), F.col("rid").alias("leader"))
    leads = large.groupBy("key").agg(F.min(order)["leader"].alias("leader"), F.count(F.lit(1)).alias("n_own"))
    met = written(heavy_join(large.select("rid", "key"), leads, ["key"], F.col("n_own") * HEAVY > total, F.xxhash64("rid", "key")).select("rid", "leader").distinct())
    salted = met.withColumn("salt", F.pmod(F.xxhash64(F.lit(3), "rid"), F.lit(SALTS))).join(sets, "rid").select("leader", "salt", F.lit(1).alias("member"), "rid", "shingles")
    heads = met.select(F.col("leader").alias("rid")).distinct().join(sets, "rid")
    heads = heads.select(F.col("rid").alias("leader"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"), F.lit(0).alias("member"), "rid", "shingles")
    rows = salted.unionByName(heads).repartition("leader", "salt").sortWithinPartitions("leader", "salt", "member", "rid")
    near = rows.mapInArrow(_near_leader, "rid long, leader long")
    cores = written(near.groupBy("rid").agg(F.min(F.struct(F.xxhash64("leader").alias("h"), "leader"))["leader"].alias("core")).join(sets.select("rid", "copies"), "rid"))
    sizes = cores.groupBy("core").agg(F.count(F.lit(1)).alias("n_core"), F.sum("copies").alias("all_copies"))
    counted = heavy_join(cores, sizes, ["core"], F.col("n_core") * HEAVY > total, F.xxhash64("rid"))
    return written(counted.select("rid", "core", (F.col("all_copies") - F.col("copies")).alias("core_links")))


def _cells(members: DataFrame, total: int) -> DataFrame:
    """``MEMBER`` rows: every text once for each cell of its buckets that has pairs for it; there are ``total`` members."""
    zero = lambda name: F.lit(0).cast("long").alias(name)
    small = members.where("nb = 1").select("key", zero("bi"), zero("bj"), zero("blk"), "band", "core", "rid", "lanes")
    rest = members.where("nb > 1")
    groups = rest.groupBy("key", "core").agg(F.count(F.lit(1)).alias("n_own"), F.sum("size").alias("size_own"))
    groups = groups.withColumn("nb_own", _blocks("n_own", "size_own"))
    # A core's texts are no pairs of each other, so its blocks meet only those of other groups.
    ring = Window.partitionBy("key")
    groups = groups.withColumn("low", F.sum("nb_own").over(ring.orderBy("core")) - F.col("nb_own")).withColumn("all_nb", F.sum("nb_own").over(ring))
    large = heavy_join(rest, groups, ["key", "core"], F.col("n_own") * HEAVY > total, F.xxhash64("rid", "band"))
    large = large.withColumn("blk", F.col("low") + F.pmod(F.xxhash64(F.lit(5), "rid"), F.col("nb_own")))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("all_nb") - 1), lambda o: (F.col("core") < 0) | (o < F.col("low")) | (o >= F.col("low") + F.col("nb_own")))
    large = large.withColumn("other", F.explode(others))
    return small.unionByName(large.select("key", F.least("blk", "other").alias("bi"), F.greatest("blk", "other").alias("bj"), "blk", "band", "core", "rid", "lanes"))


def _blocks(n: str, size: str) -> Column:
    """Blocks of a group: by texts and by bytes of shingles, at most one for each text."""
    return F.least(F.col(n), F.ceil(F.greatest(F.col(n) / BLOCK, F.col(size) * 8 / BLOCK_BYTES))).cast("long")


def classes(docs: DataFrame) -> DataFrame:
    """A row for each distinct text with words: k1, k2, rep_id, copies, links, root, class_id.

    ``rep_id`` is the least doc_id with that text, ``links`` counts the documents
    with other texts that link to it, ``root`` names its connected component and
    ``class_id`` is that component's least doc_id, null if it has none.
    """
    signed = _signed(docs).groupBy("k1", "k2").agg(F.min("rep_id").alias("rep_id"), F.sum("copies").alias("copies"), F.first("size").alias("size"), F.first("lanes").alias("lanes"), F.first("keys").alias("keys"))
    texts = written(signed.withColumn("rid", F.monotonically_increasing_id()))

    members = _members(texts)
    sets = _sets(docs, texts.select("rid", "k1", "k2", "rep_id", "copies").join(members.select("rid").distinct(), "rid"))
    total = members.count()
    cores = _cores(members, sets, total)
    # The core joins a text once, not each of its memberships.
    own = texts.select("rid", "lanes").join(cores.select("rid", "core"), "rid", "left").withColumn("core", F.coalesce("core", F.lit(-1).cast("long")))
    cells = _cells(members.join(own, "rid"), total)
    pairs = written(cells.repartition(*CELL).sortWithinPartitions(*CELL, "blk").mapInArrow(_prune, MEMBER))
    ready = pairs.join(sets, "rid").select(*pairs.columns, "copies", "shingles")
    links = ready.repartition(*CELL).sortWithinPartitions(*CELL, "blk").mapInArrow(_verify, "rid long, links long, root long")
    links = written(links.unionByName(cores.select("rid", F.col("core_links").alias("links"), F.col("core").alias("root"))))

    roots = components(links.select(F.col("rid").alias("u"), F.col("root").alias("v")))
    counted = links.groupBy("rid").agg(F.sum("links").alias("links"))
    found = counted.join(roots.withColumnRenamed("node", "rid"), "rid", "left")
    named = written(texts.select("rid", "k1", "k2", "rep_id", "copies").join(found, "rid", "left").withColumn("root", F.coalesce("root", "rid")))
    least = named.groupBy("root").agg(F.min("rep_id").alias("class_id"), F.count(F.lit(1)).alias("n"))
    joined = heavy_join(named, least, ["root"], F.col("n") * HEAVY > named.count(), F.xxhash64("rid"))
    return joined.select("k1", "k2", "rep_id", "copies", F.coalesce("links", F.lit(0)).cast("long").alias("links"), "root", "class_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, n_copies (documents with this text) and n_links (other documents at the threshold)."""
    found = written(classes(docs))
    total = found.agg(F.sum("copies")).first()[0] or 0
    keyed = docs.select("doc_id", *_keys(text_or_empty()))
    joined = heavy_join(keyed, found, ["k1", "k2"], F.col("copies") * HEAVY > total, F.xxhash64("doc_id"))
    return joined.select(
        "doc_id",
        F.when(F.col("copies").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"),
        F.coalesce(F.col("copies") - 1 + F.col("links"), F.lit(0)).cast("long").alias("n_links"),
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each class, columns unchanged.

    Of a class the row with the least doc_id stays; texts without words all stay.
    """
    found = written(classes(docs))
    one = found.groupBy("root").agg(F.min(F.struct(F.col("rep_id").isNull(), "rep_id", "k1", "k2")).alias("w")).select("w.k1", "w.k2", "w.rep_id")
    text = text_or_empty()
    rows = packed(docs, *_keys(text), F.col("doc_id"), text.rlike(WORD).alias("some"))
    # The doc_id is part of the key, so the copies of one text do not meet in one task.
    kept = rows.where("some").alias("r").join(one.alias("o"), F.expr("r.k1 = o.k1 and r.k2 = o.k2 and r.doc_id <=> o.rep_id"))
    kept = kept.select("r.*").dropDuplicates(["k1", "k2"])
    return unpacked(kept, docs.columns).unionByName(unpacked(rows.where("not some"), docs.columns))
