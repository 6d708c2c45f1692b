"""N-gram Jaccard join with count-vector R-trees.

1. Shingles that one document alone has cannot be part of any overlap. Packed postings tell how many of a document's
   shingles others have too; documents below the threshold share are linked with nothing, and drop out exactly.
2. Documents with equal sets stand for one another; one of each set goes on.
3. What is left meets in buckets, one for each shingle of a set's prefix (two sets at the threshold share one of them).
   Prefixes take the least frequent shingles first, so a passage that many sets share makes no large bucket.
4. Each bucket's most shared set is compared with the others first. Links found so join components, and pairs within a
   component need no further look, so a group of near copies costs its size rather than its square.
5. Pairs across components that share a bucket are searched with an R-tree over the sets' count vectors: shingles are
   hashed into groups, the counts are a point, and the sum of coordinate minima bounds the overlap, of a pair and of a
   query with a whole node. A set has more groups the larger it is, so the bound stays close to the overlap at any size.
   Buckets with the same smallest set are searched as one, so a pair that meets in many of them is found once; and the
   first place that a set has in such a bucket bounds what it can still share (positional filter). Large buckets are cut
   into blocks of bounded bytes that are paired in different tasks.
6. Surviving pairs are verified on the full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common as C
from tidemark.llm import postings as P
from tidemark.llm.graph import components

WORDS, PERCENT = 5, 80
#: Least and most groups of a count vector; between them, the power of two at or above twice the set's size.
GROUPS = (64, 1 << 17)
#: A shingle that so many sets have goes to the end of the order, by frequency.
FREQUENT = 8
#: Largest count that a point's coordinate holds; a point that has it anywhere is never ruled out.
FULL = 255
#: Largest frequency that a slice's message holds.
MOST_COUNT = 65535
FANOUT = 16
#: Bytes of count vectors in a block of a bucket, and in a task of the search.
BLOCK_BYTES = 24 << 20
#: Queries that walk a tree at a time.
QUERIES = 256
STAR_ROUNDS = 2


def shingles(texts: pa.Array, width: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct shingles and their texts, sorted by text, then hash. A text of fewer words has its
    whole sequence as one; without words, none."""
    dictionary, ids, off = C.word_ids(texts, lower=True)
    by_word = C.word_hashes(dictionary)[ids]
    h = C.window_hashes(by_word, width)
    at = np.flatnonzero(C.inside(off, width, len(h)))
    parts, owners = [h[at]], [C.owners(off)[at]]
    size = np.diff(off)
    for k in range(1, width):
        short = np.flatnonzero(size == k)
        if len(short):
            parts.append(C.window_hashes(by_word, k)[off[short]])
            owners.append(short)
    h, owner = np.concatenate(parts), np.concatenate(owners)
    order = np.argsort(h)
    order = order[np.argsort(owner[order].astype(np.uint16), kind="stable")]
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], owner[new]


def set_keys(h: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, list[bytes]]:
    """Set sizes, and a 128-bit key of each set."""
    edge = np.searchsorted(owner, np.arange(n + 1))
    return np.diff(edge), [hashlib.blake2b(h[x:y].tobytes(), digest_size=16).digest() for x, y in zip(edge[:-1], edge[1:])]


_SENT = {"shard": pa.int64(), "slice": pa.int64(), "at": pa.binary(), "hashes": pa.binary(), "docs": pa.binary(), "sizes": pa.binary(), "keys": pa.binary(), "shared": pa.binary()}
_SENT_SQL = "shard long, slice long, at binary, hashes binary, docs binary, sizes binary, keys binary, shared binary"
_REPLY = {k: v for k, v in _SENT.items() if k not in ("shard", "hashes")} | {"counts": pa.binary()}
_REPLY_SQL = "slice long, at binary, docs binary, sizes binary, keys binary, shared binary, counts binary"
_SIZED_SQL = "doc_id long, n long, key binary, shared long"


def _send(batches: Iterator[pa.RecordBatch], shards: int, width: int) -> Iterator[pa.RecordBatch]:
    number = 0
    bits = shards.bit_length() - 1
    for batch in C.slices(batches):
        for low in range(0, batch.num_rows, P.MOST_ROWS):
            part = batch.slice(low, P.MOST_ROWS)
            n, name = part.num_rows, P.slice_number(number)
            number += 1
            h, owner = shingles(part.column("text"), width)
            sizes, keys = set_keys(h, owner, n)
            order = np.argsort(h)
            h, owner = h[order], owner[order]
            start = P.runs(h)
            length = np.diff(np.append(start, len(h)))
            shared = np.bincount(owner[np.repeat(length > 1, length)] if len(h) else [], minlength=n)
            at = np.where(length > 1, P.SHARED, owner[start].astype(np.uint16)) if len(h) else np.zeros(0, np.uint16)
            h = h[start]
            cut = P.segments(h, shards)
            low32 = ((h << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)
            out: dict[str, list] = {k: [] for k in _SENT}
            ids = part.column("doc_id").to_numpy(zero_copy_only=False)
            meta = {"shard": name % shards, "slice": name, "docs": P.pack_ids(ids), "sizes": sizes.astype(np.int64).tobytes(), "keys": b"".join(keys), "shared": shared.astype(np.int64).tobytes()}
            for k in _SENT:
                out[k].append(meta.get(k))
            for shard in np.flatnonzero(np.diff(cut)):
                x, y = cut[shard], cut[shard + 1]
                row = {"shard": int(shard), "slice": name, "at": at[x:y].tobytes(), "hashes": low32[x:y].tobytes()}
                for k in _SENT:
                    out[k].append(row.get(k))
            yield P.rows(out, _SENT)


def _answer(table: pa.Table) -> pa.Table:
    """For each slice and shard, how many of a document's hashes other slices have; and the slices' own rows."""
    out: dict[str, list] = {k: [] for k in _REPLY}
    rows = {k: table.column(k).to_pylist() for k in _SENT if k != "shard"}
    sent = [i for i, x in enumerate(rows["hashes"]) if x is not None]
    for i, x in enumerate(rows["hashes"]):
        if x is None:
            for k in _REPLY:
                out[k].append(rows[k][i] if k in rows else None)
    if len(sent) > 1:
        parts = [np.frombuffer(rows["at"][i], np.uint16) for i in sent]
        h = np.concatenate([np.frombuffer(rows["hashes"][i], np.uint32) for i in sent])
        order = np.argsort(h)
        start = P.runs(h[order])
        length = np.diff(np.append(start, len(h)))
        many = np.zeros(len(h), bool)
        many[order] = np.repeat(length > 1, length)
        edge = np.cumsum([0] + [len(p) for p in parts])
        for j, i in enumerate(sent):
            mine = parts[j][many[edge[j] : edge[j + 1]]]
            at, counts = np.unique(mine[mine != P.SHARED], return_counts=True)
            if len(at):
                for k, v in (("slice", rows["slice"][i]), ("at", at.tobytes()), ("counts", counts.astype(np.int64).tobytes())):
                    out[k].append(v)
                for k in _REPLY:
                    if k not in ("slice", "at", "counts"):
                        out[k].append(None)
    return pa.Table.from_pydict(out, schema=pa.schema(list(_REPLY.items())))


def _gather(table: pa.Table) -> pa.Table:
    """A slice's documents with set size, key and the number of shingles that other documents have."""
    rows = {k: table.column(k).to_pylist() for k in _REPLY}
    meta = next(i for i, x in enumerate(rows["docs"]) if x is not None)
    ids = P.unpack_ids(rows["docs"][meta])
    shared = np.frombuffer(rows["shared"][meta], np.int64).copy()
    for at, counts in zip(rows["at"], rows["counts"]):
        if counts is not None:
            shared[np.frombuffer(at, np.uint16)] += np.frombuffer(counts, np.int64)
    keys = rows["keys"][meta]
    return pa.table({"doc_id": pa.array(ids, pa.int64()), "n": pa.array(np.frombuffer(rows["sizes"][meta], np.int64)), "key": pa.array([keys[16 * i : 16 * i + 16] for i in range(len(ids))], pa.binary()), "shared": pa.array(shared)})


def sized(docs: DataFrame, width: int = WORDS) -> DataFrame:
    """doc_id, n (set size), key (of the set), shared (at least the shingles that other documents have) for each row.

    A shard compares 32 bits of a hash beside its own number, so `shared` may count too many, never too few.
    """
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    shards = P.n_shards(C.text_bytes(rows, "text"))
    sent = rows.mapInArrow(lambda batches: _send(batches, shards, width), _SENT_SQL)
    return sent.groupBy("shard").applyInArrow(_answer, _REPLY_SQL).groupBy("slice").applyInArrow(_gather, _SIZED_SQL)


def point(h: np.ndarray) -> bytes:
    """The count vector of a set."""
    groups = min(max(1 << (2 * len(h) - 1).bit_length(), GROUPS[0]), GROUPS[1])
    return np.minimum(np.bincount((h & np.uint64(groups - 1)).astype(np.int64), minlength=groups), FULL).astype(np.uint8).tobytes()


def folded(points: np.ndarray, groups: int) -> np.ndarray:
    """Count vectors of fewer groups, which hold the sums of the former ones; full coordinates stay full."""
    while points.shape[1] > groups:
        half = points.shape[1] // 2
        points = np.minimum(points[:, :half].astype(np.uint16) + points[:, half:], FULL).astype(np.uint8)
    return points


_SETS_SQL = "rep long, n long, hashes binary, point binary, slice long"


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """rep, n, the set's hashes, its count vector and the number of its slice, for the rows whose set has the key asked for."""
    number = 0
    for batch in C.slices(batches):
        for low in range(0, batch.num_rows, P.MOST_ROWS):
            part = batch.slice(low, P.MOST_ROWS)
            h, owner = shingles(part.column("text"), width)
            sizes, keys = set_keys(h, owner, part.num_rows)
            asked = part.column("key").to_pylist()
            mine = [i for i, k in enumerate(keys) if k == asked[i]]
            edge = np.concatenate([[0], np.cumsum(sizes)])
            hashes, points = [], []
            for i in mine:
                own = h[edge[i] : edge[i + 1]]
                hashes.append(own.tobytes())
                points.append(point(own))
            columns = [part.column("rep").take(pa.array(mine, pa.int64())), pa.array(sizes[mine].astype(np.int64)), pa.array(hashes, pa.binary()), pa.array(points, pa.binary()), pa.array(np.full(len(mine), P.slice_number(number)))]
            number += 1
            yield pa.RecordBatch.from_arrays(columns, names=["rep", "n", "hashes", "point", "slice"])


_FREQ = {"shard": pa.int64(), "slice": pa.int64(), "hashes": pa.binary(), "counts": pa.binary()}
_FREQ_SQL = "shard long, slice long, hashes binary, counts binary"


def _freq_key(h: np.ndarray, shards: int) -> np.ndarray:
    """The bits of a hash that its frequency is counted by: those of the shard and 32 more."""
    return h >> np.uint64(32 - (shards.bit_length() - 1))


def _send_sets(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """A message to each shard for each slice: its distinct keys and how many of the slice's sets have them."""
    for batch in batches:
        name = batch.column("slice").to_numpy()
        for number in np.unique(name):
            own = batch.column("hashes").filter(pa.array(name == number)).to_pylist()
            h, counts = np.unique(np.frombuffer(b"".join(own), np.uint64), return_counts=True)
            cut = P.segments(h, shards)
            low32 = (_freq_key(h, shards) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            counts = np.minimum(counts, MOST_COUNT).astype(np.uint16)
            out: dict[str, list] = {k: [] for k in _FREQ}
            for shard in np.flatnonzero(np.diff(cut)):
                x, y = cut[shard], cut[shard + 1]
                for k, v in (("shard", int(shard)), ("slice", int(number)), ("hashes", low32[x:y].tobytes()), ("counts", counts[x:y].tobytes())):
                    out[k].append(v)
            if out["shard"]:
                yield P.rows(out, _FREQ)


def _answer_sets(table: pa.Table) -> pa.Table:
    """For each slice the keys that FREQUENT sets or more have, with a grade of the frequency."""
    shard = np.uint64(table.column("shard")[0].as_py())
    names, parts = table.column("slice").to_pylist(), [np.frombuffer(x, np.uint32) for x in table.column("hashes").to_pylist()]
    h = np.concatenate(parts)
    counts = np.concatenate([np.frombuffer(x, np.uint16) for x in table.column("counts").to_pylist()])
    kinds, inverse = np.unique(h, return_inverse=True)
    total = np.bincount(inverse, weights=counts)[inverse]
    many = total >= FREQUENT
    grade = np.minimum(8 * np.log2(np.maximum(total, 1)), 255).astype(np.uint8)
    edge = np.cumsum([0] + [len(x) for x in parts])
    out: dict[str, list] = {"slice": [], "hashes": [], "counts": []}
    for i, name in enumerate(names):
        own = slice(edge[i], edge[i + 1])
        if many[own].any():
            out["slice"].append(name)
            out["hashes"].append((h[own][many[own]].astype(np.uint64) | (shard << np.uint64(32))).tobytes())
            out["counts"].append(grade[own][many[own]].tobytes())
    return pa.Table.from_pydict(out, schema=pa.schema([(k, _FREQ[k]) for k in ("slice", "hashes", "counts")]))


def _prefixes(sets: pa.Table, frequent: pa.Table, shards: int, percent: int) -> pa.Table:
    """rep, n and the prefix of each set of a slice: rare shingles by hash, then frequent ones by grade, then hash."""
    keys = np.frombuffer(b"".join(frequent.column("hashes").to_pylist()), np.uint64)
    grades = np.frombuffer(b"".join(frequent.column("counts").to_pylist()), np.uint8)
    order = np.argsort(keys)
    keys, grades = keys[order], grades[order]
    out = []
    for blob, n in zip(sets.column("hashes").to_pylist(), sets.column("n").to_pylist()):
        h = np.frombuffer(blob, np.uint64)
        if len(keys):
            key = _freq_key(h, shards)
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            h = h[np.argsort(np.where(keys[at] == key, grades[at], 0), kind="stable")]
        out.append(h[: n - -(-percent * n // 100) + 1].view(np.int64))
    return pa.table({"rep": sets.column("rep"), "n": sets.column("n"), "prefix": pa.array(out, pa.list_(pa.int64()))})


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """rep, n, prefix for each set: what it must share one of with any set that reaches the threshold."""
    total = sets.agg(F.sum("n")).first()[0] or 0
    shards = P.n_shards(8 * total)
    sent = sets.select("slice", "hashes").mapInArrow(lambda b: _send_sets(b, shards), _FREQ_SQL)
    frequent = sent.groupBy("shard").applyInArrow(_answer_sets, "slice long, hashes binary, counts binary")
    return sets.select("rep", "n", "hashes", "slice").groupBy("slice").cogroup(frequent.groupBy("slice")).applyInArrow(lambda x, y: _prefixes(x, y, shards, percent), "rep long, n long, prefix array<long>")


def needed(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap of sets of these sizes at the threshold: percent / (100 + percent) of the sum, rounded up."""
    return -(-percent * (a + b) // (100 + percent))


class CountTree:
    """An R-tree over count vectors, packed bottom-up: points in order of set size, FANOUT to a node.

    A node has the coordinate maxima, the least and largest set size and the most shingles still to share of what is
    below it.
    """

    def __init__(self, points: np.ndarray, sizes: np.ndarray, left: np.ndarray):
        self.order = np.lexsort((points.argmax(axis=1), sizes))
        tops, low, high, most = points[self.order], sizes[self.order], sizes[self.order], left[self.order]
        self.levels = [(tops, low, high, most)]
        while len(tops) > FANOUT:
            start = np.arange(0, len(tops), FANOUT)
            tops, low, high, most = np.maximum.reduceat(tops, start), np.minimum.reduceat(low, start), np.maximum.reduceat(high, start), np.maximum.reduceat(most, start)
            self.levels.append((tops, low, high, most))

    def search(self, points: np.ndarray, sizes: np.ndarray, left: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, point) whose bound reaches the threshold; a query shares at most `left` of its shingles."""
        found = [self._walk(np.arange(x, min(x + QUERIES, len(points))), points, sizes, left, percent) for x in range(0, len(points), QUERIES)]
        return tuple(np.concatenate(x) for x in zip(*found))

    def _walk(self, asked: np.ndarray, points: np.ndarray, sizes: np.ndarray, left: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        q, node = (x.ravel() for x in np.indices((len(asked), len(self.levels[-1][0]))))
        q = asked[q]
        for depth in range(len(self.levels) - 1, -1, -1):
            tops, low, high, most = self.levels[depth]
            need = needed(sizes[q], low[node], percent)
            fits = (100 * low[node] * percent <= 10000 * sizes[q]) & (100 * sizes[q] * percent <= 10000 * high[node]) & (np.minimum(left[q], most[node]) >= need)
            q, node, need = q[fits], node[fits], need[fits]
            keep = np.zeros(len(q), bool)
            step = max(1, (1 << 22) // tops.shape[1])
            for x in range(0, len(q), step):
                y = slice(x, x + step)
                least = np.minimum(points[q[y]], tops[node[y]])
                keep[y] = (least.sum(axis=1, dtype=np.int64) >= need[y]) | (least == FULL).any(axis=1)
            q, node = q[keep], node[keep]
            if depth:
                width = len(self.levels[depth - 1][0])
                child = node[:, None] * FANOUT + np.arange(FANOUT)
                q, child = np.repeat(q, FANOUT), child.ravel()
                q, node = q[child < width], child[child < width]
        return q, self.order[node]


def _classes(points: list[bytes], rows: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each number of groups, the rows that have it and their points."""
    size = np.array([len(points[i]) for i in rows])
    return {int(g): (rows[size == g], np.frombuffer(b"".join(points[i] for i in rows[size == g]), np.uint8).reshape(-1, g)) for g in np.unique(size)}


def _search(table: pa.Table, percent: int) -> pa.Table:
    """Pairs of different components of the same bucket and pair of blocks that the R-tree lets through."""
    home, pair, side, rep, comp, size, rest = (table.column(k).to_numpy() for k in ("home", "pair", "side", "rep", "component", "n", "rest"))
    points = table.column("point").to_pylist()
    order = np.lexsort((pair, home))
    edge = np.append(np.flatnonzero(np.concatenate([[True], (np.diff(home[order]) != 0) | (np.diff(pair[order]) != 0)])), len(order))
    a, b = [], []
    for x, y in zip(edge[:-1], edge[1:]):
        rows = order[x:y]
        sides = _classes(points, rows[side[rows] <= 0]), _classes(points, rows[side[rows] >= 0])
        # Sizes of sets that can link differ by a quarter at most, so the numbers of their groups by a factor of two.
        for (g, (left, lp)), (k, (right, rp)) in ((x, y) for x in sides[0].items() for y in sides[1].items() if x[0] <= 2 * y[0] and y[0] <= 2 * x[0]):
            q, p = CountTree(folded(lp, k), size[left], rest[left]).search(folded(rp, g), size[right], rest[right], percent)
            q, p = right[q], left[p]
            ok = comp[q] != comp[p]
            a.append(np.minimum(rep[q], rep[p])[ok])
            b.append(np.maximum(rep[q], rep[p])[ok])
    both = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], 1), axis=0) if a else np.zeros((0, 2), np.int64)
    return pa.table({"a": pa.array(both[:, 0], pa.int64()), "b": pa.array(both[:, 1], pa.int64())})


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    right = sets.select(F.col("rep").alias("b"), F.col("hashes").alias("hb"))
    left = sets.select(F.col("rep").alias("a"), F.col("hashes").alias("ha"))
    both = pairs.join(right, "b").join(left, "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("ha").to_pylist(), batch.column("hb").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                same = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * same >= percent * (len(x) + len(y) - same))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.select("a", "b", "ha", "hb").mapInArrow(run, "a long, b long")


def links(docs: DataFrame, reps: DataFrame, width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) between rows (rep, key, n, often: whether rows of that doc_id repeat) that connect whatever the full relation connects."""
    rows = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").alias("text")).join(reps.select("rep", "key", "often"), "rep").select("rep", "text", "key", "often")
    once = rows.where("NOT often").mapInArrow(lambda b: _sets(b, width), _SETS_SQL)
    # Only rows that repeat need their sets moved to find the repeats.
    often = rows.where("often").mapInArrow(lambda b: _sets(b, width), _SETS_SQL).dropDuplicates(["rep", "hashes"])
    sets = C.settle(once.unionByName(often), "join-sets")
    token = C.settle(prefixes(sets, percent), "join-prefixes").select("rep", "n", F.posexplode("prefix").alias("place", "token"))
    # A bucket's home is its smallest set: buckets of one home are searched as one.
    many = token.groupBy("token").agg(F.count(F.lit(1)).alias("width"), F.min("rep").alias("home")).where("width > 1")
    token = C.settle(token.join(many, "token"), "join-tokens")
    grade = token.groupBy("rep").agg(F.sum("width").alias("grade"))
    token = C.settle(token.join(grade, "rep"), "join-graded")
    found: DataFrame | None = None
    labels: DataFrame | None = None
    for _ in range(STAR_ROUNDS):
        now = _labelled(token, labels)
        centre = now.groupBy("token").agg(F.max_by(F.struct("rep", "n", "component"), F.struct("grade", (-F.col("rep")).alias("rep"))).alias("c"), F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("token", F.col("c.rep").alias("a"), F.col("c.n").alias("na"), F.col("c.component").alias("ca"))
        pairs = now.join(centre, "token").where(f"component <> ca AND 100 * least(n, na) >= {percent} * greatest(n, na)").select("a", F.col("rep").alias("b")).distinct()
        new = C.settle(_verified(pairs, sets, percent), "join-star")
        found = new if found is None else found.unionByName(new)
        labels = components(found)
    now = _labelled(token, labels)
    # `rest`: how many shingles of a set are at or behind its first place in the home's buckets.
    now = now.groupBy("home", "rep").agg(F.max("n").alias("n"), F.max("component").alias("component"), F.max(F.col("n") - F.col("place")).alias("rest"))
    mixed = now.groupBy("home").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.sum("n").alias("all")).where("x <> y").select("home", "all")
    # Blocks of a home: pairs (i, j) of blocks meet in one task; a row's side tells which of the two it is in, 0 for both.
    blocks = F.ceil(4 * F.col("all") / BLOCK_BYTES).cast("int")
    rows = now.join(mixed, "home").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    rows = C.settle(rows.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")), "join-homes")
    tasks = max(16, -(-4 * (rows.agg(F.sum("n")).first()[0] or 0) // BLOCK_BYTES))
    rows = rows.withColumn("pair", F.least("block", "other").cast("long") * F.col("blocks") + F.greatest("block", "other")).withColumn("side", F.signum(F.col("block") - F.col("other")).cast("long"))
    rows = rows.join(sets.select("rep", "point"), "rep").select("home", "pair", "side", "rep", "component", "n", "rest", "point", F.pmod(F.xxhash64("home", "pair"), F.lit(tasks)).alias("task"))
    pairs = rows.groupBy("task").applyInArrow(lambda t: _search(t, percent), "a long, b long").distinct()
    return found.unionByName(C.settle(_verified(pairs, sets, percent), "join-links"))


def _labelled(token: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return token.withColumn("component", F.col("rep"))
    return token.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))


def near_duplicates(docs: DataFrame, width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_shingles (set size), component_id.

    component_id is the smallest doc_id reachable by links, itself included. Two documents link if the Jaccard
    similarity of their shingle sets is at least `percent` / 100, bounds included. A null text, or one without words,
    has an empty set and links with nothing. Rows of equal doc_id are one node. A null doc_id has no component. Texts are
    whole; equal sets, and so repeated rows, are one component. An empty table gives an empty result. Other columns are
    ignored.
    """
    all_rows = C.settle(sized(docs, width), "join-sized")
    keys = all_rows.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.max("shared").alias("shared"))
    often = all_rows.where("n > 0").groupBy("doc_id").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select(F.col("doc_id").alias("rep"), F.lit(True).alias("often"))
    keys = C.settle(keys.join(often, "rep", "left").withColumn("often", F.coalesce("often", F.lit(False))), "join-keys")
    found = links(docs, keys.where(f"100 * shared >= {percent} * n"), width, percent)
    same_id = all_rows.where("n > 0").join(keys.select("key", "rep"), "key").where("doc_id <> rep")
    # A doc_id with several texts holds their sets together.
    twice = same_id.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b").select("a", "b")
    labels = components(found.unionByName(twice))
    by_key = keys.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("key", F.coalesce("component", "rep").alias("component_id"))
    out = all_rows.join(by_key, "key", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    unnamed = docs.where(F.col("doc_id").isNull()).select(F.lit(0).cast("long").alias("doc_id"), F.col("text").alias("text"))
    alone = unnamed.mapInArrow(lambda batches: _sizes(batches, width), "n_shingles long").select(F.lit(None).cast("long").alias("doc_id"), "n_shingles", F.lit(None).cast("long").alias("component_id"))
    return out.unionByName(alone)


def _sizes(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in C.slices(batches):
        for low in range(0, batch.num_rows, P.MOST_ROWS):
            part = batch.slice(low, P.MOST_ROWS)
            _, owner = shingles(part.column("text"), width)
            yield pa.RecordBatch.from_pydict({"n_shingles": np.bincount(owner, minlength=part.num_rows).astype(np.int64)})


def op5_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Digest of the join over all documents: five words, 80 %."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP5_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), o AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a
)
SELECT doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(r.b) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.a = d.doc_id GROUP BY doc_id
"""
