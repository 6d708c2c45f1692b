"""Removal of word sequences that an earlier document has already, and how long these repeats are.

Level-wise doubling: every window of half of `width` words, rounded up, is looked at, its hash goes to a shard, and the
shard tells who has it besides. A window of `width` words is looked at only where both its halves are repeated (they
overlap by a word where the width is odd); then those of twice the length whose halves are repeats of `width` words, and
so on, until no candidates survive. A level carries the places and hashes of its candidates; the hash of a longer window
is made of its halves'.

The level of `width` words tells which words go, the levels above how long the longest repeat of each document is. Each
level is written to the shared folder, so that a lost executor costs one level at most.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import common as C
from tidemark.llm import postings as P

WIDTH = 13
#: What a message is: a question to a shard, or what the slice knows by itself: a repeat, or the first of one.
_ASK, _LATER, _FIRST = 0, 1, 2
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Most windows of a message of what the slice knows.
_PIECE = 1 << 17

#: The low seven bytes of hashes, stored as columns: from which bit, and of what kind.
_LOW = ((0, "<u4"), (32, "<u2"), (48, "u1"))
#: Windows by document: the documents, how many each has, and their hashes' top bytes and low seven bytes.
_WINDOWS = {"docs": pa.binary(), "counts": pa.binary(), "tops": pa.binary(), "hashes": pa.binary()}
_WINDOWS_SQL = "docs binary, counts binary, tops binary, hashes binary"
_SENT = {"to": pa.int64(), "slice": pa.int64(), **_WINDOWS, "role": pa.int8()}
_SENT_SQL = f"to long, slice long, {_WINDOWS_SQL}, role byte"
_REPLY = {"slice": pa.int64(), **_WINDOWS, "later": pa.bool_()}
_REPLY_SQL = f"slice long, {_WINDOWS_SQL}, later boolean"
_STATE_SQL = "doc_id long, t long, later binary, at binary, hashes binary"


def windows(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all windows within a text, their texts, their first words, and the texts' word offsets."""
    hashes, off = C.hashed_words(texts)
    h = C.window_hashes(hashes, width)
    at = np.flatnonzero(C.inside(off, width, len(h)))
    return h[at], C.owners(off)[at], at, off


def _send(batches: Iterator[pa.RecordBatch], width: int, tasks: int) -> Iterator[pa.RecordBatch]:
    """Messages of whole texts: their windows of the first level."""
    number, edges = 0, _edges(tasks)
    for ids, part in _sorted_slices(batches, "text"):
        h, owner, _, _ = windows(part.column("text"), width)
        yield from pack(h, owner, ids, P.slice_number(number), edges)
        number += 1


def _send_state(batches: Iterator[pa.RecordBatch], tasks: int) -> Iterator[pa.RecordBatch]:
    """Messages of a higher level: its candidates."""
    number, edges = 0, _edges(tasks)
    for ids, part in _sorted_slices(batches, "hashes"):
        each = [np.frombuffer(x, np.uint64) for x in part.column("hashes").to_pylist()]
        yield from pack(np.concatenate(each), np.repeat(np.arange(len(each)), [len(x) for x in each]), ids, P.slice_number(number), edges)
        number += 1


def _edges(tasks: int) -> np.ndarray:
    """The least hash of each task's range."""
    return np.array([-(-(k << 64) // tasks) for k in range(tasks)], np.uint64)


def _sorted_slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
    """Slices by doc_id, and these."""
    for batch in C.slices(batches, column):
        for low in range(0, batch.num_rows, P.MOST_ROWS):
            part = batch.slice(low, P.MOST_ROWS)
            ids = part.column("doc_id").to_numpy(zero_copy_only=False)
            by_id = np.argsort(ids, kind="stable")
            yield ids[by_id], part.take(pa.array(by_id))


def _packed(ids: np.ndarray, h: np.ndarray) -> dict[str, bytes]:
    """Windows sorted by document and hash: then the steps between top bytes are small."""
    start = P.runs(ids)
    counts = np.diff(start, append=len(ids)).astype(np.uint32)
    tops = (h >> np.uint64(56)).astype(np.uint8)
    return {"docs": P.pack_ids(ids[start]), "counts": zlib.compress(counts.tobytes(), 1), "tops": zlib.compress(np.diff(tops, prepend=np.uint8(0)).tobytes(), 1), "hashes": b"".join((h >> np.uint64(at)).astype(kind).tobytes() for at, kind in _LOW)}


def _unpacked(table: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Of each row the documents, how many windows each has, and the windows' hashes."""
    docs, counts, hashes = [], [], []
    for d, n, tops, low in zip(*(table.column(x).to_pylist() for x in _WINDOWS)):
        docs.append(P.unpack_ids(d))
        counts.append(np.frombuffer(zlib.decompress(n), np.uint32).astype(np.int64))
        h = np.cumsum(np.frombuffer(zlib.decompress(tops), np.uint8), dtype=np.uint8).astype(np.uint64) << np.uint64(56)
        for at, kind in _LOW:
            h |= np.frombuffer(low, kind, len(h), len(h) * at // 8).astype(np.uint64) << np.uint64(at)
        hashes.append(h)
    return docs, counts, hashes


def pack(h: np.ndarray, owner: np.ndarray, ids: np.ndarray, number: int, edges: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A slice's messages: to each task, which answers for a range of hashes, each distinct hash with its first document;
    and what is a repeat whatever the other slices have. The latter is dealt by slice, not by hash, so a frequent window
    fills no task. A message names only the documents it speaks of. ids rise with the owner."""
    tasks = len(edges)
    order = np.argsort(h)
    h, owner = h[order], owner[order].astype(np.uint16)
    start = P.runs(h)
    length = np.diff(start, append=len(h))
    first = np.minimum.reduceat(owner, start) if len(start) else owner
    again = ids[owner] > np.repeat(ids[first], length) if len(h) else np.zeros(0, bool)
    both = np.logical_or.reduceat(again, start) if len(start) else again
    out: dict[str, list] = {k: [] for k in _SENT}

    def message(to: int, who: np.ndarray, hashes: np.ndarray, role: int) -> None:
        for k, v in ({"to": to, "slice": number, "role": role} | _packed(ids[who], hashes)).items():
            out[k].append(v)

    asked = h[start]
    cut = np.append(np.searchsorted(asked, edges), len(asked))
    for to in np.flatnonzero(np.diff(cut)):
        mine, has = first[cut[to] : cut[to + 1]], asked[cut[to] : cut[to + 1]]
        by_owner = np.argsort(mine, kind="stable")
        message(int(to), mine[by_owner], has[by_owner], _ASK)
    to = number * 31 + (number >> 32) * 17
    for role, who, hashes in ((_LATER, owner[again], h[again]), (_FIRST, first[both], asked[both])):
        by_owner = np.argsort(who, kind="stable")
        who, hashes = who[by_owner], hashes[by_owner]
        new = np.flatnonzero(np.concatenate([[True], (who[1:] != who[:-1]) | (hashes[1:] != hashes[:-1])])) if len(who) else []
        for low in range(0, len(new), _PIECE):
            piece = new[low : low + _PIECE]
            message(to % tasks, who[piece], hashes[piece], role)
            to += 1
    if out["to"]:
        yield P.rows(out, _SENT)


def _answer(table: pa.Table) -> pa.Table:
    """For each slice, the windows that start in a document of smaller id too (later), and those of the smallest."""
    role = table.column("role").to_numpy()
    known = table.filter(pa.array(role != _ASK))
    passed = known.select(["slice", *_WINDOWS]).append_column("later", pa.array(known.column("role").to_numpy() == _LATER))
    out: dict[str, list] = {k: [] for k in _REPLY}
    sent = table.filter(pa.array(role == _ASK))
    if sent.num_rows > 1:
        docs, counts, hashes = _unpacked(sent)
        each = [np.repeat(d, n) for d, n in zip(docs, counts)]
        h, ids = np.concatenate(hashes), np.concatenate(each)
        order = np.argsort(h)
        start = P.runs(h[order])
        # Slices send a hash once, so those of one slice alone need no answer.
        length = np.diff(start, append=len(h))
        more = np.repeat(length > 1, length)
        order, length = order[more], length[length > 1]
        start = np.cumsum(length) - length
        later, shared = np.zeros(len(h), bool), np.zeros(len(h), bool)
        if len(start):
            mine = ids[order]
            least, most = np.minimum.reduceat(mine, start), np.maximum.reduceat(mine, start)
            later[order] = mine > np.repeat(least, length)
            shared[order] = np.repeat(most > least, length)
        edge = np.cumsum([0, *map(len, hashes)])
        for i, number in enumerate(sent.column("slice").to_pylist()):
            is_later = later[edge[i] : edge[i + 1]]
            for which, kind in ((is_later, True), (shared[edge[i] : edge[i + 1]] & ~is_later, False)):
                if which.any():
                    for k, v in ({"slice": number, "later": kind} | _packed(each[i][which], hashes[i][which])).items():
                        out[k].append(v)
    schema = pa.schema(list(_REPLY.items()))
    return pa.concat_tables([passed.cast(schema), pa.Table.from_pydict(out, schema=schema)])


def _gather(table: pa.Table) -> pa.Table:
    """A slice's replies, by document and kind: the hashes of its repeated windows."""
    docs, counts, hashes = _unpacked(table)
    later = np.repeat(table.column("later").to_numpy(), [len(x) for x in docs])
    ids, n, h = np.concatenate(docs), np.concatenate(counts), np.concatenate(hashes)
    at = np.cumsum(n) - n
    order = np.lexsort((later, ids))
    ids, later, n, at = ids[order], later[order], n[order], at[order]
    end = np.cumsum(n)
    h = h[np.arange(len(h)) + np.repeat(at - (end - n), n)]
    start = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (later[1:] != later[:-1])]))
    low = (end - n)[start]
    blobs = [h[x:y].tobytes() for x, y in zip(low, np.append(low[1:], len(h)))]
    kind = later[start]
    one = pa.array([b if k else None for b, k in zip(blobs, kind)], pa.binary())
    two = pa.array([None if k else b for b, k in zip(blobs, kind)], pa.binary())
    return pa.table({"doc_id": pa.array(ids[start], pa.int64()), "hashes": one, "firsts": two})


def _ask(sent: DataFrame) -> DataFrame:
    """doc_id, hashes and firsts (arrays of binary, 8 bytes a window) of all documents that share a window."""
    replies = sent.groupBy("to").applyInArrow(_answer, _REPLY_SQL)
    found = replies.groupBy("slice").applyInArrow(_gather, "doc_id long, hashes binary, firsts binary")
    return found.groupBy("doc_id").agg(F.collect_list("hashes").alias("hashes"), F.collect_list("firsts").alias("firsts"))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("t"))


def half(width: int) -> int:
    return -(-width // 2)


def repeats(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, hashes, firsts (arrays of binary, 8 bytes a window): the windows of `width` words that start in a document
    of smaller doc_id too; and those that start in one of larger doc_id only.

    One row for each doc_id that has any. A null doc_id is compared with nothing.
    """
    rows = _rows(docs)
    tasks = C.shards_for(C.text_bytes(rows, "text"))
    return _ask(rows.mapInArrow(lambda batches: _send(batches, width, tasks), _SENT_SQL))


def joined(at: np.ndarray, h: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the windows whose halves, `step` words apart, are both among the given; at rises."""
    other = np.searchsorted(at, at + step)
    has = other < len(at)
    has[has] = at[other[has]] == at[has] + step
    return at[has], C.spread(h[has] * _ODD + h[other[has]])


def _among(h: np.ndarray, *replies: list | None) -> np.ndarray:
    """Which of the hashes the replies have."""
    known = np.sort(np.frombuffer(b"".join(x for reply in replies for x in reply or ()), np.uint64))
    if not len(known):
        return np.zeros(len(h), bool)
    at = known.searchsorted(h)
    at[at == len(known)] = 0
    return known[at] == h


def _places(at: np.ndarray) -> bytes:
    steps = at.astype(np.uint32)
    steps[1:] -= steps[:-1].copy()
    return zlib.compress(steps.tobytes(), 1)


def _placed(blob: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(blob), np.uint32), dtype=np.int64)


def _state(rows: list[tuple[int, int, bytes | None, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    ids, t, later, at, h = zip(*rows) if rows else ((), (), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(t, pa.int64()), pa.array(later, pa.binary()), pa.array(map(_places, at), pa.binary()), pa.array([x.tobytes() for x in h], pa.binary())], names=["doc_id", "t", "later", "at", "hashes"])


def _first_candidates(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Candidates of `width` words, from texts and the replies about their halves."""
    for batch in C.slices(batches):
        ids, t = batch.column("doc_id").to_pylist(), batch.column("t").to_pylist()
        replies = list(zip(batch.column("hashes").to_pylist(), batch.column("firsts").to_pylist()))
        h, owner, at, off = windows(C.plain(batch.column("text")), half(width))
        edge = np.searchsorted(owner, np.arange(len(ids) + 1))
        hit = np.zeros(len(h), bool)
        for x, y, reply in zip(edge[:-1], edge[1:], replies):
            hit[x:y] = _among(h[x:y], *reply)
        # The halves overlap, so both lie in one text.
        places, hashes = joined(at[hit], h[hit], width - half(width))
        cut = np.searchsorted(places, off)
        yield _state([(ids[i], t[i], None, places[cut[i] : cut[i + 1]] - off[i], hashes[cut[i] : cut[i + 1]]) for i in np.flatnonzero(np.diff(cut))])


def _next_candidates(batches: Iterator[pa.RecordBatch], width: int, last: bool) -> Iterator[pa.RecordBatch]:
    """Where a document's candidates of this width are repeats of smaller ids, and its candidates of twice the width."""
    for batch in batches:
        out, more, known = [], [], []
        for row, (doc, t, at, h, later, firsts) in enumerate(zip(*(batch.column(x).to_pylist() for x in ("doc_id", "t", "at", "hashes", "laters", "firsts")))):
            at, h = _placed(at), np.frombuffer(h, np.uint64)
            is_later = _among(h, later)
            out.append((doc, t, _places(at[is_later]) if is_later.any() else None))
            if not last:
                hit = is_later | _among(h, firsts)
                # Far apart, so that no window goes on in the next row.
                more.append(at[hit] + (row << 32))
                known.append(h[hit])
        places, hashes = joined(np.concatenate(more), np.concatenate(known), width) if more else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
        cut = np.searchsorted(places, np.arange(len(out) + 1, dtype=np.int64) << 32)
        yield _state([(*row, places[x:y] - (i << 32), hashes[x:y]) for i, (row, x, y) in enumerate(zip(out, cut[:-1], cut[1:]))])


def levels(docs: DataFrame, width: int = WIDTH, most: int | None = None) -> Iterator[tuple[int, DataFrame]]:
    """(length, state) for `width` and its doublings until no candidates survive, or up to `most` words.

    state: doc_id, t (hash of the text), later (places of the windows that start in a document of smaller id too; null without any), and the
    candidates of twice the length. Rows of one doc_id have a row each. The number of levels is the logarithm of the
    longest repeat.
    """
    halves = C.settle(repeats(docs, half(width)), f"repeats-{half(width)}")
    C.free_shuffles(docs.sparkSession)
    state = C.settle(_rows(docs).join(halves, "doc_id").mapInArrow(lambda batches: _first_candidates(batches, width), _STATE_SQL), f"repeats-{width}-asked")
    length = width
    while n_bytes := C.text_bytes(state, "hashes"):
        C.free_shuffles(docs.sparkSession)
        last = most is not None and 2 * length > most
        state = C.settle(_raised(state, length, n_bytes, last), f"repeats-{length}")
        yield length, state
        state = state.where(F.octet_length("hashes") > 0)
        length *= 2
    C.free_shuffles(docs.sparkSession)


def _raised(state: DataFrame, length: int, n_bytes: int, last: bool) -> DataFrame:
    """The candidates of one length asked for, and what survives to be candidates of the next."""
    tasks = C.shards_for(n_bytes)
    found = _ask(state.mapInArrow(lambda batches: _send_state(batches, tasks), _SENT_SQL))
    both = state.select("doc_id", "t", "at", "hashes").join(found.withColumnRenamed("hashes", "laters"), "doc_id")
    return both.mapInArrow(lambda batches: _next_candidates(batches, length, last), _STATE_SQL)


def dedup(docs: DataFrame, width: int = WIDTH, keep: tuple[str, ...] = ("doc_id",), lengths: bool = True) -> DataFrame:
    """One row for each row of docs: the columns `keep`, kept_text, n_words, n_removed, longest_repeat.

    Removed are the words covered by a window of `width` consecutive words whose word sequence also starts in a document
    of smaller doc_id; windows are judged on the input. What is left is joined by single spaces; so a text without
    removals comes back with its white space normalised. A null text has no words and gives an empty one. Rows of equal
    doc_id never remove each other's words. A null doc_id removes nothing and loses nothing. A text shorter than the
    window stays whole. longest_repeat: the largest length, of `width` and its doublings, at which a window of the
    doc_id also starts in a document of smaller id, else 0; without `lengths` the levels above `width` are left out, and
    it is 0 or `width`. An empty table gives an empty result; other columns may have any name.
    """
    found = longest = None
    for length, state in levels(docs, width, None if lengths else width):
        later = state.where(F.col("later").isNotNull())
        own = later.select("doc_id", F.lit(length).cast("long").alias("length"))
        longest = own if longest is None else longest.unionByName(own)
        if found is None:
            # Rows of one doc_id may have different texts, with repeats at different places.
            found = later.groupBy("doc_id").agg(F.collect_set(F.struct("t", "later")).alias("later"))
    rows = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col("doc_id").cast("long").alias("id"), F.col("text").alias("text"), F.xxhash64("text").alias("t"))
    if found is None:
        both = rows.withColumns({"later": F.lit(None).cast("array<struct<t:long,later:binary>>"), "longest": F.lit(0).cast("long")})
    else:
        found = found.join(longest.groupBy("doc_id").agg(F.max("length").alias("longest")), "doc_id")
        both = rows.join(found.withColumnRenamed("doc_id", "id"), "id", "left")
    both = both.select(*[f"k{i}" for i in range(len(keep))], "text", "t", "later", F.coalesce("longest", F.lit(0)).cast("long").alias("longest"))
    schema = T.StructType([both.schema[f"k{i}"] for i in range(len(keep))] + [T.StructField("kept_text", T.StringType())] + [T.StructField(x, T.LongType()) for x in ("n_words", "n_removed", "longest_repeat")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches):
            split = [x.encode().split() for x in C.plain(batch.column("text")).to_pylist()]
            n_words = np.array([len(x) for x in split], np.int64)
            removed = np.zeros(len(split), np.int64)
            for i, (t, found) in enumerate(zip(batch.column("t").to_pylist(), batch.column("later").to_pylist())):
                where = next((x["later"] for x in found or () if x["t"] == t), None)
                if where is not None:
                    gone = _covered(_placed(where), len(split[i]), width)
                    removed[i] = int(gone.sum())
                    split[i] = [w for w, x in zip(split[i], gone) if not x]
            kept = pa.array([b" ".join(x).decode() for x in split], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], kept, pa.array(n_words), pa.array(removed), batch.column("longest")], names=[*(f"k{i}" for i in range(len(keep))), "kept_text", "n_words", "n_removed", "longest_repeat"])

    out = both.mapInArrow(run, schema)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "kept_text", "n_words", "n_removed", "longest_repeat")


def _covered(places: np.ndarray, n: int, width: int) -> np.ndarray:
    """Which of n words lie in a window of `width` words at one of the places, each given once."""
    covered = np.zeros(n + 1, np.int32)
    covered[places] += 1
    covered[places + width] -= 1
    return np.cumsum(covered)[:-1] > 0


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Digest of the removal over all documents, and how long each one's longest repeat is."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"), "longest_repeat")


def _raised_sql(level: int) -> str:
    """Windows of twice the length of a level: pairs of its windows that more than one document has, numbered anew."""
    step = WIDTH << level
    return f"""g{level} AS MATERIALIZED (SELECT doc_id, r, i, g, min(doc_id) OVER p AS least, max(doc_id) OVER p AS most FROM n{level} WINDOW p AS (PARTITION BY g)),
n{level + 1} AS MATERIALIZED (SELECT a.doc_id, a.r, a.i, dense_rank() OVER (ORDER BY a.g, b.g) AS g FROM g{level} a JOIN g{level} b ON b.r = a.r AND b.i = a.i + {step} WHERE a.least < a.most AND b.least < b.most)"""


#: Doublings that the SQL follows: windows of up to WIDTH * 2 ** LEVELS words, more than the longest text of the tables.
LEVELS = 11
OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), x AS (
  SELECT doc_id, r, unnest(generate_series(1, len(w) - 12)) AS i, w FROM d WHERE len(w) >= 13
), n0 AS MATERIALIZED (
  SELECT doc_id, r, i, dense_rank() OVER (ORDER BY array_to_string(w[i:i + 12], ' ')) AS g FROM x
), """ + ",\n".join(map(_raised_sql, range(LEVELS))) + r""", gone AS (
  SELECT r, list(DISTINCT p) AS ps FROM (SELECT r, unnest(generate_series(i, i + 12)) AS p FROM g0 WHERE least < doc_id) GROUP BY r
), lengths AS (
  SELECT doc_id, max(length) AS length FROM (""" + " UNION ALL ".join(f"SELECT doc_id, {WIDTH << k} AS length FROM g{k} WHERE least < doc_id" for k in range(LEVELS)) + r""") GROUP BY 1
), k AS (
  SELECT doc_id, w, coalesce(len(ps), 0) AS n,
         CASE WHEN ps IS NULL THEN w ELSE list_transform(list_filter(list_zip(w, generate_series(1, len(w))), lambda z: NOT list_contains(ps, z[2])), lambda z: z[1]) END AS kept
  FROM d LEFT JOIN gone USING (r)
)
SELECT k.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(n AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256, coalesce(length, 0)::BIGINT AS longest_repeat
FROM k LEFT JOIN lengths ON lengths.doc_id = k.doc_id
"""
