"""Packing documents into sequences by minimum bin slack.

Documents become ids where they are read; what is longer than a sequence is cut. Only the number of pieces of each length
goes to the driver, one number a length, whatever the number of documents. There each bin is filled by itself: the longest
piece left, then the combination of lengths left that fills it best, found by subset sums kept as the bits of an integer.
A combination is used for as many bins as its lengths last, so a plan has a few rows a length. Pieces are numbered within
their length and find their bin and place from their number.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common as C
from tidemark.llm import ranks
from tidemark.llm import tokens as T

#: Fixed value: how byte-level models split a text before they merge.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters whose class has been the same in all versions of Unicode that a regex library may have.
_OLD = r"^[\n!-~¡-ɏΆ-ώЀ-ҁҊ-ӿ‐-‧‰-⁞ぁ-ゖァ-ヺ一-龥가-힣]*$"
#: Bytes of text that a task encodes at a time.
SLICE = 16 << 20


class Encoder:
    """The ids of texts by a tokenizer file.

    For byte-level models whose merges are in the order of their ids, texts are cut before single spaces, and all distinct
    pieces of a slice are encoded in one call as one text: a token begins with a space exactly where a piece begins. All
    else goes to the tokenizer as it is: texts with added tokens or odd white space, pieces of unusual characters.
    """

    def __init__(self, path: str):
        self.path, self.fast, self.added = path, None, []
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.whole = lambda texts: model.encode(texts, num_threads=1)
            return
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        model.no_truncation()
        model.no_padding()
        self.whole = lambda texts: [x.ids for x in model.encode_batch_fast(texts, add_special_tokens=False)]
        if T.can_cut(path):
            self.added = [x.content for x in model.get_added_tokens_decoder().values()]
            self._ranks()

    def _ranks(self) -> None:
        """The same model for a library that encodes long texts faster; its ranks are the ids."""
        import json

        import tiktoken

        with open(self.path) as f:
            bpe = json.load(f)["model"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in shown]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}
        merged = [bpe["vocab"]["".join(x.split(" ") if isinstance(x, str) else x)] for x in bpe["merges"]]
        if merged != sorted(merged) or len(set(merged)) < len(merged) or len(bpe["vocab"]) - len(set(self.added) & bpe["vocab"].keys()) != len(merged) + 256:
            return
        self.ranks = {bytes(byte[c] for c in t): i for t, i in bpe["vocab"].items() if t not in self.added}
        self.fast = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=self.ranks, special_tokens={})
        self.starts = np.zeros(max(self.ranks.values()) + 1, bool)
        self.starts[[i for t, i in self.ranks.items() if t[:1] == b" "]] = True

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (large_string without nulls), one text after another, and where each starts (n + 1)."""
        n = len(texts)
        plain = np.zeros(n, bool)
        if self.fast:
            odd = pc.match_substring_regex(texts.cast(pa.large_binary()), T._UNSAFE_ARROW)
            for x in self.added:
                odd = pc.or_(odd, pc.match_substring(texts, x))
            plain = ~odd.to_numpy(zero_copy_only=False)
        whole = [np.array(x, np.uint32) for x in self.whole([texts[int(i)].as_py() for i in np.flatnonzero(~plain)])] if not plain.all() else []
        size = np.zeros(n, np.int64)
        size[~plain] = [len(x) for x in whole]
        ids, off = self._plain(texts.filter(pa.array(plain))) if plain.any() else (np.zeros(0, np.uint32), np.zeros(1, np.int64))
        size[plain] = np.diff(off)
        ends = np.concatenate([[0], np.cumsum(size)])
        if whole:
            out = np.empty(ends[-1], np.uint32)
            out[np.repeat(plain, size)] = ids
            for i, x in zip(np.flatnonzero(~plain), whole):
                out[ends[i] : ends[i + 1]] = x
            ids = out
        return ids, ends

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.split_pattern(texts, " ")
        flat, off = lists.flatten(), np.asarray(lists.offsets, np.int64)
        off = off - off[0]
        first = np.zeros(len(flat), bool)
        first[off[:-1]] = True
        coded = flat.filter(pa.array(~first)).dictionary_encode()
        pieces, at = self._pieces(coded.dictionary)
        heads = flat.filter(pa.array(first)).dictionary_encode()
        old = pc.match_substring_regex(heads.dictionary, _OLD).to_pylist()
        one = [self.fast.encode_ordinary(x) if ok else self.whole([x])[0] for x, ok in zip(heads.dictionary.to_pylist(), old)]
        # Pieces without a space before them come after the others.
        pool = np.concatenate([pieces, *[np.array(x, np.uint32) for x in one]])
        begin = np.concatenate([at[:-1], at[-1] + np.cumsum([0, *map(len, one)])[:-1]]).astype(np.int64)
        length = np.concatenate([np.diff(at), [len(x) for x in one]]).astype(np.int64)
        word = np.empty(len(flat), np.int64)
        word[~first] = coded.indices.to_numpy(zero_copy_only=False)
        word[first] = heads.indices.to_numpy(zero_copy_only=False) + len(at) - 1
        n = length[word]
        ends = np.concatenate([[0], np.cumsum(n)])
        return pool[np.repeat(begin[word] - ends[:-1], n) + np.arange(ends[-1])], ends[off]

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces, each after a space, and where each starts."""
        old = pc.match_substring_regex(pieces, _OLD).to_numpy(zero_copy_only=False)
        joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, int(old.sum())], pa.int64()), pieces.filter(pa.array(old))), pa.scalar(" ", pa.large_string()))[0].as_py() if old.any() else ""
        ids = np.asarray(self.fast.encode_to_numpy(" " + joined, disallowed_special=()) if joined else [], np.uint32)
        begin = np.flatnonzero(self.starts[ids])
        if len(begin) != old.sum():
            raise ValueError("a token across two pieces")
        rest = self.whole([" " + x for x in pieces.filter(pa.array(~old)).to_pylist()]) if not old.all() else []
        size = np.zeros(len(pieces), np.int64)
        size[old] = np.diff(begin, append=len(ids))
        size[~old] = [len(x) for x in rest]
        at = np.concatenate([[0], np.cumsum(size)])
        if rest:
            out = np.empty(at[-1], np.uint32)
            out[np.repeat(old, size)] = ids
            for i, x in zip(np.flatnonzero(~old), rest):
                out[at[i] : at[i + 1]] = x
            ids = out
        return ids, at


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(docs: DataFrame, model: str, capacity: int = 2048, end: int = 0, text: str = "text", key: str = "doc_id", ids: bool = False) -> DataFrame:
    """The documents as ids, each with `end` after it, cut into pieces: doc_id, piece (from 0), start, length, ids_crc32 and,
    if asked, ids. Only the first of several pieces is shorter than the capacity."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(model)
        for batch in C.slices(batches, most=SLICE):
            found, off = encode(C.plain(batch.column("text")))
            # `end` after each text.
            found, off = np.insert(found, off[1:], end).astype("<u4"), off + np.arange(len(off))
            size = np.diff(off)
            count = -(-size // capacity)
            owner = np.repeat(np.arange(len(size)), count)
            number = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            head = (size - capacity * (count - 1))[owner]
            start = np.where(number > 0, head + (number - 1) * capacity, 0)
            length = np.where(number > 0, capacity, head)
            ends = np.cumsum(length)
            view = memoryview(np.ascontiguousarray(found)).cast("B")
            crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip((ends - length).tolist(), ends.tolist())]
            columns = [batch.column("doc_id").take(pa.array(owner)), pa.array(number.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
            if ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(found.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if ids else [])])

    return rows.mapInArrow(run, schema)


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """Of so many pieces of each length those whose sum comes nearest to room without passing it: {length: pieces}.

    The bits of `reached` are the sums of pieces seen so far. Longer ones come first, and the search ends once room is
    reached, so that of equal sums the one of longer pieces is found and short ones are left for later bins."""
    reached, seen, most = 1, [], (1 << room + 1) - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, step = min(counts[length], room // length), 1
        while left:
            step = min(step, left)
            seen.append((length, step, reached))
            reached |= reached << length * step & most
            left, step = left - step, 2 * step
        if reached >> room:
            break
    at, out = reached.bit_length() - 1, {}
    for length, step, before in reversed(seen):
        if not before >> at & 1:
            at -= length * step
            out[length] = out.get(length, 0) + step
    return out


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first, bin, each, offset): from number `first` on, and until the next row of the length, pieces of the
    length go `each` to a bin, from bin on, the first of a bin at offset. Every combination is used until one of its
    lengths runs out, so its size depends on the number of lengths, not of pieces."""
    left, used, out, at = dict(counts), dict.fromkeys(counts, 0), [], 0
    while left:
        longest = max(left)
        one = {k: n - (k == longest) for k, n in left.items() if n > (k == longest)}
        chosen = fullest(one, capacity - longest)
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(left[k] // n for k, n in chosen.items())
        place = 0
        for k, n in sorted(chosen.items(), reverse=True):
            out.append((k, used[k], at, n, place))
            place += k * n
            used[k] += n * times
            left[k] -= n * times
            if not left[k]:
                del left[k]
        at += times
    return out


def packed(cut: DataFrame, capacity: int = 2048) -> DataFrame:
    """Pieces (doc_id, piece, length and more; length from 1 to capacity) with sequence_id and offset. The numbers of a
    length's pieces follow doc_id, piece and the other columns, so reruns agree."""
    more = [c for c in cut.columns if c not in ("doc_id", "piece", "length", "ids")]
    placed = ranks.ranked(cut, ["length"], ["doc_id", "piece", *more])
    counts = {r["length"]: r["n"] for r in placed.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = np.array(sorted(plan(counts, capacity)), np.int64).reshape(-1, 5)
    # One order of (length, first), so that one search finds the row of a piece.
    wide = int(max(counts.values(), default=0)) + 1
    keys = rows[:, 0] * wide + rows[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, place = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "place"))
            row = rows[np.searchsorted(keys, length * wide + place, side="right") - 1]
            past = place - row[:, 1]
            own = [c for c in batch.schema.names if c not in ("place", "n")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(row[:, 2] + past // np.maximum(row[:, 3], 1)), pa.array(row[:, 4] + past % np.maximum(row[:, 3], 1) * length)], names=[*own, "sequence_id", "offset"])

    schema = ", ".join([*(f"`{c}` {cut.schema[c].dataType.simpleString()}" for c in cut.columns), "sequence_id long, offset long"])
    return placed.select(*cut.columns, "place", "n").mapInArrow(run, schema)


def pack(docs: DataFrame, model: str, capacity: int = 2048, end: int = 0, text: str = "text", key: str = "doc_id", ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset: every piece of every document in a sequence of at
    most `capacity` ids, without gaps.

    A null text is empty and has the one id `end`. Documents of up to `capacity` ids stay whole. Repeated rows are packed
    each; null doc_ids come first among pieces of a length; an empty table gives an empty result; other columns are
    ignored. Texts are encoded once, whole."""
    return packed(C.settle(pieces(docs, model, capacity, end, text, key, ids), "pieces"), capacity)


def sequences(found: DataFrame) -> DataFrame:
    """sequence_id, ids and doc_ids (with the offset at which each begins) of what `pack` made with ids; a row has at most
    one sequence's ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return found.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.flatten("p.ids").alias("ids"), F.transform("p", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["offset"].alias("offset"))).alias("doc_ids"))


def op13_best_fit_packing(spark, sf_dir: str, model: str | None = None, capacity: int = 2048) -> DataFrame:
    """Digest of the packing of all documents."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, model or public_tokenizers.path("byte_bpe_50k.json"), capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
