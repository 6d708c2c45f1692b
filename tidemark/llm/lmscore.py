"""Context-tree weighting over bytes, and a unigram word score beside it.

A byte is eight binary decisions, each with a context tree over the preceding bytes. At every node the Krichevsky-
Trofimov estimate of the node competes with the product of its children, and the posterior of that competition mixes
the estimates of all depths. Counts come from the whole training part: (DEPTH + 1)-grams of bytes are counted by Spark.

Every context of the corpus is a node (`gram_logs`). The contexts that end in the same TOP bytes are a subtree, which a
task works out by itself, up and down; what is above has at most 256 contexts for TOP = 2, whatever the input. The result
is the log probability of each gram that occurs anywhere. Grams with at least the share FREQUENT of all places are known
to every task, the others are looked up in shards, like words. With `split`, only contexts that have this share of the
training bytes are nodes (`train`), and the tree is broadcast; the bytes of a node outside its split children are one more
child.

Word counts are exact. Words that have at least the share FREQUENT of all tokens, at most 1 / FREQUENT words, are known to
every task. The others go to shards: a slice of texts sends each shard its rarer words once, with the documents that have
them, and the shard answers with sums for each document; so no word fills a shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common as C
from tidemark.llm import postings as P

DEPTH = 4
SPLIT = 1 / 4096
#: Training bytes at which the share of a split context has begun to fall.
SPLIT_BYTES = 1e8
#: Share of all tokens from which on a word is sent to all tasks, and the most bytes of such a word.
FREQUENT, FREQUENT_BYTES = 1e-6, 128
#: Contexts that share so many last bytes are worked out together, and the grams that a task takes at a time, in whole subtrees.
TOP, BLOCK_GRAMS = 2, 200_000
#: The symbol that ends a text and stands before it: no byte of UTF-8.
END = 255
_NO_ID = np.iinfo(np.int64).min


def sequence(texts: pa.Array, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' lower-cased bytes, each after `depth` END and before one; places of the symbols; their texts."""
    raw, off = C.buffers(pc.ascii_lower(texts))
    n = len(off) - 1
    size = np.diff(off)
    seq = np.full(len(raw) + n * (depth + 1), END, np.uint8)
    start = off[:-1] + (depth + 1) * np.arange(n) + depth
    seq[np.arange(len(raw)) + np.repeat(start - off[:-1], size)] = raw
    owner = np.repeat(np.arange(n), size + 1)
    first = np.cumsum(np.concatenate([[0], size + 1]))[:-1]
    return seq, np.arange(len(owner)) + np.repeat(start - first, size + 1), owner


def _merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    codes, inverse = np.unique(np.concatenate([x[0] for x in parts]), return_inverse=True)
    return codes, *(np.bincount(inverse, weights=np.concatenate([x[j] for x in parts])).astype(np.int64) for j in (1, 2))


def gram_codes(texts: pa.Array, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The run of depth + 1 bytes that ends at each symbol, the latest byte lowest; the symbols' texts."""
    seq, at, owner = sequence(texts, depth)
    code = np.zeros(len(at), np.int64)
    for j in range(depth + 1):
        code |= seq[at - j].astype(np.int64) << (8 * j)
    return code, owner


def gram_counts(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """code, n, trained: how often each run of depth + 1 bytes occurs in column text, and how often where column held, if
    there is one, is false; the latest byte is the lowest of the code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []
        held = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(dict(zip(("code", "n", "trained"), parts[0])))

        for batch in C.slices(batches, most=3 << 20):
            away = batch.column("held").to_numpy(zero_copy_only=False).astype(bool)
            for kind in (False, True):
                code, _ = gram_codes(C.plain(batch.column("text").filter(pa.array(away == kind))), depth)
                codes, n = np.unique(code, return_counts=True)
                parts.append((codes, n, n * (not kind)))
                held += len(codes)
            if held > 3_000_000:
                parts = [_merged(parts)]
                held = len(parts[0][0])
                if held > 1_500_000:
                    yield out()
                    parts, held = [], 0
        if parts:
            parts = [_merged(parts)]
            yield out()

    held = F.col("held") if "held" in docs.columns else F.lit(False)
    counted = docs.select(F.col("text").alias("text"), held.alias("held")).mapInArrow(run, "code long, n long, trained long")
    return counted.groupBy("code").agg(F.sum("n").alias("n"), F.sum("trained").alias("trained"))


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Log gamma for x > 0: Stirling's series after eight steps up."""
    low = np.zeros_like(x)
    for j in range(8):
        low += np.log(x + j)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - low


class Tree:
    """The frozen context tree: `step` (state, byte) -> state, and `logp` (state, symbol) -> log10 probability."""

    def __init__(self, levels: list[dict[int, np.ndarray]]):
        """levels[d]: symbol counts (256) of each split-worthy context of d bytes; levels[0] has the root at 0."""
        nodes = [(d, c) for d, level in enumerate(levels) for c in level]
        number = {x: i for i, x in enumerate(nodes)}
        children: list[dict[int, int]] = [{} for _ in nodes]
        for (d, c), i in number.items():
            if d:
                children[number[d - 1, c & ((1 << 8 * (d - 1)) - 1)]][c >> 8 * (d - 1)] = i
        inner = [i for i, x in enumerate(children) if x]
        other = {i: len(nodes) + k for k, i in enumerate(inner)}
        total = len(nodes) + len(inner)
        counts = np.zeros((total, 512))
        for (d, c), i in number.items():
            counts[i, 256:] = levels[d][c]
        for i in inner:
            counts[other[i], 256:] = counts[i, 256:] - counts[list(children[i].values()), 256:].sum(axis=0)
        for u in range(255, 0, -1):
            counts[:, u] = counts[:, 2 * u] + counts[:, 2 * u + 1]
        zero, one = counts[:, 2:512:2], counts[:, 3:512:2]
        evidence = np.empty((total, 255), np.float32)
        for x in range(0, total, 4096):
            y = slice(x, x + 4096)
            evidence[y] = _lgamma(zero[y] + 0.5) + _lgamma(one[y] + 0.5) - np.log(np.pi) - _lgamma(zero[y] + one[y] + 1)
        weighted = evidence.copy()
        keep = np.ones((total, 255), np.float32)
        for i in reversed(inner):
            split = weighted[[*children[i].values(), other[i]]].astype(np.float64).sum(axis=0)
            own = evidence[i].astype(np.float64)
            weighted[i] = np.logaddexp(own, split) - np.log(2)
            keep[i] = 1 / (1 + np.exp(np.clip(split - own, -700, 700)))
        kt = ((one + 0.5) / (zero + one + 1)).astype(np.float32)
        done, open_ = np.zeros((total, 255), np.float32), np.ones((total, 255), np.float32)
        for i in inner:
            below = [*children[i].values(), other[i]]
            done[below] = done[i] + open_[i] * keep[i] * kt[i]
            open_[below] = open_[i] * (1 - keep[i])
        one_next = np.clip(done + open_ * kt, 1e-9, 1 - 1e-7)
        logp = np.zeros((total, 512), np.float32)
        for u in range(1, 256):
            logp[:, 2 * u] = logp[:, u] + np.log10(1 - one_next[:, u - 1])
            logp[:, 2 * u + 1] = logp[:, u] + np.log10(one_next[:, u - 1])
        self.logp = np.ascontiguousarray(logp[:, 256:])
        self.step = np.repeat(np.arange(total, dtype=np.int32)[:, None], 256, axis=1)
        for i in inner:
            self.step[i] = other[i]
            self.step[i, list(children[i])] = list(children[i].values())
        self.depth = len(levels) - 1

    def scores(self, texts: pa.Array) -> np.ndarray:
        """log10 probability of each text, its end included."""
        seq, at, owner = sequence(texts, self.depth)
        state = np.zeros(len(at), np.int32)
        step, logp = self.step.ravel(), self.logp.ravel()
        for j in range(1, self.depth + 1):
            state = step[state.astype(np.int64) * 256 + seq[at - j]]
        value = logp[state.astype(np.int64) * 256 + seq[at]]
        return np.bincount(owner, weights=value, minlength=len(texts))


def share(n_bytes: int) -> float:
    """The share of all training bytes that a context needs to be split."""
    return SPLIT / (1 + n_bytes / SPLIT_BYTES) ** 0.25


def train(docs: DataFrame, depth: int = DEPTH, split: float | None = None) -> Tree:
    """The tree of all texts of docs. The driver gets the contexts that have at least the share `split` of the bytes (by
    default that of `share`): at most 1 / split for each depth, of up to 256 symbols. With split 0 every context of the
    corpus is a node: the exact weighting, for corpora whose contexts fit in memory."""
    grams = C.settle(gram_counts(docs, depth), "ctw-grams")
    total = grams.agg(F.sum("n")).first()[0] or 0
    least = total * (share(total) if split is None else split)
    levels = []
    for d in range(depth + 1):
        context = F.shiftright("code", 8).bitwiseAND(F.lit((1 << 8 * d) - 1)) if d else F.col("code") * 0
        by_symbol = grams.groupBy(context.alias("context"), F.col("code").bitwiseAND(F.lit(255)).alias("symbol")).agg(F.sum("n").alias("n"))
        counted = F.map_from_entries(F.collect_list(F.struct("symbol", "n")))
        large = by_symbol.groupBy("context").agg(F.sum("n").alias("total"), counted.alias("symbols")).where(F.col("total") >= least)
        rows = large.select("context", F.explode("symbols").alias("symbol", "n")).toPandas().sort_values(["context", "symbol"])
        level: dict[int, np.ndarray] = {} if d else {0: np.zeros(256)}
        for c, s, n in zip(rows["context"], rows["symbol"], rows["n"]):
            level.setdefault(int(c), np.zeros(256))[int(s)] = n
        levels.append(level)
    return Tree(levels)


def _low(keys: np.ndarray, d: int) -> np.ndarray:
    """The keys (context above a byte) with contexts of d bytes."""
    return keys & ((1 << 8 * (d + 1)) - 1)


def _evidence(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    return _lgamma(zero + 0.5) + _lgamma(one + 0.5) - np.log(np.pi) - _lgamma(zero + one + 1)


class _Level:
    """The binary nodes of all contexts of one depth: key (context above the node's number 1 to 255, ascending), counts of
    both bits, log evidence, log weighted probability, and the posterior that the node's own estimate is kept."""

    def __init__(self, key: np.ndarray, zero: np.ndarray, one: np.ndarray, below: np.ndarray | None):
        """below: sums of the children's log weighted probabilities, or None for contexts that have no children."""
        self.key, self.kt = key, (one + 0.5) / (zero + one + 1)
        self.zero, self.one = zero, one
        own = _evidence(zero, one)
        self.weighted = own if below is None else np.logaddexp(own, below) - np.log(2)
        self.keep = np.ones(len(own)) if below is None else 1 / (1 + np.exp(np.clip(below - own, -700, 700)))

    def above(self, d: int) -> _Level:
        """The level of depth d, one less than this one's, of which these nodes are all children."""
        key, at = np.unique(_low(self.key, d), return_inverse=True)
        return _Level(key, *(np.bincount(at, weights=x).astype(np.float64) for x in (self.zero, self.one, self.weighted)))

    def down(self, done: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the nodes' children start with, from what the nodes start with: the mixture so far and the weight left."""
        return done + left * self.keep * self.kt, left * (1 - self.keep)


def _subtrees(code: np.ndarray, n: np.ndarray, depth: int, top: int) -> tuple[list[_Level], np.ndarray]:
    """Levels from depth up to top of distinct grams, and for each gram and bit the place of its node in the first level."""
    byte = 256 + (code & 255)
    number = np.stack([byte >> (8 - k) for k in range(8)])
    key, at = np.unique(((code & ~np.int64(255))[None, :] | number).ravel(), return_inverse=True)
    bit = np.stack([(byte >> (7 - k)) & 1 for k in range(8)]).ravel()
    at, times = at.ravel(), np.tile(n.astype(np.float64), 8)
    one = np.bincount(at, weights=times * bit, minlength=len(key))
    levels = [_Level(key, np.bincount(at, weights=times, minlength=len(key)) - one, one, None)]
    for d in range(depth - 1, top - 1, -1):
        levels.append(levels[-1].above(d))
    return levels, at.reshape(8, -1)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """(code, n, trained) of whole subtrees, BLOCK_GRAMS or more at a time, of rows in order of subtree."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def arrays(table: pa.Table) -> tuple[np.ndarray, ...]:
        return tuple(table.column(k).to_numpy() for k in ("code", "n", "trained"))

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= BLOCK_GRAMS:
            table = pa.Table.from_batches(held)
            top = table.column("top").to_numpy()
            cut = int(np.searchsorted(top, top[-1]))
            if cut:
                yield arrays(table.slice(0, cut))
            held = table.slice(cut).to_batches()
            rows = len(top) - cut
    if rows:
        yield arrays(pa.Table.from_batches(held))


def gram_logs(grams: DataFrame, shards: int, depth: int = DEPTH) -> DataFrame:
    """code, n, shard, logp for each row of grams (code, n, trained): the log10 probability of the last byte after the
    others, by the exact weighting over all contexts of the training texts. Grams that no training text has are given
    with trained 0. A task holds the grams of one subtree, at most 256 ** (depth + 1 - TOP) whatever the input; the driver
    gets at most 255 rows for each context of TOP - 1 bytes."""
    top = min(TOP, depth)
    context = F.shiftright("code", 8).bitwiseAND(F.lit((1 << 8 * top) - 1)) if top else F.col("code") * 0
    dealt = grams.select("code", "n", "trained", context.alias("top")).repartition("top").sortWithinPartitions("top")

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for code, _, trained in _blocks(batches):
            x = _subtrees(code, trained, depth, top)[0][-1]
            yield pa.RecordBatch.from_pydict({"key": _low(x.key, top - 1), "zero": x.zero, "one": x.one, "weighted": x.weighted})

    start: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
    if top:
        # Sums of decimals, as those of doubles would depend on the order of rows.
        exact = [F.sum(F.col(k).cast("decimal(38,12)")).cast("double").alias(k) for k in ("zero", "one", "weighted")]
        found = dealt.mapInArrow(up, "key long, zero double, one double, weighted double").groupBy("key").agg(*exact).toPandas().sort_values("key")
        levels = [_Level(*(found[k].to_numpy() for k in ("key", "zero", "one", "weighted")))]
        for d in range(top - 2, -1, -1):
            levels.append(levels[-1].above(d))
        done, left = np.zeros(len(levels[-1].key)), np.ones(len(levels[-1].key))
        for d in range(top):
            level = levels[top - 1 - d]
            if d:
                at = np.searchsorted(levels[top - d].key, _low(level.key, d - 1))
                done, left = done[at], left[at]
            done, left = level.down(done, left)
        start = levels[0].key, done, left

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for code, n, trained in _blocks(batches):
            levels, nodes = _subtrees(code, trained, depth, top)
            key = levels[-1].key
            if start is None:
                done, left = np.zeros(len(key)), np.ones(len(key))
            else:
                at = np.searchsorted(start[0], _low(key, top - 1))
                done, left = start[1][at], start[2][at]
            for d in range(top, depth):
                done, left = levels[depth - d].down(done, left)
                at = np.searchsorted(levels[depth - d].key, _low(levels[depth - d - 1].key, d))
                done, left = done[at], left[at]
            one = np.clip(done + left * levels[0].kt, 1e-9, 1 - 1e-7)
            logp = np.zeros(len(code))
            for k in range(8):
                p = one[nodes[k]]
                logp += np.log10(np.where((code >> (7 - k)) & 1, p, 1 - p))
            yield pa.RecordBatch.from_pydict({"code": code, "n": n, "shard": _gram_shards(code, shards), "logp": logp})

    return dealt.mapInArrow(down, "code long, n long, shard long, logp double")


def _gram_shards(code: np.ndarray, shards: int) -> np.ndarray:
    return (C.spread(code.astype(np.uint64)) % np.uint64(shards)).astype(np.int64)


class Grams:
    """The log probabilities of the grams that every task knows."""

    def __init__(self, code: np.ndarray, logp: np.ndarray, depth: int):
        self.code, self.logp, self.depth = code, logp, depth

    def scores(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sums for each text over the grams that are known; code and text of each place that has another one."""
        code, owner = gram_codes(texts, self.depth)
        at = pc.fill_null(pc.index_in(pa.array(code), value_set=pa.array(self.code)), -1).to_numpy()
        known = at >= 0
        total = np.bincount(owner[known], weights=self.logp[at[known]], minlength=len(texts))
        return total, code[~known], owner[~known]


_SENT = {"shard": pa.int64(), "slice": pa.int64(), "words": pa.binary(), "trained": pa.binary(), "width": pa.binary(), "at": pa.binary(), "times": pa.binary(), "docs": pa.binary(), "held": pa.binary(), "tokens": pa.binary(), "bytes": pa.binary(), "score": pa.binary(), "own_known": pa.binary(), "own_logs": pa.binary(), "grams": pa.binary(), "gram_width": pa.binary(), "gram_at": pa.binary(), "gram_times": pa.binary()}
_SENT_SQL = "shard long, slice long, words binary, trained binary, width binary, at binary, times binary, docs binary, held binary, tokens binary, bytes binary, score binary, own_known binary, own_logs binary, grams binary, gram_width binary, gram_at binary, gram_times binary"
_REPLY = {k: _SENT[k] for k in ("slice", "at", "docs", "held", "tokens", "bytes", "score", "own_known", "own_logs")} | {"known": pa.binary(), "logs": pa.binary(), "gram_at": pa.binary(), "tree": pa.binary(), "distinct": pa.int64()}
_REPLY_SQL = "slice long, at binary, docs binary, held binary, tokens binary, bytes binary, score binary, own_known binary, own_logs binary, known binary, logs binary, gram_at binary, tree binary, distinct long"
_FOUND_SQL = "doc_id long, held_out boolean, n_words long, n_bytes long, score double, known long, logs double, distinct long"


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, n, trained: occurrences in all texts and in training ones, by slice."""
    for batch in C.slices(batches):
        dictionary, ids, off = C.word_ids(C.plain(batch.column("text")), lower=True)
        held = batch.column("held").to_numpy(zero_copy_only=False).astype(bool)
        n = np.bincount(ids, minlength=len(dictionary))
        trained = np.bincount(ids, weights=~held[C.owners(off)], minlength=len(dictionary)).astype(np.int64)
        short = pc.less_equal(pc.binary_length(dictionary), FREQUENT_BYTES)
        table = pa.table({"word": dictionary.cast(pa.large_binary()).cast(pa.binary()), "n": n.astype(np.int64), "trained": trained}).filter(short)
        yield from table.combine_chunks().to_batches()


def frequent_words(rows: DataFrame, least_share: float = FREQUENT) -> tuple[pa.Array, np.ndarray]:
    """The words of (text, held) that have at least `least_share` of all tokens, and their counts in training texts."""
    counted = rows.select("text", "held").mapInArrow(_word_counts, "word binary, n long, trained long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("trained").alias("trained"))
    counted = C.settle(counted, "lm-words")
    least = (counted.agg(F.sum("n")).first()[0] or 0) * least_share
    found = counted.where(F.col("n") >= least).select("word", "trained").orderBy("word").toPandas()
    return pa.array(found["word"].tolist(), pa.large_binary()), found["trained"].to_numpy(np.int64)


def _tree_scores(texts: pa.Array, tree: Tree | Grams) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Each text's sum of what the task knows; of the other grams, in order: code, text and times."""
    score, codes, ats, times = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    at = 0
    for x in C.cuts(pa.RecordBatch.from_arrays([texts], names=["text"]), most=2 << 20):
        found = tree.scores(x.column("text"))
        if isinstance(tree, Grams):
            found, code, owner = found
            # A code has 40 bits at most for DEPTH bytes of context, a text's place in the slice 16.
            pair, n = np.unique((code << 16) | (owner + at), return_counts=True)
            codes.append(pair >> 16), ats.append(pair & 0xFFFF), times.append(n)
        score.append(found)
        at += x.num_rows
    code = np.concatenate(codes)
    order = np.argsort(code, kind="stable")
    return np.concatenate(score), (code[order], np.concatenate(ats)[order].astype(np.uint16), np.concatenate(times)[order].astype(np.uint32))


def _send(batches: Iterator[pa.RecordBatch], shards: int, tree: Tree | Grams, words: pa.Array, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    number = 0
    for batch in C.slices(batches):
        for low in range(0, batch.num_rows, P.MOST_ROWS):
            part = batch.slice(low, P.MOST_ROWS)
            n, name = part.num_rows, P.slice_number(number)
            number += 1
            texts = C.plain(part.column("text"))
            score, grams = _tree_scores(texts, tree)
            held = part.column("held").to_numpy(zero_copy_only=False).astype(bool)
            dictionary, ids, off = C.word_ids(texts, lower=True)
            owner = C.owners(off)
            place = pc.fill_null(pc.index_in(dictionary.cast(pa.large_binary()), value_set=words), -1).to_numpy(zero_copy_only=False)
            c = np.where(place >= 0, counts[place], 0)[ids] if len(words) else np.zeros(len(ids), np.int64)
            own = {"own_known": np.bincount(owner, weights=c > 0, minlength=n).astype(np.int64).tobytes(), "own_logs": np.bincount(owner, weights=np.log10(c + 1.0), minlength=n).tobytes()}
            rare = np.flatnonzero(place < 0)
            again = np.full(len(dictionary), -1)
            again[rare] = np.arange(len(rare))
            dictionary, mine = dictionary.take(pa.array(rare)), again[ids] >= 0
            ids, owner = again[ids][mine], owner[mine]
            shard = (C.word_hashes(dictionary) % np.uint64(shards)).astype(np.int64)
            by_shard = np.argsort(shard, kind="stable")
            place = np.empty(len(by_shard), np.int64)
            place[by_shard] = np.arange(len(by_shard))
            pair, times = np.unique(place[ids] * n + owner, return_counts=True)
            word, at = pair // n, (pair % n).astype(np.uint16)
            trained = np.bincount(word, weights=times * ~held[at], minlength=len(by_shard)).astype(np.int64)
            width = np.bincount(word, minlength=len(by_shard)).astype(np.uint16)
            named = dictionary.cast(pa.large_binary()).take(pa.array(by_shard)).to_pylist()
            cut = np.searchsorted(shard[by_shard], np.arange(shards + 1))
            pairs = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])
            gram, gram_at, gram_times = grams
            first = P.runs(gram)
            gram_shard = _gram_shards(gram[first], shards)
            gram_order = np.argsort(gram_shard, kind="stable")
            gram_cut = np.searchsorted(gram_shard[gram_order], np.arange(shards + 1))
            gram_width = np.diff(np.append(first, len(gram)))
            ids_ = pc.fill_null(part.column("doc_id"), _NO_ID).to_numpy(zero_copy_only=False)
            meta = {"shard": name % shards, "slice": name, "docs": P.pack_ids(ids_), "held": held.tobytes(), "tokens": np.diff(off).astype(np.int64).tobytes(), "bytes": pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64).tobytes(), "score": score.tobytes(), **own}
            out: dict[str, list] = {k: [meta.get(k)] for k in _SENT}
            for s in np.flatnonzero(np.diff(cut) + np.diff(gram_cut)):
                x, y = cut[s], cut[s + 1]
                p = slice(pairs[x], pairs[y])
                row = {"shard": int(s), "slice": name}
                if y > x:
                    row |= {"words": b"\n".join(named[x:y]), "trained": trained[x:y].tobytes(), "width": width[x:y].tobytes(), "at": at[p].tobytes(), "times": times[p].astype(np.uint32).tobytes()}
                mine = gram_order[gram_cut[s] : gram_cut[s + 1]]
                if len(mine):
                    width_ = gram_width[mine]
                    place = np.repeat(first[mine] - np.cumsum(width_) + width_, width_) + np.arange(width_.sum())
                    row |= {"grams": gram[first[mine]].tobytes(), "gram_width": width_.astype(np.uint16).tobytes(), "gram_at": gram_at[place].tobytes(), "gram_times": gram_times[place].tobytes()}
                for k in _SENT:
                    out[k].append(row.get(k))
            yield P.rows(out, _SENT)


def _answer(table: pa.Table, logs: pa.Table) -> pa.Table:
    """For each slice: known tokens and sums of log10(count + 1), by document; the sums of the tree's logs; and the shard's
    distinct training words. logs: code and logp of the shard's grams."""
    import pandas as pd

    rows = {k: table.column(k).to_pylist() for k in _SENT if k != "shard"}
    out: dict[str, list] = {k: [] for k in _REPLY}

    def add(**row) -> None:
        for k in _REPLY:
            out[k].append(row.get(k))

    for i, x in enumerate(rows["docs"]):
        if x is not None:
            add(**{k: rows[k][i] for k in ("slice", "docs", "held", "tokens", "bytes", "score", "own_known", "own_logs")})
    asked = [i for i, x in enumerate(rows["grams"]) if x is not None]
    if asked:
        order = np.argsort(logs.column("code").to_numpy())
        code, logp = logs.column("code").to_numpy()[order], logs.column("logp").to_numpy()[order]
        for i in asked:
            value = np.repeat(logp[np.searchsorted(code, np.frombuffer(rows["grams"][i], np.int64))], np.frombuffer(rows["gram_width"][i], np.uint16))
            has, place = np.unique(np.frombuffer(rows["gram_at"][i], np.uint16), return_inverse=True)
            add(slice=rows["slice"][i], gram_at=has.tobytes(), tree=np.bincount(place, weights=value * np.frombuffer(rows["gram_times"][i], np.uint32)).tobytes())
    sent = [i for i, x in enumerate(rows["words"]) if x is not None]
    if sent:
        named = [rows["words"][i].split(b"\n") for i in sent]
        codes, _ = pd.factorize(np.array([w for x in named for w in x], dtype=object))
        trained = np.concatenate([np.frombuffer(rows["trained"][i], np.int64) for i in sent])
        count = np.bincount(codes, weights=trained)
        add(slice=-1 - table.column("shard")[0].as_py(), distinct=int((count > 0).sum()))
        edge = np.cumsum([0] + [len(x) for x in named])
        for j, i in enumerate(sent):
            c = np.repeat(count[codes[edge[j] : edge[j + 1]]], np.frombuffer(rows["width"][i], np.uint16))
            at, times = np.frombuffer(rows["at"][i], np.uint16), np.frombuffer(rows["times"][i], np.uint32)
            has, place = np.unique(at, return_inverse=True)
            known = np.bincount(place, weights=times * (c > 0)).astype(np.int64)
            add(slice=rows["slice"][i], at=has.tobytes(), known=known.tobytes(), logs=np.bincount(place, weights=times * np.log10(c + 1)).tobytes())
    return pa.Table.from_pydict(out, schema=pa.schema(list(_REPLY.items())))


def _gather(table: pa.Table) -> pa.Table:
    """The documents of a slice with their sums, or the shard's number of distinct words."""
    rows = {k: table.column(k).to_pylist() for k in _REPLY}
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_words", pa.int64()), ("n_bytes", pa.int64()), ("score", pa.float64()), ("known", pa.int64()), ("logs", pa.float64()), ("distinct", pa.int64())])
    if rows["slice"][0] < 0:
        return pa.Table.from_pylist([{"distinct": x} for x in rows["distinct"]], schema)
    meta = next(i for i, x in enumerate(rows["docs"]) if x is not None)
    ids = P.unpack_ids(rows["docs"][meta])
    known, logs = np.frombuffer(rows["own_known"][meta], np.int64).copy(), np.frombuffer(rows["own_logs"][meta]).copy()
    for at, k, x in sorted((x for x in zip(rows["at"], rows["known"], rows["logs"]) if x[1] is not None), key=lambda x: (x[0], x[1], x[2])):
        at = np.frombuffer(at, np.uint16)
        known[at] += np.frombuffer(k, np.int64)
        logs[at] += np.frombuffer(x, np.float64)
    score = np.frombuffer(rows["score"][meta]).copy()
    for at, x in sorted(x for x in zip(rows["gram_at"], rows["tree"]) if x[1] is not None):
        score[np.frombuffer(at, np.uint16)] += np.frombuffer(x)
    numbers = lambda k, kind: pa.array(np.frombuffer(rows[k][meta], kind))
    columns = [pa.array(ids, mask=ids == _NO_ID), numbers("held", bool), numbers("tokens", np.int64), numbers("bytes", np.int64), pa.array(score), pa.array(known), pa.array(logs), pa.nulls(len(ids), pa.int64())]
    return pa.Table.from_arrays(columns, schema=schema)


def score(docs: DataFrame, held_out: Column, depth: int = DEPTH, split: float | None = None, frequent: float = FREQUENT) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score,
    n_bytes, bits_per_byte (code length by the tree, the end's included).

    Both models learn from the rows that held_out leaves. Tokens are the lower-cased words and one end for each text.
    base_score adds log10((c + 1) / (N + V + 1)): c the token's training count, N all training tokens, V the distinct
    ones. A null text is empty: it has the end alone. Repeated rows each count. A null held_out trains. An empty table
    gives an empty result; without any training rows the tree is the uniform start. Other columns are ignored.
    Every context is a node of the tree; with `split` those are that have at least this share of the training bytes.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))
    words, counts = frequent_words(rows, frequent)
    shards = C.shards_for(C.text_bytes(rows, "text"), 32 << 20)
    if split is None:
        grams = C.settle(gram_logs(C.settle(gram_counts(rows, depth), "ctw-grams"), shards, depth), "ctw-logs")
        least = (grams.agg(F.sum("n")).first()[0] or 0) * frequent
        known = grams.where(F.col("n") >= least).select("code", "logp").toPandas()
        tree, rare = Grams(known["code"].to_numpy(np.int64), known["logp"].to_numpy(np.float64), depth), grams.where(F.col("n") < least)
    else:
        tree = train(rows.where(~F.col("held")), depth, split)
        rare = rows.sparkSession.createDataFrame([], "code long, shard long, logp double")
    shared = rows.sparkSession.sparkContext.broadcast((tree, words, counts))
    sent = rows.mapInArrow(lambda b: _send(b, shards, *shared.value), _SENT_SQL)
    asked = sent.groupBy("shard").cogroup(rare.select("shard", "code", "logp").groupBy("shard"))
    found = C.settle(asked.applyInArrow(_answer, _REPLY_SQL).groupBy("slice").applyInArrow(_gather, _FOUND_SQL), "lm-found")
    # What was found is in files now.
    shared.unpersist()
    trained = (~F.col("held_out")) & F.col("distinct").isNull()
    n_words, ends, distinct = found.agg(F.sum(F.when(trained, F.col("n_words"))), F.count_if(trained), F.sum("distinct")).first()
    ends, distinct = ends or 0, (distinct or 0) + int((counts > 0).sum())
    total, kinds = (n_words or 0) + ends, distinct + (ends > 0)
    end_log = float(np.log10(ends + 1))
    n_tokens = F.col("n_words") + 1
    base = F.col("logs") + F.lit(end_log) - n_tokens * F.lit(float(np.log10(total + kinds + 1)))
    bits = -F.col("score") * F.lit(float(np.log2(10))) / (F.col("n_bytes") + 1)
    known = F.col("known") + F.lit(int(ends > 0))
    return found.where(F.col("distinct").isNull()).select("doc_id", "held_out", n_tokens.alias("n_tokens"), known.alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score", "n_bytes", bits.alias("bits_per_byte"))


def op1_context_tree_score(spark, sf_dir: str) -> DataFrame:
    """Digest of the scores of all documents; a seventh of them, by CRC, is held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2
    return score(docs, held).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte")
