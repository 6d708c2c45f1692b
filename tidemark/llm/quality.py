"""Quality rules as a short-circuit cascade.

Each rule's cost and rejection rate are estimated on a bounded sample, the rules are ordered by rejection
per cost, and a rule then sees only the rows that the rules before it let pass. A row is kept if no rule
rejects it, so the order changes the cost and `rejected_by`, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common as C

Features = dict[str, np.ndarray]

#: Bytes of text whose features are computed at a time: their arrays take about 60 times as much.
SLICE_BYTES = 2 << 20


def _table(*members: int) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[list(members)] = 1
    return out


_SPACE = _table(*C.SPACES.encode())
#: 1 for a byte that starts a code point other than ASCII white space.
_WORD_CHAR = np.array([int((b & 0xC0) != 0x80 and not _SPACE[b]) for b in range(256)], np.uint8)
#: The characters that count as symbols.
_SYMBOL = _table(*b"#*$%&|<>")
_SHOUT = _table(*b"!")


def _byte_sums(texts: pa.Array, *tables: np.ndarray) -> list[np.ndarray]:
    raw, off = C.buffers(texts)
    out = []
    for table in tables:
        run = np.cumsum(table[raw], dtype=np.int32)
        upto = np.zeros(len(off), np.int64)
        upto[off > 0] = run[off[off > 0] - 1]
        out.append(np.diff(upto))
    return out


def _chars(texts: pa.Array) -> Features:
    chars, symbols, shouts = _byte_sums(texts, _WORD_CHAR, _SYMBOL, _SHOUT)
    return {"word_chars": chars, "n_symbols": symbols, "n_shouts": shouts}


def _words(texts: pa.Array) -> Features:
    return {"n_words": np.diff(C.words(texts)[1])}


def _lines(texts: pa.Array) -> Features:
    total, again = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts.to_pylist()):
        full = [x for x in text.split("\n") if x.strip(C.SPACES)]
        total[i], again[i] = len(full), len(full) - len(set(full))
    return {"n_lines": total, "n_dup_lines": again}


def _repeats(texts: pa.Array) -> Features:
    """Words within a 3-word window that the same text has twice or more."""
    _, ids, off = C.word_ids(texts)
    n = len(ids) - 2
    covered = np.zeros(len(ids) + 2, bool)
    owner = C.owners(off)
    if n > 0:
        starts = np.flatnonzero(C.inside(off, 3, n))
        _, pair = np.unique(ids[starts] * (len(ids) + 1) + ids[starts + 1], return_inverse=True)
        _, triple = np.unique(pair * (len(ids) + 1) + ids[starts + 2], return_inverse=True)
        _, at, count = np.unique(triple * len(texts) + owner[starts], return_inverse=True, return_counts=True)
        hit = starts[count[at] > 1]
        for j in range(3):
            covered[hit + j] = True
    return {"n_repeat_words": np.bincount(owner, weights=covered[: len(ids)], minlength=len(texts)).astype(np.int64)}


#: What computes which features.
SOURCES: dict[str, Callable[[pa.Array], Features]] = {"chars": _chars, "words": _words, "lines": _lines, "repeats": _repeats}


@dataclass(frozen=True)
class Rule:
    """Rejects the rows where `rejects(features)` holds; `needs` names the feature sources that it reads."""

    name: str
    needs: tuple[str, ...]
    rejects: Callable[[Features], np.ndarray]


#: Production rules. The first two are the base rules of the digest query.
RULES = (
    Rule("too_few_words", ("words",), lambda f: f["n_words"] < 50),
    Rule("repeated_phrases", ("words", "repeats"), lambda f: 100 * f["n_repeat_words"] > 50 * f["n_words"]),
    Rule("symbols", ("words", "chars"), lambda f: 10 * f["n_symbols"] > 3 * f["n_words"]),
    Rule("shouting", ("words", "chars"), lambda f: 10 * f["n_shouts"] > 3 * f["n_words"]),
    Rule("word_length", ("words", "chars"), lambda f: (f["word_chars"] < 2 * f["n_words"]) | (f["word_chars"] > 20 * f["n_words"])),
    Rule("repeated_lines", ("lines",), lambda f: 2 * f["n_dup_lines"] > f["n_lines"]),
)
BASE_RULES = 2


def _has(texts: pa.Array, features: Features, needs: tuple[str, ...], have: set[str]) -> None:
    for source in needs:
        if source not in have:
            features.update(SOURCES[source](texts))
            have.add(source)


def estimate(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", sample_rows: int = 2000, seed: int = 7) -> list[tuple[str, float, float]]:
    """(rule, CPU ns a row, share rejected) for each rule, from about `sample_rows` rows spread over all documents."""
    n = docs.count()
    if not n:
        return [(r.name, 1.0, 0.0) for r in rules]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches, most=SLICE_BYTES):
            texts = C.plain(batch.column(0))
            for k, rule in enumerate(rules):
                began = time.process_time_ns()
                features: Features = {}
                _has(texts, features, rule.needs, set())
                rejected = int(np.sum(rule.rejects(features)))
                yield pa.RecordBatch.from_pydict({"k": [k], "ns": [time.process_time_ns() - began], "rejected": [rejected], "seen": [len(texts)]})

    sample = docs.select(F.col(text).alias("text")).sample(fraction=min(1.0, sample_rows / n), seed=seed)
    rows = sample.mapInArrow(run, "k long, ns long, rejected long, seen long").groupBy("k").agg(F.sum("ns"), F.sum("rejected"), F.sum("seen")).collect()
    found = {r[0]: (r[1] / max(r[3], 1), r[2] / max(r[3], 1)) for r in rows}
    return [(r.name, *found.get(k, (1.0, 0.0))) for k, r in enumerate(rules)]


def order(rules: tuple[Rule, ...], estimates: list[tuple[str, float, float]]) -> tuple[Rule, ...]:
    """Rules by rejection per cost, highest first; equal ones in the order given."""
    gain = {name: share / max(ns, 1.0) for name, ns, share in estimates}
    return tuple(sorted(rules, key=lambda r: -gain.get(r.name, 0.0)))


def cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", keep: tuple[str, ...] = ("doc_id",), features: tuple[str, ...] = (), sample_rows: int = 2000) -> DataFrame:
    """One row for each document: the columns `keep`, `kept` boolean, `rejected_by` (first rule of the order that
    rejects, else null) and, for every document, the named integer `features`.

    A null text counts as empty: no words, so the word-count rule rejects it. Texts of any length are read whole.
    Repeated rows are judged alike. An empty table gives an empty result; columns not named are ignored.
    """
    chain = order(rules, estimate(docs, rules, text, sample_rows))
    # A text that is kept is sent to the tasks once.
    read = f"k{keep.index(text)}" if text in keep else "text"
    rows = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], *([] if text in keep else [F.col(text).alias("text")]))
    schema = ", ".join([*(f"k{i} {rows.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keep))), "kept boolean, rejected_by string", *(f"{f} long" for f in features)])
    wanted = [s for s in SOURCES if set(features) & set(SOURCES[s](pa.array([""], pa.large_string())))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches, read, SLICE_BYTES):
            texts = C.plain(batch.column(read))
            whole: Features = {}
            have: set[str] = set()
            _has(texts, whole, tuple(wanted), have)
            by = np.full(len(texts), None, object)
            left = np.arange(len(texts))
            rest, now, own = texts, dict(whole), set(have)
            for rule in chain:
                if not len(left):
                    break
                _has(rest, now, rule.needs, own)
                bad = np.asarray(rule.rejects(now), bool)
                if bad.any():
                    by[left[bad]] = rule.name
                    left = left[~bad]
                    rest, now = rest.filter(pa.array(~bad)), {k: v[~bad] for k, v in now.items()}
            kept = np.zeros(len(texts), bool)
            kept[left] = True
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(kept), pa.array(by.tolist(), pa.string()), *(pa.array(whole[f], pa.int64()) for f in features)],
                names=[*(f"k{i}" for i in range(len(keep))), "kept", "rejected_by", *features],
            )

    out = rows.mapInArrow(run, schema)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "kept", "rejected_by", *features)


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Digest of the cascade with the production rules over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = cascade(docs, features=("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "kept")


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ln
  FROM documents
), tri AS (
  SELECT r, unnest(generate_series(1, len(w) - 2)) AS i, w FROM d WHERE len(w) >= 3
), keyed AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS c FROM tri
), covered AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM keyed WHERE c > 1) GROUP BY r
), f AS (
  SELECT doc_id, len(w) AS n_words,
         CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(ln) - len(list_distinct(ln)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
         len(ln) AS n_lines, len(regexp_extract_all(t, '!')) AS n_shouts
  FROM d LEFT JOIN covered USING (r)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > 3 * n_words
            OR 10 * n_shouts > 3 * n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words
            OR 2 * n_dup_lines > n_lines) AS kept
FROM f
"""
