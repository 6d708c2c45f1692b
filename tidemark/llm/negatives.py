"""Hard negatives by norm-bucketed search.

Candidates are sorted by norm and written in that order, so that a file, a row group and a batch each hold a narrow band
of norms: these are the buckets. Anchors are worked on in blocks of a fixed size, which are all that is sent to tasks; a
block reads the candidates once, and of these only the norms that can reach its lowest limit, which the scan itself skips
by its statistics. In a task each bucket is first held against every anchor: no score exceeds the product of the
anchor's norm and the bucket's largest (Cauchy-Schwarz), so an anchor skips a bucket that cannot reach its window's lower
limit or its running last place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common as C
from tidemark.llm import ranks

#: Components of the anchors of a block, rows of a bucket, and anchors that are scored at a time.
BLOCK, BUCKET, PART = 1 << 22, 2048, 512
#: Rounding of norms is far below this.
SLACK = 1 + 1e-9
LONG = (1 << 63) - 1
_FOUND = "uid long, slot int, found array<struct<down:long,unnamed:boolean,id:long,uid:long>>"


def prepared(vectors: DataFrame, scale: int = 256, classes: int = 10, shift: int = 7, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """uid, id, label, v, norm, in order of falling norm, written: rows with a label and a whole, finite vector.

    v is floor(scale * x) of each component; where id is divisible by `shift`, label is (label + 1) % classes."""
    x = F.col(vector).cast("array<double>")
    sound = F.col(label).isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    moved = F.when(F.coalesce(F.col(key) % shift == 0, F.lit(False)), (F.col(label) + 1) % classes).otherwise(F.col(label))
    # floor() of Spark gives a long; the remainder keeps large components exact.
    floored = F.transform(x, lambda c: c * scale - F.pmod(c * scale, F.lit(1.0)))
    rows = vectors.where(sound).select(F.col(key).cast("long").alias("id"), moved.cast("long").alias("label"), floored.alias("v"))
    rows = rows.withColumn("down", -F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c)))
    # Norms may repeat, ids and vectors rarely do: ranges are cut by all three.
    dealt = rows.repartitionByRange("down", F.xxhash64("id", "label", "v")).sortWithinPartitions("down", "id", "label", "v")
    return C.settle(dealt.select(F.monotonically_increasing_id().alias("uid"), "id", "label", "v", (-F.col("down")).alias("norm")), "candidates")


def _matrix(rows: list[np.ndarray], width: int = 0) -> np.ndarray:
    """Vectors as rows, missing components 0."""
    width = max([width, *map(len, rows)])
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _vectors(column: pa.Array) -> np.ndarray:
    flat, off = column.flatten().to_numpy(zero_copy_only=False), np.asarray(column.offsets, np.int64)
    size = np.diff(off)
    if len(size) and (size == size[0]).all():
        return flat.reshape(len(size), -1)
    return _matrix(np.split(flat, (off - off[0])[1:-1]))


def _scores(a: np.ndarray, b: np.ndarray, bound: float) -> np.ndarray:
    """Inner products of the rows, exact: in doubles where none exceeds what they hold, else in Python's integers, held at
    the ends of a long."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    if bound < 1 << 52:
        return (a @ b.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m], object).reshape(m.shape)
    return np.clip(whole(a) @ whole(b).T, -LONG, LONG).astype(np.int64)


class _Search:
    """What a task has found for a block of anchors: per anchor and slot the best `keep` of (-score, no id, id, uid).

    A slot has limits low and high, both included. Where `same`, candidates are other rows of the anchor's label, else
    rows of other labels."""

    def __init__(self, anchors: dict[str, np.ndarray], keep: int, same: bool):
        self.a, self.keep, self.same = anchors, keep, same
        self.best: dict[tuple[int, int], list[tuple]] = {}
        # The least score that still matters to any slot.
        self.floor = anchors["low"].min(axis=1)

    def bucket(self, uid: np.ndarray, ids: list, label: np.ndarray, v: np.ndarray, norm: np.ndarray) -> None:
        a = self.a
        reach = a["norm"] * norm.max() * SLACK
        live = np.flatnonzero(reach >= self.floor.astype(float))
        if self.same:
            for x in np.intersect1d(label, a["label"][live]):
                rows, own = np.flatnonzero(label == x), live[a["label"][live] == x]
                for i in range(0, len(own), PART):
                    self._part(own[i : i + PART], uid[rows], [ids[r] for r in rows], label[rows], v[rows], reach)
            return
        for i in range(0, len(live), PART):
            self._part(live[i : i + PART], uid, ids, label, v, reach)

    def _part(self, at: np.ndarray, uid: np.ndarray, ids: list, label: np.ndarray, v: np.ndarray, reach: np.ndarray) -> None:
        a = self.a
        score = _scores(a["v"][at], v, float(reach[at].max()))
        hit = (score >= self.floor[at][:, None]) & (score <= a["high"][at].max(axis=1)[:, None])
        hit &= (uid[None, :] != a["uid"][at][:, None]) if self.same else (label[None, :] != a["label"][at][:, None])
        row, col = np.nonzero(hit)
        cuts = np.searchsorted(row, np.arange(len(at) + 1))
        for i in np.flatnonzero(np.diff(cuts)):
            k, found = int(at[i]), col[cuts[i] : cuts[i + 1]]
            own = score[i, found]
            for slot in range(a["low"].shape[1]):
                low, high = a["low"][k, slot], a["high"][k, slot]
                kept = self.best.get((k, slot), [])
                if len(kept) == self.keep:
                    low = max(low, -kept[-1][0])
                take = np.flatnonzero((own >= low) & (own <= high))
                if not len(take):
                    continue
                if len(take) > self.keep:
                    # Of many, those from the last place up; ties with it stay for the ids to decide.
                    last = np.sort(own[take])[-self.keep]
                    take = take[own[take] >= last]
                new = [(-int(own[j]), ids[c] is None, ids[c] or 0, int(uid[c])) for j, c in zip(take, found[take])]
                self.best[k, slot] = sorted([*kept, *new])[: self.keep]
            self.floor[k] = min(max(a["low"][k, s], -held[-1][0]) if len(held := self.best.get((k, s), [])) == self.keep else a["low"][k, s] for s in range(a["low"].shape[1]))

    def rows(self) -> pa.RecordBatch:
        items = list(self.best.items())
        flat = [x for _, found in items for x in found]
        ends = np.concatenate([[0], np.cumsum([len(f) for _, f in items])]).astype(np.int32)
        structs = pa.StructArray.from_arrays([pa.array([x[0] for x in flat], pa.int64()), pa.array([x[1] for x in flat], pa.bool_()), pa.array([None if x[1] else x[2] for x in flat], pa.int64()), pa.array([x[3] for x in flat], pa.int64())], names=["down", "unnamed", "id", "uid"])
        return pa.RecordBatch.from_arrays([pa.array(self.a["uid"][[k for (k, _), _ in items]] if items else [], pa.int64()), pa.array([s for (_, s), _ in items], pa.int32()), pa.ListArray.from_arrays(pa.array(ends), structs)], names=["uid", "slot", "found"])


def _limits(score: int | None, low: int, high: int) -> tuple[int, int]:
    """The least and the greatest integer n with low * score <= 100 * n <= high * score; none if there is no score."""
    return (1, 0) if score is None else (-(-low * score // 100), high * score // 100)


def _searched(candidates: DataFrame, anchors: DataFrame, keep: int, same: bool, window: tuple[int, int]) -> DataFrame:
    """The best `keep` candidates of each anchor's slots. anchors: uid, label, v, norm, scores (one slot each), need (the
    norm that a candidate must have), and n, the number of their block."""
    blocks = sorted(r["block"] for r in anchors.select("block").distinct().collect())
    out = None
    for block in blocks:
        # A block is of bounded size; the next is fetched when this one is done with.
        rows = anchors.where(F.col("block") == block).select("uid", "label", "v", "norm", "scores", "need").toArrow()
        limits = [[_limits(s, *window) if not same else (-LONG, LONG) for s in x] for x in rows.column("scores").to_pylist()]
        slots = max(map(len, limits))
        limits = [[*x, *[(1, 0)] * (slots - len(x))] for x in limits]
        sent = {"uid": rows.column("uid").to_numpy(), "label": rows.column("label").to_numpy(), "v": _vectors(rows.column("v").combine_chunks()), "norm": rows.column("norm").to_numpy(), "low": np.array([[p[0] for p in x] for x in limits], np.int64), "high": np.array([[p[1] for p in x] for x in limits], np.int64)}
        near = candidates.where(F.col("norm") >= F.lit(min(rows.column("need").to_pylist())))
        found = C.settle(_scan(near, sent, keep, same), "found")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return candidates.sparkSession.createDataFrame([], _FOUND)
    best = F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, keep)
    return out.groupBy("uid", "slot").agg(best.alias("found"))


def _scan(candidates: DataFrame, sent: dict, keep: int, same: bool) -> DataFrame:
    held = candidates.sparkSession.sparkContext.broadcast(sent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _Search(held.value, keep, same)
        for batch in batches:
            for i in range(0, batch.num_rows, BUCKET):
                part = batch.slice(i, BUCKET)
                search.bucket(part.column("uid").to_numpy(), part.column("id").to_pylist(), part.column("label").to_numpy(), _vectors(part.column("v")), part.column("norm").to_numpy())
        yield search.rows()

    return candidates.select("uid", "id", "label", "v", "norm").mapInArrow(run, _FOUND)


def _blocked(anchors: DataFrame, order: list[str], per_block: int) -> DataFrame:
    return C.settle(ranks.ranked(anchors, [], order).withColumn("block", F.floor(F.col("place") / per_block)).drop("place", "n"), "anchors")


def mined(candidates: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, from what `prepared` gives.

    Anchors are the rows whose id is divisible by `every`; their positives the first other rows of their label, by falling
    score, ties by id (rows without id last). Negatives of a pair are the first rows of other labels whose score is
    between the window's percentages of the positive's, both included. Exact: no row is left out but by the bound on
    norms. Vectors of different lengths count as filled up with 0; repeated rows count each; a score beyond a long
    counts as the end of a long. No anchors, or no rows at all, give an empty result.
    """
    anchors = candidates.where(F.col("id") % every == 0)
    most = anchors.agg(F.max(F.size("v"))).first()[0] or 1
    per_block = max(1, BLOCK // most)
    first = _blocked(anchors.withColumn("scores", F.array(F.lit(None).cast("long"))).withColumn("need", F.lit(0.0)), ["label", "uid"], per_block)
    near = _searched(candidates, first, positives, True, window).select("uid", F.col("found").alias("near"))
    near = C.settle(near, "positives")
    scores = F.transform("near", lambda x: -x["down"])
    # The norm without which a candidate reaches no window of the anchor.
    need = F.when(F.col("norm") > 0, F.array_min("scores") * (window[0] / 100) / F.col("norm") / SLACK).otherwise(0.0)
    second = anchors.join(near, "uid").withColumn("scores", scores).withColumn("need", F.greatest(F.lit(0.0), need))
    second = _blocked(second.drop("near"), ["need", "uid"], per_block)
    found = _searched(candidates, second, negatives, False, window)
    pairs = found.join(near.join(anchors.select("uid", "id"), "uid"), "uid").withColumn("positive", F.get("near", F.col("slot")))
    out = pairs.select(F.col("id").alias("anchor_id"), F.col("positive.id").alias("positive_id"), (-F.col("positive.down")).alias("positive_score"), F.posexplode("found").alias("_at", "_x"))
    return out.select("anchor_id", "positive_id", (F.col("_at") + 1).cast("int").alias("rank"), F.col("_x.id").alias("negative_id"), "positive_score", (-F.col("_x.down")).alias("negative_score"))


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """The hard negatives of all anchors among all embeddings."""
    return mined(prepared(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT p.anchor_id, positive_id, positive_score, s.other AS negative_id, s.score AS negative_score,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.other) AS INTEGER) AS rank
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 100 * s.score BETWEEN 30 * positive_score AND 90 * positive_score
QUALIFY rank <= 10
"""
