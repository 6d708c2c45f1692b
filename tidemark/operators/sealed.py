"""Checkpoints by a list of their own last positions, however far apart, and Merkle trees that are stored.

Rows find their checkpoint by a forward as-of match (`chain.bounds`), never by dividing by an interval, so checkpoints that
were sealed early, late or before the chain grew stay what they are. A tree is stored as rows of up to 2 ** STEP
neighbouring nodes, one layer for every STEP levels; a segment of any length is many such rows, and a path is put
together from the top, each layer's rows joined to their own heads. So neither an array nor a key grows with a segment.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.functions import text as X
from tidemark.operators import chain as CH
from tidemark.operators import checkpoints as K
from tidemark.operators import ordered as O
from tidemark.sources import shared

#: Levels of a stored row, and rows of a chain that one window numbers.
STEP, BUCKET = 8, 1 << 16
KEYS = ("employee_id",)


def _same(a: str, b: str, columns: Sequence[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def joined(a: DataFrame, b: DataFrame, columns: Sequence[str], how: str = "inner") -> DataFrame:
    """a with the other columns of b, null keys being keys like any other."""
    more = [f"b.{c}" for c in b.columns if c not in columns] if how != "left_semi" else []
    return a.alias("a").join(b.alias("b"), _same("a", "b", columns), how).select("a.*", *more)


def _short(text: Column) -> Column:
    """A hash in hex as 32 bytes; any other text behind 33 bytes, so that it comes back as it was."""
    return F.when(text.rlike("^[0-9a-f]{64}\\z"), F.unhex(text)).otherwise(F.concat(F.lit(bytes(33)), text.cast("binary")))


def _long(data: Column) -> Column:
    return F.when(F.octet_length(data) == 32, F.lower(F.hex(data))).otherwise(F.substring(data, 34, 1 << 30).cast("string"))


def hashed(chain: DataFrame, keys: Sequence[str] = KEYS, position: str = "chain_seq", more: Sequence[str] = ()) -> DataFrame:
    """keys, position, `more` and hash (the leaf, 32 bytes) of a chain's rows; entry_hash as bytes, too."""
    # Rows are hashed where they are made: no payload goes through the exchanges that follow, and a hash as 32 bytes.
    return chain.select(*keys, position, *[_short(F.col(c)).alias(c) if c == "entry_hash" else c for c in more], F.unhex(K.leaf(X.serialised())).alias("hash"))


def leaves(chain: DataFrame, marks: DataFrame, keys: Sequence[str] = KEYS, position: str = "chain_seq", entries: bool = True) -> DataFrame:
    """The sealed rows of a chain, stored: keys, sealed_after, sealed_at, place (from 0, in the segment), n (rows of the
    segment), the position, entry_hash (only with `entries`) and hash (the leaf). marks: keys, last_seq of checkpoints."""
    # Stored, as the steps that follow read their input several times, and would build the chain anew for each.
    own = ["entry_hash"] if entries else []
    slim, marks = shared.stored(hashed(chain, keys, position, own), "hashed"), shared.stored(marks.select(*keys, "last_seq"), "marks")
    held = _placed(slim, marks, keys, position, own)
    return held.withColumns({"hash": F.lower(F.hex("hash")), **{c: _long(F.col(c)) for c in own}})


def _placed(slim: DataFrame, marks: DataFrame, keys: Sequence[str], position: str, more: Sequence[str]) -> DataFrame:
    """`leaves` of rows that are hashed and stored, with their columns `more`; hashes are bytes.

    Rows are numbered where `bounds` has dealt them. Only segments that reach over the end of a bucket need what lies in the
    others, two of a bucket at most, so that the rows are not exchanged again for it."""
    near = CH.bounds_by_bucket(slim, marks, keys, position, BUCKET).where("sealed_at IS NOT NULL")
    run = W.partitionBy(*keys, "_bucket", "sealed_at")
    near = near.withColumns({"_place": F.row_number().over(run.orderBy(position)) - 1, "_many": F.count(F.lit(1)).over(run)})
    near = shared.stored(near.select(*keys, "sealed_after", "sealed_at", position, *more, "hash", "_bucket", "_place", "_many"), "bounded")
    # A first segment may begin anywhere.
    far = near.where((F.col("sealed_after") <= 0) | (F.floor((F.col("sealed_after") + 1) / BUCKET) < F.floor(F.col("sealed_at") / BUCKET)))
    far = far.groupBy(*keys, "sealed_at", "_bucket").agg(F.first("_many").alias("_many"))
    whole = W.partitionBy(*keys, "sealed_at")
    before = F.coalesce(F.sum("_many").over(whole.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    far = far.select(*keys, "sealed_at", "_bucket", "_many", before.alias("_before"), F.sum("_many").over(whole).alias("_all")).where("_all > _many").drop("_many")
    far = shared.stored(far, "reaching")
    shared.free_shuffles(slim.sparkSession)
    out = joined(near, far, [*keys, "sealed_at", "_bucket"], "left")
    return out.select(*keys, "sealed_after", "sealed_at", position, *more, "hash", (F.col("_place") + F.coalesce("_before", F.lit(0))).cast("long").alias("place"), F.coalesce("_all", "_many").alias("n"))


class Tree:
    """The stored trees over `leaves`, one for each segment. layers[i]: keys, sealed_at, block, hashes of up to 2 ** STEP
    neighbouring nodes of level i * STEP; the lowest also has what `beside` names of each leaf, so that paths need not be
    joined to their rows."""

    def __init__(self, rows: DataFrame, keys: Sequence[str] = KEYS, step: int = STEP, beside: Sequence[str] = ()):
        self.keys, self.step, self.layers, self.beside = [*keys, "sealed_at"], step, [], list(beside)
        most = rows.agg(F.max("n")).first()[0] or 0
        level = rows.select(*self.keys, "place", F.unhex("hash").alias("hash"), *self.beside)
        while True:
            more = [] if self.layers else self.beside
            packed = F.array_sort(F.collect_list(F.struct("place", "hash", *more)))
            blocks = level.groupBy(*self.keys, F.shiftright("place", step).alias("block")).agg(packed.alias("_p"))
            held = shared.stored(blocks.select(*self.keys, "block", F.col("_p.hash").alias("hashes"), *[F.col(f"_p.{c}").alias(f"_all_{c}") for c in more]), "tree")
            self.layers.append(held.withColumn("hashes", F.transform("hashes", lambda h: F.lower(F.hex(h)))))
            if most <= 1 << step:
                return
            most = -(-most >> step)
            level = self.layers[-1].select(*self.keys, F.col("block").alias("place"), F.unhex(F.get(F.get(self._levels(step), F.lit(step)), F.lit(0))).alias("hash"))

    @staticmethod
    def _levels(count: int) -> Column:
        """The nodes of a row and `count` levels above them, as an array of levels."""
        more = lambda found, _: F.concat(found, F.array(K._up(F.element_at(found, -1))))
        return F.aggregate(F.sequence(F.lit(1), F.lit(count)), F.array("hashes"), more) if count else F.array("hashes")

    def roots(self) -> DataFrame:
        """keys, sealed_at, merkle_root."""
        return self.layers[-1].select(*self.keys, F.get(F.get(self._levels(self.step), F.lit(self.step)), F.lit(0)).alias("merkle_root"))

    def nodes(self) -> DataFrame:
        """keys, sealed_at, level, place, hash of all nodes; an odd last one is found again on the level above, up to the
        root."""
        out = None
        for i, layer in enumerate(self.layers):
            # The top level of a row is the lowest of the layer above, and the last layer's root.
            top = self.step - (i + 1 < len(self.layers))
            each = layer.select(*self.keys, "block", F.posexplode(self._levels(top)).alias("_d", "_nodes"))
            here = each.select(*self.keys, "_d", "block", F.posexplode("_nodes").alias("_at", "hash"))
            here = here.select(*self.keys, (F.lit(i * self.step) + F.col("_d")).alias("level"), (F.expr(f"shiftleft(block, {self.step} - _d)") + F.col("_at")).alias("place"), "hash")
            out = here if out is None else out.unionByName(here)
        # Above the root a lone node would go on for ever: it ends where the one before it was alone, too.
        height = self.layers[0].groupBy(*self.keys).agg(F.sum(F.size("hashes")).alias("_n"))
        top = F.when(F.col("_n") > 1, F.length(F.bin(F.col("_n") - 1))).otherwise(0)
        return joined(out, height.select(*self.keys, top.alias("_top")), self.keys).where("level <= _top").drop("_top")

    def paths(self, asked: DataFrame | None = None, root: bool = False, wanted: str | None = None, held: DataFrame | None = None) -> DataFrame:
        """keys, sealed_at, place, hash, path (left:hash or right:hash by level, none where a node is promoted), what the tree
        has beside, and with `root` merkle_root, of every leaf, or of those asked for (keys, sealed_at, place). Only rows of
        the tree on the way to an asked leaf are opened. wanted: a flag beside each leaf, which asks without a join. held: more
        columns of a segment (keys, sealed_at), joined before its paths are made."""
        top = [*(["merkle_root"] if root else []), *([c for c in held.columns if c not in self.keys] if held is not None else [])]
        heads = None
        for i in reversed(range(len(self.layers))):
            blocks = self.layers[i]
            if asked is not None:
                on_way = asked.select(*self.keys, F.shiftright("place", self.step * (i + 1)).alias("block")).distinct()
                blocks = joined(blocks, on_way, [*self.keys, "block"], "left_semi")
            if wanted and not i:
                blocks = blocks.where(F.exists(f"_all_{wanted}", lambda x: x))
            if held is not None and heads is None:
                blocks = joined(blocks, held, self.keys, "left")
            up = blocks.withColumn("_levels", self._levels(self.step - 1))
            if heads is not None:
                up = joined(up, heads, [*self.keys, "block"])
            else:
                up = up.withColumn("_above", F.array().cast("array<string>"))
                up = up.withColumn("merkle_root", F.get(F.get(self._levels(self.step), F.lit(self.step)), F.lit(0))) if root else up
            rows = up.select("*", F.posexplode("hashes").alias("_at", "hash"))
            path = F.concat(F.array_compact(F.array(*[self._sibling(d) for d in range(self.step)])), F.col("_above"))
            rows = rows.where(F.get(f"_all_{wanted}", F.col("_at"))) if wanted and not i else rows
            rows = rows.select(*self.keys, (F.shiftleft("block", self.step) + F.col("_at")).alias("place"), "hash", path.alias("path"), *top, *([] if i else [F.get(f"_all_{c}", F.col("_at")).alias(c) for c in self.beside]))
            heads = rows.select(*self.keys, F.col("place").alias("block"), F.col("path").alias("_above"), *top)
        return rows if asked is None else joined(rows, asked.select(*self.keys, "place").distinct(), [*self.keys, "place"], "left_semi")

    @staticmethod
    def _sibling(d: int) -> Column:
        at = F.shiftright("_at", d)
        other = F.get(F.get("_levels", F.lit(d)), F.when(at % 2 == 0, at + 1).otherwise(at - 1))
        return F.when(other.isNotNull(), F.concat(F.when(at % 2 == 0, "right:").otherwise("left:"), other))


def digests(rows: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, sealed_at, digest: SHA-256 of a segment's hashes joined, read as a stream of rows in order."""

    def step(state, row: tuple) -> tuple:
        state.update(row[0].encode())
        return state, (state.hexdigest() if row[1] else None,)

    last = rows.select(*keys, "sealed_at", "place", "entry_hash", (F.col("place") == F.col("n") - 1).alias("_last"))
    out = O.in_order(last, [*keys, "sealed_at"], ["place"], ["entry_hash", "_last"], "digest string", hashlib.sha256, step)
    return out.where("_last").select(*keys, "sealed_at", "digest")


def checkpoints(rows: DataFrame, tree: Tree, keys: Sequence[str] = KEYS, position: str = "chain_seq") -> DataFrame:
    """keys, sealed_after, first_seq, last_seq, n_rows, digest and merkle_root of each segment, by its `leaves` and tree.
    last_seq is the position of its last row, which may lie before the one that the list names (sealed_at)."""
    ends = rows.groupBy(*keys, "sealed_at").agg(F.min("sealed_after").alias("sealed_after"), F.min(position).alias("first_seq"), F.max(position).alias("last_seq"), F.count(F.lit(1)).alias("n_rows"))
    return joined(joined(ends, digests(rows, keys), [*keys, "sealed_at"]), tree.roots(), [*keys, "sealed_at"])


def made(chain: DataFrame, marks: DataFrame, keys: Sequence[str] = KEYS, position: str = "chain_seq") -> DataFrame:
    """The checkpoints of a chain at the positions of marks (keys, last_seq)."""
    rows = leaves(chain, marks, keys, position)
    return checkpoints(rows, Tree(rows, keys), keys, position)


def binding(chain: DataFrame, sealed: DataFrame, keys: Sequence[str] = KEYS, position: str = "chain_seq") -> DataFrame:
    """Every checkpoint of the list (keys, last_seq, n_rows, digest, merkle_root) held against the rows after the one before
    it: keys, last_seq, binding.

    fail: a position that is not above 0 or that the list has twice; rows that are gone, or the last of them; another digest,
    count or root. Else unknown where the list has no root or count, and pass."""
    sealed = shared.stored(sealed.select(*keys, "last_seq", "n_rows", "digest", "merkle_root"), "list")
    now = made(chain, sealed.where("last_seq > 0"), keys, position).select(*keys, F.col("sealed_at").alias("last_seq"), F.col("last_seq").alias("_last"), F.col("n_rows").alias("_n"), F.col("digest").alias("_digest"), F.col("merkle_root").alias("_root"))
    times = sealed.groupBy(*keys, "last_seq").agg(F.count(F.lit(1)).alias("_times"))
    both = joined(joined(sealed.select(*keys, F.col("last_seq").cast("long").alias("last_seq"), "n_rows", "digest", "merkle_root"), times, [*keys, "last_seq"]), now, [*keys, "last_seq"], "left")
    bad = (F.col("_times") > 1) | F.col("_last").isNull() | (F.col("_last") != F.col("last_seq")) | ~F.col("_digest").eqNullSafe(F.col("digest"))
    legacy = F.col("merkle_root").isNull() | F.col("n_rows").isNull()
    other = (F.col("_n") != F.col("n_rows")) | (F.col("_root") != F.col("merkle_root"))
    status = F.when(bad, "fail").when(legacy, "unknown").when(other, "fail").otherwise("pass")
    return both.select(*keys, "last_seq", status.alias("binding"))


def bound(chain: DataFrame, sealed: DataFrame, keys: Sequence[str] = KEYS, position: str = "chain_seq") -> DataFrame:
    """The keys, status and first_fail (a position) of each chain as a whole: unknown without any checkpoint."""
    each = binding(chain, sealed, keys, position)
    kinds = each.groupBy(*keys).agg(F.min(F.when(F.col("binding") == "fail", F.col("last_seq"))).alias("first_fail"), F.count_if(F.col("binding") == "unknown").alias("_unknown"))
    whole = joined(chain.select(*keys).distinct() if keys else chain.agg(F.lit(1).alias("_one")), kinds, keys, "left")
    status = F.when(F.col("first_fail").isNotNull(), "fail").when(F.coalesce(F.col("_unknown"), F.lit(1)) > 0, "unknown").otherwise("pass")
    return whole.select(*keys, status.alias("status"), "first_fail")


def enclosing(rows: DataFrame, sealed: DataFrame, keys: Sequence[str] = KEYS, position: str = "chain_seq") -> DataFrame:
    """For each row the lowest checkpoint at or after it and the one before that (0 for none); null in the unsealed tail."""
    found = CH.bounds(rows.select(*keys, position), sealed, keys, position)
    return found.select(*keys, position, "sealed_at", F.when(F.col("sealed_at").isNotNull(), F.col("sealed_after")).alias("sealed_after"))


def proofs(chain: DataFrame, sealed: DataFrame, keys: Sequence[str] = KEYS, position: str = "chain_seq", asked: DataFrame | None = None) -> DataFrame:
    """keys, position, sealed_at, place, n, leaf, path and merkle_root of every sealed row, or of those asked for (keys,
    position)."""
    flags = None if asked is None else asked.select(*keys, position).distinct()
    found = proofs_of(hashed(chain, keys, position), sealed, keys, position, ["n"], flags)
    return found.select(*keys, position, "sealed_at", "place", "n", F.col("hash").alias("leaf"), "path", "merkle_root")


def proofs_of(slim: DataFrame, marks: DataFrame, keys: Sequence[str] = KEYS, position: str = "chain_seq", beside: Sequence[str] = (), asked: DataFrame | None = None, held: DataFrame | None = None, tails: bool = False) -> DataFrame:
    """keys, position, sealed_at, place, hash (the leaf), path, merkle_root and what `beside` names of rows that are `hashed`.

    asked: rows without nulls whose columns, all of them columns of slim, say which rows are wanted; they are marked before
    they are stored, so that no path is joined. held: keys, sealed_at and what comes along of a segment. tails: rows behind
    the last of the marks have a tree among themselves."""
    wanted, more = None, [c for c in slim.columns if c not in (*keys, position, "hash")]
    if asked is not None:
        wanted, by = "_asked", asked.columns
        slim = joined(slim, asked.withColumn(wanted, F.lit(True)), by, "left").withColumn(wanted, F.coalesce(wanted, F.lit(False)))
        more.append(wanted)
    slim = shared.stored(slim, "hashed")
    marks = marks.select(*keys, "last_seq")
    if tails:
        marks = marks.unionByName(slim.groupBy(*keys).agg(F.max(position).alias("last_seq")))
    marks = shared.stored(marks, "marks")
    rows = _placed(slim, marks, keys, position, more).withColumn("hash", F.lower(F.hex("hash")))
    tree = Tree(rows, keys, beside=[position, *dict.fromkeys([*more, *beside])])
    return tree.paths(root=True, wanted=wanted, held=held)


def sides(place: Column, n: Column) -> Column:
    """The sides, left and right, that the path of a leaf has in a tree of n leaves."""

    def side(d: Column) -> Column:
        at, size = F.floor(place / F.pow(F.lit(2.0), d)), F.ceil(n / F.pow(F.lit(2.0), d))
        return F.when(size <= 1, None).when(at % 2 == 1, "left").when(at + 1 < size, "right")

    return F.array_compact(F.transform(F.sequence(F.lit(0), F.lit(40)), side))


def placed(path: Column, place: Column, n: Column) -> Column:
    """Whether a path can be that of this place in a tree of so many leaves."""
    fits = F.transform(path, lambda x: F.substring_index(x, ":", 1)) == sides(place, n)
    return F.coalesce((place >= 0) & (place < n) & fits, F.lit(False))
