"""A Merkle manifest of a dataset, and the authentication path of every row by fractal traversal.

The leaves of a group, in order, are cut into aligned blocks of fan ** levels. A task walks one block at a time and gives
out its leaves' paths in order. For each level it keeps the existing run, which holds the current leaf's ancestor, and
the desired run after it, which takes one leaf more at each step and is complete when the walk gets there. So a task
holds one block and two runs a level, whatever the size of the group. Block roots are the leaves of the layer above; the
paths of that layer are appended to those of its blocks, which they reach as one row at the head of the block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common as C
from tidemark.llm import ranks

#: Children of a node, and levels of a block.
FAN, LEVELS = 16, 3
#: A path: the siblings to the left and to the right, joined, level by level.
PATH = "array<struct<left:string,right:string>>"
_ARROW_PATH = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*fields: Column) -> Column:
    """The digest of fields, each `-` if null, else its UTF-8 byte count, a colon and its value."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256)


def folded(node: Column, path: Column) -> Column:
    """The root that a path leads to from a leaf."""
    return F.aggregate(path, node, lambda now, x: F.sha2(F.concat(x["left"], now, x["right"]), 256))


def siblings(path: Column) -> Column:
    """All siblings of a path joined, level by level, left to right."""
    return F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), "")


class Run:
    """The nodes of one run at `level`, made from the leaves below it as they come."""

    def __init__(self, level: int, fan: int):
        self.fan, self.open = fan, [[] for _ in range(level + 1)]

    def add(self, node: str) -> None:
        self.open[0].append(node)
        for at in range(len(self.open) - 1):
            if len(self.open[at]) < self.fan:
                return
            self._close(at)

    def _close(self, at: int) -> None:
        self.open[at + 1].append(digest("".join(self.open[at])))
        self.open[at] = []

    def nodes(self) -> list[str]:
        """The run, what is begun below it closed."""
        for at in range(len(self.open) - 1):
            if self.open[at]:
                self._close(at)
        return self.open[-1]


def height(n: int, fan: int) -> int:
    """Levels above n leaves; none above a lone one."""
    out = 0
    while n > 1:
        n, out = -(-n // fan), out + 1
    return out


def root(leaves: Sequence[str], up: int, fan: int = FAN) -> str:
    """The node `up` levels above the leaves."""
    top = Run(up, fan)
    for x in leaves:
        top.add(x)
    return top.nodes()[0]


def traversed(leaves: Sequence[str], up: int, fan: int = FAN) -> Iterator[tuple[list[str], list[str]]]:
    """For each leaf in order the siblings to its left and right, joined, at each of `up` levels."""
    span = [fan ** (at + 1) for at in range(up)]
    existing, desired = [], [Run(at, fan) for at in range(up)]
    for at in range(up):
        first = Run(at, fan)
        for x in leaves[: span[at]]:
            first.add(x)
        existing.append(first.nodes())
    left, right = [""] * up, [""] * up
    for i in range(len(leaves)):
        for at in range(up):
            if at and i % span[at - 1]:
                break
            # The walk has reached another node of this level.
            k = i // (span[at - 1] if at else 1) % fan
            left[at], right[at] = "".join(existing[at][:k]), "".join(existing[at][k + 1 :])
        yield left, right
        for at in range(up):
            if i + span[at] < len(leaves):
                desired[at].add(leaves[i + span[at]])
            if (i + 1) % span[at] == 0:
                existing[at], desired[at] = desired[at].nodes(), Run(at, fan)


def _blocks(batches: Iterator[pa.RecordBatch], names: Sequence[str]) -> Iterator[tuple[tuple, list[list]]]:
    """Blocks, one after another, of batches sorted by (g, block): the key, and a list for each of the named columns."""
    now, held = None, []
    for batch in batches:
        keys = list(zip(batch.column("g").to_pylist(), batch.column("block").to_pylist()))
        columns = [batch.column(c).to_pylist() for c in names]
        for key, at in groupby(range(len(keys)), keys.__getitem__):
            at = list(at)
            if key != now and held:
                yield now, held
                held = []
            now = key
            parts = [c[at[0] : at[-1] + 1] for c in columns]
            held = [a + b for a, b in zip(held, parts)] if held else parts
    if held:
        yield now, held


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("g", "block").sortWithinPartitions("g", "block", "place")


def _block_roots(nodes: DataFrame, fan: int, levels: int) -> DataFrame:
    """The layer above: g, place, n, node of the roots of blocks."""
    size, kind = fan**levels, nodes.schema["g"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (g, block), (ns, leaves) in _blocks(batches, ["n", "node"]):
            up = height(ns[0], fan) if ns[0] <= size else levels
            yield pa.RecordBatch.from_arrays([pa.array([g], pa_kind), pa.array([block], pa.int64()), pa.array([-(-ns[0] // size)], pa.int64()), pa.array([root(leaves, up, fan)])], names=["g", "place", "n", "node"])

    pa_kind = _arrow(nodes, "g")
    rows = nodes.select("g", "place", "n", "node", F.floor(F.col("place") / size).alias("block"))
    return _dealt(rows).mapInArrow(run, f"g {kind}, place long, n long, node string")


def _arrow(df: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[name].dataType)


def _with_paths(nodes: DataFrame, heads: DataFrame, fan: int, levels: int) -> DataFrame:
    """Nodes (g, place, n, node and more) with path and top; heads: g, place (of the block), path and top of its root."""
    size = fan**levels
    own = [c for c in nodes.columns if c != "n"]
    more = [c for c in own if c not in ("g", "place", "node")]
    rows = nodes.withColumn("block", F.floor(F.col("place") / size))
    head = heads.select("g", F.col("place").alias("block"), F.lit(-1).cast("long").alias("place"), "path", "top")
    types = {c: _arrow(nodes, c) for c in own}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (g, _), (ns, leaves, places, paths, tops, *rest) in _blocks(batches, ["n", "node", "place", "path", "top", *more]):
            # The head comes first.
            above, top, count = paths[0], tops[0], len(leaves) - 1
            up = height(ns[1], fan) if ns[1] <= size else levels
            lefts, rights = [], []
            high_left, high_right = [x["left"] for x in above], [x["right"] for x in above]
            for left, right in traversed(leaves[1:], up, fan):
                lefts += left
                lefts += high_left
                rights += right
                rights += high_right
            depth = up + len(above)
            ends = pa.array(range(0, depth * count + 1, depth) if depth else [0] * (count + 1), pa.int32())
            found = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(lefts, pa.string()), pa.array(rights, pa.string())], names=["left", "right"])).cast(_ARROW_PATH)
            values = {"g": [g] * count, "node": leaves[1:], "place": places[1:]} | {c: x[1:] for c, x in zip(more, rest)}
            yield pa.RecordBatch.from_arrays([*(pa.array(values[c], types[c]) for c in own), found, pa.array([top] * count, pa.string())], names=[*own, "path", "top"])

    schema = ", ".join([*(f"`{c}` {nodes.schema[c].dataType.simpleString()}" for c in own), f"path {PATH}", "top string"])
    return _dealt(rows.unionByName(head, allowMissingColumns=True)).mapInArrow(run, schema)


class _Tree:
    """The trees over nodes (g, place, n, node and more), one for each g: their layers, and tops (g, node)."""

    def __init__(self, nodes: DataFrame, fan: int, levels: int):
        self.fan, self.levels, self.layers = fan, levels, [nodes]
        most = nodes.agg(F.max("n")).first()[0] or 0
        while most > fan**levels:
            self.layers.append(C.settle(_block_roots(self.layers[-1], fan, levels), "merkle-layer"))
            most = -(-most // fan**levels)
        self.tops = C.settle(_block_roots(self.layers[-1], fan, levels).select("g", "node"), "merkle-tops")

    def paths(self, heads: DataFrame) -> DataFrame:
        """Nodes with path and top; heads: g, path and top of each tree's own root."""
        heads = heads.withColumn("place", F.lit(0).cast("long"))
        for layer in self.layers[:0:-1]:
            heads = C.settle(_with_paths(layer, heads, self.fan, self.levels), "merkle-paths").select("g", "place", "path", "top")
        return _with_paths(self.layers[0], heads, self.fan, self.levels)


def manifest(docs: DataFrame, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "source", order: str = "doc_id", more: dict[str, Column] | None = None, fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """One row for each row of docs: `order`, `group`, place (from 0, in the group), leaf, path, subroot, root, and the
    columns of `more`, worked out beside the leaf. `folded(leaf, path)` is the root.

    A leaf is the digest of the fields. Within a group leaves rise by `order`, nulls first, ties by leaf; while there are
    several nodes, each run of `fan` (the last may be shorter, down to one) becomes its digest. What remains is the
    subroot, a lone leaf itself. Subroots, ordered by group (null first, by bytes), make the tree above in the same way,
    up to the root. A null group is a group. Repeated rows are leaves each. Texts are hashed where they are read; only
    digests are shuffled. An empty table gives an empty result. Other columns, whatever their names, are ignored.
    """
    more = more or {}
    rows = docs.select(F.col(group).alias("g"), F.col(order).alias("o"), leaf(*[F.col(c) for c in fields]).alias("node"), *[c.alias(f"m{i}") for i, c in enumerate(more.values())])
    # Written before it is dealt by ranges, which reads its rows twice: texts are read and hashed once.
    placed = ranks.ranked(C.settle(rows, "merkle-leaves"), ["g"], ["o", "node"])
    inner = _Tree(placed, fan, levels)
    tops = ranks.ranked(inner.tops.select(F.lit(0).alias("g"), F.col("g").alias("source"), "node"), ["g"], ["source"])
    outer = _Tree(tops, fan, levels)
    top = outer.tops.first()
    whole = top["node"] if top else None
    above = C.settle(outer.paths(outer.tops.select("g", F.array().cast(PATH).alias("path"), F.col("node").alias("top"))), "merkle-sources")
    found = inner.paths(above.select(F.col("source").alias("g"), "path", F.col("node").alias("top")))
    return found.select(F.col("o").alias(order), F.col("g").alias(group), "place", F.col("node").alias("leaf"), "path", F.col("top").alias("subroot"), F.lit(whole).cast("string").alias("root"), *[F.col(f"m{i}").alias(c) for i, c in enumerate(more)])


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """Digest of the manifest of all documents, a fifth of which are tampered with after it was made."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    hit = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    found = manifest(docs, more={"now": F.when(hit, leaf(*fields, C.ascii_lower(F.col("text"))))})
    out = found.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), folded(F.coalesce("now", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql_field(x: str) -> str:
    return f"coalesce(strlen({x}::varchar) || ':' || {x}::varchar, '-')"


def _sql_levels(name: str, of: str, count: int) -> str:
    """CTEs of the levels above `of` (g, i, node, n), each with the siblings of its nodes, joined."""
    out, at = [], of
    for k in range(count):
        run = "partition by g, i // 16 order by i rows between"
        out.append(f"{name}{k} as (select *, coalesce(string_agg(node, '') over ({run} unbounded preceding and 1 preceding), '') as l, coalesce(string_agg(node, '') over ({run} 1 following and unbounded following), '') as r from {at})")
        at = f"{name}{k}_up"
        out.append(f"{at} as (select g, i // 16 as i, case when n > 1 then sha256(string_agg(node, '' order by i)) else any_value(node) end as node, (n + 15) // 16 as n from {name}{k} group by g, n, i // 16)")
    return ", ".join(out)


def _op11_sql(inner: int = 6, outer: int = 4) -> str:
    """Up to 16 ** inner documents of a source and 16 ** outer sources."""
    fields = [_sql_field(c) for c in ("doc_id", "source", "lang", "n_chars")]
    lower = f"translate(text, '{C.ASCII_UPPER}', '{C.ASCII_UPPER.lower()}')"
    byte = "case when b % 8 = 0 then xor(a, ascii(substr(doc_id::varchar, (b // 8 + 1)::int, 1))::bigint) else a end"
    crc = f"xor(list_reduce(range(0, 8 * length(doc_id::varchar)), lambda a, b: xor(({byte}) >> 1, case when ({byte}) & 1 = 1 then 3988292384 else 0 end), 4294967295), 4294967295)"
    joins, left, fold = [], [], "coalesce(changed, leaf)"
    for name, count, key, at in (("s", inner, "d.source", "d.i"), ("t", outer, "0", "o.i")):
        for k in range(count):
            x = f"{name}{k}"
            if name == "t" and not k:
                joins.append("join tops o on o.source is not distinct from d.source")
            joins.append(f"join {x} on {x}.g is not distinct from {key} and {x}.i = {at} // {16**k}")
            left.append(f"case when {x}.n > 1 then {x}.l || {x}.r else '' end")
    chain, at = [], "proved"
    for name, count in (("s", inner), ("t", outer)):
        for k in range(count):
            x = f"{name}{k}"
            chain.append(f"fold_{x} as (select * replace (case when {x}_n > 1 then sha256({x}_l || now || {x}_r) else now end as now) from {at})")
            at = f"fold_{x}"
    kept = ", ".join(f"{x}.n as {x}_n, {x}.l as {x}_l, {x}.r as {x}_r" for name, count in (("s", inner), ("t", outer)) for x in (f"{name}{k}" for k in range(count)))
    return f"""with hashed as (
  select doc_id, source, sha256({' || '.join([*fields, _sql_field('text')])}) as leaf, case when {crc} % 5 = 0 then sha256({' || '.join([*fields, _sql_field(lower)])}) end as changed from documents
), d as (
  select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by source) as n from hashed
), leaves as (select source as g, i, leaf as node, n from d), {_sql_levels('s', 'leaves', inner)},
tops as (select g as source, node, row_number() over (order by g nulls first) - 1 as i, count(*) over () as n from s{inner - 1}_up),
heads as (select 0 as g, i, node, n from tops), {_sql_levels('t', 'heads', outer)},
proved as (
  select d.doc_id, leaf, o.node as subroot, (select node from t{outer - 1}_up) as root, sha256({' || '.join(left)}) as proof_sha256, {fold} as now, {kept} from d {' '.join(joins)}
), {', '.join(chain)}
select doc_id, leaf, subroot, root, proof_sha256, now as folded_root, now = root as verified from {at}"""


OP11_SQL = _op11_sql()
