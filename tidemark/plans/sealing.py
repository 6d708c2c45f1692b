"""Checkpoints at uneven places of a chain, and trees over segments of any length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import sealed as SE
from tidemark.plans.catalogue import _SERIAL, BAD, CHAIN, _bad_chain, _chain, query
from tidemark.sources import derived as D
from tidemark.sources import shared

#: Rows that a checkpoint was sealed after, by employee and in the whole ledger.
MARKED = "sequence_id % 5 = 0"
LONG = "sequence_id in (218, 268) or sequence_id % 3001 = 400"


def _levels(name: str, rows: str, count: int) -> str:
    """CTEs name_0, ... of the levels above rows (g, seg, i, h, n), an odd last node promoted."""
    out = [f"{name}_0 as (select g, seg, i, h, n from {rows})"]
    for k in range(count):
        out.append(f"{name}_{k + 1} as (select g, seg, i // 2 as i, case when count(*) = 2 then sha256('\\x01'::blob || unhex(arg_min(h, i)) || unhex(arg_max(h, i))) else any_value(h) end as h, n from {name}_{k} group by g, seg, n, i // 2)")
    return ", ".join(out)


def _paths(name: str, rows: str, count: int) -> str:
    """rows (g, seg, i) with path, from the levels of name."""
    parts = ", ".join(f"case when r.i // {1 << k} % 2 = 0 then 'right:' || l{k}.h else 'left:' || l{k}.h end" for k in range(count))
    joins = " ".join(f"left join {name}_{k} l{k} on l{k}.g = r.g and l{k}.seg = r.seg and l{k}.i = xor(r.i // {1 << k}, 1)" for k in range(count))
    return f"select r.*, concat_ws(',', {parts}) as path from {rows} r {joins}"


def _cut(rows: str, name: str = "cut") -> str:
    return f"""{name} as (select c.*, c.employee_id as g, m.last_seq as seg, coalesce(b.last_seq, 0) as sealed_after, row_number() over (partition by c.employee_id, m.last_seq order by c.chain_seq) - 1 as i, count(*) over (partition by c.employee_id, m.last_seq) as n, sha256('\\x00'::blob || encode({_SERIAL})) as h
  from {rows} c asof join marks m on m.employee_id = c.employee_id and c.chain_seq <= m.last_seq asof left join marks b on b.employee_id = c.employee_id and c.chain_seq > b.last_seq)"""


_MARKS = f", marks as (select employee_id, chain_seq as last_seq from chain where {MARKED})"
_DEPTH = 8


def _marks(chain: DataFrame) -> DataFrame:
    return chain.where(MARKED).select("employee_id", F.col("chain_seq").alias("last_seq"))


def _ends(cut: str, name: str, to: str) -> str:
    return f"{to} as (select c.*, r.h as merkle_root from (select employee_id, seg, min(sealed_after) as sealed_after, min(chain_seq) as first_seq, max(chain_seq) as last_seq, count(*) as n_rows, sha256(string_agg(entry_hash, '' order by chain_seq)) as digest from {cut} group by 1, 2) c join {name}_{_DEPTH} r on r.g = c.employee_id and r.seg = c.seg)"


_UNEVEN = CHAIN + _MARKS + ", " + _cut("chain") + ", " + _levels("t", "cut", _DEPTH) + ", " + _ends("cut", "t", "made")


@query(_UNEVEN + " select employee_id, sealed_after, first_seq, last_seq, n_rows, digest, merkle_root from made")
def uneven_checkpoints(spark, sf_dir):
    """Checkpoints that were sealed at no fixed distance, each over the rows after the one before it."""
    chain = _chain(spark, sf_dir)
    return SE.made(chain, _marks(chain)).drop("sealed_at")


# What the list says is, by its position: whole, without root, with another root, with another digest, or said twice.
_KIND = "(employee_id + last_seq) % 9"
_SAID = f"case when {_KIND} = 2 then null when {_KIND} = 3 then repeat('0', 64) else merkle_root end as merkle_root, case when {_KIND} = 4 then repeat('1', 64) else digest end as digest"


def _list(spark, sf_dir) -> DataFrame:
    chain = _chain(spark, sf_dir)
    said = SE.made(chain, _marks(chain)).selectExpr("employee_id", "last_seq", "n_rows", *[x.strip() for x in _SAID.split(", case")[:1]], "case" + _SAID.split(", case")[1])
    said = shared.stored(said, "said")
    return said.unionByName(said.where(f"{_KIND} = 5"))


_BOUND = BAD + _MARKS + ", " + _cut("chain") + ", " + _levels("t", "cut", _DEPTH) + ", " + _ends("cut", "t", "made") + f""",
once as (select employee_id, last_seq, n_rows, {_SAID} from made), said as (select * from once union all select * from once where {_KIND} = 5),
""" + _cut("bad", "again") + ", " + _levels("u", "again", _DEPTH) + ", " + _ends("again", "u", "now") + f""",
bindings as (select s.employee_id, s.last_seq, case when {_KIND.replace('employee_id', 's.employee_id').replace('last_seq', 's.last_seq')} = 5 or n.last_seq is null or n.last_seq <> s.last_seq or n.digest <> s.digest then 'fail' when s.merkle_root is null then 'unknown' when n.n_rows <> s.n_rows or n.merkle_root <> s.merkle_root then 'fail' else 'pass' end as binding
  from said s left join now n on n.employee_id = s.employee_id and n.seg = s.last_seq)"""


@query(_BOUND + " select * from bindings")
def uneven_binding(spark, sf_dir):
    """Every checkpoint of an uneven list with faults of its own against the tampered chain."""
    return SE.binding(_bad_chain(spark, sf_dir), _list(spark, sf_dir))


@query(_BOUND + " select e.employee_id, case when first_fail is not null then 'fail' when coalesce(unsure, 1) > 0 then 'unknown' else 'pass' end as status, first_fail from (select distinct employee_id from bad) e left join (select employee_id, min(last_seq) filter (binding = 'fail') as first_fail, count(*) filter (binding = 'unknown') as unsure from bindings group by 1) b using (employee_id)")
def uneven_binding_by_chain(spark, sf_dir):
    """Each chain as a whole: where it first fails, or whether anything is unknown."""
    return SE.bound(_bad_chain(spark, sf_dir), _list(spark, sf_dir))


@query(CHAIN + _MARKS + " select c.employee_id, c.chain_seq, m.last_seq as sealed_at, case when m.last_seq is not null then coalesce(b.last_seq, 0) end as sealed_after from chain c asof left join marks m on m.employee_id = c.employee_id and c.chain_seq <= m.last_seq asof left join marks b on b.employee_id = c.employee_id and c.chain_seq > b.last_seq")
def uneven_enclosing(spark, sf_dir):
    """The checkpoint that holds each row, and the one before it."""
    chain = _chain(spark, sf_dir)
    return SE.enclosing(chain, _marks(chain))


@query(_UNEVEN + f", paths as ({_paths('t', 'cut', _DEPTH)}) select p.employee_id, p.chain_seq, p.seg as sealed_at, p.i as place, p.n, p.h as leaf, p.path, m.merkle_root, true as proved from paths p join made m on m.employee_id = p.employee_id and m.seg = p.seg")
def uneven_proofs(spark, sf_dir):
    """The path of every sealed row to the root of its own checkpoint, followed and held against the row's place."""
    chain = _chain(spark, sf_dir)
    found = SE.proofs(chain, _marks(chain))
    proved = (SE.K.proved_root(F.col("leaf"), F.col("path")) == F.col("merkle_root")) & SE.placed(F.col("path"), F.col("place"), F.col("n"))
    return found.withColumn("proved", proved).withColumn("path", F.concat_ws(",", "path"))


# Segments of thousands of rows: the whole ledger as one chain, by sequence.

_HIGH = 13
_WHOLE = D.with_sql("ledger") + f""", marks as (select sequence_id as last_seq from ledger where {LONG}),
cut as (select c.*, 0 as g, m.last_seq as seg, row_number() over (partition by m.last_seq order by c.sequence_id) - 1 as i, count(*) over (partition by m.last_seq) as n, sha256('\\x00'::blob || encode({_SERIAL})) as h, sha256({_SERIAL} || repeat('0', 64)) as entry_hash
  from ledger c asof join marks m on c.sequence_id <= m.last_seq), """ + _levels("t", "cut", _HIGH)


def _whole(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = D.ledger(spark, sf_dir).withColumn("entry_hash", X.entry_hash(F.lit(X.GENESIS)))
    return rows, rows.where(LONG).select(F.col("sequence_id").alias("last_seq"))


@query(_WHOLE + f" select c.*, r.h as merkle_root from (select seg as sealed_at, min(sequence_id) as first_seq, count(*) as n_rows, sha256(string_agg(entry_hash, '' order by sequence_id)) as digest from cut group by 1) c join t_{_HIGH} r on r.seg = c.sealed_at")
def long_checkpoints(spark, sf_dir):
    """Checkpoints over segments of thousands of rows, two of them uneven."""
    rows, marks = _whole(spark, sf_dir)
    return SE.made(rows, marks, (), "sequence_id").select("sealed_at", "first_seq", "n_rows", "digest", "merkle_root")


@query(_WHOLE + " select * from (" + " union all ".join(f"select seg as sealed_at, {k} as level, i as place, h as hash from t_{k} where {'true' if not k else f'(n - 1) >> {k - 1} > 0'}" for k in range(_HIGH + 1)) + ")")
def long_tree_nodes(spark, sf_dir):
    """All nodes of the stored trees."""
    rows, marks = _whole(spark, sf_dir)
    return SE.Tree(SE.leaves(rows, marks, (), "sequence_id"), ()).nodes()


@query(_WHOLE + f", asked as (select * from cut where action = 'DELETE') select sequence_id, sealed_at, place, path from (select sequence_id, seg as sealed_at, i as place, path from ({_paths('t', 'asked', _HIGH)}))")
def long_proofs_asked(spark, sf_dir):
    """The paths of the deletions alone; of the stored trees only rows on their way are opened."""
    rows, marks = _whole(spark, sf_dir)
    asked = rows.where("action = 'DELETE'").select("sequence_id")
    return SE.proofs(rows, marks, (), "sequence_id", asked).select("sequence_id", "sealed_at", "place", F.concat_ws(",", "path").alias("path"))
