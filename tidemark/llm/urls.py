"""URL verdicts: path rules first, then a cascade of Bloom filters over the listed hosts.

Level 0 encodes the listed keys, level 1 the unlisted keys of the universe that level 0 lets through, level 2 the
listed keys that level 1 lets through, and so on until a level lets nothing wrong through. Over that universe the
first level that rejects a key then tells exactly whether it is listed, without a join against the list.

Everything here is DataFrame expressions. A filter is split into blocks of BLOCK_WORDS longs; a key's bits all lie in
one block. Filters of up to MAX_SCALAR_BLOCKS blocks are one value in the plan (a proven bound); beyond that, the keys
are matched with their blocks by a shuffled join on the block number.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common as C

BLOCK_WORDS = 1024
MAX_SCALAR_BLOCKS = 2048  # 16 MB
BITS_PER_KEY, HASHES = 12, 4
MAX_LEVELS = 64


@dataclass(frozen=True)
class PathRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the digest query.
RULES = (PathRule("block", "net", "/"), PathRule("allow", "example.net", "/en/"), PathRule("block", "example.com", "/de/"), PathRule("allow", "org", "/fr/"))


def host_of(url: Column) -> Column:
    """After the first :// up to /, ? or #, with A-Z lower-cased; empty without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(url, "://", 1))
    after = F.substr(url, F.length(rest) + 4)
    return F.coalesce(C.ascii_lower(F.regexp_extract(after, r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ? or #; empty without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(url, "://", 1))
    after = F.substr(url, F.length(rest) + 4)
    return F.coalesce(F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[PathRule, ...]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


@dataclass
class Level:
    """One filter: its number of blocks and its rows (block, words); `value` is all of them where they are few."""

    number: int
    n_blocks: int
    rows: DataFrame
    value: Column | None


def _block(key: Column, level: int, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(level), F.lit("block"), key), F.lit(n_blocks)).cast("int")


def _bits(key: Column, level: int) -> list[Column]:
    h, step = F.xxhash64(F.lit(level), key), F.xxhash64(F.lit(level), F.lit("step"), key)
    return [F.pmod(F.xxhash64(h, step, F.lit(j)), F.lit(BLOCK_WORDS * 64)).cast("int") for j in range(HASHES)]


def _build(keys: DataFrame, n: int, level: int) -> Level:
    n_blocks = max(1, -(-n * BITS_PER_KEY // (BLOCK_WORDS * 64)))
    bit = keys.select(_block(F.col("key"), level, n_blocks).alias("block"), F.explode(F.array(*_bits(F.col("key"), level))).alias("bit"))
    word = bit.groupBy("block", F.floor(F.col("bit") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, bit % 64)")).alias("bits"))
    # Blocks as dense arrays: the words that are set, by place, and zeros between.
    found = word.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("set"))
    dense = found.select("block", F.expr(f"transform(sequence(0, {BLOCK_WORDS - 1}), i -> coalesce(element_at(set, i), 0L))").alias("words"))
    rows = C.settle(dense, f"bloom-{level}")
    value = None
    if n_blocks <= MAX_SCALAR_BLOCKS:
        every = rows.sparkSession.range(n_blocks).select(F.col("id").cast("int").alias("block")).join(rows, "block", "left")
        zero = F.expr("array_repeat(0L, 1)")
        packed = F.sort_array(F.collect_list(F.struct("block", F.coalesce("words", zero).alias("words"))))
        value = every.agg(F.transform(packed, lambda x: x["words"])).scalar()
    return Level(level, n_blocks, rows, value)


def _set(words: Column, bit: Column) -> Column:
    """Whether a block's words have the bit; a block without keys is the array [0]."""
    word = F.get(words, F.floor(bit / 64).cast("int"))
    return F.coalesce(F.call_function("shiftrightunsigned", word, (bit % 64).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1, F.lit(False))


def _passes(df: DataFrame, key: str, level: Level, out: str) -> DataFrame:
    """df with the boolean `out`: whether the filter lets the key through."""
    block, bits = _block(F.col(key), level.number, level.n_blocks), _bits(F.col(key), level.number)
    if level.value is not None:
        held = df.withColumn("_words", F.get(level.value, block))
    else:
        held = df.withColumn("_block", block).join(level.rows.select(F.col("block").alias("_block"), F.col("words").alias("_words")), "_block", "left").drop("_block")
    return held.withColumn(out, reduce(Column.__and__, [_set(F.col("_words"), b) for b in bits])).drop("_words")


def build(universe: DataFrame) -> list[Level]:
    """The cascade for rows (key, listed): distinct keys, all that will ever be asked for."""
    keys = C.settle(universe, "bloom-universe")
    inner, outer = keys.where("listed").select("key"), keys.where("NOT listed").select("key")
    levels: list[Level] = []
    n = inner.count()
    while n:
        if len(levels) == MAX_LEVELS:
            raise RuntimeError("the cascade does not end: are keys both listed and unlisted?")
        level = _build(inner, n, len(levels))
        levels.append(level)
        through = C.settle(_passes(outer, "key", level, "through").where("through").select("key"), f"bloom-through-{level.number}")
        inner, outer, n = through, inner, through.count()
    return levels


def member(df: DataFrame, key: str, levels: list[Level], out: str) -> DataFrame:
    """df with the boolean `out`: whether the key is listed."""
    answer = F.lit(len(levels) % 2 == 1)
    for level in levels:
        df = _passes(df, key, level, f"_through{level.number}")
    for level in reversed(levels):
        answer = F.when(~F.col(f"_through{level.number}"), F.lit(level.number % 2 == 1)).otherwise(answer)
    return df.withColumn(out, answer).drop(*[f"_through{x.number}" for x in levels])


def judge(pages: DataFrame, listed: Column, rules: tuple[PathRule, ...] = RULES, url: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """One row for each page: the columns `keep`, host, path, rule, listed, verdict.

    `listed` is a boolean expression over the column `key` that tells which hosts are on the list; it is evaluated on
    the distinct hosts of the pages alone, and the cascade then answers for every page. A null url, or one without ://,
    has an empty host and path; the empty host is a key like any other. Repeated pages get equal verdicts; an empty
    table, or a list without hosts, gives no levels and nothing listed.
    """
    rows = pages.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    universe = rows.select(F.col("host").alias("key")).distinct().withColumn("listed", F.coalesce(listed, F.lit(False)))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    found = member(rows, "host", build(universe), "listed")
    found = found.withColumn("rule", name).withColumn("verdict", F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")))
    return found.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "host", "path", "rule", "listed", "verdict")


def sample_list(key: Column) -> Column:
    """The host list of the digest query: about a sixteenth of all names, those whose MD5 starts with 0."""
    return (key != "") & F.md5(key).startswith("0")


def op7_url_filters(spark, sf_dir: str) -> DataFrame:
    """Digest of the verdicts on every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judge(pages, sample_list(F.col("key"))).select("page_id", "host", "path", "rule", "verdict")


OP7_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), h AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u
), r AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM h
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN host <> '' AND starts_with(md5(host), '0') THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""
