"""Request limits: fixed windows that count every request, and sliding ones that count the allowed."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import ordered as O
from tidemark.operators.detect import micros


def budget(requests: DataFrame, key: str, at: str, limit: int, seconds: int = 60) -> DataFrame:
    """By key and slot of time: requests, consumed (saturates at limit + 1), refused."""
    slot = F.floor(micros(F.col(at)) / (seconds * 1_000_000)).alias("slot")
    rows = requests.groupBy(key, slot).agg(F.count(F.lit(1)).alias("requests"))
    return rows.withColumns({"consumed": F.least("requests", F.lit(limit + 1)), "refused": F.greatest(F.col("requests") - limit, F.lit(0))})


def sliding(requests: DataFrame, key: str, at: str, order: str, limit: int = 10, seconds: int = 60) -> DataFrame:
    """Adds allowed and retry_after (seconds, 1 at least, null when allowed). Only allowed requests count, so a request
    depends on the decisions before it: a fold over each key's requests in order, with `limit` times as its state."""
    span = seconds * 1_000_000

    def step(seen: deque, row: tuple) -> tuple:
        while seen and row[0] - seen[0] >= span:
            seen.popleft()
        if len(seen) < limit:
            seen.append(row[0])
            return seen, (True, None)
        return seen, (False, max(1, -(-(span - row[0] + seen[0]) // 1_000_000)))

    rows = requests.withColumn("_t", micros(F.col(at)))
    return O.in_order(rows, [key], ["_t", order], ["_t"], "allowed boolean, retry_after bigint", deque, step).drop("_t")
