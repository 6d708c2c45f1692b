"""Folds over keyed rows as they come, with state; many keys share one group of the state store."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Groups that keys are dealt to where no timer is needed. A group costs some milliseconds a batch beside its rows, so that
#: with one for each key they were nearly all of the cost.
GROUPS = 1 << 10
_PANDAS = {"int": "Int32", "long": "Int64", "boolean": "boolean", "string": "object"}


def folded(rows: DataFrame, key: str, order: Sequence[str], fields: Sequence[str], out: str, follow: Callable[[object, list[tuple]], tuple[object, list[tuple]]], late: Callable[[object], tuple[object, list[tuple]]] | None = None, wait: Callable[[object], int | None] | None = None, groups: int = GROUPS) -> DataFrame:
    """key and the columns `out` (a schema) that a fold makes of each key's rows, read batch by batch in `order`.

    follow: a key's state, None at first, and its new `fields` in order, to the new state and its rows; their first value
    is the first of out. late and wait are for timers: a state that nothing came for and its rows, and after how many
    milliseconds it is asked (None: not at all); a state of None is dropped. A timer is a group's, so with them each key is a group of its own.
    Without, `groups` groups of keys (by hash) share the state's rows, each a dictionary by key. A null key is a key.
    A group's new rows of a batch are sorted in memory.
    """
    kind = rows.schema[key].dataType.simpleString()
    columns = [tuple(c.split()) for c in out.split(", ")]

    def run(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pickle.loads(bytes(state.get[0])) if state.exists else {}
        keys: list[str | None] = []
        made: list[tuple] = []
        if state.hasTimedOut:
            for name, old in list(held.items()):
                held[name], found = late(old)
                keys += [name] * len(found)
                made += found
        else:
            new = pd.concat(list(parts)).sort_values(list(order), kind="stable")
            by_key: dict[str | None, list[tuple]] = {}
            for name, row in zip(new["_key"].tolist(), zip(*[new[c].tolist() for c in fields])):
                by_key.setdefault(name, []).append(row)
            for name, own in by_key.items():
                held[name], found = follow(held.get(name), own)
                keys += [name] * len(found)
                made += found
        held = {name: x for name, x in held.items() if x is not None}
        if held or not state.exists:
            state.update((pickle.dumps(held),))
            times = [] if wait is None else [t for t in map(wait, held.values()) if t is not None]
            if times:
                state.setTimeoutDuration(min(times))
        else:
            state.remove()
        values = list(zip(*made)) if made else [()] * len(columns)
        yield pd.DataFrame({"_key": pd.Series(keys, dtype="object")} | {n: pd.Series(list(v), dtype=_PANDAS[t]) for (n, t), v in zip(columns, values)})

    name = F.col(key).cast("string")
    named = rows.withColumn("_key", name).withColumn("_group", F.col("_key") if wait is not None else F.pmod(F.xxhash64("_key"), F.lit(groups)))
    slim = named.select("_group", "_key", *dict.fromkeys([*order, *fields]))
    timer = GroupStateTimeout.NoTimeout if wait is None else GroupStateTimeout.ProcessingTimeTimeout
    found = slim.groupBy("_group").applyInPandasWithState(run, f"_key string, {out}", "held binary", "append", timer)
    return found.select(F.col("_key").cast(kind).alias(key), *[n for n, _ in columns])
