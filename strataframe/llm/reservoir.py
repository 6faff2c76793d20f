"""Uniform samples of fixed size from data of unknown length.

Each partition keeps a reservoir and counts what it has seen (Algorithm L: the number of rows to skip before the next
one that enters is drawn at once, so work is in proportion to the rows that enter). Reservoirs are merged by drawing how
many rows each part gives from the multivariate hypergeometric distribution over what the parts represent: a random
subset of a reservoir is then a part of a uniform sample of all. Only the counts of the parts meet in one place; the
distribution is drawn by numbering all rows and drawing the sample's numbers, as numpy's own ends at 10**9 rows.
"""

from __future__ import annotations

import hashlib
import math
import random
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataframe.plans.workspace import store


class Reservoir:
    """At most ``size`` of the numbers 0, 1, 2, ... offered so far, each set equally likely."""

    def __init__(self, size: int, rng: np.random.Generator):
        self.size, self.rng, self.seen, self.kept = size, rng, 0, []
        self._w, self._next = 1.0, size - 1 if size else math.inf
        if size:
            self._skip()

    def _skip(self) -> None:
        self._w *= math.exp(math.log(1.0 - self.rng.random()) / self.size)
        if self._w > 0.0:
            self._next += int(min(2.0**62, math.floor(math.log(1.0 - self.rng.random()) / math.log1p(-self._w)))) + 1 if self._w < 1.0 else 1
        else:
            self._next = math.inf

    def offer(self, count: int) -> list[tuple[int, int]]:
        """Takes ``count`` more rows; returns (slot, offset among them) of those that enter, later ones overwrite."""
        entered = []
        end = self.seen + count
        for row in range(self.seen, min(self.size, end)):
            entered.append((row, row - self.seen))
        while self._next < end:
            entered.append((int(self.rng.integers(self.size)), int(self._next - self.seen)))
            self._skip()
        self.seen = end
        return entered


class Kept:
    """The rows that a reservoir's slots hold, as places in the tables of rows that entered; overwritten rows go when they are too many."""

    def __init__(self, size: int):
        self.slots = np.zeros(size, dtype="int64")
        self.tables: list[pa.Table] = []
        self.rows, self.filled = 0, 0

    def put(self, slots: np.ndarray, taken: pa.Table) -> None:
        self.slots[slots] = self.rows + np.arange(len(slots))
        self.tables.append(taken)
        self.rows += len(slots)
        self.filled = max(self.filled, int(slots.max()) + 1)
        if self.rows > 8 * len(self.slots) + 1024 or len(self.tables) > 256:
            self.tables = [self.table()]
            self.rows = self.filled
            self.slots[: self.filled] = np.arange(self.filled)

    def table(self) -> pa.Table:
        return pa.concat_tables(self.tables).take(pa.array(self.slots[: self.filled]))


def _fill(sizes: dict[str, int], seed: int, width: int):
    """Reservoirs of one partition for each scope (its column) and key. The first columns are the scopes' keys."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held: dict[tuple[str, str | None], tuple[Reservoir, Kept]] = {}
        schema = None
        for batch in batches:
            payload = pa.Table.from_batches([batch]).select(list(range(len(sizes), batch.num_columns)))
            schema = payload.schema
            for k, (scope, size) in enumerate(sizes.items()):
                codes = batch.column(k).dictionary_encode(null_encoding="encode")
                keys, index = codes.dictionary.to_pylist(), codes.indices.to_numpy()
                order = np.argsort(index, kind="stable")
                ends = np.cumsum(np.bincount(index, minlength=len(keys)))
                for j, key in enumerate(keys):
                    rows = order[(ends[j - 1] if j else 0) : ends[j]]
                    name = (scope, key)
                    if name not in held:
                        mark = int.from_bytes(hashlib.blake2b(f"{scope}\0{key}\0{key is None}".encode(), digest_size=16).digest(), "big")
                        held[name] = (Reservoir(size, np.random.default_rng([seed, part, mark])), Kept(size))
                    reservoir, kept = held[name]
                    entered = dict(reservoir.offer(len(rows)))  # of rows that enter one slot the last stays
                    if entered:
                        kept.put(np.fromiter(entered, "int64", len(entered)), payload.take(pa.array(rows[list(entered.values())])))
        for (scope, key), (reservoir, kept) in held.items():
            if not kept.filled:
                continue
            table = kept.table().combine_chunks()
            n = table.num_rows
            place = reservoir.rng.permutation(n)
            head = [pa.array([scope] * n, pa.string()), pa.array([key] * n, pa.string()), pa.array([part] * n, pa.int32()), pa.array([reservoir.seen] * n, pa.int64()), pa.array(place, pa.int32())]
            cols = head + [c.combine_chunks() for c in table.columns]
            cols = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in cols]
            yield pa.RecordBatch.from_arrays(cols, names=["scope", "key", "part", "seen", "place", *schema.names])

    return fill


def part_shares(counts: np.ndarray, size: int, rng: random.Random) -> list[int]:
    """How many of ``size`` rows (all, if they are fewer) drawn without replacement come from each part of ``counts`` rows."""
    ends = np.cumsum(counts, dtype="int64")
    total = int(ends[-1]) if len(ends) else 0
    drawn = np.array(rng.sample(range(total), min(size, total)), dtype="int64")
    return np.bincount(np.searchsorted(ends, drawn, side="right"), minlength=len(ends)).tolist()


def _shares(sizes: dict[str, int], seed: int):
    def shares(scope: pd.Series, key: pd.Series, seen: pd.Series) -> pd.Series:
        out = []
        for s, k, counts in zip(scope, key, seen, strict=True):
            out.append(part_shares(np.asarray(counts, dtype="int64"), sizes[s], random.Random(f"{seed}\0{s}\0{k}")))
        return pd.Series(out)

    return F.pandas_udf(shares, "array<bigint>")


def reservoir_sample(df: DataFrame, scopes: dict[str, tuple[str | None, int]], seed: int = 0) -> DataFrame:
    """Samples without replacement: ``scope, key, population`` and the columns of ``df``.

    ``scopes`` names each sampling: its key column (None: all rows are one group) and its size. All are drawn in one pass
    over ``df``. A group with no more rows than the size is returned whole; a null key is a group; rows that repeat are
    drawn like any other; an empty table gives no rows. Columns of ``df`` must not be called scope, key or population
    (they are renamed with a leading ``in_``). The draw depends on the seed and on how rows lie in partitions.
    """
    clash = {c: f"in_{c}" for c in ("scope", "key", "population", "part", "seen", "place") if c in df.columns}
    renamed = df.withColumnsRenamed(clash)
    sizes = {name: int(size) for name, (_, size) in scopes.items()}
    keys = [(F.col(clash.get(c, c)).cast("string") if c else F.lit(None).cast("string")).alias(f"_key_{i}") for i, (c, _) in enumerate(scopes.values())]
    head = "scope string, key string, part int, seen bigint, place int"
    schema = T.StructType([*T._parse_datatype_string(head).fields, *renamed.schema.fields])
    kept = store(renamed.select(*keys, *[F.col(f"`{c}`") for c in renamed.columns]).mapInArrow(_fill(sizes, seed, len(keys)), schema), "reservoirs")
    parts = kept.groupBy("scope", "key", "part").agg(F.max("seen").alias("seen"))
    grouped = parts.groupBy("scope", "key").agg(F.sort_array(F.collect_list(F.struct("part", "seen"))).alias("parts"), F.sum("seen").alias("population"))
    shares = grouped.select("scope", "key", "population", F.explode(F.arrays_zip(F.col("parts.part").alias("part"), _shares(sizes, seed)("scope", "key", F.col("parts.seen")).alias("give"))).alias("z"))
    shares = shares.select(F.col("scope").alias("_scope"), F.col("key").alias("_key"), "population", F.col("z.part").alias("_part"), F.col("z.give").alias("give")).where("give > 0")
    on = (F.col("scope") == F.col("_scope")) & F.col("key").eqNullSafe(F.col("_key")) & (F.col("part") == F.col("_part"))
    drawn = kept.join(shares, on).where("place < give")
    return drawn.select("scope", "key", "population", *[F.col(f"`{c}`") for c in renamed.columns])
