"""Sources mixed to target shares of a total size in tokens, with capped repetition.

Each record expects a number of copies in proportion to its weight, at most its source's cap, so that its source reaches
its target. The whole copies are certain. The rest is an inclusion probability: records are ranked by their random odds
divided by their inclusion odds (Pareto order sampling), and taken in this order until the source's size is reached as
closely as whole records allow.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataframe.plans.running import running_sum
from strataframe.plans.workspace import store

#: Rank file of a public byte-level BPE; the pattern belongs to it.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """The rows of ``documents`` with ``tokens`` in the place of ``text``; a null text has 0 tokens."""

    rest = [c for c in documents.columns if c not in ("text", "tokens")]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(vocabulary).encode_ordinary
        for batch in batches:
            size = pa.array([len(encode(t.as_py())) if t.is_valid else 0 for t in batch.column(0)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], size], names=[*rest, "tokens"])

    schema = documents.select(*rest).schema.add("tokens", T.LongType())
    return documents.select("text", *rest).mapInArrow(count, schema)


def source_name(column: str) -> Column:
    """A source's name in one spelling: trimmed, lower case, hyphens for underscores and blanks; empty becomes null."""
    name = F.regexp_replace(F.lower(F.trim(column)), "[_\\s]+", "-")
    return F.when(name != "", name)


def mix(records: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Chosen records with their copies, and the shares reached.

    ``records`` has ``id, source, size`` (whole number) and ``weight`` (expected copies are in proportion to it);
    ``targets`` has ``source, target_share, max_repeats``, one row per source. ``total`` is the size to reach (default:
    all records' size). Shares count as parts of their sum over the sources with a share, so sources without a target,
    with a null or non-positive share or cap get nothing; those without records can't be reached and say so. Records with
    a null id or source or without a positive size or weight are never chosen. A source whose cap allows less than its
    target gives all it has ``max_repeats`` times; what it lacks is not made up by others.

    First result: ``id, source, size, copies`` (at least 1). Second: one row per source of either table: ``source,
    target_share, max_repeats, records, available, target_size, chosen_records, chosen_copies, reached_size,
    reached_share``.
    """
    known = records.select("id", "source", F.col("size").cast("bigint").alias("size"), F.col("weight").cast("double").alias("weight"))
    known = store(known.where("id IS NOT NULL AND source IS NOT NULL AND size > 0 AND weight > 0 AND weight < double('Infinity')"), "sized")
    have = known.groupBy("source").agg(F.count(F.lit(1)).alias("records"), F.sum("size").alias("available"))
    asked = targets.dropna(subset=["source"]).select("source", F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("int").alias("max_repeats"))
    whole = F.lit(int(total)) if total is not None else F.sum("available").over(_all())
    counted = F.when((F.col("target_share") > 0) & (F.col("max_repeats") > 0), F.col("target_share"))
    goal = have.join(asked, "source", "full").withColumn("share", F.try_divide(counted, F.sum(counted).over(_all())))
    goal = store(goal.withColumn("target_size", F.coalesce(F.round(F.col("share") * whole), F.lit(0.0)).cast("bigint")), "goal")

    wanted = goal.where("target_size > 0 AND records > 0").select("source", "target_size", "max_repeats", "available")
    # the heaviest weight below its cap gives the copies per unit of weight: all heavier ones are capped, it and lighter ones are not
    each = known.join(wanted.select("source"), "source").groupBy("source", "weight").agg(F.sum("size").alias("size")).withColumn("mass", F.col("size") * F.col("weight"))
    sums = running_sum(running_sum(each, ["source"], ["weight"], "size", "upto"), ["source"], ["weight"], "mass", "open")
    left = F.col("target_size") - F.col("max_repeats") * (F.col("available") - F.col("upto"))
    free = sums.join(wanted, "source").where(F.col("weight") * left < F.col("max_repeats") * F.col("open"))
    found = free.groupBy("source").agg(F.max_by(left / F.col("open"), F.col("weight")).alias("rate"))
    rate = wanted.drop("available").join(found, "source", "left").withColumn("rate", F.coalesce("rate", F.lit(float("inf"))))

    expected = F.least(F.col("weight") * F.col("rate"), F.col("max_repeats").cast("double"))
    each = known.join(rate, "source").withColumn("expected", expected).withColumn("sure", F.floor(F.col("expected") + 1e-9).cast("int"))
    each = store(each.withColumn("chance", F.col("expected") - F.col("sure")).select("id", "source", "size", "sure", "chance"), "expected")
    certain = each.groupBy("source").agg(F.sum(F.col("size") * F.col("sure")).alias("given"))
    odds = F.abs(F.xxhash64(F.lit(int(seed)), F.col("id"))) % (1 << 52)
    u = (odds + 0.5) / float(1 << 52)
    ranked = each.where("chance > 1e-9").select("id", "source", "size", ((u / (1 - u)) / (F.col("chance") / (1 - F.col("chance")))).alias("rank"))
    order = running_sum(ranked, ["source"], ["rank", "id"], "size", "upto")
    need = wanted.join(certain, "source").select("source", (F.col("target_size") - F.col("given")).alias("need"))
    extra = order.join(need, "source").where("upto - size / 2 <= need").select("id", F.lit(1).alias("extra"))
    chosen = each.join(extra, "id", "left").withColumn("copies", F.col("sure") + F.coalesce("extra", F.lit(0)))
    chosen = chosen.where("copies > 0").select("id", "source", "size", "copies")

    reached = chosen.groupBy("source").agg(F.count(F.lit(1)).alias("chosen_records"), F.sum("copies").alias("chosen_copies"), F.sum(F.col("size") * F.col("copies")).alias("reached_size"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("records", "available")]
    report = goal.select("source", "target_share", "max_repeats", *zero, "target_size").join(reached, "source", "left")
    report = report.select("source", "target_share", "max_repeats", "records", "available", "target_size", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("chosen_records", "chosen_copies", "reached_size")])
    return chosen, report.withColumn("reached_share", F.try_divide("reached_size", F.sum("reached_size").over(_all())))


def _all() -> WindowSpec:
    return Window.partitionBy(F.lit(0))  # one row per source
