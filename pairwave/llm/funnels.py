"""Ordered funnel counting by an ordinal equi-join (operator 11).

For each time of a client, cumulative counts of each kind through that time say which occurrence of a kind comes next: the
one whose number is a count more. A step is therefore an equi-join on client, kind and number, whatever lies between; excluded
rows between two steps are found by the difference of their counts at both.

Cumulative counts of a client with any share of the rows are made in chunks: rows are dealt by ranges of (client, time), counted inside a
chunk, and the totals of the chunks before are added. A client has as many chunks as the ranges are at most, so
no window and no join key holds more than a chunk. Quantiles are found by counts of equal durations, first by blocks of 2^15 microseconds, then
inside one block, so the windows are bounded by the limit.

Rows with a null client, kind or time don't count; equal (client, kind, time) are one row. Kinds that no funnel names are ignored.
A client without a first step has no row. Times may be with or without a zone. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .frames import written

#: Microseconds that a funnel may take from its first step.
LIMIT = 300_000_000
#: Durations are looked up by blocks of so many bits of microseconds.
BLOCK_BITS = 15


@dataclass(frozen=True)
class Funnel:
    """Kinds of the steps in order, and the kinds that end an attempt if they come between."""

    name: str
    steps: tuple[str, ...]
    excluding: tuple[str, ...] = ()


FUNNELS = (
    Funnel("A", ("view", "click", "view", "purchase"), ("error",)),
    Funnel("B", ("signup", "view", "click", "purchase"), ("error",)),
    Funnel("C", ("click", "click", "purchase", "view"), ("signup",)),
)


def micros(time: str, kind: T.DataType) -> Column:
    """Microseconds since 1970 of a time; one without a zone counts as UTC."""
    at = F.col(f"`{time}`")
    if not isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(at.cast("timestamp"))
    seconds = F.unix_date(at.cast("date")).cast("long") * 86_400 + F.hour(at) * 3_600 + F.minute(at) * 60
    return seconds * 1_000_000 + (F.date_part(F.lit("SECOND"), at) * 1_000_000).cast("long")


def timeline(events: DataFrame, kinds: list[str], client: str = "client_id", kind: str = "kind", time: str = "arrived_at") -> DataFrame:
    """client, at (microseconds), has_i (whether kinds[i] is there), seen_i (rows of kinds[i] through that time): a row for each time of a client."""
    numbers = range(len(kinds))
    rows = events.select(F.col(f"`{client}`").alias("client"), micros(time, events.schema[time].dataType).alias("at"), F.col(f"`{kind}`").alias("kind"))
    rows = rows.where(F.col("client").isNotNull() & F.col("at").isNotNull() & F.col("kind").isin(kinds))
    times = rows.groupBy("client", "at").agg(*[F.max((F.col("kind") == k).cast("int")).alias(f"has_{i}") for i, k in enumerate(kinds)])
    chunked = written(times.repartitionByRange("client", "at").withColumn("chunk", F.spark_partition_id()), "chunks")
    totals = chunked.groupBy("client", "chunk").agg(*[F.sum(f"has_{i}").alias(f"total_{i}") for i in numbers])
    before = Window.partitionBy("client").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("client", "chunk", *[F.coalesce(F.sum(f"total_{i}").over(before), F.lit(0)).alias(f"before_{i}") for i in numbers])
    inside = Window.partitionBy("client", "chunk").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    counted = chunked.select("client", "chunk", "at", *[f"has_{i}" for i in numbers], *[F.sum(f"has_{i}").over(inside).alias(f"in_{i}") for i in numbers])
    return counted.join(offsets, ["client", "chunk"]).select("client", "at", *[f"has_{i}" for i in numbers], *[(F.col(f"in_{i}") + F.col(f"before_{i}")).alias(f"seen_{i}") for i in numbers])


def _of(funnels: tuple[Funnel, ...], values: list[Column]) -> Column:
    """The value that belongs to a row's funnel."""
    out = F.lit(None)
    for number, value in enumerate(values):
        out = F.when(F.col("funnel") == number, value).otherwise(out)
    return out


def attempts(events: DataFrame, funnels: tuple[Funnel, ...] = FUNNELS, limit: int = LIMIT, **columns: str) -> list[DataFrame]:
    """For each step of the longest funnel: funnel (its number), client, began, at: the attempts that reach it. columns: names of client, kind and time."""
    kinds = sorted({k for f in funnels for k in (*f.steps, *f.excluding)})
    seen = [f"seen_{i}" for i in range(len(kinds))]
    times = written(timeline(events, kinds, **columns), "timeline")
    excluded = lambda f: sum((F.col(f"seen_{kinds.index(k)}") for k in f.excluding), F.lit(0).cast("long"))
    occurrences = times.select("client", "at", *seen, F.explode(F.array(*[F.when(F.col(f"has_{i}") > 0, F.lit(i)) for i in range(len(kinds))])).alias("kind")).where("kind IS NOT NULL")
    # number: which of the client's rows of that kind this one is.
    occurrences = occurrences.withColumn("number", F.element_at(F.array(*seen), F.col("kind") + 1))
    starts = [times.where(F.col(f"has_{kinds.index(f.steps[0])}") > 0).select(F.lit(n).alias("funnel"), "client", F.col("at").alias("began"), "at", *seen) for n, f in enumerate(funnels)]
    reached = starts[0]
    for more in starts[1:]:
        reached = reached.unionByName(more)
    steps = [reached]
    for s in range(1, max(len(f.steps) for f in funnels)):
        going = [n for n, f in enumerate(funnels) if len(f.steps) > s]
        then = [kinds.index(f.steps[s]) if len(f.steps) > s else None for f in funnels]
        waiting = reached.where(F.col("funnel").isin(going)).select(
            "funnel", "client", "began", F.col("at").alias("left_at"), _of(funnels, [excluded(f) for f in funnels]).alias("excluded"),
            _of(funnels, [F.lit(k) for k in then]).alias("kind"), _of(funnels, [F.lit(None) if k is None else F.col(f"seen_{k}") + 1 for k in then]).alias("number"),
        )
        met = waiting.join(occurrences, ["client", "kind", "number"])
        met = met.where((F.col("at") - F.col("began") <= limit) & (_of(funnels, [excluded(f) for f in funnels]) == F.col("excluded")))
        reached = written(met.select("funnel", "client", "began", F.col("left_at"), "at", *seen), f"step-{s + 1}")
        steps.append(reached)
    return steps


def quantile(lengths: DataFrame, percent: int) -> DataFrame:
    """For each (funnel, client, step) the ceil(percent * n / 100)-th smallest of its lengths, repeats counted."""
    key = ["funnel", "client", "step"]
    counts = lengths.groupBy(*key, "length").agg(F.count("*").alias("n")).withColumn("block", F.shiftright("length", BLOCK_BITS))
    blocks = counts.groupBy(*key, "block").agg(F.sum("n").alias("n"))
    whole, upto = Window.partitionBy(*key), Window.partitionBy(*key).orderBy("block")
    placed = blocks.select(*key, "block", F.floor((F.lit(percent) * F.sum("n").over(whole) + 99) / 100).cast("long").alias("wanted"), (F.sum("n").over(upto.rowsBetween(Window.unboundedPreceding, 0))).alias("upto"), "n")
    chosen = placed.where("upto >= wanted AND upto - n < wanted").select(*key, "block", (F.col("wanted") - F.col("upto") + F.col("n")).alias("wanted"))
    inside = Window.partitionBy(*key, "block").orderBy("length").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.join(chosen, [*key, "block"]).withColumn("upto", F.sum("n").over(inside))
    return ranked.where("upto >= wanted AND upto - n < wanted").select(*key, F.col("length").alias("value"))


def count(events: DataFrame, funnels: tuple[Funnel, ...] = FUNNELS, limit: int = LIMIT, percent: int = 25, **columns: str) -> DataFrame:
    """funnel, client_id, n1.., deepest, t2.., same_depth: attempts that reach each step, quantiles of the times between steps, clients with equal depth.

    Every funnel must have at least one step; columns beyond a funnel's last step are 0 and null.
    """
    steps = attempts(events, funnels, limit, **columns)
    last = len(steps)
    lengths = steps[1].select("funnel", "client", F.lit(2).alias("step"), (F.col("at") - F.col("left_at")).alias("length")) if last > 1 else None
    for s, reached in enumerate(steps[2:], 3):
        lengths = lengths.unionByName(reached.select("funnel", "client", F.lit(s).alias("step"), (F.col("at") - F.col("left_at")).alias("length")))
    each = [reached.groupBy("funnel", "client").agg(F.count("*").alias("n")).select("funnel", "client", F.lit(s).alias("step"), "n", F.lit(None).cast("long").alias("value")) for s, reached in enumerate(steps, 1)]
    if lengths is not None:
        each.append(quantile(lengths, percent).select("funnel", "client", "step", F.lit(None).cast("long").alias("n"), "value"))
    rows = each[0]
    for more in each[1:]:
        rows = rows.unionByName(more)
    at = lambda s, c: F.max(F.when(F.col("step") == s, F.col(c)))
    table = rows.groupBy("funnel", "client").agg(*[F.coalesce(at(s, "n"), F.lit(0)).alias(f"n{s}") for s in range(1, last + 1)], F.max(F.when(F.col("n") > 0, F.col("step"))).alias("deepest"), *[at(s, "value").alias(f"t{s}") for s in range(2, last + 1)])
    table = written(table, "funnels")
    depths = table.groupBy("funnel", "deepest").agg(F.count("*").alias("same_depth"))  # a row for each funnel and step at most
    names = _of(funnels, [F.lit(f.name) for f in funnels])
    return table.join(F.broadcast(depths), ["funnel", "deepest"]).select(names.alias("funnel"), F.col("client").alias("client_id"), *[f"n{s}" for s in range(1, last + 1)], "deepest", *[f"t{s}" for s in range(2, last + 1)], "same_depth")
