"""Mixing sources to target weights by Pfair scheduling, in DataFrame expressions only.

The rows of a source, in a fixed random order, form blocks of ``BLOCK`` rows. Target weights are
taken as the decimals they are written as and are whole shares of a cycle of slots that represents
them exactly. Block i = 1, 2 ... of a source with share q of a cycle of C slots is released at slot
floor((i - 1) C / q) and due before slot ceil(i C / q); each slot goes to the released block with
the earliest deadline (ties: the source named first). The shares add up to C, so all deadlines are
met and after any number of slots each source has had less than one block more or less than its
weight asks for.

The schedule repeats after a cycle, so it is worked out once for the weights alone and joined to
the blocks. Weights that need a cycle of over ``MAX_CYCLE`` slots do not repeat soon enough: their
schedule is worked out in whole numbers for the blocks there are, one row on the driver for each
block. A source that ends leaves its slots to the others, whose rates among each other stay as
they were: every row gets a place. ``on_target`` marks the rows before the first source ends,
where the weights hold exactly.

Defined cases: a null source is a source of its own, named by null; null ids and texts are rows as
any; equal rows are all placed, in any order among themselves; sources without a weight are an
error, weights without rows are left out; an empty table stays empty; a column of the table that
has the name of an added one gives way to it.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction
from numbers import Rational

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import id_digest, numbered

BLOCK = 16
MIN_CYCLE, MAX_CYCLE, MAX_SOURCES = 1000, 8192, 1024


def shares(weights: list[float], cycle: int) -> list[int]:
    """Whole shares of the cycle, at least one each, by largest remainders."""
    total = sum(weights)
    exact = [w / total * cycle for w in weights]
    out = [max(1, math.floor(x)) for x in exact]
    order = sorted(range(len(weights)), key=lambda k: (out[k] - exact[k], k))
    k = 0
    while sum(out) < cycle:
        out[order[k % len(order)]] += 1
        k += 1
    while sum(out) > cycle:
        out[max(range(len(out)), key=lambda i: (out[i] - exact[i] if out[i] > 1 else -math.inf, i))] -= 1
    return out


def exact_shares(weights: list) -> list[int]:
    """The least whole numbers in the proportions of the weights."""
    parts = [Fraction(w) if isinstance(w, Rational) else Fraction(str(w)) for w in weights]
    scale = math.lcm(*[x.denominator for x in parts])
    whole = [int(x * scale) for x in parts]
    least = math.gcd(*whole)
    return [x // least for x in whole]


def schedule(quota: list[int]) -> list[tuple[int, int]]:
    """For each slot of a cycle the source and its block's number there, by earliest deadline first."""
    cycle = sum(quota)
    due = lambda s, i: -(-(i + 1) * cycle // quota[s])
    later = [(0, due(s, 0), s, 0) for s in range(len(quota))]
    heapq.heapify(later)
    ready: list[tuple[int, int, int]] = []
    out = []
    for slot in range(cycle):
        while later and later[0][0] <= slot:
            _, deadline, s, i = heapq.heappop(later)
            heapq.heappush(ready, (deadline, s, i))
        deadline, s, i = heapq.heappop(ready)
        if deadline <= slot:
            raise AssertionError("a deadline was missed")
        out.append((s, i))
        if i + 1 < quota[s]:
            heapq.heappush(later, ((i + 1) * cycle // quota[s], due(s, i + 1), s, i + 1))
    return out


def schedule_of_blocks(quota: list[int], blocks: list[int]) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(source, block, slot, release, deadline) of all blocks as they come, and the first slot that finds its source at an end.

    A source at an end has one idle slot and then drops out; slots without a released block are passed over.
    """
    cycle = sum(quota)
    freed = lambda s, i: i * cycle // quota[s]
    due = lambda s, i: -(-(i + 1) * cycle // quota[s])
    later = [(0, due(s, 0), s, 0) for s in range(len(quota))]
    heapq.heapify(later)
    ready: list[tuple[int, int, int]] = []
    out, ends, slot, left = [], None, 0, sum(blocks)
    while left or ends is None:
        if not ready and later[0][0] > slot:
            slot = later[0][0]
        while later and later[0][0] <= slot:
            _, deadline, s, i = heapq.heappop(later)
            heapq.heappush(ready, (deadline, s, i))
        deadline, s, i = heapq.heappop(ready)
        if deadline <= slot:
            raise AssertionError("a deadline was missed")
        if i < blocks[s]:
            out.append((s, i, slot, freed(s, i), deadline))
            left -= 1
            heapq.heappush(later, (freed(s, i + 1), due(s, i + 1), s, i + 1))
        elif ends is None:
            ends = slot
        slot += 1
    return out, ends


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, block: int = BLOCK, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Add the place of each row in the mix: ``source_row, block, release, deadline, slot, position, on_target``.

    ``weights`` default to equal ones. ``position`` numbers all rows 0, 1, 2 ... without gaps.
    """
    counts = {r["s"]: r["n"] for r in docs.groupBy(F.col(source_col).alias("s")).agg(F.count(F.lit(1)).alias("n")).orderBy("s").limit(MAX_SOURCES + 1).collect()}
    if len(counts) > MAX_SOURCES:
        raise ValueError(f"over {MAX_SOURCES} sources")
    names = list(counts)
    missing = [] if weights is None else [s for s in names if not weights.get(s, 0) > 0]
    if missing:
        raise ValueError(f"no weight for sources {missing[:5]}")
    added = ["source_row", "block", "release", "deadline", "slot", "position", "on_target"]
    types = ["long", "long", "long", "long", "long", "long", "boolean"]
    own = {f"c{k}": c for k, c in enumerate(docs.columns) if c not in added}
    id_col, source_col, text_col = ({c: k for k, c in own.items()}[c] for c in (id_col, source_col, text_col))
    docs = docs.select(*[F.col(c).alias(k) for k, c in own.items()])
    back = [F.col(k).alias(c) for k, c in own.items()]
    if not names:
        return docs.select(*back, *[F.lit(None).cast(t).alias(c) for c, t in zip(added, types, strict=True)])
    quota = exact_shares([1] * len(names) if weights is None else [weights[s] for s in names])
    blocks = [-(-n // block) for n in counts.values()]
    known = F.col(source_col).eqNullSafe
    index = F.coalesce(*[F.when(known(s), k) for k, s in enumerate(names)])
    keyed = docs.withColumn("_source", index).withColumn("_digest", id_digest(id_col)).withColumn("_tie", F.xxhash64(text_col))
    placed = numbered(keyed, "_source", "_digest", ["_tie"], max(counts.values()), "source_row")
    placed = placed.withColumn("source_row", F.col("source_row").cast("long")).withColumn("block", F.floor(F.col("source_row") / block))
    if sum(quota) <= MAX_CYCLE:
        least = min(MAX_CYCLE, max(MIN_CYCLE, 4 * len(names)))
        times = min(-(-least // sum(quota)), MAX_CYCLE // sum(quota))
        placed = _by_cycle(placed, [q * times for q in quota], list(counts.values()), blocks, block)
    else:
        placed = _by_block(placed, quota, list(counts.values()), blocks, block)
    return placed.select(*back, *added)


def _by_cycle(placed: DataFrame, quota: list[int], counts: list[int], blocks: list[int], block: int) -> DataFrame:
    """``placed`` with the columns of a schedule that repeats."""
    spark, cycle = placed.sparkSession, sum(quota)
    slots = schedule(quota)
    had, rows = [0] * len(quota), []
    for at, (s, i) in enumerate(slots):
        rows.append((s, i, at, list(had)))
        had[s] += 1
    plan = spark.createDataFrame(rows, "_s int, _i int, _at int, _had array<int>")
    # the first slot that finds its source at an end
    where = {(s, i): at for at, (s, i) in enumerate(slots)}
    ends = min((b // q) * cycle + where[s, b % q] for s, (b, q) in enumerate(zip(blocks, quota, strict=True)))
    last = F.array(*[F.lit(n).cast("long") for n in counts])
    share = F.array(*[F.lit(q) for q in quota])
    placed = placed.withColumn("_q", F.element_at(share, F.col("_source") + 1))
    placed = placed.withColumn("_cycle", F.floor(F.col("block") / F.col("_q"))).join(F.broadcast(plan), (F.col("_source") == F.col("_s")) & (F.col("block") % F.col("_q") == F.col("_i")))
    # rows of all sources in the blocks of earlier slots: whole cycles, the part of this one, no more than there are
    earlier = F.zip_with(F.zip_with("_had", share, lambda had, q: F.col("_cycle") * q + had), last, lambda b, n: F.least(b * block, n))
    return (
        placed.withColumn("release", F.floor(F.col("block") * cycle / F.col("_q")))
        .withColumn("deadline", F.ceil((F.col("block") + 1) * cycle / F.col("_q")))
        .withColumn("slot", F.col("_cycle") * cycle + F.col("_at"))
        .withColumn("position", F.aggregate(earlier, F.lit(0).cast("long"), lambda a, b: a + b) + F.col("source_row") % block)
        .withColumn("on_target", F.col("slot") < ends)
    )


def _by_block(placed: DataFrame, quota: list[int], counts: list[int], blocks: list[int], block: int) -> DataFrame:
    """``placed`` with the columns of a schedule that has a row for each block."""
    order, ends = schedule_of_blocks(quota, blocks)
    starts, at = [], 0
    for s, i, *_ in order:
        starts.append(at)
        at += min(block, counts[s] - i * block)
    columns = [pa.array(c, pa.int64()) for c in (*zip(*order, strict=True), starts)]
    plan = placed.sparkSession.createDataFrame(pa.table(columns, names=["_s", "_i", "slot", "release", "deadline", "_start"]))
    met = placed.join(plan, (F.col("_source") == F.col("_s")) & (F.col("block") == F.col("_i")))
    return met.withColumn("position", F.col("_start") + F.col("source_row") % block).withColumn("on_target", F.col("slot") < ends)


def with_position(docs: DataFrame, weights: dict[str | None, float] | None = None, out: str = "position", id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and the place of each row in the mix as ``out``, which must be a new name."""
    inner = {f"c{k}": c for k, c in enumerate(docs.columns)}
    back = {c: k for k, c in inner.items()}
    mixed = mix(docs.select(*[F.col(c).alias(k) for k, c in inner.items()]), weights, id_col=back[id_col], source_col=back[source_col], text_col=back[text_col])
    return mixed.select(*[F.col(k).alias(c) for k, c in inner.items()], F.col("position").alias(out))


def in_mixed_order(docs: DataFrame, weights: dict[str | None, float] | None = None, **names: str) -> DataFrame:
    """The rows of ``docs`` with their columns; files read in order hold the mix."""
    mixed = with_position(docs, weights, "_mixed", **names)
    return mixed.repartitionByRange("_mixed").sortWithinPartitions("_mixed").drop("_mixed")


def tempered(docs: DataFrame, power: float = 0.5, source_col: str = "source") -> dict[str | None, float]:
    """Weights in proportion to a power of each source's rows, in thousandths of the largest: below 1 small sources are seen more than their share."""
    counts = {r["s"]: r["n"] for r in docs.groupBy(F.col(source_col).alias("s")).agg(F.count(F.lit(1)).alias("n")).orderBy("s").limit(MAX_SOURCES + 1).collect()}
    most = max(counts.values(), default=1)
    return {s: max(1, round(1000 * (n / most) ** power)) / 1000 for s, n in counts.items()}
