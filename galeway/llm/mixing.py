"""Mixing sources to target weights by Pfair scheduling of blocks."""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Mapping
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galeway.llm.common import pack, running_sum, salt_count, unpack

#: Bytes of text in a block: the unit that is scheduled.
BLOCK_BYTES = 1 << 16
#: Rows of a schedule up to which it is broadcast.
BROADCAST_ROWS = 1_000_000


def shares(weights: Mapping[str, float], resolution: int | None = None) -> dict[str, int]:
    """Weights as whole slots of a period: exactly as written in decimals, or rounded to about `resolution` slots, one at least."""
    if resolution is not None:
        total = sum(weights.values())
        return {s: max(1, round(resolution * w / total)) for s, w in weights.items()}
    exact = {s: Fraction(repr(float(w))) for s, w in weights.items()}
    scale = math.lcm(*(w.denominator for w in exact.values()))
    whole = {s: int(w * scale) for s, w in exact.items()}
    common = math.gcd(*whole.values())
    return {s: w // common for s, w in whole.items()}


def edf(p: Mapping[str, int], slots: int | None = None, have: Mapping[str, int] | None = None) -> list[tuple[str, int]]:
    """(source, block) by slot: block j of a source with weight p/P is released at floor(j P/p), due at ceil((j+1) P/p).

    The released block with the earliest deadline goes first. At any slot t a source has had more
    than t p/P - 1 and fewer than t p/P + 1 blocks. With `have`, it ends when a source has no block left.
    """
    period, done, out = sum(p.values()), dict.fromkeys(p, 0), []
    due = [(-(-period // p[s]), s) for s in p]  # released blocks by deadline
    later: list[tuple[int, str]] = []  # others by release
    heapq.heapify(due)
    for t in range(period if slots is None else slots):
        while later and later[0][0] <= t:
            s = heapq.heappop(later)[1]
            heapq.heappush(due, (-(-(done[s] + 1) * period // p[s]), s))
        s = heapq.heappop(due)[1]
        out.append((s, done[s]))
        done[s] += 1
        heapq.heappush(later, (done[s] * period // p[s], s))
        if have is not None and done[s] >= have[s]:
            break
    return out


def schedule(p: Mapping[str, int], blocks: Mapping[str, int]) -> tuple[list[tuple], list[tuple], int]:
    """(phases, patterns, slots) that place every block.

    While the same sources have blocks left, whole periods repeat one pattern; the last, partial
    period ends with the first source that runs out, and the others go on with their weights
    among themselves. A partial period has its own pattern, so there are no more rows than blocks. phases: (source, phase, first block, block after the last, first slot,
    share, period); patterns: (phase, source, i, slot) for the i-th block of a period.
    """
    left, at, phases, patterns, phase = {s: n for s, n in blocks.items() if n > 0}, 0, [], [], 0
    done = dict.fromkeys(left, 0)
    while left:
        active = {s: p[s] for s in left}
        period = sum(active.values())
        whole = min(left[s] // active[s] for s in left)
        for rounds in ([whole] if whole else []) + [0]:
            order = edf(active, None, None if rounds else left)
            count = Counter(s for s, _ in order)
            took = {s: count[s] * max(1, rounds) for s in active}
            for s in active:
                if took[s]:
                    phases.append((s, phase, done[s], done[s] + took[s], at, count[s], len(order)))
            patterns += [(phase, s, j, k) for k, (s, j) in enumerate(order)]
            at += period * rounds if rounds else len(order)
            phase += 1
            for s in active:
                done[s] += took[s]
                left[s] -= took[s]
            left = {s: n for s, n in left.items() if n > 0}
            if len(left) < len(active):
                break
    return phases, patterns, at


def mix(docs: DataFrame, weights: Mapping[str, float], default_weight: float = 1.0, block_bytes: int = BLOCK_BYTES,
        resolution: int | None = None, doc: str = "doc_id", text: str = "text", source: str = "source") -> tuple[DataFrame, int]:
    """(docs with mix_source, block, slot, start and phase; the number of slots).

    Read in the order of (slot, start), the sources interleave with less than one block deviation
    from their weights, as long as each has blocks; no row is dropped or repeated. A block is
    block_bytes of one source's texts (UTF-8, plus 1 each) in a fixed random order; a document
    belongs to the block in which it starts, however long it is. A null source is the source ""; null texts have
    no bytes but the one; null ids are like any other; repeated rows follow one another; an empty table gives no rows.
    Weights are relative; sources without one get default_weight; a source with a weight that is not positive gets 1e-9.
    Every source is scheduled by its exact weight, however many there are; only `resolution` rounds weights.
    Columns of the five names are replaced, others stay.
    """
    spark = docs.sparkSession
    held = pack(docs, doc=doc, text=text, source=source)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    rows = held.frame.withColumns({"s": F.coalesce("source", F.lit("")), "b": size, "h": F.xxhash64("doc", "text")})
    totals = rows.groupBy("s").agg(F.sum("b").alias("b"), F.count("*").alias("n")).collect()  # a row for each source
    p = shares({r.s: max(weights.get(r.s, default_weight), 1e-9) for r in totals} or {"": 1.0}, resolution)
    phases, patterns, slots = schedule(p, {r.s: -(-r.b // block_bytes) for r in totals})
    k = salt_count(sum(r.n for r in totals))
    rows = rows.withColumn("k", F.pmod(F.xxhash64("h"), F.lit(k)))
    rows = running_sum(rows, ["s"], "k", ["h", "doc"], "b", "start").withColumn("block", F.expr(f"start div {int(block_bytes)}"))
    # neither table has more rows than there are blocks; a period that repeats is there once
    small = lambda df, rows: F.broadcast(df) if len(rows) <= BROADCAST_ROWS else df
    ph = spark.createDataFrame(phases, "ps string, phase int, lo long, hi long, first long, share long, period long")
    pt = spark.createDataFrame(patterns, "pphase int, pps string, pi long, off long")
    rows = rows.join(small(ph, phases), (F.col("s") == F.col("ps")) & (F.col("block") >= F.col("lo")) & (F.col("block") < F.col("hi")))
    rows = rows.withColumn("i", F.expr("(block - lo) % share"))
    rows = rows.join(small(pt, patterns), (F.col("phase") == F.col("pphase")) & (F.col("s") == F.col("pps")) & (F.col("i") == F.col("pi")))
    slot = F.col("first") + F.expr("(block - lo) div share") * F.col("period") + F.col("off")
    new = {"mix_source": F.col("s"), "block": F.col("block"), "slot": slot, "start": F.col("start"), "phase": F.col("phase")}
    return unpack(held, rows, new), slots


def write_order(mixed: DataFrame, slots: int, parts: int) -> DataFrame:
    """mixed dealt to `parts` partitions by ranges of slots and sorted: its files hold the mix in order."""
    held = pack(mixed, slot="slot", start="start")
    part = F.expr(f"cast(slot * {int(parts)} div {max(1, int(slots))} as int)")
    dealt = held.frame.withColumn("part", part).repartitionById(parts, F.col("part")).sortWithinPartitions("slot", "start")
    return unpack(held, dealt, {})
