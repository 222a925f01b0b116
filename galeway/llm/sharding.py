"""Sharding by balanced label propagation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galeway.llm.common import discard, materialize, running_sum, salt_count

#: Rounds of propagation at most, and how far the linked units of a shard may outgrow its share meanwhile.
ROUNDS, SLACK = 8, 0.1
#: Movers are admitted by gain (eighths, see _gain), then by hash.
GAINS, HASHES = 24, 8
#: Lines of so many bytes link the documents that hold them.
LINE_BYTES = 16
#: A group of equal texts is placed in units of at most this part of a shard.
UNIT = 1 / 16


def _gain(v: Column) -> Column:
    """Gains over nothing as whole numbers up to GAINS, coarser where they are large."""
    return F.least(F.lit(GAINS), F.ceil(F.log2(1 + v) * 8)).cast("int")


def incidences(base: DataFrame, units: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """(u, key): the units that share something, by what they share with others: a line, a link of the caller, a group.

    base: doc, g1, g2, lines; units: u, g1, g2, j, of. No pairs are formed, so what is shared by many costs no more than its members.
    """
    lines = base.groupBy("g1", "g2").agg(F.first("lines").alias("lines")).select("g1", "g2", F.explode("lines").alias("key"))
    if links is not None:
        pair = F.xxhash64(F.lit("link"), "src", "dst")
        ends = links.select("src", "dst").select(pair.alias("key"), F.explode(F.array("src", "dst")).alias("doc"))
        lines = lines.unionByName(ends.join(base.select("doc", "g1", "g2"), "doc").select("g1", "g2", "key"))
    shared = lines.groupBy("key").agg(F.min(F.struct("g1", "g2")).alias("a"), F.max(F.struct("g1", "g2")).alias("b")).where("a != b").select("key")
    lines = materialize(lines).join(materialize(shared), "key", "left_semi")
    each = units.select("u", "g1", "g2", "of")
    own = each.where("of > 1").select("u", F.xxhash64(F.lit("group"), "g1", "g2").alias("key"))
    return materialize(each.join(lines, ["g1", "g2"]).select("u", "key").unionByName(own))


def holders(at: DataFrame, n_shards: int) -> DataFrame:
    """key, all, c0, c1, ...: members of the units that share something, by label. at: u, key, label, n."""
    return at.groupBy("key").agg(F.sum("n").alias("all"), *(F.sum(F.when(F.col("label") == k, F.col("n")).otherwise(0)).alias(f"c{k}") for k in range(n_shards)))


def votes(at: DataFrame, held: DataFrame, n_shards: int) -> DataFrame:
    """u, v0, v1, ...: for each label, the mean share of members that the other holders of what a unit shares have there, summed."""
    rest = F.greatest(F.lit(1), F.col("all") - F.col("n"))
    mine = lambda k: F.when(F.col("label") == k, F.col("n")).otherwise(0)
    return at.join(held, "key").groupBy("u").agg(*(F.sum((F.col(f"c{k}") - mine(k)) / rest).alias(f"v{k}") for k in range(n_shards)))


def admitted(wishes: list, size: dict[int, int], cap: int) -> set[tuple[int, int, int, int]]:
    """(label, to, gain, hash) of the wishes (with n) that are granted: the best gains first, while `to` has room; those that leave make room."""
    left, out, size = sorted(wishes, key=lambda r: (-r.gain, r.label, r.to, r.hb)), set(), dict(size)
    while True:
        rest = []
        for r in left:
            if size.get(r.to, 0) + r.n <= cap:
                size[r.to], size[r.label] = size.get(r.to, 0) + r.n, size[r.label] - r.n
                out.add((r.label, r.to, r.gain, r.hb))
            else:
                rest.append(r)
        if len(rest) == len(left):
            return out
        left = rest


def propagate(state: DataFrame, shared: DataFrame, total: int, n_shards: int, rounds: int = ROUNDS, slack: float = SLACK) -> DataFrame:
    """(u, label, n): linked units moved towards the shards of those they share something with.

    state: u, label, n of the linked units; total: members of all units. Others may stand anywhere, so they take no room meanwhile.

    In a round one half of the units, by a hash, ask for the label with the most votes, so that few neighbours just change places. Wishes are granted in order of gain while a label has room. What decides is a
    histogram of at most labels x labels x GAINS x HASHES rows; no unit or document reaches the driver.
    """
    cap, idle = math.ceil(total / n_shards * (1 + slack)), 0
    for r in range(rounds):
        at = materialize(shared.join(state, "u"))
        held = materialize(holders(at, n_shards))  # plain scans under the join, which a hot key can then be split in
        v = state.join(votes(at, held, n_shards), "u")
        every = F.array(*(F.struct(F.col(f"v{k}").alias("v"), F.lit(-k).alias("l")) for k in range(n_shards)))
        turn = F.pmod(F.xxhash64("u", F.lit(r)), F.lit(2)) == 0
        v = v.select("u", "label", "n", F.element_at(every, F.col("label") + 1)["v"].alias("here"), F.array_max(every).alias("best")).where(turn & (F.col("best.v") > F.col("here") + 1e-9))
        asked = v.select("u", "label", "n", (-F.col("best.l")).alias("to"), _gain(F.col("best.v") - F.col("here")).alias("gain"), F.pmod(F.xxhash64("u"), F.lit(HASHES)).cast("int").alias("hb"))
        asked = materialize(asked)
        size = {x.label: x.n for x in state.groupBy("label").agg(F.sum("n").alias("n")).collect()}
        ok = admitted(asked.groupBy("label", "to", "gain", "hb").agg(F.sum("n").alias("n")).collect(), size, cap)
        idle = 0 if ok else idle + 1
        if ok:
            grants = state.sparkSession.createDataFrame(sorted(ok), "label int, to int, gain int, hb int")
            moves = asked.join(F.broadcast(grants), ["label", "to", "gain", "hb"]).select("u", "to")
            new = materialize(state.join(moves, "u", "left").select("u", F.coalesce("to", "label").alias("label"), "n"))
            discard(state)
            state = new
        for used in (at, held, asked):
            discard(used)
        if idle == 2:
            break
    return state


def shard(docs: DataFrame, n_shards: int = 16, links: DataFrame | None = None, doc: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """doc, size, text_crc32, law, shard, slot, grown_shard: every row in one of n_shards shards.

    Law `rows`: counts are at most one apart. Documents are linked where their texts are equal or share a line of LINE_BYTES or more; `links`
    (src, dst) may add more between ids. Groups of equal texts start in shards by their hash (large ones in several) and move by
    propagate(). Then each shard keeps its documents, linked ones first, up to its exact count, and only the surplus moves to shards that lack
    some. slot counts from 0 in each shard. A null text is empty in size and checksum, but equal only
    to null ones; null ids and repeated rows are rows like any other; a text of any length is one row; an empty table gives no rows.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.array_distinct(F.transform(F.filter(F.split(t, "\n", -1), lambda x: F.octet_length(x) >= LINE_BYTES), lambda x: F.xxhash64(x)))
    base = docs.select(
        F.col(doc).alias("doc"), (F.octet_length(t).cast("long") + 1).alias("size"), F.crc32(t).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("g1"), F.xxhash64(F.lit("b"), text).alias("g2"), lines.alias("lines"),
    )
    base = materialize(base)
    total = base.count()
    k = salt_count(total)
    most = max(1, int(total * UNIT / n_shards))
    groups = base.groupBy("g1", "g2").agg(F.count("*").alias("gn"))
    units = groups.withColumn("of", F.expr(f"cast((gn + {most - 1}) div {most} as int)")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
    n = F.least(F.lit(most).cast("long"), F.col("gn") - F.col("j") * most)
    units = units.select(F.xxhash64("g1", "g2", "j").alias("u"), "g1", "g2", "j", "of", n.alias("n"), F.pmod(F.xxhash64("g1") + F.expr(f"j * {most}L * {n_shards} div {max(1, total)}"), F.lit(n_shards)).cast("int").alias("label"))
    units = materialize(units)
    shared = incidences(base, units, links)
    linked = materialize(shared.select("u").distinct())
    state = propagate(materialize(units.join(linked, "u", "left_semi").select("u", "label", "n")), shared, total, n_shards, rounds)

    # units of each label in a row, linked ones first
    rest = units.join(linked, "u", "left_anti").select("u", "label", "n", F.lit(k).alias("after"))
    placed = materialize(state.select("u", "label", "n", F.lit(0).alias("after")).unionByName(rest))
    size = {x.label: x.n for x in placed.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    placed = placed.withColumn("bucket", F.pmod("u", F.lit(k)) + F.col("after"))
    placed = running_sum(placed, ["label"], "bucket", ["u"], "n", "at").select("u", "label", "at")
    placed = materialize(units.select("u", "g1", "g2", "j").join(placed, "u").drop("u"))
    # members of a group are counted by salt, so that a hot one has many tasks
    dealt = base.drop("lines").withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(k))).repartition("g1", "g2", "salt")
    ranked = dealt.withColumn("r", F.row_number().over(Window.partitionBy("g1", "g2", "salt").orderBy("doc")) - 1)
    counts = dealt.groupBy("g1", "g2", "salt").agg(F.count("*").alias("c"))
    before = Window.partitionBy("g1", "g2").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("s_at", F.coalesce(F.sum("c").over(before), F.lit(0)))
    rows = ranked.join(starts.select("g1", "g2", "salt", "s_at"), ["g1", "g2", "salt"]).withColumn("r", F.col("s_at") + F.col("r"))
    rows = rows.withColumn("j", F.expr(f"cast(r div {most} as int)")).join(placed, ["g1", "g2", "j"]).withColumn("p", F.col("at") + F.expr(f"r % {most}"))
    # a row for each shard: what it keeps, and which of the surplus it takes
    spare, taken = [], []
    want = dict.fromkeys(range(n_shards), total // n_shards)
    for label in sorted(want, key=lambda x: (-size.get(x, 0), x))[: total % n_shards]:
        want[label] += 1
    over = under = 0
    for label in range(n_shards):
        have = size.get(label, 0)
        spare.append((label, want[label], over))
        over += max(0, have - want[label])
        if have < want[label]:
            taken.append((label, under, under + want[label] - have, have))
            under += want[label] - have
    spark = docs.sparkSession
    spare = spark.createDataFrame(spare, "label int, keeps long, first long")
    taken = spark.createDataFrame(taken, "taker int, lo long, hi long, have long")
    rows = rows.join(F.broadcast(spare), "label").withColumn("extra", F.when(F.col("p") >= F.col("keeps"), F.col("first") + F.col("p") - F.col("keeps")))
    rows = rows.join(F.broadcast(taken), (F.col("extra") >= F.col("lo")) & (F.col("extra") < F.col("hi")), "left")
    return rows.select(
        F.col("doc").alias(doc), "size", "text_crc32", F.lit("rows").alias("law"), F.coalesce("taker", "label").alias("shard"),
        F.coalesce(F.col("have") + F.col("extra") - F.col("lo"), F.col("p")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
