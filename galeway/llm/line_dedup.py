"""Line dedup by winnowing over line hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from galeway.llm.common import WORD, materialize, pack, unpack

#: A repeated run of lines is deleted if it has so many words.
MIN_WORDS = 50


def _units(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """Lines that hold a word, with the words before them (s) and up to their end (e) in their document."""
    t = F.col(text)
    lines = docs.select(F.col(doc).alias("doc"), F.xxhash64(t).alias("th"), F.posexplode(F.split(t, "\n", -1)).alias("pos", "line"))
    lines = lines.select(
        "doc", "th", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("b"), "line").alias("h2"),
        F.regexp_count("line", F.lit(WORD)).cast("long").alias("nw"),
    ).where("nw > 0")
    each = Window.partitionBy("doc", "th").orderBy("pos")
    # one exchange: rows that repeat (document and text equal) are one document
    lines = lines.repartition("doc", "th").dropDuplicates(["doc", "th", "pos"])
    return lines.withColumn("e", F.sum("nw").over(each.rowsBetween(Window.unboundedPreceding, 0))).withColumn("s", F.col("e") - F.col("nw"))


def _windows(units: DataFrame, min_words: int) -> DataFrame:
    """The shortest runs of min_words or more from each line on, and those up to each line, with their minimum.

    A run of min_words or more contains the shortest one from its first line on; so it contains
    that one's minimum (the last of equal ones), whichever document it is in: a guaranteed fingerprint.
    """
    ahead = Window.partitionBy("doc", "th").orderBy("s").rangeBetween(0, min_words - 1)
    back = Window.partitionBy("doc", "th").orderBy("e").rangeBetween(-(min_words - 1), 0)

    def over(w):
        return F.struct(
            F.sum("nw").over(w).alias("nw"), F.min("pos").over(w).alias("lo"), F.max("pos").over(w).alias("hi"),
            F.min(F.struct("h1", (-F.col("pos")).alias("n"))).over(w).alias("m"),
            F.collect_list(F.struct("h1", "h2")).over(w).alias("hs"),
        )

    both = units.select("doc", "th", over(ahead).alias("a"), over(back).alias("b"))
    w = both.select("doc", "th", F.explode(F.array(F.col("a"), F.when(F.col("b.lo") < F.col("b.hi"), F.col("b")))).alias("w")).where(F.col("w.nw") >= min_words)  # a single line is its own window both ways
    return w.select(
        "doc", "th", "w.lo", "w.hi", F.col("w.m.h1").alias("mark"), (-F.col("w.m.n")).alias("at"),
        F.xxhash64("w.hs").alias("k1"), F.xxhash64(F.lit("b"), "w.hs").alias("k2"),
    )


def repeated_runs(docs: DataFrame, doc: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Runs of lines to delete: doc, th (hash of the text), lo, hi (line numbers from 0).

    Fingerprints that occur at one place only cannot lie in a repeated run, so their windows go
    first. Windows of the other fingerprints are joined on their lines; all but the first in the
    order of documents and lines are runs to delete, and their union extends every match both
    ways as far as min_words lines agree.
    """
    # written once and read again: each join below has plain scans under both exchanges, so a hot key is split at run time
    windows = materialize(_windows(_units(docs, doc, text), min_words))
    marks = (
        windows.groupBy("mark").agg(F.min(F.struct("doc", "th", "at")).alias("x"), F.max(F.struct("doc", "th", "at")).alias("y"))
        .where("x != y").select("mark")
    )
    marks = materialize(marks)
    # used twice below: written, so that the windows are dealt by fingerprint only once
    found = materialize(windows.join(marks, "mark", "left_semi").select("doc", "th", "lo", "hi", "k1", "k2"))
    place = F.struct("doc", "th", "lo", "hi")
    first = found.groupBy("k1", "k2").agg(F.min(place).alias("f"), F.max(place).alias("l")).where("f != l").select("k1", "k2", "f")
    first = materialize(first)
    same = F.col("doc").eqNullSafe(F.col("f.doc")) & (F.col("th") == F.col("f.th"))
    # where a run overlaps its own first occurrence, that one stays whole
    later = found.join(first, ["k1", "k2"]).where(F.struct("doc", "th", "lo", "hi") != F.col("f"))
    later = later.select("doc", "th", F.when(same, F.greatest("lo", F.col("f.hi") + 1)).otherwise(F.col("lo")).alias("lo"), "hi")
    return later.where("lo <= hi")


def dedup_lines(docs: DataFrame, doc: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the later copies of repeated runs of lines deleted, and n_lines, n_removed.

    A run is a sequence of lines (split at \\n) of min_words words or more together; the first one
    in the order of (doc, text hash, line) stays. Blank lines don't count, but those inside a run
    go with it. Null texts stay null with no lines; empty ones have one line; null ids sort first;
    rows equal in id and text are one document, and all get the same result; an empty table gives none. The lines of a text of any
    length are compared whole; one document's lines are in one task. Columns n_lines and n_removed are replaced, others stay.
    """
    held = pack(docs, doc=doc, text=text)
    runs = repeated_runs(held.frame, "doc", "text", min_words).dropDuplicates(["doc", "th", "lo", "hi"])
    cut = runs.groupBy("doc", "th").agg(F.flatten(F.collect_list(F.sequence("lo", "hi"))).alias("cut"))
    cut = cut.select(F.col("doc").alias("c_doc"), F.col("th").alias("c_th"), F.array_distinct("cut").alias("cut"))
    rows = held.frame.withColumn("th", F.xxhash64("text"))
    rows = rows.join(cut, F.col("doc").eqNullSafe(F.col("c_doc")) & (F.col("th") == F.col("c_th")), "left")
    lines = F.split("text", "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("cut"))
    new = F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")
    return unpack(held, rows, {
        text: F.when(F.col("cut").isNull(), F.col("text")).otherwise(new),
        "n_lines": F.coalesce(F.when(F.col("text").isNotNull(), F.size(lines)), F.lit(0)).cast("long"),
        "n_removed": F.coalesce(F.when(F.col("cut").isNotNull(), F.size("cut")), F.lit(0)).cast("long"),
    })
