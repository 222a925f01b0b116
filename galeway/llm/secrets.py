"""Secret scans over an incremental ledger of content-addressed texts."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galeway.llm.common import materialize, pack, unpack

#: rule version -> kind -> (pattern, group that must have the length, least length). The order ranks kinds that start together.
RULES = {
    "base-1": {
        "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
        "access": (r"AKIA[A-Z0-9]+", 0, 16),
        "hex": (r"[0-9a-f]{32,}", 0, 32),  # the same as longer matches of [0-9a-f]+
    },
    "more-1": {
        "key": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
        "github": (r"gh[oprsu]_[A-Za-z0-9]+", 0, 40),
        "slack": (r"xox[abprs]-[A-Za-z0-9-]+", 0, 24),
        "jwt": (r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    },
}
KINDS = {kind: rule for rules in RULES.values() for kind, rule in rules.items()}
BASE = list(RULES["base-1"])
SPAN = "struct<start:bigint,rank:int,kind:string,end:bigint>"
LEDGER = f"sha string, rule_version string, spans array<{SPAN}>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once."""
    return F.transform(F.array(value), body)[0]


def running(x: Column) -> Column:
    """The sum of what stands before each element of an array of longs.

    A fold copies what it has at each step, so it goes over blocks of the root of the size, and over their sums.
    """
    zero = F.expr("array(0L)")
    grow = lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1) + v))

    def of_blocks(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda acc, v: acc + v))
        return _let(F.aggregate(sums, zero, grow), lambda starts: F.flatten(F.transform(blocks, lambda b, i: F.slice(F.aggregate(b, F.array(starts[i]), grow), F.lit(1), F.size(b)))))

    def cut(v: Column) -> Column:
        return _let(F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(v))).cast("int")), lambda k: _let(
            F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / k).cast("int")), lambda b: F.slice(v, b * k + 1, k)), of_blocks))

    return _let(x, lambda v: F.when(F.size(v) > 0, cut(v)).otherwise(F.expr("cast(array() as array<bigint>)")))


def _spans(text: Column, kind: str) -> Column:
    """Matches of one kind with code point offsets: lengths of the pieces between them and their own add up to their starts."""
    pattern, group, least = KINDS[kind]
    rank = list(KINDS).index(kind)
    lengths = lambda x: F.transform(x, lambda v: F.length(v).cast("long"))
    gaps, sizes = lengths(F.split(text, pattern, -1)), lengths(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    judged = lengths(F.regexp_extract_all(text, F.lit(pattern), F.lit(group))) if group else None

    def spans(s: Column) -> Column:
        each = F.transform(s["at"], lambda v, i: F.struct(
            (v + s["gap"][i]).alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (v + s["gap"][i] + s["size"][i]).alias("end"), s["judged"][i].alias("n")))
        good = F.filter(each, lambda x: x["n"] >= least)
        return F.transform(good, lambda x: F.struct(x["start"], x["rank"], x["kind"], x["end"]).cast(SPAN))

    def sized(s: Column) -> Column:
        both = F.zip_with(F.slice(s["gap"], F.lit(1), F.size(s["size"])), s["size"], lambda a, b: a + b)
        return _let(F.struct(s["gap"].alias("gap"), s["size"].alias("size"), (s["judged"] if judged is not None else s["size"]).alias("judged"), running(both).alias("at")), spans)

    found = F.struct(gaps.alias("gap"), sizes.alias("size"), *([judged.alias("judged")] if judged is not None else []))
    return F.when(text.rlike(pattern), _let(found, sized)).otherwise(F.expr(f"cast(array() as array<{SPAN}>)"))


def scan(text: Column, kinds: Iterable[str] = BASE) -> Column:
    """Spans of these kinds in a text, by start, then in the order of RULES. The work follows the number of matches to the power 1.5 at most."""
    return F.array_sort(F.concat(*(_spans(text, k) for k in kinds)))


def update_ledger(versions: DataFrame, ledger: DataFrame | None = None, rule_versions: Iterable[str] = tuple(RULES), path: str = "doc_id", text: str = "text") -> DataFrame:
    """Ledger rows (sha, rule_version, spans) for the pairs of blob and rule version that `ledger` lacks.

    The address of a blob is the SHA-256 of the text; a null text is the empty one. Of all rows with one blob, whatever their
    paths, one text is scanned: copies are put together before and after they are dealt out.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    blobs = versions.select(F.sha2(body, 256).alias("sha"), body.alias("body")).groupBy("sha").agg(F.first("body").alias("body"))
    missing = F.array(*(F.lit(v) for v in rule_versions))
    if ledger is not None:
        seen = ledger.groupBy("sha").agg(F.collect_set("rule_version").alias("seen"))
        blobs = blobs.join(seen, "sha", "left")
        missing = F.array_except(missing, F.coalesce("seen", F.expr("cast(array() as array<string>)")))
    pairs = blobs.select("sha", "body", F.explode(missing).alias("rule_version"))
    spans = F.lit(None).cast(f"array<{SPAN}>")
    for v in rule_versions:
        spans = F.when(F.col("rule_version") == v, scan(F.col("body"), RULES[v])).otherwise(spans)
    return pairs.select("sha", "rule_version", spans.alias("spans"))


class Ledger:
    """A ledger in a folder that all executors share: read, and only ever appended to."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(LEDGER).parquet(self.path)
        except AnalysisException:
            return None

    def update(self, versions: DataFrame, rule_versions: Iterable[str] = tuple(RULES), path: str = "doc_id", text: str = "text") -> DataFrame:
        """The whole ledger, after the pairs it lacked were scanned and appended."""
        update_ledger(versions, self.read(), rule_versions, path, text).write.mode("append").option("compression", "zstd").parquet(self.path)
        return self.read()


def findings(versions: DataFrame, ledger: DataFrame, rule_versions: Iterable[str] = tuple(RULES), path: str = "doc_id", text: str = "text") -> DataFrame:
    """The columns of `versions` but for the text, and sha and spans: what the ledger has of each row's text.

    Every row keeps its place, repeated rows and null paths too; a null or empty text has no spans; an empty table gives no rows;
    ties between spans go by the order of RULES; a text of any length is scanned whole, in one task. Columns sha and spans are replaced, others stay.
    """
    held = pack(versions, path=path, text=text)
    rows = held.frame.withColumn("sha", F.sha2(F.coalesce("text", F.lit("")), 256)).drop("text")
    known = ledger.where(F.col("rule_version").isin(*rule_versions) & (F.size("spans") > 0)).dropDuplicates(["sha", "rule_version"])
    known = known.groupBy("sha").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("found")).select(F.col("sha").alias("known"), "found")
    out = rows.join(known, F.col("sha") == F.col("known"), "left")
    held.names.pop(text)
    return unpack(held, out, {"sha": F.col("sha"), "spans": F.coalesce("found", F.expr(f"cast(array() as array<{SPAN}>)"))})


def find_secrets(versions: DataFrame, ledger: DataFrame | None = None, rule_versions: Iterable[str] = tuple(RULES), path: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(findings of every row of `versions`, the ledger with the new blobs), without a lasting ledger."""
    new = materialize(update_ledger(versions, ledger, rule_versions, path, text))
    whole = new if ledger is None else ledger.select(new.columns).unionByName(new)
    return findings(versions, whole, rule_versions, path, text), whole


def digest(found: DataFrame, path: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the SHA-256 of their joined spans, and all spans joined."""
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select(path, *(count(k) for k in BASE), F.sha2(text(base), 256).alias("base_sha256"), text("spans").alias("spans"))
