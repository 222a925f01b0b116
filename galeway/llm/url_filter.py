"""URL filters: host-suffix and path-prefix expressions joined on short hash prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galeway.llm.common import ascii_lower, pack, unpack

#: (action, host, path)
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: Verdict where no rule fits.
DEFAULT = "allow"
#: Hex digits of the digest that the join compares first (4 bytes).
PREFIX = 8
#: Rules are broadcast up to this number (some 20 MB), else joined by shuffle.
BROADCAST_RULES = 100_000


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): what stands between :// and the first of / ? #, in lower case (A-Z); then up to ? or #."""
    rest = F.coalesce(F.when(F.locate("://", url) > 0, F.substring_index(url, "://", 1)), F.lit(""))
    after = F.when(F.locate("://", url) > 0, F.substring(url, F.length(rest) + 4, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(after, F.length(host) + 1, F.length(after)), r"^[^?#]*", 0)
    return ascii_lower(host), path


def rule_table(rules: DataFrame) -> DataFrame:
    """action, host, path -> with the expression (host and path up to its last /) and its digest."""
    key = F.regexp_extract("path", r"^.*/", 0)
    r = rules.select("action", ascii_lower(F.col("host")).alias("r_host"), F.col("path").alias("r_path"), key.alias("r_key"))
    digest = F.sha2(F.concat("r_host", "r_key"), 256)
    return r.withColumns({"digest": digest, "prefix": F.substring(digest, 1, PREFIX), "rule": F.concat("r_host", "r_path")})


def expressions(host: Column, path: Column, labels: Column | int, depth: Column | int) -> Column:
    """All (host suffix + path prefix) of at most `labels` host labels and `depth` slashes; "" and whole labels count."""
    parts, dirs = F.split(host, r"\.", -1), F.split(path, "/", -1)
    n, d = F.size(parts), F.size(dirs) - 1
    hosts = F.transform(F.sequence(F.lit(1), F.least(n, F.lit(labels))), lambda i: F.array_join(F.slice(parts, n - i + 1, i), "."))
    paths = F.transform(
        F.sequence(F.lit(0), F.least(d, F.lit(depth))),
        lambda i: F.when(i == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(dirs, F.lit(1), i), "/"), F.lit("/"))),
    )
    return F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, p))))


def judge(pages: DataFrame, rules: DataFrame | None = None, default: str = DEFAULT, url: str = "url") -> DataFrame:
    """pages with host, path, rule and verdict.

    A rule fits its host and all subdomains where the path starts with the rule's; the longest
    rule wins, and block before allow among equally long ones. A url that is null or has no ://
    has an empty host and path, which no rule fits; ties and repeated rows are judged alike, and every row is kept;
    an empty table gives none. Equal urls are judged once. A url of any length is judged whole: its expressions
    go no deeper than the deepest rule, which loses none. Columns of the names host, path, rule and verdict are replaced, others stay.
    """
    spark = pages.sparkSession
    rules = rules if rules is not None else spark.createDataFrame(RULES, "action string, host string, path string")
    table = rule_table(rules)
    most = table.agg(
        F.count("*").alias("n"), F.coalesce(F.max(F.size(F.split("r_host", r"\."))), F.lit(1)).alias("labels"),
        F.coalesce(F.max(F.size(F.split("r_key", "/")) - 1), F.lit(0)).alias("depth"),
    ).first()
    held = pack(pages, url=url)
    host, path = split_url(F.col("url"))
    rows = held.frame.withColumns({"host": host, "path": path})
    sites = rows.select("host", "path").distinct()
    e = sites.select("host", "path", F.explode(F.array_distinct(expressions(F.col("host"), F.col("path"), most.labels, most.depth))).alias("expr"))
    e = e.withColumn("u_digest", F.sha2("expr", 256)).withColumn("u_prefix", F.substring("u_digest", 1, PREFIX))
    side = F.broadcast(table) if most.n <= BROADCAST_RULES else table
    hits = e.join(side, F.col("u_prefix") == F.col("prefix"))
    # digests confirm the expression; the strings settle what a digest over a joined host and path can't
    fits = (F.col("u_digest") == F.col("digest")) & F.col("path").startswith(F.col("r_path")) & ((F.col("host") == F.col("r_host")) | F.col("host").endswith(F.concat(F.lit("."), "r_host")))
    best = hits.where(fits).groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), (F.col("action") == "block").alias("b"), "rule", "action")).alias("best"))
    best = best.select(F.col("host").alias("b_host"), F.col("path").alias("b_path"), "best")
    out = rows.join(best, (F.col("host") == F.col("b_host")) & (F.col("path") == F.col("b_path")), "left")
    return unpack(held, out, {"host": F.col("host"), "path": F.col("path"), "rule": F.col("best.rule"), "verdict": F.coalesce("best.action", F.lit(default))})
