"""SimHash near-dedup with a Gray-ordered hierarchical index."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galeway.llm.chunks import release
from galeway.llm.common import materialize, pack, small_batches, unpack
from galeway.llm.graph import components
from galeway.llm.quality import steps

SEED = 42
#: Leaves of the index, and children of an upper node.
FAN = 16
#: Buckets above this size are divided anew, so many times at most.
BUCKET, LEVELS = 20_000, 4
#: near_duplicates(): texts of a bucket that one task compares at most; larger buckets are compared block by block.
MEMBERS = 100_000
#: Pairs that are compared at once.
PAIRS = 1 << 21
#: Shingles of the texts that one task compares: larger families are compared block by block.
FAMILY = 1_000_000
#: Families of short texts are spread as well: a block for so many texts, so many blocks at most.
SPREAD, SPREAD_BLOCKS = 500, 8
#: near_duplicates(): words of sketch, least bits of a table, and bits of the first word in which candidates may differ.
SKETCH, BITS, RADIUS = 4, 16, 18
#: Texts to a value of a table's bits, and the chance that two texts at the least similarity are candidates.
CROWD, CHANCE = 16, 0.992


def shingle_hashes(body: bytes, n: int) -> np.ndarray:
    """XXH64 (seed 42) of the n-word shingles, repeats included; of the whole sequence if it is shorter; none without words."""
    from xxhash import xxh64_digest

    words = body.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    m = max(1, len(words) - n + 1)
    hs = [xxh64_digest(joined[a:b], SEED) for a, b in zip(starts[:m].tolist(), ends[-m:].tolist(), strict=True)]
    return np.frombuffer(b"".join(hs), ">u8").astype(np.uint64)


def majority(hashes: list[np.ndarray]) -> np.ndarray:
    """For each array of hashes: a word whose bits are set in over half of them (0 for an empty one)."""
    out = np.zeros(len(hashes), np.uint64)
    full = [i for i, h in enumerate(hashes) if len(h)]
    if full:
        sizes = np.array([len(hashes[i]) for i in full])
        bits = np.unpackbits(np.concatenate([hashes[i] for i in full]).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones = np.add.reduceat(bits, np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0, dtype=np.uint32)
        out[full] = np.packbits(2 * ones > sizes[:, None], axis=1).view(">u8")[:, 0]
    return out


def remix(h: np.ndarray, k: int) -> np.ndarray:
    """Another hash of the same shingles (k > 0)."""
    if not k:
        return h
    h = h ^ np.uint64((0x9E3779B97F4A7C15 * k) & (2**64 - 1))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprint(text: Column, shingle: int = 3) -> Column:
    """The 64-bit SimHash of each whole text as a signed long; a null text has no words."""

    @F.pandas_udf("long")
    def kernel(t: pd.Series) -> pd.Series:
        out = [majority([shingle_hashes(b, shingle) for b in part]) for part in steps(t)]
        return pd.Series(np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64))

    return kernel(text)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Where a word stands in Gray order, in which neighbours differ in one bit."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


def _blocks(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for i in range(0, len(a), PAIRS // FAN**2):
        yield a[i : i + PAIRS // FAN**2], b[i : i + PAIRS // FAN**2]


class GrayIndex:
    """Words in Gray order; each upper node holds the bits that all words below share (mask and pattern)."""

    def __init__(self, x: np.ndarray):
        self.levels, self.x = [(np.full(len(x), 2**64 - 1, np.uint64), x)], x
        while len(self.levels[-1][0]) > 1:
            mask, pattern = self.levels[-1]
            at = np.arange(0, len(mask), FAN)
            any_, all_ = np.bitwise_or.reduceat(pattern, at), np.bitwise_and.reduceat(pattern, at)
            shared = np.bitwise_and.reduceat(mask, at) & ~(any_ ^ all_)
            self.levels.append((shared, all_ & shared))

    def pairs(self, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(i, j, differing bits) for all i < j with k differing bits at most, in blocks.

        Pairs of nodes whose shared bits already differ in more than k places are pruned with all below.
        """
        zero = np.zeros(1, np.int64)
        stack = [(len(self.levels) - 1, zero, zero)]
        while stack:
            level, a, b = stack.pop()
            mask, pattern = self.levels[level]
            d = np.bitwise_count((pattern[a] ^ pattern[b]) & mask[a] & mask[b])
            a, b, d = a[d <= k], b[d <= k], d[d <= k]
            if level == 0:
                yield a[a < b], b[a < b], d[a < b]
                continue
            n = len(self.levels[level - 1][0])
            for pa, pb in _blocks(a, b):
                ca = (pa[:, None, None] * FAN + np.arange(FAN)[:, None]).repeat(FAN, 2).ravel()
                cb = (pb[:, None, None] * FAN + np.arange(FAN)[None, :]).repeat(FAN, 1).ravel()
                ok = (ca < n) & (cb < n) & (ca <= cb)
                stack.append((level - 1, ca[ok], cb[ok]))


def _joined(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[int]:
    """Positions of the pairs that connect two parts; root (parents) is updated."""
    took = []

    def find(v: int) -> int:
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    for n, (a, b) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
            took.append(n)
    return took


def _flat(root: np.ndarray) -> np.ndarray:
    while True:
        up = root[root]
        if (up == root).all():
            return root
        root = up


def spanning(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of a spanning forest of all links at k differing bits or fewer, nearest pairs first within a block."""
    return _spanning(x, k)[:2]


def _spanning(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """spanning(), and the words with a link that the forest leaves out."""
    order = np.argsort(gray_rank(x), kind="stable")
    index, root, out = GrayIndex(x[order]), np.arange(len(x)), []
    links = np.zeros(len(x), np.int64)  # of each word, less those of the forest
    for i, j, d in index.pairs(k):
        links[order] += np.bincount(i, minlength=len(x)) + np.bincount(j, minlength=len(x))
        flat = _flat(root)
        new = flat[i] != flat[j]
        i, j, d = i[new], j[new], d[new]
        for near in range(k + 1):  # nearest first: a minimum spanning forest of the block
            at = np.flatnonzero(d == near)
            while len(at):
                part = at[:4096]
                took = part[_joined(root, i[part], j[part])]
                out.append((order[i[took]], order[j[took]]))
                flat = _flat(root)
                at = at[4096:]
                at = at[flat[i[at]] != flat[j[at]]]
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j = np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])
    return i, j, np.flatnonzero(links > np.bincount(i, minlength=len(x)) + np.bincount(j, minlength=len(x)))


def bucket_edges(key: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spanning pairs (i, j) inside each run of equal keys, and the positions with links that they leave out.

    Short runs are compared together, position by position, and leave none out.
    """
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(first, len(key)))
    out_i, out_j, left = [], [], [np.zeros(0, np.int64)]
    small = np.flatnonzero((size > 1) & (size <= FAN))
    for step in range(1, FAN):
        runs = small[size[small] > step]
        if not len(runs):
            break
        i = np.repeat(first[runs], size[runs] - step) + np.concatenate([np.arange(s - step) for s in size[runs]])
        near = np.bitwise_count(x[i] ^ x[i + step]) <= k
        out_i.append(i[near])
        out_j.append(i[near] + step)
    for r in np.flatnonzero(size > FAN):
        i, j, rest = _spanning(x[first[r] : first[r] + size[r]], k)
        out_i.append(i + first[r])
        out_j.append(j + first[r])
        left.append(rest + first[r])
    none = [np.zeros(0, np.int64)]
    return np.concatenate(out_i or none), np.concatenate(out_j or none), np.concatenate(left)


def _edges(k: int, marks: bool = False):
    """Batches of (key, x, node), sorted by key -> (a, b): links of the buckets; with `marks` also (node, null, key) for nodes with links left out."""

    def emit(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j, left = bucket_edges(pdf.key.to_numpy(), pdf.x.to_numpy(np.int64).view(np.uint64), k)
        node = pdf.node.to_numpy()
        out = pd.DataFrame({"a": node[i], "b": node[j]})
        if not marks:
            return out
        more = pd.DataFrame({"a": node[left], "b": None, "key": pd.array(pdf.key.to_numpy()[left], "Int64")})
        return pd.concat([out.assign(key=pd.array([None] * len(out), "Int64")), more], ignore_index=True)

    return _by_key(emit)


def _by_key(emit):
    """emit() over batches sorted by key, whole keys at a time: the last key of a batch waits for the next batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, last = [], None

        for pdf in batches:
            if not len(pdf):
                continue
            end = pdf.key.iloc[-1]
            cut = int(pdf.key.searchsorted(end))
            if end == last and cut == 0:
                held.append(pdf)
                continue
            if held or cut:
                yield emit(pd.concat([*held, pdf.iloc[:cut]], ignore_index=True))
            held, last = [pdf.iloc[cut:]], end
            release()
        if held:
            yield emit(pd.concat(held, ignore_index=True))

    return run


def _parts(mask: int, n: int) -> list[int]:
    """The bits of mask in n parts."""
    bits = [b for b in range(64) if mask >> b & 1]
    return [sum(1 << b for b in bits[i * len(bits) // n : (i + 1) * len(bits) // n]) for i in range(n)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(prints: DataFrame, k: int = 3) -> DataFrame:
    """(a, b): pairs that connect all of `prints` (x: distinct longs) that differ in k bits or fewer.

    Of k + 1 parts of the bits, two such words share one, so they meet in its bucket; buckets of over BUCKET words
    are divided by parts of their other bits in the same, exact way. LEVELS divisions fix all bits but 16, so
    no bucket left has over 65,536 words. In a bucket the Gray-ordered index finds the links, of which a spanning forest goes on.
    """
    spark = prints.sparkSession
    key = lambda m: F.xxhash64(F.lit(_signed(m)), F.col("x").bitwiseAND(F.lit(_signed(m))))
    first = _parts(2**64 - 1, k + 1)
    rows = prints.select("x", F.explode(F.array(*(F.struct(key(m).alias("key"), F.lit(i).alias("path")) for i, m in enumerate(first)))).alias("r")).select("x", "r.*")
    masks, done = dict(enumerate(first)), []
    for _ in range(LEVELS):
        hot = rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BUCKET).select("key", F.lit(True).alias("hot"))
        hot = materialize(hot)
        if hot.isEmpty():
            break
        both = rows.join(hot, "key", "left")  # few keys are hot: each has over BUCKET rows
        done.append(both.where("hot is null").select("key", "x"))
        deeper, branches = {}, []
        for path, mask in masks.items():
            subs = _parts(2**64 - 1 - mask, k + 1)
            for i, m in enumerate(subs):
                deeper[path * (k + 1) + i] = mask | m
            s = F.array(*(F.struct(F.xxhash64("key", F.lit(_signed(m)), F.col("x").bitwiseAND(F.lit(_signed(m)))).alias("key"), F.lit(path * (k + 1) + i).alias("path")) for i, m in enumerate(subs)))
            branches.append((path, s))
        pick = None
        for path, s in branches:
            pick = F.when(F.col("path") == path, s) if pick is None else pick.when(F.col("path") == path, s)
        rows = materialize(both.where("hot").select("x", F.explode(pick).alias("r")).select("x", "r.*"))
        masks = deeper
    rows = rows.select("key", "x")
    for d in done:
        rows = rows.unionByName(d)
    rows = rows.withColumn("node", F.col("x"))
    return rows.repartition("key").sortWithinPartitions("key").mapInPandas(_edges(k), "a long, b long")


def simhash_components(docs: DataFrame, shingle: int = 3, k: int = 3, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, fingerprint (16 hex digits), component_id: the smallest id reachable over links of k differing bits or fewer.

    Copies share a fingerprint and are counted once; a null or empty text has fingerprint 0. Every row
    comes back, repeated ones too; null ids belong to components, whose id is null if all ids are.
    """
    small_batches(docs.sparkSession)
    prints = materialize(docs.select(F.col(doc).alias("doc"), fingerprint(F.col(text), shingle).alias("x")))
    least = materialize(prints.groupBy("x").agg(F.min("doc").alias("least")))
    roots = components(links(least.select("x"), k))
    named = least.join(roots, least["x"] == roots["node"], "left").select("x", "least", F.coalesce("root", "x").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = named.select("x", "root").join(ids, "root").select(F.col("x").alias("x2"), "component_id")
    out = prints.join(ids, prints["x"] == ids["x2"])
    return out.select(F.col("doc").alias(doc), F.lower(F.lpad(F.hex("x"), 16, "0")).alias("fingerprint"), "component_id")


def table_shape(n: int, similarity: float) -> tuple[int, int]:
    """(bits, tables) for n texts. Bits grow with the logarithm of n, so that buckets of unlike texts don't; tables keep the chance.

    Texts of this Jaccard similarity have an angle whose cosine is 2 s / (1 + s), and a bit of theirs is equal with 1 - angle / pi.
    """
    bits = max(BITS, math.ceil(math.log2(max(1, n) / CROWD)))
    same = 1 - math.acos(2 * similarity / (1 + similarity)) / math.pi
    return bits, max(1, math.ceil(math.log(1 - CHANCE) / math.log1p(-(same**bits)))) if same < 1 else 1


def _sketcher(shingle: int, n_bits: int, tables: int):
    rng = np.random.default_rng(20)
    subsets = np.array([rng.permutation(64 * SKETCH)[:n_bits] for _ in range(tables)])
    powers = (1 << np.arange(n_bits)).astype(np.int64)

    @F.pandas_udf("x long, tables array<long>, n long")
    def kernel(t: pd.Series) -> pd.DataFrame:
        out = []
        for part in steps(t):
            hs = [np.unique(shingle_hashes(b, shingle)) for b in part]
            words = np.stack([majority([remix(h, w) for h in hs]) for w in range(SKETCH)], 1)
            bits = np.unpackbits(words.astype(">u8").view(np.uint8).reshape(len(part), -1), axis=1)
            keys = bits[:, subsets].astype(np.int64) @ powers
            out.append(pd.DataFrame({"x": words[:, 0].view(np.int64), "tables": list(keys), "n": [len(h) for h in hs]}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"x": [], "tables": [], "n": []})

    return kernel


def _sets(shingle: int):
    @F.pandas_udf("array<long>")
    def kernel(t: pd.Series) -> pd.Series:
        return pd.Series([np.unique(shingle_hashes(b, shingle)).view(np.int64) for part in steps(t) for b in part])

    return kernel


def alike(sets: list[np.ndarray], similarity: float, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of `similarity` or more that connect all such pairs of sets whose roots differ.

    Two such sets share one of the n - ceil(similarity n) + 1 rarest members of each (prefix filter), so
    no pair is lost; a pair that is joined already, by verified pairs only, isn't compared.
    """
    size, root, out = np.array([len(h) for h in sets]), root.copy(), []

    def join(i: int, j: int) -> None:
        if root[i] != root[j]:
            root[root == root[j]] = root[i]
            out.append((i, j))

    none = np.flatnonzero(size == 0)
    for j in none[1:]:
        join(none[0], j)
    if size.sum():
        _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rank = np.empty(len(count), np.int64)
        rank[np.argsort(count, kind="stable")] = np.arange(len(count))
        row, at = np.repeat(np.arange(len(sets)), size), np.concatenate([[0], np.cumsum(size)])
        r = rank[code]
        r = r[np.lexsort((r, row))]
        prefix = size - np.ceil(similarity * size - 1e-9).astype(np.int64) + 1
        head = np.arange(len(r)) - at[row] < prefix[row]
        by = np.argsort(r[head], kind="stable")
        having, first = row[head][by], np.concatenate([[0], np.cumsum(np.bincount(r[head], minlength=len(count)))])
        mark = np.zeros(len(count), bool)
        for i in np.flatnonzero(size):
            tokens = r[at[i] : at[i] + min(prefix[i], size[i])]
            tokens = tokens[first[tokens + 1] - first[tokens] > 1]
            if not len(tokens):
                continue
            j = np.unique(np.concatenate([having[first[t] : first[t + 1]] for t in tokens]))
            j = j[(j > i) & (root[j] != root[i])]
            j = j[np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]) - 1e-9]
            mark[r[at[i] : at[i + 1]]] = True
            for part in np.array_split(j, -(-int(size[j].sum()) // PAIRS) or 1):
                if len(part):
                    ends = np.concatenate([[0], np.cumsum(size[part])[:-1]])
                    common = np.add.reduceat(mark[np.concatenate([r[at[v] : at[v + 1]] for v in part])], ends, dtype=np.int64)
                    for v in part[common >= similarity * (size[i] + size[part] - common) - 1e-9]:
                        join(i, v)
            mark[r[at[i] : at[i + 1]]] = False
    return np.array([a for a, _ in out], np.int64), np.array([b for _, b in out], np.int64)


def _bounded(rows: DataFrame) -> DataFrame:
    """rows (key, x, node) with each key of over MEMBERS rows replaced by keys for all pairs of blocks of half as many.

    Any two rows of such a key meet in the pair of their blocks, so none of their links is lost.
    """
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > MEMBERS)
    hot = materialize(sizes.select("key", F.ceil(2 * F.col("n") / F.lit(MEMBERS)).cast("int").alias("nb")))
    if hot.isEmpty():
        return rows
    both = rows.join(hot, "key", "left")  # a hot key has one row in `hot`, so that adaptive execution can split it
    own, last = F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"), F.col("nb") - 1
    both = both.withColumn("own", own).withColumn("other", F.explode(F.when(F.col("nb").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), last))))
    pair = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    # a block meets itself in each pair with another one
    return both.where("nb is null or own != other").select(F.when(F.col("nb").isNull(), F.col("key")).otherwise(pair).alias("key"), "x", "node")


def _left_out(marks: DataFrame, roots: DataFrame, sets: DataFrame, similarity: float) -> DataFrame | None:
    """(a, b): verified pairs across the groups `roots` in the families of texts that share buckets in `marks` (node, key).

    A family's texts are compared whole against whole in blocks of FAMILY shingles, and of SPREAD texts while that gives no more than SPREAD_BLOCKS.
    """
    named = marks.join(roots, "node", "left").select("node", "key", F.coalesce("root", "node").alias("root"))
    split = named.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("key")
    crossing = materialize(named.join(split, "key", "left_semi"))
    if crossing.isEmpty():
        return None
    families = components(crossing.select(F.col("node").alias("a"), F.concat(F.lit("k"), F.col("key").cast("string")).alias("b")))
    members = crossing.select("node", "root").distinct().join(families.select("node", F.col("root").alias("family")), "node")
    members = materialize(members.join(sets.select("node", F.size("h").alias("n")), "node"))
    spread = F.least(F.ceil(F.count("*") / F.lit(SPREAD)), F.lit(SPREAD_BLOCKS))
    blocks = members.groupBy("family").agg(F.greatest(F.ceil(F.sum("n") / F.lit(FAMILY)), spread).cast("int").alias("nb"))
    rows = members.join(blocks, "family").withColumn("own", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    key = F.concat_ws(" ", "family", F.least("own", "other").cast("string"), F.greatest("own", "other").cast("string"))
    rows = rows.select("node", "root", key.alias("key")).join(sets, "node")

    def emit(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = alike([np.asarray(h, np.int64) for h in pdf.h], similarity, pd.factorize(pdf.root)[0])
        node = pdf.node.to_numpy()
        return pd.DataFrame({"a": node[i], "b": node[j]})

    return rows.repartition("key").sortWithinPartitions("key").mapInPandas(_by_key(emit), "a string, b string")


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(node, root, least): every distinct text by its MD5, the group it belongs to, the smallest id of its rows.

    Texts whose sets of shingles have a Jaccard similarity of `similarity` or more are linked; groups are
    the components. Candidates share one of the samples of sketch bits that table_shape() asks for and differ in
    RADIUS bits at most of one word: two texts at 0.8 meet with a probability of about 0.98, at any size. Each bucket (or, over
    MEMBERS texts, each pair of its blocks) gives all its pairs, or if it is large a spanning forest of its nearest ones, and every one of these is then settled
    on the whole sets. Pairs that a forest leaves out and that no verified pairs join are settled by _left_out().
    """
    small_batches(docs.sparkSession)
    bits, tables = table_shape(docs.count(), similarity)
    sketched = docs.select(F.md5(F.coalesce(F.col(text), F.lit(""))).alias("node"), F.col(doc).alias("doc"), _sketcher(shingle, bits, tables)(F.col(text)).alias("s"))
    texts = materialize(sketched.groupBy("node").agg(F.min("doc").alias("least"), F.min(F.struct("s.n", "s.x", "s.tables")).alias("s")))
    rows = texts.select("node", F.col("s.x").alias("x"), F.posexplode("s.tables").alias("t", "v")).select((F.col("t").cast("long") * F.lit(1 << bits) + F.col("v")).alias("key"), "x", "node")
    pairs = _bounded(rows).repartition("key").sortWithinPartitions("key", "x").mapInPandas(_edges(RADIUS, True), "a string, b string, key long")
    found = materialize(pairs.distinct())
    marks = found.where("b is null").select(F.col("a").alias("node"), "key")
    pairs = materialize(found.where("b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    nodes = materialize(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct())
    body = docs.select(F.md5(F.coalesce(F.col(text), F.lit(""))).alias("node"), F.col(doc).alias("doc"), F.col(text).alias("text"))
    pick = texts.join(nodes, "node", "left_semi").select("node", F.col("least").alias("doc"))
    one = body.join(pick, (body["node"] == pick["node"]) & body["doc"].eqNullSafe(pick["doc"]), "left_semi")
    sets = materialize(one.select("node", _sets(shingle)(F.col("text")).alias("h")).dropDuplicates(["node"]))
    sized = pairs.join(sets.select(F.col("node").alias("a"), F.col("h").alias("ha")), "a").join(sets.select(F.col("node").alias("b"), F.col("h").alias("hb")), "b")
    common = F.size(F.array_intersect("ha", "hb"))
    union = F.size("ha") + F.size("hb") - common
    near = sized.where((union == 0) | (common >= similarity * union - 1e-9)).select("a", "b")
    near = materialize(near)
    roots = components(near)
    more = _left_out(marks, roots, sets, similarity)
    if more is not None:
        roots = components(near.unionByName(more))
    return texts.select("node", "least").join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each group of near_duplicates(): that with the smallest id (null ids last), then MD5.

    Texts without a word, null or not, form one group; of rows equal in id and text one stays; an empty table gives none. Texts of
    any length are compared whole. All columns stay, whatever their names.
    """
    groups = near_duplicates(docs, shingle, similarity, doc, text)
    best = groups.groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("n"), "least", "node")).alias("k"))
    keep = best.select(F.col("k.node").alias("node"), F.col("k.least").alias("least"))
    held = pack(docs, doc=doc, text=text)
    rows = held.frame.withColumn("md5", F.md5(F.coalesce("text", F.lit(""))))
    out = rows.join(keep, (F.col("md5") == F.col("node")) & F.col("doc").eqNullSafe(F.col("least")), "left_semi")
    # rows equal in id and text are rare, but only one of them may stay
    twice = held.frame.groupBy("doc", F.xxhash64("text")).agg(F.count("*").alias("n")).where("n > 1")
    return unpack(held, out if twice.isEmpty() else out.dropDuplicates(["doc", "md5"]), {})
