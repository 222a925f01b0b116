"""Token ids in blocks with Elias-Fano encoded document boundaries."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from galeway.llm.chunks import STEP, ChunkCoder, gathered, joined, shared, text_steps
from galeway.llm.common import small_batches

#: Tokens after which a block ends; one whole document at least.
BLOCK_TOKENS = 1 << 18
#: Chunks that are encoded as one text.
GROUP = 64
#: A part's last character, where a cut may follow: none of these is white space.
SAFE_END = r"[!-~\pL\pM\pN\pP\pS]$"
#: The id after each document.
END = 0
#: Ones between the sampled positions of the select structure.
SAMPLE = 256
BLOCKS = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("at", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("block", pa.binary())])
MAGIC, HEAD = b"GWTB1\0\0\0", "<8sIQQQqII"


class EliasFano:
    """A sequence that never falls, in about 2 + log2(range / count) bits a value.

    The low bits of each value stand in a packed array, the high ones in a bit vector in which
    value i sets bit (high + i). select(i) finds the i-th one from the nearest of the positions sampled every SAMPLE ones.
    """

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n, top = len(v), int(v[-1]) if len(v) else 0
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        low = np.packbits(((v[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        at = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros((int(at[-1]) if n else 0) // 8 + 1, np.uint8)
        np.bitwise_or.at(high, at // 8, (1 << (at % 8)).astype(np.uint8))
        return cls(n, bits, low, high, at[::SAMPLE].astype(np.uint32))

    def to_bytes(self) -> bytes:
        return struct.pack("<QBII", self.n, self.low_bits, len(self.high), len(self.samples)) + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, b: bytes, at: int = 0) -> tuple[EliasFano, int]:
        """The sequence, and where it ends."""
        n, bits, n_high, n_samples = struct.unpack_from("<QBII", b, at)
        at += struct.calcsize("<QBII")
        parts = []
        for size, kind in (((n * bits + 7) // 8, np.uint8), (n_high, np.uint8), (n_samples * 4, np.dtype("<u4"))):
            parts.append(np.frombuffer(b[at : at + size], kind))
            at += size
        return cls(n, bits, *parts), at

    def _low(self, i: int) -> int:
        a, b = i * self.low_bits, (i + 1) * self.low_bits
        word = int.from_bytes(self.low[a // 8 : (b + 7) // 8].tobytes(), "little")
        return word >> a % 8 & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """Value i, from a few bytes around it."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, rest = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte, seen = at // 8, -(int(self.high[at // 8]) & ((1 << at % 8) - 1)).bit_count()
        while seen + (ones := int(self.high[byte]).bit_count()) <= rest:
            seen, byte = seen + ones, byte + 1
        word = int(self.high[byte])
        for _ in range(rest - seen):
            word &= word - 1
        pos = byte * 8 + (word & -word).bit_length() - 1
        return ((pos - i) << self.low_bits) | self._low(i)

    def values(self) -> np.ndarray:
        at = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        low = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
        low = (low.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(1, dtype=np.uint64)
        return ((at - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)) | low


def pack(docs: list[int | None], ends: np.ndarray, tokens: np.ndarray) -> bytes:
    """A block: header, ids of the documents (nulls come first and are only counted), ends of the documents, token ids."""
    known = np.array([d for d in docs if d is not None], np.int64)
    base = int(known[0]) if len(known) else 0
    doc_part = EliasFano.encode(known.view(np.uint64) - np.array(base, np.int64).view(np.uint64)).to_bytes()
    end_part = EliasFano.encode(ends).to_bytes()
    return struct.pack(HEAD, MAGIC, tokens.itemsize, len(docs), len(docs) - len(known), int(ends[-1]), base, len(doc_part), len(end_part)) + doc_part + end_part + tokens.tobytes()


class Block:
    """A block as read back: doc_ids, and ids(i) of the i-th document by two selects."""

    def __init__(self, b: bytes):
        magic, self.width, self.n, self.nulls, self.n_tokens, base, n_doc, n_end = struct.unpack_from(HEAD, b)
        if magic != MAGIC:
            raise ValueError("not a token block")
        at = struct.calcsize(HEAD)
        self.docs, _ = EliasFano.from_bytes(b, at)
        self.ends, _ = EliasFano.from_bytes(b, at + n_doc)
        self.base, self.tokens = base, np.frombuffer(b[at + n_doc + n_end :], f"<u{self.width}")

    def doc_ids(self) -> list[int | None]:
        known = (self.docs.values() + np.array(self.base, np.int64).view(np.uint64)).view(np.int64)
        return [None] * self.nulls + known.tolist()

    def ids(self, i: int) -> np.ndarray:
        """The tokens of the i-th document, by two selects."""
        return self.tokens[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]


class ByteBpe(ChunkCoder):
    """A byte-level BPE of the tokenizers library. No token crosses a space that follows another character than white space."""

    def __init__(self, model: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(model)
        n = self.model.get_vocab_size()
        super().__init__("<u2" if n <= 1 << 16 else "<u4", 1_500_000)
        self.leads = np.array([(self.model.id_to_token(i) or "").startswith("Ġ") for i in range(n)])

    def open_ends(self, parts: pa.Array) -> np.ndarray:
        return ~pc.match_substring_regex(parts, SAFE_END).to_numpy(zero_copy_only=False)

    def fresh_parts(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not len(parts):
            return self.fresh([])
        # texts of GROUP parts: each part begins with the only tokens that begin with a space
        at = np.append(np.arange(0, len(parts), GROUP), len(parts)).astype(np.int32)
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(at), parts), " ").to_pylist()
        ids, sizes = joined([np.array(e.ids, self.dtype) for e in self.model.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)], self.dtype)
        first = np.flatnonzero(self.leads[ids])
        per = np.searchsorted(first, np.cumsum(sizes))
        if (np.diff(per, prepend=0) != np.diff(at)).any() or (first[at[:-1]] != np.cumsum(sizes) - sizes).any():
            return super().fresh_parts(parts)
        return ids, np.diff(np.append(first, len(ids)))

    def fresh(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return joined([np.array(e.ids, self.dtype) for e in self.model.encode_batch(chunks, add_special_tokens=False)], self.dtype)


def vocabulary(name: str) -> str:
    """The path of an installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_blocks(docs: DataFrame, model_path: str, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """part, seq, at, n_docs, n_tokens, block: the table of the file format, one row a block.

    Documents are dealt by ranges of ids and sorted, then encoded where they lie, so texts move
    once. (part, seq) is the order of blocks, `at` the tokens of earlier blocks of the part.
    """
    small_batches(docs.sparkSession)
    with open(model_path, encoding="utf-8") as f:
        key = zlib.crc32((content := f.read()).encode())
        model = docs.sparkSession.sparkContext.broadcast(content)  # a few MB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = shared(f"ByteBpe {key}", lambda: ByteBpe(model.value))
        part, seq, at = TaskContext.get().partitionId(), 0, 0
        docs, tokens, ends = [], np.zeros(0, coder.dtype), np.zeros(0, np.int64)

        def block(n: int) -> pa.RecordBatch:
            row = {"part": [part], "seq": [seq], "at": [at], "n_docs": [n], "n_tokens": [int(ends[n - 1])], "block": [pack(docs[:n], ends[:n], tokens[: ends[n - 1]])]}
            return pa.RecordBatch.from_pydict(row, BLOCKS)

        for batch in gathered(batches, "text", STEP):
            ids, n = batch["doc"].to_pylist(), 0
            for texts in text_steps(batch["text"]):
                coded, stop = coder.code(texts)
                more = np.full(len(coded) + len(stop), END, coder.dtype)
                more[np.arange(len(coded)) + np.repeat(np.arange(len(stop)), np.diff(stop, prepend=0))] = coded
                ends = np.concatenate([ends, len(tokens) + stop + np.arange(1, len(stop) + 1)])
                tokens = np.concatenate([tokens, more])
                docs += ids[n : n + len(stop)]
                n += len(stop)
                while len(tokens) >= BLOCK_TOKENS:
                    k = int(np.searchsorted(ends, BLOCK_TOKENS)) + 1
                    yield block(k)
                    cut = int(ends[k - 1])
                    seq, at, docs, tokens, ends = seq + 1, at + cut, docs[k:], tokens[cut:], ends[k:] - cut
        if docs:
            yield block(len(docs))

    rows = docs.select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("text"), F.crc32(text).alias("tie"))
    rows = rows.repartitionByRange("doc", "tie").sortWithinPartitions("doc", "tie")
    return rows.select("doc", "text").mapInArrow(run, "part int, seq int, at long, n_docs long, n_tokens long, block binary")


def write_blocks(docs: DataFrame, path: str, model_path: str, doc: str = "doc_id", text: str = "text") -> None:
    """Write all documents, by ascending id (null ids first, equal ids by checksum), with END after each. A null text is empty."""
    encode_blocks(docs, model_path, doc, text).write.option("compression", "zstd").parquet(path)


def read_blocks(spark, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document in the files.

    Only a row for each part, of which there are as many as tasks wrote, is summed in one place and broadcast.
    """
    blocks = spark.read.parquet(path)
    totals = blocks.groupBy("part").agg(F.sum("n_tokens").alias("t"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("first"))
    rows = blocks.join(F.broadcast(starts), "part").select((F.col("first") + F.col("at")).alias("start"), "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, raw in zip(batch["start"].to_pylist(), batch["block"], strict=True):
                b = Block(memoryview(raw.as_buffer()))
                ends = np.array([b.ends.select(i) for i in range(b.n)], np.int64)
                firsts = np.concatenate([[0], ends[:-1]])
                wide = b.tokens.astype("<u4")
                out = [pa.array(b.doc_ids(), pa.int64()), pa.array(start + firsts), pa.array(ends - firsts), pa.array([zlib.crc32(wide[a:e]) for a, e in zip(firsts.tolist(), ends.tolist(), strict=True)], pa.int64())]
                if with_ids:
                    out.append(pa.array([b.ids(i).astype(np.int32) for i in range(b.n)], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(out)])

    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
