"""SentencePiece encoding and decoding: an Aho-Corasick automaton drives a one-pass Viterbi search."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galeway.llm.chunks import ChunkCoder, joined, shared, text_steps
from galeway.llm.common import pack, small_batches, unpack

MARK = "▁"
#: What an unknown character costs more than the worst piece.
UNKNOWN = 10.0


class Pieces(NamedTuple):
    """rows: (piece, score, kind) by id; kind: piece, byte, or other for control, unknown and unused ones. bpe: settled by merges, else by sums of scores."""

    rows: list[tuple[str, float, str]]
    bpe: bool


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte, at = b[at], at + 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(b):
        field, wire = divmod(number(), 8)
        if wire == 0:
            yield field, number()
            continue
        size = number() if wire == 2 else {1: 8, 5: 4}[wire]
        yield field, b[at : at + size]
        at += size


def load_pieces(model_path: str) -> Pieces:
    """The pieces of a model. Its normalizer must leave texts as they are but for marks and the one before a text."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=model_path)
    kind = lambda i: "byte" if sp.is_byte(i) else "other" if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else "piece"
    parts = dict(_fields(sp.serialized_model_proto()))  # of repeated fields (the pieces) the last
    trainer, normalizer = dict(_fields(parts.get(2, b""))), dict(_fields(parts.get(3, b"")))
    if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(3, 1) or not normalizer.get(5, 1):
        raise ValueError("only the identity normalizer with a mark before each text is supported")
    if (model_type := trainer.get(3, 1)) not in (1, 2):
        raise ValueError("the model must be a unigram or a BPE one")
    return Pieces([(sp.id_to_piece(i), sp.get_score(i), kind(i)) for i in range(sp.get_piece_size())], model_type == 2)


class PieceCoder(ChunkCoder):
    """The library's segmentation: that of the merges of a BPE model, or of a unigram model the one with the greatest sum of scores.

    Spaces are marks, and one stands before a text that isn't empty. No piece has a mark after another
    character, so a cut before a mark that follows one is safe; so is one between two characters that no piece has
    side by side. Characters without a piece become bytes.

    Both searches go over a string once: the automaton reports the pieces that end at a position along its output links.
    In a unigram model each of them relaxes the best sum up to there, the longest last piece winning ties. In a BPE model exactly one can be
    the last of the merged prefix: the one whose merges, next to the last piece of the prefix before it, leave the border between both alone.
    """

    prefix = " "

    def __init__(self, pieces: Pieces):
        import ahocorasick

        rows = pieces.rows
        super().__init__("<u2" if len(rows) <= 1 << 16 else "<u4", 1_500_000)
        score = {p: s for p, s, k in rows if k == "piece"}
        if any(MARK in p.lstrip(MARK) for p in score):
            raise ValueError("a piece spans a word boundary")
        ids = {p: i for i, (p, _, k) in enumerate(rows) if k == "piece"}
        self.bpe, self.known = pieces.bpe, set().union(*score)
        self.automaton = ahocorasick.Automaton()
        if self.bpe:
            ids |= {c: len(rows) + i for i, c in enumerate(sorted(self.known.difference(ids)))}  # may merge, but stand for bytes alone
            self.rank, self.split = _merges(score, ids)
            self.concat = {(a, b): self.rank[i] for p, i in ids.items() for a, b in ((ids.get(p[:n]), ids.get(p[n:])) for n in range(1, len(p))) if a is not None and b is not None}
            self.free: dict[int, bool] = {}  # by both pieces in one number
        for p, i in ids.items():
            if not self.bpe or len(p) == 1 or i in self.split:
                self.automaton.add_word(p, (i, len(p), score.get(p, 0.0)))
        self.automaton.make_automaton()
        self.length = {i: len(p) for p, i in ids.items()}
        self.unknown = min(score.values()) - UNKNOWN
        self.bytes = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(rows) if k == "byte"}
        self.other = next((i for i, (_, _, k) in enumerate(rows) if k == "other"), 0)
        self.out = Store8([bytes([int(p[3:5], 16)]) if k == "byte" else b"" if k == "other" else p.replace(MARK, " ").encode() for p, _, k in rows])
        self.limit, self.cuts, self.bits = len(rows), _cuts(score), {}

    def open_ends(self, parts: pa.Array) -> np.ndarray:
        return ~pc.match_substring_regex(parts, f"[^{MARK}]\\z").to_numpy(zero_copy_only=False)

    def _free(self, a: int, b: int) -> bool:
        """Whether merges leave the border between pieces a and b alone.

        Taken apart again in the reverse order of their merges, the parts at the border must not make a piece
        that would have been merged earlier than what was just taken apart; of equal merges the left one goes first.
        """
        rank, split, left = self.rank, self.split, False
        limit = float("inf")
        while True:
            c = self.concat.get((a, b))
            if c is not None and (c <= limit if left else c < limit):
                return False
            ra, rb = rank.get(a, -1.0), rank.get(b, -1.0)
            if ra < 0 and rb < 0:
                return True
            left = rb >= ra
            limit = rb if left else ra
            if left:
                b = split[b][0]
            else:
                a = split[a][1]

    def _merged(self, s: str) -> list[int]:
        n = len(s)
        last: list[int | None] = [None] * (n + 1)  # none after an unknown character, which merges with nothing
        free, length = self.free, self.length
        for end, (i, size, _) in self.automaton.iter(s):
            if last[end + 1] is None:
                before = last[end + 1 - size]
                if before is not None:
                    ok = free.get(before << 24 | i)
                    if ok is None:
                        ok = free[before << 24 | i] = self._free(before, i)
                    if not ok:
                        continue
                last[end + 1] = i
        ids = []
        while n:
            i = last[n]
            if i is None or i >= self.limit:
                ids += [self.bytes.get(b, self.other) for b in reversed(s[n - 1].encode())]
                n -= 1
            else:
                ids.append(i)
                n -= length[i]
        return ids[::-1]

    def _best(self, s: str) -> list[int]:
        n = len(s)
        best, back = [0.0] + [-np.inf] * n, [None] * (n + 1)
        at, single = 0, False  # characters before `at` are settled
        for end, (i, size, score) in self.automaton.iter(s):
            while at < end:
                if not single and best[at] + self.unknown > best[at + 1]:
                    best[at + 1], back[at + 1] = best[at] + self.unknown, (-1, 1)
                at, single = at + 1, False
            single = single or size == 1
            v = best[end + 1 - size] + score
            if v > best[end + 1]:
                best[end + 1], back[end + 1] = v, (i, size)
        while at < n:
            if not single and best[at] + self.unknown > best[at + 1]:
                best[at + 1], back[at + 1] = best[at] + self.unknown, (-1, 1)
            at, single = at + 1, False
        ids = []
        while n:
            i, size = back[n]
            n -= size
            ids += [i] if i >= 0 else [self.bytes.get(b, self.other) for b in reversed(s[n].encode())]
        return ids[::-1]

    def segment(self, s: str) -> list[int]:
        """Ids of a string with marks for spaces."""
        return self._merged(s) if self.bpe else self._best(s)

    def fresh(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for c in chunks:
            ids: list[int] = []
            for part in self.cuts(c.replace(" ", MARK)):
                found = self.bits.get(part)
                if found is None:
                    found = self.bits[part] = self.segment(part)
                ids += found
            out.append(np.array(ids, self.dtype))
        if len(self.bits) > self.cap // 6:
            self.bits.clear()
        return joined(out, self.dtype)

    def decode(self, ids: np.ndarray) -> str:
        """The text; the mark before it goes. A mark that a text holds itself comes back as a space."""
        raw = self.out.gather(ids)[0].tobytes()
        return raw[1:].decode(errors="replace") if raw[:1] == b" " else raw.decode(errors="replace")

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """decode() of many texts, whose ids stand in turn and end at `ends`."""
        raw, at = self.out.gather(ids)
        raw, stop = raw.tobytes(), np.concatenate([[0], at])[ends].tolist()
        parts = (raw[a:b] for a, b in zip([0, *stop[:-1]], stop, strict=True))
        return [(p[1:] if p[:1] == b" " else p).decode(errors="replace") for p in parts]


class Store8:
    """The bytes of each piece."""

    def __init__(self, out: list[bytes]):
        self.flat, self.size = np.frombuffer(b"".join(out), np.uint8), np.fromiter(map(len, out), np.int64, len(out))
        self.first = np.cumsum(self.size) - self.size

    def gather(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.size[ids]
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(self.first[ids] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)], ends


def _merges(score: dict[str, float], ids: dict[str, int]) -> tuple[dict[int, float], dict[int, tuple[int, int]]]:
    """(rank, (left, right) of the last merge) of the pieces that merging their own characters, best scores first, gives."""
    rank, split = {}, {}
    for p in score:
        parts, last = list(p), None
        while len(parts) > 1:
            s, k = min(((-score[parts[k] + parts[k + 1]], k) for k in range(len(parts) - 1) if parts[k] + parts[k + 1] in score), default=(0.0, -1))
            if k < 0:
                break
            last = parts[k], parts[k + 1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        if len(p) > 1:
            rank[ids[p]] = -score[p]
            if len(parts) == 1:
                split[ids[p]] = ids[last[0]], ids[last[1]]
    return rank, split


def _cuts(score: dict[str, float]):
    """A function that cuts a string between a character and ASCII punctuation or a line's end, where no piece has both side by side."""
    before: dict[str, set[str]] = {c: set() for c in "\n!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~"}
    for p in score:
        for a, b in zip(p, p[1:]):
            if b in before:
                before[b].add(a)
    after_line = {p[k + 1] for p in score for k in range(len(p) - 1) if p[k] == "\n"}
    of = "|".join(f"(?<=[^{re.escape(''.join(sorted(left | {MARK})))}])(?={re.escape(c)})" for c, left in before.items())
    pattern = re.compile(f"(?=[{re.escape(''.join(before))}])(?:{of})" + ("" if after_line else "|(?<=\n)(?=[^\n])"))
    plain = re.compile(f"[^{re.escape(''.join(before))}]*").fullmatch
    return lambda s: [s] if plain(s) else pattern.split(s)


def _kernel(spark, model_path: str, schema: str, make):
    small_batches(spark)
    pieces = spark.sparkContext.broadcast(tuple(load_pieces(model_path)))  # 1 MB, whatever the input
    key = f"PieceCoder {zlib.crc32(repr(pieces.value).encode())}"

    @F.arrow_udf(schema)
    def kernel(texts: pa.Array) -> pa.Array:
        coder = shared(key, lambda: PieceCoder(Pieces(*pieces.value)))
        out = [make(coder, part, *coder.code(part)) for part in text_steps(texts)]
        return pa.concat_arrays([pa.StructArray.from_arrays(x, [c.split()[0] for c in schema.split(", ")]) for x in out])

    return kernel


def _lists(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int32)))


def encode(spark, text: Column, model_path: str) -> Column:
    """struct(ids array<int>, n_tokens long) of each whole text; none for a null or empty one."""
    return _kernel(spark, model_path, "ids array<int>, n_tokens long", lambda c, t, ids, ends: [_lists(ids, ends), pa.array(np.diff(ends, prepend=0))])(text)


def _digest(coder: PieceCoder, texts: pa.Array, ids: np.ndarray, ends: np.ndarray) -> list[pa.Array]:
    texts, wide, stop = pc.fill_null(texts, ""), ids.astype("<u4"), ends.tolist()
    crc = [zlib.crc32(wide[a:b]) for a, b in zip([0, *stop[:-1]], stop, strict=True)]
    same = pc.equal(pa.array(coder.decode_all(ids, ends), pa.string()), texts)
    return [pa.array(np.diff(ends, prepend=0)), pa.array(crc, pa.int64()), pc.utf8_length(texts).cast(pa.int64()), same]


def digest(spark, text: Column, model_path: str) -> Column:
    """struct(n_tokens, ids_crc32, n_chars, round_trip): ids as little-endian unsigned 32-bit integers; whether decoding gives the text."""
    return _kernel(spark, model_path, "n_tokens long, ids_crc32 long, n_chars long, round_trip boolean", _digest)(text)


def decode(spark, ids: Column, model_path: str) -> Column:
    """The text of each array of ids; a null array gives an empty text."""
    pieces = spark.sparkContext.broadcast(tuple(load_pieces(model_path)))
    key = f"PieceCoder {zlib.crc32(repr(pieces.value).encode())}"

    @F.pandas_udf("string")
    def kernel(x: pd.Series) -> pd.Series:
        coder = shared(key, lambda: PieceCoder(Pieces(*pieces.value)))
        return pd.Series(["" if i is None else coder.decode(np.asarray(i, np.int64)) for i in x], dtype=object)

    return kernel(ids)


def tokenize(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """docs with ids and n_tokens.

    Row by row: row ids, ties and repeated rows don't matter, an empty table gives none; a null or empty text has no ids (an empty array);
    a text of any length is encoded whole, in one task. Columns of the names ids and n_tokens are replaced, others stay.
    """
    held = pack(docs, text=text)
    e = held.frame.withColumn("_e", encode(docs.sparkSession, F.col("text"), model_path))
    return unpack(held, e, {"ids": F.col("_e.ids"), "n_tokens": F.col("_e.n_tokens")})
