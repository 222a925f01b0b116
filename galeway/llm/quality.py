"""Quality rules: word counts, repetition and compression bands."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galeway.llm.chunks import release
from galeway.llm.common import pack, small_batches, unpack

#: Compressor level, and bytes of the fixed chunks.
LEVEL, CHUNK = 3, 4096
#: (bytes from, least and most ratio of the whole text); ratio: bytes / compressed bytes. Longer texts compress
#: better, so the limits move with the length. Under 256 bytes frames and headers outweigh the content.
#: Least ratios of texts labelled good (sf0.1): 1.34, 1.72, 2.12, 2.34; base64 has 1.09 to 1.34.
BANDS = [(256, 1.3, 3.5), (1024, 1.5, 4.5), (4096, 1.6, 6.0), (16384, 1.7, 8.0), (65536, 1.7, 10.0)]
#: The same for chunks, of which the last may be shorter; least ratios of good texts: 1.37, 1.8, 2.07.
CHUNK_BANDS = [(256, 1.3, 8.0), (1024, 1.5, 8.0), (CHUNK, 1.7, 8.0)]
#: A text fails if more than this share of its chunks is outside CHUNK_BANDS.
BAD_CHUNKS = 0.25
#: Bytes of text that are taken apart at once.
STEP = 1_000_000

SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, ratio double, n_chunks long, n_bad_chunks long, base_failed boolean, kept boolean"


def repeat_words(codes: np.ndarray, sizes: np.ndarray, window: int = 8) -> np.ndarray:
    """Words of each document inside windows of `window` words (a power of two) that it has twice or more.

    codes: word numbers of all documents in a row; sizes: words of each. Windows get exact numbers by doubling.
    """
    n, out = len(codes), np.zeros(len(sizes), np.int64)
    if n < window:
        return out
    doc = np.repeat(np.arange(len(sizes)), sizes)
    r, width = codes.astype(np.int64), 1
    while width < window:
        r = pd.factorize(r[:-width] * (int(r.max()) + 1) + r[width:])[0].astype(np.int64)
        width *= 2
    inside = doc[: n - window + 1] == doc[window - 1 :]
    at = np.flatnonzero(inside)
    key = pd.factorize(r[at] * len(sizes) + doc[at])[0]
    twice = at[np.bincount(key, minlength=1)[key] >= 2] if len(at) else at
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, twice, 1)
    np.add.at(change, twice + window, -1)
    np.add.at(out, doc[np.cumsum(change[:-1]) > 0], 1)
    return out


def _inside(n: int, ratio: float, bands: list[tuple[int, float, float]]) -> bool:
    found = True
    for least, low, high in bands:
        if n >= least:
            found = low <= ratio <= high
    return found


def compression(body: bytes, zstd) -> tuple[float, int, int, bool]:
    """(ratio of the whole text, chunks, chunks outside their band, inside the bands?); a text under CHUNK bytes has no chunks."""
    if not body:
        return 0.0, 0, 0, True
    ratio = len(body) / len(zstd.compress(body))
    chunks = [body[i : i + CHUNK] for i in range(0, len(body), CHUNK)] if len(body) >= CHUNK else []
    if chunks and len(chunks[-1]) < CHUNK_BANDS[0][0]:
        chunks.pop()
    bad = sum(not _inside(len(c), len(c) / len(zstd.compress(c)), CHUNK_BANDS) for c in chunks)
    return ratio, len(chunks), bad, _inside(len(body), ratio, BANDS) and bad <= BAD_CHUNKS * len(chunks)


def measure(texts: list[bytes]) -> pd.DataFrame:
    import zstandard

    zstd = zstandard.ZstdCompressor(level=LEVEL)
    number: dict[bytes, int] = {}
    codes, sizes, rows = [], [], []
    for b in texts:
        words = b.split()  # splits at ASCII white space only, as WORD does
        codes += [number.setdefault(w, len(number)) for w in words]
        sizes.append(len(words))
        lines = [x for x in b.split(b"\n") if x.strip()]
        chars = len(b.translate(None, b" \t\n\r\x0b\x0c" + bytes(range(0x80, 0xC0))))  # continuation bytes aren't code points
        rows.append((len(words), chars, len(b) - len(b.translate(None, b"#*$%&|<>")), len(lines) - len(set(lines)), *compression(b, zstd)))
    out = pd.DataFrame(rows, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "ratio", "n_chunks", "n_bad_chunks", "good"])
    out["n_repeat_words"] = repeat_words(np.array(codes, np.int64), np.array(sizes, np.int64))
    out["base_failed"] = (out.n_words < 20) | (100 * out.n_repeat_words > 30 * out.n_words)
    out["kept"] = ~out.base_failed & out.good
    return out[[c.split()[0] for c in SCHEMA.split(", ")]]


def steps(texts: pd.Series) -> Iterator[list[bytes]]:
    held, size = [], 0
    for t in texts:
        held.append(b"" if t is None else t.encode())
        size += len(held[-1])
        if size >= STEP:
            yield held
            held, size = [], 0
    if held:
        yield held
    release()


def judge(text: Column) -> Column:
    """A struct of SCHEMA for each whole text; a null text counts as none (no words, not kept)."""

    @F.pandas_udf(SCHEMA)
    def kernel(t: pd.Series) -> pd.DataFrame:
        return pd.concat([measure(x) for x in steps(t)], ignore_index=True) if len(t) else measure([])

    return kernel(text)


def quality(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the columns of SCHEMA.

    Row by row: row ids, ties and repeated rows don't matter, an empty table gives none; a null or empty text has no words and
    isn't kept; a text of any length is measured whole, in one task. Columns of the names in SCHEMA are replaced, others stay.
    """
    small_batches(docs.sparkSession)
    held = pack(docs, text=text)
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return unpack(held, held.frame.withColumn("q", judge(F.col("text"))), {n: F.col(f"q.{n}") for n in names})
