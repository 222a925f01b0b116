"""A corpus pipeline: quality rules, line dedup, near-dedup, mixing and encoding, each over what the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galeway.llm import line_dedup, mixing, pieces, quality, simhash
from galeway.llm.common import materialize, pack, small_batches, table, unpack
from galeway.llm.token_files import vocabulary

#: Relative weights of sources; others have 1.
WEIGHTS = {"src0": 5.0}
#: The vocabulary of the last stage.
PIECES = "piece_bpe_32k.model"


def _documents(docs: DataFrame):
    return pack(docs, doc_id="doc_id", text="text", source="source")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep.

    Row by row, each text whole: a null or empty text goes, as it has no words; repeated rows fare alike; other columns, whatever their
    names, stay; an empty table gives none.
    """
    small_batches(spark)
    return docs.where(quality.judge(F.col("text"))["kept"]).select(docs.columns)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without later copies of runs of whole lines of line_dedup.MIN_WORDS words or more; n_chars follows the text.

    Of equal runs that with the smallest (id, text hash, line) stays; null ids come first; null and empty texts stay as they are;
    rows equal in id and text get the same result; other columns, whatever their names, stay; an empty table gives none.
    """
    held = _documents(docs)
    out, new = line_dedup.dedup_lines(held.frame), {}
    if "n_chars" in docs.columns:
        old = held.names["n_chars"]
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(old))
    return unpack(held, out, new)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8): that with the smallest id, null ids last.

    Null, empty and blank texts form one group; of rows equal in id and text one stays; texts are compared whole; other
    columns, whatever their names, stay; an empty table gives none.
    """
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix: the files of the result hold it, one range of slots each.

    A null source is one of its own; null texts count one byte; repeated rows follow one another; a text of any length lies in the block where
    it starts; other columns, whatever their names, stay; an empty table gives none.
    """
    held = _documents(docs)
    mixed, slots = mixing.mix(held.frame, WEIGHTS)
    return unpack(held, mixing.write_order(mixed, slots, int(spark.conf.get("spark.sql.shuffle.partitions"))), {})


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids and n_tokens of every document.

    Row by row, each text whole: a null or empty text has no ids; repeated rows fare alike; other columns go; an empty table gives none.
    """
    return pieces.tokenize(docs.select("doc_id", "source", "text"), vocabulary(PIECES)).select("doc_id", "source", "ids", "n_tokens")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_deduplication),
    ("simhash_near_dedup", near_deduplication),
    ("mix_sources", mix_sources),
    ("encode_pieces", encode_pieces),
]

#: Compression, sketches and pieces are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
