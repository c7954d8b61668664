"""One query for each operator, over whole tables, next to its SQL where SQL can express it."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .alignment import align_and_link, written_groups
from .common import documents, embeddings, shared_folder
from .conversation_trie import TRIE_SQL, ordered_turns, prefix_trie, with_shared_starts
from .hamming_index import nearest
from .langid import identify
from .licenses import scan, scan_sql
from .mixing import MIX_SQL, mix
from .packing import pack
from .perplexity import judge
from .sentence_pieces import decode_pieces, encode_pieces
from .sharding import write_shards
from .simhash import near_duplicates
from .tiled_cosine import near_vectors
from .token_file import token_file

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


@query("op1_token_file")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of all documents, from the token file that was written."""
    return token_file(documents(spark, folder), "byte_bpe_50k.json", end_id=0)


@query("op2_hamming_index")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest vectors of every hundredth vector."""
    return nearest(embeddings(spark, folder), F.col("vec_id") % 100 == 0, 10)


@query("op3_sharding")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in 16 shards of near equal bytes, read back from the shards."""
    path = f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}"
    write_shards(documents(spark, folder).select("doc_id", "text"), path, 16)
    text = F.coalesce("text", F.lit(""))
    return spark.read.schema("doc_id long, text string, slot long, shard int").parquet(path).select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op4_license_scan", scan_sql())
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """Licence phrases and notices in all documents."""
    return scan(documents(spark, folder)).withColumn("score", F.round("score", 6))


@query("op5_simhash")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints and components of all documents."""
    return near_duplicates(documents(spark, folder), words=3, distance=2)


@query("op6_perplexity")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """Perplexity of all documents and whether they are accepted."""
    return judge(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))


@query("op7_best_fit_packing")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in sequences of 4096 tokens."""
    return pack(documents(spark, folder), 4096, "word_bpe_49k.json", end_id=1)


@query("op8_poisson_mixing", MIX_SQL)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in equal parts from every source, in a global random order."""
    size = (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("size")
    mixed = mix(documents(spark, folder), columns=[F.col("doc_id"), F.col("source"), size])
    return mixed.select("row.*", F.round("rate", 6).alias("rate"), F.col("copies").cast("long").alias("copies"), F.col("copy").cast("long").alias("copy"), "position")


@query("op9_language_id")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """Language of all documents; a third of them is held out from learning."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    found = identify(documents(spark, folder), ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op10_tiled_cosine")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate vectors of a label, by cosine 0.93."""
    return near_vectors(embeddings(spark, folder), 0.93)


def group_digests(batch: pa.RecordBatch) -> pa.Array:
    """SHA-256 of the groups as written; an empty string for a text without tokens."""
    return pa.array([hashlib.sha256(g).hexdigest() if g else "" for g in written_groups(batch)], pa.string())


def packed_counts(column: str) -> tuple[T.DataType, Callable[[pa.RecordBatch], pa.Array]]:
    return T.LongType(), lambda batch: pa.array(np.asarray(pc.binary_length(batch.column(column)), np.int64) // 4)


@query("op11_token_alignment")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of byte-level and SentencePiece tokens of all documents, and how often their links occur in all of them."""
    sizes = {"n_a": packed_counts("a_ids"), "n_b": packed_counts("b_ids"), "n_groups": packed_counts("a_upto")}
    measures = sizes | {"groups_sha256": (T.StringType(), group_digests)}
    return align_and_link(documents(spark, folder).select("doc_id", "text"), measures)


@query("op12_sentence_pieces")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """SentencePiece ids of all documents, and the texts that they decode to."""
    there = encode_pieces(documents(spark, folder).select("doc_id", "text"))
    return decode_pieces(there).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query("op13_conversation_trie", TRIE_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """The prefix trie of all conversations, rebuilt with shared starts."""
    return prefix_trie(with_shared_starts(ordered_turns(spark.read.parquet(f"{folder}/conversations.parquet"))))
