"""Exact dedup by composable polynomial fingerprints and chunkwise comparison.

A text without white space is cut into chunks of bytes. Each chunk has a polynomial hash of its own, and the
hash of a joined text follows from the hashes of its parts: H(ab) = H(a) * r^len(b) + H(b) mod p. So chunks of
a huge text can be hashed in any order and on any machine. Texts of equal fingerprints are then compared chunk
by chunk: the smallest and the largest chunk at each place must be the same.

Defined results: a null text counts as empty; all empty texts form one group. Of texts that tie in code points the
smallest id stays, a null one last; rows that repeat one id are separate members of their group, and just one of them
stays. A very long text is hashed in one task and compared chunk by chunk. An empty table gives an empty result.
Columns other than the id, the text and, where named, the row's are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.session import cut_lineage, spread, table

#: Two primes under 2^31 and a base for each.
MODULI = ((2147483647, 1099087573), (2147483629, 873651241))
CHUNK_BYTES = 1 << 16
#: Bits of the map of fingerprints that occur twice or more: so many for each of them, between these; 64 MB at most.
#: A fuller map lets more texts through to the comparison, which tells them apart all the same.
BITS_EACH, LEAST_BITS, MOST_BITS = 64, 1 << 18, 1 << 29
WHITE = b" \t\n\v\f\r"

_FEATURES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("uid", T.LongType()),
        T.StructField("n_points", T.LongType()),
        T.StructField("fp", T.LongType()),
        T.StructField("size", T.LongType()),
        T.StructField("text_sha256", T.StringType()),
    ]
)
_CHUNKS = T.StructType([T.StructField("fp", T.LongType()), T.StructField("size", T.LongType()), T.StructField("chunk_no", T.LongType()), T.StructField("chunk", T.BinaryType())])


def normalized(text: str | None) -> bytes:
    """UTF-8 of the text without white space."""
    return (text or "").encode("utf-8", "surrogatepass").translate(None, WHITE)


class Polynomial:
    """Hashes of byte strings modulo one prime."""

    def __init__(self, modulus: int, base: int, chunk_bytes: int = CHUNK_BYTES):
        self.modulus, self.base = modulus, base % modulus
        powers = np.empty(chunk_bytes, dtype=np.uint64)
        x = 1
        for i in range(chunk_bytes):
            powers[chunk_bytes - 1 - i] = x
            x = x * self.base % modulus
        self.powers, self.shift = powers, x  # shift: base^chunk_bytes

    def chunk(self, data: np.ndarray) -> int:
        """Hash of at most chunk_bytes bytes; each byte counts one more, so that zero bytes count."""
        return int(np.dot(data + np.uint64(1), self.powers[len(self.powers) - len(data) :])) % self.modulus if len(data) else 0

    def combine(self, left: int, right: int, right_bytes: int) -> int:
        """Hash of two joined strings, from their hashes and the length of the second."""
        shift = self.shift if right_bytes == len(self.powers) else pow(self.base, right_bytes, self.modulus)
        return (left * shift + right) % self.modulus


def fingerprint(data: bytes, hashes: list[Polynomial], chunk_bytes: int = CHUNK_BYTES) -> int:
    """The polynomial hashes of a whole string, packed into a signed 64-bit number."""
    out = 0
    for h in hashes:
        total = 0
        for at in range(0, len(data), chunk_bytes):
            piece = np.frombuffer(data, dtype=np.uint8, count=min(chunk_bytes, len(data) - at), offset=at).astype(np.uint64)
            total = h.combine(total, h.chunk(piece), len(piece)) if at else h.chunk(piece)
        out = out << 31 | total
    return out


def _features(moduli, chunk_bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = [Polynomial(m, b, chunk_bytes) for m, b in moduli]
        for batch in batches:
            rows = []
            for doc_id, uid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                text = text.as_py()
                data = normalized(text)
                rows.append((doc_id, uid, len(text or ""), fingerprint(data, hashes, chunk_bytes), len(data), hashlib.sha256(data).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*rows, strict=True), (pa.int64(),) * 5 + (pa.string(),), strict=True)] if rows else [pa.array([], type=t) for t in (pa.int64(),) * 5 + (pa.string(),)], names=_FEATURES.names)

    return run


def _chunks(moduli, chunk_bytes, bits, maybe):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = [Polynomial(m, b, chunk_bytes) for m, b in moduli], np.frombuffer(maybe.value, dtype=np.uint8)
        for batch in batches:
            out, held = [], 0
            for text in batch.column(0):
                data = normalized(text.as_py())
                fp = fingerprint(data, hashes, chunk_bytes)
                at = fp % bits
                if seen[at >> 3] >> (at & 7) & 1:
                    for k, i in enumerate(range(0, len(data), chunk_bytes)):
                        out.append((fp, len(data), k, data[i : i + chunk_bytes]))
                        held += min(chunk_bytes, len(data) - i)
                        if held > 1 << 23:
                            yield _chunk_batch(out)
                            out, held = [], 0
            if out:
                yield _chunk_batch(out)

    return run


def _chunk_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=_CHUNKS.names)


def _bitmap(keys: DataFrame, bits: int) -> bytes:
    """Bits of the numbers in column fp modulo `bits`: at most bits / 32768 rows of 4 KB reach the driver."""
    at = F.pmod("fp", F.lit(bits))
    rows = keys.select(F.bitmap_bucket_number(at + 1).alias("bucket"), F.bitmap_bit_position(at + 1).alias("place")).groupBy("bucket").agg(F.bitmap_construct_agg("place").alias("map")).collect()
    out = bytearray(bits // 8)
    for r in rows:
        start = (r["bucket"] - 1) * 4096
        out[start : start + 4096] = bytes(r["map"])[: len(out) - start]
    return bytes(out)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, row_col: str | None = None, moduli=MODULI, chunk_bytes: int = CHUNK_BYTES, filter_bits: int | None = None) -> DataFrame:
    """One row per input row: doc_id, uid (a number that tells rows apart: of `row_col`, or its own), n_points, keep_id,
    group_size, kept, text_sha256.

    The largest thing on the driver is the bit map, of at most MOST_BITS. A group is pre-aggregated in each task
    before any shuffle; the join that carries its outcome to its rows is one that Spark splits when it is skewed.
    """
    spark = docs.sparkSession
    row = F.col(row_col).cast("long") if row_col else F.monotonically_increasing_id()
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), row.alias("uid"), F.col(text_col).alias("text"))
    rows = cut_lineage(texts.mapInArrow(_features(moduli, chunk_bytes), _FEATURES))
    repeated = cut_lineage(rows.groupBy("fp", "size").agg(F.count("*").alias("n")).filter("n > 1"))
    filter_bits = filter_bits or min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_EACH * repeated.count()).bit_length()))
    maybe = spark.sparkContext.broadcast(_bitmap(repeated, filter_bits))
    compared = texts.select("text").mapInArrow(_chunks(moduli, chunk_bytes, filter_bits, maybe), _CHUNKS).groupBy("fp", "size", "chunk_no").agg(F.min("chunk").alias("lo"), F.max("chunk").alias("hi"))
    collided = cut_lineage(compared.filter(F.col("lo") != F.col("hi")).select("fp", "size").distinct())
    maybe.unpersist()
    if collided.isEmpty():
        rows = rows.withColumn("part", F.lit(""))
    else:  # different texts of one fingerprint and length: the SHA-256 of the text tells them apart
        rows = rows.join(collided.withColumn("part", F.lit(1)), ["fp", "size"], "left").withColumn("part", F.when(F.col("part") == 1, F.col("text_sha256")).otherwise(""))
    order = F.struct("n_points", F.coalesce(-F.col("doc_id"), F.lit(-(1 << 62))).alias("a"), (-F.col("uid")).alias("b"), "doc_id")
    key = ["fp", "size", "part"]
    groups = cut_lineage(rows.groupBy(*key).agg(F.count("*").alias("group_size"), F.max(order).alias("best")).filter("group_size > 1").select(*key, "group_size", F.col("best.doc_id").alias("best_id"), (-F.col("best.b")).alias("best_uid")))
    single = F.col("group_size").isNull()
    return rows.join(groups, key, "left").select(
        "doc_id",
        "uid",
        "n_points",
        F.when(single, F.col("doc_id")).otherwise(F.col("best_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col("uid") == F.col("best_uid"))).alias("kept"),
        "text_sha256",
    )


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(spread(table(spark, sf_dir, "documents"))).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


QUERIES = {"op9_exact_dedup": op9_exact_dedup}
ORACLE = {
    "op9_exact_dedup": """
WITH d AS (
    SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS t FROM documents
), r AS (
    SELECT *, first_value(doc_id) OVER (PARTITION BY t ORDER BY n DESC, doc_id) AS keep_id,
        count(*) OVER (PARTITION BY t) AS group_size, row_number() OVER (PARTITION BY t ORDER BY n DESC, doc_id) = 1 AS kept
    FROM d
)
SELECT doc_id, keep_id, group_size, kept, sha256(t) AS text_sha256 FROM r
"""
}
