"""SimHash near-duplicate detection with deletion-variant signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import Staging, cleaned
from .components import components
from .text import over_texts, slices, strings

#: Buckets of more members than this link through shared neighbours instead of pairs.
PAIR_BUCKET = 16
#: At most so many bucket keys (16 bytes each) are broadcast; more are joined by shuffle.
BROADCAST_KEYS = 250_000


def fingerprint(text: bytes, width: int, seed: int = 42) -> int:
    """The 64-bit SimHash of a text's `width`-word shingles, as a signed number."""
    words = text.lower().split()  # of bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > width:
        starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], seed) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)], dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 100_000):
        part = hashes[at : at + 100_000]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, width: int = 3) -> DataFrame:
    """(doc_id, th, fp) for each row: one pass over the texts, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                texts = strings(batch.column("text")).cast(pa.large_binary())
                fps = pa.array([fingerprint(t.as_py(), width) for t in texts], type=pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), fps], names=["doc_id", "th", "fp"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    return over_texts(rows, run, "doc_id long, th long, fp long")


def _apart(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _variants(fps: DataFrame) -> DataFrame:
    """(key, fp): both 32-bit halves of each fingerprint, each with one bit taken out in turn."""
    place = F.explode(F.sequence(F.lit(0), F.lit(63))).alias("v")
    half = "(case when v < 32 then fp & 4294967295L else shiftrightunsigned(fp, 32) end)"
    key = f"(cast(v as bigint) * 4294967296L) | ({half} & ~shiftleft(1L, v % 32))"
    return fps.select("fp", place).select(F.expr(key).alias("key"), "fp")


def links(fps: DataFrame, staging: Staging, pair_bucket: int = PAIR_BUCKET) -> DataFrame:
    """Links (a, b) that join all distinct fingerprints at 2 or fewer differing bits.

    A fingerprint is cut into two halves: of two differing bits, one half has at
    most one, so that the halves agree with one bit taken out. Each fingerprint
    is indexed under its 64 variants; those that share a key are candidates and
    are verified. Buckets of up to three members give their pairs from the
    aggregate itself, those up to `pair_bucket` from an equality join. Members
    of larger buckets are linked exactly without pairs: each is dealt to itself
    and its 64 one-bit neighbours, two at distance 2 or less meet at one of
    those, all that meet are within distance 2, and each links to the least.
    """
    keyed = _variants(fps)
    buckets = staging.write(
        keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi"), F.expr("bit_xor(fp)").alias("x")).where("n > 1"), "buckets"
    )
    mid = F.col("x").bitwiseXOR(F.col("lo")).bitwiseXOR(F.col("hi"))
    pair = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    few = buckets.where("n <= 3").select(
        F.explode(F.when(F.col("n") == 2, F.array(pair(F.col("lo"), F.col("hi")))).otherwise(F.array(pair(F.col("lo"), mid), pair(mid, F.col("hi")), pair(F.col("lo"), F.col("hi"))))).alias("p")
    ).select("p.a", "p.b")
    large = buckets.where("n > 3").select("key", "n")
    with cleaned(large.sparkSession):
        large = F.broadcast(large) if large.count() <= BROADCAST_KEYS else large
    members = staging.write(keyed.join(large, "key"), "members")
    medium = members.where(F.col("n") <= pair_bucket).select("key", "fp")
    paired = medium.withColumnRenamed("fp", "a").join(medium.withColumnRenamed("fp", "b"), "key").where("a < b").select("a", "b")
    near = few.union(paired).where(_apart(F.col("a"), F.col("b")) <= 2).distinct()
    crowd = members.where(F.col("n") > pair_bucket).select("fp").distinct()
    balls = crowd.select("fp", F.explode(F.sequence(F.lit(-1), F.lit(63))).alias("v")).select(F.expr("case when v < 0 then fp else fp ^ shiftleft(1L, v) end").alias("ball"), "fp")
    least = balls.groupBy("ball").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").select("ball", "b")
    met = balls.join(least, "ball").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()
    return near.union(met)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, pair_bucket: int = PAIR_BUCKET) -> DataFrame:
    """(doc_id, th, fingerprint, component_id, n_copies) for every row.

    Fingerprints link at 2 or fewer differing bits; component_id is the
    smallest id reachable over links, itself included, and n_copies counts the
    rows of the same fingerprint. Equal fingerprints are one node, so copies
    never become pairs. A null text counts as empty; texts without words have
    the fingerprint zero and link like any other. Rows repeat as they come. A
    null id stays, and takes the component of its fingerprint. An empty table
    gives no rows; columns other than the two named are not read. th is a hash
    of the text.
    """
    staging = Staging(docs.sparkSession, "simhash")
    prints = staging.write(fingerprints(docs, id_col, text_col, width), "prints")
    distinct = staging.write(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_copies")), "distinct")
    roots = components(links(distinct.select("fp"), staging, pair_bucket), staging).withColumnRenamed("node", "fp")
    rooted = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = staging.write(rooted, "rooted")
    staging.drop("buckets", "members", "distinct")
    named = staging.write(
        rooted.select("fp", "root", "n_copies").join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id", "n_copies"), "named"
    )
    staging.drop("rooted")
    return prints.join(named, "fp").select("doc_id", "th", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_copies")
