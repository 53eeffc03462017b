"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A text's fingerprint takes the majority of its shingles' hash bits. Two fingerprints within
RADIUS bits have a variant within RADIUS / 2 bits of both: every distinct fingerprint emits
all variants in that ball, variants are shuffled, and those of one variant are linked.
By the triangle inequality all fingerprints that share a variant are within RADIUS, so each
links to the least of them only: no group is expanded into pairs, and no link between groups
is lost. Each link is verified again by its differing bits.

A variant takes 8 bytes: an odd multiplier mixes it, the top bits name the bucket that is
shuffled, and the mask's number takes their place. Eight rounds, by a linear syndrome
of the variant, bound the disk; each round's shuffle is dropped before the next.

Nulls and texts without words have fingerprint zero and link like any other. Whole texts are
hashed. Copies share a fingerprint and cost one row here. Documents with a null id are
fingerprinted, but a group is named by its least id that isn't null. Empty tables give none.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, by_value, drop_path, quoted, scratch, stored
from .graph import components

by_value(__name__)

RADIUS = 4
MIX, UNMIX = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64)
#: Least bits that hold the number of a mask (enough for the 2,081 of radius 2), and least bits of a bucket.
MASK_BITS = 12
#: Variants a bucket should hold at most, rounds (the number of syndromes), fingerprints expanded
#: at once by a worker, and links held by one before they are passed on.
BUCKET, ROUNDS, CHUNK, LINKS = 1 << 18, 8, 4096, 500_000
#: Full buckets in a partition, at most: 64 MB.
PARTITION = 32


def fingerprint(text: str | None, size: int = 4, seed: int = 42) -> int:
    """SimHash of the lower-cased (A-Z) words' shingles by XXH64; zero without words."""
    words = (text or "").encode().lower().split()  # bytes: splits at \\x20 and \\x09-\\x0D, lowers A-Z only
    if not words:
        return 0
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    if len(words) > size:
        starts = np.concatenate([[0], ends[: len(words) - size] + 1]).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)]
    else:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    h = np.array(hashes, dtype=">u8")
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(df: DataFrame, text_col: str = "text", size: int = 4, seed: int = 42) -> DataFrame:
    """df, without the text, with `fp`: the fingerprint as a signed long."""
    keep = [c for c in df.columns if c not in (text_col, "fp")]

    def work(batches):
        for batch in batches:
            done = np.array([fingerprint(t, size, seed) for t in batch.column(len(keep)).to_pylist()], dtype=np.uint64)
            yield batch, [pa.array(done.view(np.int64))]

    return arrow_map(df, keep, [quoted(text_col)], [("fp", "bigint")], work)


def masks(radius: int) -> np.ndarray:
    """All 64-bit masks of at most `radius` bits."""
    found = [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(64), r)]
    return np.array(found, dtype=np.uint64)


def mask_bits(ball: np.ndarray) -> int:
    """Bits that hold the number of any mask of the ball."""
    return max(MASK_BITS, (len(ball) - 1).bit_length())


def syndromes(fps: np.ndarray) -> np.ndarray:
    """3-bit XOR of the numbers (mod 8) of the bits that are set: linear, so equal variants agree."""
    out = np.zeros(len(fps), dtype=np.uint8)
    for k in range(3):
        column = np.uint64(sum(1 << i for i in range(64) if i >> k & 1))
        out |= ((np.bitwise_count(fps & column) & 1) << k).astype(np.uint8)
    return out


def _emit(bits: int, number: int, half: int):
    """Expands fingerprints to the packed variants of one round's syndrome, one binary a bucket."""

    def work(batches):
        with np.errstate(over="ignore"):
            ball = masks(half)
            kinds, low = syndromes(ball), np.uint64((1 << mask_bits(ball)) - 1)
            chunk = max(1, (CHUNK << MASK_BITS) // max(1 << MASK_BITS, len(ball)))
            for batch in batches:
                fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
                for at in range(0, len(fps), chunk):
                    part, packed = fps[at : at + chunk], []
                    own = syndromes(part)
                    for s in range(ROUNDS):
                        numbers = np.flatnonzero(kinds == s ^ number).astype(np.uint64)
                        mixed = (part[own == s, None] ^ ball[numbers][None, :]) * np.uint64(MIX)
                        buckets = (mixed >> np.uint64(64 - bits)).astype(np.uint32)
                        mixed <<= np.uint64(bits)
                        mixed &= ~low
                        mixed |= numbers[None, :]
                        packed.append((buckets.ravel(), mixed.ravel()))
                    buckets, keys = (np.concatenate(x) for x in zip(*packed, strict=True))
                    order = np.argsort(buckets, kind="stable")
                    buckets, keys = buckets[order], keys[order]
                    heads = np.flatnonzero(np.diff(buckets, prepend=np.uint32(0xFFFFFFFF)))
                    blobs = [keys[a:b].tobytes() for a, b in zip(heads, [*heads[1:], len(keys)], strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(buckets[heads].astype(np.int64)), pa.array(blobs, pa.binary())], names=["bucket", "keys"])

    return work


def _collisions(bucket: int, blobs: list, bits: int, ball: np.ndarray, radius: int) -> np.ndarray:
    """Links of one bucket: fingerprints of equal variants, each to the least, repeats dropped."""
    low = np.uint64((1 << mask_bits(ball)) - 1)
    keys = np.frombuffer(b"".join(blobs), dtype=np.uint64).copy()
    keys.sort()
    variants = keys >> np.uint64(mask_bits(ball))
    same = variants[1:] == variants[:-1]
    held = np.flatnonzero(np.append(same, False) | np.append(False, same))
    keys, variants = keys[held], variants[held]
    # A key has the mixed variant's bits below the bucket's at its top, then the mask's number.
    mixed = (np.uint64(bucket) << np.uint64(64 - bits)) | ((keys & ~low) >> np.uint64(bits))
    fps = (mixed * np.uint64(UNMIX)) ^ ball[(keys & low).astype(np.int64)]
    order = np.lexsort((fps, variants))
    fps, variants = fps[order], variants[order]
    first = np.flatnonzero(np.append(True, variants[1:] != variants[:-1])[: len(variants)])
    least = np.repeat(fps[first], np.diff([*first, len(fps)])) if len(fps) else fps
    pairs = np.unique(np.stack([least, fps], axis=1)[least != fps], axis=0)
    return pairs[np.bitwise_count(pairs[:, 0] ^ pairs[:, 1]) <= radius]


def _collide(bits: int, half: int, radius: int):
    """Streams a partition's blobs in the order of their buckets and gives its links."""

    def batch_of(pairs: list) -> pa.RecordBatch:
        done = np.unique(np.concatenate(pairs), axis=0).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(done[:, 0]), pa.array(done[:, 1])], names=["a", "b"])

    def work(batches):
        with np.errstate(over="ignore"):
            ball, now, blobs, pairs = masks(half), None, [], [np.empty((0, 2), np.uint64)]
            for batch in batches:
                for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if bucket != now and blobs:
                        pairs.append(_collisions(now, blobs, bits, ball, radius))
                        blobs = []
                        if sum(map(len, pairs)) > LINKS:
                            yield batch_of(pairs)
                            pairs = []
                    now = bucket
                    blobs.append(blob)
            if blobs:
                pairs.append(_collisions(now, blobs, bits, ball, radius))
            if pairs:
                yield batch_of(pairs)

    return work


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between the distinct fingerprints `fp` that keep every component of distance <= radius.

    A round takes the variants of one syndrome, an eighth of all. The radius is even: at odd
    ones fingerprints of one variant can be further apart, and a link by the least could be lost.
    """
    if radius < 0 or radius % 2:
        raise ValueError(f"radius {radius} is not an even number")
    spark, half = distinct.sparkSession, radius // 2
    path, ball = scratch(spark), masks(half)
    total = max(1, distinct.count() * len(ball) // ROUNDS)
    bits = max(mask_bits(ball), (total // BUCKET).bit_length())
    shuffled = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // (PARTITION * BUCKET))
    for n in range(ROUNDS):
        sent = distinct.select("fp").mapInArrow(_emit(bits, n, half), "bucket bigint, `keys` binary")
        dealt = sent.repartition(shuffled, "bucket").sortWithinPartitions("bucket")
        stored(dealt.mapInArrow(_collide(bits, half, radius), "a bigint, b bigint"), f"{path}/links", "append")
    return spark.read.schema("a bigint, b bigint").parquet(f"{path}/links")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, size: int = 4) -> DataFrame:
    """One row a document: id, `fp` and `component_id`, the least id reachable over links of <= radius bits."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    ids = quoted(id_col)
    docs = stored(fingerprints(df.select(ids, quoted(text_col)), text_col, size), f"{path}/fps")
    distinct = stored(docs.groupBy("fp").agg(F.min(ids).alias("least")), f"{path}/distinct")
    groups = components(fingerprint_links(distinct, radius))
    named = distinct.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = stored(named, f"{path}/named")
    # A table of its own, so that the join with it is a plain one, which splits a large component.
    least = stored(named.groupBy("component").agg(F.min("least").alias("component_id")), f"{path}/least")
    # One row a fingerprint, joined to the documents; hot fingerprints are split by the skew join.
    ids_of = stored(named.join(least, "component").select("fp", "component_id"), f"{path}/ids")
    return docs.join(ids_of, "fp")
