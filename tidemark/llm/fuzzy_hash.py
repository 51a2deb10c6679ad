"""Document fingerprints: context-triggered piecewise hashing.

A rolling hash over seven bytes ends a chunk wherever it meets the block size, so an edit moves
only the chunks near it.  Each chunk gives one of 64 characters; a fingerprint is
``block:signature:signature at twice the block``.  Block sizes are 3 * 2^k.  Two fingerprints are
compared by the edit distance of signatures made with the same block size.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import count_below, ship, sliced, width

WINDOW, LEAST_BLOCK, LENGTH = 7, 3, 64
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
RESULT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

_ROLL = 0x2C9277B5
_BASE = 0x9E3779B97F4A7C15 | 1
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _grow(n: int) -> None:
    """Powers of the odd base and of its inverse modulo 2^64, as far as needed."""
    global _powers, _inverses
    if len(_powers) < n:
        n = max(n, 2 * len(_powers))
        for name, base in (("_powers", _BASE), ("_inverses", pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            globals()[name] = np.multiply.accumulate(steps)


def _rolling(data: np.ndarray) -> np.ndarray:
    wide, out, factor = data.astype(np.uint32), np.zeros(len(data), np.uint32), 1
    for k in range(min(WINDOW, len(data))):
        out[k:] += wide[: len(data) - k] * np.uint32(factor)
        factor = factor * _ROLL & 0xFFFFFFFF
    return (out * np.uint32(0x85EBCA6B)) >> np.uint32(4)


def _signature(sums: np.ndarray, ends: np.ndarray, most: int) -> str:
    """One character for each chunk; what follows the last but one allowed end is one chunk."""
    n = len(sums) - 1
    ends = ends[: most - 1]
    ends = ends if len(ends) and ends[-1] == n else np.append(ends, n)
    starts = np.concatenate([[0], ends[:-1]])
    hashes = (sums[ends] - sums[starts]) * _inverses[starts] * np.uint64(0xD6E8FEB86659FD93)
    hashes ^= hashes >> np.uint64(32)
    return ALPHABET[((hashes * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(58)).astype(np.intp)].tobytes().decode()


def fingerprint(data: bytes) -> str:
    """Of any bytes; those of no bytes are ``3::``."""
    if not data:
        return f"{LEAST_BLOCK}::"
    raw = np.frombuffer(data, np.uint8)
    _grow(len(raw) + 1)
    roll = _rolling(raw)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers[: len(raw)], dtype=np.uint64)])
    block = LEAST_BLOCK
    while block * LENGTH < len(raw):
        block *= 2
    while True:
        ends = np.flatnonzero(roll % np.uint32(block) == block - 1) + 1
        if len(ends) >= LENGTH // 2 or block == LEAST_BLOCK:
            break
        block //= 2
    wider = ends[roll[ends - 1] % np.uint32(2 * block) == 2 * block - 1]
    return f"{block}:{_signature(sums, ends, LENGTH)}:{_signature(sums, wider, LENGTH // 2)}"


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance, a column of the table at a time as the bits of one integer."""
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    top, mask = 1 << len(a) - 1, (1 << len(a)) - 1
    up, down, distance = mask, 0, len(a)
    for c in b:
        same = places.get(c, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        plus, minus = down | ~(diagonal | up) & mask, up & diagonal
        distance += bool(plus & top) - bool(minus & top)
        plus, minus = (plus << 1 | 1) & mask, minus << 1 & mask
        up, down = minus | ~(diagonal | plus) & mask, plus & diagonal
    return distance


def likeness(a: str, b: str) -> float:
    """1 for equal fingerprints, else the best of 1 - distance / length at a shared block size, 0 without one."""
    if a == b:
        return 1.0
    (size_a, *signs_a), (size_b, *signs_b) = a.split(":"), b.split(":")
    best = 0.0
    for i, x in enumerate(signs_a):
        for j, y in enumerate(signs_b):
            if int(size_a) << i == int(size_b) << j and x and y:
                best = max(best, 1 - edit_distance(x, y) / max(len(x), len(y)))
    return best


def edited(text: str, following: str) -> str:
    """The last half (rounded down) of the code points replaced by the first as many of ``following``, or all."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def place(doc_id: Column, text: Column) -> Column:
    """Sorts as descending doc_id, null last, then as descending hash of the text: digits of equal length."""
    digits = lambda c: F.lpad(F.hex(c), 16, "0")
    turned = lambda c: F.bitwise_not(c.bitwiseXOR(F.lit(-(1 << 63))))
    number = F.when(doc_id.isNull(), F.lit("1" + "0" * 16)).otherwise(F.concat(F.lit("0"), digits(turned(doc_id))))
    return F.concat(number, digits(turned(F.xxhash64(text))))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness to each other and to the next document's.

    The next document is the next lower doc_id, after the last one the first; a table of one row
    is its own next.  A null doc_id comes last, rows with the same doc_id go by the hash of their
    texts, null texts count as empty.  Repeated rows stay repeated, an empty table gives no rows.  A very long
    text is hashed whole; it takes about 40 bytes of memory a byte while it is.  Only key and text are read,
    whatever other columns are called.

    The order is that of ``place``, which ranges documents into buckets: rows of one doc_id, or of none, go by the hash of
    their text, so no number is one task (rows that repeat both are neighbours and stay together).  The first row of a bucket
    also goes to the bucket before it, so each text is shuffled about once and no window spans the table.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("place", place(F.col("doc_id"), F.col("text")))
    ranged = rows.select("place").repartitionByRange(4 * width(spark), "place")
    bounds = sorted(r["least"] for r in ranged.groupBy(F.spark_partition_id()).agg(F.min("place").alias("least")).collect())  # one a bucket
    rows = rows.withColumn("bucket", count_below(bounds[1:], F.concat("place", F.lit("~")), "string"))  # "~" follows all digits: equal bounds count
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("peek"))
    peek = F.struct(F.pmod(F.col("bucket") - 1, F.lit(max(len(bounds), 1))).alias("bucket"), F.lit(True).alias("peek"))
    heads = F.get(F.split(F.lit(",".join(bounds)), ","), F.col("bucket"))
    rows = rows.select("doc_id", "text", "place", F.explode(F.when(F.col("place") == heads, F.array(own, peek)).otherwise(F.array(own))).alias("at"))
    rows = rows.select("doc_id", "text", "place", "at.bucket", "at.peek").repartition(width(spark), "bucket")
    rows = rows.sortWithinPartitions("bucket", "peek", "place", F.col("text").desc())

    ship(docs.sparkSession)
    def judged(batches):
        last, names = None, [f.split(" ")[0] for f in RESULT.split(", ")]
        for batch in sliced(batches):
            out = []
            for doc, value, at, peek in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "bucket", "peek")), strict=True):
                if peek and (last is None or last[3] != at):
                    continue
                mark = fingerprint(value.encode())
                if last is not None and last[3] == at:
                    changed = edited(last[1], value).encode()
                    other = fingerprint(changed)
                    out.append((last[0], len(last[1]), hashlib.sha256(changed).hexdigest(), last[2], other, likeness(last[2], other), likeness(last[2], mark)))
                last = None if peek else (doc, value, mark, at)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate([pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()])], names=names)

    return rows.mapInArrow(judged, RESULT)
