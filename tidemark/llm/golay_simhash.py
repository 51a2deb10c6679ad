"""SimHash near-duplicates, searched by Golay codes.

A fingerprint has 64 bits; bit i is 1 if it is set in over half the XXH64 hashes of a text's shingles.  Two
fingerprints link if at most ERRORS bits differ.

Fuzzy keys.  In the extended Golay code of 24 bits every word lies within distance 3 of one codeword, or at distance 4 of
exactly six, whose differences from it part the 24 places into tetrads.  The keys of a word are the numbers of that codeword or of
those six.  Words that differ in one bit share a key: one of the two is even, so at distance 0, 2 or 4 of its codewords,
and the other odd, at 1 or 3 of one.  From 0 or 2 the flipped bit leads to at most 3 from the same codeword, and from 4 it lies
in one of the tetrads and leads to 3 from that codeword.

Pigeonhole.  Fingerprints are cut into segments of 21, 21 and 22 bits (filled up with zeros to 24).  Of three errors either some
segment has none, and then one of the other two at most one: a key is the exact segment with a fuzzy key of another (6 tables, 33 or
34 bits).  Or each segment has exactly one: a key is one fuzzy key of each (one table, 36 bits, with two more of the parities, as an error
flips all three).  Every link so shares a key for certain; keys are numbers of at most 41 bits that tell tables apart.

Links.  Equal fingerprints are one node.  In every bucket each node is compared with one pivot, the node that shares most buckets;
the links give components.  Where a bucket holds several components, further pivots are drawn as long as that joins many, and what is
left is compared by pairs of different components that agree in one of four parts of the bits outside the exact segment, as
three errors leave one part alone.  So nothing is lost, and a group of close fingerprints makes no pairs.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTES, discard, large, shared_folder, ship, sliced, staged
from .near_dup import components

SHINGLE, SEED, ERRORS = 3, 42, 3
#: (first bit, number of bits) of each segment.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: Ordered pairs of segments: the first exact, the second fuzzy.
PAIRS = tuple(permutations(range(3), 2))
#: Pairs are made at once if at most so many for each row in a bucket, and pivots are drawn no more than so often.
PLENTY, DRAWS = 2, 6


def golay_parities() -> np.ndarray:
    """For each of the 12 information bits the 12 check bits: division by x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, and a parity bit."""
    generator, out = 0b101011100011, []
    for i in range(12):
        rest = 1 << (i + 11)
        for k in range(i + 11, 10, -1):
            if rest >> k & 1:
                rest ^= generator << (k - 11)
        out.append(rest | (rest.bit_count() + 1 & 1) << 11)
    return np.array(out, np.int64)


def golay_leaders() -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome (12 bits) the information bits of its lightest errors, and how many there are: 1 or 6."""
    checks = golay_parities()
    bits = [(0, 1 << i) for i in range(12)] + [(1 << i, int(checks[i])) for i in range(12)]
    found: dict[int, list[int]] = {0: [0]}
    sums = [(0, 0, -1)]
    for weight in range(1, 5):
        sums = [(info ^ bits[k][0], s ^ bits[k][1], k) for info, s, top in sums for k in range(top + 1, 24)]
        known = set(found)
        for info, s, _ in sums:
            if s not in known:
                found.setdefault(s, []).append(info)
    leaders, counts = np.zeros((4096, 6), np.int64), np.zeros(4096, np.int64)
    for s, infos in found.items():
        leaders[s, : len(infos)], counts[s] = infos, len(infos)
    return leaders, counts


_tables: list = []


def golay_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For words of 24 bits (12 of information above 12 of checks) up to six keys each, and how many."""
    if not _tables:
        leaders, counts = golay_leaders()
        info, checks = np.arange(4096), np.zeros(4096, np.int64)
        for i, c in enumerate(golay_parities().tolist()):
            checks ^= np.where(info >> i & 1, c, 0)
        _tables.extend((leaders, counts, checks))
    leaders, counts, checks = _tables
    info = words >> 12
    syndrome = (words & 4095) ^ checks[info]
    return info[:, None] ^ leaders[syndrome], counts[syndrome]


def table_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, key): every key of every fingerprint (int64)."""
    raw = prints.view(np.uint64)
    exact = [((raw >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    keys, counts = zip(*map(golay_keys, exact), strict=True)
    index, out = [], []

    def each(*sizes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Every combination of places below the sizes, for each fingerprint."""
        total = np.multiply.reduce(sizes)
        own = np.repeat(np.arange(len(total)), total)
        k = np.arange(len(own)) - np.repeat(np.cumsum(total) - total, total)
        places = []
        for size in sizes:
            k, rest = np.divmod(k, size[own])
            places.append(rest)
        return own, places

    for table, (a, b) in enumerate(PAIRS):
        own, (k,) = each(counts[b])
        index.append(own)
        out.append((table << 38) | (exact[a][own] << 12) | keys[b][own, k])
    own, places = each(*counts)
    odd = [np.bitwise_count(e).astype(np.int64) & 1 for e in exact]
    key = ((odd[0] ^ odd[1]) << 1 | (odd[0] ^ odd[2]))[own]
    for i, k in enumerate(places):
        key = key << 12 | keys[i][own, k]
    index.append(own)
    out.append((len(PAIRS) << 38) | key)
    return np.concatenate(index), np.concatenate(out)


def other_bits(table: int) -> list[int]:
    """The bits outside a table's exact segment, as four masks (signed)."""
    held = SEGMENTS[PAIRS[table][0]] if table < len(PAIRS) else (0, 0)
    free = [b for b in range(64) if not held[0] <= b < sum(held)]
    masks = [sum(1 << b for b in part.tolist()) for part in np.array_split(np.array(free), ERRORS + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def simhash(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes (uint64); 0 without any."""
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > len(hashes)).tobytes(), "big")


def shingle_hashes(text: bytes | None, size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of every shingle, repeats included; with fewer words, of all words as one."""
    words = text.translate(LOWER_BYTES).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (np.concatenate([[0], ends[:-1]])[: max(len(words) - size + 1, 1)]).tolist()
    ends = (ends[min(size, len(words)) - 1 :] - 1).tolist()
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends, strict=True)), np.uint64, len(starts))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """doc_id and node (the fingerprint as a signed integer) of every row."""
    ship(docs.sparkSession)

    def hashed(batches):
        for batch in sliced(batches):
            marks = [simhash(shingle_hashes(t, size)) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(marks, np.uint64).view(np.int64))], names=["doc_id", "node"])

    return docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(hashed, "doc_id bigint, node bigint")


def keyed(nodes: DataFrame) -> DataFrame:
    """(key, node) for every key of every node."""
    ship(nodes.sparkSession)

    def found(batches):
        for batch in sliced(batches, 4096):
            prints = batch.column("node").to_numpy(zero_copy_only=False)
            index, keys = table_keys(prints)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(prints[index])], names=["key", "node"])

    return nodes.select("node").mapInArrow(found, "key bigint, node bigint")


def near(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= ERRORS


def linked(nodes: DataFrame) -> DataFrame:
    """Links (a, b) between nodes that connect exactly what links of at most ERRORS bits connect."""
    spark = nodes.sparkSession
    folder = shared_folder(spark)
    rows = keyed(nodes)
    sizes = rows.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    members = staged(rows.join(large(sizes), "key"), f"{folder}/members")
    shares = members.groupBy("node").agg(F.sum("members").alias("shares"))
    pivots = members.select("key", "node").join(large(shares), "node").groupBy("key").agg(F.max_by("node", F.struct("shares", "node")).alias("a"))
    tested = members.join(large(pivots), "key").where((F.col("node") != F.col("a")) & near(F.col("node"), F.col("a")))
    links = staged(tested.select("a", F.col("node").alias("b")).distinct(), f"{folder}/links")

    # Buckets of several components: more pivots, then pairs between components that agree in a part of their bits.
    masks = F.array(*[F.array(*[F.lit(m) for m in other_bits(t)]) for t in range(len(PAIRS) + 1)])
    rest, before = members.select("key", "node"), None
    for draw in range(DRAWS + 1):
        roots = components(links)
        placed = rest.join(large(roots), "node", "left").withColumn("root", F.coalesce("root", "node"))
        placed = staged(placed, f"{folder}/placed{draw}")
        mixed = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max_by("node", F.xxhash64("node", F.lit(draw))).alias("a")).where("lo <> hi")
        rest = staged(placed.join(large(mixed.select("key", "a")), "key"), f"{folder}/rest{draw}")
        parts = rest.select("key", "node", "root", F.posexplode(F.get(masks, F.shiftright("key", 38).cast("int"))).alias("part", "mask"))
        parts = parts.select("key", "node", "root", "part", F.col("node").bitwiseAND(F.col("mask")).alias("bits"))
        in_part = parts.groupBy("key", "part", "bits").agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1))).first()[0] or 0
        left = rest.count()
        if in_part <= PLENTY * left or draw == DRAWS or (before is not None and 10 * left > 9 * before):
            break
        before = left
        drawn = rest.join(large(roots.select(F.col("node").alias("a"), F.col("root").alias("other"))), "a", "left")
        drawn = drawn.where((F.col("root") != F.coalesce("other", "a")) & near(F.col("node"), F.col("a")))
        links = staged(links.union(drawn.select("a", F.col("node").alias("b"))).distinct(), f"{folder}/links{draw}")
        rest = rest.select("key", "node")
    other = parts.select("key", "part", "bits", F.col("node").alias("b"), F.col("root").alias("other"))
    more = parts.join(large(other), ["key", "part", "bits"]).where((F.col("root") < F.col("other")) & near(F.col("node"), F.col("b")))
    out = staged(links.union(more.select(F.col("node").alias("a"), "b")).distinct(), f"{folder}/out")
    for name in ("members", "links", *[f"{n}{k}" for n in ("placed", "rest") for k in range(draw + 1)], *[f"links{k}" for k in range(draw)]):
        discard(spark, f"{folder}/{name}")
    return out


def simhash_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hexadecimal digits) and component_id, the smallest doc_id that links reach.

    A null, empty or wordless text has the fingerprint zero, which links like any other.  A null doc_id takes part but is
    no component_id; a component of such rows only has none.  Repeated rows stay repeated, an empty table gives no rows.  Very long
    texts are hashed whole.  Only key and text are read, whatever other columns are called.
    """
    folder = shared_folder(docs.sparkSession)
    rows = staged(fingerprints(docs, key, text, size), f"{folder}/rows")
    nodes = staged(rows.groupBy("node").agg(F.min("doc_id").alias("first")), f"{folder}/nodes")
    roots = components(linked(nodes))
    named = nodes.join(large(roots), "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = staged(named.join(large(least), "root").select("node", "component_id"), f"{folder}/named")
    return rows.join(large(named), "node").select("doc_id", F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), "component_id")
