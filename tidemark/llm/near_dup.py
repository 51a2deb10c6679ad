"""MinHash near-duplicates with tensored banding.

A document is the set of its shingles.  Two collections of BUNDLES bundles of ROWS minhashes each
give BUNDLES^2 tables: the key of table (i, j) joins bundle i of the first collection with
bundle j of the second.  81 tables of 6 hashes so need 54 minhashes instead of 486.  A pair at
the threshold of 0.85 shares no key with a chance of 2 * (1 - 0.85^3)^9 = 0.0004, one at 0.9 with
0.00002.  A lower threshold takes shorter bundles: at 0.8 those of 2 hashes, 2 * (1 - 0.8^2)^9 = 0.0002.

Documents with equal sets are one class.  In every table each class is compared with one class
of its bucket, the pivot: the one that shares most buckets, so the original of a group of edited copies
rather than a copy.  That needs no pairs within buckets.  The links give components.  Then only
buckets that still hold several components are gone through again, for classes that their pivot did not take in.
Each class carries a parity sketch: a bit is set if an odd number of its shingles fall on it.  What
two classes share cancels in the exclusive or, so its bits can't outnumber the shingles in which they
differ; pairs with more bits than a link allows are left out, exactly.
Every link is confirmed on the full sets.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, large, LOWER_BYTES, shared_folder, ship, sliced, staged

SHINGLE, PERCENT = 3, 85
BUNDLES, ROWS = 9, 3
#: A pair at the threshold shares no key with this chance at most.
LOSS = 0.0004
#: Bits of a parity sketch.
SKETCH = 512
REMEMBERED = 100_000

_ODD = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3]
_words: dict[bytes, int] = {}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def banding(percent: int) -> tuple[int, int]:
    """Bundles in a collection and minhashes in a bundle that lose at most LOSS of the pairs at the threshold."""
    at = min(max(percent, 1), 99) / 100
    for rows in range(ROWS, 0, -1):
        n = math.ceil(math.log(LOSS / 2) / math.log(1 - at**rows))
        if n <= BUNDLES:
            return BUNDLES, rows
    return n, 1


_seeds: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    """What n minhashes are mixed with."""
    if n not in _seeds:
        both = _mixed(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(_ODD[0]))
        _seeds[n] = both[:n, None], both[n:, None] | np.uint64(1)
    return _seeds[n]


def shingles(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """The sorted 64-bit hashes of the distinct shingles; with fewer words, of all words as one."""
    words = text.translate(LOWER_BYTES).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    known = list(map(_words.get, words))
    if None in known:
        if len(_words) > REMEMBERED:
            _words.clear()
        for i, v in enumerate(known):
            if v is None:
                known[i] = xxhash.xxh64_intdigest(words[i]) >> 1
                if len(words[i]) < 64:
                    _words[words[i]] = known[i]
    h = np.array(known, np.int64).astype(np.uint64)
    width = min(size, len(h))
    sums = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        sums = _mixed(sums * np.uint64(_ODD[i % len(_ODD)]) + h[i : len(h) - width + 1 + i])
    return np.unique(sums)


def bundles(hashes: np.ndarray, n: int = BUNDLES, rows: int = ROWS) -> list[int]:
    """The n bundles of each collection, one after the other."""
    xor, times = seeds(2 * n * rows)
    least = np.full(2 * n * rows, np.uint64(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(hashes), 1 << 13):
        least = np.minimum(least, ((hashes[None, i : i + (1 << 13)] ^ xor) * times).min(axis=1))
    grouped = least.reshape(2 * n, rows)
    out = np.zeros(2 * n, np.uint64)
    for k in range(rows):
        out = _mixed(out * np.uint64(_ODD[1]) + grouped[:, k])
    return out.view(np.int64).tolist()


def sketch(hashes: np.ndarray) -> list[int]:
    """The parity of the number of shingles on each bit, as 64-bit integers."""
    odd = np.bincount((hashes >> np.uint64(20)).astype(np.int64) % SKETCH, minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def digest(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def text_key(text: Column) -> Column:
    """128 bits that tell texts apart."""
    return F.unhex(F.md5(text.cast("binary")))


def signatures(docs: DataFrame, key: str, text: str, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_key, n_shingles, set_key (null for an empty set), bundles and sketch of every row."""
    n, width = banding(percent)

    ship(docs.sparkSession)
    def signed(batches):
        for batch in sliced(batches):
            counts, keys, found, marks = [], [], [], []
            for value in batch.column("text").cast(pa.binary()).to_pylist():
                hashes = shingles(value, size)
                counts.append(len(hashes))
                keys.append(digest(hashes) if len(hashes) else None)
                found.append(bundles(hashes, n, width) if len(hashes) else None)
                marks.append(sketch(hashes) if len(hashes) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(found, pa.list_(pa.int64())), pa.array(marks, pa.list_(pa.int64()))], names=["doc_id", "text_key", "n_shingles", "set_key", "bundles", "sketch"])

    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"), text_key(F.col(text)).alias("text_key"))
    return rows.mapInArrow(signed, "doc_id bigint, text_key binary, n_shingles bigint, set_key binary, bundles array<bigint>, sketch array<bigint>")


def table_keys(classes: DataFrame, n: int = BUNDLES) -> DataFrame:
    """(key, node) for every class and table."""
    first = F.sequence(F.lit(1), F.lit(n))
    left = classes.select("node", "bundles", F.explode(first).alias("i")).select("node", "bundles", "i", F.element_at("bundles", F.col("i")).alias("a"))
    both = left.select("node", "i", "a", F.posexplode(F.slice("bundles", n + 1, n)).alias("j", "b"))
    return both.select(F.xxhash64("i", "a", "j", "b").alias("key"), "node")


def first_key(bundles: Column, others: Column, n: int = BUNDLES) -> Column:
    """The key of the first table in which two classes meet."""

    def first(start: int) -> Column:
        same = F.zip_with(F.slice(bundles, start, n), F.slice(others, start, n), lambda x, y: x == y)
        return F.array_position(same, F.lit(True)).cast("int")

    i, j = first(1), first(n + 1)
    return F.xxhash64(i, F.element_at(bundles, i), j - 1, F.element_at(bundles, j + n))


def measured(pairs: DataFrame, texts: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(a, b, common, united) of each pair (a, b) of nodes, from the full texts (node, set_key, text)."""
    first = texts.select(F.col("node").alias("a"), F.col("set_key").alias("key_a"), F.col("text").alias("text_a"))
    second = texts.select(F.col("node").alias("b"), F.col("set_key").alias("key_b"), F.col("text").alias("text_b"))
    met = pairs.select("a", "b").join(large(first), "a").join(large(second), "b")
    ship(pairs.sparkSession)

    def counted(batches):
        last: tuple = (None, None)
        for batch in sliced(batches):
            out = []
            columns = [batch.column(c).to_pylist() for c in ("a", "b", "key_a", "key_b")]
            texts_a, texts_b = (batch.column(c).cast(pa.binary()).to_pylist() for c in ("text_a", "text_b"))
            for a, b, key_a, key_b, text_a, text_b in zip(*columns, texts_a, texts_b, strict=True):
                if last[0] != a:
                    last = (a, shingles(text_a, size))
                x, y = last[1], shingles(text_b, size)
                if digest(x) == key_a and digest(y) == key_b:
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    out.append((a, b, common, len(x) + len(y) - common))
                else:
                    last = (None, None)  # rows of another text under the same doc_id
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(4)], names=["a", "b", "common", "united"])

    return met.select("a", "b", "key_a", "key_b", "text_a", "text_b").mapInArrow(counted, "a bigint, b bigint, common bigint, united bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): the smallest node reachable.

    Each round takes the least root among a node's neighbours and then the root of that root; the
    rounds end when nothing changes.  Rounds are written to the shared folder, which cuts the lineage.
    """
    spark = edges.sparkSession
    folder = shared_folder(spark)
    both = staged(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), f"{folder}/edges")
    roots = staged(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("root")), f"{folder}/0")
    k = 0
    while True:
        k += 1
        near = both.join(large(roots), both["b"] == roots["node"]).groupBy("a").agg(F.min("root").alias("near"))
        new = roots.join(large(near.withColumnRenamed("a", "node")), "node").select("node", "root", F.least("root", "near").alias("next"))
        jump = roots.select(F.col("node").alias("next"), F.col("root").alias("jumped"))
        new = new.join(large(jump), "next").select("node", F.least("next", "jumped").alias("root"), (F.least("next", "jumped") != F.col("root")).alias("changed"))
        new = staged(new, f"{folder}/{k}")
        more = new.where("changed").limit(1).count()
        discard(spark, f"{folder}/{k - 1}")
        roots = new.drop("changed")
        if not more:
            return roots


def grouped(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, text_key, set_key, n_shingles, n_equal, and first: the doc_id and the text_key of
    the first row of its component, by doc_id with null at the end and then by text; null without shingles.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark)
    n, _ = banding(percent)
    signed = staged(signatures(docs, key, text, size, percent), f"{folder}/signed")
    classes = signed.where("set_key is not null").groupBy("set_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("rep"), F.count("*").alias("n_equal"), F.first("n_shingles").alias("n"), F.first("bundles").alias("bundles"), F.first("sketch").alias("sketch"))
    classes = staged(classes.withColumn("node", F.monotonically_increasing_id()), f"{folder}/classes")

    # Tables: every class that shares a bucket, and the bucket's pivot.
    rows = table_keys(classes, n)
    sizes = rows.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    members = staged(rows.join(large(sizes), "key"), f"{folder}/members")
    shares = members.groupBy("node").agg(F.sum("members").alias("shares"))
    pivots = members.select("key", "node").join(large(shares), "node").groupBy("key").agg(F.max_by("node", F.struct("shares", "node")).alias("a"))
    pivots = staged(pivots, f"{folder}/pivots")
    tested = staged(members.join(large(pivots), "key").where(F.col("node") != F.col("a")).select("a", F.col("node").alias("b")).distinct(), f"{folder}/tested")

    held = members.select("node").distinct().join(large(classes.select("node", "set_key", F.col("rep.doc_id").alias("rep"), F.col("rep.text_key").alias("rep_text"))), "node")
    own = docs.select(F.col(key).cast("bigint").alias("rep"), F.col(text).alias("text"), text_key(F.col(text)).alias("rep_text")).where(F.col("text").isNotNull()).withColumnRenamed("rep", "own")
    texts = own.join(large(held), own["own"].eqNullSafe(held["rep"]) & (own["rep_text"] == held["rep_text"])).select("node", "set_key", "text").dropDuplicates(["node"])  # once, however often its row repeats
    texts = staged(texts, f"{folder}/texts")
    linked = F.col("common") * 100 >= F.col("united") * percent
    links = staged(measured(tested, texts, size).where(linked).select("a", "b"), f"{folder}/links")
    roots = components(links)

    # Buckets that hold several components: classes apart from their pivot against all others.
    placed = members.select("key", "node").join(large(roots), "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    main = pivots.join(large(mixed), "key").select("key", F.col("a").alias("node")).join(large(roots), "node", "left").select("key", F.coalesce("root", "node").alias("main"))
    left = staged(placed.join(large(main), "key").join(large(classes.select("node", "n", "sketch", "bundles")), "node"), f"{folder}/left")
    other = left.select("key", F.col("node").alias("b"), F.col("n").alias("m"), F.col("root").alias("other_root"), (F.col("root") != F.col("main")).alias("apart"), F.col("sketch").alias("other_sketch"), F.col("bundles").alias("other_bundles"))
    differ = F.lit(0)
    for i in range(SKETCH // 64):
        differ = differ + F.bit_count(F.col("sketch")[i].bitwiseXOR(F.col("other_sketch")[i]))
    able = (F.col("root") != F.col("other_root")) & (differ * (100 + percent) <= (F.col("n") + F.col("m")) * (100 - percent))
    once = first_key(F.col("bundles"), F.col("other_bundles"), n) == F.col("key")
    rest = left.where("root <> main").join(large(other), "key").where(able & (~F.col("apart") | (F.col("node") < F.col("b"))) & once)
    rest = staged(rest.select(F.col("node").alias("a"), "b").distinct(), f"{folder}/rest")
    more = staged(measured(rest, texts, size).where(linked).select("a", "b"), f"{folder}/more")
    if more.limit(1).count():
        roots = components(links.union(more))

    named = classes.select("node", "set_key", "rep", "n_equal").join(large(roots), "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("rep").alias("first"))
    classes_out = staged(named.join(large(least), "root").select("set_key", "first", "n_equal"), f"{folder}/named")
    for name in ("members", "pivots", "tested", "texts", "links", "left", "rest", "more"):
        discard(spark, f"{folder}/{name}")
    out = signed.select("doc_id", "text_key", "n_shingles", "set_key").join(large(classes_out), "set_key", "left")
    return out.withColumn("n_equal", F.coalesce("n_equal", F.lit(1)).cast("bigint"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, n_equal (rows with an equal set).

    ``component_id`` is the smallest doc_id that links reach, ``kept`` whether it is the own one.
    A null, empty or wordless text has no shingles and links with nothing; a null doc_id takes
    part but is never a component_id nor kept.  Repeated rows stay repeated, rows that tie for the smallest
    doc_id are all kept, an empty table gives no rows.  Very long texts are compared whole.  Only key and text
    are read, whatever other columns are called.
    """
    component = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id"))
    return grouped(docs, percent, size, key, text).select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"), "n_equal")


def one_of_each(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without near-duplicates: of each component one row with all columns, that of its smallest doc_id and,
    where rows share it, of the first text by hash.

    Rows that repeat both doc_id and text are one document.  A null doc_id comes after all others.  Texts
    without shingles link with nothing and stay; an empty table gives no rows; very long texts are compared whole.
    """
    is_first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))
    gone = grouped(docs, percent, size, key, text).where(F.col("set_key").isNotNull() & ~is_first).select(F.col("doc_id").alias("_gone"), F.col("text_key").alias("_gone_text")).distinct()
    same = F.col(key).cast("bigint").eqNullSafe(F.col("_gone")) & (text_key(F.col(text)) == F.col("_gone_text"))
    return docs.join(large(gone), same, "left_anti").dropDuplicates([key, text])


def oracle(percent: int = PERCENT) -> str:
    """DuckDB SQL for near_duplicates over documents: all pairs that share a shingle, then reachability."""
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
    WITH RECURSIVE d AS (
        SELECT doc_id, list_filter(regexp_split_to_array({lower}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
    ), s AS (
        SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 OR w IS NULL THEN [] WHEN len(w) < {SHINGLE} THEN [array_to_string(w, ' ')]
               ELSE list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i : i + {SHINGLE - 1}], ' ')) END) AS g FROM d
    ), one AS (SELECT doc_id, CAST(len(g) AS BIGINT) AS n, unnest(g) AS g FROM s),
    pairs AS (
        SELECT x.doc_id AS a, y.doc_id AS b FROM one x JOIN one y ON x.g = y.g AND x.doc_id < y.doc_id
        GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING count(*) * 100 >= (x.n + y.n - count(*)) * {percent}
    ), edges AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
    reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
    least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
    SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN least USING (doc_id)"""
