"""Benchmark decontamination: Wu-Manber search for all windows of the benchmark at once.

The symbols are words.  Windows of one length share a shift table over hashed blocks of two
words: a block that no window holds lets the search skip nearly a whole window.  Where the shift
is 0 the block ends some window; the bucket of that suffix block names the windows to compare
word by word.  A document is searched where it lies, so nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, ship, sliced, staged, UPPER, WORD_BYTES

#: Benchmark text of at most so many bytes is searched for, and broadcast, at a time.
BLOCK_BYTES = 16 << 20
TABLE_BITS = 20
RESULT = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, spans array<struct<start:int,end:int>>"


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


class Tables:
    """Shift table and suffix buckets for windows that all have ``length`` words."""

    def __init__(self, length: int, windows: dict[tuple[int, ...], tuple[str, ...]]):
        self.length, self.block = length, min(2, length)
        self.shift = np.full(1 << TABLE_BITS, length - self.block + 1, np.uint16)
        self.bucket: dict[int, dict] = defaultdict(dict)
        for window, items in windows.items():
            codes = self.codes(np.array(window, np.int64))
            np.minimum.at(self.shift, self.slots(codes), np.arange(len(codes) - 1, -1, -1, dtype=np.uint16))
            self.bucket[int(codes[-1])][window] = items

    def codes(self, ids: np.ndarray) -> np.ndarray:
        return ids if self.block == 1 else (ids[:-1] << 31) + ids[1:]

    @staticmethod
    def slots(codes: np.ndarray) -> np.ndarray:
        return (codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)

    def search(self, ids: np.ndarray, hit: np.ndarray, items: set[str]) -> None:
        """Marks the words of every occurrence and gathers the items."""
        n, m = len(ids), self.length
        if n < m:
            return
        codes = self.codes(ids)
        shifts = self.shift[self.slots(codes)].tolist()
        at, back, last = m - self.block, m - self.block, len(shifts)
        while at < last:
            skip = shifts[at]
            if skip:
                at += skip
                continue
            bucket = self.bucket.get(int(codes[at]))
            if bucket:
                start = at - back
                owners = bucket.get(tuple(ids[start : start + m].tolist()))
                if owners:
                    hit[start : start + m] = True
                    items.update(owners)
            at += 1


class Windows:
    """All windows of some benchmark items, ready for searching."""

    def __init__(self, items: list[tuple[str, bytes]], length: int):
        self.ids: dict[bytes, int] = {}
        by_length: dict[int, dict] = defaultdict(lambda: defaultdict(set))
        for item, text in items:
            ids = [self.ids.setdefault(w, len(self.ids) + 1) for w in words_of(text)]
            size = min(length, len(ids))
            for i in range(len(ids) - size + 1 if ids else 0):
                by_length[size][tuple(ids[i : i + size])].add(item)
        self.tables = [Tables(m, {w: tuple(sorted(o)) for w, o in ws.items()}) for m, ws in sorted(by_length.items())]

    def search(self, text: bytes | None) -> tuple[np.ndarray, set[str]]:
        """Which words of the text are hit, and by which items."""
        known = self.ids.get
        ids = np.array([known(w, 0) for w in words_of(text)], np.int64)
        hit, items = np.zeros(len(ids), bool), set()
        if ids.any():
            for table in self.tables:
                table.search(ids, hit, items)
        return hit, items


def _blocks(benchmark: DataFrame, length: int, block_bytes: int, item: str, text: str) -> Iterator[tuple[Windows, bool]]:
    """The benchmark in blocks of bounded size, whatever its own size, and whether each is the last; only one is built at a time."""
    rows = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("item"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) if n > 1 else rows
        yield Windows([(r["item"], r["text"].encode()) for r in part.collect()], length), k == n - 1


def _texts(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    return batch.column(name).cast(pa.binary()).to_pylist()


def _spans(hit: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    return [(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2], strict=True)]


def contamination(docs: DataFrame, benchmark: DataFrame, length: int = 10, block_bytes: int = BLOCK_BYTES, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document: words, words hit, items found, and the spans [start, end) hit.

    A null, empty or wordless text has no words and no hits; repeated rows stay repeated; a
    benchmark without words hits nothing, an empty table of documents gives no rows.  Items count by
    their id; a null id reads ``null``, and items that share an id are one.  Very long texts are searched whole.
    Only key and text are read, whatever other columns are called.  A benchmark over ``block_bytes`` is
    searched block by block: the driver holds one block, and documents are written with their hits in between.
    """
    spark = docs.sparkSession
    ship(spark)
    state = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"), F.expr("array() :: array<struct<start:int,end:int>>").alias("spans"), F.expr("array() :: array<string>").alias("items"))
    for windows, final in _blocks(benchmark, length, block_bytes, item, item_text):
        shared = spark.sparkContext.broadcast(windows)

        def scan(batches, shared=shared, final=final):
            windows = shared.value
            for batch in sliced(batches):
                out = []
                for doc, value, spans, items in zip(batch.column("doc_id").to_pylist(), _texts(batch, "text"), batch.column("spans").to_pylist(), batch.column("items").to_pylist(), strict=True):
                    hit, found = windows.search(value)
                    for s in spans:
                        hit[s["start"] : s["end"]] = True
                    found.update(items)
                    merged = [{"start": a, "end": b} for a, b in _spans(hit)]
                    if final:
                        names = ",".join(sorted(found))
                        out.append((doc, len(hit), int(hit.sum()), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit.any()), merged))
                    else:
                        out.append((doc, value and value.decode(), merged, sorted(found)))
                names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"] if final else ["doc_id", "text", "spans", "items"]
                span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), span] if final else [pa.int64(), pa.string(), span, pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=names)

        state = state.mapInArrow(scan, RESULT if final else state.schema)
        if not final:
            state = staged(state)
            shared.unpersist()
    return state


def without_contaminated(docs: DataFrame, benchmark: DataFrame, length: int = 10, block_bytes: int = BLOCK_BYTES, text: str = "text") -> DataFrame:
    """The documents in which no benchmark window occurs, with all their columns; those without words stay, and so do repeated rows.

    An empty table gives no rows, an empty benchmark takes none away, very long texts are searched whole.  Each block of the benchmark is one
    pass over the documents that are left.
    """
    ship(docs.sparkSession)
    for windows, final in _blocks(benchmark, length, block_bytes, "item_id", "text"):
        shared = docs.sparkSession.sparkContext.broadcast(windows)

        def clean(batches, shared=shared):
            for batch in sliced(batches):
                keep = [not shared.value.search(value)[1] for value in _texts(batch, text)]
                yield batch.filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
        if not final:
            docs = staged(docs)
            shared.unpersist()
    return docs


def oracle(length: int = 10) -> str:
    """DuckDB SQL for contamination over documents and benchmark, by a join of all windows."""
    words = lambda c: f"list_filter(regexp_split_to_array(translate(coalesce({c}, ''), '{UPPER}', '{LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"
    return f"""
    WITH d AS (SELECT doc_id, {words('text')} AS w FROM documents),
    b AS (SELECT item_id, {words('text')} AS w FROM benchmark),
    windows AS (
        SELECT DISTINCT item_id, size, array_to_string(w[i : i + size - 1], ' ') AS words
        FROM (SELECT item_id, w, least({length}, len(w)) AS size, unnest(range(1, len(w) - least({length}, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
    ), sizes AS (SELECT DISTINCT size FROM windows),
    places AS (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size),
    met AS (SELECT doc_id, item_id, i, p.size FROM places p JOIN windows x ON x.size = p.size AND x.words = array_to_string(p.w[i : i + p.size - 1], ' ')),
    hits AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM met) GROUP BY 1),
    items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS names FROM met GROUP BY 1)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)"""
