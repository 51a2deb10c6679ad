"""Token-ID output: document by document zstandard frames under one shared dictionary.

A store is a folder with two tables.  ``dictionary`` has one row: the dictionary's bytes and
their SHA-256.  ``blocks`` has rows of up to about a megabyte: the frames of consecutive
documents one after the other, with the offset, the number of ids and the doc_id of each, the
least and the largest doc_id, and the dictionary's hash, so one document is read by slicing and
decompressing its own frame.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import gathered, literal_rows, ship, sliced, sums_by, width

#: The dictionary is trained on about so many documents, evenly hashed, and on so many ids of each.
SAMPLE_DOCS, SAMPLE_IDS, DICTIONARY_BYTES = 1000, 4096, 64 << 10
BLOCK_BYTES, BLOCK_DOCS = 1 << 20, 4096
LEVEL = 3
END_ID = 0
#: Encodings of so many pieces of text are remembered by a Python worker.
REMEMBERED = 400_000
#: New pieces that the library gets in one call.
TOGETHER = 64
BLOCKS = "first bigint, least bigint, most bigint, doc_ids array<bigint>, counts array<int>, offsets array<int>, dictionary_sha256 string, id_bytes int, payload binary"
RESULT = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"

#: Where the quick cuts would be wrong: white space after white space, or a stop or comma after anything but a letter or digit.
_SPACES, _STOPS = r"[\pZ\s\x0b\x1c-\x1f\x85]{2}", r"(^|[^\pL\pN])[.,]"
#: White space followed by other characters.  The controls 1C-1F are no white space to tokenizers.
_CHUNK = re.compile(r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+")
_PLAIN = re.compile(r" ?\S{1,64}").fullmatch
_CUT = "\x01"
_encoders: dict[str, Encoder] = {}


class Encoder:
    """Encodes texts piece by piece and remembers pieces.

    Byte-level vocabularies split a text, before any merge, into words with at most one space before
    them, runs of other signs, and white space.  So a text may be cut before white space that
    follows something else, after a single line end, and between a letter or digit and a stop or comma.
    Arrow cuts a batch of texts and finds its distinct pieces; only those are looked up or encoded.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        self.tokenizer = Tokenizer.from_file(path)
        #: Texts that hold one of these literally are left to the library as a whole.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.line = line[0] if len(line) == 1 else -1
        self.known: dict[str, bytes] = {}

    def pieces(self, texts: pa.Array) -> pa.ListArray:
        """The pieces of each text; texts with white space in runs are cut one by one."""
        hard = pc.or_(pc.match_substring(texts, _CUT), pc.match_substring_regex(texts, _SPACES))
        for t in self.added:
            hard = pc.or_(hard, pc.match_substring(texts, t))
        cut = pc.replace_substring(pc.replace_substring(texts, " ", f"{_CUT} "), "\n", f"{_CUT}\n{_CUT}")
        stops = pc.replace_substring(pc.replace_substring(cut, ".", f"{_CUT}."), ",", f"{_CUT},")
        cut = pc.split_pattern(pc.if_else(pc.match_substring_regex(texts, _STOPS), cut, stops), _CUT)
        if not pc.any(hard).as_py():
            return cut
        apart = [([t] if any(x in t for x in self.added) else _CHUNK.findall(t)) if h else None for t, h in zip(texts.to_pylist(), hard.to_pylist(), strict=True)]
        return pc.if_else(hard, pa.array(apart, pa.list_(pa.string())), cut)

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many ids each has."""
        cut = self.pieces(texts)
        distinct = cut.flatten().dictionary_encode()
        names = distinct.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.known.get, names))
        if None in found:
            if len(self.known) > REMEMBERED:  # pieces that this batch holds too are frequent ones
                self.known = {p: f for p, f in zip(names, found, strict=True) if f is not None and len(p) < 64}
            places = [i for i, f in enumerate(found) if f is None]
            new = [names[i] for i in places]
            made = self.fresh(new)
            for i, f in zip(places, made, strict=True):
                found[i] = f
            self.known.update(zip(new, made, strict=True) if max(map(len, new)) < 64 else ((p, f) for p, f in zip(new, made, strict=True) if len(p) < 64))
        ids, sizes = gathered(found, distinct.indices.to_numpy(), self.kind)
        return ids, sums_by(sizes, pc.list_value_length(cut).to_numpy())

    def fresh(self, pieces: list[str]) -> list[bytes]:
        """Encodings by the library.  Pieces without inner white space go many to a call, a line end between
        them: it is a token of its own before and after such a piece, and tells them apart again."""
        out: list[bytes] = []
        for i in range(0, len(pieces), TOGETHER):
            part = pieces[i : i + TOGETHER]
            joined = "\n".join(part)
            if all(map(_PLAIN, part)) and not any(t in joined for t in self.added):
                ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, self.kind)
                ends = np.flatnonzero(ids == self.line)
                if len(ends) == len(part) - 1:
                    raw, size = ids.tobytes(), ids.itemsize
                    starts, stops = [0, *((ends + 1) * size).tolist()], [*(ends * size).tolist(), len(raw)]
                    out += [raw[a:b] for a, b in zip(starts, stops, strict=True)]
                    continue
            out += [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
        return out

    def encode(self, text: str) -> bytes:
        """The ids of one text as little-endian integers."""
        return self.encode_all(pa.array([text], pa.string()))[0].tobytes()


def encoder(path: str) -> Encoder:
    """The Python worker's encoder of a vocabulary."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def train_dictionary(docs: DataFrame, path: str, sample_docs: int = SAMPLE_DOCS) -> bytes:
    """A dictionary from a hashed sample of about ``sample_docs`` documents of the whole table.

    Too few or too uniform samples can't be trained on; their bytes then serve as raw content.
    """
    n = docs.count()
    parts = max(1, n // sample_docs)
    rows = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) == 0).select(F.xxhash64("doc_id").alias("h"), F.substring("text", 1, 4 * SAMPLE_IDS).alias("text"))
    own = Encoder(path)
    size = np.dtype(own.kind).itemsize
    samples = [own.encode(r["text"] or "")[: SAMPLE_IDS * size] for r in rows.orderBy("h").limit(2 * sample_docs).collect()]
    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


def _dictionary(data: bytes) -> dict:
    return {"dict_data": zstandard.ZstdCompressionDict(data)} if data else {}


def write_store(docs: DataFrame, folder: str, path: str) -> str:
    """Encodes rows (doc_id, text) and writes them in ascending doc_id order; returns the hash of the dictionary.

    Rows are ranged by doc_id and the hash of the text, so that no doc_id fills a task alone
    unless its texts are equal too; a null doc_id comes first, a null text is empty.  Repeated rows
    stay repeated, rows of one doc_id are ordered by the hash of their texts.  An empty table gives
    a store without blocks.  A very long text is one frame, in a block of its own.  Other columns are not read.
    """
    spark = docs.sparkSession
    data = train_dictionary(docs, path)
    sha = hashlib.sha256(data).hexdigest()
    spark.createDataFrame([(sha, bytearray(data))], "sha256 string, data binary").coalesce(1).write.parquet(f"{folder}/dictionary")
    shared = spark.sparkContext.broadcast(data)

    ship(docs.sparkSession)
    def blocks(batches):
        own = encoder(path)
        size = np.dtype(own.kind).itemsize
        end = np.array([END_ID], own.kind).tobytes()
        zip_ = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True, **_dictionary(shared.value))
        done, ids, counts, offsets, frames, at = 0, [], [], [], [], 0

        def block():
            row = [[done], [min((i for i in ids if i is not None), default=None)], [max((i for i in ids if i is not None), default=None)], [ids], [counts], [offsets], [sha], [size], [b"".join(frames)]]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.string(), pa.int32(), pa.binary()]
            names = ["first", "least", "most", "doc_ids", "counts", "offsets", "dictionary_sha256", "id_bytes", "payload"]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=names)

        for batch in sliced(batches, 512):
            every, lengths = own.encode_all(pc.fill_null(batch.column("text"), ""))
            stops = np.cumsum(lengths)
            for doc, start, stop in zip(batch.column("doc_id").to_pylist(), (stops - lengths).tolist(), stops.tolist(), strict=True):
                raw = every[start:stop].tobytes() + end
                frame = zip_.compress(raw)
                if ids and (at + len(frame) > BLOCK_BYTES or len(ids) >= BLOCK_DOCS):
                    yield block()
                    done, ids, counts, offsets, frames, at = done + sum(counts), [], [], [], [], 0
                ids.append(doc)
                counts.append(len(raw) // size)
                offsets.append(at)
                frames.append(frame)
                at += len(frame)
        if ids:
            yield block()

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    rows = docs.select("doc_id", "text").repartitionByRange(width(spark), *order).sortWithinPartitions(*order)
    out = rows.mapInArrow(blocks, BLOCKS).withColumns({"part": F.spark_partition_id(), "block": F.monotonically_increasing_id()})
    out.write.option("compression", "uncompressed").parquet(f"{folder}/blocks")
    return sha


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (array of int) of every document of a store."""
    return _read(spark, folder, "doc_id bigint, start bigint, n_tokens bigint, ids array<int>", lambda raw, kind: np.frombuffer(raw, kind).astype(np.int32).tolist(), pa.list_(pa.int32()))


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of the ids as 32-bit integers."""
    return _read(spark, folder, RESULT, lambda raw, kind: zlib.crc32(np.frombuffer(raw, kind).astype("<u4").tobytes()), pa.int64())


def _read(spark: SparkSession, folder: str, schema: str, made, kind) -> DataFrame:
    stored = spark.read.parquet(f"{folder}/dictionary").first()
    data, sha = bytes(stored["data"]), stored["sha256"]
    table = spark.read.parquet(f"{folder}/blocks")
    sizes = table.groupBy("part").agg(F.sum(F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("n")).collect()
    starts, total = [], 0
    for row in sorted(sizes, key=lambda r: r["part"]):  # one row per partition that was written
        starts.append({"part": row["part"], "before": total})
        total += row["n"]
    table = table.join(F.broadcast(literal_rows(spark, starts, "part int, before bigint")), "part")
    shared = spark.sparkContext.broadcast(data)

    ship(spark)
    def documents(batches):
        unzip = zstandard.ZstdDecompressor(**_dictionary(shared.value))
        for batch in sliced(batches):
            for row in batch.to_pylist():
                if row["dictionary_sha256"] != sha:
                    raise ValueError("a block was written under another dictionary")
                payload, ends = memoryview(row["payload"]), [*row["offsets"][1:], len(row["payload"])]
                start = row["before"] + row["first"] + np.concatenate([[0], np.cumsum(row["counts"])[:-1]]).astype(np.int64)
                values = [made(unzip.decompress(payload[a:b]), f"<u{row['id_bytes']}") for a, b in zip(row["offsets"], ends, strict=True)]
                names = [f.split(" ")[0] for f in schema.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(start), pa.array(row["counts"], pa.int64()), pa.array(values, kind)], names=names)

    wanted = table.select("before", "first", "doc_ids", "counts", "offsets", "dictionary_sha256", "id_bytes", "payload")
    return wanted.mapInArrow(documents, schema)


def read_document(spark: SparkSession, folder: str, doc_id: int) -> list[list[int]]:
    """The ids of one document, from its own frame alone (several lists where rows repeat the doc_id).

    The scan gets the bounds of doc_id, so files and row groups of other documents are not read.
    """
    data = bytes(spark.read.parquet(f"{folder}/dictionary").first()["data"])
    table = spark.read.parquet(f"{folder}/blocks").where((F.col("least") <= doc_id) & (F.col("most") >= doc_id)).where(F.array_contains("doc_ids", doc_id))
    at = table.select("id_bytes", "payload", F.explode(F.arrays_zip("doc_ids", "offsets", F.concat(F.slice("offsets", F.lit(2), F.size("offsets")), F.array(F.length("payload"))).alias("ends"))).alias("d"))
    at = at.where(F.col("d.doc_ids") == doc_id).select("id_bytes", F.expr("substring(payload, d.offsets + 1, d.ends - d.offsets)").alias("frame"))
    unzip = zstandard.ZstdDecompressor(**_dictionary(data))
    return [np.frombuffer(unzip.decompress(bytes(r["frame"])), f"<u{r['id_bytes']}").tolist() for r in at.collect()]
