"""Language ID: the language whose zstandard dictionary compresses a text best.

For each language a raw-content dictionary is made of excerpts of a bounded hashed sample.
Texts are reduced to lower-case letters and single spaces and cut into blocks of BLOCK bytes, so that the dictionary and not the text's own beginning decides, and each block is compressed under every dictionary.  The smallest sum wins; a narrow
margin over the runner-up marks the prediction as rejected.
"""

from __future__ import annotations

import re

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, sliced

#: Learning takes about so many documents of a language and so many characters of each.
SAMPLE_DOCS, SAMPLE_CHARS = 64, 1500
#: So many languages' dictionaries are broadcast, and held by a task, at a time.
TOGETHER = 100
BLOCK, LEVEL = 4096, 9
MARGIN = 0.02
UNKNOWN = "und"
RESULT = "doc_id bigint, held_out boolean, lang_pred string, score double, confident boolean"

_NO_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    return _NO_LETTERS.sub(" ", text.lower()).encode()


def held_out(key: Column) -> Column:
    """Documents that are never learned from: crc32 of the doc_id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, key: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, bytes]:
    """The dictionary of each language, from texts with a language that are not held out (nor have a null key)."""
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key)))
    known = known.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("lang"))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    if not counts:
        return {}
    parts = F.create_map(*[x for name, n in counts.items() for x in (F.lit(name), F.lit(max(1, n // (2 * sample_docs))))])
    some = known.where(F.pmod(F.xxhash64("k"), parts[F.col("lang")]) == 0)
    best: dict[str, list] = {name: [] for name in counts}
    for r in some.select("lang", F.xxhash64("k", F.lit("order")).alias("h"), F.substring("t", 1, SAMPLE_CHARS).alias("t")).orderBy("lang", "h", "t").toLocalIterator():
        if len(best[r["lang"]]) < sample_docs:
            best[r["lang"]].append(r["t"])
    order = sorted(best, key=lambda name: (-counts[name], name))
    return {name: letters("\n".join(best[name])) for name in order}


class Judge:
    """Compresses texts under each language's dictionary; of many languages only TOGETHER are loaded at a time."""

    def __init__(self, parts: list):
        """``parts`` are broadcasts of dictionaries by language, in order of preference."""
        self.parts, self.loaded, self.coders = parts, None, []
        self.plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False)

    def load(self, i: int) -> list:
        if self.loaded != i:
            self.loaded, self.coders = i, []
            for name, data in self.parts[i].value.items():
                own = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                own.precompute_compress(level=LEVEL)
                self.coders.append((name, zstandard.ZstdCompressor(dict_data=own, write_content_size=False, write_checksum=False)))
        return self.coders

    def judge(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """The best language of each text and its margin over the next, from 0 to 1; ties go to the language learned from most documents."""
        cut = []
        for text in texts:
            data = letters(text) if text else b""
            cut.append([data[i : i + BLOCK] for i in range(0, len(data), BLOCK)])
        sizes: list[list] = [[] for _ in cut]
        for i in range(len(self.parts)):
            for name, coder in self.load(i):
                for blocks, own in zip(cut, sizes, strict=True):
                    if blocks:
                        own.append((sum(len(coder.compress(b)) for b in blocks), name))
        out = []
        for blocks, own in zip(cut, sizes, strict=True):
            if not own:
                out.append((UNKNOWN, 0.0))
                continue
            best = min(range(len(own)), key=lambda i, own=own: own[i][0])
            rest = [s for i, (s, _) in enumerate(own) if i != best] or [sum(len(self.plain.compress(b)) for b in blocks)]
            out.append((own[best][1], max(0.0, 1 - own[best][0] / min(rest))))
        return out


def shared_parts(spark: SparkSession, dictionaries: dict[str, bytes]) -> list:
    names = list(dictionaries)
    return [spark.sparkContext.broadcast({n: dictionaries[n] for n in names[i : i + TOGETHER]}) for i in range(0, len(names), TOGETHER)]


def language_of(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: held_out, lang_pred, score (the margin) and whether it is confident.

    ``und`` with score 0 for a null text, one without letters, or where nothing was learned.
    Repeated rows stay repeated, an empty table gives no rows; very long texts are compressed whole, block by
    block.  Only key and text are read, whatever other columns are called.
    """
    shared = shared_parts(docs.sparkSession, dictionaries)
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), held_out(F.col(key)).alias("held_out"), F.when(F.col(text).rlike(r"\p{L}"), F.col(text)).alias("text"))

    ship(docs.sparkSession)
    def predict(batches):
        judge = Judge(shared)
        for batch in sliced(batches):
            found = judge.judge(batch.column("text").to_pylist())
            sure = [name != UNKNOWN and score >= margin for name, score in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array(sure, pa.bool_())],
                names=["doc_id", "held_out", "lang_pred", "score", "confident"],
            )

    return rows.mapInArrow(predict, RESULT)


def only_known(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN, text: str = "text") -> DataFrame:
    """The documents whose prediction is confident, with all their columns; null texts and those without letters go, repeated rows stay.

    An empty table gives no rows, very long texts are compressed whole, further columns pass through, whatever they are called.
    Where nothing was learned, nothing is known and all documents go.
    """
    shared = shared_parts(docs.sparkSession, dictionaries)

    ship(docs.sparkSession)
    def keep(batches):
        judge = Judge(shared)
        for batch in sliced(batches):
            texts = [t if t and any(map(str.isalpha, t)) else None for t in batch.column(text).to_pylist()]
            sure = [name != UNKNOWN and score >= margin for name, score in judge.judge(texts)]
            yield batch.filter(pa.array(sure, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
