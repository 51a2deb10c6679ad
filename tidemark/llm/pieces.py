"""SentencePiece encoding and decoding by a relational lattice.

Texts are cut into words where no piece can cross.  For a set of distinct words Spark explodes all
substrings of bounded length, joins them with the piece table, groups the edges that are left by word
and folds them with a higher-order aggregate.  A unigram model is folded by Viterbi: the path with the
largest sum of scores, position by position.  A byte-pair model is no sum of scores: each step merges the two
neighbours whose edge scores best, the leftmost among equals, until none can.

The lattice is built for all distinct words of LATTICE_CHARS characters at most.  Those of a bounded hashed sample of
documents, the frequent ones among them, reach the texts by broadcast.  All others go to the slices of documents that hold them:
words and documents, many to a packed row, are dealt by slice and sorted, so that a task reads the words of a slice before its documents.
Longer words, those without any piece and unigram words with a character that no piece covers are cut by the same rule where they occur.
"""

from __future__ import annotations

import heapq
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import large, ship, sliced, sums_by, width

SPACE = "▁"
#: The lattice is built for words of at most so many characters: a merge's state is one 64-bit number.
LATTICE_CHARS = 60
#: The words of about so many documents are broadcast; longer documents are not in that sample, so that its size is bounded.
SAMPLE_DOCS, SAMPLE_CHARS = 1000, 20_000
#: Bytes of text in a slice of documents, whose words a task holds.
SLICE_BYTES = 32 << 20
#: Pairs of slice and word that a task packs at once.
PACKED = 200_000
#: Documents that are encoded together, so that their words meet the table at once.
TOGETHER = 1024
#: Words beyond the lattice that a Python worker remembers.
REMEMBERED = 250_000
IDS = "doc_id bigint, ids array<int>"
DIGEST = "doc_id bigint, n_chars bigint, n_pieces bigint, ids_crc32 bigint, decoded_crc32 bigint, round_trip boolean"
#: Model types as models name them, and how far below the least score an uncovered character lies.
UNIGRAM, BYTE_PAIRS = 1, 2
UNCOVERED = 10.0

_CUT = "\x01"
_WORDS = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n|[^{SPACE}\n]+")


class Model:
    """The pieces of a model: texts by id, and id and score of each piece that text can become.

    Models of other types than unigram and byte pairs, with a normaliser that changes text, without byte
    pieces or with pieces of the user's own are refused, as their ids would come out wrong.
    """

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        own = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = sentencepiece_model_pb2.ModelProto.FromString(own.serialized_model_proto())
        self.kind, rules = proto.trainer_spec.model_type, proto.normalizer_spec
        if self.kind not in (UNIGRAM, BYTE_PAIRS):
            raise ValueError(f"model type {self.kind} is neither unigram nor byte pairs")
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.add_dummy_prefix:
            raise ValueError("this model normalises text")
        if any(p.type == proto.SentencePiece.USER_DEFINED for p in proto.pieces):
            raise ValueError("this model has pieces of the user's own")
        n = own.get_piece_size()
        self.texts = [own.id_to_piece(i) for i in range(n)]
        self.bytes = {i: int(self.texts[i][3:5], 16) for i in range(n) if own.is_byte(i)}
        self.byte_ids = {b: i for i, b in self.bytes.items()}
        self.silent = {i for i in range(n) if own.is_control(i)}
        self.unknown = own.unk_id()
        self.pieces = {self.texts[i]: (i, own.get_score(i)) for i in range(n) if not (own.is_byte(i) or own.is_control(i) or own.is_unknown(i) or own.is_unused(i))}
        self.scores = {p: s for p, (_, s) in self.pieces.items()}
        self.costs = {p: -s for p, s in self.scores.items()}
        self.longest = max(map(len, self.pieces))
        self.late: set[str] | None = None
        self.uncovered = min(self.scores.values()) - UNCOVERED
        if len(self.byte_ids) < 256:
            raise ValueError("this model has no byte pieces")
        if any("\n" in p or SPACE in p.lstrip(SPACE) for p in self.pieces):
            raise ValueError("pieces of this model cross white space")
        #: What each id reads as; None where its neighbours decide (bytes beyond ASCII).
        self.reads = ["" if i in self.silent else " ⁇ " if i == self.unknown else chr(self.bytes[i]) if self.bytes.get(i, 128) < 128 else None if i in self.bytes else t.replace(SPACE, " ") for i, t in enumerate(self.texts)]

    def cut(self, word: str) -> list[int]:
        """The ids of a word."""
        parts = self.merged(word) if self.kind == BYTE_PAIRS else self.best_path(word)
        out: list[int] = []
        for part in parts:
            out += [self.pieces[part][0]] if part in self.pieces else [self.byte_ids[b] for b in part.encode()]
        return out

    def filled(self, word: str, ids: list[int]) -> list[int]:
        """The ids of a word's parts with those of bytes where a negative one stands for a character without a piece."""
        out, at = [], 0
        for i in ids:
            out += [i] if i >= 0 else [self.byte_ids[b] for b in word[at].encode()]
            at += len(self.texts[i]) if i >= 0 else 1
        return out

    def merged(self, word: str) -> list[str]:
        """Byte pairs: neighbours merge by best score, leftmost first, until none can."""
        if len(word) > 256:
            return self.merged_long(word)
        cost, none = self.costs.get, float("inf")
        parts = list(word)
        costs = [cost(a + b, none) for a, b in zip(parts, parts[1:])]
        while costs:
            least = min(costs)
            if least == none:
                break
            i = costs.index(least)
            parts[i] += parts.pop(i + 1)
            del costs[i]
            if i:
                costs[i - 1] = cost(parts[i - 1] + parts[i], none)
            if i < len(costs):
                costs[i] = cost(parts[i] + parts[i + 1], none)
        return parts

    def made_late(self) -> set[str]:
        """Byte pairs: the pieces that some merge makes possible after its own turn in the order of costs has passed.

        Merges inside a part depend on nothing outside it, so what comes before a piece are the merges of its own text alone.
        """
        if self.late is None:
            self.late = set()
            for piece, own in self.costs.items():
                parts = list(piece)
                while len(parts) > 1:
                    least, i = min((self.costs.get(a + b, float("inf")), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
                    if least == float("inf"):
                        break
                    parts[i] += parts.pop(i + 1)
                    if len(parts) > 1 and least >= own:
                        self.late.add(piece)
                        break
        return self.late

    def merged_long(self, word: str) -> list[str]:
        """The same with a heap of offers, for words of any length."""
        parts: list[str | None] = list(word)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < len(parts):
                both = parts[i] + parts[j]
                if both in self.costs:
                    heapq.heappush(heap, (self.costs[both], i, both))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = after[i]
            if parts[i] is None or j >= len(parts) or parts[j] is None or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j] = both, None
            after[i] = after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [part for part in parts if part is not None]

    def best_path(self, word: str) -> list[str]:
        """Unigram: the path with the largest sum of scores, of equal ones that with the earlier start of its last piece."""
        n = len(word)
        best, start = np.full(n + 1, -np.inf, np.float32), [0] * (n + 1)
        best[0] = 0
        for e in range(1, n + 1):
            for s in range(max(0, e - self.longest), e):
                score = self.scores.get(word[s:e], self.uncovered if e - s == 1 else None)
                if score is not None and best[s] + np.float32(score) > best[e]:
                    best[e], start[e] = best[s] + np.float32(score), s
        out, e = [], n
        while e:
            out.append(word[start[e] : e])
            e = start[e]
        return out[::-1]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        out, raw = [], bytearray()
        for i in ids:
            if i in self.bytes:
                raw.append(self.bytes[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            out.append(self.reads[i])
        out.append(raw.decode("utf-8", "replace"))
        text = "".join(out)
        return text[1:] if text.startswith(" ") else text


class Coder:
    """Encodes and decodes batches of texts; remembers words."""

    def __init__(self, model: Model, table: dict[str, bytes]):
        self.model, self.known = model, {}
        self.reads = pa.array(model.reads, pa.string())
        sizes = np.fromiter(map(len, table.values()), np.int64, len(table)) // 4
        self.parts = [(pa.array(table, pa.string()), sizes, np.frombuffer(b"".join(table.values()), "<i4"))]

    def learn(self, words: pa.Array, ids: pa.ListArray) -> None:
        """Remembers encodings from the lattice, as arrays; null ids stand for characters that become bytes."""
        if ids.values.null_count:
            whole = [self.model.filled(w, [-1 if i is None else i for i in own]) if None in own else own for w, own in zip(words.to_pylist(), ids.to_pylist())]
            ids = pa.array(whole, pa.list_(pa.int32()))
        self.parts.append((words, pc.list_value_length(ids).to_numpy().astype(np.int64), ids.flatten().to_numpy()))

    def found(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the ids of each word begin and how many they are, and all ids; words that no table has are cut."""
        if len(self.parts) > 1:
            self.parts = [(pa.concat_arrays([p[0] for p in self.parts]), np.concatenate([p[1] for p in self.parts]), np.concatenate([p[2] for p in self.parts]))]
        table, own, flat = self.parts[0]
        at = pc.fill_null(pc.index_in(words, table), -1).to_numpy().copy()
        rest = words.filter(pa.array(at < 0)).to_pylist()
        if len(self.known) > REMEMBERED:  # words that this batch holds too are frequent ones
            self.known = {w: self.known[w] for w in rest if w in self.known}
        cut = []
        for word in rest:
            ids = self.known.get(word)
            if ids is None:
                ids = np.array(self.model.cut(word), "<i4").tobytes()
                if len(word) < 64:
                    self.known[word] = ids
            cut.append(ids)
        at[at < 0] = len(table) + np.arange(len(rest))
        sizes = np.concatenate([own, np.fromiter(map(len, cut), np.int64, len(cut)) // 4])
        return (np.cumsum(sizes) - sizes)[at], sizes[at], np.concatenate([flat, np.frombuffer(b"".join(cut), "<i4")]) if cut else flat

    @staticmethod
    def words(texts: pa.Array) -> pa.ListArray:
        """Cuts before spaces that follow something else and around line ends; a space comes first."""
        texts = pc.replace_substring(pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(SPACE, texts, "")), " ", SPACE)
        cut = pc.split_pattern(pc.replace_substring(pc.replace_substring(texts, SPACE, _CUT + SPACE), "\n", f"{_CUT}\n{_CUT}"), _CUT)
        hard = pc.or_(pc.match_substring(texts, SPACE + SPACE), pc.match_substring(texts, _CUT))
        if not pc.any(hard).as_py():
            return cut
        return pc.if_else(hard, pa.array([_WORDS.findall(t) if h else None for t, h in zip(texts.to_pylist(), hard.to_pylist(), strict=True)], pa.list_(pa.string())), cut)

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """The ids of each text (none of them null); only the distinct words of the batch are looked up or cut."""
        cut = self.words(texts)
        distinct = cut.flatten().dictionary_encode()
        starts, lengths, flat = self.found(distinct.dictionary)
        index = distinct.indices.to_numpy()
        sizes = lengths[index]
        ids = flat[np.repeat(starts[index] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
        counts = sums_by(sizes, pc.list_value_length(cut).to_numpy())
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids, pa.int32()))

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The text of each list of ids; a null list gives a null text."""
        counts = pc.fill_null(pc.list_value_length(ids), 0).to_numpy()
        read = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), self.reads.take(pc.list_flatten(ids)))
        texts = pc.if_else(ids.is_null(), None, pc.binary_join(read, ""))  # null also where an id reads as null
        texts = pc.if_else(pc.starts_with(texts, " "), pc.utf8_slice_codeunits(texts, 1), texts)
        hard = pc.and_(texts.is_null(), ids.is_valid())
        if not pc.any(hard).as_py():
            return texts
        return pc.if_else(hard, pa.array([self.model.decode(i) if h else None for i, h in zip(ids.to_pylist(), hard.to_pylist(), strict=True)], pa.string()), texts)


#: Characters of a beginning that tells how long a piece can be.
BEGINNING = 4


def lattice(words: DataFrame, pieces: DataFrame, *edges: Column) -> DataFrame:
    """(word, edges): the pieces that occur in each distinct word, gathered by the aggregates ``edges`` of the piece's columns, start s and end e.

    Words are sorted before they are exploded, so that gathering finds their edges side by side.  From each start substrings go as far as the
    longest piece with the same beginning; pieces are met by hash and compared in full.
    """
    part = F.substr("word", F.col("s") + 1, F.col("e") - F.col("s"))
    begins = F.xxhash64(F.substr("word", F.col("s") + 1, F.lit(BEGINNING)))
    reach = pieces.where(F.length("piece") >= BEGINNING).groupBy(F.xxhash64(F.substr("piece", F.lit(1), F.lit(BEGINNING))).alias("_begins")).agg(F.max(F.length("piece")).alias("_most"))
    starts = words.select("word").sortWithinPartitions("word").select("word", F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("s"))
    starts = starts.withColumn("_begins", begins).join(F.broadcast(reach), "_begins", "left")
    ends = F.least(F.coalesce("_most", F.lit(BEGINNING - 1)) + F.col("s"), F.length("word"))
    spans = starts.select("word", "s", F.explode(F.sequence(F.col("s") + 1, ends)).alias("e"))
    met = spans.withColumn("_hash", F.xxhash64(part)).join(F.broadcast(pieces.withColumn("_hash", F.xxhash64("piece"))), "_hash")  # the vocabulary of one model
    return met.where(F.col("piece") == part).groupBy("word").agg(*edges)


#: The order of an edge of byte pairs as one number: the place of its piece by cost, start, end and id, in so many bits.
START_BITS = END_BITS = 6
ID_BITS = 22


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), i)


def packed_edge() -> Column:
    """An edge by its order, with the bits of its ends and of what lies between them."""
    shift = lambda c, bits: F.shiftleft(c.cast("bigint"), bits)
    code = shift(F.col("rank"), START_BITS + END_BITS + ID_BITS) + shift(F.col("s"), END_BITS + ID_BITS) + shift(F.col("e"), ID_BITS) + F.col("id")
    return F.struct(code.alias("code"), (_bit(F.col("s")) + _bit(F.col("e"))).alias("ends"), (_bit(F.col("e")) - _bit(F.col("s") + 1)).alias("inner"))


def merge_pass(word: Column, wide: Column, single: Column, late: Column) -> Column:
    """Byte pairs: the ids of a word after all merges, in one pass over its packed edges of several characters, cheapest and leftmost first.

    That is the order of merges but where a piece is made late; such words, and those with a part that has no piece, go by merge_fold.
    """
    low = lambda code, bits: code.bitwiseAND(F.lit((1 << bits) - 1))
    start = lambda code: low(F.shiftright(code, END_BITS + ID_BITS), START_BITS).cast("int")
    end = lambda code: low(F.shiftright(code, ID_BITS), END_BITS).cast("int")
    id_ = lambda code: low(code, ID_BITS).cast("int")

    def step(state: Column, e: Column) -> Column:
        able = (state.bitwiseAND(e["ends"]) == e["ends"]) & (F.bit_count(state.bitwiseAND(e["inner"])) == 1)
        return F.when(able, state.bitwiseAND(F.bitwise_not(e["inner"]))).otherwise(state)

    def parts(state: Column) -> Column:
        left = F.concat(F.filter(single, lambda e: state.bitwiseAND(e["ends"]) == e["ends"]), F.filter(wide, lambda e: state.bitwiseAND(e["ends"].bitwiseOR(e["inner"])) == e["ends"]))
        return F.sort_array(F.transform(left, lambda e: low(e["code"], START_BITS + END_BITS + ID_BITS)))

    last = F.aggregate(wide, _bit(F.length(word) + 1) - 1, step)
    every = F.sort_array(F.concat(wide, single))
    slow = merge_fold(word, F.transform(every, lambda e: F.struct(start(e["code"]).alias("s"), end(e["code"]).alias("e"), id_(e["code"]).alias("id"))))
    covered = lambda x: F.aggregate(x, F.lit(0), lambda n, c: n + end(c) - start(c)) == F.length(word)
    left = F.transform(F.transform(F.array(last), parts), lambda x: F.when(~late & covered(x), F.transform(x, id_)))
    return F.coalesce(F.element_at(left, 1), slow)


def merge_fold(word: Column, edges: Column) -> Column:
    """Byte pairs: the ids of a word after all merges.  The state has bit i set where a part begins or ends at i."""
    one = F.lit(1).cast("bigint")
    bit = lambda i: F.call_function("shiftleft", one, i)
    wide = F.transform(F.filter(edges, lambda e: e["e"] - e["s"] > 1), lambda e: F.struct(bit(e["s"]).bitwiseOR(bit(e["e"])).alias("ends"), (bit(e["e"]) - bit(e["s"] + 1)).alias("inner")))

    def last_state(all_edges: Column) -> Column:
        def merge(state: Column, _: Column) -> Column:
            able = F.filter(all_edges, lambda e: (state.bitwiseAND(e["ends"]) == e["ends"]) & (F.bit_count(state.bitwiseAND(e["inner"])) == 1))
            return F.coalesce(state.bitwiseAND(F.bitwise_not(F.get(able, F.lit(0))["inner"])), state)

        return F.aggregate(F.sequence(F.lit(1), F.length(word)), bit(F.length(word) + 1) - 1, merge)

    def ids(state: Column) -> Column:
        cuts = F.filter(F.sequence(F.lit(0), F.length(word)), lambda i: state.bitwiseAND(bit(i)) != 0)
        spans = F.zip_with(cuts, F.slice(cuts, F.lit(2), F.greatest(F.size(cuts) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("s"), b.alias("e")))
        return F.transform(F.filter(spans, lambda x: x["e"].isNotNull()), lambda x: F.get(F.filter(edges, lambda e: (e["s"] == x["s"]) & (e["e"] == x["e"])), F.lit(0))["id"])

    return F.element_at(F.transform(F.transform(F.array(wide), last_state), ids), 1)


def viterbi_fold(word: Column, edges: Column) -> Column:
    """Unigram: the ids along the path with the largest sum of scores; null ids where no piece covers a character."""
    first = F.array(F.struct(F.lit(0.0).cast("float").alias("score"), F.lit(-1).alias("start"), F.lit(None).cast("int").alias("id")))

    def reach(state: Column, k: Column) -> Column:
        ways = F.transform(F.filter(edges, lambda e: e["e"] == k), lambda e: F.struct((F.get(state, e["s"])["score"] - e["cost"]).cast("float").alias("score"), (-e["s"]).alias("left"), e["id"].alias("id")))
        best = F.transform(F.array(F.array_max(F.filter(ways, lambda w: w["score"].isNotNull()))), lambda b: F.struct(b["score"].alias("score"), (-b["left"]).alias("start"), b["id"].alias("id")))
        return F.concat(state, best)

    def back(states: Column) -> Column:
        none = F.struct(F.length(word).alias("at"), F.array().cast("array<int>").alias("ids"))
        step = lambda x, _: F.when(x["at"] > 0, F.transform(F.array(F.get(states, x["at"])), lambda p: F.struct(F.coalesce(p["start"], F.lit(0)).alias("at"), F.concat(F.array(p["id"]), x["ids"]).alias("ids")))[0]).otherwise(x)
        return F.aggregate(F.sequence(F.lit(1), F.length(word)), none, step)["ids"]

    states = F.aggregate(F.sequence(F.lit(1), F.length(word)), first, reach)
    return F.element_at(F.transform(F.array(states), back), 1)


def encoded_words(words: DataFrame, model: Model) -> DataFrame:
    """(word, ids) of distinct words of 1 to LATTICE_CHARS characters that hold a piece; a part without a piece has a null id."""
    spark = words.sparkSession
    if model.kind == UNIGRAM:
        pieces = spark.createDataFrame([(p, i, float(s)) for p, (i, s) in model.pieces.items()], "piece string, id int, score float")
        found = lattice(words, pieces, F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("cost"), F.col("s"), F.col("e"), F.col("id")))).alias("edges"))
        return found.select("word", viterbi_fold(F.col("word"), F.col("edges")).alias("ids"))
    order, late = {c: k for k, c in enumerate(sorted(set(model.costs.values())))}, model.made_late()
    pieces = spark.createDataFrame([(p, i, order[model.costs[p]], p in late) for p, (i, _) in model.pieces.items()], "piece string, id int, rank int, late boolean")
    several, edge = F.col("e") - F.col("s") > 1, packed_edge()
    found = lattice(words, pieces, F.sort_array(F.collect_list(F.when(several, edge))).alias("wide"), F.collect_list(F.when(~several, edge)).alias("single"), F.max("late").alias("late"))
    return found.select("word", merge_pass(F.col("word"), F.col("wide"), F.col("single"), F.col("late")).alias("ids"))


def sample_words(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The distinct words, LATTICE_CHARS long at most, of about ``sample_docs`` documents of SAMPLE_CHARS at most, by the hash of their doc_id."""
    ship(docs.sparkSession)
    parts = max(1, docs.count() // sample_docs)
    some = docs.where((F.pmod(F.xxhash64(key), F.lit(parts)) == 0) & (F.length(text) <= SAMPLE_CHARS)).select(F.col(text).alias("text"))

    def cut(batches):
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([Coder.words(pc.fill_null(batch.column(0), "")).flatten().unique()], names=["word"])

    return some.mapInArrow(cut, "word string").where(F.length("word").between(1, LATTICE_CHARS)).distinct()


def word_table(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> dict[str, bytes]:
    """Encodings of the sample's words; its size is bounded by the sample."""
    table = encoded_words(sample_words(docs, key=key, text=text), model).where(~F.exists("ids", lambda i: i.isNull()))
    return {r["word"]: np.array(r["ids"], "<i4").tobytes() for r in table.toLocalIterator()}


class _Shared:
    """A broadcast (model, table) that a Python worker unpacks once."""

    last: tuple = ("", None)

    def __init__(self, broadcast):
        self.broadcast, self.id = broadcast, uuid.uuid4().hex

    @property
    def value(self):
        if _Shared.last[0] != self.id:
            _Shared.last = (self.id, self.broadcast.value)
        return _Shared.last[1]


def words_of_slices(rows: DataFrame, shared: _Shared) -> DataFrame:
    """(slice, word): the words of each slice that the lattice takes and the broadcast table lacks; a pair may come several times."""

    def cut(batches):
        known = pa.array(shared.value[1], pa.string())
        for batch in sliced(batches, 2048):
            words = Coder.words(pc.fill_null(batch.column("text"), ""))
            flat, found = pc.list_flatten(words).dictionary_encode(), pc.take(batch.column("slice"), pc.list_parent_indices(words))
            chars = pc.utf8_length(flat.dictionary)
            routed = pc.and_(pc.and_(pc.greater(chars, 0), pc.less_equal(chars, LATTICE_CHARS)), pc.invert(pc.is_in(flat.dictionary, known)))
            pairs = pa.table({"slice": found, "at": flat.indices}).filter(pc.take(routed, flat.indices)).group_by(["slice", "at"], use_threads=False).aggregate([])
            yield from pa.table({"slice": pairs["slice"], "word": pc.take(flat.dictionary, pairs["at"])}).to_batches()

    return rows.select("slice", "text").mapInArrow(cut, "slice int, word string")


def words_of(pairs: DataFrame) -> DataFrame:
    """The distinct words of pairs (slice, word).

    The slices are counted so that both columns are read: only then does Spark see that the join takes the same rows, and deals them once.
    """
    return pairs.groupBy("word").agg(F.count("slice").alias("n")).where("n > 0").select("word")


def packed(words: pa.Array, ids: pa.ListArray) -> bytes:
    """Words of LATTICE_CHARS characters at most and their ids, compressed: lengths, words, numbers of ids, ids by byte; -1 for null."""
    raw, flat = words.cast(pa.binary()), ids.flatten().fill_null(-1).to_numpy().astype("<i4")
    sizes, counts = pc.binary_length(raw).to_numpy().astype(np.uint8), pc.list_value_length(ids).to_numpy().astype(np.uint8)
    head = np.array([len(words), len(flat)], "<i8").tobytes()
    return zstandard.compress(b"".join([head, sizes.tobytes(), counts.tobytes(), flat.view(np.uint8).reshape(-1, 4).T.tobytes(), *raw.to_pylist()]))


def unpacked(blob: bytes) -> tuple[pa.Array, pa.ListArray]:
    """The words and ids of packed."""
    data = zstandard.decompress(blob)
    n, m = np.frombuffer(data, "<i8", 2).tolist()
    sizes, counts = np.frombuffer(data, np.uint8, 2 * n, 16).reshape(2, n)
    flat = np.ascontiguousarray(np.frombuffer(data, np.uint8, 4 * m, 16 + 2 * n).reshape(4, m).T).view("<i4").ravel()
    ends = lambda of: np.concatenate([[0], np.cumsum(of, dtype=np.int64)]).astype(np.int32)
    words = pa.StringArray.from_buffers(n, pa.py_buffer(ends(sizes)), pa.py_buffer(data[16 + 2 * n + 4 * m :]))
    return words, pa.ListArray.from_arrays(pa.array(ends(counts)), pa.array(flat, mask=flat < 0))


def packed_words(routed: DataFrame) -> DataFrame:
    """(slice, pack): the rows (slice, word, ids) of each task, packed by slice."""

    def pack(held):
        table = pa.Table.from_batches(held)
        table = table.take(pc.sort_indices(table["slice"])).combine_chunks()  # stable: words that are alike stay side by side
        at = table["slice"].to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
        words, ids = (pa.concat_arrays(table[c].chunks) for c in ("word", "ids"))
        blobs = [packed(words[a:b], ids[a:b]) for a, b in zip(edges, edges[1:])]
        return pa.RecordBatch.from_arrays([pa.array(at[edges[:-1]], pa.int32()), pa.array(blobs, pa.binary())], names=["slice", "pack"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= PACKED:
                yield pack(held)
                held, n = [], 0
        if held:
            yield pack(held)

    return routed.select("slice", "word", "ids").mapInArrow(run, "slice int, pack binary")


def packed_docs(rows: DataFrame) -> DataFrame:
    """(slice, pack): the rows (slice, doc_id, text), some thousand at a time, as compressed batches of each slice."""

    def pack(batches):
        small = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in sliced(batches, 2048):
            for at in batch.column("slice").unique().to_pylist():
                part = batch.select(["doc_id", "text"]).filter(pc.equal(batch.column("slice"), at))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=small) as to:
                    to.write_batch(part)
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["slice", "pack"])

    return rows.select("slice", "doc_id", "text").mapInArrow(pack, "slice int, pack binary")


def with_words(docs: DataFrame, path: str, key: str, text: str, out, schema: str) -> DataFrame:
    """``out(coder, batch)`` for batches (doc_id, text) of all documents, with a coder that knows the words of their slice."""
    spark = docs.sparkSession
    ship(spark)
    model = Model(path)
    shared = _Shared(spark.sparkContext.broadcast((model, word_table(docs, model, key, text))))
    size = docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    slices = max(size // SLICE_BYTES + 1, spark.sparkContext.defaultParallelism)
    parts = max(width(spark), 6 * slices)
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("doc_id", "text"), F.lit(slices)).cast("int"))
    # A fixed number of partitions: the words are few bytes but much work.  Pairs are dealt by word once, for the lattice and the join.
    pairs = words_of_slices(rows, shared).repartition(parts, "word")
    found = encoded_words(words_of(pairs), model)
    if model.kind == UNIGRAM:  # Viterbi's fold has no path over a character without a piece
        found = found.where(~F.exists("ids", lambda i: i.isNull()))
    routed = packed_words(found.join(large(pairs.distinct()), "word")).withColumn("kind", F.lit(0))
    both = routed.unionByName(packed_docs(rows).withColumn("kind", F.lit(1)))
    dealt = both.repartitionById(slices, F.col("slice")).sortWithinPartitions("slice", "kind")

    def read(batches):
        now, coder, held = None, None, []
        for at, kind, pack in (row for batch in batches for few in sliced([batch], 16) for row in zip(*(few.column(c).to_pylist() for c in ("slice", "kind", "pack")))):
            if at != now:
                if held:
                    yield from outputs(coder, held)
                coder, held = None, []  # its words go before those of another slice come
                now, coder = at, Coder(*shared.value)
            if kind == 0:
                coder.learn(*unpacked(pack))
                continue
            held += pa.ipc.open_stream(pack).read_all().to_batches()
            if sum(b.num_rows for b in held) >= TOGETHER:
                yield from outputs(coder, held)
                held = []
        if held:
            yield from outputs(coder, held)

    def outputs(coder: Coder, held: list[pa.RecordBatch]):
        for few in pa.Table.from_batches(held).combine_chunks().to_batches(max_chunksize=TOGETHER):
            yield out(coder, few)

    return dealt.mapInArrow(read, schema)


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids of every text; a null or empty text has no ids; repeated rows stay repeated.

    An empty table gives no rows.  A very long text is cut like any other, a very long word by a heap.
    Only key and text are read, whatever other columns are called.
    """

    def encoded(coder: Coder, batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), coder.encode(pc.fill_null(batch.column("text"), ""))], names=["doc_id", "ids"])

    return with_words(docs, path, key, text, encoded, IDS)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows (doc_id, ids); null ids give a null text."""
    spark: SparkSession = encoded.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(Model(path))

    def decoded(batches):
        coder = Coder(shared.value, {})
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), coder.decode(batch.column("ids"))], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(decoded, "doc_id bigint, text string")


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: characters, pieces, checksums of its ids (as 32-bit integers) and of
    the text decoded from them, and whether that is the text again.

    A null text counts as empty.  U+2581 in a text decodes to a space, so it does not come back.
    Repeated rows stay repeated, an empty table gives no rows, only key and text are read.
    """

    def checked(coder: Coder, batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = pc.fill_null(batch.column("text"), "")
        ids = coder.encode(texts)
        back = coder.decode(ids)
        flat, ends = ids.values.to_numpy(), ids.offsets.to_numpy().tolist()
        columns = [
            batch.column("doc_id"), pc.utf8_length(texts).cast(pa.int64()), pc.list_value_length(ids).cast(pa.int64()),
            pa.array([zlib.crc32(flat[a:b]) for a, b in zip(ends, ends[1:])], pa.int64()),
            pa.array([zlib.crc32(t) for t in back.cast(pa.binary()).to_pylist()], pa.int64()), pc.equal(texts, back),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_chars", "n_pieces", "ids_crc32", "decoded_crc32", "round_trip"])

    return with_words(docs, path, key, text, checked, DIGEST)
