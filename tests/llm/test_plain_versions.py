"""Fingerprints, perplexities and their bounds, compressed sizes and the pipeline's stages against plain versions."""

import math
import random
import re
import struct

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
import zstandard
from pyspark.sql import functions as F
from test_operators import AWKWARD, plain_components, plain_hits, plain_model

import corpus_pipeline
from tidemark.llm import fuzzy_hash, kn_quality, lang_id

SF = "/root/testdata/sf0.01"
DOCS = "doc_id bigint, text string, lang string, source string"


# --- 8 fingerprints: one byte at a time


def plain_fingerprint(data):
    if not data:
        return "3::"
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    rolls = []
    for i in range(len(data)):
        r = sum(data[i - k] * 0x2C9277B5**k for k in range(min(7, i + 1)))
        rolls.append((r * 0x85EBCA6B & 0xFFFFFFFF) >> 4)

    def signature(size, most):
        out, value, power = "", 0, 1
        for i, byte in enumerate(data):
            value, power = (value + (byte + 1) * power) & (1 << 64) - 1, power * 0x9E3779B97F4A7C15 & (1 << 64) - 1
            if i == len(data) - 1 or len(out) < most - 1 and rolls[i] % size == size - 1:
                h = value * 0xD6E8FEB86659FD93 & (1 << 64) - 1
                h = (h ^ h >> 32) * 0xD6E8FEB86659FD93 & (1 << 64) - 1
                out, value, power = out + letters[h >> 58], 0, 1
        return out

    block = 3
    while block * 64 < len(data):
        block *= 2
    while block > 3 and sum(r % block == block - 1 for r in rolls) < 32:
        block //= 2
    return f"{block}:{signature(block, 64)}:{signature(2 * block, 32)}"


@pytest.mark.parametrize("seed", range(6))
def test_fingerprint_of_bytes(seed):
    rng = random.Random(seed)
    for n in (1, 2, 6, 7, 8, 60, 191, 192, 193, 1000, 7000, 30_000):
        some = rng.choice([b"ab", b"the shore and tide\n", bytes(range(256)), b"a"])
        data = bytes(rng.choice(some) for _ in range(n))
        assert fuzzy_hash.fingerprint(data) == plain_fingerprint(data)


def test_fingerprints_of_awkward_texts():
    for t in AWKWARD:
        data = (t or "").encode()
        assert fuzzy_hash.fingerprint(data) == plain_fingerprint(data)


def test_fingerprint_of_a_long_text():
    data = b"".join(b"%d tides and %d birds. " % (i, i * i % 97) for i in range(50_000))
    assert len(data) > 1_000_000 and fuzzy_hash.fingerprint(data) == plain_fingerprint(data)


# --- 9 quality: perplexity, bounds and what is kept


def is_apart(doc):
    """Spark's xxhash64 of a long and a string, modulo 4."""
    first = xxhash.xxh64(struct.pack("<q", doc), seed=42).intdigest()
    return xxhash.xxh64(b"apart", seed=first).intdigest() % 4 == 0


def plain_quality(rows, labels):
    """{row number: (perplexity, low, high, kept)} of (doc_id, text, lang) rows."""
    good = {d for d, q, t in labels if q == 1} - {d for d, q, t in labels if t == 1}
    p = plain_model([t.encode() for d, t, _ in rows if t and d in good and not is_apart(d)])
    known = {}

    def perplexity(text):
        if not text:
            return None
        s = [kn_quality.EDGE] * 3 + [int(kn_quality.CLASSES[b]) for b in kn_quality.marked(text.encode())]
        total = 0.0
        for i in range(3, len(s)):
            g = tuple(s[i - 3 : i + 1])
            if g not in known:
                known[g] = math.log2(p(g))
            total += known[g]
        return 2 ** (-total / (len(s) - 3))

    values = [perplexity(t) for _, t, _ in rows]
    apart = [(k, v) for (d, _, k), v in zip(rows, values, strict=True) if v is not None and d in good and is_apart(d)]

    def bounds(some):
        v = sorted(some)
        low, mid, high = (v[max(0, math.ceil(q * len(v)) - 1)] for q in (0.005, 0.5, 0.995))
        return min(low, mid / 1.5) / 1.08, max(high, mid * 1.5) * 1.08

    limits = {k: bounds([v for x, v in apart if x == k]) for k in {k for k, _ in apart if k is not None}}
    rest = bounds([v for _, v in apart]) if apart else (0.0, math.inf)
    return [(v, *limits.get(k, rest), v is not None and limits.get(k, rest)[0] <= v <= limits.get(k, rest)[1]) for (_, _, k), v in zip(rows, values, strict=True)]


@pytest.fixture(scope="module")
def corpus(spark):
    """Documents with copies, awkward rows, benchmark passages and null languages, and their labels."""
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").orderBy("doc_id").limit(160).collect()]
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").limit(3).collect()]
    long = [d for d in docs if len(d[1].split()) > 100]
    docs += [(5000 + i, t, "en" if i % 3 else None, "s") for i, t in enumerate(AWKWARD)]
    docs += [(6000 + i, d[1] + " tail", d[2], "s") for i, d in enumerate(long[:12])] + [long[20], long[20], (None, long[21][1], None, None), (None, "no number", None, None)]
    docs += [(7000 + i, long[30 + i][1] + "\n" + t, long[30 + i][2], "s") for i, t in enumerate(items)]
    labels = [tuple(r) for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    return docs, labels


def test_perplexity_bounds_and_kept(spark, corpus):
    docs, labels = corpus
    rows = [(i, *d) for i, d in enumerate(docs)]
    frame = spark.createDataFrame(rows, "n int, " + DOCS)
    marks = spark.createDataFrame(labels, "doc_id bigint, quality bigint, toxic bigint")
    want = plain_quality([d[:3] for d in docs], labels)
    got = kn_quality.classify(frame, marks).collect()
    assert len(got) == len(docs)
    key = lambda d, k, v: (str(d), str(k), v is not None, v or 0)
    pairs = list(zip(sorted(got, key=lambda r: key(r["doc_id"], r["lang"], r["perplexity"])), sorted(((d[0], d[2], *w) for d, w in zip(docs, want, strict=True)), key=lambda r: key(*r[:3])), strict=True))
    for g, (doc, lang, value, low, high, kept) in pairs:
        assert (g["doc_id"], g["lang"]) == (doc, lang)
        assert g["perplexity"] == (None if value is None else pytest.approx(value, rel=0.003))
        assert (g["least"], g["largest"]) == pytest.approx((low, high), rel=0.003)
        if value is None or min(abs(value / low - 1), abs(value / high - 1)) > 0.006:  # the table holds half floats
            assert g["kept"] == kept
    assert 20 < sum(w[-1] for w in want) < len(want)
    assert kn_quality.only_good(frame, marks).count() == sum(r["kept"] for r in got)


# --- 10 language: sizes and choice


def plain_language(text, dictionaries):
    """(language, margin) from the compressed size of every block under every dictionary."""
    data = re.sub(r"[\W\d_]+", " ", (text or "").lower()).encode() if any(c.isalpha() for c in text or "") else b""
    if not data or not dictionaries:
        return "und", 0.0
    sizes = []
    for k, (name, d) in enumerate(dictionaries.items()):
        known = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(level=9)
        sizes.append((sum(len(zstandard.ZstdCompressor(dict_data=known, write_content_size=False, write_checksum=False).compress(data[i : i + 4096])) for i in range(0, len(data), 4096)), k, name))
    first, second, *_ = sorted(sizes)
    return first[2], max(0.0, 1 - first[0] / second[0])


def test_language_sizes_and_choice(spark, corpus):
    docs = spark.createDataFrame(corpus[0], DOCS)
    known = lang_id.learn(docs)
    assert len(known) > 1
    got = sorted(((r["doc_id"], r["lang_pred"], round(r["score"], 9)) for r in lang_id.language_of(docs, known).collect()), key=str)
    want = sorted(((d[0], *((lambda p: (p[0], round(p[1], 9)))(plain_language(d[1], known)))) for d in corpus[0]), key=str)
    assert got == want


def test_dictionaries_are_of_learnable_texts(spark, corpus):
    import zlib

    known = lang_id.learn(spark.createDataFrame(corpus[0], DOCS))
    for lang, data in known.items():
        allowed = b" ".join(lang_id.letters(d[1][:1500]) for d in corpus[0] if d[0] is not None and d[1] and d[2] == lang and zlib.crc32(str(d[0]).encode()) % 4 != 2)
        assert set(data.split()) <= set(allowed.split())


# --- the pipeline, stage by stage


def test_each_stage_against_a_plain_version(spark, corpus, tmp_path):
    docs, labels = corpus
    folder = str(tmp_path / "tables")
    spark.createDataFrame(docs, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality bigint, toxic bigint").write.parquet(f"{folder}/labels.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    stages = dict(corpus_pipeline.STAGES)

    def through(name, rows):
        out = stages[name](spark, spark.createDataFrame(rows, DOCS), folder)
        assert out.columns == ["doc_id", "text", "lang", "source"]
        return sorted((tuple(r) for r in out.collect()), key=str)

    kept = through("quality", docs)
    sure = [(d, w) for d, w in zip(docs, plain_quality([d[:3] for d in docs], labels), strict=True) if w[0] is None or min(abs(w[0] / w[1] - 1), abs(w[0] / w[2] - 1)) > 0.006]
    assert len(sure) > 0.9 * len(docs) and all((d in kept) == w[-1] for d, w in sure)

    known = lang_id.learn(spark.createDataFrame(kept, DOCS))
    want = [d for d in kept if (lambda p: p[0] != "und" and p[1] >= lang_id.MARGIN)(plain_language(d[1], known))]
    kept = through("language", kept)
    assert kept == sorted(want, key=str) and kept

    groups = plain_components([d[:2] for d in kept], 80, 5)
    want = sorted({d for d, (doc, _, least) in zip(kept, groups, strict=True) if doc == least}, key=str)
    before, kept = len(kept), through("near_duplicates", kept)
    assert kept == want and len(kept) < before

    want = [d for d in kept if not plain_hits(d[1], items)[-1]]
    before, kept = len(kept), through("decontamination", kept)
    assert kept == want and len(kept) < before

    own = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    last = stages["sentencepiece"](spark, spark.createDataFrame(kept, DOCS), folder)
    assert sorted(((r["doc_id"], list(r["ids"])) for r in last.collect()), key=str) == sorted(((d[0], own.encode(d[1])) for d in kept), key=str)
    run = corpus_pipeline.run(spark, folder)
    assert sorted(((r["doc_id"], list(r["ids"])) for r in run.collect()), key=str) == sorted(((d[0], own.encode(d[1])) for d in kept), key=str)
