"""SimHash by Golay codes, source divergence and periodic runs against plain versions, and on awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import divergence, golay_simhash, periodic_runs

DOCS = "doc_id bigint, text string, lang string, source string, node int, key string, place int, term string, block int, root int"
PROSE = "the shore and the tide of a long day with many birds over water "
AWKWARD = [None, "", " ", "\n\t", "a", "a b", "Same text here, twice.", "Same text here, twice.", "ÀÉ İK ß 日本 🙂 \x01\x1c x\x85y", PROSE * 400, "x" * 5000, "!!! ???", "ha " * 40]


def table(spark, texts, first=0):
    """Documents with more columns whose names the operators use inside."""
    rows = [(first + i, t, ("en", "fr", None)[i % 3], ("a", None, "b", "é")[i % 4], i, "k", i, "t", i, i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def awkward(spark):
    extra = [(None, "no number", None, None, 1, None, None, None, None, None), (3, "\n\n", "en", "s", 3, "k", 3, "x", 3, 3)]
    return table(spark, AWKWARD).unionByName(spark.createDataFrame(extra, DOCS))


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


# --- 11 simhash


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """The smallest number that links reach, for each of numbered fingerprints, by all pairs."""
    root = {p: p for p in prints.values()}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    distinct = sorted(root)
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    least = {}
    for k, p in prints.items():
        least[find(p)] = min(least.get(find(p), k), k)
    return {k: least[find(p)] for k, p in prints.items()}


def test_golay_code():
    checks = golay_simhash.golay_parities()
    words = [0]
    for i in range(12):
        words += [w ^ (1 << (i + 12) | int(checks[i])) for w in words]
    assert Counter(w.bit_count() for w in words) == {0: 1, 8: 759, 12: 2576, 16: 759, 24: 1}
    leaders, counts = golay_simhash.golay_leaders()
    assert np.bincount(counts).tolist() == [0, 2325, 0, 0, 0, 0, 1771]


@pytest.mark.parametrize("flips", [1, 2, 3])
def test_fingerprints_of_few_different_bits_share_a_key(flips):
    rng = np.random.default_rng(flips)
    prints = rng.integers(-(2**63), 2**63 - 1, 2_000)
    masks = np.array([sum(1 << int(b) for b in rng.choice(64, flips, replace=False)) for _ in prints], np.uint64)
    others = (prints.view(np.uint64) ^ masks).view(np.int64)
    shared = []
    for some in (prints, others):
        index, keys = golay_simhash.table_keys(some)
        held = defaultdict(set)
        for i, k in zip(index.tolist(), keys.tolist(), strict=True):
            held[i].add(k)
        shared.append(held)
    assert all(shared[0][i] & shared[1][i] for i in range(len(prints)))


def test_masks_part_what_is_not_exact():
    for t, masks in ((t, golay_simhash.other_bits(t)) for t in range(7)):
        bits = [m & (1 << 64) - 1 for m in masks]
        assert sum(b.bit_count() for b in bits) == sum(bits).bit_count() == (64 - golay_simhash.SEGMENTS[golay_simhash.PAIRS[t][0]][1] if t < 6 else 64)


def linked(spark, prints):
    nodes = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "node bigint")
    roots = {r["node"]: r["root"] for r in golay_simhash.components(golay_simhash.linked(nodes)).collect()}
    return {p: roots.get(int(np.uint64(p).astype(np.int64)), int(np.uint64(p).astype(np.int64))) for p in prints}


@pytest.mark.parametrize("kind", ["chains", "ball", "apart", "random"])
def test_links_connect_what_all_pairs_connect(spark, kind):
    rng = random.Random(kind)
    prints = {rng.getrandbits(64) for _ in range(20)}
    for start in sorted(prints)[:8]:
        p = start
        for _ in range(60):
            if kind == "chains":
                p ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))
                prints.add(p)
            elif kind == "ball":  # close to one centre, many not linked with it
                prints.add(start ^ sum(1 << b for b in rng.sample(range(64), rng.randint(2, 6))))
            elif kind == "apart":  # one exact segment for all, the rest far away
                prints.add(start & (1 << 21) - 1 | rng.getrandbits(43) << 21)
    got = linked(spark, prints)
    want = plain_components({p: p for p in prints})
    same = defaultdict(set)
    for p in prints:
        same[got[p]].add(want[p])
    assert all(len(v) == 1 for v in same.values()) and len(same) == len(set(want.values()))


def test_group_of_close_prints_makes_no_pairs(spark):
    """2,000 prints within two bits of one: rows compared stay in proportion to the keys."""
    centre, prints = 0x0123456789ABCDEF, set()
    rng = random.Random(4)
    while len(prints) < 2_000:
        prints.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 2))))
    nodes = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "node bigint")
    out = golay_simhash.linked(nodes)
    assert out.count() < 60 * 2_000 and golay_simhash.components(out).select("root").distinct().count() == 1


def test_simhash_groups(spark, awkward, nothing):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(15):
        words = rng.choices(vocabulary, k=rng.choice([2, 3, 40, 300]))
        texts.append(" ".join(words))
        for _ in range(6):
            words = words[:]
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append("\t".join(words) + rng.choice(["", " ", "\n"]))
    docs = awkward.unionByName(table(spark, texts, 100))
    rows = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in golay_simhash.simhash_groups(docs).collect()]
    assert len(rows) == docs.count()
    texts_of = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted((k, f) for k, f, _ in rows if k is not None) == sorted((k, f"{plain_print(t):016x}") for k, t in texts_of if k is not None)
    least = {}
    for k, t in texts_of:
        p = plain_print(t)
        if k is not None:
            least[p] = min(least.get(p, k), k)
    want = plain_components({p: p for p in {plain_print(t) for _, t in texts_of}})
    ids = defaultdict(list)
    for p, root in want.items():
        ids[root].append(least.get(p))
    for k, f, component in rows:
        known = [i for i in ids[want[int(f, 16)]] if i is not None]
        assert component == min(known, default=None), k
    assert golay_simhash.simhash_groups(nothing).count() == 0


# --- 12 divergence


def plain_divergence(rows, least, top):
    """rows: (lang, source, text)."""
    rows = [tuple(v or "" for v in r) for r in rows]
    terms = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(t)) for _, _, t in rows]
    out = []
    for lang in sorted({r[0] for r in rows}):
        own = [i for i, r in enumerate(rows) if r[0] == lang]
        held = Counter(t for i in own for t in set(terms[i]))
        kept = [t for t, n in held.items() if n >= least]
        counts = {s: Counter(t for i in own if rows[i][1] == s for t in terms[i] if held[t] >= least) for s in {rows[i][1] for i in own}}
        counts[None] = sum(counts.values(), Counter())
        share = {s: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept} for s, c in counts.items()}
        for s in sorted(k for k in counts if k is not None):
            pairs = [(sum(abs(share[s][t] - share[o][t]) for t in kept), o) for o in counts if o not in (s, None)]
            more = [(share[s][t] - share[None][t], t) for t in kept if counts[s][t] > 0 and share[s][t] > share[None][t]]
            for part, found, most in (("pair", pairs, None), ("term", more, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(ranked)]
    return out


@pytest.mark.parametrize("block", [divergence.BLOCK, 3])
def test_divergence(spark, awkward, monkeypatch, block):
    monkeypatch.setattr(divergence, "BLOCK", block)
    rng = random.Random(block)
    vocabulary = [f"{a}{b}" for a in "abcdé日" for b in "xyzXYZ"]
    texts = [" ".join(rng.choices(vocabulary[: rng.choice([5, 20, 36])], k=rng.choice([0, 3, 30]))) for _ in range(120)]
    docs = awkward.unionByName(table(spark, texts, 50))
    plain = [(r["lang"], r["source"], r["text"]) for r in docs.collect()]
    for least, top in ((1, 50), (6, 4), (10**6, 5)):
        got = sorted(map(tuple, divergence.divergence(docs, least=least, top=top).collect()))
        assert got == sorted(plain_divergence(plain, least, top))


def test_divergence_of_little(spark, nothing):
    assert divergence.divergence(nothing).count() == 0
    one = table(spark, ["a b"]).unionByName(table(spark, ["c"]))
    assert divergence.divergence(one, least=1).where("part = 'pair'").count() == 0
    two = table(spark, [None]).withColumn("source", F.lit("z")).unionByName(table(spark, ["a"]))
    assert sorted(map(tuple, divergence.divergence(two).collect())) == [("en", "a", "pair", "z", 0, 1), ("en", "z", "pair", "a", 0, 1)]


def test_partial_counts_are_passed_on(spark, monkeypatch):
    docs = table(spark, ["a b c", "c d e", "a a f"] * 50)
    want = sorted(map(tuple, divergence.divergence(docs, least=2).collect()))
    monkeypatch.setattr(divergence, "HELD", 2)
    assert sorted(map(tuple, divergence.divergence(docs, least=2).collect())) == want


# --- 13 periodic runs


def plain_runs(words):
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def plain_planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i if i < a else a + (i - a) % p] for i in range(n)]


def plain_digest(doc_id, text):
    words = plain_planted(doc_id, re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    runs = plain_runs(words)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(((-n, s, q) for s, n, q in runs), default=None)
    first = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    sums = ("".join(f"{s},{n},{q}\n" for s, n, q in runs), " ".join(w for i, w in enumerate(words) if i not in dropped))
    return (doc_id, len(runs), *first, *(hashlib.sha256(s.encode()).hexdigest() for s in sums))


def repetitive(rng):
    words = [rng.choice("abcdefgh"[: rng.choice([1, 2, 3, 8])]) for _ in range(rng.choice([0, 1, 5, 6, 7, 30, 150]))]
    for _ in range(rng.randint(0, 2)):
        a = rng.randrange(len(words) + 1)
        words = words[:a] + words[a : a + rng.randint(1, 6)] * rng.randint(3, 9) + words[a:]
    return words


def test_runs_of_batches():
    rng = random.Random(3)
    for _ in range(150):
        texts = [repetitive(rng) for _ in range(rng.randint(0, 6))]
        got = periodic_runs.runs_of([np.array([ord(w) for w in t], np.int64) for t in texts])
        assert [[tuple(r) for r in g.tolist()] for g in got] == [plain_runs(t) for t in texts]


def test_candidates_in_slices(monkeypatch):
    monkeypatch.setattr(periodic_runs, "TOGETHER", 7)
    test_runs_of_batches()


def test_extensions():
    rng = np.random.default_rng(8)
    words = np.concatenate([[90], rng.integers(0, 2, 400), [91], np.tile(rng.integers(0, 9, 7), 40), [92]])
    g = periodic_runs.grammar(words)
    a = rng.integers(1, len(words) - 2, 3000)
    b = np.minimum(a + rng.integers(1, 60, 3000), len(words) - 1)
    a, b = a[a != b], b[a != b]
    ahead, back = periodic_runs.extension(g, a, b), periodic_runs.extension(g, a, b, False)
    for x, y, f, k in zip(a.tolist(), b.tolist(), ahead.tolist(), back.tolist(), strict=True):
        n = 0
        while words[x + n] == words[y + n]:
            n += 1
        m = 0
        while words[x - m] == words[y - m]:
            m += 1
        assert (f, k) == (n, m)


def test_grammar_is_small_for_long_repetition():
    g = periodic_runs.grammar(np.concatenate([[5], np.tile([1, 2, 3], 50_000), [6]]))
    assert len(np.unique(g.symbol)) < 200


def test_periodic_runs(spark, awkward, nothing):
    rng = random.Random(6)
    texts = ["".join(w + rng.choice([" ", "\n", "\t ", "  "]) for w in repetitive(rng)) for _ in range(150)] + ["word " * 40_000, "a b c " * 20_000 + "A b c"]
    docs = awkward.unionByName(table(spark, texts, 200))
    found = periodic_runs.periodic_runs(periodic_runs.with_planted(docs))
    got = sorted(map(tuple, periodic_runs.digests(found).collect()), key=str)
    small = [(r["doc_id"], r["text"]) for r in docs.where(F.coalesce(F.length("text"), F.lit(0)) < 20_000).collect()]
    want = sorted((plain_digest(*r) for r in small), key=str)
    large = [r for r in got if r[0] is not None and r[0] >= 350 or r[0] == 9]
    assert [r for r in got if r not in large] == want and len(large) == 3
    assert found.where("doc_id = 350").first()["collapsed"] == "word"
    assert periodic_runs.with_planted(docs).columns == docs.columns
    assert periodic_runs.periodic_runs(nothing).count() == 0 and periodic_runs.with_planted(nothing).count() == 0
