"""Source divergence audit: how far the word use of each source lies from that of every other source of its language.

Each (language, source) group is a sparse row of term counts.  With p the smoothed share of a term in a group (in parts of
SCALE), the distance of two groups is the sum of |p - q| over all kept terms, in whole numbers.

Most terms are missing from most rows, where p is the group's baseline p0 (the share of a count of zero).  So a distance is
V * |p0 - q0|, corrected by each row's own terms against the other's baseline, and by |p - q| - |p - q0| - |p0 - q| + |p0 - q0|
for the terms that both have.  The last sum is a sparse product, found row by row (Gustavson): a row's terms are looked up
in the term-major index, and what they meet there is added to a dense accumulator with one place for each peer.  No pair of
postings leaves the task.  The terms of a language are dealt into blocks of about BLOCK postings, so neither a large language nor a
large source is one task; the accumulators of a row are summed over blocks.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, shared_folder, ship, sliced, staged

#: Documents of a language that must hold a term, pseudo-count, scale of shares, ranks of terms.
LEAST, PSEUDO, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Postings of a block of terms, about, and partial counts that a task holds before it passes them on.
BLOCK, HELD = 200_000, 400_000

#: For bytes.translate: A-Z to a-z, ASCII other than letters to a space.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
COUNTS = "lang string, source string, term string, n bigint, docs bigint"


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of every term in every group; a group without terms has one row of a null term."""
    ship(docs.sparkSession)
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))]

    def table(held):
        rows = [(*group, term, packed & (1 << 40) - 1, packed >> 40) for group, terms in held.items() for term, packed in (terms or {None: 0}).items()]
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.binary()).cast(pa.string()), pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.int64())],
            names=["lang", "source", "term", "n", "docs"],
        )

    def counted(batches):
        held: dict[tuple, dict] = {}
        size = 0
        for batch in sliced(batches):
            for at, own, value in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                terms = held.setdefault((at, own), {})
                size -= len(terms)
                for term, n in Counter(value.translate(TERM_BYTES).split()).items():
                    terms[term] = terms.get(term, 0) + (1 << 40) + n
                size += len(terms)
            if size > HELD:
                yield table(held)
                held, size = {}, 0
        if held:
            yield table(held)

    parts = docs.select(*named).mapInArrow(counted, COUNTS)
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + PSEUDO) / (total + PSEUDO * terms)), exactly."""
    wide = lambda c: c.cast("decimal(28,0)")
    up, down = F.lit(SCALE).cast("decimal(10,0)") * wide(n + PSEUDO), wide(total + PSEUDO * terms)
    return F.call_function("div", up, F.nullif(down, F.lit(0).cast("decimal(28,0)"))) + 1


def one_sided(values: np.ndarray, zero: int, centres: np.ndarray) -> np.ndarray:
    """For each centre c the sum of |v - c| - |zero - c| over the values, by prefix sums."""
    values = np.sort(values)
    sums = np.concatenate([[0], np.cumsum(values)])
    below = np.searchsorted(values, centres)
    total = centres * below - sums[below] + (sums[-1] - sums[below]) - centres * (len(values) - below)
    return total - len(values) * np.abs(zero - centres)


def accumulated(place: np.ndarray, term: np.ndarray, p: np.ndarray, zeros: np.ndarray):
    """For each row that occurs (place, its terms numbered, shares): place, sums over shared terms, one-sided sums; both by peer."""
    by_term = np.argsort(term, kind="stable")
    peers, shares = place[by_term], p[by_term]
    begins = np.searchsorted(term[by_term], np.arange(int(term.max(initial=-1)) + 2))
    by_row = np.argsort(place, kind="stable")
    for rows in np.split(by_row, np.flatnonzero(np.diff(place[by_row])) + 1):
        own, zero = int(place[rows[0]]), int(zeros[place[rows[0]]])
        lengths = begins[term[rows] + 1] - begins[term[rows]]
        posts = np.repeat(begins[term[rows]] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
        here, q, peer = np.repeat(p[rows], lengths), shares[posts], peers[posts]
        q0 = zeros[peer]
        dense = np.zeros(len(zeros), np.int64)
        np.add.at(dense, peer, np.abs(here - q) - np.abs(here - q0) - np.abs(zero - q) + np.abs(zero - q0))
        yield own, dense, one_sided(p[rows], zero, zeros)


def divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part ``pair`` has for every group each other source of its language and their distance, largest first; part ``term``
    the terms whose share in the group exceeds that in the language most, to rank ``top``.  Ties go by the bytes of
    the item.  Kept terms are those in at least ``least`` documents of the language; without any, distances are 0.

    Null text, lang and source count as empty; empty texts have no terms but their group stays.  Repeated rows count each; an
    empty table gives no rows; very long texts are counted whole.  Only text, lang and source are read, whatever other columns are called.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark)
    counts = staged(term_counts(docs, text, lang, source), f"{folder}/counts")
    words = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("held_by"), F.sum("n").alias("in_lang"))
    kept = staged(words.where(F.col("held_by") >= least).select("lang", "term", "in_lang"), f"{folder}/kept")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("in_lang").alias("n_lang"))
    cells = counts.select("lang", "source", "term", "n").join(kept, ["lang", "term"])
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("filled"))
    groups = counts.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "filled", "v", "n_lang"])
    groups = groups.withColumn("p0", F.coalesce(share(F.lit(0), F.col("total"), F.col("v")), F.lit(0)).cast("bigint"))
    in_lang = Window.partitionBy("lang")
    groups = groups.withColumns({"place": F.row_number().over(in_lang.orderBy("source")) - 1, "blocks": F.ceil(F.sum("filled").over(in_lang) / BLOCK).cast("bigint")})
    groups = staged(groups, f"{folder}/groups")
    shares = cells.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("v")).cast("bigint"))
    shares = staged(shares.withColumn("q", share(F.col("in_lang"), F.col("n_lang"), F.col("v")).cast("bigint")).withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks"))).select("lang", "source", "term", "p", "q", "place", "block"), f"{folder}/shares")
    ship(spark)

    def scattered(key, postings: pd.DataFrame, peers: pd.DataFrame) -> pd.DataFrame:
        zeros = np.zeros(len(peers), np.int64)
        zeros[peers["place"].to_numpy()] = peers["p0"].to_numpy()
        rows = accumulated(postings["place"].to_numpy(np.int64), pd.factorize(postings["term"])[0], postings["p"].to_numpy(np.int64), zeros) if len(postings) else []
        return pd.DataFrame([(key[0], place, dense, sided) for place, dense, sided in rows], columns=["lang", "place", "both", "sided"])

    dealt = groups.where("blocks > 0").select("lang", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"), "place", "p0")
    blocks = shares.select("lang", "block", "term", "place", "p").groupBy("lang", "block").cogroup(dealt.groupBy("lang", "block"))
    sums = blocks.applyInPandas(scattered, "lang string, place int, both array<bigint>, sided array<bigint>")
    sums = sums.select("lang", "place", F.posexplode(F.arrays_zip("both", "sided")).alias("peer", "sum")).where("place <> peer")
    back = sums.select("lang", F.col("peer").alias("place"), F.col("place").alias("peer"), F.col("sum.sided").alias("part"))
    both = sums.select("lang", "place", "peer", (F.col("sum.both") + F.col("sum.sided")).alias("part")).union(back).groupBy("lang", "place", "peer").agg(F.sum("part").alias("part"))

    own = groups.select("lang", "source", "place", "p0", "v")
    peer = groups.select("lang", F.col("source").alias("item"), F.col("place").alias("peer"), F.col("p0").alias("q0"))
    pairs = own.join(peer, "lang").where("place <> peer").join(both, ["lang", "place", "peer"], "left")
    pairs = pairs.withColumn("value", F.coalesce("part", F.lit(0)) + F.col("v") * F.abs(F.col("p0") - F.col("q0")))
    ranked = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(ranked).alias("rank"))
    terms = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)
    return pairs.union(terms)


def oracle(least: int = LEAST, top: int = TOP) -> str:
    """DuckDB SQL for divergence over documents: every kept term for every pair of groups."""
    share_of = lambda n, total: f"1 + ({SCALE} * (CAST({n} AS HUGEINT) + {PSEUDO})) // ({total} + {PSEUDO} * v)"
    return f"""
    WITH d AS (
        SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
               list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda t: t <> '') AS terms FROM documents
    ), words AS (SELECT lang, source, unnest(terms) AS term FROM d),
    held AS (SELECT lang, unnest(list_distinct(terms)) AS term FROM d),
    kept AS (SELECT lang, term FROM held GROUP BY ALL HAVING count(*) >= {least}),
    counts AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
    langs AS (SELECT lang, count(*) AS v FROM kept GROUP BY 1),
    summed AS (SELECT lang, term, sum(n) AS n FROM counts GROUP BY ALL),
    in_lang AS (SELECT *, sum(n) OVER (PARTITION BY lang) AS total FROM summed),
    groups AS (SELECT DISTINCT lang, source FROM d),
    totals AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM groups LEFT JOIN counts USING (lang, source) GROUP BY ALL),
    shares AS (
        SELECT lang, source, term, coalesce(n, 0) AS n, {share_of('coalesce(n, 0)', 'total')} AS p
        FROM totals JOIN langs USING (lang) JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)
    ), met AS (
        SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value
        FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
    ), pairs AS (
        SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(value, 0) AS value
        FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN met m ON m.lang = g.lang AND m.source = g.source AND m.item = h.source
    ), terms AS (
        SELECT s.lang, s.source, 'term' AS part, s.term AS item, s.p - ({share_of('i.n', 'i.total')}) AS value
        FROM shares s JOIN in_lang i USING (lang, term) JOIN langs USING (lang) WHERE s.n > 0
    ), every AS (SELECT * FROM pairs UNION ALL SELECT * FROM terms WHERE value > 0),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM every)
    SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= {top}"""
