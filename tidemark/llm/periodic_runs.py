"""Periodic runs: stretches of words that repeat with some period, at least POWER times, found by recompression.

The words of a text become numbers, and a run-length grammar is built over them bottom up: rounds alternate block
compression (a symbol that stands k times in a row becomes one) and pair compression (symbols are split
into left and right ones, every left-right pair becomes one), until few symbols are left.  Equal symbols of a level have equal
expansions, and equal stretches are parsed alike but for their ends, so a longest common extension climbs
the grammar while parents agree and descends where they differ: a few steps a level, no suffix arrays.

A run of period q and length of POWER * q or more covers POWER - 1 neighbouring multiples of q, of which one is a multiple
of (POWER - 1) * q.  Those places, for every q, are the harmonic grid: n * ln(n) / (POWER - 1) candidates, most of
which fall by comparing single words.  For the rest two extension queries give both ends of the run exactly.

Texts of a batch share one grammar, parted by symbols that occur once, so all steps are array operations.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, sliced

#: A run is at least so many periods, and so many words, long.
POWER, LEAST = 4, 6
#: Candidates that are looked at together.
TOGETHER = 1 << 19

SPACES = r"[\x20\x09-\x0D]+"
RESULT = "doc_id bigint, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _bits(symbols: np.ndarray, turn: int) -> np.ndarray:
    """Whether a symbol is a left one in this turn."""
    h = (symbols.astype(np.uint64) + np.uint64(turn * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)) * _ODD
    h ^= h >> np.uint64(29)
    return ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(63)).astype(bool)


@dataclass
class Grammar:
    """All levels, one after the other: nodes of a level are neighbours, level 0 are the words.

    ``parent`` (-1 at the top) and ``child`` (the first one; -1 at level 0) lead between levels, ``last`` is the last
    child, ``head`` and ``tail`` the first and last node of the own parent, ``block`` tells that the parent is
    a block of equal symbols.
    """

    symbol: np.ndarray
    parent: np.ndarray
    child: np.ndarray
    last: np.ndarray
    head: np.ndarray
    tail: np.ndarray
    block: np.ndarray


def grammar(numbers: np.ndarray, few: int = 2) -> Grammar:
    """The run-length grammar of a sequence, up to a level of ``few`` symbols or less."""
    symbols, fresh, offset, turn = numbers.astype(np.int64), int(numbers.max(initial=0)) + 1, 0, 0
    levels, parents, blocks, firsts, lasts = [symbols], [], [], [np.full(len(symbols), -1)], [np.full(len(symbols), -1)]
    while len(symbols) > max(few, 1):
        n = len(symbols)
        if turn % 2 == 0:
            starts = np.flatnonzero(np.concatenate([[True], symbols[1:] != symbols[:-1]]))
        else:
            left = _bits(symbols, turn)
            pairs = max((left[:-1] & ~left[1:], ~left[:-1] & left[1:]), key=np.count_nonzero)
            starts = np.flatnonzero(np.concatenate([[True], ~pairs]))
        sizes = np.diff(np.append(starts, n))
        merged = symbols[starts]
        grown = np.flatnonzero(sizes > 1)
        if len(grown):
            second = sizes[grown] if turn % 2 == 0 else symbols[starts[grown] + 1]
            _, names = np.unique(merged[grown] * (max(fresh, n) + 1) + second, return_inverse=True)
            merged[grown] = fresh + names
            fresh += int(names.max()) + 1
        if len(grown) or turn % 2:
            parents.append(offset + n + np.repeat(np.arange(len(starts)), sizes))
            blocks.append(np.full(n, turn % 2 == 0))
            firsts.append(offset + starts)
            lasts.append(offset + starts + sizes - 1)
            levels.append(merged)
            symbols, offset = merged, offset + n
        turn += 1
    parents.append(np.full(len(symbols), -1))
    blocks.append(np.full(len(symbols), False))
    symbol, parent, child, last, block = map(np.concatenate, (levels, parents, firsts, lasts, blocks))
    at_top = parent < 0
    own = np.arange(len(symbol))
    head, tail = np.where(at_top, own, child[parent]), np.where(at_top, own, last[parent])
    return Grammar(symbol, parent, child, last, head, tail, block)


def extension(g: Grammar, a: np.ndarray, b: np.ndarray, forward: bool = True) -> np.ndarray:
    """How many words from a and b on (backward: down from them) are equal, for each pair of different places.

    Some symbol on the way must occur once only, so that every query ends within the sequence.
    """
    edge, down, step = (g.head, g.child, 1) if forward else (g.tail, g.last, -1)
    far = g.tail if forward else g.head
    x, y, begun = a.copy(), b.copy(), a.copy()
    falling = np.zeros(len(a), bool)
    active = np.arange(len(a))
    while len(active):
        p, q = x[active], y[active]
        up_p, up_q = g.parent[p], g.parent[q]
        climbs = ~falling[active] & (up_p >= 0) & (edge[p] == p) & (edge[q] == q) & (g.symbol[up_p] == g.symbol[up_q])
        same = ~climbs & (g.symbol[p] == g.symbol[q])
        differ = ~climbs & ~same
        over = differ & (g.child[p] < 0)
        falls = differ & ~over
        together = np.where(g.block[p], np.minimum(np.abs(far[p] - p), np.abs(far[q] - q)) + 1, 1) * step
        x[active] = np.where(climbs, up_p, np.where(same, p + together, np.where(falls, down[p], p)))
        y[active] = np.where(climbs, up_q, np.where(same, q + together, np.where(falls, down[q], q)))
        falling[active] |= falls
        active = active[~over]
    return np.abs(x - begun)


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each count c: its index c times, and 0 to c - 1."""
    index = np.repeat(np.arange(len(counts)), counts)
    return index, np.arange(len(index)) - np.repeat(np.cumsum(counts) - counts, counts)


def candidates(numbers: np.ndarray, begins: np.ndarray, sizes: np.ndarray):
    """(place, period) arrays of the harmonic grid whose words allow a run; texts lie at ``begins`` and are parted by unique numbers."""
    able = np.flatnonzero(sizes >= LEAST)
    text, less = _spread(sizes[able] // POWER)
    text, q = able[text], less + 1
    begin, size, stride = begins[text], sizes[text], (POWER - 1) * q
    counts = -(-(size - q) // stride)
    ends = np.cumsum(counts)
    done = 0
    while done < len(q):
        stop = max(int(np.searchsorted(ends, (ends[done - 1] if done else 0) + TOGETHER, "right")), done + 1)
        row, k = _spread(counts[done:stop])
        row += done
        place = begin[row] + k * stride[row]
        some = np.flatnonzero(numbers[place] == numbers[place + q[row]])
        row, place = row[some], place[some]
        period, low, high = q[row], begin[row], begin[row] + size[row]

        def equal(shift: int) -> np.ndarray:
            at = place + shift * period
            inside = (at >= low) & (at + period < high)
            at = np.where(inside, at, place)
            return inside & (numbers[at] == numbers[at + period])

        near = [equal(i) for i in range(2 - POWER, POWER - 1) if i]
        near.insert(POWER - 2, np.ones(len(place), bool))
        fits = np.zeros(len(place), bool)
        for i in range(POWER - 1):
            fits |= np.logical_and.reduce(near[i : i + POWER - 1])
        yield place[fits], period[fits]
        done = stop


def runs_of(texts: list[np.ndarray]) -> list[np.ndarray]:
    """For each sequence of numbers its runs: rows (start, length, period), by start and then period."""
    sizes = np.array([len(t) for t in texts], np.int64)
    out = [np.zeros((0, 3), np.int64)] * len(texts)
    if not len(texts) or sizes.max() < LEAST:
        return out
    begins = np.cumsum(sizes + 1) - sizes
    numbers = np.zeros(int(sizes.sum()) + len(texts) + 1, np.int64)
    least = max(int(t.max(initial=0)) for t in texts) + 1
    numbers[np.append(begins - 1, len(numbers) - 1)] = least + np.arange(len(texts) + 1)
    for t, at in zip(texts, begins.tolist(), strict=True):
        numbers[at : at + len(t)] = t

    found = list(candidates(numbers, begins, sizes))
    places, periods = (np.concatenate([f[i] for f in found]) for i in (0, 1))
    held = np.unique(np.searchsorted(begins, places, "right") - 1)
    if not len(held):
        return out
    # A grammar of the texts that have candidates; one symbol parts them.
    index, k = _spread(sizes[held] + 1)
    kept = np.append(begins[held][index] - 1 + k, len(numbers) - 1)
    g = grammar(numbers[kept], 2 * len(held))
    parts = []
    for i in range(0, len(places), TOGETHER):
        place, period = places[i : i + TOGETHER], periods[i : i + TOGETHER]
        at = np.searchsorted(kept, place)
        starts = place - extension(g, at - 1, at - 1 + period, False)
        ends = place + period + extension(g, at, at + period)
        enough = ends - starts >= np.maximum(LEAST, POWER * period)
        parts.append(np.unique(np.stack([starts, ends, period], 1)[enough], axis=0))
    rows = np.unique(np.concatenate(parts), axis=0)
    if not len(rows):
        return out
    # The smallest period of equal stretches; by Fine and Wilf the others are its multiples.
    rows = rows[np.concatenate([[True], np.any(rows[1:, :2] != rows[:-1, :2], axis=1)])]
    rows[:, 1] -= rows[:, 0]
    owner = np.searchsorted(begins, rows[:, 0], "right") - 1
    rows[:, 0] -= begins[owner]
    rows, owner = rows[order := np.lexsort((rows[:, 2], rows[:, 0], owner))], owner[order]
    for k, part in zip(np.unique(owner).tolist(), np.split(rows, np.flatnonzero(np.diff(owner)) + 1), strict=True):
        out[k] = part
    return out


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stay: those that no run holds after its first period."""
    if not len(runs):
        return np.ones(n, bool)
    ends = np.bincount(runs[:, 0] + runs[:, 1], minlength=n + 1)
    return np.cumsum(np.bincount(runs[:, 0] + runs[:, 2], minlength=n + 1) - ends)[:n] == 0


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, runs (start, length, period; by start, then period) and collapsed: the
    words, parted by single spaces, without those that repeat inside a run.

    Words are what whitespace parts, compared as they stand.  A null text counts as empty: no words, no runs, an
    empty collapsed text.  A null doc_id is kept as such, repeated rows stay repeated, an empty table gives no rows.  Very
    long texts are searched whole; memory grows with a text's words, not with their square.  Only key and text are
    read, whatever other columns are called.
    """
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    ship(docs.sparkSession)

    def searched(batches):
        for batch in sliced(batches):
            known: dict[bytes, int] = {}
            texts = [(t or b"").split() for t in batch.column("text").cast(pa.binary()).to_pylist()]
            numbers = [np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)) for words in texts]
            runs = runs_of(numbers)
            collapsed = [b" ".join(words if not len(r) else [w for w, stays in zip(words, kept_words(len(words), r).tolist(), strict=True) if stays]) for words, r in zip(texts, runs, strict=True)]
            flat = np.concatenate(runs) if runs else np.zeros((0, 3), np.int64)
            ends = np.cumsum([0, *map(len, runs)])
            parts = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], names=["start", "length", "period"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(w) for w in texts], pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), parts), pa.array(collapsed, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "runs", "collapsed"],
            )

    return rows.mapInArrow(searched, RESULT)


def with_planted(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, of which about a tenth, chosen by the checksum of their number, end in a repetition that depends on it.

    Those documents' words are parted by single spaces.  Rows with a null number, and texts without words, stay as they are.
    """
    h = F.crc32(F.col(key).cast("string").cast("binary"))
    chosen = docs.withColumn("_w", F.when(h % 10 == 0, F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), SPACES), "")))
    n, g = F.nullif(F.size("_w"), F.lit(0)).cast("bigint"), F.floor(h / 10)
    a = g % F.col("_n")
    p = F.floor((F.col("_n") - F.col("_a")) / (3 + g % 8)) + 1
    repeated = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1), lambda i: F.get("_w", F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int")))
    chosen = chosen.withColumn("_n", n).withColumn("_a", a).withColumn("_p", p)
    return chosen.withColumn(text, F.when(F.col("_n") > 0, F.array_join(repeated, " ")).otherwise(F.col(text))).drop("_w", "_n", "_a", "_p")


def digests(found: DataFrame) -> DataFrame:
    """n_runs, the longest run (ties: smallest start, then period) and hexadecimal SHA-256 sums of all runs and of the collapsed text."""
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")

    def hexed(text: Column) -> Column:
        return F.sha2(text.cast("binary"), 256)

    rows = found.withColumn("_best", longest)
    length = -F.col("_best.less")
    return rows.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("_best.start").alias("start"), length.alias("length"), F.col("_best.period").alias("period"),
        F.floor(F.lit(1000) * length / F.col("_best.period")).cast("bigint").alias("exponent_milli"), hexed(lines).alias("runs_sha256"), hexed(F.col("collapsed")).alias("collapsed_sha256"),
    )


def oracle() -> str:
    """DuckDB SQL for digests of periodic_runs over documents with planted repetitions: all pairs of equal words at most a quarter of the text apart."""
    from .shard import crc_table

    crc = "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1])), 4294967295)"
    return f"""
    WITH d AS (
        SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w, {crc} AS h
        FROM documents, (SELECT CAST({crc_table()} AS BIGINT[]) AS t)
    ), places AS (SELECT doc_id, w, h // 10 AS g, h % 10 = 0 AND len(w) > 0 AS planted, len(w) AS n FROM d),
    bent AS (SELECT *, CASE WHEN planted THEN g % n END AS a FROM places),
    texts AS (
        SELECT doc_id, n, CASE WHEN planted THEN list_transform(range(0, n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE w END AS w FROM bent
    ), words AS (SELECT doc_id, n, unnest(w) AS word, unnest(range(0, n)) AS i FROM texts),
    pairs AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND (y.i - x.i) * {POWER} <= x.n),
    islands AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs),
    stretches AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM islands GROUP BY doc_id, q, island HAVING count(*) + q >= greatest({LEAST}, {POWER} * q)),
    runs AS (SELECT doc_id, start, length, min(q) AS period FROM stretches GROUP BY ALL),
    summed AS (
        SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
               first(struct_pack(s := start, l := length, p := period) ORDER BY length DESC, start, period) AS best FROM runs GROUP BY 1
    ), dropped AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
    kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS collapsed FROM words ANTI JOIN dropped USING (doc_id, i) GROUP BY 1)
    SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(best.s AS BIGINT) AS start, CAST(best.l AS BIGINT) AS length, CAST(best.p AS BIGINT) AS period,
           CAST(1000 * best.l // best.p AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
    FROM texts LEFT JOIN summed USING (doc_id) LEFT JOIN kept USING (doc_id)"""
