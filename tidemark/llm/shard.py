"""Sharding: a Feistel permutation of the global row numbers.

The row numbers 0..n-1 are laid out on a grid of a x b cells, with a = ceil(sqrt(n)) and
b = ceil(n / a).  A Feistel network whose halves are the two grid coordinates permutes the
cells; cells beyond n are walked until they lead back below n.  Shard and slot of any row
follow from its number, the seed and n alone.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered

ROUNDS = 6
SQUARED = 1_000_003
PRIME = 2_147_483_647


def round_keys(seed: int, rounds: int = ROUNDS) -> list[tuple[int, int, int]]:
    """Three numbers below PRIME for each round."""
    keys = []
    for k in range(rounds):
        d = hashlib.sha256(f"{seed}/{k}".encode()).digest()
        keys.append(tuple(int.from_bytes(d[i : i + 8], "little") % (PRIME - 1) + 1 for i in (0, 8, 16)))
    return keys


def grid(n: int) -> tuple[int, int]:
    a = math.isqrt(max(n - 1, 0)) + 1
    return a, max(1, -(-n // a))


def _mixed(v: Column, key: Column) -> Column:
    x = (v + key["k0"]) % F.lit(SQUARED)
    return (((x * x + key["k1"]) % F.lit(PRIME)) * key["k2"] + x) % F.lit(PRIME)


def permuted(row_no: Column, n: int, seed: int) -> Column:
    """One pass of the network over the grid."""
    a, b = grid(n)
    keys = F.array(*[F.struct(F.lit(k % 2).alias("odd"), *[F.lit(v).cast("bigint").alias(f"k{i}") for i, v in enumerate(key)]) for k, key in enumerate(round_keys(seed))])

    def one(s: Column, key: Column) -> Column:
        left = F.when(key["odd"] == 0, (s["l"] + _mixed(s["r"], key)) % F.lit(a)).otherwise(s["l"])
        right = F.when(key["odd"] == 1, (s["r"] + _mixed(s["l"], key)) % F.lit(b)).otherwise(s["r"])
        return F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"))

    start = F.struct(F.floor(row_no / F.lit(b)).cast("bigint").alias("l"), (row_no % F.lit(b)).cast("bigint").alias("r"))
    return F.aggregate(keys, start, one, lambda s: s["l"] * F.lit(b) + s["r"])


def shuffled_number(row_no: Column, n: int, seed: int) -> Column:
    """The row's place in the shuffle, 0..n-1.

    Fewer than a cells lie beyond n, and a walk meets each of them at most once, so a walk of
    that many steps always ends.  On large grids one step goes astray with a chance of 1/b; 40
    steps in a row do not, and if they did the job would stop instead of placing a row wrongly.
    """
    a, b = grid(n)
    beyond = a * b - n
    first = permuted(row_no, n, seed)
    if not beyond:
        return first
    steps = F.sequence(F.lit(1), F.lit(min(beyond, 40)))
    walked = F.aggregate(steps, first, lambda p, _: F.when(p >= F.lit(n), permuted(p, n, seed)).otherwise(p))
    return F.when(first < F.lit(n), first).when(walked < F.lit(n), walked).otherwise(F.raise_error(F.lit("cycle walk too long; choose another seed")).cast("bigint"))


def shard_rows(docs: DataFrame, shards: int = 16, seed: int = 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Deals all rows into ``shards`` shards whose counts differ by one at most (law ``rows``).

    Rows are numbered by key (null first), then by the checksum and size of the text; fully equal
    rows are interchangeable.  ``size`` is the UTF-8 length plus 1, so 1 for null and empty
    texts; very long ones are measured whole.  An empty table gives no rows.  Other columns are not read.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    content = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.col(key).alias("doc_id"), (F.octet_length(content) + 1).cast("bigint").alias("size"), F.crc32(content.cast("binary")).alias("text_crc32"))
    rows, n = numbered(base, [F.col("doc_id").asc_nulls_first(), F.col("text_crc32").asc(), F.col("size").asc()])
    place = rows.withColumn("_p", shuffled_number(F.col("row_no"), max(n, 1), seed))
    return place.select(
        "doc_id", "size", "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("_p") % shards).cast("int").alias("shard"),
        F.floor(F.col("_p") / F.lit(shards)).cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "row_no",
    )


def crc_table() -> list[int]:
    """The byte table of the usual CRC-32 (reflected polynomial 0xEDB88320)."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


def oracle(shards: int = 16, seed: int = 20) -> str:
    """DuckDB SQL for shard_rows over a table documents whose doc_id is unique."""

    def network(source: str) -> str:
        """Passes the rows of source through the rounds."""
        sql = f"SELECT row_no, n, a, b, p // b AS l, p % b AS r FROM {source}"
        for k, (k0, k1, k2) in enumerate(round_keys(seed)):
            v = "r" if k % 2 == 0 else "l"
            x = f"(({v} + {k0}) % {SQUARED})"
            f = f"(((({x} * {x} + {k1}) % {PRIME}) * {k2} + {x}) % {PRIME})"
            pair = f"(l + {f}) % a AS l, r" if k % 2 == 0 else f"l, (r + {f}) % b AS r"
            sql = f"SELECT row_no, n, a, b, {pair} FROM ({sql})"
        return f"SELECT row_no, n, a, b, l * b + r AS p FROM ({sql})"

    return f"""
    WITH RECURSIVE base AS (
        SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size,
               list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS bytes
        FROM documents
    ), dims AS (
        SELECT n, a, CAST((n + a - 1) // a AS BIGINT) AS b
        FROM (SELECT count(*) AS n, CAST(ceil(sqrt(count(*))) AS BIGINT) AS a FROM base)
    ), numbered AS (
        SELECT doc_id, size, row_number() OVER (ORDER BY doc_id NULLS FIRST) - 1 AS row_no,
               xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes),
                               lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1])), 4294967295) AS text_crc32
        FROM base, (SELECT CAST({crc_table()} AS BIGINT[]) AS t)
    ), walk AS (
        {network('(SELECT row_no, n, a, b, row_no AS p FROM numbered, dims)')}
        UNION ALL
        {network('(SELECT * FROM walk WHERE p >= n)')}
    )
    SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(p % {shards} AS INTEGER) AS shard, CAST(p // {shards} AS BIGINT) AS slot,
           CAST(NULL AS INTEGER) AS grown_shard, row_no
    FROM walk JOIN numbered USING (row_no) WHERE p < n"""
