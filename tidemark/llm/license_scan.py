"""License scans: fixed phrases, and an exact set-similarity join of text blocks with templates.

A block is a run of 2 * reach consecutive words, one beginning at every reach-th word, line ends or not; a
template belongs to the least reach of 12, 24, 48, ... that is not less than its number of words, so a notice as long as its template
lies whole in some block, wrapped or in the middle of a long line, and words scattered over a long text don't meet.
A template with n distinct words matches a block that holds at least ceil(threshold * n) of them; the join finds all such pairs.
Its label is given where the block also holds one of its telling runs: words that stand one after the other in no other licence's notice, as ``general public license version 3`` after ``gnu``.
So notices of one family don't give each other's labels, and what else a block holds, such as a second licence or the number of a
chapter, neither adds a label nor takes one away.

Template words are ordered by their document frequency over all
documents, rarest first, and written as ranks.  A block meets a template in the join only by a
rank of the template's prefix (its first n - need + 1 ranks), which every match must share;
length and positional filters then bound the overlap before it is counted exactly.  Words outside
the templates can't add to an overlap, so blocks keep only ranks.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower, literal_rows

#: Phrases with the labels that they prove.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

#: Notices of public licences, with their labels and telling runs.
TEMPLATES = (
    ("mit", "Released under the MIT License", ("mit license",)),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction", ("permission is hereby granted free of charge",)),
    ("apache-2", "Licensed under the Apache License, Version 2.0", ("apache license version 2", "apache license 2")),
    ("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", ("apache org licenses license 2",)),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", ("cc by nc 4",)),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ("commons attribution noncommercial 4",)),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3", ("gnu general public license version 3", "gnu general public license v3", "gnu general public license 3")),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", ("gnu general public license as published by the free software foundation either version 3",)),
    ("lgpl-3", "Licensed under the GNU Lesser General Public License, version 3", ("gnu lesser general public license version 3", "gnu lesser general public license v3", "gnu lesser general public license 3")),
    ("lgpl-3", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License", ("gnu lesser general public license as published by the free software foundation either version 3",)),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license v 2", "mozilla public license version 2")),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("cc0", "To the extent possible under law, the author has dedicated all copyright and related rights to the public domain under CC0 1.0 Universal", ("cc0 1",)),
)
LEAST_REACH = 12

_W = r"[0-9A-Za-z\x{80}-\x{10FFFF}]"
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def all_words(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))


def template_words(text: str) -> list[str]:
    """The distinct words of a template in their order."""
    return list(dict.fromkeys(all_words(text)))


def reach(text: str) -> int:
    """Half the length of the blocks that a template is compared with."""
    out = LEAST_REACH
    while out < len(all_words(text)):
        out *= 2
    return out


def needed(n: int, threshold: float) -> int:
    return max(1, math.ceil(threshold * n - 1e-9))


def words_in(text: Column) -> Column:
    """The words of a text, as they stand."""
    return F.array_remove(F.split(text, _GAP), "")


def phrase_pattern(phrase: str) -> str:
    """Finds the phrase's words one after the other; no phrase may overlap itself."""
    words = phrase.split(" ")
    if any(words[:k] == words[-k:] for k in range(1, len(words))):
        raise ValueError(f"phrase overlaps itself: {phrase}")
    return f"(?i)(?<!{_W})" + _GAP.join(map(re.escape, words)) + f"(?!{_W})"


def _count(text: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).cast("bigint")


def phrase_places(text: Column, phrases=PHRASES) -> dict[str, Column]:
    """n_base, first_word, last_word and the array base_labels of a text that is not null."""
    hits, firsts, lasts, labels = [], [], [], []
    lowered = F.lower(text)
    for phrase, label in phrases:
        pattern = phrase_pattern(phrase)
        maybe = lowered.contains(max(phrase.split(" "), key=len))
        n = F.when(maybe, _count(text, pattern)).otherwise(F.lit(0).cast("bigint"))
        hits.append(n)
        found = maybe & text.rlike(pattern)
        firsts.append(F.when(found, F.size(words_in(F.split(text, pattern, 2)[0])).cast("bigint")))
        lasts.append(F.when(found, F.size(words_in(F.regexp_extract(text, "(?s)^(.*)" + pattern, 1))).cast("bigint")))
        labels.append(F.when(found, F.lit(label)))
    total = hits[0]
    for n in hits[1:]:
        total = total + n
    least, most = (F.least(*firsts), F.greatest(*lasts)) if len(phrases) > 1 else (firsts[0], lasts[0])
    return {"n_base": total, "first_word": least, "last_word": most, "_base": F.array_sort(F.array_distinct(F.array_compact(F.array(*labels))))}


def word_ranks(docs: DataFrame, vocabulary: list[str], text: str = "text") -> dict[str, int]:
    """Ranks template words by the number of documents that hold them, rarest first."""
    known = F.array(*[F.lit(w) for w in vocabulary])
    # The order only steers the search, so the faster Unicode lower-casing does here.
    held = docs.select(F.explode(F.array_intersect(known, words_in(F.lower(F.coalesce(F.col(text), F.lit("")))))).alias("word"))
    counts = {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count("*").alias("n")).collect()}
    return {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}


def template_matches(docs: DataFrame, templates=TEMPLATES, threshold: float = 0.8, text: str = "text") -> DataFrame:
    """Every (text_sha, reach, first, label, template_no, containment, telling) at or above the threshold; a block begins at the word ``first``.

    ``telling`` says whether the block holds one of the template's telling runs; pairs without one are returned all the same.
    Equal texts are scanned once; ``text_sha`` is the hexadecimal SHA-256 of the text.
    """
    sets = [(k, label, template_words(t), reach(t), tells) for k, (label, t, tells) in enumerate(templates)]
    vocabulary = sorted({w for _, _, ws, _, _ in sets for w in ws})
    runs = sorted({r for *_, tells in sets for r in tells})
    ranks = word_ranks(docs, vocabulary, text)
    rows = []
    for k, label, ws, size, tells in sets:
        order, need = sorted(ranks[w] for w in ws), needed(len(ws), threshold)
        for i, rank in enumerate(order[: len(order) - need + 1]):
            rows.append({"rank": rank, "reach": size, "template_no": k, "label": label, "place": i + 1, "need": need, "template": order, "tells": [runs.index(r) for r in tells]})
    index = literal_rows(docs.sparkSession, rows, "rank int, reach int, template_no int, label string, place int, need int, template array<int>, tells array<int>")
    prefix = sorted({r["rank"] for r in rows})
    by_rank = {v: k for k, v in ranks.items()}
    rank_of = F.create_map(*[x for w, r in ranks.items() for x in (F.lit(w), F.lit(r))])
    known = F.array(*[F.lit(w) for w in vocabulary])
    ends_known = F.array(*[F.lit(by_rank[r]) for r in prefix])

    def line(words: Column) -> Column:
        """The words between spaces, in an array, so that lambdas see it made once; no word holds a space."""
        return F.array(F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")))

    texts = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("_text"), words_in(ascii_lower(F.col(text))).alias("_words"))
    texts = texts.where(F.arrays_overlap("_words", ends_known)).select(F.sha2("_text", 256).alias("text_sha"), "_words")
    sizes = F.array(*[F.lit(n) for n in sorted({size for _, _, _, size, _ in sets})])
    starts = texts.select("text_sha", "_words", F.explode(sizes).alias("reach"))
    starts = starts.select("text_sha", "_words", "reach", F.explode(F.sequence(F.lit(0), F.greatest(F.size("_words") - F.col("reach") - 1, F.lit(0)), F.col("reach"))).alias("first"))
    own = F.slice("_words", F.col("first") + 1, 2 * F.col("reach"))
    blocks = starts.select("text_sha", "reach", "first", own.alias("_own")).where(F.arrays_overlap("_own", ends_known))
    tells = F.array_compact(F.transform(line(F.col("_own")), lambda t: F.array(*[F.when(t.contains(f" {r} "), F.lit(i)) for i, r in enumerate(runs)]))[0])
    blocks = blocks.select("text_sha", "reach", "first", F.array_intersect(known, "_own").alias("_held"), tells.alias("told"))
    blocks = blocks.select("text_sha", "reach", "first", "told", F.array_sort(F.transform("_held", lambda w: rank_of[w])).alias("block")).distinct()
    ends = blocks.select("text_sha", "reach", "first", "told", "block", F.explode(F.array_intersect(F.array(*[F.lit(r) for r in prefix]), F.col("block"))).alias("rank"))
    met = ends.join(F.broadcast(index), ["rank", "reach"])  # one row per template and prefix rank
    at = F.array_position("block", F.col("rank")).cast("int")
    bound = F.least(F.col("place"), at) + F.least(F.size("template") - F.col("place"), F.size("block") - at)
    met = met.where((F.size("block") >= F.col("need")) & (bound >= F.col("need")))
    overlap = F.size(F.array_intersect("block", "template"))
    met = met.where(overlap >= F.col("need"))
    return met.select("text_sha", "reach", "first", "label", "template_no", (overlap / F.size("template")).alias("containment"), F.arrays_overlap("told", "tells").alias("telling")).distinct()


def license_scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, threshold: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: word count, phrase places, labels and the best containment.

    A null text counts as empty: no words, no places (first_word and last_word null), empty
    label strings and score 0.  ``score`` is 1 with a phrase, else the best containment that
    met the threshold, else 0.  Repeated rows stay repeated, an empty table gives no rows.  Very long
    texts are scanned whole, in blocks.  Only key and text are read, whatever other columns are called.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.col(key).alias("doc_id"), content.alias("_text"))
    base = base.select(
        "doc_id",
        F.sha2("_text", 256).alias("text_sha"),
        F.size(words_in(F.col("_text"))).cast("bigint").alias("n_words"),
        *[c.alias(n) for n, c in phrase_places(F.col("_text"), phrases).items()],
    )
    found = template_matches(docs, templates, threshold, text).where("telling").groupBy("text_sha").agg(F.collect_set("label").alias("_more"), F.max("containment").alias("_best"))
    out = base.join(found, "text_sha", "left")
    every = F.array_sort(F.array_union("_base", F.coalesce("_more", F.array().cast("array<string>"))))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("_base", ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("_best", F.lit(0.0))).alias("score"),
    )


def oracle(phrases=PHRASES, templates=TEMPLATES, threshold: float = 0.8) -> str:
    """DuckDB SQL for license_scan over documents: phrases by lists of words, templates by brute force."""
    listed = lambda v: "[" + ", ".join(f"'{w}'" for w in v) + "]::VARCHAR[]"
    sets = [(label, template_words(t), reach(t), tells) for label, t, tells in templates]
    rows = ", ".join(f"('{label}', {len(ws)}, {needed(len(ws), threshold)}, {size}, {listed(ws)}, {listed(tells)})" for label, ws, size, tells in sets)
    wanted = ", ".join(f"({p.split(' ')}, '{label}')" for p, label in phrases)
    words = lambda c: f"list_filter(regexp_split_to_array(translate({c}, '{UPPER}', '{LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"
    return f"""
    WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, {words("coalesce(text, '')")} AS w FROM documents),
    phrases(p, label) AS (VALUES {wanted}),
    places AS (
        SELECT doc_id, label, unnest(list_filter(range(0, len(w) - len(p) + 1), lambda i: w[i + 1 : i + len(p)] = p)) AS pos
        FROM docs, phrases WHERE list_has_all(w, p)
    ), base AS (
        SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list_sort(list_distinct(list(label))) AS b FROM places GROUP BY 1
    ), templates(label, n, need, reach, t, tells) AS (VALUES {rows}),
    sizes AS (SELECT DISTINCT reach FROM templates),
    starts AS (SELECT doc_id, w, reach, unnest(range(0, greatest(len(w) - reach, 1), reach)) AS s FROM docs, sizes WHERE len(w) > 0),
    blocks AS (SELECT doc_id, reach, list_distinct(r) AS w, ' ' || array_to_string(r, ' ') || ' ' AS line FROM (SELECT DISTINCT doc_id, reach, w[s + 1 : s + 2 * reach] AS r FROM starts)),
    met AS (
        SELECT doc_id, label, len(list_intersect(w, t)) / n AS containment FROM blocks JOIN templates USING (reach)
        WHERE len(list_intersect(w, t)) >= need AND len(list_filter(tells, lambda r: contains(line, ' ' || r || ' '))) > 0
    ),
    more AS (SELECT doc_id, list_distinct(list(label)) AS m, max(containment) AS best FROM met GROUP BY 1)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
           array_to_string(coalesce(b, []), ',') AS base_labels,
           array_to_string(list_sort(list_distinct(list_concat(coalesce(b, []), coalesce(m, [])))), ',') AS labels,
           CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score
    FROM docs LEFT JOIN base USING (doc_id) LEFT JOIN more USING (doc_id)"""
