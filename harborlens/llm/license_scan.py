"""License notices by an exact set-similarity join of text blocks with notice templates."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborlens.llm.common import ascii_folded, checkpointed

#: Phrases whose places are counted: (label, words).
PHRASES = (
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
)
#: Notices: (label, words, words that a block must hold, words that it may not hold). A block that holds most words of one gets its label.
TEMPLATES = (
    ("gpl", "licensed under the gnu general public license version", "gnu general", "lesser affero"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license", "gnu general", "lesser affero"),
    ("lgpl", "gnu lesser general public license as published by the free software foundation", "lesser general", ""),
    ("mit", "released under the mit license", "mit", ""),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "granted charge", ""),
    ("apache", "licensed under the apache license version 2 0", "apache", ""),
    ("cc-by", "licensed under cc by 4 0", "cc by", ""),
    ("cc-by", "creative commons attribution 4 0 international license", "commons attribution", ""),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution", ""),
    ("mpl", "this source code form is subject to the terms of the mozilla public license", "mozilla", ""),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "fee", ""),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered", ""),
)
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_folded(text), F.lit(f"({WORD})"), F.lit(1))


def _array(values: Sequence[str | int]) -> Column:
    return F.array(*(F.lit(v) for v in values))


def license_scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    phrases: Sequence[tuple[str, str]] = PHRASES,
    templates: Sequence[tuple[str, str, str, str]] = TEMPLATES,
    threshold: float = 0.8,
    stride: int = 32,
) -> DataFrame:
    """One row per input row: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    A text is cut into blocks of ``2 * stride`` words that start every ``stride`` words,
    so that any passage of up to ``stride + 1`` words lies in a block. A block meets a template when
    it holds at least ``threshold`` of the template's distinct words, those among them by which the license is told
    from others, and no word that speaks for another; a phrase must be
    held whole, and its places (all its words one after another) are then counted.

    The join is exact. Words of the templates are ordered by the number of documents that
    hold them, rarest first, counted over all rows. A pair can only match if one of the
    template's first ``|T| - need + 1`` words is in the block, where ``need`` is the least
    overlap; blocks are made only around such words, met by an equality join on the word
    (the template side has a row for each template word, so it is broadcast), thinned
    by block length and by the positions of the first shared word, and verified. Words
    of no template can't be shared, so a text is cut into words once, and only the places of
    template words are kept (in the checkpoint folder, a number each); all else works on these.

    Null or empty texts have no words, no labels and score 0. ``score`` is the largest
    share of a template's words that an accepted block holds (1 for a phrase). Repeated
    rows are scanned by themselves; other columns are ignored. An empty table gives no rows.
    """
    wanted = [(label, t.split(" "), 1.0, True, [], []) for label, t in phrases]
    wanted += [(label, t.split(" "), threshold, False, must.split(), never.split()) for label, t, must, never in templates]
    if any(len(x[1]) > stride + 1 for x in wanted):
        raise ValueError("a phrase or template is longer than a block can hold at any place")
    vocabulary = sorted({w for x in wanted for w in (*x[1], *x[4], *x[5])})
    code, base = {w: i for i, w in enumerate(vocabulary)}, len(vocabulary)

    # A mark is a template word at a place: place * base + the word's number.
    spelled = docs.select(F.col(id_col).alias("_id"), _words(F.coalesce(F.col(text_col), F.lit(""))).alias("_words"))
    mark = lambda w, i: F.when(w.isin(vocabulary), i.cast("long") * base + F.array_position(_array(vocabulary), w) - 1)
    rows = checkpointed(
        spelled.select(
            F.monotonically_increasing_id().alias("_row"), "_id", F.size("_words").cast("long").alias("n_words"),
            F.array_compact(F.transform("_words", mark)).alias("_marks"),
        )
    )
    word, place = (lambda m: (m % base).cast("int")), (lambda m: F.floor(m / base).cast("long"))
    counted = rows.select(F.explode(F.array_distinct(F.transform("_marks", word))).alias("_w")).groupBy("_w").count()
    frequency = {vocabulary[r["_w"]]: r["count"] for r in counted.collect()}  # a row for each template word at most
    order = sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}

    index = []
    for number, (label, words, least, exact, must, never) in enumerate(wanted):
        ordered = sorted(set(words), key=rank.__getitem__)
        need = max(1, math.ceil(least * len(ordered) - 1e-9))
        codes = [[code[w] for w in ws] for ws in (ordered, must, never)]
        for at, w in enumerate(ordered[: len(ordered) - need + 1]):
            index.append((code[w], number, label, [code[x] for x in words] if exact else None, *codes, at, need))
    prefix = docs.sparkSession.createDataFrame(
        index, "_token int, _template int, _label string, _phrase array<int>, _tokens array<int>, _must array<int>, _never array<int>, _place int, _need int"
    )
    first_words = sorted({x[0] for x in index})

    # Of each first word, the blocks that hold it and none before it, with its number among the marks.
    firsts = F.filter(
        F.transform("_marks", lambda m, j: F.struct(place(m).alias("p"), word(m).alias("w"), j.alias("j"))), lambda f: f["w"].isin(first_words)
    )
    before = lambda i: F.coalesce(F.get("_firsts", i - 1)["p"], F.lit(-1))
    blocks = F.flatten(
        F.transform(
            "_firsts",
            lambda f, i: F.transform(
                F.filter(
                    F.array(F.floor(f["p"] / stride) - 1, F.floor(f["p"] / stride)), lambda k: (k >= 0) & ((i == 0) | (before(i) < k * stride))
                ),
                lambda k: F.struct(k.alias("k"), f["j"].alias("j")),
            ),
        )
    )
    # A block has 2 * stride places, so its marks are near that one.
    near = F.slice("_marks", F.greatest(F.col("_b.j") - 2 * stride, F.lit(0)) + 1, F.lit(4 * stride + 1))
    inside = F.filter(near, lambda m: (place(m) >= F.col("_b.k") * stride) & (place(m) < (F.col("_b.k") + 2) * stride))
    block = (
        rows.withColumn("_firsts", firsts)
        .select("_row", "_id", "n_words", F.when(F.size("_firsts") > 0, F.col("_marks")).alias("_marks"), F.explode_outer(blocks).alias("_b"))
        .select("_row", "_id", "n_words", F.col("_b.k").alias("_k"), inside.alias("_block"))
        .withColumn("_held", F.array_intersect(_array([code[w] for w in order]), F.transform("_block", word)))
    )
    pairs = block.select("*", F.posexplode_outer("_held").alias("_at", "_token")).join(F.broadcast(prefix), "_token", "left")
    shared = F.array_intersect("_tokens", F.col("_held"))
    fits = (
        (F.size("_held") >= F.col("_need"))
        & (F.least(F.size("_tokens") - F.col("_place"), F.size("_held") - F.col("_at")) >= F.col("_need"))
        & (F.size(shared) >= F.col("_need"))
        & (F.get(shared, F.lit(0)) == F.col("_token"))  # a pair is taken at its first shared word only
        & (F.size(F.array_except("_must", "_held")) == 0)
        & ~F.arrays_overlap("_never", "_held")
    )
    met = F.coalesce(fits, F.lit(False))
    whole = lambda m: F.forall(  # noqa: E731  the phrase's words stand here one after another
        F.transform("_phrase", lambda w, i: F.array_contains("_block", (place(m) + i) * base + w)), lambda held: held
    )
    places = F.when(
        met & F.col("_phrase").isNotNull(),
        F.transform(F.filter("_block", lambda m: (place(m) < (F.col("_k") + 1) * stride) & (word(m) == F.get("_phrase", F.lit(0))) & whole(m)), place),
    )
    found = pairs.withColumns({"_met": met, "_places": places}).withColumns(
        {
            "_base": F.when(F.size("_places") > 0, F.col("_label")),
            "_own": F.when(F.col("_met") & F.col("_phrase").isNull(), F.col("_label")),
            "_share": F.when(F.size("_places") > 0, 1.0).when(F.col("_met") & F.col("_phrase").isNull(), F.size(shared) / F.size("_tokens")),
        }
    )
    per_row = found.groupBy("_row", "_id", "n_words").agg(
        F.sum(F.when(F.col("_base").isNotNull(), F.size("_places")).otherwise(0)).cast("long").alias("n_base"),
        F.min(F.array_min("_places")).alias("first_word"),
        F.max(F.array_max("_places")).alias("last_word"),
        F.collect_set("_base").alias("_bases"),
        F.collect_set("_own").alias("_owns"),
        F.coalesce(F.max("_share"), F.lit(0.0)).alias("score"),
    )
    return per_row.select(
        F.col("_id").alias(id_col), "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("_bases"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("_bases", "_owns")), ",").alias("labels"),
        "score",
    )


def brute_force_sql(
    phrases: Sequence[tuple[str, str]] = PHRASES, templates: Sequence[tuple[str, str, str, str]] = TEMPLATES, threshold: float = 0.8, stride: int = 32
) -> str:
    """DuckDB SQL for ``license_scan`` over ``documents``: every block against every template."""
    listed = ", ".join(f"('{label}', string_split('{words}', ' '))" for label, words in phrases)
    listing = lambda words: f"list_distinct(string_split('{words}', ' '))" if words else "[]::varchar[]"
    given = ", ".join(f"('{label}', {listing(words)}, {listing(must)}, {listing(never)})" for label, words, must, never in templates)
    return f"""
        with phrases(label, words) as (values {listed}), templates(label, words, must, never) as (values {given}),
        docs as (
            select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '{WORD}') as words from documents),
        starts as (select doc_id, words as ws, unnest(range(len(words))) as p from docs),
        places as (select doc_id, label, p from starts, phrases f where ws[p + 1] = f.words[1] and ws[p + 1 : p + len(f.words)] = f.words),
        base as (
            select doc_id, count(*) as n_base, min(p) as first_word, max(p) as last_word, list(distinct label) as bases from places group by doc_id),
        blocks as (
            select doc_id, words[k * {stride} + 1 : k * {stride} + {2 * stride}] as block
            from (select doc_id, words, unnest(range((len(words) + {stride - 1}) // {stride})) as k from docs)),
        shares as (
            select doc_id, label, len(list_intersect(t.words, block)) / len(t.words) as share, ceil({threshold} * len(t.words) - 1e-9) as need,
                len(list_intersect(t.words, block)) as held from blocks, templates t
            where list_has_all(block, t.must) and not list_has_any(block, t.never)),
        own as (select doc_id, list(distinct label) as owns, max(share) as share from shares where held >= need group by doc_id)
        select d.doc_id, len(d.words)::bigint as n_words, coalesce(n_base, 0) as n_base, first_word, last_word,
            array_to_string(list_sort(coalesce(bases, [])), ',') as base_labels,
            array_to_string(list_sort(list_distinct(list_concat(coalesce(bases, []), coalesce(owns, [])))), ',') as labels,
            case when n_base > 0 then 1.0::double else coalesce(share, 0.0)::double end as score
        from docs d left join base using (doc_id) left join own using (doc_id)"""
