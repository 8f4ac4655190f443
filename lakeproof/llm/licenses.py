"""License scans by diagonal voting, in DataFrame functions only.

All rolling 3-grams of a text's words are hashed and joined with the positions of the same grams in license templates. A
gram at word p of the text and word q of a template votes for the diagonal p - q. Votes are combined per diagonal as bit
sets of the template's words, ``PART`` words each, so templates may be of any length, whole license texts too. Diagonals a few words apart are
merged (words were put in or left out), and a merged span is verified: a fixed phrase must stand there whole, and of a template
the words covered by grams must be a share of ``COVERED`` of its words and of the words by which the span is shifted.

The words of a text are never shuffled, and neither is a gram without a match: the join is a broadcast join, as the
templates are few (``MAX_GRAMS``, checked; with more of them it is left to Spark, which may shuffle). Grams are compared as words after the hashes. Each text also sends one
header row with its number of words, so all of it is one pass over the texts.

Defined cases: NULL texts count as empty, texts without words have no place and score 0; rows that are equal in id and text
are counted and returned as often as they came; rows under one id with other texts are apart; labels are the empty
string when there are none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeproof.llm.common import quoted, text_of

GRAM = 3
#: Words of a template that are the bits of one long.
PART = 62
#: The join with the templates is a broadcast join up to so many grams.
MAX_GRAMS = 200_000
#: Diagonals that are at most so many words apart belong to one span.
GAP = 3
COVERED = 0.75
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

# Phrases and their labels. A place of one is where its words stand consecutively.
PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
# Opening sentences of common licenses, in normalised words.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0", "no rights reserved this work is dedicated to the public domain under cc0 1 0 universal"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), NO_WORD), "")


def _gram(words: Column, at: Column) -> list[Column]:
    return [F.get(words, at + j) for j in range(GRAM)]


def template_grams(spark: SparkSession, phrases=PHRASES, templates=TEMPLATES, max_grams: int = MAX_GRAMS) -> DataFrame:
    """(template, label, base, words, part, bits, t, h, g0, g1, g2), to be broadcast if few: a row per gram and part of its words.

    ``bits`` are the gram's words in the part. Templates are cut into their words here, so a row of input is a template.
    """
    rows = []
    for number, (label, text, base) in enumerate([(a, b, True) for a, b in phrases] + [(a, b, False) for a, b in templates]):
        count = len(text.split())
        if count < GRAM:
            raise ValueError(f"a template has at least {GRAM} words: {text}")
        rows.append((number, label, base, count, " ".join(text.split())))
    listed = spark.createDataFrame(rows, "template int, label string, base boolean, words int, text string")
    listed = listed.withColumn("w", F.split("text", " "))
    listed = listed.select("template", "label", "base", "words", "w", F.explode(F.sequence(F.lit(0), F.col("words") - GRAM)).alias("t"))
    grams = listed.select("template", "label", "base", "words", "t", *[c.alias(f"g{j}") for j, c in enumerate(_gram(F.col("w"), F.col("t")))])
    word = F.explode(F.sequence(F.col("t"), F.col("t") + GRAM - 1))
    grams = grams.select("*", word.alias("word")).withColumn("part", F.expr(f"word div {PART}").cast("int"))
    grams = grams.groupBy("template", "label", "base", "words", "part", "t", *[f"g{j}" for j in range(GRAM)]).agg(F.expr(f"bit_or(shiftleft(1L, word % {PART}))").alias("bits"))
    header = spark.range(1).select(
        F.lit(-1).alias("template"), F.lit("").alias("label"), F.lit(False).alias("base"), F.lit(0).alias("words"), F.lit(0).alias("part"), F.lit(0).alias("t"),
        F.lit("").alias("g0"), *[F.lit(None).cast("string").alias(f"g{j}") for j in range(1, GRAM)], F.lit(0).cast("bigint").alias("bits"),
    )
    every = grams.unionByName(header).withColumn("h", F.xxhash64(*[f"g{j}" for j in range(GRAM)]))
    return F.broadcast(every) if 2 * sum(r[3] for r in rows) <= max_grams else every


def votes(docs: DataFrame, id_col: str, text_col: str, grams: DataFrame) -> DataFrame:
    """(doc_id, th, template, label, base, words, diagonal, part, mask, n). Template -1 is a text's header: its diagonal is the
    number of words, and n how often the text came."""
    text = text_of(text_col)
    # the empty string after the last word is the header's gram
    listed = docs.select(
        quoted(id_col).alias("doc_id"), F.xxhash64(text).alias("th"), F.array_append(words_of(text), F.lit("")).alias("w")
    )
    placed = listed.select("doc_id", "th", "w", F.posexplode("w").alias("p", "w0"))
    rolled = placed.select("doc_id", "th", "p", *[c.alias(f"w{j}") for j, c in enumerate(_gram(F.col("w"), F.col("p")))])
    rolled = rolled.select("*", F.xxhash64(*[f"w{j}" for j in range(GRAM)]).alias("h"))
    joined = rolled.join(grams, "h")
    for j in range(GRAM):
        joined = joined.filter(F.col(f"w{j}").eqNullSafe(F.col(f"g{j}")))
    return joined.groupBy("doc_id", "th", "template", "label", "base", "words", (F.col("p") - F.col("t")).alias("diagonal"), "part").agg(
        F.bit_or("bits").alias("mask"), F.count("*").alias("n")
    )


def _join(names: Column) -> Column:
    return F.array_join(F.array_sort(names), ",")


def report(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, templates=TEMPLATES, max_grams: int = MAX_GRAMS
) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_spans), one row per row of ``docs``.

    ``n_base`` and the two words count places of the fixed phrases, ``n_spans`` the verified spans of templates. The score
    is the greatest share of a template; a phrase counts 1.
    """
    every = votes(docs, id_col, text_col, template_grams(docs.sparkSession, phrases, templates, max_grams))
    key = ["doc_id", "th"]
    along = Window.partitionBy(*key, "template").orderBy("diagonal")
    # phrases must stand without a gap, so each of their diagonals is by itself
    step = F.col("diagonal") - F.lag("diagonal").over(along)
    apart = F.coalesce((step > GAP) | (F.col("base") & (step > 0)) | (F.col("template") < 0), F.lit(True))
    spans = every.withColumn("apart", apart.cast("int")).withColumn("span", F.sum("apart").over(along))
    spans = spans.groupBy(*key, "template", "label", "base", "words", "span", "part").agg(
        F.bit_or("mask").alias("mask"), F.min("diagonal").alias("diagonal"), F.max("diagonal").alias("to"), F.max("n").alias("n")
    )
    spans = spans.groupBy(*key, "template", "label", "base", "words", "span").agg(
        F.sum(F.bit_count("mask")).alias("covered"), F.min("diagonal").alias("diagonal"), F.max("to").alias("to"), F.max("n").alias("n")
    )
    spans = spans.withColumn("share", F.when(F.col("template") >= 0, F.col("covered") / (F.col("words") + F.col("to") - F.col("diagonal"))))
    head, place = F.col("template") < 0, F.col("base") & (F.col("share") == 1)
    # part of a phrase is no evidence
    verified = place | (~F.col("base") & ~head & (F.col("share") >= COVERED))
    found = spans.groupBy(*key).agg(
        F.max(F.when(head, F.col("diagonal"))).cast("bigint").alias("n_words"),
        F.max(F.when(head, F.col("n"))).alias("copies"),
        F.count_if(place).alias("n_base"),
        F.min(F.when(place, F.col("diagonal"))).cast("bigint").alias("first_word"),
        F.max(F.when(place, F.col("diagonal"))).cast("bigint").alias("last_word"),
        _join(F.collect_set(F.when(place, F.col("label")))).alias("base_labels"),
        _join(F.collect_set(F.when(verified, F.col("label")))).alias("labels"),
        F.coalesce(F.max(F.when(~head & (~F.col("base") | place), F.col("share"))), F.lit(0.0)).alias("score"),
        F.count_if(verified & ~F.col("base")).alias("n_spans"),
    )
    copies = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return copies.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_spans")


def _sql_words(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


_VALUES = ", ".join(
    f"({k}, '{label}', {base}, '{text}')"
    for k, (label, text, base) in enumerate([(a, b, "true") for a, b in PHRASES] + [(a, b, "false") for a, b in TEMPLATES])
)
SQL = f"""
WITH doc AS (SELECT doc_id, {_sql_words("text")} AS w FROM documents),
template AS (SELECT k, label, base, string_split(words, ' ') AS tw FROM (VALUES {_VALUES}) AS v(k, label, base, words)),
gram AS (SELECT k, label, base, len(tw) AS words, t - 1 AS t, array_to_string(tw[t : t + 2], ' ') AS g
         FROM (SELECT *, unnest(range(1, len(tw) - 1)) AS t FROM template)),
place AS (SELECT doc_id, p - 1 AS p, array_to_string(w[p : p + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM doc)),
vote AS (SELECT DISTINCT doc_id, k, label, base, words, p - t AS d, unnest([t, t + 1, t + 2]) AS t FROM place JOIN gram USING (g)),
diagonal AS (SELECT doc_id, k, label, base, words, d, list(t) AS ts FROM vote GROUP BY ALL),
cut AS (SELECT *, CASE WHEN base OR d - lag(d) OVER (PARTITION BY doc_id, k ORDER BY d) <= {GAP} IS NOT TRUE THEN 1 ELSE 0 END AS apart FROM diagonal),
numbered AS (SELECT *, sum(apart) OVER (PARTITION BY doc_id, k ORDER BY d) AS span FROM cut),
span AS (
  SELECT doc_id, k, label, base, min(d) AS d, len(list_distinct(flatten(list(ts)))) / (any_value(words) + max(d) - min(d)) AS share
  FROM numbered GROUP BY doc_id, k, label, base, span
),
judged AS (SELECT *, base AND share = 1 AS whole, CASE WHEN base THEN share = 1 ELSE share >= {COVERED} END AS good FROM span),
found AS (
  SELECT doc_id, count(*) FILTER (whole) AS n_base, min(d) FILTER (whole) AS first_word, max(d) FILTER (whole) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (whole) AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (good) AS labels,
    max(share) FILTER (whole OR NOT base) AS score, count(*) FILTER (good AND NOT base) AS n_spans
  FROM judged GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score, coalesce(n_spans, 0) AS n_spans
FROM doc LEFT JOIN found USING (doc_id)
"""
