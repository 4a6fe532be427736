"""License scans by diagonal voting, in DataFrame operations only.

Every pair of neighbouring words of a text is hashed and joined to the places of
that pair in the license templates. A hit votes for its diagonal (place in the text
minus place in the template): a verbatim copy puts all its votes on one diagonal,
a copy with a few words put in or left out on neighbouring ones. Diagonals with
enough votes that lie within a distance of each other that grows with the template are
merged, unless one of them verifies by itself (a verbatim copy is not lost to weak
neighbours) or the two are too far apart in the text to be one copy; a span is verified
if it is no longer than the template allows and covers enough of its word pairs.
Base phrases are short templates of their own and have to be covered completely.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventide.llm.common import pick, read

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Fixed phrases and labels: each consecutive place counts.
BASE = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))
#: Notices, grants and warranty passages of common licenses as words, and their labels.
NOTICES = (
    ("apache", "licensed under the apache license version"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is "
               "distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
            "associated documentation files"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial "
            "portions of the software"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited "
            "to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted "
            "provided that the following conditions are met"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the "
            "following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
            "products derived from this software without specific prior written permission"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
            "granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("gpl-notice", "licensed under the gnu general public license version"),
    ("gpl-notice", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "licensed under the gnu lesser general public license version"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "licensed under the gnu affero general public license version"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("cc-by-4", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("mpl", "subject to the terms of the mozilla public license"),
    ("epl", "made available under the terms of the eclipse public license"),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications "
             "and to alter it and redistribute it freely subject to the following restrictions"),
    ("boost", "distributed under the boost software license version"),
)
#: Diagonals this close are merged, or this share of the template's pairs; one needs this share of
#: the pairs to be merged, a span this share to be verified.
SLACK, SLACK_SHARE, DIAGONAL_SHARE, SPAN_SHARE = 2, 0.1, 0.15, 0.75
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def templates(base=BASE, notices=NOTICES) -> list[tuple]:
    """One row per word pair of each template: number, label, base, pairs of the template, place, pair."""
    rows = []
    for number, (label, text, is_base) in enumerate([(a, b, True) for a, b in base] + [(a, b, False) for a, b in notices]):
        words = text.split()
        if len(words) < 2:
            raise ValueError(f"a template needs two words: {text!r}")
        rows += [(number, label, is_base, len(words) - 1, i, f"{words[i]} {words[i + 1]}") for i in range(len(words) - 1)]
    return rows


def _values(base, notices) -> str:
    return ", ".join(f"({n}, '{label}', {str(b).lower()}, {p}, {i}, '{pair}')" for n, label, b, p, i, pair in templates(base, notices))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base=BASE, notices=NOTICES,
         with_spans: bool = False) -> DataFrame:
    """Licenses named or quoted in every whole text.

    One row per input row: ``doc_id``, ``n_words``, ``n_base`` (places of base
    phrases), ``first_word`` and ``last_word`` (their smallest and largest start,
    null if none), ``base_labels``, ``labels`` (both kinds; distinct, sorted, joined by
    commas, empty if none), ``score`` (largest share of a template's word pairs in
    a merged span, 1 for a base place, 0 if nothing was voted for) and, with
    ``with_spans``, ``spans`` (label, start, end, share). Null and empty texts have
    no words; repeated rows and null ids stay; other columns are not read.

    The templates are broadcast: their size is fixed by the list. Only hits and
    one row per document are shuffled, once, by document row.
    """
    spark = docs.sparkSession
    places = spark.sql("SELECT *, xxhash64(known) AS hash FROM VALUES " + _values(base, notices)
                       + " AS t(template, label, is_base, pairs, place, known)")
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), _UPPER, _LOWER)
    words = pick(docs, doc_id=id_col, text=text_col).select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)).alias("words"))
    counted = words.withColumn("n_words", F.size("words").cast("bigint"))
    pairs = F.when(F.col("n_words") >= 2, F.expr(
        "transform(sequence(0, size(words) - 2), i -> concat_ws(' ', words[i], words[i + 1]))")).otherwise(F.expr("cast(array() as array<string>)"))
    # the null in front keeps a row for documents without a hit
    each = counted.select("row", "doc_id", "n_words", F.posexplode(F.concat(F.array(F.lit(None).cast("string")), pairs)).alias("at", "pair"))
    met = each.withColumn("hash", F.xxhash64("pair")).join(F.broadcast(places), "hash", "left").where(
        F.col("pair").isNull() | (F.col("pair") == F.col("known")))
    hits = met.select("row", "doc_id", "n_words", "template", "label", "is_base", "pairs", "place",
                      (F.col("at") - 1).cast("bigint").alias("at")).repartition("row")

    voted = hits.groupBy("row", "doc_id", "n_words", "template", "label", "is_base", "pairs",
                         (F.col("at") - F.col("place")).alias("diagonal")).agg(
        F.collect_set("place").alias("covered"), F.min("at").alias("start"), F.max(F.col("at") + 2).alias("end"))
    votes = F.size("covered")
    enough = voted.where(F.col("template").isNull() | F.when(F.col("is_base"), votes == F.col("pairs")).otherwise(
        votes >= F.greatest(F.lit(1.0), F.col("pairs") * DIAGONAL_SHARE)))
    order = W.partitionBy("row", "template").orderBy("diagonal")
    slack = F.greatest(F.lit(SLACK), F.floor(F.col("pairs") * SLACK_SHARE))
    longest = F.col("pairs") + 1 + 2 * slack
    alone = votes >= F.col("pairs") * SPAN_SHARE
    reach = F.greatest("end", F.lag("end").over(order)) - F.least("start", F.lag("start").over(order))
    apart = (F.col("is_base") | alone | F.lag(alone).over(order)
             | (F.col("diagonal") - F.lag("diagonal").over(order) > slack) | (reach > longest))
    merged = (enough.withColumn("new", F.coalesce(apart, F.lit(True)).cast("int"))
              .withColumn("span", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
              .groupBy("row", "doc_id", "n_words", "template", "label", "is_base", "pairs", "span").agg(
                  F.size(F.array_distinct(F.flatten(F.collect_list("covered")))).alias("votes"),
                  F.min("start").alias("start"), F.max("end").alias("end")))
    share = F.col("votes") / F.col("pairs")
    fits = F.col("end") - F.col("start") <= longest
    found = merged.withColumn("share", share).withColumn("kept", F.coalesce(fits & (F.col("share") >= SPAN_SHARE), F.lit(False)))
    base_place = F.coalesce(F.col("is_base"), F.lit(False))
    columns = [
        F.count(F.when(base_place, 1)).alias("n_base"), F.min(F.when(base_place, F.col("start"))).alias("first_word"),
        F.max(F.when(base_place, F.col("start"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base_place, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("kept"), F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max(F.when(fits, F.col("share"))), F.lit(0.0)).alias("score"),
    ]
    if with_spans:
        span = F.struct("start", "end", "label", "share")
        columns.append(F.array_sort(F.collect_list(F.when(F.col("kept"), span))).alias("spans"))
    return found.groupBy("row", "doc_id", "n_words").agg(*columns).drop("row")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))


def oracle_sql(base=BASE, notices=NOTICES) -> str:
    """The scan for DuckDB: base places straight from the word lists, spans from the votes."""
    values = _values(base, notices)
    at_base = " UNION ALL ".join(
        f"SELECT r, '{label}' AS label, i AS pos FROM each WHERE " + " AND ".join(
            f"words[i + {k + 1}] = '{w}'" for k, w in enumerate(phrase.split())) for label, phrase in base)
    return f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{WORD}') AS words
  FROM documents),
each AS (SELECT r, words, unnest(range(len(words))) AS i FROM docs),
base AS ({at_base}),
known(template, label, is_base, pairs, place, pair) AS (VALUES {values}),
hits AS (
  SELECT r, template, label, pairs, place, i AS pos FROM each JOIN known
  ON pair = words[i + 1] || ' ' || words[i + 2] WHERE NOT is_base),
voted AS (
  SELECT r, template, label, pairs, pos - place AS diagonal, list(DISTINCT place) AS covered, min(pos) AS s, max(pos + 2) AS e,
         len(list(DISTINCT place)) >= pairs * {SPAN_SHARE} AS alone,
         pairs + 1 + 2 * greatest({SLACK}, CAST(floor(pairs * {SLACK_SHARE}) AS BIGINT)) AS longest
  FROM hits GROUP BY r, template, label, pairs, pos - place HAVING len(list(DISTINCT place)) >= greatest(1.0, pairs * {DIAGONAL_SHARE})),
marked AS (
  SELECT *, CASE WHEN NOT alone AND NOT lag(alone) OVER o AND diagonal - lag(diagonal) OVER o <= greatest({SLACK}, floor(pairs * {SLACK_SHARE}))
                      AND greatest(e, lag(e) OVER o) - least(s, lag(s) OVER o) <= longest THEN 0 ELSE 1 END AS new
  FROM voted WINDOW o AS (PARTITION BY r, template ORDER BY diagonal)),
grouped AS (SELECT *, sum(new) OVER (PARTITION BY r, template ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS span FROM marked),
spans AS (
  SELECT r, label, len(list_distinct(flatten(list(covered)))) / pairs AS share, max(e) - min(s) <= longest AS fits
  FROM grouped GROUP BY r, template, label, pairs, longest, span),
places AS (
  SELECT r, count(*) AS n, min(pos) AS lo, max(pos) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM base GROUP BY r),
named AS (
  SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (
    SELECT r, label FROM base UNION ALL SELECT r, label FROM spans WHERE fits AND share >= {SPAN_SHARE}) GROUP BY r),
best AS (SELECT r, max(share) AS score FROM spans WHERE fits GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(lo AS BIGINT) AS first_word,
       CAST(hi AS BIGINT) AS last_word, coalesce(places.labels, '') AS base_labels, coalesce(named.labels, '') AS labels,
       CAST(CASE WHEN n > 0 THEN greatest(1.0, coalesce(score, 0)) ELSE coalesce(score, 0) END AS DOUBLE) AS score
FROM docs LEFT JOIN places USING (r) LEFT JOIN named USING (r) LEFT JOIN best USING (r)"""
