"""Operator 6, licence scans, by a positional rare-token index, with DataFrame functions only.

Every template has mandatory key phrases. The corpus gives each of their words an inverse document frequency; the
rarest words of a key phrase are looked up in a file first. A word found at i that stands at p in the template is a
posting for a start at i - p; the postings of a template's rare words are intersected, so only places where they
stand at the right relative positions are left, and there the whole key phrase, version included, is verified word by
word. A notice is labelled only where enough of its other words agree, too.

Only the words of templates are counted over the corpus, so what comes to the driver is bounded by the templates.

Defined results: a null or empty text has no words, no labels, score 0 and null places; null ids, repeated rows and
extra columns pass through; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, table

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Base phrases by label, then notices as (label, words, start of the key phrase, its length).
BASE = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}
NOTICES = (
    ("apache-2.0", "licensed under the apache license version 2 0", 3, 5),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", 0, 8),
    ("cc-by-nc", "licensed under cc by nc 4 0", 2, 5),
    ("cc-by-sa", "licensed under cc by sa 4 0", 2, 5),
    ("cc0", "cc0 1 0 universal public domain dedication", 0, 4),
    ("gpl-notice", "this work is licensed under the gnu general public license version 3", 6, 6),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", 0, 5),
    ("mit", "released under the mit license", 1, 4),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software", 0, 6),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", 11, 6),
)
#: A notice is labelled where at least this share of its words stand in their places, its key phrase among them.
MIN_SHARE = 0.5
#: So many rare words of a key phrase are intersected before it is verified.
RARE = 3


def templates() -> list[tuple[str, list[str], int, int]]:
    return [(label, phrase.split(), 0, len(phrase.split())) for label, phrase in BASE.items()] + [(label, words.split(), start, n) for label, words, start, n in NOTICES]


def file_words(text: Column) -> Column:
    """The words of a text; its first and last separators make no empty words. Only A-Z differ between lower() and the rule in words that templates hold."""
    w = F.split(F.lower(text), NOT_WORD)
    return F.filter(w, lambda x: x != "")


def inverse_frequencies(df: DataFrame, words_col: str, vocabulary: list[str]) -> dict[str, float]:
    """For each word of the vocabulary log((1 + documents) / (1 + documents with it)), counted over all of df."""
    known = F.array(*map(F.lit, vocabulary))
    held = df.select(F.array_intersect(words_col, known).alias("w"))
    rows = held.select(F.explode(F.concat("w", F.array(F.lit(""))) ).alias("w")).groupBy("w").count().collect()  # a row for each word at most, and the total
    n = {r["w"]: r["count"] for r in rows}
    return {w: math.log((1 + n.get("", 0)) / (1 + n.get(w, 0))) for w in vocabulary}


def starts(words: Column, hits: Column, template: list[str], key: int, n: int, idf: dict[str, float]) -> Column:
    """Where the template starts: postings of the key phrase's rarest words intersected, then the phrase verified. hits: (w, i) of the words in the index."""
    rare = sorted(range(key, key + n), key=lambda p: (-idf[template[p]], p))[:RARE]

    def postings(p: int) -> Column:
        return F.transform(F.filter(hits, lambda h: h["w"] == template[p]), lambda h: h["i"] - p)

    found = reduce(F.array_intersect, map(postings, rare))
    return F.filter(found, lambda s: reduce(lambda a, b: a & b, (F.coalesce(F.get(words, s + p) == template[p], F.lit(False)) for p in range(key, key + n))))


def agreement(words: Column, at: Column, template: list[str]) -> Column:
    """For each start the share of the template's words that stand in their places."""
    def share(s: Column) -> Column:
        same = [F.when(s + p >= 0, F.get(words, s + p)) == x for p, x in enumerate(template)]
        return reduce(lambda a, b: a + b, (F.coalesce(x.cast("int"), F.lit(0)) for x in same)) / F.lit(float(len(template)))

    return F.transform(at, share)


def alike(words: Column, at: Column, template: list[str]) -> Column:
    """The starts where enough of the template's words agree."""
    near = F.zip_with(at, agreement(words, at, template), lambda s, share: F.struct(s.alias("s"), share.alias("share")))
    return F.transform(F.filter(near, lambda x: x["share"] >= MIN_SHARE), lambda x: x["s"])


def scan(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_words, n_base, first_word, last_word, base_labels, labels, score; columns of df with these names are replaced."""
    found = templates()
    vocabulary = sorted({w for _, t, k, n in found for w in t[k : k + n]})
    added = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    df, held = packed(df, text_col, added)
    df = df.withColumn("_words", file_words(F.col("_text")))
    idf = inverse_frequencies(df, "_words", vocabulary)
    anchors = sorted({t[p] for _, t, k, n in found for p in sorted(range(k, k + n), key=lambda p: (-idf[t[p]], p))[:RARE]})
    w = F.col("_words")
    at = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.get(w, i).isin(anchors))
    df = df.withColumn("_hits", F.when(F.arrays_overlap(w, F.array(*map(F.lit, anchors))), F.transform(at, lambda i: F.struct(F.get(w, i).alias("w"), i.alias("i")))))
    hits = F.col("_hits")
    names = []
    for label, t, k, n in found:
        df = df.withColumn(name := f"_at_{len(names)}", F.when(hits.isNull(), F.array().cast("array<int>")).otherwise(starts(w, hits, t, k, n, idf) if label in BASE else alike(w, starts(w, hits, t, k, n, idf), t)))
        names.append(name)
    base = names[: len(BASE)]
    df = df.withColumn("_base", F.concat(*base))
    share = [F.coalesce(F.array_max(agreement(w, F.col(a), t)), F.lit(0.0)) for a, (_, t, _, _) in zip(names, found, strict=True)]
    by_label = sorted(zip([x[0] for x in found], names, strict=True))
    df = df.withColumns({
        "n_words": F.size(w).cast("long"),
        "n_base": F.size("_base").cast("long"),
        "first_word": F.array_min("_base").cast("long"),
        "last_word": F.array_max("_base").cast("long"),
        "base_labels": F.concat_ws(",", *[F.when(F.size(a) > 0, F.lit(x)) for x, a in by_label if x in BASE]),
        "labels": F.concat_ws(",", *[F.when(F.size(a) > 0, F.lit(x)) for x, a in by_label]),
        "score": F.greatest(*share).cast("double"),
    })
    return df.select(*held, *added)


def op6_license_scans(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def sql() -> str:
    """DuckDB's form: each word of a file that a template holds is a vote for a start, and starts with the whole key phrase count."""
    words = ", ".join(f"('{label}', {p}, '{x}', {str(k <= p < k + n).lower()})" for label, t, k, n in templates() for p, x in enumerate(t))
    kinds = ", ".join(f"('{label}', {len(t)}, {n}, {str(label in BASE).lower()})" for label, t, _, n in templates())
    return rf"""
with t(label, p, word, in_key) as (values {words}),
k(label, n, n_key, base) as (values {kinds}),
d as (
  select row_number() over () as row, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents),
w as (select row, unnest(w) as word, generate_subscripts(w, 1) - 1 as i from d),
votes as (select row, label, i - p as s, count(*) as same, count(*) filter (in_key) as keyed from w join t using (word) group by all),
found as (select row, label, base, s, same / n as share from votes join k using (label) where keyed = n_key and same >= {MIN_SHARE} * n),
scored as (select row, max(same / n) as score from votes join k using (label) where keyed = n_key group by row),
of_row as (
  select row, count(*) filter (base) as n_base, min(s) filter (base) as first_word, max(s) filter (base) as last_word,
    string_agg(distinct label, ',' order by label) filter (base) as base_labels, string_agg(distinct label, ',' order by label) as labels
  from found group by row)
select doc_id, len(w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
  coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0)::double as score
from d left join of_row using (row) left join scored using (row)
"""
