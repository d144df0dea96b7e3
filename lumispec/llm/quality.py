"""Operator 8, quality rules, by line-first cleaning, with DataFrame functions only.

Each line is judged by itself (punctuation, navigation, boilerplate); failing lines go; a document that loses
too large a share of its text goes as a whole. Nothing is shuffled: a document is one row from scan to result.

Defined results: a null or blank text has no words, fails the base rule and is not kept; null ids, repeated rows and
extra columns pass through; an empty table gives an empty table. Three-word windows are compared by 64-bit hashes.
Texts and lines of any length are judged whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, SPACE_CHARS, packed, where_computed, words

# Phrases of navigation and of boilerplate, lower case, in English, German, French and Spanish.
NAVIGATION = (
    "home", "menu", "log in", "login", "sign in", "sign up", "register", "next page", "previous page", "back to top", "read more", "skip to content", "sitemap", "share this",
    "startseite", "menü", "anmelden", "registrieren", "nächste seite", "vorherige seite", "nach oben", "weiterlesen", "zum inhalt springen",
    "accueil", "connexion", "se connecter", "s'inscrire", "page suivante", "page précédente", "haut de page", "lire la suite", "aller au contenu",
    "inicio", "menú", "iniciar sesión", "registrarse", "página siguiente", "página anterior", "volver arriba", "leer más", "ir al contenido",
)
BOILERPLATE = (
    "cookie policy", "privacy policy", "terms of use", "terms of service", "enable javascript", "use cookies", "subscribe to our newsletter", "lorem ipsum",
    "datenschutzerklärung", "nutzungsbedingungen", "verwendet cookies", "newsletter abonnieren",
    "politique de confidentialité", "conditions d'utilisation", "utilise des cookies", "abonnez-vous à notre newsletter",
    "política de privacidad", "política de cookies", "términos de uso", "suscríbete a nuestro boletín",
)
#: Lines with more symbols than this share of their words, or as many words that shout, fail the punctuation rule.
MAX_SYMBOLS, MAX_SHOUTS = 0.5, 0.5
#: A line of navigation has at most so many words to a separator.
WORDS_BETWEEN = 4
#: A kept document keeps at least this share of the characters in its words.
MIN_KEPT = 0.5


def count(text: Column, regex: str) -> Column:
    return F.regexp_count(text, F.lit(regex))


def trail(line: Column) -> Column:
    """Three separators or more, and one for every WORDS_BETWEEN words; guillemets around a quotation separate nothing."""
    bare = F.regexp_replace(F.regexp_replace(line, r"«[^«»]*»|‹[^‹›]*›", "q"), r"»[^«»]*«|›[^‹›]*‹", "q")
    dense = WORDS_BETWEEN * count(bare, "[|»›]") >= count(line, f"[^{SPACE}|»›]+")
    likely = F.regexp_like(line, F.lit(r"\S\s*[|»›]\s*\S[^|»›]*[|»›]\s*\S[^|»›]*[|»›]"))
    return likely & F.regexp_like(bare, F.lit(r"\S\s*[|»›]\s*\S[^|»›]*[|»›]\s*\S[^|»›]*[|»›]")) & dense


def line_fails(line: Column) -> Column:
    """True for a line that has words and breaks a rule."""
    n = count(line, f"[^{SPACE}]+")
    low = F.lower(line)
    symbols = count(line, r"[#*$%&|<>{}\\]") > MAX_SYMBOLS * n
    shouts = (n >= 3) & (count(line, f"[!?]{{2,}}(?=[{SPACE}]|$)") > MAX_SHOUTS * n)
    no_letters = ~F.regexp_like(line, F.lit(r"[\p{L}\p{N}]"))
    navigation = (n <= 4) & F.regexp_like(low, F.lit(rf"^[{SPACE}]*[>»«‹›]*[{SPACE}]*({'|'.join(NAVIGATION)})[{SPACE}>»«‹›.:]*$")) | trail(line)
    boilerplate = (n <= 30) & F.regexp_like(low, F.lit("|".join(BOILERPLATE)))
    return symbols | shouts | no_letters | navigation | boilerplate


def repeat_words(df: DataFrame, words_col: str, out: str) -> DataFrame:
    """Adds out: how many words stand in a three-word window that the text holds twice or more."""
    w = F.col(words_col)
    df = df.withColumn("_wh", F.transform(w, lambda x: F.xxhash64(x)))
    h = F.col("_wh")
    df = df.withColumn("_tri", F.when(F.size(h) < 3, F.array().cast("array<bigint>")).otherwise(F.transform(F.slice(h, F.lit(1), F.size(h) - 2), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)))))
    t = F.col("_tri")
    # Only documents in which some window occurs twice sort their windows.
    df = df.withColumn("_sorted", F.when(F.size(F.array_distinct(t)) < F.size(t), F.sort_array(F.transform(t, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    s = F.col("_sorted")
    df = df.withColumn("_at", F.transform(F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"])), lambda x: x["i"]))
    at = F.col("_at")
    covered = F.array_distinct(F.concat(at, F.transform(at, lambda i: i + 1), F.transform(at, lambda i: i + 2)))
    return df.withColumn(out, F.when(at.isNull(), F.lit(0)).otherwise(F.size(covered)).cast("long")).drop("_wh", "_tri", "_sorted", "_at")


def judge(df: DataFrame, text_col: str = "text", only_kept: bool = False) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, cleaned (the text without failing lines) and n_lines_removed.

    Columns of df with these names are replaced. To filter by kept, ask for only_kept, or see where_computed().
    """
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "cleaned", "n_lines_removed"]
    df, held = packed(df, text_col, added)
    t = F.col("_text")
    df = df.withColumn("_words", words(t)).withColumn("_lines", F.split(t, "\n"))
    w, lines = F.col("_words"), F.col("_lines")
    full = F.filter(lines, lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    df = df.withColumns({
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": count(t, r"[#*$%&|<>]").cast("long"),
        "_full": full,
    })
    full = F.col("_full")
    df = df.withColumn("n_dup_lines", (F.size(full) - F.size(F.array_distinct(full))).cast("long"))
    df = repeat_words(df, "_words", "n_repeat_words")
    df = df.withColumn("_good", F.filter(lines, lambda x: F.coalesce(~line_fails(x), F.lit(True)) | (F.btrim(x, F.lit(SPACE_CHARS)) == "")))
    df = df.withColumn("cleaned", F.array_join("_good", "\n"))
    kept_chars = F.length(F.regexp_replace("cleaned", f"[{SPACE}]+", ""))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    df = df.withColumns({"base_failed": failed, "n_lines_removed": (F.size(lines) - F.size("_good")).cast("long"), "_kept_chars": kept_chars})
    df = df.withColumn("kept", ~F.col("base_failed") & (F.col("_kept_chars") >= MIN_KEPT * F.col("word_chars")))
    df = where_computed(df, "kept") if only_kept else df
    return df.select(*held, *added)


def op8_quality_rules(spark, sf_dir):
    from .common import table

    return judge(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def stage(spark, docs, sf_dir):
    """Pipeline: rejected documents go; the others go on with their cleaned text."""
    out = judge(docs.select("doc_id", "text", "lang", "source"), only_kept=True)
    return out.select("doc_id", F.col("cleaned").alias("text"), "lang", "source", F.length("cleaned").cast("long").alias("n_chars"))


def sql() -> str:
    """DuckDB's form, line by line and window by window."""
    any_of = lambda phrases: "|".join(phrases).replace("'", "''")
    gap, word = f"[{SPACE}]*", f"[^{SPACE}]"
    trail_of = lambda x: f"regexp_matches({x}, '{word}{gap}[|»›]{gap}{word}[^|»›]*[|»›]{gap}{word}[^|»›]*[|»›]')"
    count_of = lambda x, regex: f"len(regexp_extract_all({x}, '{regex}'))"
    return rf"""
with d as (select row_number() over () as row, doc_id, coalesce(text, '') as t from documents),
w as (select row, regexp_extract_all(t, '{word}+') as w from d),
flat as (select row, unnest(w) as x, generate_subscripts(w, 1) as i from w),
triples as (select row, i, x as a, lead(x, 1) over (partition by row order by i) as b, lead(x, 2) over (partition by row order by i) as c from flat),
again as (select row, i from (select row, i, count(*) over (partition by row, a, b, c) as n from triples where c is not null) where n > 1),
repeats as (select row, count(distinct j) as n_repeat_words from (select row, unnest([i, i + 1, i + 2]) as j from again) group by row),
lines as (select row, unnest(string_split(t, chr(10))) as x from d),
seen as (
  select row, x, lower(x) as low, {count_of("x", word + "+")} as n, length(regexp_replace(x, '[{SPACE}]+', '', 'g')) as chars,
    regexp_replace(regexp_replace(x, '«[^«»]*»|‹[^‹›]*›', 'q', 'g'), '»[^«»]*«|›[^‹›]*‹', 'q', 'g') as bare
  from lines),
judged as (
  select row, x, n, chars,
    {count_of("x", r"[#*$%&|<>{}\\]")} > {MAX_SYMBOLS} * n
    or n >= 3 and {count_of("x", f"[!?]{{2,}}(?:[{SPACE}]|$)")} > {MAX_SHOUTS} * n
    or not regexp_matches(x, '[\p{{L}}\p{{N}}]')
    or n <= 4 and regexp_matches(low, '^{gap}[>»«‹›]*{gap}({any_of(NAVIGATION)})[{SPACE}>»«‹›.:]*$')
    or {trail_of("x")} and {trail_of("bare")} and {WORDS_BETWEEN} * {count_of("bare", "[|»›]")} >= {count_of("x", f"[^{SPACE}|»›]+")}
    or n <= 30 and regexp_matches(low, '{any_of(BOILERPLATE)}') as fails
  from seen where n > 0),
of_row as (
  select row, sum(n) as n_words, sum(chars) as word_chars, count(*) - count(distinct x) as n_dup_lines, sum(chars) filter (not fails) as kept_chars
  from judged group by row),
counted as (
  select doc_id, coalesce(n_words, 0)::bigint as n_words, coalesce(word_chars, 0)::bigint as word_chars, {count_of("t", "[#*$%&|<>]")}::bigint as n_symbols,
    coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words, coalesce(kept_chars, 0) as kept_chars
  from d left join of_row using (row) left join repeats using (row))
select * exclude (kept_chars), n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and kept_chars >= {MIN_KEPT} * word_chars as kept
from counted
"""
