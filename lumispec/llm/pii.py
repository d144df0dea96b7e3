"""Operator 1, personal data, by information-theoretic sanitisation, with DataFrame functions only.

The base patterns find e-mail addresses, IP addresses, card and phone numbers; each distinct value is a protected
entity, whatever its separators, and so is the wider one that it belongs to: an address' domain, an IP network of 24
bits, a card's issuer (six digits), a phone number but for its last four digits. A term may tell the wider entity (a firm,
a site) where no single value comes often enough to be estimated. Around every entity stand its context terms. With counts over the whole corpus, a term t reveals an entity e
by their pointwise mutual information over the entity's own information,

    reveals(e, t) = log2(p(e, t) / (p(e) p(t))) / -log2(p(e))

which is 1 where seeing t tells e for certain. p counts documents. From REMOVE on, a term is removed where it stands,
from GENERALISE on it is generalised; entities are replaced by their kind. A pair counts only where it was seen in
SUPPORT documents with different contexts, so that neither chance nor copies of a text disclose anything.

Terms are counted by partial aggregation before any shuffle. The disclosing terms are joined back to documents
through a shuffle; they are broadcast only if they are few enough, by a count.

Defined results: a null or empty text has no spans; null ids, repeated rows and extra columns pass through (repeated
rows count as documents of their own); an empty table gives an empty table; terms inside base spans are not terms; texts of any
length are read whole; entities at one place are in the order of their ends.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, packed, stored, table, where_computed

KINDS = ("email", "ip", "card", "phone")
# The patterns start where a run of their first characters does, or where the last match ended, and never give back
# what they took: the same matches as the plain patterns, in time that grows with the text and not with its square.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Context terms on either side of an entity, as far as the next entity.
WINDOW = 5
#: A term is disclosing for what it reveals of an entity, from so many documents on.
GENERALISE, REMOVE, SUPPORT = 0.75, 0.9, 3
#: Broadcast at most so many bytes of disclosing terms; more are joined through a shuffle.
BROADCAST_BYTES = 4 << 20
TERM = r"[^\p{L}\p{N}]+"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes: from the right, every second digit counts double, less 9 over 9."""
    d = F.reverse(F.split(digits, ""))
    one = lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise((x.cast("int") * 2) - F.when(x.cast("int") > 4, 9).otherwise(0))
    return F.aggregate(F.transform(d, one), F.lit(0), lambda a, x: a + x) % 10 == 0


def holds(kind: str, s: Column) -> Column:
    """The test on a match of the kind's pattern."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(s, r"\."), lambda x: let(F.regexp_replace(x, "^0+", ""), lambda y: (F.length(y) <= 3) & (F.coalesce(F.when(F.length(y) <= 3, F.when(y == "", "0").otherwise(y)).cast("int"), F.lit(0)) <= 255)))
    digits = F.regexp_replace(s, "[^0-9]", "")
    if kind == "card":
        return let(digits, lambda d: F.when(F.length(d).between(13, 19), luhn(d)).otherwise(F.lit(False)))
    return F.length(digits).between(9, 15)


def spans(text: Column, pattern: Column, good) -> Column:
    """All matches of the pattern that pass good, as (start, end, value) in code points; the text between matches gives the places."""
    found, gaps = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, -1)
    start = F.struct(F.lit(0).cast("long").alias("at"), no_spans().alias("all"))

    def step(acc: Column, m: Column) -> Column:
        s = acc["at"] + F.length(m["gap"])
        e = s + F.length(m["v"])
        return F.struct(e.alias("at"), F.when(good(m["v"]), F.concat(acc["all"], F.array(F.struct(s.alias("s"), e.alias("e"), m["v"].alias("v"))))).otherwise(acc["all"]).alias("all"))

    def placed(f: Column) -> Column:
        return let(gaps, lambda g: F.aggregate(F.transform(f, lambda v, i: F.struct(F.get(g, i).alias("gap"), v.alias("v"))), start, step, lambda a: a["all"]))

    return let(found, lambda f: F.when(F.size(f) == 0, no_spans()).otherwise(placed(f)))


def no_spans() -> Column:
    return F.array().cast("array<struct<s:bigint,e:bigint,v:string>>")


def base_spans(df: DataFrame, text: Column) -> DataFrame:
    """Adds a column of spans for each kind, _email and so on."""
    for kind in KINDS:
        likely = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}.get(kind, F.lit(True))
        df = df.withColumn(f"_{kind}", F.when(likely, spans(text, F.lit(PATTERNS[kind]), partial(holds, kind))).otherwise(no_spans()))
    return df


def of_kinds(one) -> Column:
    """The spans of all kinds, each as one(kind, span) says."""
    return F.concat(*[F.transform(F.col(f"_{k}"), (lambda kind: lambda x: one(kind, x))(k)) for k in KINDS])


def joined(kind: str, found: Column) -> Column:
    return F.transform(found, lambda x: F.concat_ws(":", F.lit(kind), x["s"], x["e"]))


def entities(kind: str, span: Column) -> Column:
    """The names of the value and of the wider entity."""
    v = F.lower(span["v"])
    if kind == "email":
        wider = F.regexp_extract(v, "@.*$", 0)
    elif kind == "ip":
        wider = F.regexp_extract(v, r"^.*\.", 0)
    else:
        v = F.regexp_replace(v, "[^0-9]", "")
        wider = F.concat(F.left(v, F.lit(6) if kind == "card" else F.length(v) - 4), F.lit("*"))
    return F.array(F.concat(F.lit(kind + ":"), v), F.concat(F.lit(kind + ":"), wider))


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), TERM), lambda x: x != "")


def contexts(df: DataFrame) -> DataFrame:
    """(entity, term, context): once a document, what stands within WINDOW terms of an entity, with the hash of all the document's contexts; a null term for the entity itself."""
    text = F.col("_text")
    all_spans = F.array_sort(of_kinds(lambda k, x: F.struct(x["s"].alias("s"), x["e"].alias("e"), entities(k, x).alias("names"))))

    def words(start: Column, end: Column) -> Column:
        gap = F.substr(text, start.cast("int") + 1, F.greatest(end - start, F.lit(0)).cast("int"))
        return F.filter(terms(gap), lambda t: F.regexp_like(t, F.lit(r"\p{L}")))

    def near(all_of: Column) -> Column:
        # Each stretch between two entities is cut once, so the work grows with the text and not with its entities.
        starts = F.concat(F.array(F.lit(0).cast("long")), F.transform(all_of, lambda x: x["e"]))
        ends = F.concat(F.transform(all_of, lambda x: x["s"]), F.array(F.length(text).cast("long")))
        cut = F.zip_with(starts, ends, words)

        def of(gaps: Column) -> Column:
            def one(x: Column, i: Column) -> Column:
                before, after = F.slice(F.reverse(F.get(gaps, i)), 1, WINDOW), F.slice(F.get(gaps, i + 1), 1, WINDOW)
                found = F.concat(F.array(F.lit(None).cast("string")), before, after)
                return F.flatten(F.transform(x["names"], lambda name: F.transform(found, lambda t: F.struct(name.alias("entity"), t.alias("term")))))

            return F.transform(all_of, one)

        return let(cut, of)

    pairs = let(all_spans, near)
    hit = where_computed(df, " or ".join(f"size(_{k}) > 0" for k in KINDS)).select(F.array_distinct(F.flatten(pairs)).alias("p"))
    return hit.select(F.xxhash64("p").alias("context"), F.explode("p").alias("x")).select("x.entity", "x.term", "context")


def disclosing(df: DataFrame) -> DataFrame | None:
    """(term, reveals): the terms that reveal some entity by GENERALISE or more, from counts over all of df; None if there are none.

    A term's own count over the corpus is needed only where its pair can still reach GENERALISE; the documents that
    hold it in a context are a lower bound of that count, so common words are out before any text is read again.
    """
    total = F.lit(float(max(df.count(), 2)))
    seen = stored(contexts(df), "pii-contexts")

    def reveals(n_term: str) -> Column:
        p_both, p_entity, p_term = (F.least(F.col(c) / total, F.lit(1.0)) for c in ("both", "n_entity", n_term))
        return F.try_divide(F.log2(p_both / (p_entity * p_term)), -F.log2(p_entity))

    pairs = seen.where("term is not null").groupBy("entity", "term").agg(F.count("*").alias("both"), F.min("context").alias("a"), F.max("context").alias("b")).where((F.col("both") >= SUPPORT) & (F.col("a") != F.col("b")))
    of_entity = seen.where("term is null").groupBy("entity").agg(F.count("*").alias("n_entity"))
    in_contexts = seen.where("term is not null").groupBy("term").agg(F.countDistinct("context").alias("n_context"))
    pairs = pairs.join(of_entity, "entity").join(in_contexts, "term").where(reveals("n_context") >= GENERALISE)
    pairs = stored(pairs.select("term", "both", "n_entity"), "pii-pairs")
    if pairs.isEmpty():
        return None
    # Counted first, joined then: what is joined is a vocabulary, not its places in the corpus.
    of_term = document_terms(df).groupBy("term").agg(F.count("*").alias("n_term"))
    found = pairs.join(of_term, "term").select("term", reveals("n_term").alias("reveals"))
    found = stored(found.groupBy("term").agg(F.max("reveals").alias("reveals")).where(F.col("reveals") >= GENERALISE), "pii-disclosing")
    return None if found.isEmpty() else found


def document_terms(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, F.explode(F.array_distinct(terms(F.col("_text")))).alias("term"))


def small(df: DataFrame, size: Column) -> DataFrame:
    """df, stored, to be broadcast if it has at most BROADCAST_BYTES; size: bytes of a row."""
    df = stored(df, "pii-terms")
    return F.broadcast(df) if (df.agg(F.sum(size + 32)).first()[0] or 0) <= BROADCAST_BYTES else df


def with_terms(df: DataFrame, found: DataFrame) -> DataFrame:
    """Adds _terms, (term, reveals) of each disclosing term that the text holds, else null."""
    df = df.withColumn("_key", F.md5("_text"))
    hits = document_terms(df, "_key").join(small(found, F.octet_length("term")), "term").groupBy("_key").agg(F.collect_set(F.struct("term", "reveals")).alias("_terms"))
    held = F.aggregate("_terms", F.lit(0), lambda n, t: n + F.octet_length(t["term"]) + 16)
    hits = small(hits.withColumnRenamed("_key", "_hit"), held)
    return df.join(hits, F.col("_key") == F.col("_hit"), "left").drop("_hit", "_key")


def sanitise(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_email, n_ip, n_card, n_phone, base_spans, term_spans (arrays of kind:start:end) and sanitised (the text with entities and terms replaced)."""
    added = [*(f"n_{k}" for k in KINDS), "base_spans", "term_spans", "sanitised"]
    df, kept = packed(df, text_col, added)
    df = base_spans(df, F.col("_text"))
    found = disclosing(df)
    df = with_terms(df, found) if found is not None else df.withColumn("_terms", F.lit(None).cast("array<struct<term:string,reveals:double>>"))
    quoted = F.array_join(F.transform("_terms", lambda x: x["term"]), "|")
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), quoted, F.lit(r")(?![\p{L}\p{N}])"))
    base = of_kinds(lambda k, x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(f"[{k.upper()}]").alias("r")))
    df = df.withColumn("_base", F.array_sort(base)).withColumn("_found", F.when(F.col("_terms").isNull(), no_spans()).otherwise(spans(F.col("_text"), pattern, lambda v: F.lit(True))))
    apart = F.filter("_found", lambda t: ~F.exists("_base", lambda b: (b["s"] < t["e"]) & (t["s"] < b["e"])))
    df = df.withColumn("_found", apart)
    level = lambda t: F.coalesce(F.element_at(F.map_from_entries("_terms"), F.lower(t["v"])), F.lit(1.0))
    shape = lambda v: F.when(F.regexp_like(v, F.lit(r"\p{N}")), "[CODE]").when(F.regexp_like(v, F.lit(r"^\p{Lu}")), "[NAME]").otherwise("[TERM]")
    replaced = F.transform("_found", lambda t: F.struct(t["s"].alias("s"), t["e"].alias("e"), F.when(level(t) >= REMOVE, F.lit("")).otherwise(shape(t["v"])).alias("r")))
    df = df.withColumn("_edits", F.array_sort(F.concat("_base", F.when(F.size("_found") > 0, replaced).otherwise(F.array().cast("array<struct<s:bigint,e:bigint,r:string>>")))))
    text = F.col("_text")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        """Overlapping spans are replaced as one, by the name of the first."""
        gap = F.substring(text, (acc["at"] + 1).cast("int"), F.greatest(x["s"] - acc["at"], F.lit(0)).cast("int"))
        return F.struct(F.greatest(x["e"], acc["at"]).alias("at"), F.when(x["s"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], gap, x["r"])).alias("out"))

    edited = F.aggregate("_edits", start, step, lambda a: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.length(text))))
    counts = {f"n_{k}": F.size(f"_{k}").cast("long") for k in KINDS}
    df = df.withColumns(counts | {"base_spans": F.concat(*[joined(k, F.col(f"_{k}")) for k in KINDS]), "term_spans": joined("term", F.col("_found")), "sanitised": F.when(F.size("_edits") == 0, text).otherwise(edited)})
    return df.select(*kept, *added)


def op1_pii(spark, sf_dir):
    out = sanitise(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.array_join("base_spans", ","), 256).alias("base_sha256"), F.array_join(F.concat("base_spans", "term_spans"), ",").alias("spans"))


def stage(spark, docs, sf_dir):
    """Pipeline: every document goes on, with its text sanitised."""
    out = sanitise(docs.select("doc_id", "text", "lang", "source"))
    return out.select("doc_id", F.col("sanitised").alias("text"), "lang", "source", F.length("sanitised").cast("long").alias("n_chars"))
