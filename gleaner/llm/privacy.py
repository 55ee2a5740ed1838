"""Operator 5: information-theoretic sanitisation, in DataFrame functions only.

Base detectors find e-mail addresses, IP addresses, payment cards and telephone numbers. Each distinct value found is a
protected entity. Corpus co-occurrence then tells how strongly a term reveals one: the share of the term's documents
that hold the entity, and the information this gives over the entity's own frequency. In the documents that hold an
entity, terms above both thresholds are further spans, however few documents that are; sanitising generalises base spans to their kind and removes terms.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import materialize, table

KINDS = ("email", "ip", "card", "phone")
#: As the contract's patterns, made linear: runs are possessive, and a run may begin only where the characters before
#: it end one or where the match before it ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TERM = "term"
TERM_ORDER = len(KINDS)
#: Numbers whose running totals are taken at a time, and places that the copies of one text are dealt to.
BLOCK, SALTS = 128, 16
SPAN = "struct<start:int,ord:int,kind:string,end:int,value:string>"


def _holds(kind: str, text: Column) -> Column:
    """A cheap test that no text with a match fails."""
    return {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}.get(kind, text.rlike("[0-9]"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check sum of a string of digits is divisible by ten."""
    at = F.sequence(F.lit(1), F.length(digits))
    values = F.transform(at, lambda i: F.substring(F.reverse(digits), i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    return F.aggregate(values, F.lit(0), lambda s, x: s + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        bare = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(bare, lambda p: (F.length(p) <= 3) & (F.substring(p, 1, 3).cast("int") <= 255))
    digits = _digits(value)
    if kind == "card":
        return F.length(digits).between(14, 19) & F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    return F.length(digits).between(10, 15)


def _running(numbers: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Running totals of an array of numbers that aren't negative, in blocks: an array grows by copying, so one pass over
    all would take the square of its length."""
    none = F.array().cast("array<int>")

    def within(block: Column) -> Column:
        step = lambda acc, n: F.struct(combine(acc["at"], n).alias("at"), F.concat(acc["out"], F.array(combine(acc["at"], n))).alias("out"))
        return F.aggregate(block, F.struct(F.lit(0).alias("at"), none.alias("out")), step)["out"]

    last = F.floor((F.size(numbers) - 1) / BLOCK).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda k: F.slice(numbers, k * BLOCK + 1, F.lit(BLOCK)))
    inner = F.transform(cut, within)
    bases = F.concat(F.array(F.lit(0)), within(F.transform(inner, lambda b: F.coalesce(F.array_max(b), F.lit(0)))))
    return F.flatten(F.zip_with(inner, F.slice(bases, F.lit(1), F.size(inner)), lambda b, base: F.transform(b, lambda x: combine(base, x))))


def _spans(text: Column, pattern: Column, kind: str, order: int) -> Column:
    """All matches as an array of SPAN, by the lengths in code points of matches and of the gaps between them."""
    matches, gaps = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, -1)
    steps = F.zip_with(matches, gaps, lambda m, g: F.coalesce(F.length(m) + F.length(g), F.lit(0)))
    ends = _running(steps, lambda x, y: x + y)
    return F.zip_with(
        matches, F.slice(ends, F.lit(1), F.size(matches)),
        lambda m, e: F.struct((e - F.length(m)).alias("start"), F.lit(order).alias("ord"), F.lit(kind).alias("kind"), e.alias("end"), m.alias("value")),
    )


def base_spans(text: Column) -> Column:
    """All valid base spans of a text, by start and then kind."""
    none = F.array().cast(f"array<{SPAN}>")

    def of(kind: str, order: int) -> Column:
        valid = F.filter(_spans(text, F.lit(PATTERNS[kind]), kind, order), lambda s: _valid(kind, s["value"]))
        return F.when(_holds(kind, text), valid).otherwise(none)

    found = [of(kind, k) for k, kind in enumerate(KINDS)]
    return F.array_sort(F.concat(*found))


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _words(text: Column) -> Column:
    return F.filter(F.array_distinct(F.split(text, r"[^\p{L}]+")), lambda w: F.length(w) >= 3)


def _any_of(terms: Column) -> Column:
    """A pattern of the terms as whole words; those with the same first two letters are tried together."""
    heads = F.array_distinct(F.transform(terms, lambda t: F.substring(t, 1, 2)))
    tails = lambda h: F.transform(F.filter(terms, lambda t: F.substring(t, 1, 2) == h), lambda t: F.substring(t, F.lit(3), F.length(t)))
    return F.concat(F.lit(r"(?<!\p{L})(?:"), F.array_join(F.transform(heads, lambda h: F.concat(h, F.lit("(?:"), F.array_join(tails(h), "|"), F.lit(")"))), "|"), F.lit(r")(?!\p{L})"))


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_texts: int = 1, min_share: float = 0.5, min_bits: float = 3.0) -> DataFrame:
    """One row per document: doc_id, base, spans (arrays of start, ord, kind, end, value) and text_key.

    A term is flagged for an entity where the entity is in ``min_share`` of the term's documents and that is ``min_bits``
    more information than the entity's own share. The share is smoothed by one more document of the term that holds the
    entity as often as any document does: a term of one document passes only just, one stray use of it undoes that, and
    more documents bear more strays. Callers may ask for ``min_texts`` different texts besides.
    Null and empty texts have no spans, an empty table gives no row; copies count as documents but not as different
    texts; repeated rows each get a row. Very long texts are scanned whole, in time about linear in their matches.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))
    found = rows.withColumn("base", base_spans(F.col("text"))).select(
        "doc_id", "text_key", "base", F.when(F.size("base") > 0, F.col("text")).alias("text"),
    )
    found = materialize(found, "spans")
    # One row for each different text that holds an entity, with its number of documents.
    holders = found.where(F.size("base") > 0).groupBy("text_key").agg(F.any_value(F.struct("text", "base")).alias("x"), F.count("*").alias("copies"))
    entity = F.array_distinct(F.transform("x.base", lambda s: F.concat_ws(":", s["kind"], F.when(s["kind"] == "email", F.lower(s["value"])).when(s["kind"] == "ip", s["value"]).otherwise(_digits(s["value"])))))
    holders = materialize(holders.select("text_key", "copies", F.col("x.text").alias("text"), entity.alias("entities")), "holders")
    each = holders.select("text_key", "copies", "text", F.explode("entities").alias("entity"))
    # Entities of the same texts reveal the same terms: one of them stands for all.
    same = [F.bit_xor(F.xxhash64("text_key", F.lit(k))).alias(f"same{k}") for k in (1, 2)]
    known = each.groupBy("entity").agg(F.count("*").alias("texts"), F.sum("copies").alias("entity_docs"), *same).where(F.col("texts") >= min_texts)
    known = known.groupBy("texts", "entity_docs", "same1", "same2").agg(F.min("entity").alias("entity"))
    owners = each.join(known, "entity").groupBy("text_key").agg(F.max("entity_docs").alias("most"), F.collect_list(F.struct("entity", "entity_docs")).alias("owners"))
    owners = materialize(owners, "owners")
    # Document frequencies over the whole corpus, summed in each task before the shuffle.
    seen = rows.select(F.explode(_words(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("term_docs"))
    # Terms of more documents than any entity of the text can have its share of are out before pairs are made.
    words = holders.join(owners.select("text_key", "most"), "text_key").select("text_key", "copies", "most", F.explode(_words(F.col("text"))).alias("term"))
    words = words.join(seen, "term").where(F.col("most") + 1 >= min_share * (F.col("term_docs") + 1)).drop("most")
    pairs = words.join(owners, "text_key").select("text_key", "copies", "term", "term_docs", F.inline("owners"))
    pairs = materialize(pairs, "pairs")
    both = pairs.groupBy("entity", "term").agg(
        F.count("*").alias("texts"), F.sum("copies").alias("docs"), F.first("entity_docs").alias("entity_docs"), F.first("term_docs").alias("term_docs"),
    ).where(F.col("texts") >= min_texts)
    total = rows.agg(F.count("*").alias("all_docs"))
    usual = F.col("entity_docs") / F.col("all_docs")
    share = (F.col("docs") + usual) / (F.col("term_docs") + 1)
    strong = both.crossJoin(F.broadcast(total)).where((share >= min_share) & (F.log2(share / usual) >= min_bits))
    terms = pairs.join(strong.select("entity", "term"), ["entity", "term"]).groupBy("text_key").agg(F.collect_set("term").alias("terms"))
    more = holders.join(terms, "text_key").select("text_key", _spans(F.col("text"), _any_of(F.col("terms")), TERM, TERM_ORDER).alias("added"))
    # Only texts with an entity can have terms; the copies of one are dealt to several places.
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt")
    salted = more.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    held = F.size("base") > 0
    joined = found.where(held).select("doc_id", "text_key", "base", salt).join(salted, ["text_key", "salt"], "left").drop("salt")
    joined = joined.unionByName(found.where(~held).select("doc_id", "text_key", "base"), allowMissingColumns=True)
    outside = F.filter("added", lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    return joined.select("doc_id", "text_key", "base", F.array_sort(F.concat("base", F.coalesce(outside, F.array().cast(f"array<{SPAN}>")))).alias("spans"))


def sanitise(text: Column, spans: Column) -> Column:
    """The text with base spans generalised to their kind, like ``<email>``, and terms removed. Of spans that overlap
    the first stands for all of them."""
    mark = lambda s: F.when(s["kind"] == TERM, "").otherwise(F.concat(F.lit("<"), s["kind"], F.lit(">")))
    ends = _running(F.transform(spans, lambda s: s["end"]), lambda x, y: F.greatest(x, y))
    before = F.concat(F.array(F.lit(0)), F.slice(ends, F.lit(1), F.greatest(F.size(ends) - 1, F.lit(0))))
    kept = F.zip_with(spans, before, lambda s, at: F.when(s["start"] >= at, F.concat(F.substring(text, at + 1, s["start"] - at), mark(s))).otherwise(""))
    whole = F.concat(F.array_join(kept, ""), F.substring(text, F.coalesce(F.array_max(ends), F.lit(0)) + 1, F.length(text)))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def op5_sanitise_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of all documents: counts of base spans, their digest, and all spans."""
    found = find(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k) for k in KINDS), F.sha2(span_text(F.col("base")).cast("binary"), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))
