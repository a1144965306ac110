"""Personal data: base patterns, and terms that give protected entities away.

Everything runs as DataFrame expressions.  Base matches are found kind by kind
with linear-time patterns.  Each e-mail address, IP, card or phone number is a
protected entity, and the corpus tells how strongly a term reveals one.  With
N distinct texts, n(e) of them that hold entity e, n(t, e) that hold e and,
anywhere outside it, term t, and n(t) that hold t, a term reveals e if n(t, e) >= support,
P(e | t) = n(t, e) / n(t) >= disclosure, and the pointwise information
log2(N n(t, e) / (n(t) n(e))) >= bits.  Texts count once however often they are
copied.  Revealing terms are spans of kind ``term`` wherever
they occur, and are generalised to a label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared, spans

KINDS = ("email", "ip", "card", "phone")
#: Fixed by the contract; written so that each matches what the plain form matches, in linear time.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text needs to have a match at all.
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]"}
SUPPORT, DISCLOSURE, BITS, LEAST_TERM = 5, 0.8, 4.0, 4
BETWEEN = r"[^\p{L}\p{N}]+"


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(v: Column) -> Column:
    def ok(d: Column) -> Column:
        n = F.length(d)
        digit = lambda i: F.substring(d, i, F.lit(1)).cast("int")
        doubled = lambda x: x * 2 - F.when(x > 4, 9).otherwise(0)
        total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + F.when((n - i) % 2 == 0, digit(i)).otherwise(doubled(digit(i))))
        return F.when((n >= 12) & (n <= 19), total % 10 == 0).otherwise(False)

    return spans.let(_digits(v), ok)


def _ip(v: Column) -> Column:
    return F.forall(F.split(v, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.substring(F.concat(F.lit("000"), p), -3, 3).cast("int") <= 255))


def _phone(v: Column) -> Column:
    n = F.length(_digits(v))
    return (n >= 9) & (n <= 15)


TESTS = {"email": None, "ip": _ip, "card": _luhn, "phone": _phone}


def base_spans(text: Column) -> Column:
    """All base spans of a text that is not null, by start, then kind."""
    every = [F.when(text.rlike(NEEDS[k]), spans.matches(text, PATTERNS[k], k, i, TESTS[k])).otherwise(spans.none()) for i, k in enumerate(KINDS)]
    return F.array_sort(F.concat(*every))


def terms_of(text: Column) -> Column:
    """The distinct terms of a text: runs of LEAST_TERM or more letters and digits with a letter, in lower case."""
    return F.filter(F.array_distinct(F.split(F.lower(text), BETWEEN)), lambda t: (F.length(t) >= LEAST_TERM) & t.rlike(r"\p{L}"))


def base_table(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Stored table (doc, whole, spans, rest) of every row: whole is a digest of the text, rest the terms outside its spans, if it has any; null texts are empty."""
    t = docs.select(F.col(doc_id).alias("doc"), F.coalesce(text, F.lit("")).alias("t"))
    found = t.select("doc", "t", F.sha2(F.col("t").cast("binary"), 256).alias("whole"), base_spans(F.col("t")).alias("spans"))
    outside = terms_of(spans.redacted(F.col("t"), F.col("spans"), dict.fromkeys(LABELS, " ")))
    return shared.stored(found.select("doc", "whole", "spans", F.when(F.size("spans") > 0, outside).alias("rest")), "base-spans")


def revealing_terms(found: DataFrame, docs: DataFrame, text: str, support: int = SUPPORT, disclosure: float = DISCLOSURE, bits: float = BITS) -> DataFrame:
    """Stored table (term) of the terms that reveal an entity of the corpus."""
    entity = lambda s: F.xxhash64(s["kind"], F.when(s["kind"] == "email", F.lower(s["value"])).when(s["kind"] == "ip", s["value"]).otherwise(_digits(s["value"])))
    texts = found.where(F.size("spans") > 0).select("whole", "rest", F.transform("spans", lambda s: F.struct(entity(s).alias("entity"), s["value"].alias("value"))).alias("held")).dropDuplicates(["whole"])
    held = texts.select("rest", "held", F.explode(F.array_distinct(F.transform("held", lambda x: x["entity"]))).alias("entity"))
    # an entity's own characters tell nothing about it; those of the text's other entities do
    others = F.array_join(F.transform(F.filter("held", lambda x: x["entity"] != F.col("entity")), lambda x: x["value"]), " ")
    pairs = held.select("entity", F.explode(F.array_union(F.array(F.lit("")), F.array_union("rest", terms_of(others)))).alias("term"))
    counts = shared.stored(pairs.groupBy("entity", "term").agg(F.count("*").alias("n")).where(F.col("n") >= support), "term-texts")
    own = counts.where("term = ''").select("entity", F.col("n").alias("n_e"))
    both = counts.where("term <> ''").join(own, "entity").select("entity", "term", "n_e", F.col("n").alias("n_te"))
    if both.isEmpty():
        return both.select("term")
    # texts that occur once are counted where they are; of the others, one of each is
    texts = docs.select(F.coalesce(text, F.lit("")).alias("t")).select(F.sha2(F.col("t").cast("binary"), 256).alias("whole"), "t")
    copied = shared.stored(found.groupBy("whole").agg(F.count("*").alias("n")).where("n > 1").select("whole"), "copied-texts")
    few = shared.small(copied)
    texts = texts.join(few, "whole", "left_anti").unionByName(texts.join(few, "whole", "left_semi").dropDuplicates(["whole"]))
    n_t = texts.select(F.explode(terms_of(F.col("t"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    total = found.select("whole").distinct().count()
    information = F.log2(F.lit(float(total)) * F.col("n_te") / (F.col("n_t") * F.col("n_e")))
    strong = both.join(n_t, "term").where((F.col("n_te") >= disclosure * F.col("n_t")) & (information >= bits))
    return shared.stored(strong.select("term").distinct(), "revealing-terms")


def term_spans(docs: DataFrame, text: str, terms: DataFrame) -> DataFrame | None:
    """(whole, term_spans) of the texts in which revealing terms occur; None if there are no such terms."""
    if terms.isEmpty():
        return None
    texts = docs.select(F.coalesce(text, F.lit("")).alias("t")).select(F.sha2(F.col("t").cast("binary"), 256).alias("whole"), "t")
    held = texts.select("whole", F.explode(terms_of(F.col("t"))).alias("term")).join(shared.small(terms), "term").groupBy("whole").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    held = shared.small(shared.stored(held, "texts-with-terms"))
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join("terms", "|"), F.lit(r")(?![\p{L}\p{N}])"))
    return texts.join(held, "whole").select("whole", spans.matches(F.col("t"), pattern, "term", len(KINDS)).alias("term_spans")).dropDuplicates(["whole"])


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", support: int = SUPPORT, disclosure: float = DISCLOSURE, bits: float = BITS) -> DataFrame:
    """(doc_id, base, spans) for every row of docs: arrays of spans, spans being base and terms by start, then kind.

    Null and empty texts have none.  Rows that repeat are found each.  Other columns are ignored.
    """
    found = base_table(docs, doc_id, text)
    more = term_spans(docs, text, revealing_terms(found, docs, text, support, disclosure, bits))
    if more is None:
        return found.select(F.col("doc").alias(doc_id), F.col("spans").alias("base"), "spans")
    both = found.join(more, "whole", "left")
    return both.select(F.col("doc").alias(doc_id), F.col("spans").alias("base"), F.array_sort(F.concat("spans", F.coalesce("term_spans", spans.none()))).alias("spans"))


def sanitise(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with personal data and revealing terms in text put as labels; null texts stay null, all columns are kept."""
    found = base_table(docs, doc_id, text)
    more = term_spans(docs, text, revealing_terms(found, docs, text))
    t = F.col(text)
    if more is None:
        return docs.withColumn(text, F.when(t.isNotNull(), spans.let(base_spans(t), lambda s: spans.redacted(t, s, LABELS))))
    more = more.select(F.col("whole").alias("_whole"), F.col("term_spans").alias("_terms"))
    every = lambda s: F.array_sort(F.concat(s, F.coalesce("_terms", spans.none())))
    return (
        docs.withColumn("_whole", F.sha2(F.coalesce(t, F.lit("")).cast("binary"), 256))
        .join(more, "_whole", "left")
        .withColumn(text, F.when(t.isNotNull(), spans.let(every(base_spans(t)), lambda s: spans.redacted(t, s, LABELS))))
        .select(*docs.columns)
    )


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data and revealing terms in all documents."""
    f = find(shared.documents(spark, sf_dir))
    return f.select("doc_id", *[spans.count(F.col("base"), k).alias(f"n_{k}") for k in KINDS], spans.digest(F.col("base")).alias("base_sha256"), spans.joined(F.col("spans")).alias("spans"))
