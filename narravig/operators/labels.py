"""Drug labels: which label a drug means, and its text as sections and items."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narravig import lexicons as lex
from narravig.functions.text import exploded, let, rx, strip
from narravig.sources.tables import cut

BRAND, GENERIC, SUBSTANCE = "brand_name", "generic_name", "substance_name"
#: Ways in which a label may answer for a drug, the best first: (list of openfda, whole entry or part of it).
CASCADE = ((BRAND, True), (GENERIC, True), (SUBSTANCE, True), (GENERIC, False), (SUBSTANCE, False), (None, False))
TWO_STEPS = ((BRAND, True), (GENERIC, True))
#: Up to so many asked names are broadcast.
ASKED = 100_000
NAMES = (BRAND, GENERIC, SUBSTANCE, "manufacturer_name", "route", "product_type")
TEXTS = tuple(f for f, _ in lex.SECTIONS)


def element0(column: str) -> Column:
    """The first text of a list; null if the list is null or empty."""
    return F.get(F.col(column), 0)


def words(text: Column) -> Column:
    """The words of a text in small letters."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}-]+"), lambda w: w != "")


def _ranked(entries: Column, priority: int, name: str, made) -> Column:
    return F.transform(entries, lambda e: F.struct(F.lit(priority).alias("priority"), made(e).alias(name)))


def whole_names(labels: DataFrame, cascade=CASCADE) -> DataFrame:
    """label_id, priority, name: whole entries under which a label is found, from one look at each label."""
    lists = [_ranked(F.col(f"openfda.{f}"), p, "name", lambda e: F.lower(strip(e))) for p, (f, whole) in enumerate(cascade) if whole]
    every = F.concat(*(F.coalesce(x, F.array().cast("array<struct<priority:int,name:string>>")) for x in lists))
    return labels.select("label_id", F.explode(every).alias("n")).select("label_id", "n.*").where("name <> ''")


def loose_texts(labels: DataFrame, cascade=CASCADE) -> DataFrame:
    """label_id, priority, words: each text that may hold a drug's name as whole words; for the last step all texts of the label."""
    entries = [_ranked(F.col(f"openfda.{f}"), p, "text", lambda e: e) for p, (f, whole) in enumerate(cascade) if f and not whole]
    last = [p for p, (f, _) in enumerate(cascade) if f is None]
    texts = F.flatten(F.array(*(F.coalesce(F.col(f), F.array().cast("array<string>")) for f in (*TEXTS, *(f"openfda.{f}" for f in NAMES)))))
    every = [*entries, *(_ranked(texts, p, "text", lambda e: e) for p in last)]
    every = F.concat(*(F.coalesce(x, F.array().cast("array<struct<priority:int,text:string>>")) for x in every))
    return labels.select("label_id", F.explode(every).alias("t")).select("label_id", "t.priority", words(F.col("t.text")).alias("words"))


def resolve(drugs: DataFrame, drug: str, labels: DataFrame, cascade=CASCADE) -> DataFrame:
    """drug, label_id, priority of the one label that each distinct drug means: best step, then smallest id.

    Whole entries are met by an equality join. Names that no whole entry answers, of any number of words, go on to the loose
    steps: a text gives its runs of as many words as such names have. The names are broadcast if there are at most ASKED of
    them; else the same joins shuffle. A partial minimum per drug goes through the shuffle, so a drug on many labels makes
    no large group.
    """
    # names and answers are one short row a drug; cut off, what they come from is read once
    asked = cut(drugs.select(F.lower(strip(F.col(drug))).alias("name")).where("name <> ''").distinct())
    bounded = asked.count() <= ASKED
    small = F.broadcast if bounded else lambda df: df
    best = lambda hits: hits.groupBy("name").agg(F.min(F.struct("priority", "label_id")).alias("b")).select("name", "b.label_id", "b.priority")
    firm = cut(best(whole_names(labels, cascade).join(small(asked), "name")))
    if all(whole for _, whole in cascade):
        return firm.withColumnRenamed("name", "drug").select("drug", "label_id", "priority")
    # one drug's words as one key; the runs of a text are as long as the names that are still open
    spelled = asked.join(firm, "name", "left_anti").withColumn("own", words(F.col("name")))
    open_ = spelled.select("name", F.array_join("own", " ").alias("run"), F.size("own").alias("n")).where("n > 0")
    sizes = sorted(r.n for r in open_.select("n").distinct().collect())
    found = firm
    if sizes:
        runs = F.flatten(F.array(*(_runs(n) for n in sizes)))
        near = loose_texts(labels, cascade).select("label_id", "priority", F.explode(F.array_distinct(runs)).alias("run")).join(small(open_), "run")
        found = firm.unionByName(cut(best(near.select("name", "label_id", "priority"))))
    return found.select(F.col("name").alias("drug"), "label_id", "priority")


def _runs(n: int) -> Column:
    """Every run of n of the ``words``."""
    some = F.transform(F.sequence(F.lit(1), F.size("words") - n + 1), lambda i: F.array_join(F.slice("words", i, n), " "))
    whole = F.col("words") if n == 1 else some
    return F.when(F.size("words") >= n, whole).otherwise(F.array().cast("array<string>"))


def headers_pattern() -> str:
    return "|".join(re.escape(h) for h in lex.WARNING_HEADERS)


def sections(raw: Column) -> Column:
    """Array of (ord, header, body) of a warnings text: text under each header; a repeated header keeps its first place and last text."""
    pattern = headers_pattern()

    def of(text: Column) -> Column:
        bodies = F.transform(F.split(text, pattern), strip)
        heads = F.concat(F.array(F.lit("general")), F.regexp_extract_all(text, F.lit(f"({pattern})"), 1))
        return F.transform(F.arrays_zip(bodies.alias("body"), heads.alias("header")), lambda z, i: F.struct(i.alias("ord"), z["header"].alias("header"), z["body"].alias("body")))

    # a body that is itself a header in other letters opens a section; it stands alone between two headers and holds no text
    keep = lambda z: (z["body"] != "") & (z["header"] != "general") & ~F.regexp_like(z["body"], F.lit(f"(?i)^(?:{pattern})$"))
    same = lambda all_, h: F.filter(all_, lambda z: z["header"] == h)

    def merged(all_: Column) -> Column:
        heads = F.array_distinct(F.transform(all_, lambda z: z["header"]))
        return F.transform(heads, lambda h: F.struct(same(all_, h)[0]["ord"].alias("ord"), h.alias("header"), F.element_at(same(all_, h), -1)["body"].alias("body")))

    return let(let(strip(raw), lambda text: F.filter(of(text), keep)), merged)


def warning_sections(labels: DataFrame) -> DataFrame:
    """label_id, ord, header, body of the first text of warnings, by ``sections``."""
    return exploded(labels, sections(element0("warnings")), "s", "label_id").select("label_id", "s.*")


def items(text: Column) -> Column:
    """Cleaned items of a text: sentences and parts between semicolons that may name a reaction, in order."""
    parts = F.split(strip(text), rx(lex.ITEM_BREAK))
    parts = F.transform(parts, lambda p: F.rtrim(strip(p), F.lit(".,;")))
    keep = lambda p: (
        (F.length(p) >= 6)
        & ~F.regexp_like(F.lower(p), F.lit("|".join(re.escape(b) for b in lex.BOILERPLATE)))
        & ~F.regexp_like(p, F.lit(rx(lex.PERCENT)))
        & ~F.regexp_like(p, F.lit(rx(lex.NUMBERS_ONLY)))
        & ~F.regexp_like(p, F.lit(rx(lex.DOSE_ONLY, True)))
        & ~F.regexp_like(p, F.lit(rx(rf"^(?:{lex.LEADING_WORDS})\b", True)))
        & F.regexp_like(p, F.lit(lex.FOUR_LETTERS))
    )
    return F.filter(parts, keep)


def side_effects(labels: DataFrame) -> DataFrame:
    """label_id, section, ord, label, text: cleaned reactions first, then the sections of the warnings."""
    cleaned = exploded(labels, items(element0("adverse_reactions")), "text", "label_id", pos="ord")
    cleaned = cleaned.select("label_id", F.lit("Adverse Reactions").alias("section"), "ord", F.lit(None).cast("string").alias("label"), "text")
    warned = warning_sections(labels).select("label_id", F.lit("Warnings").alias("section"), "ord", F.col("header").alias("label"), F.col("body").alias("text"))
    return cleaned.unionByName(warned)


LISTED = ("brand_name", "generic_name", "manufacturer_name", "route", "product_type")


def projection(labels: DataFrame, *keep: str) -> DataFrame:
    """One flat row a label: ``keep``, lists with a default, first texts of the fields."""
    listed = lambda f: F.coalesce(F.col(f"openfda.{f}"), F.array(F.lit("N/A"))).alias(f)
    filled = lambda c: F.when(element0(c) != "", element0(c))
    return labels.select(
        *keep,
        "label_id",
        *(listed(f) for f in LISTED),
        F.coalesce(element0("adverse_reactions"), F.lit("")).alias("adverse_reactions_raw"),
        F.coalesce(filled("warnings"), filled("warnings_and_precautions"), F.lit("")).alias("warnings_raw"),
        *(element0(c).alias(c) for c in ("boxed_warning", "contraindications", "drug_interactions", "indications_and_usage", "dosage_and_administration")),
    )


def section_rows(labels: DataFrame, *keep: str) -> DataFrame:
    """``keep``, label_id, ord, section, text of the filled fields, spaces collapsed, longer than 20 characters."""
    each = F.posexplode(F.array(*(F.struct(F.lit(title).alias("section"), element0(f).alias("raw")) for f, title in lex.SECTIONS))).alias("ord", "s")
    rows = labels.select(*keep, "label_id", each).select(*keep, "label_id", "ord", "s.section", F.regexp_replace(strip(F.col("s.raw")), rx(r"\s+"), " ").alias("text"))
    return rows.where(F.length("text") > 20)


def title(drug: Column) -> Column:
    """``Brand (generic)``, or the brand alone; the brand defaults to ``drug``."""
    brand = F.coalesce(F.get(F.col("openfda.brand_name"), 0), drug)
    generic = F.get(F.col("openfda.generic_name"), 0)
    return F.when(generic != "", F.concat(brand, F.lit(" ("), generic, F.lit(")"))).otherwise(brand)


def link(set_id: Column, drug: Column, base: str) -> Column:
    """The detail address of a label with a set id, else the search address."""
    return F.when(set_id != "", F.concat(F.lit(f"{base}/drugInfo.cfm?setid="), set_id)).otherwise(F.concat(F.lit(f"{base}/search.cfm?query="), drug))


def _blob() -> Column:
    """Reactions and warnings of a label as one text in small letters."""
    return F.lower(F.concat_ws(" ", *(F.array_join(F.col(c), " ") for c in ("adverse_reactions", "warnings", "warnings_and_precautions"))))


def keyword_context(labels: DataFrame, keyword: str) -> DataFrame:
    """label_id, hit_no, context: the keyword with exactly 50 characters of its line on either side."""
    hits = F.regexp_extract_all(_blob(), F.lit(rf"(?d).{{50}}{re.escape(keyword)}.{{50}}"), 0)
    return exploded(labels, hits, "context", "label_id", pos="hit_no")


def keyword_found(labels: DataFrame, keywords: tuple[str, ...]) -> DataFrame:
    """label_id, keyword, found: whether reactions or warnings hold each of the keywords."""
    each = lambda blob: F.array(*(F.struct(F.lit(k).alias("keyword"), F.contains(blob, F.lit(k)).alias("found")) for k in keywords))
    return labels.select("label_id", F.explode(let(_blob(), each)).alias("k")).select("label_id", "k.*")


def for_drugs(drugs: DataFrame, drug: str, labels: DataFrame, cascade=CASCADE) -> DataFrame:
    """drug and every column of the label that it means, one row a drug; a label that stands twice counts once."""
    meant = resolve(drugs, drug, labels, cascade).drop("priority")
    picked = labels.join(meant.select("label_id").distinct(), "label_id", "left_semi").dropDuplicates(["label_id"])
    return meant.join(picked, "label_id")
