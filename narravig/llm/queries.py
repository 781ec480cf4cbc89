"""Queries of the text operators with their SQL, by name."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narravig.llm import canon, chunking, packing, pii, readability, sentences, tokens
from narravig.sources.tables import cut, read


#: Fields that size_limits bounds.
LIMITED = ("narrative", "clinical_pharmacology", "text")


def _limits(spark: SparkSession, sf: str) -> dict[str, tuple[int, int]]:
    """max_size and overlap_size by field; the table has one row a field."""
    rows = read(spark, sf, "size_limits", "field", "max_size", "overlap_size").where(F.col("field").isin(*LIMITED)).distinct()
    got = {r.field: (r.max_size, r.overlap_size) for r in rows.limit(len(LIMITED) + 1).collect()}
    if rows.count() != len(got):
        raise ValueError("size_limits has two rows of one field")
    return got


def _pieces(spark: SparkSession, sf: str) -> DataFrame:
    limits = {k: v for k, v in _limits(spark, sf).items() if k in ("narrative", "clinical_pharmacology")}
    told = read(spark, sf, "narratives", "narrative_id", "narrative").select(
        F.lit("narrative").alias("field"), F.col("narrative_id").alias("item_id"), F.lit(0).alias("pos"), F.col("narrative").alias("text")
    )
    labels = read(spark, sf, "drug_labels", "label_id", "clinical_pharmacology").select(
        F.lit("clinical_pharmacology").alias("field"), F.col("label_id").alias("item_id"), F.posexplode("clinical_pharmacology").alias("pos", "text")
    )
    return chunking.split(told.unionByName(labels), limits)


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return _pieces(spark, sf).select("field", "item_id", "pos").distinct()


def p1_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """The pieces of every oversized text."""
    return _pieces(spark, sf).dropDuplicates(["field", "item_id", "pos", "piece"])


def p1_rebuilt(spark: SparkSession, sf: str) -> DataFrame:
    """Each oversized text put together again from its pieces, as a digest, and how many pieces exceed the limit."""
    limits = _limits(spark, sf)
    most = F.create_map(*(x for field, (size, _) in limits.items() for x in (F.lit(field), F.lit(size))))
    own = F.array_sort(F.collect_list(F.struct("piece", "start_at", "end_at", "text"))).alias("own")
    each = p1_pieces(spark, sf).groupBy("field", "item_id", "pos").agg(own, F.count_if(F.length("text") > most[F.col("field")]).alias("too_long"))
    fresh = F.transform("own", lambda p, i: F.substring(p["text"], F.when(i == 0, 1).otherwise(F.element_at("own", F.greatest(i, F.lit(1)))["end_at"] - p["start_at"] + 1).cast("int"), F.length(p["text"])))
    return each.select("field", "item_id", "pos", F.md5(F.array_join(fresh, "").cast("binary")).alias("digest"), "too_long")


#: Setting that holds the secret of the pseudonyms. Without it each call draws one, so its pseudonyms link within its result only.
SECRET_CONF = "spark.narravig.pseudonymKey"


def _secret(spark: SparkSession) -> str:
    return spark.conf.get(SECRET_CONF, None) or secrets.token_hex(32)


def p3_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """Every mention with the check that a number passes and its pseudonym."""
    return pii.found(read(spark, sf, "narratives", "narrative_id", "narrative"), "narrative_id", "narrative", _secret(spark))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return p3_mentions(spark, sf).select("narrative_id", "kind", "start_at").distinct()


def p3_redacted(spark: SparkSession, sf: str) -> DataFrame:
    """Every narrative with placeholders."""
    return pii.redacted(read(spark, sf, "narratives", "narrative_id", "narrative"), "narrative_id", "narrative", _secret(spark))


def _typed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The typed values with their list, and the lists' entries."""

    def of(rows: DataFrame, field: str, name: str, row_id: str, pos, value: str) -> DataFrame:
        pos = F.col(pos) if isinstance(pos, str) else pos
        return rows.select(
            F.lit(field).alias("field"), F.lit(name).alias("list"), F.col(row_id).alias("row_id"), pos.cast("long").alias("pos"), F.col(value).alias("value")
        )

    drugs = read(spark, sf, "ai_extractions", "narrative_id", "extraction").select("narrative_id", F.posexplode("extraction.drugs").alias("i", "d"))
    rows = (
        of(read(spark, sf, "reports", "report_id", "line_no", "reaction"), "reaction", "reaction", "report_id", "line_no", "reaction")
        .unionByName(of(read(spark, sf, "report_counts", "count_id", "term"), "term", "reaction", "count_id", F.lit(0), "term"))
        .unionByName(of(drugs, "name", "drug", "narrative_id", "i", "d.name"))
    )
    entries = read(spark, sf, "reaction_lex", "term").select(F.lit("reaction").alias("list"), F.col("term").alias("canonical"))
    entries = entries.unionByName(read(spark, sf, "drug_lex", "name").select(F.lit("drug").alias("list"), F.col("name").alias("canonical")))
    return rows, entries


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return canon.resolve(*_typed(spark, sf))


def p4_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    """How many typed values of each field found an entry."""
    found = canon.resolve(*_typed(spark, sf))
    return found.groupBy("field").agg(F.count("*").alias("typed"), F.count_if(F.col("canonical") == "").alias("unmatched"))


def _prose(spark: SparkSession, sf: str) -> DataFrame:
    labels = read(spark, sf, "drug_labels", "label_id", "lang", "layout", "adverse_reactions", "warnings").where("layout = 'prose'")
    texts = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.get(F.col(f), 0).alias("text")) for f in ("adverse_reactions", "warnings"))))
    return labels.select(F.col("label_id").alias("item_id"), "lang", texts.alias("t")).select("item_id", "lang", "t.field", "t.text")


def _sentences(spark: SparkSession, sf: str, of_documents: bool) -> DataFrame:
    prose, docs = _prose(spark, sf), read(spark, sf, "documents", "doc_id", "text", "lang")
    learned = sentences.learn(prose.select("lang", "text").unionByName(docs.select("lang", "text")))
    texts = docs.select(F.col("doc_id").alias("item_id"), "lang", F.lit("text").alias("field"), "text") if of_documents else prose
    return sentences.split(texts, learned)


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    found = _sentences(spark, sf, False)
    return found.select(F.col("item_id").alias("label_id"), "field", "start_at").distinct()


def p7_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Where each sentence of each document starts and ends."""
    return _sentences(spark, sf, True).select(F.col("item_id").alias("doc_id"), "lang", "start_at", "end_at").distinct()


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.encode(read(spark, sf, "documents", "doc_id", "text"), "doc_id", "text")


def _packed(spark: SparkSession, sf: str) -> DataFrame:
    capacity, _ = _limits(spark, sf)["text"]
    sized = tokens.encode(read(spark, sf, "documents", "doc_id", "text"), "doc_id", "text", lengths_only=True)
    return packing.containers(sized, "doc_id", "n_tokens", capacity)


def p9_assignments(spark: SparkSession, sf: str) -> DataFrame:
    """The container of every document, or of its pieces if it exceeds the capacity."""
    return _packed(spark, sf).select(F.col("id").alias("doc_id"), "piece", "size", "container")


def p9_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Containers used, how many the search filled and in how many steps, tokens in them and the share of room left empty."""
    capacity, _ = _limits(spark, sf)["text"]
    each = _packed(spark, sf).groupBy("container").agg(F.sum("size").alias("fill"), F.count("*").alias("items"), F.max("nodes").alias("nodes"))
    return each.agg(
        F.count("*").alias("containers"),
        F.count_if(F.col("nodes") > 0).alias("searched"),
        F.sum("nodes").alias("nodes"),
        F.sum("fill").alias("tokens"),
        F.sum("items").alias("items"),
        F.max("fill").alias("fullest"),
        F.ceil(F.sum("fill") / F.lit(capacity)).alias("lower_bound"),
        (1 - F.sum("fill") / (F.count("*") * F.lit(capacity))).alias("waste"),
    )


def p9_placed(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with text, and whether a container that holds any of it exceeds the capacity."""
    capacity, _ = _limits(spark, sf)["text"]
    placed = cut(_packed(spark, sf).select("id", "container", "size"))
    over = placed.groupBy("container").agg((F.sum("size") > capacity).alias("over"))
    return placed.join(over, "container").groupBy(F.col("id").alias("doc_id")).agg(F.bool_or("over").alias("over"))


def _levels(spark: SparkSession, sf: str, docs: DataFrame, *keep: str) -> DataFrame:
    model = readability.fit(read(spark, sf, "level_samples", "sample_id", "text", "band"))
    return readability.levels(docs, "doc_id", "text", model, *keep)


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents", "doc_id", "text", "lang").where((F.col("lang") == "en") & (F.length("text") >= 400))
    return _levels(spark, sf, docs).where("band IS NOT NULL").select("doc_id", "band").distinct()


def p10_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Score and band of every document with words, in any language."""
    docs = read(spark, sf, "documents", "doc_id", "text", "source", "lang")
    return _levels(spark, sf, docs, "source", "lang").where("band IS NOT NULL").distinct()


def p10_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Documents, mean score and share of each band by source."""
    scored = p10_scores(spark, sf)
    share = lambda b: F.avg((F.col("band") == b).cast("double")).alias(f"share_{b}")
    return scored.groupBy("source").agg(F.count("*").alias("docs"), F.avg("score").alias("mean_score"), share(1), share(2), share(3))


QUERIES = {f.__name__: f for f in (p1_found, p1_pieces, p1_rebuilt, p3_found, p3_mentions, p3_redacted, p4_found, p4_unmatched, p7_found, p7_documents, p8_ids, p9_assignments, p9_fill, p9_placed, p10_found, p10_scores, p10_profile)}

SQL = {
    "p1_found": """
        SELECT DISTINCT 'narrative' AS field, narrative_id AS item_id, CAST(0 AS BIGINT) AS pos FROM narratives
        WHERE length(narrative) > (SELECT max_size FROM size_limits WHERE field = 'narrative')
        UNION
        SELECT DISTINCT 'clinical_pharmacology', label_id, CAST(i - 1 AS BIGINT) FROM (
            SELECT label_id, clinical_pharmacology AS c, unnest(range(1, len(clinical_pharmacology) + 1)) AS i FROM drug_labels)
        WHERE length(c[i]) > (SELECT max_size FROM size_limits WHERE field = 'clinical_pharmacology')""",
    "p1_rebuilt": """
        SELECT DISTINCT 'narrative' AS field, narrative_id AS item_id, CAST(0 AS BIGINT) AS pos, md5(narrative) AS digest, CAST(0 AS BIGINT) AS too_long FROM narratives
        WHERE length(narrative) > (SELECT max_size FROM size_limits WHERE field = 'narrative')
        UNION
        SELECT DISTINCT 'clinical_pharmacology', label_id, CAST(i - 1 AS BIGINT), md5(c[i]), CAST(0 AS BIGINT) FROM (
            SELECT label_id, clinical_pharmacology AS c, unnest(range(1, len(clinical_pharmacology) + 1)) AS i FROM drug_labels)
        WHERE length(c[i]) > (SELECT max_size FROM size_limits WHERE field = 'clinical_pharmacology')""",
    "p9_placed": "SELECT DISTINCT doc_id, false AS over FROM documents WHERE text <> ''",
}
