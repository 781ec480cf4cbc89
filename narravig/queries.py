"""Queries of the core with their SQL, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narravig import reference_queries, reference_sql
from narravig.operators import nested, packed, units
from narravig.sources.tables import read


def _payload_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return nested.nodes(read(spark, sf, "raw_records", "record_id", "payload"), "record_id", "payload")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return nested.found(_payload_nodes(spark, sf))


def p2_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Every node with its Dewey label, its parent's, its schema path, and the scalar members of an object as JSON."""
    kept = _payload_nodes(spark, sf).where("broken IS NULL")
    own = kept.select("key", "dewey", "parent_dewey", "node_path", "parent_path", "schema_path", "pos", "is_null", "value", F.to_json("fields", {"ignoreNullFields": "false"}).alias("fields"))
    return own.distinct()


def p2_broken(spark: SparkSession, sf: str) -> DataFrame:
    return _payload_nodes(spark, sf).where("broken IS NOT NULL").select("key", "broken").distinct()


def p2_records(spark: SparkSession, sf: str) -> DataFrame:
    """The root table: one row a record, with its scalar members and the patient's."""
    return nested.roots(read(spark, sf, "raw_records", "record_id", "payload"), "record_id", "payload", ["set_id"], ["age", "sex"])


def p2_reactions(spark: SparkSession, sf: str) -> DataFrame:
    """Reactions of the record itself."""
    return nested.table(_payload_nodes(spark, sf), "reactions[]", ["reaction", "severity", "onset", "outcome"])


def p2_drugs(spark: SparkSession, sf: str) -> DataFrame:
    return nested.table(_payload_nodes(spark, sf), "drugs[]", ["name", "dose"])


def p2_drug_reactions(spark: SparkSession, sf: str) -> DataFrame:
    return nested.table(_payload_nodes(spark, sf), "drugs[].reactions[]", ["reaction", "severity", "onset", "outcome"])


def p2_sections(spark: SparkSession, sf: str) -> DataFrame:
    return nested.table(_payload_nodes(spark, sf), "adverse_reactions[]", ["section"])


def p2_section_items(spark: SparkSession, sf: str) -> DataFrame:
    return nested.table(_payload_nodes(spark, sf), "adverse_reactions[].items[]", ["label", "text"])


def p2_label_openfda(spark: SparkSession, sf: str) -> DataFrame:
    """The lists in openfda of drug_labels as one table; they are typed, so the positions come from the plan itself."""
    labels = read(spark, sf, "drug_labels", "label_id", "openfda")
    lists = F.array(*(F.struct(F.lit(f"openfda.{k}[]").alias("schema_path"), F.col(f"openfda.{k}").alias("own")) for k in nested.OPENFDA))
    each = labels.select("label_id", F.explode(lists).alias("l")).select("label_id", "l.schema_path", F.posexplode("l.own").alias("pos", "value"))
    return each.where("value IS NOT NULL").withColumn("pos", F.col("pos").cast("long")).distinct()


def _extracted(spark: SparkSession, sf: str, member: str) -> DataFrame:
    """Dewey label, parent's label, path, position and members of a typed list of ai_extractions; null elements keep their number."""
    rows = read(spark, sf, "ai_extractions", "narrative_id", "extraction").select(F.col("narrative_id").alias("key"), F.posexplode(f"extraction.{member}").alias("pos", "e"))
    ordinal = ("drugs", "reactions").index(member)
    path = F.concat(F.lit(f"{member}["), "pos", F.lit("]"))
    links = (F.concat(F.lit(f"0.{ordinal}."), "pos").alias("dewey"), F.lit("0").alias("parent_dewey"), F.lit("$").alias("parent_path"), path.alias("node_path"))
    return rows.where("e IS NOT NULL").select("key", *links, F.col("pos").cast("long").alias("pos"), "e")


def p2_extracted(spark: SparkSession, sf: str) -> DataFrame:
    """Drugs and reactions of ai_extractions with their links and name, and all their members as JSON."""
    parts = []
    for member, name in (("drugs", "name"), ("reactions", "reaction")):
        members = F.to_json("e", {"ignoreNullFields": "false"}).alias("fields")
        parts.append(_extracted(spark, sf, member).select(F.col("key").alias("narrative_id"), "node_path", "parent_path", F.lit(f"{member}[]").alias("schema_path"), "pos", F.col(f"e.{name}").alias("name"), members))
    return parts[0].unionByName(parts[1]).distinct()


def p2_extracted_drugs(spark: SparkSession, sf: str) -> DataFrame:
    return _extracted(spark, sf, "drugs").select("*", "e.*").drop("e").distinct()


def p2_extracted_reactions(spark: SparkSession, sf: str) -> DataFrame:
    return _extracted(spark, sf, "reactions").select("*", "e.*").drop("e").distinct()


def p2_extracted_records(spark: SparkSession, sf: str) -> DataFrame:
    """The root table of ai_extractions: one row an extraction, with the patient's members."""
    rows = read(spark, sf, "ai_extractions", "narrative_id", "extraction").where("extraction IS NOT NULL")
    e, patient = F.col("extraction"), ("age", "sex", "relevant_history")
    own = (e[c].alias(c) for c in ("causality", "overall_severity", "notes"))
    return rows.select(F.col("narrative_id").alias("key"), *(e["patient"][c].alias(c) for c in patient), *own).distinct()


def _packed(spark: SparkSession, sf: str) -> DataFrame:
    labels = read(spark, sf, "drug_labels", "label_id", "layout", "adverse_reactions", "contraindications")
    listing = labels.where("layout = 'listing'")
    return packed.unpack(
        listing, "label_id", {f: F.get(F.col(f), 0) for f in ("adverse_reactions", "contraindications")}
    )


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return _packed(spark, sf).select(F.col("key").alias("label_id"), "field", "pos", "item")


def p5_flags(spark: SparkSession, sf: str) -> DataFrame:
    """How often values came with each error flag."""
    return _packed(spark, sf).groupBy("field", "flag").agg(F.count("*").alias("n"))


def _doses(spark: SparkSession, sf: str) -> DataFrame:
    """ai_extractions with the engine that read the narrative as ``source``."""
    engines = read(spark, sf, "narratives", "narrative_id", "engine").groupBy("narrative_id").agg(F.min("engine").alias("source"))
    return read(spark, sf, "ai_extractions", "narrative_id", "extraction").join(engines, "narrative_id", "left")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Doses whose unit is written down; of several units in notes the classifier chooses, and only where it is sure."""
    return units.resolved(_doses(spark, sf))


def p6_doses(spark: SparkSession, sf: str) -> DataFrame:
    """Every dose with its amount, unit and the unit's source; uncertain ones are marked for review."""
    return units.convert(_doses(spark, sf))


def p6_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """How often the classifier is sure, and right, on doses whose known unit is hidden from it."""
    return units.accuracy(_doses(spark, sf))


QUERIES = {
    f.__name__: f
    for f in (
        p2_found, p2_nodes, p2_broken, p2_records, p2_reactions, p2_drugs, p2_drug_reactions, p2_sections, p2_section_items, p2_label_openfda,
        p2_extracted, p2_extracted_drugs, p2_extracted_reactions, p2_extracted_records, p5_found, p5_flags, p6_found, p6_doses, p6_accuracy,
    )
} | reference_queries.QUERIES

def _typed_sql(member: str, ordinal: int, fields: tuple[str, ...]) -> str:
    own = ", ".join(f"e.{f} AS {f}" for f in fields)
    return f"""SELECT DISTINCT narrative_id AS key, '0.{ordinal}.' || i AS dewey, '0' AS parent_dewey, '$' AS parent_path, '{member}[' || i || ']' AS node_path, i AS pos, {own}
        FROM (SELECT narrative_id, unnest(extraction.{member}) AS e, generate_subscripts(extraction.{member}, 1) - 1 AS i FROM ai_extractions) WHERE e IS NOT NULL"""


_DRUG, _REACTION = ("name", "dose", "route", "indication"), ("reaction", "severity", "onset", "outcome", "drug")
SQL: dict[str, str] = reference_sql.SQL | {
    "p2_label_openfda": "SELECT DISTINCT label_id, schema_path, i AS pos, value FROM ("
    + " UNION ALL ".join(f"SELECT label_id, 'openfda.{k}[]' AS schema_path, unnest(openfda.{k}) AS value, generate_subscripts(openfda.{k}, 1) - 1 AS i FROM drug_labels" for k in nested.OPENFDA)
    + ") WHERE value IS NOT NULL",
    "p2_extracted": " UNION ".join(
        f"""SELECT narrative_id, '{m}[' || i || ']' AS node_path, '$' AS parent_path, '{m}[]' AS schema_path, i AS pos, e.{n} AS name, CAST(to_json(e) AS VARCHAR) AS fields
        FROM (SELECT narrative_id, unnest(extraction.{m}) AS e, generate_subscripts(extraction.{m}, 1) - 1 AS i FROM ai_extractions) WHERE e IS NOT NULL"""
        for m, n in (("drugs", "name"), ("reactions", "reaction"))
    ),
    "p2_extracted_drugs": _typed_sql("drugs", 0, _DRUG),
    "p2_extracted_reactions": _typed_sql("reactions", 1, _REACTION),
    "p2_extracted_records": """SELECT DISTINCT narrative_id AS key, extraction.patient.age AS age, extraction.patient.sex AS sex, extraction.patient.relevant_history AS relevant_history,
        extraction.causality AS causality, extraction.overall_severity AS overall_severity, extraction.notes AS notes FROM ai_extractions WHERE extraction IS NOT NULL""",
}
