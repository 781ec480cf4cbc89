"""The per-narrative operators over a stream; they keep no state, so the batch plans serve as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narravig.functions.text import exploded
from narravig.operators import deid, extract


def redacted(stream: DataFrame) -> DataFrame:
    """narrative_id, received_at and the redacted text of each arriving narrative."""
    return stream.select("narrative_id", "received_at", deid.redact(F.col("narrative")).alias("redacted"))


def reaction_counts(stream: DataFrame, drugs: DataFrame, reactions: DataFrame, window: str = "7 days", late: str = "60 days") -> DataFrame:
    """start, drug, reaction, n by window of arrival; narratives later than ``late`` behind the newest are left out.

    A narrative sent again within that time counts once; the state of both steps ends with the watermark.
    """
    once = stream.withWatermark("received_at", late).dropDuplicates(["narrative_id", "received_at"])
    rows = exploded(extract.extract(once, "narrative", drugs, reactions, True), F.col("reactions"), "r", "received_at")
    grouped = rows.groupBy(F.window("received_at", window).alias("w"), F.coalesce("r.drug", F.lit("<none>")).alias("drug"), F.col("r.reaction").alias("reaction"))
    return grouped.agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "drug", "reaction", "n")
