"""Extraction by outside models, behind one interface; no network here, clients are given by the caller.

A provider only ever sees redacted text. Its answers are rows; failures become rows with an error, never exceptions.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narravig.functions.arrowmap import flat_map
from narravig.operators.deid import redact

#: Characters of redacted text that the entity model is given: its interface takes no more.
NER_CHARS = 2000
EXTRACTION = (
    "struct<drugs:array<struct<name:string,dose:string,route:string,indication:string>>,"
    "reactions:array<struct<reaction:string,severity:string,onset:string,outcome:string,drug:string>>,"
    "patient:struct<age:string,sex:string,relevant_history:string>,causality:string,overall_severity:string,notes:string>"
)


class Provider:
    """``client`` is a picklable function from redacted text to the model's answer; None means not available."""

    def __init__(self, client: Callable[[str], object] | None, chars: int | None = None):
        self.client, self.chars = client, chars

    def available(self) -> bool:
        return self.client is not None

    def _given(self, df: DataFrame, text: str):
        given = redact(F.col(text))
        return F.substring(given, 1, self.chars) if self.chars else given

    def answers(self, df: DataFrame, key: str, text: str) -> DataFrame:
        """key, answer (JSON text), error for every row with text."""
        client = self.client
        kind = df.schema[key].dataType.simpleString()

        def make():
            def rows(k, t):
                if client is None:
                    yield k, None, "not available"
                    return
                try:
                    answer = client(t)
                    yield k, answer if isinstance(answer, str) else json.dumps(answer), None
                except Exception as e:
                    yield k, None, str(e) or type(e).__name__

            return rows

        asked = df.where(F.col(text).isNotNull()).select(F.col(key), self._given(df, text).alias("given"))
        return flat_map(asked, [key, "given"], make, f"`{key}` {kind}, answer string, error string")


def extractions(provider: Provider, df: DataFrame, key: str, text: str) -> DataFrame:
    """key, extraction, error as in ai_extractions, from a model that answers with an extraction as JSON."""
    got = provider.answers(df, key, text)
    parsed = F.from_json("answer", EXTRACTION)
    bad = F.col("error").isNull() & (parsed.isNull() | F.to_json(parsed).isin("{}"))
    return got.select(key, parsed.alias("extraction"), F.when(bad, "malformed answer").otherwise(F.col("error")).alias("error"))


def entities(provider: Provider, df: DataFrame, key: str, text: str) -> DataFrame:
    """key, entities (seq, word, entity_group), error, from a model that answers with a list of entities as JSON."""
    got = provider.answers(df, key, text)
    listed = F.from_json("answer", "array<struct<word:string,entity_group:string,entity:string>>")
    made = F.transform(listed, lambda e, i: F.struct(i.alias("seq"), e["word"].alias("word"), F.coalesce(e["entity_group"], e["entity"], F.lit("")).alias("entity_group")))
    return got.select(key, made.alias("entities"), "error")


def route(df: DataFrame, engine: str) -> DataFrame:
    """``df`` with ``provider``: the entity model where it is asked for by name, the language model for anything else."""
    return df.withColumn("provider", F.when(F.col(engine) == "huggingface", "entities").otherwise("extractions"))


#: What runs each provider that ``route`` names.
ROUTES = {"entities": entities, "extractions": extractions}
#: Setting that names the client of a provider as ``module:function``; the function must be importable on the executors.
CLIENT_CONF = "spark.narravig.client."


def configured(spark: SparkSession) -> dict[str, Provider]:
    """The providers by the session's settings; one without a client isn't available. A client that can't be imported is an error."""
    out = {}
    for name, chars in (("entities", NER_CHARS), ("extractions", None)):
        where = spark.conf.get(f"{CLIENT_CONF}{name}", None)
        client = None
        if where:
            module, _, function = where.partition(":")
            client = getattr(importlib.import_module(module), function)
        out[name] = Provider(client, chars)
    return out
