"""Nested records into related flat tables by Dewey labels.

Every node of a record gets the path of ordinals that leads to it (its Dewey label, as ``1.0.2``). The label of a
parent is the label without its last ordinals, so links need no state; nodes of the same schema path (the path with
its ordinals removed) form one flat table.

Defined results:

* a payload that is null, empty, cut off or no JSON object gives one row in ``broken`` and no nodes;
* a single value in the place of a list is its element 0; a list may be encoded as text, again to any depth;
* null elements keep their number and are marked ``is_null``; an empty list gives no node;
* member names are compared without case and punctuation; lists and objects whose names then coincide are taken as one
  list, in order; of scalar members all are kept, the second named ``name#2``, and a table's column has the first not null;
* several objects in the place of one (openfda) are all walked: their paths are ``openfda``, ``openfda#1``, ...;
* repeated rows give their nodes once; further columns of the input are not looked at, whatever their names.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narravig.functions.arrowmap import flat_map

OPENFDA = ("brand_name", "generic_name", "substance_name", "manufacturer_name", "route", "product_type")
#: Members that are lists, each with the members of its elements; None: the elements' lists aren't declared.
RECORD = {
    "openfda": {k: [] for k in OPENFDA},
    "adverse_reactions": [{"items": [{}]}],
    "drugs": [{"openfda": {k: [] for k in OPENFDA}, "reactions": [{}]}],
    "reactions": [{}],
}
#: Schema paths that p2_found reports.
FOUND = (
    "adverse_reactions[]",
    "adverse_reactions[].items[]",
    "drugs[]",
    "drugs[].reactions[]",
    "reactions[]",
    *(f"{at}openfda.{k}[]" for at in ("", "drugs[].") for k in ("brand_name", "generic_name", "substance_name", "route")),
)
NODES = (
    "key long, dewey string, node_path string, schema_path string, pos long, is_null boolean, value string, "
    "fields map<string,string>, broken string"
)


def fold(name: str) -> str:
    return re.sub(r"[^a-z0-9]", "", name.lower())


def _decoded(value):
    """A list or object encoded as text, decoded; other values as they are."""
    while isinstance(value, str) and value.lstrip()[:1] in ("[", "{"):
        try:
            value = json.loads(value)
        except (ValueError, RecursionError):
            return value
    return value


def _scalar(value) -> str | None:
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value, ensure_ascii=False)


class Walker:
    """Yields the nodes of one payload under a shape such as RECORD."""

    def __init__(self, shape: dict):
        self.shape = shape
        self.known = {fold(k) for k in shape}

    def records(self, value) -> list[dict]:
        """The records in a payload, whatever wraps them."""
        level = [value]
        while level:
            found = [v for v in level if isinstance(v, dict) and self.known & {fold(k) for k in v}]
            if found:
                return found
            level = [
                _decoded(w)
                for v in level
                for w in (v.values() if isinstance(v, dict) else v if isinstance(v, list) else ())
                if isinstance(_decoded(w), (dict, list))
            ]
        return []

    def members(self, obj: dict) -> dict[str, list[tuple[int, str, object]]]:
        """Ordinal, name and value of the members, by folded name."""
        out: dict[str, list[tuple[int, str, object]]] = {}
        for i, (name, value) in enumerate(obj.items()):
            out.setdefault(fold(name), []).append((i, name, value))
        return out

    def scalar(self, members: dict, name: str) -> str | None:
        """The first not null of the members of that name."""
        return _scalar(next((v for _, _, v in members.get(fold(name), ()) if v is not None), None))

    def walk(self, obj: dict, shape: dict, dewey: str, path: str, schema: str) -> Iterator[tuple]:
        members = self.members(obj)
        for name, inner in shape.items():
            own = [(ordinal, _decoded(value)) for ordinal, _, value in members.get(fold(name), ())]
            if isinstance(inner, dict):
                # each object, with the label of where it stands; one alone in its place adds no ordinal
                held = [(f"{o}.{k}" if len(v) > 1 else f"{o}", _decoded(w)) for o, v in ((o, v if isinstance(v, list) else [v]) for o, v in own) for k, w in enumerate(v)]
                for n, (at, value) in enumerate((a, v) for a, v in held if isinstance(v, dict)):
                    yield from self.walk(value, inner, f"{dewey}{at}.", f"{path}{name}{f'#{n}' if n else ''}.", f"{schema}{name}.")
                continue
            elements = [(f"{dewey}{o}.{k}", w) for o, v in own if v is not None for k, w in enumerate(v if isinstance(v, list) else [v])]
            for i, (here, element) in enumerate(elements):
                element = _decoded(element)
                at, to = f"{path}{name}[{i}]", f"{schema}{name}[]"
                sub = inner[0] if inner else {}
                fields = None
                if isinstance(element, dict):
                    lists = {fold(k) for k in sub}
                    fields = [(f"{n.lower()}#{j}" if j > 1 else n.lower(), _scalar(v)) for n, j, v in self._scalars(element, lists)]
                yield here, at, to, i, element is None, None if fields is not None else _scalar(element), fields
                if fields is not None:
                    yield from self.walk(element, sub, f"{here}.", f"{at}.", f"{to}.")

    def _scalars(self, obj: dict, lists: set[str]) -> Iterator[tuple[str, int, object]]:
        """Name, number among the members of that name, and value; a null where another has a value comes behind it."""
        for folded, own in self.members(obj).items():
            if folded not in lists:
                name = own[0][1]
                for j, (_, n, v) in enumerate(sorted(own, key=lambda m: m[2] is None), 1):
                    yield n if len(own) == 1 else name, j, v

    def roots(self, payload: str | None, fields: list[str], person: list[str]) -> Iterator[tuple]:
        """Label, path, number, ``fields`` and the patient's ``person`` of each record of a complete payload."""
        try:
            value = json.loads(payload) if payload is not None else None
            # a record may hold nothing but its scalar members
            records = (self.records(value) or Walker({f: [] for f in (*fields, "patient")}).records(value)) if isinstance(value, dict) else []
        except (ValueError, RecursionError):
            return
        for n, record in enumerate(records):
            members = self.members(record)
            told: dict = {}
            for _, _, patient in members.get("patient", ()):
                patient = _decoded(patient)
                for one in patient if isinstance(patient, list) else [patient]:
                    for name, own in self.members(one).items() if isinstance(one, dict) else ():
                        told.setdefault(name, []).extend(own)
            at = (f"1.0.{n}", f"results[{n}]") if n else ("0", "$")
            yield *at, n, *(self.scalar(members, f) for f in fields), *(self.scalar(told, f) for f in person)

    def __call__(self, key, payload) -> Iterator[tuple]:
        why = None
        try:
            value = json.loads(payload) if payload is not None else None
            if payload is None or not payload.strip():
                why = "empty"
            elif not isinstance(value, dict):
                why = "no object"
        except (ValueError, RecursionError):
            why = "empty" if not payload.strip() else "malformed"
        if why:
            yield key, None, None, None, None, None, None, None, why
            return
        try:
            records = self.records(value)
            nodes = [
                row
                for n, record in enumerate(records)
                for row in self.walk(record, self.shape, f"1.0.{n}." if n else "0.", f"results[{n}]." if n else "", "results[]." if n else "")
            ]
        except RecursionError:
            yield key, None, None, None, None, None, None, None, "too deep"
            return
        for row in nodes:
            yield key, *row, None


def nodes(df: DataFrame, key: str | Column, payload: str | Column, shape: dict = RECORD) -> DataFrame:
    """The labelled nodes of every payload, with parent links; see the module for the defined cases."""
    key = F.col(key) if isinstance(key, str) else key
    payload = F.col(payload) if isinstance(payload, str) else payload
    raw = flat_map(df, [key.cast("long").alias("key"), payload.alias("payload")], lambda: Walker(shape), NODES)
    # the nearest enclosing list element is the path cut after its last bracket but one
    above = F.regexp_extract("node_path", r"^(.*\])\.[^\]]*\[\d+\]$", 1)
    depth = F.when(above == "", 1).otherwise(F.size(F.split(above, r"[.\[]")) + 1)
    return raw.withColumns(
        {
            "parent_path": F.when(above == "", "$").otherwise(above),
            "parent_dewey": F.array_join(F.slice(F.split("dewey", r"\."), F.lit(1), depth), "."),
        }
    )


def roots(df: DataFrame, key: str, payload: str, fields: list[str], person: list[str]) -> DataFrame:
    """The root table: key, dewey and node_path (the parent's of a record's elements), pos, scalar members and the patient's."""
    schema = "key long, dewey string, node_path string, pos long, " + ", ".join(f"{f} string" for f in (*fields, *person))

    def make():
        walker = Walker(RECORD)
        return lambda k, text: ((k, *row) for row in walker.roots(text, fields, person))

    return flat_map(df, [F.col(key).cast("long").alias("key"), payload], make, schema).distinct()


def table(labelled: DataFrame, schema_path: str, fields: list[str]) -> DataFrame:
    """The flat table of one schema path, in any record of the payload: key, own label, parent's label, position and the named scalar members."""
    own = labelled.where(F.col("schema_path").isin(schema_path, f"results[].{schema_path}") & ~F.col("is_null"))
    return own.select(
        "key", "dewey", "parent_dewey", "parent_path", "node_path", "pos", "value", *(F.col("fields")[f].alias(f) for f in fields)
    ).distinct()


def found(labelled: DataFrame) -> DataFrame:
    """record_id, parent_path, node_path of each element that is no null, once."""
    kept = labelled.where(F.col("schema_path").isin(*FOUND) & ~F.col("is_null"))
    return kept.select(F.col("key").alias("record_id"), "parent_path", "node_path").distinct()
