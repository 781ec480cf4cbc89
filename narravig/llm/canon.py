"""Freely typed values to the entry of a reference list that is meant, with DataFrame expressions only.

Each distinct value is cleaned (case, accents, digits for letters, list marks, brackets, qualifiers) into a few variants
without spaces: as it stands, without qualifiers, and with the part after a comma moved to the front. All variants go
through a pigeonhole join: an entry is cut into k+1 segments, and a variant within k edits of it must hold one of them,
unchanged, at a place that the edits left and right of it allow. So the join is an equality join on (length, segment
number, text); the built-in levenshtein then verifies. Two further rules name entries that edits can't reach: one with
the same words in another order, and the one entry that a variant is the beginning of (half of it or more). No edits come
before word order, word order before beginnings, and these before the fewest edits; where two entries tie, none is meant.
Values without entry come from an anti-join and are reported with an empty canonical.

k grows with the entry's length: 0 for one letter, 1 up to 5, 2 up to 7, 3 up to 10, then 4.

Defined results: null and blank values give no row; values that equal an entry but for case and spaces give none
either; equal values get equal results; repeated rows are reported once; an empty list leaves every value unmatched;
values of any length are read whole, and one longer than every entry by more than its k is unmatched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narravig.sources.tables import cut

ACCENTED, PLAIN = "àáâãäåāèéêëēėęìíîïīòóôõöøōùúûüūñńçćčšśžźżýÿłđ", "aaaaaaaeeeeeeeiiiiiooooooouuuuunncccsszzzyyld"
#: Words that qualify a term without changing which is meant, by list.
QUALIFIERS = {
    "reaction": (
        "severe mild moderate serious acute chronic ongoing some slight persistent recurrent intermittent occasional worsening new "
        "resolved resolving recovered improved nos again suspected possible probable left right bilateral onset patient reports had has"
    ).split(),
    "drug": (
        "hydrochloride hcl maleate sodium potassium sulfate sulphate phosphate acetate citrate tartrate mesylate besylate calcium tablets tablet "
        "tabs tab capsules capsule caps cap xr er sr cr ir generic brand film coated injection syrup oral solution"
    ).split(),
}
#: Values that make up more than 1/HOT of all rows are joined apart; there are fewer than HOT of them.
HOT = 64


def plain(value: Column) -> Column:
    """Case and surplus spaces folded, as for equality with an entry."""
    return F.trim(F.regexp_replace(F.lower(value), r"(?U)\s+", " "))


def cleaned(value: Column) -> Column:
    """Letters and single spaces, a comma kept; list marks, brackets at the end, amounts and periods removed."""
    v = F.translate(plain(value), ACCENTED, PLAIN)
    v = F.regexp_replace(v, r"^\d+[.)]\s*", "")
    v = F.regexp_replace(v, r"(?<=[a-z])0|0(?=[a-z])", "o")
    v = F.regexp_replace(v, r"(?<=[a-z])1|(?<![0-9])1(?=[a-z])", "l")
    v = F.regexp_replace(v, r"^[^a-z0-9]+|[^a-z0-9]+$", "")
    v = F.regexp_replace(v, r"\s*[(\[][^)\]]*[)\]]?$", "")
    v = F.regexp_replace(v, r"\s+(x|for)?\s*\d+\s*(days?|weeks?|months?|hours?|h|d)$", "")
    v = F.regexp_replace(v, r"\s*\d+([.,]\d+)?\s*(mg|mcg|ug|g|ml|iu)\b", "")
    v = F.regexp_replace(v, r"[^a-z,]+", " ")
    return F.trim(F.regexp_replace(v, r"\s*,[\s,]*", ","))


def _without(v: Column, words: list[str]) -> Column:
    out = F.regexp_replace(v, rf"\b({'|'.join(words)})\b", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r" *,[ ,]*", ","), r"^[ ,]+|[ ,]+$|(?<= ) +", ""))


def _turned(v: Column) -> Column:
    """What follows the last comma, then what precedes it."""
    return F.regexp_replace(v, r"^(.*),([^,]+)$", "$2 $1")


def _squeezed(v: Column) -> Column:
    return F.regexp_replace(v, "[^a-z]", "")


def _bag(v: Column) -> Column:
    return F.array_join(F.array_sort(F.split(F.regexp_replace(v, "[, ]+", " "), " ")), " ")


def _k(length: Column) -> Column:
    return F.when(length <= 1, 0).when(length <= 5, 1).when(length <= 7, 2).when(length <= 10, 3).otherwise(4)


def references(entries: DataFrame) -> DataFrame:
    """list, canonical, and its keys, from entries(list, canonical)."""
    e = entries.where(F.col("canonical").isNotNull()).distinct()
    e = e.withColumn("spaced", F.trim(F.regexp_replace(F.translate(plain(F.col("canonical")), ACCENTED, PLAIN), "[^a-z]+", " ")))
    return e.withColumns({"ref": _squeezed(F.col("spaced")), "bag": _bag(F.col("spaced"))}).where("ref <> ''")


def variants(values: DataFrame) -> DataFrame:
    """list, value, spaced, typed: the ways in which each of values(list, value) may be meant, with and without spaces."""
    v = values.withColumn("c", cleaned(F.col("value")))
    bare = F.lit(None).cast("string")
    for name, words in QUALIFIERS.items():
        bare = F.when(F.col("list") == name, _without(F.col("c"), words)).otherwise(bare)
    v = v.withColumn("bare", F.coalesce(bare, F.col("c")))
    ways = F.array_distinct(F.array("c", "bare", _turned(F.col("bare"))))
    v = v.select("list", "value", F.explode(ways).alias("spaced"))
    v = v.withColumn("spaced", F.trim(F.regexp_replace("spaced", "[, ]+", " ")))
    return v.withColumn("typed", _squeezed(F.col("spaced"))).where("typed <> ''")


def _reordered(v: DataFrame, refs: DataFrame) -> DataFrame:
    """list, value, canonical of variants with the words of an entry in another order."""
    bags = v.select("list", "value", _bag(F.col("spaced")).alias("bag"))
    return bags.join(refs.select("list", "bag", "canonical"), ["list", "bag"]).select("list", "value", "canonical")


def _begun(v: DataFrame, refs: DataFrame) -> DataFrame:
    """list, value, canonical of variants that are the beginning, half or more, of one entry only."""
    size = F.length("spaced")
    starts = refs.select("list", "canonical", "spaced", F.explode(F.sequence(F.lit(5), F.greatest(F.lit(5), size - 1))).alias("n"))
    starts = starts.where((F.col("n") < size) & (F.col("n") * 2 >= size))
    starts = starts.select("list", "canonical", F.rtrim(F.substring("spaced", F.lit(1), F.col("n"))).alias("spaced")).distinct()
    alone = starts.groupBy("list", "spaced").agg(F.count("*").alias("many"), F.first("canonical").alias("canonical")).where("many = 1")
    return v.join(alone, ["list", "spaced"]).select("list", "value", "canonical")


def _segments(refs: DataFrame) -> DataFrame:
    """list, size, part, text, ref, canonical: the k+1 segments of each entry, as equal in length as may be."""
    r = refs.withColumn("size", F.length("ref")).withColumn("k", _k(F.col("size")))
    r = r.where("size > k").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("k"))))
    from_, to = (F.floor((F.col("part") + d) * F.col("size") / (F.col("k") + 1)).cast("int") for d in (0, 1))
    return r.select("list", "size", "k", "part", F.substring("ref", from_ + 1, to - from_).alias("text"), "ref", "canonical")


def _near(v: DataFrame, refs: DataFrame) -> DataFrame:
    """list, typed, canonical, edits of the entries within k edits of each distinct variant."""
    v = v.select("list", "typed").distinct().withColumn("n", F.length("typed"))
    # entry sizes that may match, with the segments' places; the shift of a segment is bound from both sides
    v = v.withColumn("size", F.explode(F.sequence(F.greatest(F.lit(1), F.col("n") - 4), F.col("n") + 4)))
    v = v.withColumn("k", _k(F.col("size"))).withColumn("d", F.col("n") - F.col("size")).where("abs(d) <= k AND size > k")
    v = v.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("k"))))
    low = F.greatest(-F.col("part"), F.col("d") - (F.col("k") - F.col("part")))
    high = F.least(F.col("part"), F.col("d") + (F.col("k") - F.col("part")))
    v = v.withColumns({"low": low, "high": high}).where("low <= high")
    v = v.withColumn("shift", F.explode(F.sequence(F.col("low"), F.col("high"))))
    from_, to = (F.floor((F.col("part") + d) * F.col("size") / (F.col("k") + 1)).cast("int") for d in (0, 1))
    v = v.withColumn("start", from_ + F.col("shift")).where((F.col("start") >= 0) & (F.col("start") + (to - from_) <= F.col("n")))
    probes = v.select("list", "typed", "size", "k", "part", F.substring("typed", F.col("start") + 1, to - from_).alias("text"))
    pairs = probes.join(_segments(refs).drop("k"), ["list", "size", "part", "text"])
    pairs = pairs.select("list", "typed", "ref", "canonical", "k").distinct()
    return pairs.withColumn("edits", F.levenshtein("typed", "ref")).where("edits <= k").select("list", "typed", "canonical", "edits").distinct()


def known_values(values: DataFrame, entries: DataFrame) -> DataFrame:
    """list, value, canonical of the distinct values(list, value) that name an entry; '' where several tie."""
    refs = references(entries)
    v = cut(variants(values))
    near = v.select("list", "value", "typed").join(_near(v, refs), ["list", "typed"])
    rank = lambda df, rank, edits: df.select("list", "value", F.struct(rank.alias("rank"), edits.alias("edits"), "canonical").alias("way"))
    every = rank(near, F.when(F.col("edits") == 0, 0).otherwise(3), F.col("edits"))
    for n, rule in ((1, _reordered), (2, _begun)):
        every = every.unionByName(rank(rule(v, refs), F.lit(n), F.lit(0)))
    best = every.groupBy("list", "value").agg(F.min("way").alias("best"), F.collect_set("way").alias("all"))
    tied = F.filter("all", lambda w: (w["rank"] == F.col("best.rank")) & (w["edits"] == F.col("best.edits")))
    return best.select("list", "value", F.when(F.size(tied) == 1, F.col("best.canonical")).otherwise("").alias("canonical"))


def resolve(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """field, row_id, pos, canonical for rows(field, list, row_id, pos, value) that equal no entry."""
    own = entries.select("list", plain(F.col("canonical")).alias("folded")).distinct()
    rows = rows.select("field", "list", "row_id", "pos", "value").where(~F.col("value").rlike(r"(?U)^\s*$"))
    rows = rows.withColumn("folded", plain(F.col("value"))).join(own, ["list", "folded"], "left_anti")
    counted = cut(rows.groupBy("list", F.col("folded").alias("value")).agg(F.count("*").alias("n")))
    total = counted.agg(F.sum("n")).first()[0] or 0
    known = cut(known_values(counted.select("list", "value"), entries).join(counted, ["list", "value"]))
    missing = counted.join(known.select("list", "value"), ["list", "value"], "left_anti").withColumn("canonical", F.lit(""))
    mapped = known.unionByName(missing).select("list", F.col("value").alias("folded"), "canonical", "n")
    hot = F.broadcast(mapped.where(F.col("n") * HOT > total).drop("n"))
    keys = ["list", "folded"]
    out = ["field", F.col("row_id").cast("long"), F.col("pos").cast("long").alias("pos"), "canonical"]
    common = rows.join(hot, keys).select(*out)
    others = rows.join(hot, keys, "left_anti").join(mapped.where(F.col("n") * HOT <= total).drop("n"), keys).select(*out)
    return common.unionByName(others).distinct()
