"""Best representative of each duplicate group, chosen and filled field by field.

A record is a point of (completeness, trust, recency). One record dominates another when it is at least as
complete, is trusted at least as much and is at least as recent, and differs. Recency is (time, id), a total
order, so two records never tie in all. Completeness is the set of fields a record has a value for ("fields":
at least as complete means that it has every field the other has) or their number ("count").

The layers are computed in two mergeable steps. Among records of one group with the same set of fields
and the same trust only the most recent counts, and ``max`` keeps it on the map side: at most
2^fields x ranks records of a group are left however large the group is. Those few are then put into
dominance layers inside one array: layer 0 is undominated, a record of layer n is dominated by one of layer
n - 1. The lexicographic policy (trust, then recency) orders a layer; the first record of layer 0 survives, and
its missing fields are filled from the rest of its layer in that order, then from the next layers.

The two forms answer different questions. With sets, the best record by the policy that has a value for a field
is never dominated (whatever dominated it would have the field and rank before it), so each field comes from
its best row and from layer 0. With numbers a record may be dominated by one that has other fields; it then fills
what no record of the layers before it has, and a less trusted or older record of an earlier layer goes first.

Defined results: records with a null group key or id aren't in a group; null trust ranks last and null
time is oldest; ties end with the highest id; fields that no record has give no row; repeated rows change
nothing; an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Strings that stand in for a missing value, in any letter case.
STAND_INS = ("n/a", "-", "unknown", "null", "none", "?")
_LAST = 2**31 - 1


def skyline(df: DataFrame, group: Column, row_id: Column, fields: dict[str, Column], rank: Column, at: Column, completeness: str = "fields") -> DataFrame:
    """(group, group_id, n_rows, layers): the records of each group by dominance layer, then in order of the policy.

    ``fields`` says for each field whether a record has a value (boolean). ``completeness`` is "fields" (a set, as in
    the module's text) or "count" (how many fields have a value). An element has ``layer`` (0: undominated),
    ``rank`` (smaller is better), ``age`` and ``no`` (time and id, negated), ``id`` and ``mask`` (bit i: the i-th field).
    """
    mask = sum((F.when(F.coalesce(has, F.lit(False)), F.lit(1 << i)).otherwise(0) for i, has in enumerate(fields.values())), F.lit(0))
    rows = df.select(
        group.alias("g"), row_id.cast("long").alias("id"), mask.cast("int").alias("mask"), F.coalesce(rank.cast("int"), F.lit(_LAST)).alias("rank"),
        F.coalesce(F.unix_micros(at.cast("timestamp")), F.lit(-(2**62))).alias("at"),
    ).where("g is not null and id is not null")
    few = rows.groupBy("g", "mask", "rank").agg(F.max(F.struct("at", "id")).alias("top"), F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    point = F.struct("rank", (-F.col("top.at")).alias("age"), (-F.col("top.id")).alias("no"), F.col("top.id").alias("id"), "mask")
    held = few.groupBy("g").agg(F.min("first").alias("group_id"), F.sum("n").alias("n_rows"), F.array_sort(F.collect_list(point)).alias("p"))
    # In the policy's order a record is at least as good as all behind it except in recency and completeness, so only records before it can dominate it.
    as_complete = {"fields": "(a.mask & b.mask) = b.mask", "count": "bit_count(a.mask) >= bit_count(b.mask)"}[completeness]
    before = f"filter(done, a -> {as_complete} and (a.age < b.age or (a.age = b.age and a.no <= b.no)))"
    layered = F.expr(f"""aggregate(p, cast(array() as array<struct<layer: int, rank: int, age: bigint, no: bigint, id: bigint, mask: int>>),
        (done, b) -> concat(done, array(struct(1 + coalesce(array_max(transform({before}, a -> a.layer)), -1) as layer, b.rank as rank, b.age as age, b.no as no, b.id as id, b.mask as mask))))""")
    return held.select(F.col("g").alias("group"), "group_id", "n_rows", F.array_sort(layered).alias("layers"))


def fill_sources(sky: DataFrame, names: list[str], least: int = 2, layer: bool = False) -> DataFrame:
    """(group_id, field_name, from_id): the record that gives each field, for groups of at least ``least`` records; with ``layer`` also the layer it stands in."""
    per_field = F.array(*(F.expr(f"struct('{n}' as field_name, filter(layers, r -> (r.mask & {1 << i}) <> 0) as having)") for i, n in enumerate(names)))
    out = sky.where(F.col("n_rows") >= least).select("group_id", F.explode(per_field).alias("f"))
    return out.where(F.size("f.having") > 0).select("group_id", "f.field_name", F.expr("f.having[0].id").alias("from_id"), *([F.expr("f.having[0].layer").alias("layer")] if layer else []))


def usable(text: Column) -> Column:
    """Whether a string is a value: neither blank nor a stand-in."""
    bare = F.lower(F.regexp_replace(text, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return text.isNotNull() & (bare != "") & ~bare.isin(*STAND_INS)


def json_fields(text: Column, keys: list[str]) -> dict[str, Column]:
    """For each key whether a JSON object text has a value for it.

    None has one where the text isn't valid as a whole or names a key twice.
    """
    # The parser stops after the first value, so the text is wrapped: what follows the object then makes the whole invalid.
    whole = F.when(F.rtrim(text).endswith("}"), F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))))
    alone = F.try_variant_get(whole, "$[1]", "variant").isNull()
    out = {}
    for k in keys:
        path = f"$[0].{k}"
        kind = F.schema_of_variant(F.try_variant_get(whole, path, "variant"))
        as_text = F.try_variant_get(whole, path, "string")
        empty = F.when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), as_text.isin("[]", "{}")).otherwise(~usable(as_text) & (kind == "STRING"))
        out[k] = alone & as_text.isNotNull() & ~F.coalesce(empty, F.lit(False))
    return out
