"""Rules, groups and generations kept in tables: conditions folded from fragments, records by generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logjury.functions.text import is_blank
from logjury.session import settled

_FRAGMENT = "array<struct<when: string, merge: string>>"


def _fragments(when: Column, merge: Column, conditions: Column | None = None) -> Column:
    """The fragments of a group or rule in order: its own condition, then the listed ones."""
    own = F.when(when.isNotNull(), F.array(F.struct(when.alias("when"), merge.alias("merge"))))
    found = F.coalesce(own, F.array()).cast(_FRAGMENT)
    if conditions is None:
        return found
    listed = F.transform(conditions, lambda f: F.struct(f["when"].alias("when"), f["merge_condition_as"].alias("merge")))
    return F.concat(found, F.coalesce(listed.cast(_FRAGMENT), F.array().cast(_FRAGMENT)))


def _folded(fragments: Column) -> Column:
    """``(text, overrides)``: the fragments folded from left to right."""

    def step(done: Column, fragment: Column) -> Column:
        override = fragment["merge"] == "override"
        # A comment at the end must not take in what follows.
        own = F.concat(fragment["when"], F.when(F.contains(fragment["when"], F.lit("--")), F.lit("\n")).otherwise(F.lit("")))
        wrapped = F.concat(F.lit("("), own, F.lit(")"))
        joiner = F.when(fragment["merge"] == "or", F.lit(" OR ")).otherwise(F.lit(" AND "))
        joined = F.concat(F.lit("("), done["text"], F.lit(")"), joiner, wrapped)
        return F.struct(
            F.when(done["text"].isNull() | override, wrapped).otherwise(joined).alias("text"),
            (done["overrides"] + override.cast("int")).alias("overrides"),
        )

    start = F.struct(F.lit(None).cast("string").alias("text"), F.lit(0).alias("overrides"))
    return F.aggregate(fragments, start, step)


def merged_conditions(rules: DataFrame, groups: DataFrame) -> DataFrame:
    """``(name, condition, error)`` of rules kept in a table; the text is what ``RuleSet.condition_of`` makes.

    ``rules`` has ``name, when, groups, merge_condition_as`` and may have ``rule_groups``, groups known to the rule
    alone, which hide shared groups of the same name; a group is ``name, when, merge_condition_as, conditions``. The
    fragments of a rule's groups in listed order and its own condition are one array, folded by one expression. A rule
    that names a missing group, has a blank fragment or more than one override has no condition but an error.

    Groups join by name, without a hint: many rules that name one group meet in a join that Catalyst broadcasts or
    splits. Only a rule's own fragments come together.
    """
    shared = groups.select(
        F.col("name").alias("group"), _fragments(F.col("when"), F.col("merge_condition_as"), F.col("conditions")).alias("parts")
    )
    local = F.array().cast("array<struct<name: string, parts: array<struct<when: string, merge: string>>>>")
    if "rule_groups" in rules.columns:
        local = F.coalesce(
            F.transform(
                "rule_groups",
                lambda g: F.struct(g["name"].alias("name"), _fragments(g["when"], g["merge_condition_as"], g["conditions"]).alias("parts")),
            ),
            local,
        )
    own = rules.select(
        "name", _fragments(F.col("when"), F.col("merge_condition_as")).alias("last"),
        F.coalesce("groups", F.array().cast("array<string>")).alias("groups"), local.alias("local"),
    )
    named = own.select("name", "local", F.posexplode("groups").alias("place", "group"))
    found = named.join(shared, "group", "left")
    hidden = F.get(F.filter("local", lambda g: g["name"] == F.col("group")), F.lit(0))["parts"]
    parts = F.coalesce(hidden, F.col("parts"))
    gathered = found.groupBy("name").agg(
        F.array_sort(F.collect_list(F.struct("place", "group", parts.alias("parts")))).alias("found")
    )
    joined = own.join(gathered, "name", "left")
    listed = F.coalesce("found", F.array().cast(gathered.schema["found"].dataType))
    missing = F.get(F.filter(listed, lambda g: g["parts"].isNull()), F.lit(0))["group"]
    every = F.concat(F.flatten(F.transform(F.filter(listed, lambda g: g["parts"].isNotNull()), lambda g: g["parts"])), "last")
    blank = F.exists("every", lambda f: F.coalesce(is_blank(f["when"]), F.lit(True)))
    error = (
        F.when(F.col("missing").isNotNull(), F.concat(F.lit("no such group: "), "missing"))
        .when(blank, F.lit("empty condition"))
        .when(F.col("folded.overrides") > 1, F.lit("more than one override"))
    )
    folded = joined.select("name", missing.alias("missing"), every.alias("every")).withColumn("folded", _folded(F.col("every")))
    text = F.when(error.isNull(), F.coalesce("folded.text", F.lit("true")))
    return folded.select("name", text.alias("condition"), error.alias("error"))


def at_generation(records: DataFrame, generations: DataFrame, time: Column, name: str = "generation") -> DataFrame:
    """The records with the generation of rules that was valid at their time, or NULL before the first one.

    ``generations`` is ``(generation, valid_from)``, of the type of ``time``; of several that begin at one time the
    greatest counts. A record without a time has no generation.

    Both tables are sorted together by time in ranges, a record behind the generations of its time. Records
    of one time are split by a hash, so a time that a third of them share is many tasks. Within a range the last
    generation is carried forward; what a range begins with is known from one row per range.
    """
    begun = generations.groupBy(F.col("valid_from").alias("_at")).agg(F.max("generation").alias("_new"))
    marks = begun.where(F.col("_at").isNotNull()).select("_at", "_new", F.lit(None).cast(records.schema).alias("_row"))
    rows = records.select(
        time.alias("_at"), F.lit(None).cast(begun.schema["_new"].dataType).alias("_new"), F.struct(*records.columns).alias("_row")
    )
    plain = [f"_row.{f.name}" for f in records.schema if "map<" not in f.dataType.simpleString()]
    both = rows.union(marks).withColumns({"_is": F.col("_row").isNotNull(), "_deal": F.xxhash64(*plain)})
    order = ["_at", "_is", "_deal"]
    placed = settled(both.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    # One row per range.
    last = placed.groupBy("_part").agg(F.max_by("_new", F.when(F.col("_new").isNotNull(), F.col("_at"))).alias("_last"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("_part", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    inside = Window.partitionBy("_part").orderBy(*order)
    found = F.last("_new", ignorenulls=True).over(inside)
    filled = placed.withColumn("_found", found).where(F.col("_is")).join(F.broadcast(carried), "_part")
    known = F.when(F.col("_at").isNotNull(), F.coalesce("_found", "_carried"))
    return filled.select("_row.*", known.alias(name))
