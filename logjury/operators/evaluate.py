"""Records x rules: every rule's answer on every record.

Each rule ends as matched, not matched or error. SQL NULL is the error state: a rule that cannot
be decided never matches. All rules of a set are evaluated in one projection; the answers are small
numbers in an array, of which the hits are exploded. What a rule is called is looked up in a
constant, so there is neither a join nor a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logjury.functions.predicates import java_pattern_problem, pattern_set_functions, register_functions
from logjury.operators.roots import ROOTS, with_roots
from logjury.operators.conditions import ConditionError, compiled
from logjury.operators.literals import FIELDS, LENGTHS, matcher, prepared
from logjury.operators.numbering import number
from logjury.operators.records import literal_rows
from logjury.operators.rules import RuleError, RuleSet
from logjury.schema import RECORD_FIELDS, RULE
from logjury.session import prepare, settled

NOT_MATCHED, MATCHED, UNDECIDED, WRONG_TYPE = 0, 1, 2, 3


@dataclass(frozen=True)
class Predicate:
    """A condition that passed analysis."""

    text: str
    kind: str  # bool, or what else the condition evaluates to
    broken: str | None = None  # why it can never be evaluated

    def state(self) -> Column:
        if self.broken is not None:
            return F.lit(WRONG_TYPE).cast("tinyint")
        value = F.expr(self.text)
        if self.kind == "bool":
            return F.coalesce(value.cast("tinyint"), F.lit(UNDECIDED).cast("tinyint"))
        return F.when(value.isNull(), F.lit(UNDECIDED)).otherwise(F.lit(WRONG_TYPE)).cast("tinyint")

    def error(self) -> str:
        return self.broken or f"no answer: condition is {self.kind}, not true or false"


UNDECIDED_ERROR = "no answer: condition is null"


@contextmanager
def _lenient(spark: SparkSession) -> Iterator[None]:
    """Analyse conditions without ANSI errors, so that bad data gives NULL and not a failed job."""
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def _kind(data_type: T.DataType) -> str:
    if isinstance(data_type, T.BooleanType):
        return "bool"
    if isinstance(data_type, T.StringType):
        return "string"
    if isinstance(data_type, T.IntegralType):
        return "int"
    if isinstance(data_type, T.ArrayType):
        return "array"
    if isinstance(data_type, T.NullType):
        return "null"
    return "object" if isinstance(data_type, (T.MapType, T.StructType)) else data_type.typeName()


def _sample(spark: SparkSession) -> DataFrame:
    """One empty record, evaluated on the driver without a job."""
    values = {
        name: F.lit("") if name != "attributes" else F.create_map(F.lit(""), F.lit(""))
        for name in RECORD_FIELDS
    }
    one = spark.sql("SELECT 1 AS one").select(*[c.alias(n) for n, c in values.items()])
    return with_roots(one).select(*ROOTS)


def compile_rules(spark: SparkSession, rule_set: RuleSet) -> tuple[list[Predicate], dict[str, str]]:
    """Analyse every condition once, and collect the addresses they look at; raise ``RuleError`` for one that is no expression.

    A condition that is an expression but cannot run (a malformed pattern) becomes a rule that
    reports an error on every record, as a rule that fails must not stop the others.
    """
    prepare(spark)
    register_functions(spark)
    for pattern_set in rule_set.pattern_sets if rule_set.conditions_enabled else ():
        for pattern in pattern_set.patterns if pattern_set.kind == "regex" else ():
            problem = java_pattern_problem(spark, pattern)
            if problem:
                raise RuleError(f"pattern set {pattern_set.name}: {problem}")
    for statement in pattern_set_functions(rule_set.patterns("contains"), rule_set.patterns("regex")):
        spark.sql(statement)
    sample = _sample(spark)
    addresses: dict[str, str] = {}
    own = frozenset(name.lower() for name in rule_set.functions)
    texts = {}
    for rule in rule_set.ordered_rules():
        try:
            texts[rule.name] = compiled(spark, sample, rule_set.condition_of(rule), addresses, own)
        except ConditionError as error:
            raise RuleError(f"rule {rule.name} {error}") from error
    sample = _with_addresses(sample, addresses)
    with _lenient(spark):
        try:
            analysed = sample.select(*[F.expr(t).alias(f"c{i}") for i, t in enumerate(texts.values())])
            types = [f.dataType for f in analysed.schema]
            runnable = _runs(analysed)
        except PySparkException:
            types, runnable = [_analyse(sample, n, t) for n, t in texts.items()], False
        predicates = []
        for text, data_type in zip(texts.values(), types, strict=True):
            broken = None
            if not runnable and not _runs(sample.select(F.expr(text).alias("c"))):
                broken = f"condition fails: {text}"
            predicates.append(Predicate(text, _kind(data_type), broken))
    return predicates, addresses


def _with_addresses(rooted: DataFrame, addresses: dict[str, str]) -> DataFrame:
    """The bits of every address that rules look at, as columns of a projection of their own."""
    return rooted.withColumns({name: F.expr(f"ip_bits({text})") for text, name in addresses.items()})


def _analyse(sample: DataFrame, name: str, text: str) -> T.DataType:
    try:
        return sample.select(F.expr(text).alias("c")).schema[0].dataType
    except (AnalysisException, PySparkException) as error:
        message = str(error).split("\n")[0]
        raise RuleError(f"rule {name} cannot be analysed: {message}") from error


def _runs(frame: DataFrame) -> bool:
    if not frame.columns:
        return True
    try:
        frame.collect()  # one literal row
    except Exception:
        return False
    return True


def evaluate(records: DataFrame, rule_set: RuleSet, hits_only: bool = False) -> DataFrame:
    """One row per record and rule: the record's columns plus ``rule_rank, condition, rule_id,
    tags, priority, matched, error``. ``hits_only`` drops what neither matched nor failed.

    Quarantined lines (``parse_error`` set) are no records and are left out.
    """
    spark = records.sparkSession
    predicates, addresses = compile_rules(spark, rule_set)
    if "parse_error" in records.columns:
        records = records.where(F.col("parse_error").isNull()).drop("raw_line")
    columns = records.columns
    if predicates:
        with _lenient(spark):
            states = F.array(*[p.state() for p in predicates])
            rooted = _with_addresses(with_roots(records), addresses)
            answered = rooted.select(*columns, states.alias("states"))
    else:
        answered = records.withColumn("states", F.array().cast("array<tinyint>"))
    answers = F.transform(
        "states", lambda state, rank: F.struct(rank.alias("rule_rank"), state.alias("state"))
    )
    if hits_only:  # before the explode, so a record without a hit makes no row at all
        answers = F.filter(answers, lambda answer: answer["state"] != NOT_MATCHED)
    exploded = answered.select(*columns, F.explode(answers).alias("answer"))
    state, rank = F.col("answer")["state"], F.col("answer")["rule_rank"]
    rule = F.get(_rule_literal(rule_set, predicates), rank)
    return exploded.select(
        *columns,
        rank.alias("rule_rank"),
        rule["condition"].alias("condition"),
        rule["rule_id"].alias("rule_id"),
        rule["tags"].alias("tags"),
        rule["priority"].alias("priority"),
        (state == MATCHED).alias("matched"),
        F.when(state == UNDECIDED, F.lit(UNDECIDED_ERROR))
        .when(state == WRONG_TYPE, rule["wrong_type"])
        .alias("error"),
    )


def _rule_literal(rule_set: RuleSet, predicates: list[Predicate]) -> Column:
    """The rules in order as one constant, so that attaching them needs no join."""
    rows = [
        {
            "condition": rule.name,
            "rule_id": rule.id,
            "tags": list(rule.tags),
            "priority": rule.priority,
            "wrong_type": predicate.error(),
        }
        for rule, predicate in zip(rule_set.ordered_rules(), predicates, strict=True)
    ]
    return literal_rows(
        rows, "condition string, rule_id string, tags array<string>, priority bigint, wrong_type string"
    )


# Rules that stand in one row of the table of rules; tests that tasks are sent at once.
LIST, TILE = 128, 1 << 20
# A row of rules is numbered by its test and, in so many bits, by its place among the rows of the test.
SHIFT = 24


def evaluate_table(records: DataFrame, rules: DataFrame) -> DataFrame:
    """Matches for rules kept in a table, for rule sets too large to write as text.

    A rule is a conjunction: ``(condition, source_eq, level_eq, service_eq, contains array)``, where
    NULL or an empty array means "any"; ``rule_id``, ``tags`` and ``priority`` may be given.

    Rules that test the same are one test. Tests are sent to the tasks, ``TILE`` at a time, and each record gets the
    numbers of the tests it passes, in one walk over its message (``literals``). Every test is keyed once: by a gram of
    up to 16 bytes of its longest literals, the one that fewest tests hold, else by its most telling equality (service,
    then source, then level), else by nothing, which all records have. Of a table of more than ``TILE`` tests the
    records are stored and walked once a tile, so the memory of a task does not grow with the table.

    The rules of a test are rows of ``LIST`` rules at most, which are joined by number and without a hint, as the last
    step: a row of the join is a record, a test it passes and a list, without a text that nobody asks for, and
    Catalyst broadcasts the lists while they are small. So rows grow with the answers, and not with records times rules.

    Quarantined lines are no records. The tests are null-safe, so a record without a level merely
    does not match; no rule of this form can fail, and ``error`` is always NULL.

    Output: that of ``evaluate(..., hits_only=True)``, ready for ``decide``. Ranks follow priority and
    name, as in a rule set.
    """
    if "parse_error" in records.columns:
        records = records.where(F.col("parse_error").isNull()).drop("raw_line")
    given = {
        "rule_id": F.lit(None).cast("string"),
        "tags": F.array().cast("array<string>"),
        "priority": F.lit(0).cast("bigint"),
    }
    rules = settled(rules.withColumns({name: c for name, c in given.items() if name not in rules.columns}))
    tests, lists = _tests_and_lists(number(rules, ["priority", "condition"], "rule_rank", start=0))
    passed = F.explode(F.sequence(F.lit(0), F.col("_test").bitwiseAND(F.lit((1 << SHIFT) - 1)) - 1)).alias("_list")
    found = _tested(records, tests).select(*records.columns, "_test", passed)
    at = F.shiftleft(F.shiftright("_test", SHIFT), SHIFT).bitwiseOR(F.col("_list").cast("long"))
    joined = found.withColumn("rule_key", at).alias("record").join(lists.alias("rule"), "rule_key")
    ruled = joined.select(*[F.col(f"record.{name}") for name in records.columns], F.explode("rule.rules").alias("_rule"))
    return ruled.select(
        *records.columns,
        *[F.col("_rule")[name].alias(name) for name in RULE.names],
        F.lit(True).alias("matched"),
        F.lit(None).cast("string").alias("error"),
    )


def _tests_and_lists(ranked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The different tests of rules with the gram that keys them, and the rules of each in lists."""
    literals = F.filter("contains", lambda part: F.octet_length(part) > 0)
    parts = F.array_sort(F.array_distinct(F.coalesce(literals, F.array().cast("array<string>"))))
    rule = F.struct(*[F.col(n).cast("int").alias(n) if n == "rule_rank" else F.col(n) for n in RULE.names])
    same = ["source_eq", "level_eq", "service_eq", "parts"]
    placed = ranked.select(rule.alias("rule"), *same[:-1], parts.alias("parts"))
    sizes = placed.groupBy(*same).agg(
        F.min("rule.rule_rank").cast("long").alias("test"), F.ceil(F.count("*") / LIST).cast("long").alias("lists")
    )
    tests = settled(sizes)
    one, other = placed.alias("one"), tests.alias("other")
    on = reduce(Column.__and__, [F.col(f"one.{name}").eqNullSafe(F.col(f"other.{name}")) for name in same])
    place = F.pmod(F.xxhash64("one.rule.rule_rank"), "other.lists")
    listed = one.join(other, on).select(F.shiftleft("other.test", SHIFT).bitwiseOR(place).alias("rule_key"), "one.rule")
    lists = settled(listed.groupBy("rule_key").agg(F.collect_list("rule").alias("rules")))
    return settled(_keyed(tests)), lists


def _keyed(tests: DataFrame) -> DataFrame:
    """Tests with ``gram``, which keys them, and ``rest``, the literals that it does not hold as a whole."""

    def length(part: Column) -> Column:
        size = F.octet_length(part)
        return reduce(lambda found, n: F.when(size >= n, F.lit(n)).otherwise(found), LENGTHS, F.lit(None).cast("int"))

    longest = tests.withColumn("length", F.array_max(F.transform("parts", length)))
    parts = longest.select("test", "length", F.explode(F.filter("parts", lambda part: length(part) == F.col("length"))).alias("part"))
    whole, bytes_ = F.octet_length("part") == F.col("length"), F.col("part").cast("binary")
    starts = F.sequence(F.lit(1), F.octet_length("part") - F.col("length") + 1)
    cut = F.array_distinct(F.transform(starts, lambda at: F.substring(bytes_, at, F.col("length"))))
    grams = parts.select("test", F.when(whole, F.col("part")).alias("whole"), F.explode(F.when(whole, F.array(bytes_)).otherwise(cut)).alias("gram"))
    spread = grams.groupBy("gram").agg(F.count("*").alias("tests"))
    # The gram that fewest tests hold; equal ones by hash, so that a test's choice is fixed.
    order = F.struct((-F.col("tests")).alias("few"), F.xxhash64("gram").alias("h"), F.col("whole").isNotNull().alias("w"))
    chosen = grams.join(spread, "gram").groupBy("test").agg(F.max_by(F.struct("gram", "whole"), order).alias("key"))
    rest = F.filter("parts", lambda part: ~part.eqNullSafe(F.col("key.whole")))
    return tests.join(chosen, "test", "left").select(
        "test", "lists", "key.gram", *[f"{name}_eq" for name in FIELDS], F.transform(rest, lambda part: part.cast("binary")).alias("rest")
    )


def _tested(records: DataFrame, tests: DataFrame) -> DataFrame:
    """A row for every record and test it passes, ``_test``: the number of the test and that of its lists."""
    spark = records.sparkSession
    facts = tests.agg(F.count("*").alias("tests"), F.count("gram").alias("grams")).first()
    tiles = max(1, -(-facts["tests"] // TILE))
    if tiles > 1 and not records.isStreaming:
        records = settled(records)
    match = matcher(SHIFT, facts["grams"] > 0)

    def walked(tile: DataFrame) -> DataFrame:
        shared = spark.sparkContext.broadcast(prepared(tile.toArrow()))

        @F.arrow_udf("array<bigint>")
        def passed(message: pa.Array, service: pa.Array, source: pa.Array, level: pa.Array) -> pa.Array:
            return match(shared.value, message, {"service": service, "source": source, "level": level})

        return records.withColumn("_test", F.explode(passed("message", *FIELDS)))

    parts = [walked(tests.where(F.pmod(F.xxhash64("test"), F.lit(tiles)) == k)) for k in range(tiles)]
    return reduce(DataFrame.unionAll, parts)
