"""Matched rules to decisions: handlers, actions, order, numbering, the latest ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logjury.operators.evaluate import evaluate
from logjury.operators.numbering import number
from logjury.operators.records import literal_rows
from logjury.operators.rules import RuleSet, action_rows
from logjury.schema import ACTION, CALLBACK_INTENT, ORDER_KEY

HANDLES = f"struct<handler_rank: int, handler: string, actions: array<{ACTION.simpleString()}>>"


def judge(records: DataFrame, rule_set: RuleSet) -> DataFrame:
    """Decisions of a rule set on records, as one narrow job: no join, no shuffle.

    Every row carries the order key ``(ord, rec_idx, rule_rank, handler_rank, action_rank)``;
    ``number`` turns it into ids. A rule that failed gives one ``error`` decision, a matched rule
    one decision per action of each of its handlers (or one plain ``matched`` decision for a
    handler without actions).
    """
    hits = evaluate(records, rule_set, hits_only=True)
    if not rule_set.judgment_enabled:
        hits = hits.where(F.lit(False))
    own = F.get(_handler_literal(rule_set), F.col("rule_rank"))
    return _decided(hits, own, rule_set.mode, rule_set.generation)


def decide(hits: DataFrame, handlers: DataFrame, mode: str, generation: int) -> DataFrame:
    """Decisions for hits of any origin, with the handlers in a table (``RuleSet.handler_frame``).

    The handlers of a condition are brought together first, so every hit meets one row; Catalyst
    broadcasts that side while it is small.
    """
    rows = F.struct("handler_rank", "handler", "actions")
    # Maps have no order, so the ranks alone are sorted and point to the rows.
    sides = handlers.groupBy(F.col("condition").alias("_handles")).agg(
        F.map_from_entries(F.collect_list(F.struct("handler_rank", rows))).alias("_rows")
    ).select("_handles", F.transform(F.array_sort(F.map_keys("_rows")), lambda k: F.col("_rows")[k]).alias("_own"))
    joined = hits.join(sides, F.col("condition") == F.col("_handles"), "left")
    return _decided(joined, F.col("_own"), mode, generation)


def _decided(hits: DataFrame, own: Column, mode: str, generation: int) -> DataFrame:
    """Fan every hit out over the handlers of its rule (``own``); failed rules pass through."""
    failed = F.col("error").isNotNull()
    no_handler = F.array(F.lit(None).cast(HANDLES))
    handled = hits.withColumnRenamed("message", "record_text").select(
        "*", F.explode(F.when(failed, no_handler).otherwise(own)).alias("_to")
    )
    fanned = handled.select("*", F.posexplode_outer("_to.actions").alias("action_pos", "action"))
    action = F.col("action")
    is_intent = action["kind"] == "emit_callback_intent"
    is_decision = action["kind"] == "emit_decision"
    intent = F.struct(
        *[action[name].alias(name) for name in ("target", "operation", "payload", "dedupe_key")]
    )
    return fanned.select(
        "ord",
        "rec_idx",
        "rule_rank",
        F.coalesce(F.col("_to.handler_rank"), F.lit(0)).alias("handler_rank"),
        F.coalesce("action_pos", F.lit(0)).alias("action_rank"),
        F.lit(generation).cast("bigint").alias("generation"),
        F.unix_millis(F.current_timestamp()).alias("created_at_unix_ms"),
        "condition",
        F.col("_to.handler").alias("handler"),
        _outcome(failed, is_intent).alias("outcome"),
        F.lit(mode).alias("mode"),
        F.when(failed, F.lit("error")).when(is_decision, action["severity"]).alias("severity"),
        F.when(failed, F.col("error")).when(is_decision, action["message"]).alias("message"),
        F.when(is_intent, intent).cast(CALLBACK_INTENT).alias("callback_intent"),
        F.col("source").alias("record_source"),
        F.col("record_text").alias("record_message"),
    )


def _handler_literal(rule_set: RuleSet) -> Column:
    """For every rule, in order, its handlers in order, as one constant."""
    own: dict[str, list] = {}
    for rank, handler in enumerate(rule_set.ordered_handlers()):
        actions = [dict(zip(ACTION.names, row, strict=True)) for row in action_rows(handler)]
        own.setdefault(handler.condition, []).append(
            {"handler_rank": rank, "handler": handler.name, "actions": actions}
        )
    rows = [{"own": own.get(rule.name, [])} for rule in rule_set.ordered_rules()]
    return F.transform(literal_rows(rows, f"own array<{HANDLES}>"), lambda row: row["own"])


def _outcome(failed: Column, is_intent: Column) -> Column:
    return (
        F.when(failed, F.lit("error"))
        .when(is_intent, F.lit("callback_intent"))
        .otherwise(F.lit("matched"))
    )


def with_ids(decisions: DataFrame, start: int = 1) -> DataFrame:
    """Decisions with ``seq`` and ``id`` = ``decision-<seq>``."""
    return number(decisions, start=start).withColumn(
        "id", F.concat(F.lit("decision-"), F.col("seq").cast("string"))
    )


def recent(decisions: DataFrame, n: int, keys: list[str] | None = None) -> DataFrame:
    """The last ``n`` decisions by key, oldest first, with the columns they came with.

    ``n`` bounds the result, so this is a top-k: every task keeps its last ``n`` rows at most.
    """
    keys = keys or ORDER_KEY
    return decisions.orderBy(*[F.col(k).desc() for k in keys]).limit(n).orderBy(*keys)


def etag(generation: int) -> str:
    return f'"judgment-{generation}"'


def status(spark: SparkSession, rule_set: RuleSet) -> DataFrame:
    """One row that describes the rule set: its rules and handlers in order."""
    conditions = [(r.name, r.id, list(r.tags), r.priority) for r in rule_set.ordered_rules()]
    handlers = [(h.name, h.condition, h.priority, len(h.actions)) for h in rule_set.ordered_handlers()]
    row = (
        rule_set.generation, etag(rule_set.generation), rule_set.judgment_enabled,
        rule_set.mode, conditions, handlers,
    )
    return spark.createDataFrame(
        [row],
        "generation bigint, etag string, enabled boolean, mode string, "
        "conditions array<struct<name: string, id: string, tags: array<string>, priority: bigint>>, "
        "handlers array<struct<name: string, condition: string, priority: bigint, actions: int>>",
    )
