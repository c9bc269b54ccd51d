"""Rules and generations in tables against the rule set's own fold and a plain loop."""

import random

from pyspark.sql import functions as F

from logjury import Fragment, Group, Rule, RuleError, RuleSet, at_generation, merged_conditions

PARTS = "array<struct<when: string, merge_condition_as: string>>"
GROUP = f"struct<name: string, when: string, merge_condition_as: string, conditions: {PARTS}>"


def test_conditions_equal_those_of_rule_sets(spark):
    rng = random.Random(4)
    merge = lambda: rng.choice(["and", "and", "or", "override"])
    text = lambda: rng.choice(["a = 1", "b", "c -- d", "x OR y", "true"])

    def group(name):
        conditions = [(text(), merge()) for _ in range(rng.randint(0, 3))]
        return (name, text() if rng.random() < 0.6 or not conditions else None, merge(), conditions)

    groups = [group(f"g{k}") for k in range(6)]
    rules = []
    for k in range(300):
        named = [rng.choice(["g0", "g1", "g2", "g3", "g4", "g5", "gone"][: 6 + (k % 20 == 0)]) for _ in range(rng.randint(0, 4))]
        local = [group(n) for n in rng.sample(["g1", "g4"], rng.randint(0, 2))]
        when = text() if rng.random() < 0.7 or not named else None
        rules.append((f"r{k}", " " if k == 7 else when, named, merge(), local))
    rules.append(("bare", None, [], "and", None))
    frame = spark.createDataFrame(rules, f"name string, when string, groups array<string>, merge_condition_as string, rule_groups array<{GROUP}>")
    table = spark.createDataFrame(groups, f"name string, when string, merge_condition_as string, conditions {PARTS}")
    made = lambda g: Group(g[0], g[1], g[2], tuple(Fragment(*c) for c in g[3]))
    shared = tuple(map(made, groups))
    seen = set()
    for row in merged_conditions(frame, table).collect():
        name, when, named, how, local = next(r for r in rules if r[0] == row["name"])
        rule = Rule(name, when, merge_condition_as=how, groups=tuple(named), rule_groups=tuple(map(made, local or [])))
        try:
            want, error = RuleSet.condition_of(RuleSet(groups=shared), rule), None
        except RuleError as problem:
            want, error = None, str(problem)
        assert row["condition"] == want, (row, error)
        kinds = {"no such group": "there is no group", "empty": "empty condition", "more": "more than one override"}
        assert (row["error"] is None) == (error is None)
        if error:
            assert next(v for k, v in kinds.items() if row["error"].startswith(k)) in error
            seen.add(row["error"].split(":")[0])
    assert len(seen) == 3
    assert merged_conditions(frame, table).count() == len(rules)
    assert merged_conditions(frame.where("false"), table.where("false")).count() == 0


def test_generations_over_time(spark):
    rng = random.Random(6)
    records = [(k, rng.randint(0, 40), {"a": "b"}) for k in range(500)] + [(k, 20, {}) for k in range(500, 900)] + [(900, None, None)]
    begun = [(g, rng.randint(3, 45)) for g in range(12)] + [(99, 20), (98, 20), (97, None)]
    frame = spark.createDataFrame(records, "n long, t long, m map<string, string>").repartition(5)
    table = spark.createDataFrame(begun, "generation long, valid_from long")

    def valid(t):
        known = [(start, g) for g, start in begun if start is not None and t is not None and start <= t]
        return max(known)[1] if known else None

    found = at_generation(frame, table, F.col("t"))
    assert found.columns == ["n", "t", "m", "generation"]
    assert {r["n"]: r["generation"] for r in found.collect()} == {n: valid(t) for n, t, _ in records}
    assert found.count() == len(records)
    assert at_generation(frame, table.where("false"), F.col("t")).where("generation IS NOT NULL").count() == 0
    assert at_generation(frame.where("false"), table, F.col("t")).count() == 0
