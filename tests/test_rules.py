import ipaddress
import json
import random

import pytest
from pyspark.sql import functions as F

from logjury import (
    Action,
    Fragment,
    Group,
    Handler,
    PatternSet,
    Rule,
    RuleError,
    RuleSet,
    decide,
    evaluate,
    evaluate_table,
    judge,
    longest_networks,
    merge,
    normalize,
    recent,
    status,
    validate_group_table,
    validate_rule_table,
    with_ids,
)
from logjury.functions.predicates import any_of_pattern, call

LINES = [
    '{"service":"authelia-7","level":"error","message":"door jammed"}',
    '{"service":"authelia-7","level":"warn","message":"badge denied at gate"}',
    '{"service":"shop","message":"7"}',
]


@pytest.fixture(scope="module")
def records(spark):
    lines = spark.createDataFrame(list(enumerate(LINES, 1)), "ord long, value string")
    return normalize(lines)


def answers(records, rules, **more):
    rows = evaluate(records, RuleSet(rules=rules, **more)).collect()
    return {(r["condition"], r["ord"]): r["error"] or r["matched"] for r in rows}


def test_field_rule_and_group(records):
    found = answers(
        records,
        (
            Rule("plain", "Log.Source == 'authelia' AND Log.Level == 'error'"),
            Rule("grouped", "Log.Source = 'authelia'", groups=("bad",)),
        ),
        groups=(Group("bad", "Log.Level = 'error'"),),
    )
    assert [found["plain", i] for i in (1, 2, 3)] == [True, False, False]
    assert found["grouped", 1] is True and found["grouped", 2] is False


def test_undecided_rules_fail_closed(records):
    null = "no answer: condition is null"
    found = answers(
        records,
        (
            Rule("null", "length(Log.Level) > 2"),
            Rule("level", "Log.Level = 'error' OR 'x' == Log.Service"),
            Rule("guarded", "Log.Source = 'x' AND matches(Log.Message, '(')"),
            Rule("type", "Log.Message"),
            Rule("cast", "CAST(Log.Message AS INT) > 3"),
            Rule("divide", "1 / length(Log.Timestamp) > 0"),
            Rule("pattern", "matches(Log.Message, '(')"),
        ),
    )
    assert found["null", 3] == null
    assert [found["level", i] for i in (1, 2, 3)] == [True, False, False]
    assert {found["guarded", i] for i in (1, 2, 3)} == {False}
    assert found["type", 1] == "no answer: condition is string, not true or false"
    assert found["cast", 1] == null and found["cast", 3] is True
    assert found["divide", 1] == null
    assert found["pattern", 2] == null


def test_merge():
    assert merge([]) == "true"
    steps = [Fragment("a"), Fragment("b", "override"), Fragment("c", "or")]
    assert merge(steps) == "((b)) OR (c)"
    with pytest.raises(RuleError, match="more than one override"):
        merge([Fragment("a", "override"), Fragment("b", "override")])
    with pytest.raises(RuleError, match="empty condition text"):
        merge([Fragment(" ")])


@pytest.mark.parametrize(
    "broken, message",
    [
        ({"rules": (Rule(" ", "true"),)}, "has no name"),
        ({"rules": (Rule("a", "true", priority=-1),)}, "priority"),
        ({"rules": (Rule("a"),)}, "says nothing"),
        ({"rules": (Rule("a", "true"), Rule("a", "true"))}, "rule a occurs twice"),
        ({"rules": (Rule("a", "true", id="1"), Rule("b", "true", id="1"))}, "rule id 1 occurs twice"),
        ({"rules": (Rule("a", groups=("x",)),)}, "no group x"),
        ({"groups": (Group("g"),)}, "says nothing"),
        ({"groups": (Group("g", "true"), Group("g", "true"))}, "group g occurs twice"),
        ({"handlers": (Handler("h", "none"),)}, "no rule none"),
        ({"rules": (Rule("a", "true"),), "handlers": (Handler("h", "a"), Handler("h", "a"))}, "handler h occurs twice"),
        ({"rules": (Rule("a", "true"),), "handlers": (Handler("h", "a", -1),)}, "priority"),
        (
            {"rules": (Rule("a", "true"),), "handlers": (Handler("h", "a", 0, (Action("emit_decision", -1),)),)},
            "action priority",
        ),
        ({"mode": "loud"}, "mode"),
    ],
)
def test_refused_rule_sets(broken, message):
    with pytest.raises(RuleError, match=message):
        RuleSet(**broken)


def test_refused_expressions(spark, records):
    with pytest.raises(RuleError, match="rule bad cannot be analysed"):
        evaluate(records, RuleSet(rules=(Rule("good", "true"), Rule("bad", "No.Such = 1"))))
    with pytest.raises(RuleError, match="pattern set"):
        sets = (PatternSet("p", "regex", ("(",)),)
        evaluate(records, RuleSet(rules=(Rule("a", "true"),), pattern_sets=sets))


def test_from_dict_is_off_by_default_and_strict():
    config = {
        "condition": {"enabled": True, "rules": [{"name": "denied", "when": "contains(Log.Message, 'denied')"}]},
        "judgment": {
            "enabled": True,
            "handlers": [
                {"name": "record", "condition": "denied", "actions": [{"type": "emit_decision", "severity": "warning"}]}
            ],
        },
    }
    rules = RuleSet.from_dict(config)
    assert rules.max_decisions == 256 and rules.mode == "monitor"
    assert RuleSet.from_dict({}).ordered_rules() == []
    with pytest.raises(RuleError, match="not known"):
        RuleSet.from_dict({"condition": {"rulez": []}})


def test_in_cidr_like_ipaddress(spark):
    """Against Python's ipaddress, which here also accepts scope ids the rule must refuse."""
    rng = random.Random(3)
    v4 = [".".join(str(rng.choice([0, 1, 10, 127, 128, 255])) for _ in range(4)) for _ in range(40)]
    v6 = [str(ipaddress.IPv6Address(rng.getrandbits(128) >> rng.choice([0, 64, 100]))) for _ in range(40)]
    odd = [
        "::", "::1", "1::", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8::", "1::2::3", ":::", ":1", "1:",
        "::ffff:1.2.3.4", "1:2:3:4:5:6:1.2.3.4", "::1.2.3", "::01.2.3.4", "1.2.3.4::", "12345::", "::g", "fe80::1%e",
        "1.2.3", "1.2.3.4.5", "01.2.3.4", "256.1.1.1", "", " 1.2.3.4", "2001:DB8::A", "1:2:3:4:5:6:7:1.2.3.4", "0:0:0:0:0:0:0:0",
    ]
    nets = ["0.0.0.0/0", "10.0.0.0/8", "128.0.0.0/1", "127.1.0.0/31", "::/0", "::/64", "::ffff:0:0/96", "2001:db8::/13", "1::/128"]
    frame = spark.createDataFrame([(ip,) for ip in v4 + v6 + odd], "ip string")
    rows = frame.select("ip", *[call("in_cidr", F.col("ip"), net).alias(net) for net in nets]).collect()
    for row in rows:
        for net in nets:
            try:
                address = ipaddress.ip_address(row["ip"])
                assert "%" not in row["ip"]
            except (ValueError, AssertionError):
                expected = None
            else:
                network = ipaddress.ip_network(net, strict=False)
                expected = address.version == network.version and address in network
            assert row[net] is expected, (row["ip"], net)


def test_bad_networks_are_undecided(spark):
    nets = ["10.0.0.0", "10.0.0.0/33", "10.0.0.0/", "10.0.0.0/x", "x/8", "10.0.0.0/8/8", "10.0.0.0/99999999999"]
    one = spark.range(1)
    row = one.select(*[call("in_cidr", F.lit("10.1.1.1"), net).alias(net) for net in nets]).first()
    assert set(row) == {None}
    assert one.select(call("in_cidr", F.lit("::1"), "10.0.0.0/33")).first()[0] is False
    assert one.select(call("in_cidr", F.lit("10.1.1.1"), "10.0.0.0/+8")).first()[0] is True


def test_other_functions(spark):
    one = spark.sql("SELECT map('a', '1', 'B', cast(null AS string)) AS m, array('x', null) AS l")
    expressions = {
        "byte_size('é')": 2,
        "lower_ascii('ÄB')": "Äb",
        "upper_ascii('äb')": "äB",
        "get_value(m, 'zz')": None,
        "list_size(get_all(m, 'zz'))": 0,
        "any_value_contains(m, '1')": True,
        "any_key_matches(m, '^[A-Z]$')": True,
        "any_matches(m, '^b$')": False,
        "any_entry_matches(m, 'a', '2')": False,
        "all_entries_match(m, '.', '.')": False,
        "all_entries_match(cast(map() AS map<string,string>), 'x', 'x')": True,
        "any_item_matches(l, 'x')": True,
        "has_key(m, 'B')": True,
        "matches('tür', r'^\\w+$')": True,
    }
    call("byte_size", "x")
    row = one.selectExpr(*[f"{text} AS c{i}" for i, text in enumerate(expressions)]).first()
    assert list(row) == list(expressions.values())


JUDGED = RuleSet(
    rules=(Rule("deny", "contains(Log.Message, 'denied')"), Rule("broken", "length(Log.Level) > 9", priority=3)),
    handlers=(
        Handler(
            "act",
            "deny",
            actions=(
                Action("emit_decision", 2, severity="a"),
                Action("emit_decision", 1, severity="b"),
                Action("emit_callback_intent", 1, target="policy", operation="apply", payload={"k": "v"}),
            ),
        ),
        Handler("bare", "deny", priority=-0),
    ),
)


def test_decisions_in_order(records):
    rows = with_ids(judge(records, JUDGED)).orderBy("seq").collect()
    assert [r["id"] for r in rows] == [f"decision-{i}" for i in range(1, len(rows) + 1)]
    shape = [(r["ord"], r["condition"], r["handler"], r["outcome"], r["severity"]) for r in rows]
    assert shape == [
        (2, "deny", "act", "matched", "b"),
        (2, "deny", "act", "callback_intent", None),
        (2, "deny", "act", "matched", "a"),
        (2, "deny", "bare", "matched", None),
        (3, "broken", None, "error", "error"),
    ]
    intent = rows[1]["callback_intent"]
    assert (intent["target"], intent["payload"], intent["dedupe_key"]) == ("policy", {"k": "v"}, None)


def test_recent_and_status(spark, records):
    decisions = judge(records, JUDGED)
    assert [r["action_rank"] for r in recent(decisions, 3).collect()] == [2, 0, 0]
    assert recent(decisions, 0).count() == 0
    assert recent(decisions, 20_000).columns == recent(decisions, 1).columns and recent(decisions, 20_000).count() == 5
    row = status(spark, JUDGED).first()
    assert row["enabled"] and [h["actions"] for h in row["handlers"]] == [3, 0]
    assert [x["name"] for x in row["conditions"]] == ["deny", "broken"]


def test_numbering_with_a_hot_key(spark):
    """One line holds nearly all decisions; numbers stay consecutive and in order."""
    from logjury import number

    rows = spark.range(20_000).select(F.when(F.col("id") < 19_000, 5).otherwise(F.col("id")).alias("a"), F.col("id").alias("b"))
    numbered = number(rows.repartition(7), ["a", "b"])
    expected = sorted((r["a"], r["b"]) for r in rows.collect())
    got = [(r["a"], r["b"]) for r in numbered.orderBy("seq").collect()]
    assert got == expected
    assert numbered.agg(F.min("seq"), F.max("seq"), F.count_distinct("seq")).first()[:] == (1, 20_000, 20_000)


@pytest.mark.parametrize("threshold", ["10m", "-1"])
def test_rule_table(spark, threshold):
    """With the rules broadcast and with both sides shuffled; bad lines are no records."""
    rules = spark.createDataFrame(
        [
            ("a", "authelia", "error", None, ["jam"]),
            ("b", None, None, "shop", []),
            ("c", "authelia", None, None, ["denied", "badge"]),
            ("d", None, "error", None, []),
            ("e", None, None, None, None),
        ],
        "condition string, source_eq string, level_eq string, service_eq string, contains array<string>",
    )
    records = normalize(spark.createDataFrame(list(enumerate([*LINES, '{"bad"'], 1)), "ord long, value string"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        rows = evaluate_table(records, rules).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    expected = {("a", 1), ("b", 3), ("c", 2), ("d", 1), ("e", 1), ("e", 2), ("e", 3)}
    assert {(r["condition"], r["ord"]) for r in rows} == expected and len(rows) == 7
    assert {(r["condition"], r["rule_rank"]) for r in rows} == {(name, k) for k, name in enumerate("abcde")}
    assert all(r["matched"] and r["error"] is None for r in rows)


def test_table_decisions_equal_set_decisions(spark, records):
    """Handlers from a table give what handlers of a rule set give."""
    want = judge(records, JUDGED).drop("created_at_unix_ms")
    hits = evaluate(records, JUDGED, hits_only=True)
    got = decide(hits, JUDGED.handler_frame(spark), JUDGED.mode, JUDGED.generation).drop("created_at_unix_ms")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_rules_and_handlers_need_no_join(records):
    plan = judge(records, JUDGED)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_conditions_refuse_traps(records):
    for text in (
        "matches(Log.Message, Log.Attributes['p'])",
        "Log.Message RLIKE '('",
        "regexp_extract(Log.Message, 'a', 3) = ''",
        "element_at(Log.Attributes, 'x') = 'y'",
        "raise_error('x')",
        "any_entry_matches(Log.Attributes, 'a', Log.Message)",
    ):
        with pytest.raises(RuleError, match="rule bad"):
            evaluate(records, RuleSet(rules=(Rule("good", "true"), Rule("bad", text))))
    found = answers(records, (Rule("texts", "Log.Message <> 'raise_error(RLIKE) Log.Level = (' AND matches(Log.Message, concat('d', 'oor'))"),))
    assert [found["texts", i] for i in (1, 2, 3)] == [True, False, False]


def test_conditions_refuse_what_may_stop_a_job(records):
    for text in (
        "url_decode(Log.Message) = 'x'",
        "size(str_to_map(Log.Message)) > 1",
        "xpath_string(Log.Message, 'a') = 'b'",
        "from_utc_timestamp(now(), Log.Message) IS NULL",
        "decode(encode(Log.Message, 'utf-8'), Log.Attributes['p']) = 'x'",
        "Log.Message LIKE Log.Service ESCAPE '/'",
        "(SELECT true)",
        "Log.Message LIKE ANY ('a\\\\q', 'b')",
        "count(*) > 1",
    ):
        with pytest.raises(RuleError, match="rule bad is refused"):
            evaluate(records, RuleSet(rules=(Rule("good", "true"), Rule("bad", text))))
    with pytest.raises(RuleError, match="rule bad cannot be analysed"):
        evaluate(records, RuleSet(rules=(Rule("bad", "Log.Level = = 'x'"),)))


def test_conditions_are_changed_on_the_tree(records):
    """Comments, joined literals, brackets and names in literals do not mislead."""
    found = answers(
        records,
        (
            Rule("joined", "Log.Level = 'err' || 'or' /* contains( */ -- Log.Level = 'no'"),
            Rule("turned", "'error' = (Log.Level)"),
            Rule("set", "NOT (Log.Level) IN ('error', concat('in', 'fo'))"),
            Rule("other", "Log.Level = Log.Service"),
            Rule("texts", "any_value_contains ( /* of */ Log.Message, 'denied') OR has_key(Log, 'Log.Level IN (1)')"),
            Rule("lambda", "exists(map_values(Log.Attributes), v -> v = 'a' OR contains(v, 'x'))"),
        ),
    )
    assert [found["joined", i] for i in (1, 2, 3)] == [True, False, False]
    assert [found["turned", i] for i in (1, 2, 3)] == [True, False, False]
    assert found["set", 3] is True and found["set", 1] is False
    assert found["other", 3] == "no answer: condition is null"
    assert [found["texts", i] for i in (1, 2, 3)] == [False, True, False]


def test_functions_of_the_caller(spark, records):
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION is_door(s STRING) RETURNS BOOLEAN RETURN contains(s, 'door')")
    rules = (Rule("own", "is_door(Log.Message)"),)
    with pytest.raises(RuleError, match="is_door may not be used"):
        evaluate(records, RuleSet(rules=rules))
    assert evaluate(records, RuleSet(rules=rules, functions=("is_door",)), hits_only=True).count() == 1


def test_rules_and_groups_in_tables(spark):
    rules = spark.createDataFrame(
        [("a", "1", 0, "true", ["g", "none"], "and"), ("b", "2", 0, None, ["g"], "xor"), ("c", "3", -1, " ", [], "or")],
        "name string, id string, priority long, when string, groups array<string>, merge_condition_as string",
    )
    parts = "array<struct<when: string, merge_condition_as: string>>"
    groups = spark.createDataFrame(
        [
            ("g", "true", "override", [("x", "override"), (" ", "and")]),
            ("empty", None, "and", []),
            ("twice", "t", "and", []),
            ("twice", "t", "maybe", []),
        ],
        f"name string, when string, merge_condition_as string, conditions {parts}",
    )
    assert sorted(map(tuple, validate_rule_table(rules, groups).collect())) == [
        ("a", "no such group: none"),
        ("b", "no such merge word"),
        ("c", "empty condition"),
        ("c", "priority below zero"),
    ]
    assert sorted(map(tuple, validate_group_table(groups).collect())) == [
        ("empty", "neither when nor conditions"),
        ("g", "empty condition"),
        ("g", "more than one override"),
        ("twice", "name occurs twice"),
        ("twice", "no such merge word"),
    ]


def test_hundreds_of_rules(records):
    rules = tuple(Rule(f"r{k}", f"contains(Log.Message, 'door') AND Log.Level = 'error' AND {k} % 50 = 0") for k in range(300))
    assert evaluate(records, RuleSet(rules=rules), hits_only=True).count() == 6


def test_networks_in_rules(records, spark):
    line = '{"service":"a","msg":"m","ip":"%s"}'
    ips = ["10.1.2.3", "::1", "bad", "192.168.0.9"]
    frame = normalize(spark.createDataFrame([(k, line % ip) for k, ip in enumerate(ips)], "ord long, value string"))
    rules = {
        "ten": ("in_cidr(Request.Client.Ip, '10.0.0.0/8')", [True, False, None, False]),
        "host": ("in_cidr(Request.Client.Ip, '192.168.0.9/32')", [False, False, None, True]),
        "six": ("in_cidr( Request.Client.Ip , '::/0')", [False, True, None, False]),
        "long": ("in_cidr(Request.Client.Ip, '10.0.0.0/33')", [None, False, None, None]),
        "no": ("in_cidr(Request.Client.Ip, 'x/8')", [None] * 4),
        "data": ("in_cidr('10.0.0.1', concat(Request.Client.Ip, '/8'))", [True, False, None, False]),
    }
    rows = evaluate(frame, RuleSet(rules=tuple(Rule(n, t) for n, (t, _) in rules.items()))).collect()
    got = {(r["condition"], r["ord"]): None if r["error"] else r["matched"] for r in rows}
    for name, (_, want) in rules.items():
        assert [got[name, k] for k in range(4)] == want, name


def test_pattern_of_many_literals(spark):
    """The trie finds what looking for each literal finds."""
    rng = random.Random(5)
    signs = "ab.\\[*^$|#é\n-😀&Q"
    for n in (1, 3, 40, 400):
        literals = ["".join(rng.choice(signs) for _ in range(rng.randint(1, 6))) for _ in range(n)]
        texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 9))) for _ in range(300)] + literals
        pattern = any_of_pattern(literals)
        frame = spark.createDataFrame([(t,) for t in texts], "s string")
        found = frame.select("s", F.col("s").rlike(pattern).alias("hit")).collect()
        assert all(r["hit"] == any(x in r["s"] for x in literals) for r in found)
    deep = ["a" * k + "b" for k in range(300)]
    row = spark.sql("SELECT 1").select(F.lit("xaab").rlike(any_of_pattern(deep)), F.lit("xaac").rlike(any_of_pattern(deep))).first()
    assert list(row) == [True, False]
    assert any_of_pattern(["", "x"]) == "" and any_of_pattern(["ab", "abc", "b"]) == "[b]|ab"


def test_literal_sets_keep_their_answers(records):
    sets = (PatternSet("none", "contains"), PatternSet("all", "contains", ("", "q")), PatternSet("some", "contains", ("jam", "7")))
    rules = tuple(Rule(s.name, f"contains_any(Log.Message, '{s.name}')") for s in sets) + (
        Rule("absent", "contains_any(Log.Timestamp, 'some')"),
    )
    found = answers(records, rules, pattern_sets=sets)
    assert [found["none", i] for i in (1, 2, 3)] == [False] * 3
    assert [found["all", i] for i in (1, 2, 3)] == [True] * 3
    assert [found["some", i] for i in (1, 2, 3)] == [True, False, True]
    assert found["absent", 1] == "no answer: condition is null"


@pytest.mark.parametrize("threshold", ["10m", "-1"])
def test_longest_networks_like_ipaddress(spark, threshold):
    rng = random.Random(9)
    address = lambda: str(ipaddress.IPv4Address(rng.getrandbits(4) << 28 | rng.getrandbits(3) << 8 | rng.getrandbits(2)))
    wide = lambda: str(ipaddress.IPv6Address(1 << 120 | rng.getrandbits(3) << 60 | rng.getrandbits(2)))
    nets = [f"{address()}/{rng.choice([0, 3, 24, 31, 32])}" for _ in range(40)]
    nets += [f"{wide()}/{rng.choice([8, 66, 128])}" for _ in range(20)] + ["10.0.0.0/33", "x", "1.2.3.4"]
    ips = [address() for _ in range(150)] + [wide() for _ in range(60)] + [None, "", "x"] * 5
    ips += [ips[0]] * 400  # a hot address
    frame = spark.createDataFrame([(k, ip, {"a": "b"}) for k, ip in enumerate(ips)], "n long, ip string, m map<string, string>")
    table = spark.createDataFrame([(net, k) for k, net in enumerate(nets)], "cidr string, k long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        rows = longest_networks(frame, table, F.col("ip")).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    good = [(net, ipaddress.ip_network(net, strict=False)) for net in nets[:60]]
    assert len(rows) == len(ips)
    for row in rows:
        try:
            ip = ipaddress.ip_address(row["ip"] or "")
        except ValueError:
            assert row["network"] is None
            continue
        holding = [(-net.prefixlen, text) for text, net in good if net.version == ip.version and ip in net]
        assert (row["network"] and row["network"]["cidr"]) == (min(holding)[1] if holding else None)


def test_rules_of_literals_meet_only_what_holds_their_gram(spark):
    """Short and long literals, several of them, none, and letters of two code units."""
    rng = random.Random(2)
    words = ["alpha", "beta", "a", "é", "😀x", "gamma delta", "zz", "##", "ta al"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 8))) for _ in range(60)]
    records = normalize(spark.createDataFrame([(k, json.dumps({"message": t})) for k, t in enumerate(texts)], "ord long, value string"))
    literals = [rng.sample([*words, "absent", "lpha b", ""], rng.randint(0, 3)) for _ in range(80)]
    rules = spark.createDataFrame(
        [(f"r{k:02}", None, None, None, own) for k, own in enumerate(literals)],
        "condition string, source_eq string, level_eq string, service_eq string, contains array<string>",
    )
    rows = evaluate_table(records, rules).collect()
    want = {(f"r{k:02}", t) for k, own in enumerate(literals) for t, text in enumerate(texts) if all(x in text for x in own)}
    assert {(r["condition"], r["ord"]) for r in rows} == want and len(rows) == len(want)
    assert all(r["rule_rank"] == int(r["condition"][1:]) for r in rows)
    assert evaluate_table(records, rules.where("false")).count() == 0


def test_rule_tables_in_tiles_and_lists(spark, monkeypatch):
    """Many rules of one test, more tests than a tile, long literals, equalities, absent fields, empty and long texts."""
    monkeypatch.setattr("logjury.operators.literals.WINDOW", 64)
    monkeypatch.setitem(evaluate_table.__globals__, "TILE", 20)
    monkeypatch.setitem(evaluate_table.__globals__, "LIST", 3)
    rng = random.Random(8)
    words = ["ab", "é", "the long and winding literal of a rule", "sixteen bytes!!!", "sixteen bytes!!?", "\U0001f600x", "a b c d e f g h", " "]
    pick = lambda values: rng.choice([None, None, *values])
    names = {"source": ["s1", "s2"], "level": ["error", "info"], "service": ["shop", ""]}
    fields = list(names)
    made = lambda k: (k, *[pick(names[f]) for f in fields], "".join(rng.choices(words, k=rng.choice([0, 1, 3, 8]))))
    records = [made(k) for k in range(150)] + [(150, "s1", "error", "shop", None)]
    literals = [*words, "winding literal of a r", "bytes!!!ab", "absent", "", None, "e long and winding literal of a ruleé"]
    rules = [(f"r{k:03}", *[pick(names[f]) if k % 3 else None for f in fields], rng.choices(literals, k=rng.choice([0, 1, 1, 2, 4]))) for k in range(120)]
    rules += [(f"same{k}", None, None, "shop", ["é", "ab"][:: 1 - 2 * (k % 2)]) for k in range(11)] + [("none", None, None, None, None)]
    frame = spark.createDataFrame(records, "ord long, source string, level string, service string, message string").repartition(3)
    table = spark.createDataFrame(rules, "condition string, source_eq string, level_eq string, service_eq string, contains array<string>")
    rows = evaluate_table(frame, table).collect()

    def passes(record, rule):
        equal = all(want is None or want == own for want, own in zip(rule[1:4], record[1:4]))
        return equal and record[4] is not None and all(part in record[4] for part in rule[4] or () if part)

    want = {(rule[0], record[0]) for rule in rules for record in records if passes(record, rule)}
    assert {(r["condition"], r["ord"]) for r in rows} == want and len(rows) == len(want)
    order = {name: rank for rank, name in enumerate(sorted(rule[0] for rule in rules))}
    texts = {record[0]: record[4] for record in records}
    assert all(r["rule_rank"] == order[r["condition"]] and r["message"] == texts[r["ord"]] for r in rows)


def test_rule_tables_join_without_the_text(spark):
    """What meets the rules is the number of a test, with the columns that are asked for; rules of one test are one row."""
    rows = spark.range(40).selectExpr("id AS ord", "'s' AS source", "'info' AS level", "'w' AS service", "concat('denied ', id) AS message")
    none = F.lit(None).cast("string")
    rules = spark.range(60).select(
        F.concat(F.lit("r"), "id").alias("condition"), none.alias("source_eq"), none.alias("level_eq"), none.alias("service_eq"), F.array(F.lit("denied")).alias("contains")
    )
    found = evaluate_table(rows, rules).select("ord", "condition")
    plans, joins = [found._jdf.queryExecution().optimizedPlan()], []
    while plans:
        plan = plans.pop()
        below = plan.children()
        plans += [below.apply(k) for k in range(below.size())]
        if plan.nodeName() == "Join":
            sides = [below.apply(k).output() for k in range(2)]
            joins.append([{side.apply(k).name() for k in range(side.size())} for side in sides])
    assert joins and all("message" not in side for sides in joins for side in sides)
    assert found.count() == 40 * 60
