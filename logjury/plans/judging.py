"""Queries for roots, rule functions, evaluation, decisions and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from logjury.operators.evaluate import evaluate, evaluate_table
from logjury.operators.judge import decide, judge, recent, status, with_ids
from logjury.operators.networks import longest_networks
from logjury.operators.roots import with_roots
from logjury.operators.rules import (
    Action,
    Fragment,
    Group,
    Handler,
    PatternSet,
    Rule,
    RuleSet,
    validate_handler_table,
    validate_rule_table,
)
from logjury.operators.tables import at_generation, merged_conditions
from logjury.plans.base import (
    EVENTS_SQL,
    app_line,
    c,
    events,
    normalize,
    oracle,
    parse,
    scratch,
    text_table,
    to_line,
)
from logjury.streaming.pipeline import RecentStore, run_recent, run_to_table
from logjury.streaming.state import keep_recent, kept_recent

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


# Request-like attributes on every event, under the alternate names the roots know.
def _request_line():
    even = c("event_id") % 2 == 0
    return app_line(
        method=F.when(even, F.lit("GET")),
        http_method=F.lit("POST"),
        uri=F.concat(F.lit("/"), c("event_type"), F.lit("/"), c("user_id")),
        path=F.when(c("event_id") % 5 == 0, F.lit("")),
        request_query=F.concat(F.lit("k="), c("k")),
        body_size=F.when(even, c("k").cast("string")).otherwise(F.concat(F.lit(" "), c("k"))),
        body=c("event_type"),
        ip=F.concat_ws(".", F.lit("10"), c("user_id") % 4, c("k"), c("event_id") % 256),
        name="svc",
        policy_action="event_type",
        outcome="out",
        subject="user_id",
    )


def _requests(spark, sf_dir, keep=("event_id",)):
    return parse(events(spark, sf_dir), _request_line(), keep=list(keep))


# The address in SQL; its octets are at hand, so networks are integer arithmetic.
_IP = "'10.' || user_id % 4 || '.' || k || '.' || event_id % 256"


@query(
    "e1_log_root",
    oracle("SELECT event_id, 'logjury.log.v1' AS schema_tag, src AS source, t AS time, level, svc AS service, msg AS message, svc AS name FROM e"),
)
def e1(spark, sf_dir):
    return with_roots(_requests(spark, sf_dir)).select(
        "event_id", c("Log.Schema").alias("schema_tag"), c("Log.Source").alias("source"),
        c("Log.Timestamp").alias("time"), c("Log.Level").alias("level"), c("Log.Service").alias("service"),
        c("Log.Message").alias("message"), c("Log.Attributes")["name"].alias("name"),
    )


@query(
    "e2_context_root",
    oracle("SELECT event_id, 'docker_logs' AS source, CASE WHEN event_id % 2 = 0 THEN '[x]' ELSE '' END AS service, 0 AS tags FROM e"),
)
def e2(spark, sf_dir):
    line = to_line(message="msg", app=F.when(c("event_id") % 2 == 0, F.lit("[x]")))
    return with_roots(parse(events(spark, sf_dir), line, keep=["event_id"])).select(
        "event_id", c("Context.Source").alias("source"), c("Context.Service").alias("service"),
        F.size("Context.RuleTags").alias("tags"),
    )


@query(
    "e3_request_root",
    oracle(
        f"""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'GET' ELSE 'POST' END AS method,
 CASE WHEN event_id % 5 = 0 THEN '' ELSE '/' || event_type || '/' || user_id END AS path, 'k=' || k AS query,
 CASE WHEN event_id % 2 = 0 THEN k ELSE 0 END AS size, event_type AS body, {_IP} AS ip, 0 AS headers, false AS truncated FROM e"""
    ),
)
def e3(spark, sf_dir):
    http = "Request.Http"
    return with_roots(_requests(spark, sf_dir)).select(
        "event_id", c(f"{http}.Method").alias("method"), c(f"{http}.Path").alias("path"),
        c(f"{http}.Query").alias("query"), c(f"{http}.Body.Size").alias("size"),
        c(f"{http}.Body.Text").alias("body"), c("Request.Client.Ip").alias("ip"),
        F.size(f"{http}.Headers").alias("headers"), c(f"{http}.Body.IsTruncated").alias("truncated"),
    )


@query(
    "e4_policy_root",
    oracle("SELECT event_id, '' AS source, svc AS name, event_type AS action, out AS outcome, CAST(user_id AS VARCHAR) AS subject FROM e"),
)
def e4(spark, sf_dir):
    policy = "DynamicPolicy"
    return with_roots(_requests(spark, sf_dir)).select(
        "event_id", c(f"{policy}.Source").alias("source"), c(f"{policy}.Name").alias("name"),
        c(f"{policy}.Action").alias("action"), c(f"{policy}.Outcome").alias("outcome"),
        c(f"{policy}.Subject").alias("subject"),
    )


# ------------------------------------------------------------------ rule functions


def _rules(conditions: dict[str, str], **more) -> RuleSet:
    rules = tuple(Rule(name, when) for name, when in conditions.items())
    return RuleSet(rules=rules, **more)


def _answers_sql(select: str, table: str, conditions: dict[str, str]) -> str:
    parts = [
        f"SELECT {select}, '{name}' AS condition, ({sql}) AS matched FROM {table}"
        for name, sql in conditions.items()
    ]
    return " UNION ALL ".join(parts)


def _function(name: str, conditions: dict[str, tuple[str, str]], **more) -> None:
    """A query that evaluates rules on the request lines; NULL marks an undecided rule."""
    spark_sql = {rule: texts[0] for rule, texts in conditions.items()}
    duck_sql = {rule: texts[1] for rule, texts in conditions.items()}

    def run(spark, sf_dir):
        rows = evaluate(_requests(spark, sf_dir), _rules(spark_sql, **more))
        return rows.select("event_id", "condition", F.when(c("error").isNull(), c("matched")).alias("matched"))

    sql = f"WITH e AS ({EVENTS_SQL}) " + _answers_sql("event_id", "e", duck_sql)
    query(name, sql)(run)


_NET16 = "user_id % 4 = 1"
_function(
    "f1_contains",
    {
        "text": ("contains(Log.Message, 'denied')", "event_type = 'error'"),
        "list": ("has_item(array(Log.Service, Log.Level), 'shop')", "svc = 'shop'"),
        "empty": ("has_item(Context.RuleTags, 'x')", "false"),
    },
)
_function("f2_starts_with", {"text": ("startswith(Log.Service, 'h')", "starts_with(svc, 'h')")})
_function("f3_ends_with", {"text": ("endswith(Log.Service, 'p')", "suffix(svc, 'p')")})
_function("f4_lower_ascii", {"text": ("lower_ascii(concat(Log.Service, 'Ä')) = 'ory kratosÄ'", "svc = 'Ory Kratos'")})
_function("f5_upper_ascii", {"text": ("upper_ascii(concat(Log.Service, 'ä')) = 'SHOPä'", "svc = 'shop'")})
_function(
    "f6_size",
    {
        "bytes": ("byte_size(concat(Log.Service, 'é')) > 9", "strlen(svc) + 2 > 9"),
        "map": (
            "map_size(Log.Attributes) = 12",
            "event_id % 10 = 0",
        ),
        "list": ("list_size(Request.Tags) = 0", "true"),
    },
)
_function("f7_count", {"bytes": ("byte_count(Log.Message) % 2 = 0", "strlen(msg) % 2 = 0")})
_function(
    "f8_matches",
    {
        "found": (r"matches(Log.Message, r'user \\d*7\\b')".replace("\\\\", "\\"), r"regexp_matches(msg, 'user [0-9]*7\b')"),
        "broken": ("matches(Log.Message, '(')", "CAST(NULL AS BOOLEAN)"),
    },
)
_function(
    "f9_has",
    {
        "key": ("has_key(Log.Attributes, 'method')", "event_id % 2 = 0"),
        "text": ("has_text(Log.Service, 'story')", "contains(svc, 'story')"),
    },
)
_function(
    "f10_in_cidr",
    {
        "net8": ("in_cidr(Request.Client.Ip, '10.0.0.0/8')", "true"),
        "net16": ("in_cidr(Request.Client.Ip, '10.1.0.0/16')", _NET16),
        "net27": ("in_cidr(Request.Client.Ip, '10.2.64.0/19')", "user_id % 4 = 2 AND k BETWEEN 64 AND 95"),
        "other_family": ("in_cidr(Request.Client.Ip, '::/0')", "false"),
        "mapped": ("in_cidr(concat('2001:db8::', Log.Attributes['subject']), '2001:db8::/64')", "true"),
        "out_of_range": ("in_cidr(Request.Client.Ip, '10.0.0.0/33')", "CAST(NULL AS BOOLEAN)"),
        "no_address": ("in_cidr(Log.Service, '10.0.0.0/8')", "CAST(NULL AS BOOLEAN)"),
    },
)
_function(
    "f11_get",
    {
        "value": ("get_value(Log.Attributes, 'subject') = '42'", "user_id = 42"),
        "missing": ("get_value(Log.Attributes, 'none') IS NULL", "true"),
    },
)
_function(
    "f12_get_all",
    {
        "one": ("list_size(get_all(Log.Attributes, 'method')) = 1", "event_id % 2 = 0"),
        "item": ("has_item(get_all(Log.Attributes, 'name'), 'shop')", "svc = 'shop'"),
    },
)
_TEXT_LIST = "array(Log.Service, Log.Message)"
_function(
    "f13_any_value_contains",
    {
        "map": ("any_value_contains(Log.Attributes, 'Kratos')", "svc = 'Ory Kratos'"),
        "text": ("any_value_contains(Log.Service, 'sho')", "svc = 'shop'"),
        "list": (f"any_value_contains({_TEXT_LIST}, 'view')", "event_type = 'view'"),
        "root": ("any_value_contains(Log, 'event purchase')", "event_type = 'purchase'"),
    },
)
_function("f14_any_key_matches", {"map": ("any_key_matches(Log.Attributes, '^method$')", "event_id % 2 = 0")})
_function("f15_any_name_matches", {"map": ("any_name_matches(Log.Attributes, '(?i)^METH')", "event_id % 2 = 0")})
_function(
    "f16_any_value_matches",
    {
        "map": ("any_value_matches(Log.Attributes, '^(GET|his.*)$')", "event_id % 2 = 0 OR svc = 'history'"),
        "list": (f"any_value_matches({_TEXT_LIST}, '^event (view|click)')", "event_type IN ('view', 'click')"),
        "text": ("any_value_matches(Log.Service, '^sh')", "svc = 'shop'"),
        "items": (f"any_item_matches({_TEXT_LIST}, '^his')", "svc = 'history'"),
        "empty": ("any_item_matches(Request.Tags, '.')", "false"),
    },
)
_function(
    "f17_any_matches",
    {
        "map": ("any_matches(Log.Attributes, '^(method|shop)$')", "event_id % 2 = 0 OR svc = 'shop'"),
        "text": ("any_matches(Log.Service, '^sh')", "svc = 'shop'"),
        "list": (f"any_matches({_TEXT_LIST}, '^(shop|event view)')", "svc = 'shop' OR event_type = 'view'"),
    },
)
_function(
    "f18_any_entry_matches",
    {"map": ("any_entry_matches(Log.Attributes, '^(name|body)$', '^(shop|click)$')", "svc = 'shop' OR event_type = 'click'")},
)
_function(
    "f19_all_entries_match",
    {
        "map": ("all_entries_match(Log.Attributes, '^[a-z_]+$', '.')", "event_id % 5 <> 0"),
        "empty": ("all_entries_match(Request.Http.Headers, 'x', 'x')", "true"),
    },
)
_SETS = (
    PatternSet("stems", "contains", ("Krat", "hist", "it's")),
    PatternSet("ends", "regex", ("o[pr]y?$", r"^void\w+$")),
)
_function(
    "f20_contains_any",
    {"set": ("contains_any(Log.Service, 'stems')", "contains(svc, 'Krat') OR contains(svc, 'hist')")},
    pattern_sets=_SETS,
)
_function(
    "f21_matches_any",
    {"set": ("matches_any(Log.Service, 'ends')", r"regexp_matches(svc, 'o[pr]y?$') OR regexp_matches(svc, '^void\w+$')")},
    pattern_sets=_SETS,
)

# Rules over long free text, whole texts of three tables.
_TEXT_RULES = {
    "stem": ("contains(Log.Message, 'tion')", "contains(text, 'tion')"),
    "shape": ("matches(Log.Message, '[0-9]{3}[- ][0-9]{2}')", "regexp_matches(text, '[0-9]{3}[- ][0-9]{2}')"),
    "set": (
        "contains_any(lower_ascii(Log.Message), 'words')",
        "contains(text, 'license') OR contains(text, 'License') OR contains(text, 'LICENSE') OR contains(text, '<article>')",
    ),
    "long": ("byte_size(Log.Message) > 2000", "strlen(rtrim(text, chr(10) || chr(13))) > 2000"),
}


def _text_query(table: str, key_sql: str) -> None:
    words = PatternSet("words", "contains", ("license", "<article>"))
    rules = _rules({n: t[0] for n, t in _TEXT_RULES.items()}, pattern_sets=(words,))

    def run(spark, sf_dir):
        rows = evaluate(text_table(spark, sf_dir, table), rules)
        return rows.select("ord", "condition", "matched")

    source = f"SELECT {key_sql} AS ord, {'html' if table == 'pages' else 'text'} AS text FROM {table}"
    sql = f"WITH x AS ({source}) " + _answers_sql("ord", "x", {n: t[1] for n, t in _TEXT_RULES.items()})
    query(f"text_rules_{table}", sql)(run)


_text_query("documents", "doc_id")
_text_query("pages", "page_id")
_text_query("conversations", "conv_id * 1000 + turn")

# ------------------------------------------------------------------ evaluation

_G_RULES = RuleSet(
    rules=(
        Rule("errors", "Log.Level = 'error'", id="r-1", tags=("a", "b"), priority=20),
        Rule("ory", "Log.Source == 'ory' AND startswith(Log.Message, 'event view')", priority=10),
        Rule("always", "true", priority=10),
        Rule("text", "Log.Message", priority=30),
        Rule("number", "CAST(Log.Attributes['word'] AS INT) > 50", priority=40),
    )
)
_G_SQL = """SELECT e.event_id, r.rule_rank, r.condition,
 CASE r.condition WHEN 'errors' THEN event_type = 'error' WHEN 'ory' THEN src = 'ory' AND event_type = 'view'
 WHEN 'always' THEN true WHEN 'text' THEN false ELSE event_id % 3 = 0 AND k > 50 END AS matched,
 CASE WHEN r.condition = 'text' THEN 'no answer: condition is string, not true or false'
 WHEN r.condition = 'number' AND event_id % 3 > 0 THEN 'no answer: condition is null' END AS error
 FROM e CROSS JOIN (VALUES (0, 'always'), (1, 'ory'), (2, 'errors'), (3, 'text'), (4, 'number')) r(rule_rank, condition)"""


def _g_records(spark, sf_dir):
    word = F.when(c("event_id") % 3 == 0, c("k").cast("string")).when(c("event_id") % 3 == 1, F.lit("many"))
    return parse(events(spark, sf_dir), app_line(word=word), keep=["event_id"])


@query("g1_evaluate", oracle(_G_SQL))
def g1(spark, sf_dir):
    rows = evaluate(_g_records(spark, sf_dir), _G_RULES)
    return rows.select("event_id", "rule_rank", "condition", "matched", "error")


@query("g2_tristate", oracle(f"SELECT condition, matched, error, count(*) AS n FROM ({_G_SQL}) GROUP BY ALL"))
def g2(spark, sf_dir):
    rows = evaluate(_g_records(spark, sf_dir), _G_RULES)
    return rows.groupBy("condition", "matched", "error").agg(F.count("*").alias("n"))


_NO_TRAPS = RuleSet(
    rules=(
        Rule("guarded", "Log.Service = 'nobody' AND matches(Log.Message, '(')"),
        Rule("broken", "matches(Log.Message, '(') OR Log.Service = 'shop'", priority=1),
        Rule("level", "Log.Level = 'error'", priority=2),
        Rule("other", "'error' <> Log.Level", priority=3),
        Rule("none", "Log.Level IS NULL", priority=4),
        Rule("joined", "Log.Level = 'err' || 'or' -- Log.Level = 'x'", priority=5),
        Rule("among", "(Log.Level) IN ('error', lower('WARNING'))", priority=6),
        Rule("apart", "Log.Level NOT IN ('error', 'info')", priority=7),
        Rule("like", "Log.Level LIKE 'err%'", priority=8),
        Rule("called", "lower_ascii(Log.Level) = 'error'", priority=9),
        Rule("torn", r"Log.Service = 'shop' OR Log.Message LIKE r'a\q'", priority=10),
        Rule("given", "Log.Message LIKE Log.Attributes['p']", priority=11),
        Rule("decoded", "try_url_decode(Log.Attributes['u']) = 'a b'", priority=12),
    ),
)


@query(
    "g2_no_traps",
    oracle(
        """SELECT event_id, condition, matched, CASE WHEN matched IS NULL THEN 'no answer: condition is null' END AS error FROM (
 SELECT event_id, 'guarded' AS condition, false AS matched FROM e
 UNION ALL SELECT event_id, 'broken', CASE WHEN svc = 'shop' THEN true END FROM e
 UNION ALL SELECT event_id, 'level', event_id % 3 <> 0 AND level = 'error' FROM e
 UNION ALL SELECT event_id, 'other', event_id % 3 = 0 OR level <> 'error' FROM e
 UNION ALL SELECT event_id, 'none', event_id % 3 = 0 FROM e
 UNION ALL SELECT event_id, 'joined', event_id % 3 <> 0 AND level = 'error' FROM e
 UNION ALL SELECT event_id, 'among', event_id % 3 <> 0 AND level IN ('error', 'warning') FROM e
 UNION ALL SELECT event_id, 'apart', event_id % 3 = 0 OR level NOT IN ('error', 'info') FROM e
 UNION ALL SELECT event_id, 'like', CASE WHEN event_id % 3 <> 0 THEN starts_with(level, 'err') END FROM e
 UNION ALL SELECT event_id, 'called', CASE WHEN event_id % 3 <> 0 THEN level = 'error' END FROM e
 UNION ALL SELECT event_id, 'torn', CASE WHEN svc = 'shop' THEN true END FROM e
 UNION ALL SELECT event_id, 'given', CASE event_id % 4 WHEN 0 THEN starts_with(msg, 'event error') WHEN 1 THEN true END FROM e
 UNION ALL SELECT event_id, 'decoded', CASE event_id % 2 WHEN 0 THEN true END FROM e)"""
    ),
)
def g2_no_traps(spark, sf_dir):
    """Neither a malformed pattern, of the rule or of the line, nor an absent level stops the job or other rules."""
    line = to_line(
        time="t", level=F.when(c("event_id") % 3 != 0, c("lvl")), service="svc", message="msg",
        p=F.get(F.array(*map(F.lit, ("event error%", "e_ent%", "a\\q", "%\\"))), (c("event_id") % 4).cast("int")),
        u=F.when(c("event_id") % 2 == 0, F.lit("a%20b")).otherwise(F.lit("%zz")),
    )
    rows = evaluate(parse(events(spark, sf_dir), line, keep=["event_id"]), _NO_TRAPS)
    matched = F.when(c("error").isNull(), c("matched"))
    return rows.select("event_id", "condition", matched.alias("matched"), "error")


def many_rules(n: int):
    """Hits of so many rules on the event lines; for measuring, as its work is a matter of ``n``."""
    rules = tuple(
        Rule(f"r{k}", f"Log.Level = 'error' AND endswith(Log.Message, 'user {k} denied') OR Log.Attributes['none'] = '{k}'")
        for k in range(n)
    )

    def run(spark, sf_dir):
        return evaluate(_g_records(spark, sf_dir), RuleSet(rules=rules), hits_only=True).select("event_id", "condition")

    return run


@query("g3_hits", oracle(f"SELECT event_id, condition FROM ({_G_SQL}) WHERE matched OR error IS NOT NULL"))
def g3(spark, sf_dir):
    return evaluate(_g_records(spark, sf_dir), _G_RULES, hits_only=True).select("event_id", "condition")


_MERGED = RuleSet(
    rules=(
        Rule("and_or", groups=("bad", "either")),
        Rule("overridden", "Log.Source = 'ory'", groups=("bad", "reset"), merge_condition_as="or"),
        Rule("nothing", groups=("hollow",), when="Log.Source = 'authelia'"),
    ),
    groups=(
        Group("bad", "Log.Level = 'error'"),
        Group("either", conditions=(Fragment("Log.Source = 'shop'", "or"), Fragment("Log.Service <> 'history'"))),
        Group("reset", "Log.Level = 'debug'", merge_condition_as="override"),
        Group("hollow", conditions=(Fragment("Log.Level = 'info'"),)),
    ),
)


@query(
    "g5_merge",
    "WITH e AS (" + EVENTS_SQL + ") "
    + _answers_sql(
        "event_id",
        "e",
        {
            "and_or": "(level = 'error' OR src = 'shop') AND svc <> 'history'",
            "overridden": "level = 'debug' OR src = 'ory'",
            "nothing": "level = 'info' AND src = 'authelia'",
        },
    ),
)
def g5(spark, sf_dir):
    rows = evaluate(_g_records(spark, sf_dir), _MERGED)
    return rows.select("event_id", "condition", "matched")


_GROUPED = RuleSet(
    rules=(
        Rule("shared", groups=("pick",)),
        Rule("shadowed", groups=("pick", "more"), rule_groups=(Group("pick", "Log.Level = 'debug'"),)),
    ),
    groups=(Group("pick", "Log.Level = 'error'"), Group("more", "Log.Source = 'ory'", merge_condition_as="or")),
)


@query(
    "g6_groups",
    "WITH e AS (" + EVENTS_SQL + ") "
    + _answers_sql(
        "event_id", "e", {"shared": "level = 'error'", "shadowed": "level = 'debug' OR src = 'ory'"}
    ),
)
def g6(spark, sf_dir):
    rows = evaluate(_g_records(spark, sf_dir), _GROUPED)
    return rows.select("event_id", "condition", "matched")


@query(
    "g5_table_merge",
    """WITH u AS (SELECT DISTINCT user_id AS u FROM events),
 own AS (SELECT u, 'Log.Service = ' || chr(39) || 's' || u || chr(39) AS w,
   CASE u % 3 WHEN 0 THEN 'and' WHEN 1 THEN 'or' ELSE 'override' END AS m,
   CASE u % 4 WHEN 0 THEN '(a = 1)' WHEN 1 THEN '((a = 1)) OR (b = ' || u || ')' WHEN 2 THEN '(c)' END AS head FROM u),
 told AS (SELECT *, u % 6 <> 5 AS has FROM own)
SELECT 'r' || u AS name,
 CASE WHEN u % 4 = 3 OR u % 4 = 2 AND has AND m = 'override' THEN NULL WHEN NOT has THEN head
   WHEN m = 'override' THEN '(' || w || ')' ELSE '(' || head || ') ' || upper(m) || ' (' || w || ')' END AS condition,
 CASE WHEN u % 4 = 3 THEN 'no such group: none' WHEN u % 4 = 2 AND has AND m = 'override' THEN 'more than one override' END AS error
FROM told""",
)
def g5_table_merge(spark, sf_dir):
    """Conditions of one rule per user, folded from groups in tables; some hide shared groups, some are broken."""
    users = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct()
    u = c("user_id")
    group = "struct<name: string, when: string, merge_condition_as: string, conditions: array<struct<when: string, merge_condition_as: string>>>"
    local = F.struct(
        F.lit("second").alias("name"), F.concat(F.lit("b = "), u).alias("when"), F.lit("or").alias("merge_condition_as"),
        F.array().cast("array<struct<when: string, merge_condition_as: string>>").alias("conditions"),
    )
    names = F.when(u % 4 == 0, F.array(F.lit("first"))).when(u % 4 == 1, F.array(F.lit("first"), F.lit("second")))
    names = names.when(u % 4 == 2, F.array(F.lit("first"), F.lit("third"))).otherwise(F.array(F.lit("none"), F.lit("first")))
    rules = users.select(
        F.concat(F.lit("r"), u).alias("name"), F.when(u % 6 != 5, F.concat(F.lit("Log.Service = 's"), u, F.lit("'"))).alias("when"),
        names.alias("groups"), F.get(F.array(*map(F.lit, ("and", "or", "override"))), (u % 3).cast("int")).alias("merge_condition_as"),
        F.when(u % 4 == 1, F.array(local)).cast(f"array<{group}>").alias("rule_groups"),
    )
    groups = spark.createDataFrame(
        [("first", "a = 1", "and", []), ("second", "hidden", "and", []), ("third", None, "and", [("x", "and"), ("c", "override")])],
        "name string, when string, merge_condition_as string, conditions array<struct<when: string, merge_condition_as: string>>",
    )
    return merged_conditions(rules, groups)


@query(
    "h9_generations",
    """WITH g AS (SELECT user_id AS generation, min(ts) AS valid_from FROM events WHERE user_id % 5 = 0 GROUP BY user_id)
SELECT event_id, (SELECT max(generation) FROM g WHERE valid_from = (SELECT max(valid_from) FROM g WHERE valid_from <= ts)) AS generation
FROM events""",
)
def h9_generations(spark, sf_dir):
    """Every event with the last generation begun at its time; every fifth user begins one with its first event."""
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    begun = table.where(c("user_id") % 5 == 0).groupBy(c("user_id").alias("generation")).agg(F.min("ts").alias("valid_from"))
    return at_generation(table.select("event_id", "ts"), begun, c("ts")).select("event_id", "generation")


def _rule_definitions(spark, sf_dir):
    """Every event as a rule definition, some of them broken."""
    texts = events(spark, sf_dir)
    return texts.select(
        F.when(c("event_id") % 50 == 1, F.lit(" "))
        .when(c("event_id") % 50 == 2, F.lit("twice"))
        .otherwise(F.concat(F.lit("rule-"), "event_id"))
        .alias("name"),
        F.when(c("event_id") % 2 == 0, F.concat(F.lit("id-"), F.floor(c("event_id") / 3))).alias("id"),
        F.when(c("event_id") % 40 == 7, F.lit(-1)).otherwise(c("k")).alias("priority"),
        F.when(c("event_id") % 30 == 11, F.lit(None)).when(c("event_id") % 30 == 12, F.lit("\t")).otherwise(F.lit("true")).alias("when"),
        F.when(c("event_id") % 60 == 11, F.array(F.lit("g"))).otherwise(F.array().cast("array<string>")).alias("groups"),
        "event_id",
        "user_id",
    )


_RULES_SQL = """SELECT event_id, user_id, CASE event_id % 50 WHEN 1 THEN ' ' WHEN 2 THEN 'twice' ELSE 'rule-' || event_id END AS name,
 CASE WHEN event_id % 2 = 0 THEN 'id-' || (event_id // 3) END AS id FROM events"""


@query(
    "g8_validate",
    f"""WITH r AS ({_RULES_SQL})
 SELECT name, 'no name' AS problem FROM r WHERE event_id % 50 = 1
 UNION ALL SELECT name, 'priority below zero' FROM r WHERE event_id % 40 = 7
 UNION ALL SELECT name, 'neither when nor groups' FROM r WHERE event_id % 30 = 11 AND event_id % 60 <> 11
 UNION ALL SELECT name, 'empty condition' FROM r WHERE event_id % 30 = 12
 UNION ALL SELECT name, 'name occurs twice' FROM r GROUP BY name HAVING count(*) > 1
 UNION ALL SELECT id, 'id occurs twice' FROM r WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1""",
)
def g8(spark, sf_dir):
    return validate_rule_table(_rule_definitions(spark, sf_dir))


@query(
    "g9_disabled",
    "SELECT count(*) AS records, 0 AS evaluations FROM events",
)
def g9(spark, sf_dir):
    records = _g_records(spark, sf_dir)
    off = RuleSet(rules=(Rule("broken", "no expression ("),), conditions_enabled=False)
    rows = records.select(F.lit(0).alias("is_answer")).unionByName(
        evaluate(records, off).select(F.lit(1).alias("is_answer"))
    )
    return rows.agg(
        F.count_if(c("is_answer") == 0).alias("records"),
        F.count_if(c("is_answer") == 1).cast("int").alias("evaluations"),
    )


@query(
    "g11_summary",
    oracle(
        f"""SELECT rule_rank, condition, CASE condition WHEN 'errors' THEN 'r-1' END AS id,
 CASE condition WHEN 'errors' THEN 'a,b' ELSE '' END AS tags,
 CAST(CASE condition WHEN 'errors' THEN 20 WHEN 'text' THEN 30 WHEN 'number' THEN 40 ELSE 10 END AS BIGINT) AS priority,
 count(*) FILTER (WHERE matched) AS matches FROM ({_G_SQL}) GROUP BY rule_rank, condition"""
    ),
)
def g11(spark, sf_dir):
    rows = evaluate(_g_records(spark, sf_dir), _G_RULES)
    return rows.groupBy(
        "rule_rank", "condition", c("rule_id").alias("id"), F.array_join("tags", ",").alias("tags"), "priority"
    ).agg(F.count_if("matched").alias("matches"))


@query(
    "g1_rule_table",
    f"""WITH e AS ({EVENTS_SQL}), r AS (SELECT 'rule-' || u AS condition, u, d.svc, d.level FROM
 (SELECT user_id AS u, min(svc) AS svc, min(level) AS level FROM e GROUP BY user_id) d)
 SELECT event_id, r.condition FROM e JOIN r ON e.src = CASE r.svc WHEN 'shop' THEN 'docker_logs' ELSE 'ory' END
 AND (r.u % 2 = 0 OR e.level = r.level) AND contains(e.msg, CAST(r.u AS VARCHAR))
 UNION ALL SELECT event_id, 'any-' || r.u FROM e JOIN r ON e.svc = r.svc AND e.level = r.level AND contains(e.msg, 'user ' || r.u)""",
)
def g1_table(spark, sf_dir):
    """Rules made from the users of the table, as many as there are users."""
    table = events(spark, sf_dir)
    records = parse(table, app_line(), keep=["event_id"])
    levels = records.join(table.select("event_id", "user_id", "svc"), "event_id")
    users = levels.groupBy("user_id").agg(F.min("svc").alias("svc"), F.min("level").alias("lv"))
    no_text = F.lit(None).cast("string")
    sourced = users.select(
        F.concat(F.lit("rule-"), "user_id").alias("condition"),
        F.when(c("svc") == "shop", F.lit("docker_logs")).otherwise(F.lit("ory")).alias("source_eq"),
        F.when(c("user_id") % 2 == 1, c("lv")).alias("level_eq"),
        no_text.alias("service_eq"),
        F.array(c("user_id").cast("string")).alias("contains"),
    )
    anywhere = users.select(
        F.concat(F.lit("any-"), "user_id").alias("condition"),
        no_text.alias("source_eq"),
        c("lv").alias("level_eq"),
        c("svc").alias("service_eq"),
        F.array(F.concat(F.lit("user "), "user_id")).alias("contains"),
    )
    rows = evaluate_table(records, sourced.unionByName(anywhere))
    return rows.where("matched").select("event_id", "condition")


@query(
    "g1_text_rules_table",
    """WITH parts AS (SELECT doc_id, k, substr(text, 30 * k + 11, 12) AS part FROM documents, range(10) t(k)),
 rules AS (SELECT 'r' || doc_id || '-' || k AS condition, part,
   CASE WHEN k = 3 THEN substr(text, 1, 3) WHEN k = 4 THEN substr(text, 400, 8) ELSE '' END AS more
   FROM parts JOIN documents USING (doc_id) WHERE length(part) = 12 AND regexp_matches(part, '^[a-zA-Z ,.]*$') AND part = trim(part))
 SELECT d.doc_id, r.condition FROM documents d JOIN rules r ON contains(d.text, r.part) AND contains(d.text, r.more)""",
)
def g1_text_rules_table(spark, sf_dir):
    """Rules of literals alone, up to ten from every document, on the texts of all documents."""
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    part = F.substring("text", 30 * c("k") + 11, F.lit(12))
    parts = texts.select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("k")).select("doc_id", "k", "text", part.alias("part"))
    parts = parts.where((F.char_length("part") == 12) & c("part").rlike(r"^[a-zA-Z ,.]*\z") & (c("part") == F.trim("part")))
    more = F.when(c("k") == 3, F.substring("text", 1, 3)).when(c("k") == 4, F.substring("text", 400, 8)).otherwise(F.lit(""))
    none = F.lit(None).cast("string")
    rules = parts.select(
        F.concat(F.lit("r"), "doc_id", F.lit("-"), "k").alias("condition"), none.alias("source_eq"), none.alias("level_eq"),
        none.alias("service_eq"), F.array("part", more).alias("contains"),
    )
    return evaluate_table(text_table(spark, sf_dir, "documents"), rules).select(c("ord").alias("doc_id"), "condition")


_TABLE_HANDLERS = RuleSet(
    conditions_enabled=True,
    rules=(Rule("views", "true"), Rule("loud", "true")),
    handlers=(
        Handler("second", "loud", 2, (Action("emit_decision", 1, severity="low"),)),
        Handler("first", "loud", 1, (Action("emit_callback_intent", 3, target="t", operation="o"), Action("emit_decision", 2))),
        Handler("bare", "views", 3),
    ),
)


@query(
    "g1_table_decisions",
    oracle(
        """SELECT event_id, rule_rank, condition, handler, action_rank, outcome, severity FROM (
 SELECT event_id, 1 AS rule_rank, 'views' AS condition, 'bare' AS handler, 0 AS action_rank, 'matched' AS outcome, NULL AS severity
   FROM e WHERE event_type = 'view' AND event_id % 5 <> 0
 UNION ALL SELECT event_id, 0, 'loud', v.* FROM e, (VALUES ('first', 0, 'matched', NULL), ('first', 1, 'callback_intent', NULL),
   ('second', 0, 'matched', 'low')) v WHERE level = 'error' AND event_id % 3 <> 0 AND event_id % 5 <> 0)"""
    ),
)
def g1_table_decisions(spark, sf_dir):
    """Rules and handlers kept in tables, to decisions; some lines are broken, some have no level."""
    whole = to_line(time="t", level=F.when(c("event_id") % 3 != 0, c("lvl")), service="svc", message="msg")
    line = F.when(c("event_id") % 5 == 0, F.concat(whole, F.lit("}"))).otherwise(whole)
    records = parse(events(spark, sf_dir), line, keep=["event_id"])
    rules = spark.createDataFrame(
        [("loud", None, "error", None, [], 1), ("views", None, None, None, ["event view"], 2), ("unheard", None, None, "shop", [], 3)],
        "condition string, source_eq string, level_eq string, service_eq string, contains array<string>, priority bigint",
    )
    handlers = _TABLE_HANDLERS.handler_frame(spark)
    rows = decide(evaluate_table(records, rules), handlers, "monitor", 1)
    return rows.select(
        c("ord").alias("event_id"), "rule_rank", "condition", "handler", "action_rank", "outcome", "severity"
    )


_SYLLABLES = "the er and on ing tion re ha en in ed es at or st nt ly an le wh".split()
_MANY = tuple(a + b + d for a in _SYLLABLES for b in _SYLLABLES for d in _SYLLABLES)
_LITERALS = RuleSet(
    rules=(
        Rule("ends", "contains_any(Log.Message, 'ends')"),
        Rule("doubled", "contains_any(Log.Message, 'doubled')"),
        Rule("signs", "contains_any(Log.Message, 'signs')"),
    ),
    pattern_sets=(
        PatternSet("ends", "contains", tuple(f"{word}.\n" for word in _MANY)),
        PatternSet("doubled", "contains", tuple(f" {word}{word[::-1]}" for word in _MANY)),
        PatternSet("signs", "contains", ("#{(", "$^", "\\E", "[a]|*", "##", "= \"")),
    ),
)


@query(
    "f20_many_literals",
    f"""WITH s AS (SELECT unnest({_SYLLABLES!r}) AS x), many AS (SELECT a.x || b.x || d.x AS w FROM s a, s b, s d),
 ends AS (SELECT w || '.' || chr(10) AS w FROM many), doubled AS (SELECT ' ' || w || reverse(w) AS w FROM many)
SELECT doc_id, 'ends' AS condition, count(*) > 0 AS matched FROM documents SEMI JOIN ends ON contains(text, w) GROUP BY doc_id
UNION ALL SELECT doc_id, 'doubled', true FROM documents SEMI JOIN doubled ON contains(text, w)
UNION ALL SELECT doc_id, 'signs', true FROM documents WHERE contains(text, '##') OR contains(text, '= "') OR contains(text, '$^')
  OR contains(text, '#{{(') OR contains(text, chr(92) || 'E') OR contains(text, '[a]|*')""",
)
def f20_many_literals(spark, sf_dir):
    """Sets of eight thousand literals on the texts of all documents."""
    rows = evaluate(text_table(spark, sf_dir, "documents"), _LITERALS, hits_only=True)
    return rows.select(c("ord").alias("doc_id"), "condition", "matched")


@query(
    "f10_network_table",
    f"""WITH e AS ({EVENTS_SQL}), r AS (SELECT event_id, user_id, user_id % 4 AS a, k % 256 AS b, event_id % 256 AS d,
  CASE WHEN event_id % 11 = 0 THEN 'x' ELSE '10.' || user_id % 4 || '.' || k % 256 || '.' || event_id % 256 END AS ip,
  ((user_id % 4) * 256 + k % 256) * 256 + event_id % 256 AS n FROM e),
 nets AS (SELECT DISTINCT '10.' || a || '.' || b || '.' || d || '/' || p AS cidr, n // (1 << (32 - p)) AS part, p
   FROM (SELECT *, CAST(22 + user_id % 9 AS INTEGER) AS p FROM r WHERE event_id % 7 = 0)),
 firsts AS (SELECT part, p, min(cidr) AS cidr FROM nets GROUP BY part, p),
 sizes AS (SELECT DISTINCT p FROM firsts)
SELECT event_id, ip, arg_max(cidr, p) AS cidr FROM (
  SELECT r.event_id, r.ip, f.cidr, f.p FROM r JOIN sizes s ON true
    LEFT JOIN firsts f ON r.ip <> 'x' AND f.p = s.p AND f.part = r.n // (1 << (32 - s.p))) GROUP BY event_id, ip""",
)
def f10_network_table(spark, sf_dir):
    """Every event's address in networks made of every seventh event's, of nine sizes and some of the other family."""
    octets = [c("user_id") % 4, c("k") % 256, c("event_id") % 256]
    ip = F.concat_ws(".", F.lit("10"), *octets)
    table = events(spark, sf_dir)
    line = app_line(ip=F.when(c("event_id") % 11 == 0, F.lit("x")).otherwise(ip))
    records = with_roots(parse(table, line, keep=["event_id"])).select("event_id", c("Request.Client.Ip").alias("ip"))
    own = table.where(c("event_id") % 7 == 0)
    networks = own.select(F.concat(ip, F.lit("/"), 22 + c("user_id") % 9).alias("cidr"), F.lit(4).alias("family"))
    others = own.select(F.concat(F.lit("fe80::"), c("event_id") % 256, F.lit("/"), 100 + c("user_id") % 40).alias("cidr"), F.lit(6).alias("family"))
    found = longest_networks(records, networks.union(others).distinct(), c("ip"))
    return found.select("event_id", "ip", c("network.cidr").alias("cidr"))


# ------------------------------------------------------------------ decisions

_JUDGED = RuleSet(
    rules=(
        Rule("errors", "Log.Level = 'error'", priority=5),
        Rule("views", "startswith(Log.Message, 'event view')", priority=1),
        Rule("unheard", "true", priority=2),
        Rule("number", "CAST(Log.Attributes['word'] AS INT) > 50", priority=9),
    ),
    handlers=(
        Handler(
            "alert",
            "errors",
            2,
            (
                Action("emit_callback_intent", 7, target="edge", operation="review", dedupe_key="d-1", payload={"k": "v", "a": "b"}),
                Action("emit_decision", 1, severity="high", message="seen"),
                Action("emit_decision", 1),
            ),
        ),
        Handler("aaa", "errors", 2, (Action("emit_decision", severity="low"),)),
        Handler("note", "views", 9),
    ),
    mode="enforce",
    generation=3,
)
_DECISIONS_SQL = """SELECT e.event_id, a.rule_rank, a.handler_rank, a.action_rank, a.condition, a.handler, a.outcome, a.severity,
 a.message, a.target, a.operation, a.dedupe_key, a.payload, e.src AS record_source, e.msg AS record_message FROM e JOIN (VALUES
 (0, 2, 0, 'views', 'note', 'matched', NULL, NULL, NULL, NULL, NULL, NULL),
 (2, 0, 0, 'errors', 'aaa', 'matched', 'low', NULL, NULL, NULL, NULL, NULL),
 (2, 1, 0, 'errors', 'alert', 'matched', 'high', 'seen', NULL, NULL, NULL, NULL),
 (2, 1, 1, 'errors', 'alert', 'matched', NULL, NULL, NULL, NULL, NULL, NULL),
 (2, 1, 2, 'errors', 'alert', 'callback_intent', NULL, NULL, 'edge', 'review', 'd-1', 'a=b,k=v'),
 (3, 0, 0, 'number', NULL, 'error', 'error', 'no answer: condition is null', NULL, NULL, NULL, NULL)
 ) a(rule_rank, handler_rank, action_rank, condition, handler, outcome, severity, message, target, operation, dedupe_key, payload)
 ON CASE a.condition WHEN 'views' THEN event_type = 'view' WHEN 'errors' THEN event_type = 'error' ELSE event_id % 3 > 0 END"""


def _decisions(spark, sf_dir):
    return judge(_g_records(spark, sf_dir), _JUDGED)


def _flat(decisions, *more):
    intent = c("callback_intent")
    pairs = F.transform(F.array_sort(F.map_entries(intent["payload"])), lambda p: F.concat_ws("=", p["key"], p["value"]))
    return decisions.select(
        c("ord").alias("event_id"), "rule_rank", "handler_rank", "action_rank", "condition", "handler", "outcome",
        "severity", "message", intent["target"].alias("target"), intent["operation"].alias("operation"),
        intent["dedupe_key"].alias("dedupe_key"), F.array_join(pairs, ",").alias("payload"),
        "record_source", "record_message", *more,
    )


@query("h1_handlers", oracle(f"SELECT DISTINCT event_id, condition, handler FROM ({_DECISIONS_SQL}) WHERE handler IS NOT NULL"))
def h1(spark, sf_dir):
    rows = _decisions(spark, sf_dir).where(c("handler").isNotNull() & (c("action_rank") == 0))
    return rows.select(c("ord").alias("event_id"), "condition", "handler")


@query("h2_actions", oracle(f"SELECT event_id, handler, action_rank, outcome, severity FROM ({_DECISIONS_SQL}) WHERE condition = 'errors'"))
def h2(spark, sf_dir):
    rows = _flat(_decisions(spark, sf_dir)).where("condition = 'errors'")
    return rows.select("event_id", "handler", "action_rank", "outcome", "severity")


@query("h3_no_action", oracle(f"SELECT event_id, outcome, severity, message FROM ({_DECISIONS_SQL}) WHERE condition = 'views'"))
def h3(spark, sf_dir):
    rows = _flat(_decisions(spark, sf_dir)).where("condition = 'views'")
    return rows.select("event_id", "outcome", "severity", "message")


@query("h6_errors", oracle(f"SELECT event_id, condition, handler, outcome, severity, message FROM ({_DECISIONS_SQL}) WHERE outcome = 'error'"))
def h6(spark, sf_dir):
    rows = _flat(_decisions(spark, sf_dir)).where("outcome = 'error'")
    return rows.select("event_id", "condition", "handler", "outcome", "severity", "message")


@query(
    "h8_callbacks",
    oracle(f"SELECT event_id, target, operation, dedupe_key, payload FROM ({_DECISIONS_SQL}) WHERE outcome = 'callback_intent'"),
)
def h8(spark, sf_dir):
    rows = _flat(_decisions(spark, sf_dir)).where("outcome = 'callback_intent'")
    return rows.select("event_id", "target", "operation", "dedupe_key", "payload")


@query(
    "h9_stamps",
    oracle(
        f"""SELECT event_id, CAST(3 AS BIGINT) AS generation, 'enforce' AS mode, record_source, record_message, true AS is_timed
 FROM ({_DECISIONS_SQL})"""
    ),
)
def h9(spark, sf_dir):
    rows = _flat(_decisions(spark, sf_dir), "generation", "mode", (c("created_at_unix_ms") > 0).alias("is_timed"))
    return rows.select("event_id", "generation", "mode", "record_source", "record_message", "is_timed")


_ORDER = "event_id, rule_rank, handler_rank, action_rank"


@query(
    "h10_sequence",
    oracle(
        f"""SELECT 'decision-' || row_number() OVER (ORDER BY {_ORDER}) AS id, {_ORDER}, condition
 FROM ({_DECISIONS_SQL})"""
    ),
)
def h10(spark, sf_dir):
    rows = with_ids(_decisions(spark, sf_dir))
    return rows.select("id", c("ord").alias("event_id"), "rule_rank", "handler_rank", "action_rank", "condition")


@query(
    "h12_recent",
    oracle(f"SELECT {_ORDER}, condition, outcome FROM ({_DECISIONS_SQL}) ORDER BY event_id DESC, rule_rank DESC, handler_rank DESC, action_rank DESC LIMIT 256"),
)
def h12(spark, sf_dir):
    rows = recent(_decisions(spark, sf_dir), _JUDGED.max_decisions)
    return rows.select(c("ord").alias("event_id"), "rule_rank", "handler_rank", "action_rank", "condition", "outcome")


@query("h13_disabled", "SELECT count(*) AS records, 0 AS decisions FROM events")
def h13(spark, sf_dir):
    records = _g_records(spark, sf_dir)
    off = RuleSet(rules=_JUDGED.rules, handlers=_JUDGED.handlers, judgment_enabled=False)
    rows = records.select(F.lit(0).alias("is_decision")).unionByName(
        judge(records, off).select(F.lit(1).alias("is_decision"))
    )
    return rows.agg(
        F.count_if(c("is_decision") == 0).alias("records"),
        F.count_if(c("is_decision") == 1).cast("int").alias("decisions"),
    )


@query(
    "h14_validate",
    f"""WITH r AS ({_RULES_SQL}), h AS (SELECT CASE WHEN event_id % 25 = 3 THEN 'again' WHEN event_id % 25 = 4 THEN '' ELSE 'h-' || event_id END AS name,
 CASE WHEN event_id % 9 = 5 THEN '  ' ELSE 'rule-' || (event_id + 1) END AS condition, event_id FROM events)
 SELECT name, 'no name' AS problem FROM h WHERE name = ''
 UNION ALL SELECT name, 'no condition' FROM h WHERE condition = '  '
 UNION ALL SELECT name, 'priority below zero' FROM h WHERE event_id % 21 = 6
 UNION ALL SELECT name, 'action priority below zero' FROM h WHERE event_id % 33 = 8
 UNION ALL SELECT name, 'no such condition' FROM h WHERE condition <> '  ' AND NOT EXISTS (SELECT 1 FROM r WHERE r.name = h.condition)
 UNION ALL SELECT name, 'name occurs twice' FROM h GROUP BY name HAVING count(*) > 1""",
)
def h14(spark, sf_dir):
    at = c("event_id")
    handlers = events(spark, sf_dir).select(
        F.when(at % 25 == 3, F.lit("again")).when(at % 25 == 4, F.lit("")).otherwise(F.concat(F.lit("h-"), at)).alias("name"),
        F.when(at % 9 == 5, F.lit("  ")).otherwise(F.concat(F.lit("rule-"), at + 1)).alias("condition"),
        F.when(at % 21 == 6, F.lit(-3)).otherwise(F.lit(0)).alias("priority"),
        F.when(at % 33 == 8, F.array(F.lit(1), F.lit(-1))).otherwise(F.array(F.lit(0))).alias("action_priorities"),
    )
    return validate_handler_table(handlers, _rule_definitions(spark, sf_dir))


@query(
    "h15_status",
    oracle(
        f"""SELECT CAST(3 AS BIGINT) AS generation, '"judgment-3"' AS etag, true AS enabled, 'enforce' AS mode, h.name, h.condition, h.actions,
 (SELECT count(*) FROM ({_DECISIONS_SQL}) d WHERE d.handler = h.name) AS decisions
 FROM (VALUES ('aaa', 'errors', 1), ('alert', 'errors', 3), ('note', 'views', 0)) h(name, condition, actions)"""
    ),
)
def h15(spark, sf_dir):
    made = _decisions(spark, sf_dir).groupBy(c("handler").alias("name")).agg(F.count("*").alias("decisions"))
    listed = status(spark, _JUDGED).select("generation", "etag", "enabled", "mode", F.inline("handlers"))
    rows = listed.join(made, "name", "left")
    return rows.select(
        "generation", "etag", "enabled", "mode", "name", "condition", "actions",
        F.coalesce("decisions", F.lit(0)).alias("decisions"),
    )


# All lanes, then rules, handlers and actions: the whole way in one query.
def mixed_lines(spark, sf_dir):
    word = F.when(c("event_id") % 3 == 0, c("k").cast("string")).when(c("event_id") % 3 == 1, F.lit("many"))
    app = app_line(word=word)
    kinds = [
        app,
        to_line(log=F.concat(app, F.lit("\n")), stream=F.lit("stdout"), time="t"),
        to_line(request_id="user_id", actor="svc", message="msg", created_at="t", level="lvl", word=word),
        F.concat(F.lit("time="), c("t"), F.lit(" level="), F.trim("lvl"), F.lit(' msg="'), c("msg"), F.lit('" word='), F.coalesce(word, F.lit("-"))),
    ]
    line = kinds[0]
    for i, kind in enumerate(kinds[1:], 1):
        line = F.when(c("event_id") % 4 == i, kind).otherwise(line)
    return events(spark, sf_dir).select("ord", line.alias("value"))


_MIXED_SQL = _DECISIONS_SQL.replace(
    "e.src AS record_source",
    "CASE event_id % 4 WHEN 0 THEN e.src WHEN 2 THEN 'openapi' ELSE 'docker_logs' END AS record_source",
)


def end_to_end(spark, sf_dir):
    return _flat(judge(normalize(mixed_lines(spark, sf_dir)), _JUDGED))


query("h16_end_to_end", oracle(_MIXED_SQL))(end_to_end)


@query("s1_stream_decisions", oracle(_MIXED_SQL))
def s1(spark, sf_dir):
    """The flagship on a stream: lines land as files, decisions are appended to a table."""
    folder = scratch(spark)
    lines = mixed_lines(spark, sf_dir)
    lines.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 4).parquet(f"{folder}/in")
    decisions = judge(normalize(stream), _JUDGED)
    run_to_table(decisions, f"{folder}/out", f"{folder}/state").awaitTermination()
    return _flat(spark.read.schema(decisions.schema).parquet(f"{folder}/out"))


def _median(rows, name, bits=14):
    """The exact median of a column of whole numbers, as ``F.median`` gives it, by counting.

    ``F.median`` holds every different value in one task. Here ranges of values are counted, about ``2 ** bits`` at a time, and
    the range that holds the middle is counted anew, more finely; a task holds those counts and no values.
    """
    facts = rows.agg(F.count(name).alias("rows"), F.min(name).alias("low"), F.max(name).alias("high")).first()
    known = {}

    def counts(low, high, shift):
        if (low, high) not in known:
            inside = rows.where(c(name).between(low, high)).groupBy(F.shiftright(name, shift).alias("range"))
            known[low, high] = sorted(inside.agg(F.count("*")).collect())
        return known[low, high]

    def at(rank):
        low, high = facts["low"], facts["high"]
        while low < high:
            shift = max(0, (high - low).bit_length() - bits)
            for place, held in counts(low, high, shift):
                if rank < held:
                    break
                rank -= held
            low, high = max(low, place << shift), min(high, (place + 1 << shift) - 1)
        return low

    if not facts["rows"]:
        return None
    before, after = at((facts["rows"] - 1) // 2), at(facts["rows"] // 2)
    return float(before) if before == after else 0.5 * before + 0.5 * after


@query(
    "s2_stream_recent",
    oracle(
        f"""SELECT number, 'decision-' || number AS id, condition, handler, action_rank, outcome, record_message FROM (
 SELECT *, row_number() OVER (ORDER BY event_id >= (SELECT median(event_id) FROM e), {_ORDER}) AS number FROM ({_MIXED_SQL}))
 ORDER BY number DESC LIMIT 256"""
    ),
)
def s2(spark, sf_dir):
    """The latest decisions over micro-batches: two halves, one after the other, numbered on and on."""
    folder = scratch(spark)
    lines = mixed_lines(spark, sf_dir)
    middle = F.lit(_median(lines, "ord"))
    store = RecentStore(spark, f"{folder}/recent", _JUDGED.max_decisions)
    for half in (c("ord") < middle, c("ord") >= middle):
        lines.where(half).repartitionByRange("ord").write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(lines.schema).parquet(f"{folder}/in")
        running = run_recent(stream, _JUDGED, store, f"{folder}/state", sink=f"{folder}/out")
        running.awaitTermination()
    rows = store.read(running.lastProgress["batchId"])
    return rows.select(c("seq").alias("number"), "id", "condition", "handler", "action_rank", "outcome", "record_message")


@query(
    "s3_stream_state",
    oracle(
        f"""SELECT event_id, condition, handler, action_rank, outcome, record_message FROM ({_MIXED_SQL})
 ORDER BY event_id DESC, rule_rank DESC, handler_rank DESC, action_rank DESC LIMIT 256"""
    ),
)
def s3(spark, sf_dir):
    """The latest decisions in the state store, over two runs of one query: the second goes on from its checkpoint."""
    folder = scratch(spark)
    lines = mixed_lines(spark, sf_dir)
    for half in (c("ord") % 2 == 1, c("ord") % 2 == 0):
        lines.where(half).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(lines.schema).parquet(f"{folder}/in")
        decisions = judge(normalize(stream), _JUDGED)
        keep_recent(decisions, _JUDGED.max_decisions, f"{folder}/state", f"{folder}/counts").awaitTermination()
    rows = kept_recent(spark, decisions.schema, _JUDGED.max_decisions, f"{folder}/state")
    return rows.select(c("ord").alias("event_id"), "condition", "handler", "action_rank", "outcome", "record_message")
