"""Lines with known records; all of them go through one job."""

import json
import random

import pytest
from pyspark.sql import functions as F

from logjury import BUILTIN, Descriptor, Provider, UnknownSource, normalize
from logjury.functions.json import open_object, text_map
from logjury.operators import application
from logjury.operators.records import only, record
from logjury.schema import SCHEMA_TAG
from logjury.sources.registry import Registry

DOCKER = "docker_logs"
# The built-in providers with a source of our own.
SOURCES = Registry((*BUILTIN.providers[:-1], application.provider({"edge": ["edge"], **application.SOURCE_WORDS})))

# name -> (requested source, line, expected records); a record is a dict of the fields to check,
# ``None`` instead of the list stands for a quarantined line.
VECTORS = {
    "docker json": (
        "auto",
        r'{"log":"{\"level\":\"Info\",\"service\":\"till-3\",\"msg\":\"drawer open\"}\n","stream":"stderr","time":"2023-11-02T04:05:06.7Z"}',
        [{
            "source": DOCKER, "timestamp": "2023-11-02T04:05:06.7Z", "level": "info",
            "service": "till-3", "message": "drawer open",
            "attributes": {"input_source": DOCKER, "stream": "stderr"},
        }],
    ),
    "linux journal": (
        "auto",
        '{"MESSAGE":"link down on port 7","SYSLOG_IDENTIFIER":"netd","PRIORITY":"4","__REALTIME_TIMESTAMP":"1698897906000001"}',
        [{
            "source": "linux_journal", "timestamp": "1698897906000001", "level": "warning",
            "service": "netd", "message": "link down on port 7", "attributes": {},
        }],
    ),
    "docker journald": (
        "auto",
        '{"MESSAGE":"kiln is hot","PRIORITY":"6","CONTAINER_NAME":"/kiln-2","__REALTIME_TIMESTAMP":"1698897906000001"}',
        [{"source": "docker_journald", "service": "kiln-2", "level": "info", "message": "kiln is hot"}],
    ),
    "app json": (
        "auto",
        '{"service":"edge-north","message":"quota used up","lvl":"warn","ts":"2023-11-02T04:05:07Z","tenant":"t9"}',
        [{"source": "edge", "level": "warning", "attributes": {"tenant": "t9"}}],
    ),
    "authelia": (
        "auto",
        '{"msg":"second factor asked","service":"my-authelia-1","level":"debug"}',
        [{"source": "authelia", "message": "second factor asked"}],
    ),
    "ory": (
        "auto",
        '{"logger":"Hydra admin","event":"client gone","severity":"err"}',
        [{"source": "ory", "level": "error", "message": "client gone"}],
    ),
    "logfmt": (
        "voidauth",
        'level=notice msg="session \\"a\\" closed" seat=14 time=2023-11-02T04:05:08Z',
        [{"source": "voidauth", "message": 'session "a" closed', "attributes": {"seat": "14"}}],
    ),
    "bracketed": (
        "auto",
        "[2023-11-02 04:05:09] [bitwarden/sync] [DEBUG] 12 items sent",
        [{
            "source": "vaultwarden", "service": "bitwarden/sync", "message": "12 items sent",
            "timestamp": "2023-11-02 04:05:09", "level": "debug",
        }],
    ),
    "plain": (
        "docker_logs",
        "2023-11-02T04:05:10Z NOTICE pump primed",
        [{"schema": SCHEMA_TAG, "source": DOCKER, "message": "pump primed", "level": "notice"}],
    ),
    "blank": ("auto", " \t ", []),
    "collection": (
        "auto",
        '{"operations":[{"request_id":"q-77","actor":"robot","service":"depot","operation":"fetch","outcome":"ok","created_at":"2023-11-02"},'
        '{"request_id":"q-78","actor":"robot","service":"depot","operation":"purge","outcome":"failed"}]}',
        [
            {
                "source": "openapi", "service": "depot", "level": "info", "message": "ok",
                "attributes": {"request_id": "q-77", "actor": "robot", "api_collection": "operations"},
            },
            {"level": "error", "message": "failed"},
        ],
    ),
    "trailing junk": ("auto", '{"a":1} junk', None),
    "cut": ("auto", '{"a":', None),
    "docker with broken json": (
        "auto", '{"log":"{\\"a\\":","stream":"s","time":"t"}', [{"source": DOCKER, "message": '{"a":'}]
    ),
    "empty first hit": ("auto", '{"message":"","msg":"x"}', [{"message": "", "attributes": {}}]),
    "null first hit": ("auto", '{"message":null,"msg":"x"}', [{"message": "x"}]),
    "substring source": ("auto", '{"service":"history","msg":"x"}', [{"source": "ory"}]),
    "journal for another source": (
        "edge", '{"MESSAGE":"m","PRIORITY":"9"}', [{"source": "edge", "level": "9"}]
    ),
    "second collection": (
        "auto",
        '{"events":[1,{"event":"e"}],"audit":[]}',
        [{"service": "events", "message": "e", "attributes": {"api_collection": "events"}}],
    ),
    "bare word": (
        "auto", "level=info hello k=v", [{"level": "info", "message": "level=info hello k=v", "attributes": {}}]
    ),
    "no known key": ("auto", "ts=1 k=v", [{"timestamp": None, "message": "ts=1 k=v", "attributes": {}}]),
    "last pair wins": (
        "auto", 'a="x\\"y" msg=m a=2 q="x\\"y\\n', [{"message": "m", "attributes": {"a": "2", "q": 'x"y\\n'}}]
    ),
    "escaped quote at the end": ("auto", 'msg=m q="a\\"', [{"attributes": {"q": 'a"'}}]),
    "lone quote": ("auto", 'msg=m q="', [{"attributes": {"q": ""}}]),
    "operation": (
        "auto",
        '{"operation":{"state":"done"},"event":null,"request_id":"r"}',
        [{
            "source": "openapi", "service": "admin_api", "message": "operation done",
            "attributes": {"operation_state": "done", "request_id": "r"},
        }],
    ),
    "wrapper attributes": (
        "auto",
        '{"log":"x","stream":"s","time":"t","log_id":7,"n":null}',
        [{"attributes": {"input_source": DOCKER, "stream": "s", "log_id": "7"}, "timestamp": "t"}],
    ),
    "log alone": ("auto", '{"log":"x","stream":"s"}', [{"source": DOCKER, "message": "x", "attributes": {"stream": "s"}}]),
    "log alone, asked": ("docker-logs", '{"log":"x"}', [{"attributes": {"input_source": DOCKER}}]),
    "wrapped collection": (
        "auto",
        r'{"log":"{\"audit\":[{\"event\":\"a\"},{\"event\":\"b\"}]}","stream":"s","time":"t"}',
        [{"source": DOCKER, "message": "a", "timestamp": "t"}, {"source": DOCKER, "message": "b"}],
    ),
    "error text": ("openapi", '{"error":"","outcome":"ok"}', [{"message": "", "level": "info"}]),
    "asked for api": ("openapi", '{"x":1}', [{"source": "openapi", "message": "", "attributes": {"x": "1"}}]),
    "numbers": (
        "auto",
        '{"a":1.0,"b":1e20,"c":0.00001,"d":1E-7,"e":12345678.5,"f":18446744073709551615,"g":"1.0E7","h":[1,{"b":1,"a":null}]}',
        [{"attributes": {
            "a": "1.0", "b": "1e20", "c": "0.00001", "d": "1e-7", "e": "12345678.5",
            "f": "18446744073709551615", "g": "1.0E7", "h": '[1,{"a":null,"b":1}]',
        }}],
    ),
    "repeated keys": ("auto", '{"a":1,"b":2,"a":3}', [{"attributes": {"a": "3", "b": "2"}}]),
    "emergency is no token": ("auto", "emergency stop", [{"level": None, "message": "emergency stop"}]),
    "unknown source": ("nowhere", "x", None),
}


def _deep(depth):
    """Wrappers inside wrappers as nested text; every level doubles the escapes."""
    line = '{"msg":"core"}'
    for level in range(depth):
        line = json.dumps({"log": line, "stream": "s", "time": f"t{level}", f"l{level}": level})
    return line


def _deep_object(depth):
    """Wrappers inside wrappers as nested objects; no escapes at all."""
    value = {"msg": "core"}
    for level in range(depth):
        value = {"log": value, "stream": "s", "time": f"t{level}", f"l{level}": level}
    return json.dumps(value)


@pytest.fixture(scope="module")
def parsed(spark):
    vectors = dict(VECTORS)
    for depth in (2, 5, 9):
        for kind, build in (("text", _deep), ("object", _deep_object)):
            expected = {"message": "core", "timestamp": f"t{depth - 1}", "source": DOCKER}
            vectors[f"{kind} depth {depth}"] = ("auto", build(depth), [expected])
    rows = [(i, name, *v[:2]) for i, (name, v) in enumerate(vectors.items())]
    lines = spark.createDataFrame(rows, "ord long, name string, asked string, value string")
    found = normalize(lines, source=F.col("asked"), keep=["name"], registry=SOURCES)
    records = {name: [] for name in vectors}
    for row in found.orderBy("ord", "rec_idx").collect():
        records[row["name"]].append(row)
    return vectors, records


def test_vectors(parsed):
    vectors, records = parsed
    for name, (_, _, expected) in vectors.items():
        rows = records[name]
        if expected is None:
            assert len(rows) == 1 and rows[0]["parse_error"], name
            continue
        assert [r["parse_error"] for r in rows] == [None] * len(expected), name
        for row, fields in zip(rows, expected, strict=True):
            assert {k: row[k] for k in fields} == fields, name


def test_deep_wrappers_keep_every_attribute(parsed):
    _, records = parsed
    for kind in ("text", "object"):
        attributes = records[f"{kind} depth 9"][0]["attributes"]
        assert {f"l{i}": str(i) for i in range(9)}.items() <= attributes.items()


def test_strict_objects_like_a_json_parser(spark):
    """Random damage to JSON texts: accepted exactly when Python's parser accepts an object."""
    rng = random.Random(7)
    base = ['{"a":1}', '{"a":"x","b":[1,{"c":null}]}', "{}", '{"a":{"b":"}"}}', '{"q":"a\\"b"}']
    pieces = ["{", "}", "[", "]", ",", '"', ":", " ", "1", "x", "\\", "null", '{"z":2}']
    texts = set(base)
    while len(texts) < 1500:
        text = rng.choice(base)
        for _ in range(rng.randint(1, 2)):
            at = rng.randint(0, len(text))
            text = text[:at] + rng.choice(pieces) + text[at + rng.randint(0, 1) :]
        if text.lstrip().startswith("{"):
            texts.add(text)
    texts = sorted(texts)

    def accepted(text):
        try:
            return isinstance(json.loads(text, parse_constant=lambda _: 1 / 0), dict)
        except Exception:
            return False

    frame = spark.createDataFrame([(t,) for t in texts], "value string")
    members = open_object(F.col("value"))
    rows = frame.select("value", members.isNotNull().alias("ok")).collect()
    assert [r["value"] for r in rows if r["ok"] != accepted(r["value"])] == []


def test_member_texts_like_a_json_parser(spark):
    rng = random.Random(11)
    documents = []
    for i in range(300):
        values = {
            "i": rng.randint(-(10**12), 10**12), "t": rng.choice(["x", "1.0E9", "{", "é\"\n"]),
            "b": rng.random() < 0.5, "n": None, "l": [1, "a", {"z": 1, "a": [True, None]}], "o": {"k": i, "a": "b"},
        }
        documents.append({k: v for k, v in values.items() if rng.random() < 0.8})

    def text(value):
        if value is None or isinstance(value, str):
            return value
        return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)

    frame = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(documents)], "i int, value string")
    opened = frame.withColumn("m", open_object(F.col("value")))
    for row in opened.select("i", text_map(F.col("value"), F.col("m")).alias("m")).collect():
        assert row["m"] == {k: text(v) for k, v in documents[row["i"]].items()}


def test_logfmt_on_long_lines(spark):
    pairs = " ".join(f"k{i % 5000}={i}" for i in range(20_000))
    long_value = 'msg="' + 'a\\"' * 50_000 + '"'
    rows = [(1, f"msg=m {pairs}"), (2, long_value), (3, "x" * 200_000)]
    lines = spark.createDataFrame(rows, "ord long, value string")
    found = {r["ord"]: r for r in normalize(lines).collect()}
    assert len(found[1]["attributes"]) == 5000 and found[1]["attributes"]["k7"] == "15007"
    assert found[2]["message"] == 'a"' * 50_000
    assert found[3]["message"] == "x" * 200_000


def test_plug_in_source(spark):
    provider = Provider(
        (Descriptor("badge_reader", ("badge-reader",), "application"),),
        text=lambda line: only(record(line.requested, line.payload)),
    )
    registry = BUILTIN.with_provider(provider)
    assert registry.resolve("badge-reader") == "badge_reader"
    lines = spark.createDataFrame([(1, "door 4 opened")], "ord long, value string")
    rows = normalize(lines, source="badge-reader", registry=registry).collect()
    assert [(r["source"], r["message"]) for r in rows] == [("badge_reader", "door 4 opened")]


def test_failfast_and_unknown_name(spark):
    lines = spark.createDataFrame([(1, "fine"), (4, '{"a":')], "ord long, value string")
    with pytest.raises(Exception, match="line 4 is no JSON object"):
        normalize(lines, mode="failfast").collect()
    with pytest.raises(UnknownSource):
        normalize(lines, source="nowhere")


def test_plan_is_narrow_and_parses_once(spark):
    value = F.concat(F.lit('{"msg":"'), F.col("id"), F.lit('"}'))
    lines = spark.range(10).select(F.col("id").alias("ord"), value.alias("value"))
    records = normalize(lines).where("source = 'ory' AND parse_error IS NULL")
    plan = records._jdf.queryExecution().executedPlan().toString()
    above, below = plan.split("Generate", 1)
    assert "Exchange" not in plan
    assert "Filter" in above and "ory" in above
    assert below.count("Filter") == 1  # blank lines only
