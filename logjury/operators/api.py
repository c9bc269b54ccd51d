"""Admin-API responses: single records and collections of records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logjury.functions.json import JsonObject, first_field, raw_members, text_map, variant_members
from logjury.functions.text import (
    empty_map,
    let,
    literal_map,
    lower_ascii,
    overlay_map,
    strip_line_end,
)
from logjury.operators.records import passthrough, record
from logjury.sources.registry import API, Descriptor, Line, Provider

SOURCE = "openapi"

# Collection fields in order of preference, consumed fields, outcome words.
COLLECTIONS = [
    "audit", "events", "operations", "ipm_audit",
    "dynamic_policy_audit", "dynamic_policy", "dynamic_policies",
]
CONSUMED = [
    "message", "summary", "event", "operation", "outcome", "action", "error",
    "timestamp", "created_at", "updated_at", "time", "created_at_unix_ms",
    "timestamp_unix_ms", "level", "status", "service",
]
OUTCOME_LEVELS = {
    **dict.fromkeys(["allow", "allowed", "success", "succeeded", "ok"], "info"),
    **dict.fromkeys(["deny", "denied", "failure", "failed", "error"], "error"),
}

DESCRIPTORS = (Descriptor(SOURCE, ("openapi", "open-api", "admin-openapi"), API),)


def is_api_record(obj: JsonObject) -> Column:
    return (
        (obj.has("request_id") & obj.has("actor", "principal", "outcome", "operation", "error"))
        | (obj.has("event") & obj.has("operation"))
        | obj.has(*COLLECTIONS)
    )


def takes(line: Line) -> Column:
    return (line.requested == SOURCE) | is_api_record(line.object)


def _member_object(obj: JsonObject, key: str) -> Column:
    """Members of a nested object; NULL if the member is not an object."""

    def open_member(text: Column) -> Column:
        return let(F.from_json(text, "map<string,string>"), lambda m: text_map(text, m))

    return F.when(obj.kind_is(key, "OBJECT"), let(obj.raw(key), open_member))


def api_message(obj: JsonObject, error: Column, operation: Column) -> Column:
    kind = F.coalesce(first_field(operation, "kind"), F.lit("operation"))
    state = first_field(operation, "state")
    operation_text = F.when(operation.isNotNull(), F.concat_ws(" ", kind, state))
    return F.coalesce(
        strip_line_end(obj.field("message", "summary", "event")),
        strip_line_end(first_field(error, "message", "code")),
        strip_line_end(obj.members["error"]),
        operation_text,
        obj.field("outcome", "action", "operation"),
        F.lit(""),
    )


def api_timestamp(obj: JsonObject) -> Column:
    return F.coalesce(
        obj.field("timestamp", "created_at", "updated_at", "time"),
        obj.field("created_at_unix_ms", "timestamp_unix_ms"),
    )


def api_level(obj: JsonObject) -> Column:
    outcome = obj.field("outcome")
    return F.coalesce(
        obj.field("level", "status"),
        literal_map(OUTCOME_LEVELS)[lower_ascii(outcome)],
        outcome,
    )


def _operation_attributes(operation: Column) -> Column:
    named = F.create_map(
        F.lit("operation_kind"), first_field(operation, "kind"),
        F.lit("operation_state"), first_field(operation, "state"),
        F.lit("request_id"), first_field(operation, "request_id"),
    )
    return F.when(
        operation.isNotNull(), F.map_filter(named, lambda _, value: value.isNotNull())
    ).otherwise(empty_map())


def _api_record(obj: JsonObject, collection: Column) -> Column:
    """One record; ``collection`` is NULL for an object that stands alone."""
    service = F.coalesce(F.regexp_replace(collection, r"(?:_audit)+\z", ""), F.lit("admin_api"))
    own = F.when(
        collection.isNotNull(), F.create_map(F.lit("api_collection"), collection)
    ).otherwise(empty_map())

    def build(parts: Column) -> Column:
        operation = parts["operation"]
        attributes = overlay_map(
            F.map_concat(own, _operation_attributes(operation)),
            passthrough(obj.members, CONSUMED),
        )
        return record(
            source=F.lit(SOURCE),
            timestamp=api_timestamp(obj),
            level=api_level(obj),
            service=F.coalesce(obj.field("service"), service),
            message=api_message(obj, parts["error"], operation),
            attributes=attributes,
        )

    parts = F.struct(
        _member_object(obj, "error").alias("error"),
        _member_object(obj, "operation").alias("operation"),
    )
    return let(parts, build)


def _collection(obj: JsonObject) -> Column:
    """Name and item texts of the first collection field that holds objects, else NULL.

    The line is parsed once for the kinds of its members and once for their texts, however many
    collection fields it has.
    """

    def items(parsed: Column, name: str) -> Column:
        texts = F.from_json(parsed["raw"][name], "array<string>")
        kinds = F.transform(parsed["kinds"][name].cast("array<variant>"), lambda item: F.schema_of_variant(item))
        objects = F.filter(
            F.arrays_zip(texts.alias("text"), kinds.alias("kind")),
            lambda item: F.startswith(item["kind"], F.lit("OBJECT")),
        )
        return F.transform(objects, lambda item: item["text"])

    def named(parsed: Column, name: str) -> Column:
        is_array = F.startswith(obj.members[name], F.lit("[")) & F.startswith(
            F.schema_of_variant(parsed["kinds"][name]), F.lit("ARRAY")
        )
        found = let(
            items(parsed, name),
            lambda texts: F.when(F.size(texts) > 0, F.struct(F.lit(name).alias("name"), texts.alias("items"))),
        )
        return F.when(is_array, found)

    parsed = F.struct(variant_members(obj.text).alias("kinds"), raw_members(obj.text).alias("raw"))
    return F.when(
        obj.has(*COLLECTIONS),
        let(parsed, lambda both: F.coalesce(*[named(both, name) for name in COLLECTIONS])),
    )


def objects(line: Line) -> Column:
    """The objects that become records: the items of a collection, or the line itself."""

    def item(name: Column, text: Column, members: Column) -> Column:
        return F.struct(name.alias("collection"), text.alias("text"), members.alias("members"))

    def open_item(name: Column, text: Column) -> Column:
        members = let(F.from_json(text, "map<string,string>"), lambda m: text_map(text, m))
        return item(name, text, members)

    def expand(found: Column) -> Column:
        alone = F.array(item(F.lit(None).cast("string"), line.payload, line.object.members))
        items = F.transform(found["items"], lambda text: open_item(found["name"], text))
        return F.when(found.isNull(), alone).otherwise(items)

    return let(_collection(line.object), expand)


def records(line: Line) -> Column:
    return F.transform(
        line.prepared,
        lambda item: _api_record(JsonObject(item["text"], item["members"]), item["collection"]),
    )


PROVIDER = Provider(DESCRIPTORS, takes_json=takes, json=records, prepare=(objects,))
