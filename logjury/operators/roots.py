"""What a rule can read of a record: the structs Log, Context, Request and DynamicPolicy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logjury.functions.text import empty_map

ROOTS = ["Log", "Context", "Request", "DynamicPolicy"]

# Attribute names behind the fields of the roots, in order of preference.
HTTP_FIELDS = {
    "Method": ["method", "request_method", "http_method"],
    "Path": ["path", "request_path", "http_path", "uri"],
    "Query": ["query", "request_query", "http_query"],
}
BODY_SIZE = ["body_size", "request_body_size"]
BODY_TEXT = ["body", "request_body"]
CLIENT_IP = ["client_ip", "remote_addr", "ip"]
POLICY_FIELDS = {
    "Source": ["source", "policy_source"],
    "Name": ["name", "policy_name"],
    "Action": ["action", "policy_action"],
    "Outcome": ["outcome", "status"],
    "Subject": ["subject", "policy_subject"],
}


def first_attribute(attributes: Column, keys: list[str]) -> Column:
    """Value of the first attribute that is present, even if empty; else the empty text."""
    return F.coalesce(*[attributes[key] for key in keys], F.lit(""))


def _no_texts() -> Column:
    return F.array().cast("array<string>")


def log_root() -> Column:
    return F.struct(
        F.col("schema").alias("Schema"),
        F.col("source").alias("Source"),
        F.col("timestamp").alias("Timestamp"),
        F.col("level").alias("Level"),
        F.col("service").alias("Service"),
        F.col("message").alias("Message"),
        F.col("attributes").alias("Attributes"),
    )


def context_root() -> Column:
    return F.struct(
        F.col("source").alias("Source"),
        F.coalesce("service", F.lit("")).alias("Service"),
        _no_texts().alias("RuleTags"),
    )


def _body_size(attributes: Column) -> Column:
    """Digits with an optional sign; anything else, blanks included, counts as 0."""
    text = first_attribute(attributes, BODY_SIZE)
    return F.when(
        text.rlike(r"^[+-]?[0-9]+\z"), F.coalesce(text.try_cast("bigint"), F.lit(0))
    ).otherwise(F.lit(0).cast("bigint"))


def request_root() -> Column:
    attributes = F.col("attributes")
    http = [first_attribute(attributes, keys).alias(name) for name, keys in HTTP_FIELDS.items()]
    body = F.struct(
        _body_size(attributes).alias("Size"),
        first_attribute(attributes, BODY_TEXT).alias("Text"),
        F.lit("").alias("Bytes"),
        F.lit(False).alias("IsTruncated"),
    )
    return F.struct(
        F.struct(*http, empty_map().alias("Headers"), body.alias("Body")).alias("Http"),
        F.struct(first_attribute(attributes, CLIENT_IP).alias("Ip")).alias("Client"),
        _no_texts().alias("Tags"),
    )


def policy_root() -> Column:
    attributes = F.col("attributes")
    return F.struct(
        *[first_attribute(attributes, keys).alias(name) for name, keys in POLICY_FIELDS.items()]
    )


def with_roots(records: DataFrame) -> DataFrame:
    """Records plus the four roots. Fields no rule reads are pruned by the optimizer."""
    return records.withColumns(
        {
            "Log": log_root(),
            "Context": context_root(),
            "Request": request_root(),
            "DynamicPolicy": policy_root(),
        }
    )
