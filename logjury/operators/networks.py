"""Addresses against a table of networks: the longest network that holds each address."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logjury.functions.predicates import register_functions
from logjury.session import settled

SALTS = 64


def _plain(frame: DataFrame) -> list[str]:
    """Columns without maps, of which a hash can be made."""
    return [field.name for field in frame.schema if "map<" not in field.dataType.simpleString()]


def prefixes(bits: Column, lengths: dict[str, list[int]]) -> Column:
    """The first bits of an address in all lengths that networks of its family have."""
    found = F.array().cast("array<string>")
    for family, own in lengths.items():
        parts = F.array(*[F.left(bits, F.lit(n + 1)) for n in own])
        found = F.when(F.left(bits, F.lit(1)) == family, parts).otherwise(found)
    return found


def longest_networks(records: DataFrame, networks: DataFrame, address: Column, name: str = "network") -> DataFrame:
    """The records with ``name``, the row of the longest network that holds their address, or NULL.

    ``networks`` has a column ``cidr`` beside any others; rows that are no network hold nothing, of equal networks
    the one whose text comes first counts. An address that is none is in no network.

    A network is the string of its first bits, so it holds an address if it is a prefix of the address's bits: one
    equality per length that occurs in the table (at most 33 and 129), whatever their number. Different addresses are
    looked up once, and the answers go back to the records by address and a salt of ``SALTS``, so that an address
    with a third of all records, or records without one, are many tasks.
    """
    register_functions(records.sparkSession)
    own = F.expr("ip_bits(split_part(cidr, '/', 1))")
    known = networks.select(F.struct(*networks.columns).alias("row"), own.alias("bits"), F.expr("cidr_prefix(cidr)").alias("size"))
    known = known.where(F.col("size") < F.length("bits"))
    known = known.select("row", F.expr("left(bits, CAST(size + 1 AS INT))").alias("prefix"))
    known = settled(known.groupBy("prefix").agg(F.min_by("row", F.col("row.cidr")).alias("row")))
    lengths: dict[str, list[int]] = {}
    size = (F.length("prefix") - 1).alias("size")
    for row in known.select(F.left("prefix", F.lit(1)).alias("family"), size).distinct().collect():
        lengths.setdefault(row["family"], []).append(row["size"])
    salt = F.pmod(F.xxhash64(*_plain(records)), F.lit(SALTS)).cast("int")
    rows = settled(records.withColumns({"_bits": F.call_function("ip_bits", address), "_salt": salt}))
    places = rows.where(F.col("_bits").isNotNull()).groupBy("_bits", "_salt").agg(F.lit(1).alias("_one"))
    different = places.groupBy("_bits").agg(F.collect_list("_salt").alias("_salts"))
    looked = different.select("_bits", "_salts", F.explode(prefixes(F.col("_bits"), lengths)).alias("prefix"))
    longest = (
        looked.join(known, "prefix")
        .groupBy("_bits")
        .agg(F.max_by("row", F.length("prefix")).alias("_network"), F.first("_salts").alias("_salts"))
        .select("_bits", "_network", F.explode("_salts").alias("_salt"))
    )
    # Records without an address find nothing; their key is NULL and the salt alone deals them.
    joined = rows.join(longest, ["_bits", "_salt"], "left")
    return joined.select(*records.columns, F.col("_network").alias(name))
