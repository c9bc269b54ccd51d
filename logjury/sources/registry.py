"""Log sources: names, aliases, lanes, and which provider takes a line.

A provider turns one payload into an array of record structs with Column expressions, so a
plug-in runs inside the same Spark projection as the built-in ones.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logjury.functions.json import JsonObject
from logjury.functions.text import literal_map

AUTO = "auto"

TRANSPORT = "transport"
JOURNAL = "journal"
API = "api"
APPLICATION = "application"


# Source names with the words that point to them, in order of preference.
SourceWords = tuple[tuple[str, tuple[str, ...]], ...]


class UnknownSource(ValueError):
    """A requested source that no provider knows."""


@dataclass(frozen=True)
class Descriptor:
    canonical: str
    aliases: tuple[str, ...]
    lane: str


@dataclass(frozen=True)
class Line:
    """What a provider sees: the requested source, the payload text and, for JSON, its object."""

    requested: Column
    payload: Column
    object: JsonObject
    prepared: Column | None = None

    @property
    def is_auto(self) -> Column:
        return self.requested == AUTO

    @property
    def is_json(self) -> Column:
        return self.object.members.isNotNull()


@dataclass(frozen=True)
class Provider:
    """A log source plug-in.

    ``takes_json`` decides per line, ``json`` and ``text`` build ``array<record>`` columns
    (see ``schema.RECORD``). A provider without ``text`` never takes plain text. ``unwraps``
    marks a transport whose payload is dispatched again.

    ``prepare`` lists steps for the lines the provider takes. Each step is a struct computed in a
    projection of its own; the next step, ``json`` and ``text`` find it in ``line.prepared``. Steps
    keep shared sub-expressions from being evaluated more than once.
    """

    descriptors: tuple[Descriptor, ...]
    takes_json: Callable[[Line], Column] | None = None
    json: Callable[[Line], Column] | None = None
    text: Callable[[Line], Column] | None = None
    unwraps: bool = False
    prepare: tuple[Callable[[Line], Column], ...] = ()
    source_words: SourceWords = ()

    @property
    def canonical_names(self) -> list[str]:
        return [d.canonical for d in self.descriptors]

    def serves(self, lane: str) -> bool:
        return any(d.lane == lane for d in self.descriptors)


@dataclass(frozen=True)
class Registry:
    providers: tuple[Provider, ...] = field(default_factory=tuple)

    def with_provider(self, provider: Provider, first: bool = False) -> Registry:
        """A new registry that also knows ``provider`` (last in order unless ``first``)."""
        if first:
            return Registry((provider, *self.providers))
        return Registry((*self.providers, provider))

    @property
    def source_words(self) -> SourceWords:
        """Words of all providers by which a wrapped payload is led to a source."""
        return tuple(words for p in self.providers for words in p.source_words)

    def descriptors(self) -> list[Descriptor]:
        return [d for p in self.providers for d in p.descriptors]

    def aliases(self) -> dict[str, str]:
        """Every accepted name and its canonical name; the first provider wins."""
        names: dict[str, str] = {AUTO: AUTO}
        for d in self.descriptors():
            for name in (d.canonical, *d.aliases):
                names.setdefault(name, d.canonical)
        return names

    def choices(self) -> list[str]:
        return [AUTO, *[alias for d in self.descriptors() for alias in d.aliases]]

    def resolve(self, name: str) -> str:
        try:
            return self.aliases()[name]
        except KeyError:
            raise UnknownSource(f"no such source: {name}") from None

    def resolve_column(self, name: Column) -> Column:
        """Canonical source per row; NULL for an unknown name."""
        return literal_map(self.aliases())[name]

    def alias_table(self, spark: SparkSession) -> DataFrame:
        """(position, alias, canonical, lane) in the order choices are listed."""
        rows = [(0, AUTO, AUTO, AUTO)]
        for d in self.descriptors():
            rows += [(len(rows) + i, alias, d.canonical, d.lane) for i, alias in enumerate(d.aliases)]
        return spark.createDataFrame(rows, "position int, alias string, canonical string, lane string")

    def route_json(self, line: Line) -> Column:
        """Index of the provider that takes a JSON object, -1 if none does.

        A named source is offered to the transports, the journals and its own provider before
        the general order applies.
        """
        takers = [i for i, p in enumerate(self.providers) if p.takes_json is not None]
        first = [i for i in takers if self.providers[i].serves(TRANSPORT)]
        first += [i for i in takers if self.providers[i].serves(JOURNAL) and i not in first]
        steps: list[tuple[Column | None, int]] = []
        if takers[: len(first)] == first:
            # The general order starts with the same providers, so one test serves both.
            steps += [(None, i) for i in first]
            rest = takers[len(first) :]
        else:
            steps += [(~line.is_auto, i) for i in first]
            rest = takers
        steps += [(line.requested.isin(self.providers[i].canonical_names), i) for i in takers]
        steps += [(None, i) for i in rest]
        return self._first_taker(
            [
                (taken if guard is None else guard & taken, i)
                for guard, i in steps
                for taken in [self.providers[i].takes_json(line)]
            ]
        )

    def route_text(self, line: Line) -> Column:
        takers = [i for i, p in enumerate(self.providers) if p.text is not None]
        steps = [(line.requested.isin(self.providers[i].canonical_names), i) for i in takers]
        return self._first_taker(steps + [(F.lit(True), i) for i in takers[:1]])

    @staticmethod
    def _first_taker(steps: Sequence[tuple[Column, int]]) -> Column:
        chosen = F.lit(None).cast("int")
        for condition, index in reversed(steps):
            chosen = F.when(condition, F.lit(index)).otherwise(chosen)
        return F.coalesce(chosen, F.lit(-1))
