"""Queries as callers write them: JSON objects or these classes."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any


class InvalidQueryFormat(ValueError):
    """The query lacks what its type needs, or can't be read."""


class UnknownQueryType(ValueError):
    """No executor has this name."""


@dataclass(frozen=True)
class Condition:
    ColumnName: str
    Value: str


@dataclass(frozen=True)
class NeedleInHaystackQuery:
    """Files in which the conditions hold: all of them (And) or any (Or, the default). They may hold in different rows of a file."""

    Conditions: tuple[Condition, ...] = field(default_factory=tuple)
    Relation: str = "Or"

    def validated(self) -> NeedleInHaystackQuery:
        if not self.Conditions:
            raise InvalidQueryFormat("a query needs at least one condition")
        return self


@dataclass(frozen=True)
class CardinalityQuery:
    MetadataKey: str = ""

    def validated(self) -> CardinalityQuery:
        if not self.MetadataKey:
            raise InvalidQueryFormat("a query needs a metadata key")
        return self


@dataclass(frozen=True)
class FrequencyQuery:
    MetadataKey: str = ""
    MetadataValue: str = ""

    def validated(self) -> FrequencyQuery:
        if not self.MetadataKey or not self.MetadataValue:
            raise InvalidQueryFormat("a query needs a metadata key and a value")
        return self


RELATIONS = ("Or", "And")


def parsed(kind: type, body: str | dict[str, Any]):
    """A query of a class from JSON. Names are case-sensitive and unknown ones are passed over; a relation may be its number."""
    try:
        given = json.loads(body) if isinstance(body, str) else dict(body)
        if kind is not NeedleInHaystackQuery:
            return kind(**{k: v for k, v in given.items() if k in kind.__dataclass_fields__ and v is not None}).validated()
        conditions = tuple(Condition(c["ColumnName"], c["Value"]) for c in given.get("Conditions") or ())
        relation = given.get("Relation", 0)
        relation = RELATIONS[relation] if isinstance(relation, int) and relation < len(RELATIONS) else str(relation)
    except (KeyError, TypeError, AttributeError, json.JSONDecodeError) as e:
        raise InvalidQueryFormat(str(e)) from e
    return NeedleInHaystackQuery(conditions, relation).validated()
