"""The query descriptor and its compact string form."""

from __future__ import annotations

import enum
from dataclasses import dataclass, field


class Aggregate(enum.Enum):
    """How a rollup window's values become one. NONE sums, LATEST is LAST."""

    NONE = "none"
    MIN = "min"
    MAX = "max"
    AVG = "avg"
    LAST = "last"
    LATEST = "last"
    SUM = "sum"
    COUNT = "count"


@dataclass(frozen=True)
class Query:
    """What to read of a measurement.

    ``tags``: equalities that must all hold. ``fields``: names to return in order, none for all. ``start_ms`` and
    ``end_ms``: inclusive, 0 or less for no bound. ``limit``: rows for each field, 0 for all. ``rollup_interval``: window
    width in ms, 0 for raw points (the method is then ignored).
    """

    measurement: str
    tags: tuple[tuple[str, str], ...] = ()
    fields: tuple[str, ...] = ()
    start_ms: int = 0
    end_ms: int = 0
    limit: int = 0
    rollup_interval: int = 0
    method: Aggregate = Aggregate.NONE
    zero_fill: bool = field(default=False)

    def __post_init__(self) -> None:
        if self.measurement is None:
            raise ValueError("a query needs a measurement")
        if self.limit < 0 or self.rollup_interval < 0:
            raise ValueError("limit and rollup_interval can't be negative")
        tags = self.tags.items() if isinstance(self.tags, dict) else self.tags
        object.__setattr__(self, "tags", tuple((str(k), str(v)) for k, v in tags))
        object.__setattr__(self, "fields", tuple(dict.fromkeys(self.fields)))


MAX_FIELDS, MAX_TAGS = 64, 32
_METHODS = {"avg": Aggregate.AVG, "mean": Aggregate.AVG, "sum": Aggregate.SUM, "min": Aggregate.MIN, "max": Aggregate.MAX, "count": Aggregate.COUNT, "last": Aggregate.LAST}


def _listed(body: str, what: str, most: int) -> list[str]:
    items = [x for x in map(str.strip, body.split(",")) if x]
    if len(items) > most:
        raise ValueError(f"more than {most} {what}")
    return items


def parse_query_string(text: str, **settings) -> Query:
    """``method:measurement(field,...){key:value,...}`` as a Query; the braces may be absent.

    An unknown method means NONE. Method and measurement are taken as written, names inside the brackets are stripped,
    empty field names are skipped, ``()`` means all fields. What the form can't say (range, limit, rollup) comes by
    keyword. Raises ValueError where the text doesn't have this form.
    """
    if text is None:
        raise ValueError("no query string")
    method, colon, rest = text.partition(":")
    measurement, opened, rest = rest.partition("(")
    if not (colon and opened and method and measurement):
        raise ValueError(f"not a query string: {text!r}")
    inside, closed, rest = rest.partition(")")
    if not closed:
        raise ValueError(f"fields aren't closed: {text!r}")
    names, rest, tags = _listed(inside, "fields", MAX_FIELDS), rest.strip(), []
    if rest:
        if rest[0] != "{" or rest[-1] != "}" or "}" in rest[:-1]:
            raise ValueError(f"unexpected text after the fields: {text!r}")
        body = rest[1:-1].strip()
        for item in body.split(",") if body else []:
            key, colon, value = (x.strip() for x in item.partition(":"))
            if not (key and colon and value):
                raise ValueError(f"not a tag: {item!r}")
            tags.append((key, value))
        if len(tags) > MAX_TAGS:
            raise ValueError(f"more than {MAX_TAGS} tags")
    return Query(measurement, tags=tuple(tags), fields=tuple(names), method=_METHODS.get(method.lower(), Aggregate.NONE), **settings)
