"""Small driver-side helpers: lists, nested options, column metadata, text tables."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from enum import Enum
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.expressions import date_text, number_text, percent_text


class ValueType(Enum):
    """How a column is shown."""

    NUMBER = "number"
    PERCENT = "percent"
    DATE = "date"
    TEXT = "text"


@dataclass(frozen=True)
class Shown:
    """A column's label and format, kept in the schema's metadata."""

    label: str
    kind: ValueType = ValueType.NUMBER
    digits: int = 2

    def text(self, c: Column) -> Column:
        if self.kind is ValueType.PERCENT:
            return percent_text(c, self.digits)
        if self.kind is ValueType.DATE:
            return date_text(c)
        return number_text(c, self.digits) if self.kind is ValueType.NUMBER else c.cast("string")

    def tag(self, df: DataFrame, column: str) -> DataFrame:
        return df.withMetadata(column, {"label": self.label, "kind": self.kind.value, "digits": self.digits})


def as_text(df: DataFrame) -> DataFrame:
    """Tagged columns as text under their labels; others stay."""
    out = []
    for f in df.schema.fields:
        m = f.metadata
        out.append(Shown(m["label"], ValueType(m["kind"]), m["digits"]).text(F.col(f.name)).alias(m["label"]) if "label" in m else F.col(f.name))
    return df.select(*out)


def text_table(df: DataFrame, most: int = 1000) -> str:
    """An aligned plain-text table of a small frame."""
    rows = [[str(v) if v is not None else "" for v in r] for r in df.limit(most).collect()]
    widths = [max(map(len, col)) for col in zip(df.columns, *rows, strict=True)]
    return "\n".join("  ".join(v.rjust(w) for v, w in zip(r, widths, strict=True)) for r in [df.columns, *rows])


class Dots(dict):
    """A dictionary whose keys are attributes too."""

    __setattr__ = dict.__setitem__
    __delattr__ = dict.__delitem__

    def __getattr__(self, name: str) -> Any:
        try:
            return self[name]
        except KeyError:
            raise AttributeError(name) from None


def by_name(kind: type[Enum], name: str) -> Enum:
    """A member by its name, or by its value."""
    return kind[name] if name in kind.__members__ else kind(name)


def intersection(a: Iterable, b: Iterable) -> list:
    """What both have, in the order of b."""
    inside = set(a)
    return [x for x in b if x in inside]


def difference(a: Iterable, b: Iterable) -> list:
    """What b has and a lacks, in the order of b."""
    inside = set(a)
    return [x for x in b if x not in inside]


def union(a: Iterable, b: Iterable) -> list:
    return list(dict.fromkeys([*a, *b]))


def require_subset(large: Iterable, sample: Iterable) -> None:
    if missing := difference(large, sample):
        raise ValueError(f"not found: {missing}")


def repeated(items: Iterable) -> list:
    return [x for x, n in Counter(items).items() if n > 1]


def require_unique(items: Iterable, name: str = "items") -> None:
    if found := repeated(items):
        raise ValueError(f"{name} repeat: {found}")


def first_to(items: Sequence, item: object) -> list:
    return [item, *(x for x in items if x != item)]


def flat(items: object) -> Iterator:
    """The leaves of nested iterables; text is a leaf."""
    if isinstance(items, Iterable) and not isinstance(items, str | bytes):
        for x in items.values() if isinstance(items, Mapping) else items:
            yield from flat(x)
    else:
        yield items


def merged(options: Mapping | None, new: Mapping | None) -> dict:
    """Both; the second wins."""
    return {**(options or {}), **(new or {})}


def halves(d: Mapping) -> tuple[dict, dict]:
    items = list(d.items())
    at = (len(items) + 1) // 2
    return dict(items[:at]), dict(items[at:])


def number_in(text: str) -> tuple[int | None, str]:
    """A3 gives (3, 'A')."""
    found = re.search(r"\d+", text)
    return (int(found[0]) if found else None), re.sub(r"\d+", "", text)
