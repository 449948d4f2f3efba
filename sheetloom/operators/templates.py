"""Schemas, charts and calendars as data: checked on the driver, turned into column expressions or small tables."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import slug

KINDS = {"text": "string", "integer": "bigint", "decimal": "double", "date": "date"}


class Invalid(ValueError):
    pass


@dataclass
class Template:
    """A document's row fields by kind, the labels it is known by, and the fields that are checked against references."""

    name: str
    fields: dict[str, str]
    aliases: list[str] = field(default_factory=list)
    checked: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        if not re.fullmatch("[a-z][a-z0-9_]{1,40}", self.name):
            raise Invalid(f"name {self.name!r}")
        if not 1 <= len(self.fields) <= 40:
            raise Invalid("from 1 to 40 fields")
        if wrong := {k: v for k, v in self.fields.items() if v not in KINDS or not re.fullmatch("[a-z][a-z0-9_]*", k)}:
            raise Invalid(f"fields {wrong}")
        if unknown := set(self.checked) - self.fields.keys():
            raise Invalid(f"unknown fields {sorted(unknown)}")

    def row_type(self) -> str:
        """The type of a row as it is read: all texts."""
        return f"struct<{', '.join(f'{f}: string' for f in self.fields)}>"

    def typed(self, row: str) -> list[Column]:
        """The row's fields as their kinds, null where a text doesn't fit."""
        number = lambda c: F.replace(F.trim(c), F.lit(","), F.lit("."))
        out = []
        for f, kind in self.fields.items():
            c = F.col(f"{row}.{f}")
            out.append((number(c).try_cast(KINDS[kind]) if kind in ("integer", "decimal") else F.trim(c).try_cast(KINDS[kind])).alias(f))
        return out


class Registry:
    """Templates by name; an alias belongs to one of them."""

    def __init__(self) -> None:
        self.known: dict[str, Template] = {}

    def add(self, template: Template) -> None:
        taken = {a.upper(): t.name for t in self.known.values() for a in t.aliases if t.name != template.name}
        if clash := [a for a in template.aliases if a.upper() in taken]:
            raise Invalid(f"labels of other templates: {clash}")
        self.known[template.name] = template

    def aliases(self, spark: SparkSession) -> DataFrame:
        """(alias, template): as many rows as there are labels."""
        return spark.createDataFrame([(a.upper(), t.name) for t in self.known.values() for a in t.aliases], "alias string, template string")


def canonical(label: Column, known: dict[str, list[str]]) -> Column:
    """The field a written label stands for, by its synonyms; a slug of the label where none does."""
    pairs = [F.lit(x) for f, words in known.items() for w in [f, *words] for x in (w.lower(), f)]
    found = F.try_element_at(F.create_map(*pairs), F.lower(F.trim(label))) if pairs else F.lit(None).cast("string")
    return F.coalesce(found, F.regexp_replace(slug(label), "-", "_"))


def chart(spec: dict, rows: list[dict]) -> dict:
    """A chart's labels and values from rows, checked: two labels or more, every series as long as they are."""
    labels = [r.get(spec["x"]) for r in rows]
    series = {y: [r.get(y) for r in rows] for y in spec.get("y", [])}
    if len(labels) < 2:
        raise Invalid("a chart needs two labels or more")
    if not series or any(v is None or isinstance(v, (str, bool)) for values in series.values() for v in values):
        raise Invalid("a chart needs numbers for every label")
    return {"type": spec.get("type", "bar"), "labels": labels, "series": series}


def calendar(spark: SparkSession, config: dict[str, list[str]]) -> DataFrame:
    """(day, working) from lists of holidays and of worked days; a day in both is worked."""
    days = {d: False for d in config.get("holidays", [])} | {d: True for d in config.get("worked", [])}
    if bad := [d for d in days if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", d)]:
        raise Invalid(f"days {bad}")
    return spark.createDataFrame(sorted(days.items()), "day string, working boolean").withColumn("day", F.to_date("day"))
