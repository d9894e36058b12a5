"""REST items as documents: pointers into JSON, natively on strings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Mapping:
    """Pointers (a.b or /a/b) of an API item's fields; text takes several, comma separated."""

    id: str = ""
    title: str = ""
    text: str = ""
    author: str = ""
    updated: str = ""
    prefix: str = "rest"


def json_path(pointer: str) -> str:
    """A pointer as a JSON path; slashes and tildes inside a name may be written ~1 and ~0."""
    p = pointer.strip()
    names = [n.replace("~1", "/").replace("~0", "~") for n in p[1:].split("/")] if p.startswith("/") else p.split(".")
    return "$" + "".join(f"[{n}]" if n.isdigit() else f"['{n}']" for n in names)


def scalar(item: Column, pointer: str) -> Column:
    """A string, number or boolean at the pointer as text; empty for anything else."""
    if not pointer.strip():
        return F.lit("")
    value = F.get_json_object(item, json_path(pointer))
    return F.when(value.isNull() | value.rlike(r"^\s*[\[{]"), "").otherwise(value)


def find_items(bodies: DataFrame, body: str = "body", pointer: str = "") -> DataFrame:
    """bodies with a row per item: the array at the pointer, else the body itself, else /data, /items or /results."""
    c = F.col(body)
    places = [json_path(pointer)] if pointer.strip() else ["$", "$.data", "$.items", "$.results"]
    array = F.coalesce(*[F.from_json(F.when(F.get_json_object(c, p).startswith("["), F.get_json_object(c, p)), "array<string>") for p in places])
    return bodies.withColumn("item", F.explode(array))


def documents(items: DataFrame, how: Mapping, item: str = "item") -> DataFrame:
    """items with external_id, title, text, author, updated and source_ref; items without title and text go.

    A missing id falls back to the item's id or key, then to rest- and the first
    16 digits of the sha256 of title and text.
    """
    c = F.col(item)
    parts = F.array(*[F.nullif(scalar(c, p), F.lit("")) for p in how.text.split(",") if p.strip()])
    text = F.array_join(F.array_compact(parts), "\n")
    base = items.withColumn("title", scalar(c, how.title)).withColumn("text", text).where("title <> '' OR text <> ''")
    fallback = F.concat(F.lit("rest-"), F.substring(F.sha2(F.concat("title", F.lit("\n"), "text"), 256), 1, 16))
    found = F.coalesce(F.nullif(scalar(c, how.id), F.lit("")), F.get_json_object(c, "$.id"), F.get_json_object(c, "$.key"), fallback)
    raw = scalar(c, how.updated)
    updated = F.coalesce(F.try_to_timestamp(raw), F.timestamp_seconds(F.try_to_number(raw, F.lit("9999999999")).cast("long")))
    return base.withColumns({"external_id": found, "author": scalar(c, how.author), "updated": updated}).withColumn("source_ref", F.concat(F.lit(how.prefix + ":"), "external_id"))
