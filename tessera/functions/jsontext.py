"""JSON in text columns: tolerant extraction and typed reading."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def object_text(raw: Column) -> Column:
    """From the first { to the last } of a text, so code fences and remarks around an object fall away; null without one."""
    found = F.regexp_extract(raw, "(?s)(\\{.*\\})", 1)
    return F.when(found != "", found)


def read_object(raw: Column, schema: str) -> Column:
    """The object of a text as a struct: inside a code fence if there is one, of a list the first object, else from the first { to
    the last }; null if there is none or it does not parse. ``schema`` lists the fields."""
    fenced = F.regexp_extract(raw, "(?s)```(?:json)?\\s*(.*?)```", 1)
    inner = F.trim(F.when(fenced != "", fenced).otherwise(raw))
    listed = F.filter(F.from_json(inner, f"array<struct<{schema}>>", {"mode": "PERMISSIVE"}), lambda x: x.isNotNull())
    one = F.from_json(object_text(inner), schema, {"mode": "PERMISSIVE"})
    return F.when(inner.startswith("["), F.get(listed, F.lit(0))).otherwise(one)


def redact_keys(raw: Column, names: list[str]) -> Column:
    """Masks the string values of the named keys wherever they stand in JSON text, also inside lists."""
    pattern = '("(?i:' + "|".join(names) + ')"\\s*:\\s*)"(?:[^"\\\\]|\\\\.)*+"'
    return F.regexp_replace(raw, pattern, '$1"***"')


def objects(raw: Column) -> Column:
    """The balanced objects of a text in order, as an array of texts: each from a { to the } that closes it.

    One fold over the characters from the first { to the last } keeps the depth, whether it is inside a string, and whether the last character was a
    backslash there; braces inside strings do not count. Quotes outside of objects are remarks. An object that is not closed is left
    out, as is what stands inside it. Null and texts without braces have none.
    """
    region = F.regexp_extract(F.coalesce(raw, F.lit("")), "(?s)(\\{.*\\})", 1)
    chars = F.split(region, "")
    none = "cast(array() as array<struct<start:int,end:int>>)"
    empty = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(False).alias("text"), F.lit(False).alias("escape"), F.lit(0).alias("start"), F.expr(none).alias("found"))

    def step(acc, c):
        inside = acc["text"]
        quote = (c == '"') & (acc["depth"] > 0) & ~acc["escape"]
        opens, closes = (c == "{") & ~inside, (c == "}") & ~inside & (acc["depth"] > 0)
        depth = acc["depth"] + opens.cast("int") - closes.cast("int")
        done = closes & (depth == 0)
        place = F.struct(acc["start"].alias("start"), (acc["at"] + 1).alias("end"))
        return F.struct(
            (acc["at"] + F.length(c)).alias("at"),
            depth.alias("depth"),
            F.when(quote, ~inside).otherwise(inside).alias("text"),
            (inside & (c == "\\") & ~acc["escape"]).alias("escape"),
            F.when(opens & (acc["depth"] == 0), acc["at"]).otherwise(acc["start"]).alias("start"),
            F.when(done, F.concat(acc["found"], F.array(place))).otherwise(acc["found"]).alias("found"),
        )

    places = F.aggregate(F.filter(chars, lambda c: c != ""), empty, step)["found"]
    return F.when(region == "", F.expr("cast(array() as array<string>)")).otherwise(F.transform(places, lambda p: F.substring(region, p["start"] + 1, p["end"] - p["start"])))


def first_valid(raw: Column) -> Column:
    """The first balanced object of a text that is JSON; null without one."""
    return F.get(F.filter(objects(raw), lambda o: F.try_parse_json(o).isNotNull()), F.lit(0))
