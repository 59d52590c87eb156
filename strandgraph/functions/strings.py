"""Columns on text from outside: query strings, and notes folded into lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent_decode(text: Column) -> Column:
    """``%41`` as its byte and "+" as a space; a "%" without two digits stays."""
    return F.url_decode(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"))


def query_arguments(query: Column) -> Column:
    """The map of a query string; a part without "=" has an empty value, of a name
    that stands twice the last value counts."""
    parts = F.filter(F.split(query, "&"), lambda p: p != "")
    name = lambda p: percent_decode(F.regexp_extract(p, "^([^=]*)", 1))
    value = lambda p: percent_decode(F.regexp_extract(p, "^[^=]*=(.*)$", 1))
    # the last of a name, so names are distinct
    later = F.transform(parts, lambda p, i: F.exists(F.slice(parts, i + 2, F.size(parts)), lambda q: name(q) == name(p)))
    kept = F.filter(F.arrays_zip(parts.alias("p"), later.alias("l")), lambda x: ~x["l"])
    return F.map_from_entries(F.transform(kept, lambda x: F.struct(name(x["p"]), value(x["p"]))))


def fold(text: Column, width: int) -> Column:
    """The words of a text as lines of at most ``width`` characters; a longer word
    is a line of its own."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("line"))

    def step(at, word):
        full = (at["line"] != "") & (F.length(at["line"]) + 1 + F.length(word) > width)
        lines = F.when(full, F.concat(at["lines"], F.array(at["line"]))).otherwise(at["lines"])
        line = F.when(full | (at["line"] == ""), word).otherwise(F.concat(at["line"], F.lit(" "), word))
        return F.struct(lines.alias("lines"), line.alias("line"))

    return F.aggregate(words, start, step, lambda at: F.when(at["line"] != "", F.concat(at["lines"], F.array(at["line"]))).otherwise(at["lines"]))
