"""Column functions on text with the Unicode rules of the data model: white space is Unicode white space."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed class of white space: what Unicode calls so, with the four ASCII separators.
SPACE = "\\t\\n\\x0B\\f\\r\\x1C-\\x20\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"


def strip(text: Column) -> Column:
    """Text without white space at its ends. It is read once: a search for white space up to the end begins anew at every character."""
    return F.regexp_extract(text, f"(?s)^[{SPACE}]*+(.*[^{SPACE}])", 1)


def count_chars(text: Column) -> Column:
    """Code points that aren't white space."""
    return F.length(F.regexp_replace(text, f"[{SPACE}]+", ""))


def letter_share(text: Column) -> Column:
    """The share of Hangul syllables among Hangul syllables and A-Z letters; null without any."""
    hangul = F.length(F.regexp_replace(text, "[^\\uAC00-\\uD7A3]+", ""))
    latin = F.length(F.regexp_replace(text, "[^A-Za-z]+", ""))
    return F.when(hangul + latin > 0, hangul / (hangul + latin))


def language_of(text: Column, least: float = 0.3) -> Column:
    """Ko if the share of Hangul is at least ``least``, else en; '' without letters."""
    share = letter_share(text)
    return F.when(share.isNull(), "").when(share >= least, "ko").otherwise("en")


def normalise(text: Column) -> Column:
    """K1: plain spaces for no-break and ideographic ones and tabs, no control characters, '- ' for quote marks that start a line."""
    spaced = F.regexp_replace(text, "[\\t\\xA0\\u3000]", " ")
    clean = F.regexp_replace(spaced, "[\\x00-\\x08\\x0B-\\x1F\\x7F]", "")
    return F.regexp_replace(clean, f"(?m)(?d)^[{SPACE}]*[»›][{SPACE}]*", "- ")


def fingerprint(text: Column, digits: int = 12) -> Column:
    """The first hexadecimal digits of the SHA-256."""
    return F.substring(F.sha2(text.cast("binary"), 256), 1, digits)


def site_key(url: Column) -> Column:
    """Scheme://host."""
    return F.regexp_extract(url, "^([^:/?#]+://[^/?#]*)", 1)


def strip_request(question: Column, pattern: str) -> Column:
    """The question without its generic last request; the question itself if nothing is left."""
    rest = strip(F.regexp_replace(question, pattern, ""))
    return F.when(rest == "", question).otherwise(rest)


def percent_decoded(text: Column) -> Column:
    """Text with its percent signs read as UTF-8, or as it is where they can't be; a plus stays one."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def tags(text: Column, table: dict[str, str]) -> Column:
    """The names, in the table's order, whose pattern occurs in the text, case ignored."""
    return F.filter(F.array(*[F.when(text.rlike(f"(?iu){pattern}"), F.lit(name)) for name, pattern in table.items()]), lambda name: name.isNotNull())


def settled(column: Column) -> Column:
    """``column``, to be computed where it is selected and nowhere else.

    A filter on a column, or an explode of it, is otherwise pushed below the projection with the column's whole
    expression in place of its name, and inside a lambda that is computed again for each element. What depends on
    the task stays where it is. (Cheap filters aren't pushed below such a projection either: filter first.)
    """
    return F.when(F.spark_partition_id() >= 0, column)


def bound(value: Column, how: Callable[[Column], Column]) -> Column:
    """``how`` of a value that is computed once, however often ``how`` uses it."""
    return F.get(F.transform(F.array(value), how), F.lit(0))


def running(items: Column, first: Column, step: Callable[[Column, Column], Column], kind: str, run: int = 64) -> Column:
    """The states of a fold, one after each item. ``kind`` is the state's type.

    States are appended to runs and runs to a list, so that no long array is copied at each step.
    """
    none = F.array().cast(f"array<{kind}>")
    start = F.struct(first.cast(kind).alias("now"), none.alias("last"), F.array().cast(f"array<array<{kind}>>").alias("runs"))

    def next_(a: Column, x: Column) -> Column:
        full = F.size(a["last"]) >= run

        def put(now: Column) -> Column:
            last = F.concat(F.when(full, none).otherwise(a["last"]), F.array(now))
            return F.struct(now.alias("now"), last.alias("last"), F.when(full, F.concat(a["runs"], F.array(a["last"]))).otherwise(a["runs"]).alias("runs"))

        return bound(step(a["now"], x).cast(kind), put)

    return F.aggregate(items, start, next_, lambda a: F.flatten(F.concat(a["runs"], F.array(a["last"]))))


def stretches(items: Column, starts: Column, how: Callable[[Column, Column, Column], Column]) -> Column:
    """``how(number, first place, end)`` of each stretch of ``items`` from one of ``starts`` (places from 0, in order) to the next."""
    return F.transform(starts, lambda at, k: how(k, at, F.coalesce(F.get(starts, k + 1), F.size(items))))


def blocks_of(text: Column, size: int = 4096) -> Column:
    """A text in blocks of ``size`` code points, of which ``part_of`` cuts out pieces without reading from the text's start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def part_of(blocks: Column, start: Column, end: Column, size: int = 4096) -> Column:
    """The code points from ``start`` (from 0) to before ``end``."""
    first = F.floor(start / size).cast("int")
    last = F.floor((end - 1) / size).cast("int")
    return F.when(end > start, F.substring(F.array_join(F.slice(blocks, first + 1, F.greatest(last - first + 1, F.lit(1))), ""), start - first * size + 1, end - start)).otherwise(F.lit(""))


def unused(df: DataFrame, name: str) -> str:
    """``name``, or the like, that is no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def filter_after(df: DataFrame, condition: Column) -> DataFrame:
    """``df`` filtered above its own projections.

    A filter on a costly column is otherwise pushed below them, with the column's whole expression in place of its
    name, and inside a lambda that is computed again for each element. A column that depends on the task keeps
    the filter where it is.
    """
    task = unused(df, "filter_task")
    return df.withColumn(task, F.spark_partition_id()).filter(condition & (F.col(task) >= 0)).drop(task)
