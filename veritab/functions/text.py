"""Text columns: number tokens, slots, keyword scores, fixed-width numbers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: grouped thousands or a plain number, with an optional fraction, that letters, digits, "_", "." or "," of no script touch before, nor letters,
#: digits or "_" after. No sign and no percent.
NUMBER = r"(?<![\p{L}\p{N}\p{M}_.,])(?:\p{Nd}{1,3}(?:,\p{Nd}{3})+|\p{Nd}+)(?:\.\p{Nd}+)?(?![\p{L}\p{N}\p{M}_])"


def number_tokens(text: Column) -> Column:
    """Distinct number tokens in order; an empty array for null."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBER), F.lit(0)))


def foreign_numbers(text: Column, allowed: Column) -> Column:
    """Number tokens that aren't among the allowed ones."""
    return F.array_except(number_tokens(text), allowed)


def fill_slots(template: Column, slots: Mapping[str, Column]) -> Column:
    """{{name}} becomes the slot's value; unknown names stay."""
    return reduce(lambda t, kv: F.replace(t, F.lit("{{" + kv[0] + "}}"), kv[1].cast("string")), slots.items(), template)


def open_slots(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\{\{([^{}]*)\}\}"), F.lit(1))


def occurrences(text: Column, word: str) -> Column:
    """How often a word stands in a text, without overlap, whatever the case."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return ((F.length(low) - F.length(F.replace(low, F.lit(word.lower()), F.lit("")))) / len(word)).cast("long")


def keyword_score(words: Sequence[str], weights: Mapping[str, int]) -> Column:
    """Sum over the words and the columns of weights: occurrences times the column's weight."""
    return reduce(Column.__add__, [occurrences(F.col(c), w) * F.lit(k) for w in words for c, k in weights.items()])


def best_sections(sections: DataFrame, words: Sequence[str], weights: Mapping[str, int], place: str, k: int) -> DataFrame:
    """The k sections with the highest score above 0, ties by place."""
    scored = sections.withColumn("score", keyword_score(words, weights)).where("score > 0")
    return scored.orderBy(F.desc("score"), place).limit(k)


def clip(text: Column, most: int) -> Column:
    """White space collapsed; cut to `most` characters, the last of them an ellipsis if something is cut."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t\r\n]+", " "))
    return F.when(F.length(t) > most, F.concat(F.rtrim(F.substring(t, 1, most - 1)), F.lit("…"))).otherwise(t)


def within_budget(df: DataFrame, text: str, group: str, order: str, most: int) -> DataFrame:
    """Texts of each group in order as long as their lengths together stay within the budget."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("used", F.sum(F.length(text)).over(w)).where(F.col("used") <= most)


def tags(text: Column) -> Column:
    """The parts between commas and semicolons (of either width) and white space; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[,;，；\s\p{Z}]+"), lambda t: t != "")


def keywords(text: Column, aliases: Mapping[str, str] | None = None) -> Column:
    """Runs of two or more letters, digits, "_" or Chinese characters, in order; then the aliases of the words that occur anywhere, whatever the case."""
    text = F.coalesce(text, F.lit(""))
    found = F.filter(F.split(text, r"[^0-9A-Za-z_\u4e00-\u9fff]+"), lambda t: F.length(t) >= 2)
    named = [F.when(F.contains(F.lower(text), F.lit(word.lower())), F.lit(alias)) for word, alias in (aliases or {}).items()]
    return F.concat(found, F.array_compact(F.array(*named))) if named else found


def constants(condition: Column) -> Column:
    """The numbers in a rule's text that aren't part of a name or a quoted string, in order."""
    bare = F.regexp_replace(F.coalesce(condition, F.lit("")), r"'[^']*'", " ")
    return F.transform(F.regexp_extract_all(bare, F.lit(r"(?<![A-Za-z0-9_.])[0-9]+(?:\.[0-9]+)?(?![A-Za-z0-9_])"), F.lit(0)), lambda n: n.cast("double"))


def contains_all(text: Column, query: str) -> Column:
    """Every word of the query is somewhere in the text, whatever the case."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return reduce(Column.__and__, [F.contains(low, F.lit(w)) for w in query.lower().split()], F.lit(True))


def fixed_width(value: Column, digits: int, places: int) -> Column:
    """A sign, `digits` digits and `places` decimals, padded with zeros."""
    cents = F.bround(F.abs(value) * 10**places).cast("long")
    return F.concat(F.when(value < 0, F.lit("-")).otherwise(F.lit("+")), F.lpad(cents.cast("string"), digits + places, "0"))


def from_fixed_width(code: Column, places: int) -> Column:
    sign = F.when(F.substring(code, 1, 1) == "-", -1).otherwise(1)
    return sign * F.substring(code, 2, 100).cast("long") / F.lit(10**places)


def prefix_interval(prefix: Column, digits: int, places: int = 0, signed: bool = False) -> tuple[Column, Column]:
    """Least and greatest number whose fixed-width text begins with a prefix: a sign if `signed`, `digits` digits, a point and `places` decimals if there are any.

    Whole numbers are longs, others decimals. After a minus sign larger digits are less. An empty signed prefix goes from minus zero up, as its missing digits are
    filled as those of a positive number.
    """

    def filled(sign: str, digit: str) -> Column:
        whole = (sign if signed else "") + digit * digits + ("." + digit * places if places else "")
        return F.concat(prefix, F.substring(F.lit(whole), F.length(prefix) + 1, F.lit(len(whole))))

    minus = F.startswith(prefix, F.lit("-")) if signed else F.lit(False)
    kind = f"decimal({min(38, digits + places)},{places})" if places else "long"
    low, high = F.when(minus, filled("-", "9")).otherwise(filled("-", "0")), F.when(minus, filled("+", "0")).otherwise(filled("+", "9"))
    return low.cast(kind), high.cast(kind)


def prefix_fits(prefix: Column, digits: int, places: int = 0, signed: bool = False) -> Column:
    """Whether a text may begin a fixed-width number: a sign first if `signed`, digits, the point in its place, and not too long."""
    whole = f"[0-9]{{0,{digits - 1}}}|[0-9]{{{digits}}}" + (f"(\\.[0-9]{{0,{places}}})?" if places else "")
    return F.coalesce(F.rlike(prefix, F.lit(f"\\A(|[+-]({whole}))\\z" if signed else f"\\A({whole})\\z")), F.lit(False))


def hex_dump(data: Column, limit: int = 1024) -> Column:
    """Sixteen bytes a line: place in hex, the bytes, and their printable ASCII; what exceeds the limit is counted in a last line. Null for null."""
    head = F.substring(data.cast("binary"), 1, limit)
    hexes = F.regexp_extract_all(F.lower(F.hex(head)), F.lit(".{1,32}"), F.lit(0))
    shown = F.regexp_extract_all(F.regexp_replace(F.decode(head, "ISO-8859-1"), "[^ -~]", "."), F.lit(".{1,16}"), F.lit(0))

    def line(h: Column, i: Column) -> Column:
        place = F.lower(F.hex(i * 16))
        return F.concat(F.lpad(place, F.greatest(F.length(place), F.lit(4)), F.lit("0")), F.lit("  "), F.rpad(F.rtrim(F.regexp_replace(h, "(..)", "$1 ")), 47, " "), F.lit("  "))

    # the printable part joins by place, once for all lines
    lines = F.zip_with(F.transform(hexes, line), shown, lambda a, b: F.concat(a, b))
    size = F.octet_length(data.cast("binary"))
    more = F.when(size > limit, F.array(F.concat(F.lit("… ("), (size - limit).cast("string"), F.lit(" more bytes)")))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(lines, more), "\n")
