"""Text as column expressions: tokens, trimming, markup, claims. A null text gives null or nothing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits; a possessive ``'s`` is dropped first."""
    return F.regexp_extract_all(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"'s\b", ""), F.lit("[a-z0-9]+"), F.lit(0))


def token_count(text: Column) -> Column:
    return F.size(tokens(text))


def stripped(text: Column) -> Column:
    """Without white space of Unicode at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def replaced(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Regular expressions applied in order."""
    return reduce(lambda c, rule: F.regexp_replace(c, *rule), rules, text)


def infobox_value(text: Column, key: str) -> Column:
    """The value behind ``| key =`` on its line, stripped; null if there is none."""
    pattern = rf"(?m)^\s*\|\s*{key}\s*=[ \t]*(.*?)[ \t]*$"
    return F.when(F.regexp_like(text, F.lit(pattern)), stripped(F.regexp_extract(text, pattern, 1)))


def bullets(text: Column) -> Column:
    """The items of lines that start with asterisks."""
    items = F.transform(F.split(text, "\n"), lambda x: F.regexp_extract(x, r"^\*+\s*(.*)$", 1))
    return F.filter(F.transform(items, stripped), lambda x: x != "")


#: Light markup cleaning, in this order: links, formatting, tags, entities of space, blanks.
MARKUP_RULES = [
    (r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]", "$1"),
    (r"\{\{[^{}]*\}\}", ""),
    (r"'{2,5}", ""),
    (r"<[^<>]*>", " "),
    (r"&nbsp;", " "),
    (r"&[a-zA-Z]+;|&#\d+;", " "),
    (r"[ \t]+", " "),
]


def plain(text: Column) -> Column:
    """Without wiki links, simple templates, quotes, tags and entities."""
    return stripped(replaced(text, MARKUP_RULES))


def linked(text: Column) -> Column:
    """Links as what they show: what stands behind the first bar, or all of it."""
    return F.regexp_replace(text, r"\[\[(?:[^\[\]|]*\|)?([^\[\]]+)\]\]", "$1")


def untagged(text: Column) -> Column:
    """Without references and what they hold, code and line breaks as they read."""
    parts = F.split(text, "<ref>")
    behind = F.transform(parts, lambda p, i: F.when(i == 0, p).when(F.contains(p, F.lit("</ref>")), F.substring(p, F.instr(p, "</ref>") + 6, F.length(p))).otherwise(F.concat(F.lit("<ref>"), p)))
    return F.regexp_replace(F.regexp_replace(F.array_join(behind, ""), r"<br\s*/?>", " "), r"<code>(.*?)</code>", "$1")


def unquoted(text: Column) -> Column:
    """Bold and italic words without their marks."""
    return F.regexp_replace(text, r"('{2,3})([^']+)\1", "$2")


def tidied(text: Column) -> Column:
    """Without ends of templates, empty brackets and rules of asterisks, on one line."""
    closed = F.regexp_replace(text, r"(?:\|\w+)?\}\}", "")
    empty = F.regexp_replace(F.regexp_replace(closed, r"(?U)\s+", " "), r"\( ?\)|\[ ?\]", "")
    return stripped(F.regexp_replace(empty, r" ?\*{3} ?", " "))


def cleaned(text: Column) -> Column:
    """What is left of a page's text whose templates are printed."""
    return tidied(unquoted(untagged(linked(text))))


#: Fixed kinds of marks for what a template could not resolve; ``without_placeholders`` removes them, innermost first.
MARKS = ["CALC", "VAR", "EXPR", "TALENT", "G"]
PLACEHOLDER = rf"\[(?:{'|'.join(MARKS)}):[^\[\]]*\]"


def without_placeholders(text: Column, rounds: int = 10) -> Column:
    return reduce(lambda c, _: F.regexp_replace(c, PLACEHOLDER, ""), range(rounds), text)


def base_value(text: Column) -> Column:
    """A plain number or slash list as it is, else the leading number, else the text."""
    whole = r"^\s*-?\d+(?:\.\d+)?(?:\s*/\s*-?\d+(?:\.\d+)?)*\s*%?\s*$"
    leading = F.regexp_extract(text, r"^\s*(-?\d+(?:\.\d+)?)", 1)
    return F.when(text.rlike(whole), stripped(text)).when(leading != "", leading).otherwise(text)


def pick(text: Column, delimiter: str, at: Column) -> Column:
    """Part number ``at`` (from 0) of the text; the text itself where there is no such part."""
    return F.coalesce(F.get(F.split(text, rf"\Q{delimiter}\E"), at), text)


def level_values(text: Column) -> Column:
    """The numbers of ``a/b/c``; parts that are none are null."""
    return F.transform(F.split(text, "/"), lambda x: stripped(x).try_cast("double"))


def at_level(values: Column, level: Column) -> Column:
    """The value of a level (from 1); a short list goes on with its last value."""
    return F.when(F.size(values) > 0, F.element_at(values, F.least(level, F.size(values))))


#: What stands between a chunk's prefix of ``key: value`` pairs and its text.
DATA_MARKER = "| Data: "


def without_prefix(content: Column) -> Column:
    """The values of the prefix as a sentence before the text; other bars become full stops."""
    at = F.instr(content, DATA_MARKER)
    head = F.filter(F.split(F.substring(content, F.lit(1), at - 1), r"\|"), lambda x: F.instr(x, ":") > 0)
    values = F.array_join(F.transform(head, lambda x: stripped(F.regexp_replace(x, r"^[^:]*:", ""))), ", ")
    rest = F.substring(content, at + len(DATA_MARKER), F.length(content))
    bare = F.regexp_replace(content, r"^\s*Data:\s*", "")
    joined = F.when(at > 0, F.concat(F.when(values != "", F.concat(values, F.lit(". "))).otherwise(""), rest)).otherwise(bare)
    return stripped(replaced(joined, [(r"\s*\|\s*", ". "), (r"\.(?:\s*\.)+", ".")]))


def claims(answer: Column, least_words: int = 3, most: int = 8) -> Column:
    """The first ``most`` sentences of ``least_words`` or more words."""
    sentences = F.transform(F.split(F.coalesce(answer, F.lit("")), r"(?<=[.!?])\s+"), stripped)
    return F.slice(F.filter(sentences, lambda s: F.size(F.regexp_extract_all(s, F.lit(r"\S+"), F.lit(0))) >= least_words), 1, most)


def pipe_list(text: Column) -> Column:
    """The parts of ``a | b``, trimmed, without blanks; null gives none."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\|"), stripped), lambda x: x != "")
