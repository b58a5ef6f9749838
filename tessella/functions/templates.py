"""Wiki templates as column expressions. A null text stays null; what can't be resolved becomes a placeholder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import balanced
from .text import cleaned, linked, replaced, stripped

#: Fixed values of the constants template, by name in lower case, as they are printed.
CONSTANTS = {
    "bonus universal damage": "0.7",
    "bonus strength damage": "1.0",
    "bonus agility damage": "1.0",
    "bonus intelligence damage": "1.0",
    "bonus health": "22.0",
    "bonus mana": "12.0",
    "bonus health regeneration flat": "0.09",
    "bonus mana regeneration flat": "0.05",
    "bonus armor": "0.16666666666666666",
    "bonus magic resistance": "0.001",
    "tick rate": "1",
    "magic resistance": "0.25",
    "base magic resistance": "0.25",
}
#: Fixed names of the symbols that make a parenthesis a side remark.
SYMBOLS = ["Talent", "Aghshard", "Aghanim", "Daytime", "Nighttime"]


def constants(text: Column) -> Column:
    """The values of constants; an unknown name gives ``[G:name]``."""
    known = [(rf"(?i)\{{\{{G\|\s*{name}\s*\}}\}}", value) for name, value in CONSTANTS.items()]
    return replaced(text, [*known, (r"\{\{G\|([^{}]+)\}\}", "[G:$1]")])


def _printed(text: Column, prints: Callable[[Column, Column], dict[str, Column]]) -> Column:
    """``text`` with its innermost templates as ``prints`` shows them by name; all others, and those of
    which it shows null, are left as they are.

    ``prints`` takes the parts of a template, its name the first, and all behind the name as one text.
    """

    def shown(piece: Column) -> Column:
        parts = F.split(F.substring(piece, F.lit(3), F.length(piece) - 4), r"\|")
        rest = F.array_join(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), "|")
        named = F.coalesce(*[F.when(F.get(parts, F.lit(0)) == name, value) for name, value in prints(parts, rest).items()], piece)
        return F.when(piece.rlike(r"^\{\{[^{}]*\}\}$"), named).otherwise(piece)

    return F.array_join(F.transform(F.split(text, r"(?=\{\{)|(?<=\}\})"), shown), "")


def text_templates(text: Column) -> Column:
    """Templates for units, keys, fractions, links, attributes and value colours, replaced by their texts."""

    def prints(parts: Column, rest: Column) -> dict[str, Column]:
        first, second, number = F.get(parts, F.lit(1)), F.get(parts, F.lit(2)), F.size(parts)
        behind = F.array_join(F.slice(parts, 3, F.greatest(number, F.lit(1))), "|")
        return {
            "U": F.when((number == 3) & second.rlike("^text=."), F.substring(second, F.lit(6), F.length(second))),
            "Key press": F.when(rest == "double", "double-tapping").when(number > 1, rest),
            "cf": F.when(number == 2, F.concat(F.lit("("), first, F.lit(")"))).when(number > 2, F.concat(F.lit("("), first, F.lit(") "), behind)),
            "Cl": F.when(number > 2, F.concat(stripped(second), F.lit(" ("), stripped(first), F.lit(")"))),
            "Attribute ID": F.when(number > 1, rest),
            "ValueColor": F.when((number > 2) & first.rlike(r"^\d+$"), second).when(number > 1, ""),
        }

    return _printed(text, prints)


def page_text(text: Column) -> Column:
    """A page's text without markup: templates by their texts, then links, tags, quotes and what is left of braces."""

    def prints(parts: Column, rest: Column) -> dict[str, Column]:
        first, second, number = F.get(parts, F.lit(1)), F.get(parts, F.lit(2)), F.size(parts)
        whole = {name: F.when(number > 1, rest) for name in ("Key press", "Key special", "I", "H", "U")}
        return whole | {
            "A": F.when(number > 2, first),
            "cf": F.when(number > 1, F.concat(F.lit("("), rest, F.lit(")"))),
            "tooltip": F.when(number > 2, first),
            "Symbol": F.when(number > 1, ""),
            "ValueColor": F.when((number > 2) & first.rlike(r"^\d+$") & (second != ""), second).when(number > 1, ""),
        }

    words = F.regexp_replace(_printed(F.regexp_replace(text, r"<sm2>.*?</sm2>", ""), prints), r"\{\{([A-Z][a-z]+)\}\}", "$1")
    return cleaned(words)


def short_text(text: Column) -> Column:
    """The lighter cleaning of talents, guides and change lists: templates, links and quotes only."""

    def prints(parts: Column, rest: Column) -> dict[str, Column]:
        first, number = F.get(parts, F.lit(1)), F.size(parts)
        named = {name: F.when(number > 1, first) for name in ("H", "A", "I")}
        return named | {"Attribute ID": F.when(number > 1, rest), "tooltip": F.when(number > 2, first), "cf": F.when(number > 1, ""), "Symbol": F.when(number > 1, rest)}

    # the white space behind a fraction goes with it
    joined = F.regexp_replace(text, r"(\{\{cf\|[^{}]+\}\})\s+", "$1")
    return stripped(F.regexp_replace(linked(_printed(joined, prints)), "'{2,3}", ""))


def parameters(text: Column, name: str) -> Column:
    """The parameters of the first template of this name, in any case; none if there is no such template."""
    inside = F.regexp_extract(text, rf"(?is)\{{\{{{name}\s*\|(.*?)\}}\}}", 1)
    return F.filter(F.split(inside, r"\|"), lambda p: p != "")


def without_remarks(text: Column) -> Column:
    """Without parentheses, of any depth, that start with a symbol, nor signs of day and night."""
    symbol = rf"\s*\{{\{{Symbol\|(?:{'|'.join(SYMBOLS)})\}}\}}"
    return F.regexp_replace(balanced.without(text, symbol), r"\{\{Symbol\|(?:Daytime|Nighttime)\}\}\s*", "")


def talent_placeholders(text: Column, hero: Column) -> Column:
    """``{{Talent|hero|...}}`` of this hero, in any case, becomes ``[TALENT:...]``."""
    return F.regexp_replace(text, F.concat(F.lit(r"(?i)\{\{Talent\|\s*\Q"), F.coalesce(hero, F.lit("")), F.lit(r"\E\s*\|([^{}]*)\}\}")), F.lit("[TALENT:$1]"))


def _filled(text: Column, known: Column, given: Column) -> Column:
    """References to what is known, or else given, by their values; others as ``[VAR:name]``."""

    def shown(piece: Column) -> Column:
        name = stripped(F.regexp_extract(piece, r"^\{\{#var:([^{}]*)\}\}$", 1))
        value = F.coalesce(F.try_element_at(known, name), F.try_element_at(given, name), F.concat(F.lit("[VAR:"), name, F.lit("]")))
        return F.when(piece.rlike(r"^\{\{#var:[^{}]*\}\}$"), value).otherwise(piece)

    return F.array_join(F.transform(F.split(text, r"(?=\{\{#var:)|(?<=\}\})"), shown), "")


_STATE = "struct<out:string,known:map<string,string>>"


def _run(text: Column, given: Column) -> Column:
    """(out, known) of a text: a fold over its definitions in their order.

    A value's references are filled with what is defined before it, so that every value in the map is
    resolved however long a chain is. What is defined later, or by a cycle, isn't known there and is marked.
    A value that has other templates than references defines nothing and stays in the text.
    """

    def step(state: Column, segment: Column) -> Column:
        inside = F.regexp_replace(segment["text"], r"(?s)^\{\{#vardefine(?:echo)?:|\}\}$", "")
        name, value = stripped(F.substring_index(inside, "|", 1)), stripped(F.substring(inside, F.instr(inside, "|") + 1, F.length(inside)))
        filled = _filled(value, state["known"], given)
        defines = (segment["kind"] == "block") & (F.instr(inside, "|") > 0) & ~F.contains(filled, F.lit("{{"))
        known = F.map_concat(F.map_filter(state["known"], lambda k, v: k != name), F.create_map(name, filled))
        shown = F.when(~defines, segment["text"]).when(segment["text"].startswith("{{#vardefineecho:"), filled).otherwise("")
        return F.struct(F.concat(state["out"], shown).alias("out"), F.when(defines, known).otherwise(state["known"]).alias("known")).cast(_STATE)

    begin = F.struct(F.lit("").alias("out"), F.create_map().cast("map<string,string>").alias("known")).cast(_STATE)
    return F.aggregate(balanced.segments(text, "#vardefine(?:echo)?:"), begin, step)


def definitions(text: Column, given: Column | None = None) -> Column:
    """A map of the variables that a text defines; of a name defined again the last value counts."""
    return _run(text, given if given is not None else F.create_map().cast("map<string,string>"))["known"]


def resolved(text: Column, variables: Column) -> Column:
    """References replaced by values, definitions removed or echoed; unknown names give ``[VAR:name]``.

    The text's own definitions count before ``variables``, a map whose values may hold references to each
    other: those are followed by pointer doubling (see ``closed``), a cycle is marked.
    """
    given = closed(variables)
    return F.aggregate(F.array(_run(text, given)), F.lit(""), lambda _, s: _filled(s["out"], s["known"], given))


def closed(variables: Column) -> Column:
    """The map with all references within its values replaced; names on a cycle, or that lead to one, and unknown ones stay as ``[VAR:name]``.

    Each round replaces every reference by its name's text of the round before, so the distance that
    is covered doubles; it ends when the map is as deep as it has names, in the logarithm of their number.
    """
    names = F.map_keys(variables)
    doublings = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(names), F.lit(1)) + 1)).cast("int"))

    def doubled(known: Column, _: Column) -> Column:
        def value(k: Column, v: Column) -> Column:
            def shown(piece: Column) -> Column:
                name = stripped(F.regexp_extract(piece, r"^\{\{#var:([^{}]*)\}\}$", 1))
                inner = F.try_element_at(known, name)
                loops = (name == k) | F.contains(inner, F.concat(F.lit("{{#var:"), name, F.lit("}}")))
                return F.when(piece.rlike(r"^\{\{#var:[^{}]*\}\}$"), F.when(loops | inner.isNull(), F.concat(F.lit("[VAR:"), name, F.lit("]"))).otherwise(inner)).otherwise(piece)

            return F.array_join(F.transform(F.split(v, r"(?=\{\{#var:)|(?<=\}\})"), shown), "")

        return F.transform_values(known, value)

    ended = F.aggregate(doublings, variables, doubled)
    return F.transform_values(ended, lambda k, v: F.regexp_replace(v, r"\{\{#var:([^{}]*)\}\}", "[VAR:$1]"))


def titled(text: Column) -> Column:
    """Each run of letters with a capital first, as ``It'S``."""
    runs = F.split(text, r"(?<!\p{L})(?=\p{L})")
    return F.array_join(F.transform(runs, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, F.lit(2), F.length(x))))), "")
