"""Leftovers of markup in a corpus: named patterns, their matches per text, and counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Name and pattern of each kind of leftover, in Java's flavour.
PATTERNS: dict[str, str] = {
    "expression_tag": r"\[EXPR:[^\]]+\]",
    "double_curly_braces_template": r"\{\{[^}]{2,}\}\}",
    "question_mark_pipe_values": r"\?\|[a-zA-Z0-9_]+=",
    "unresolved_wiki_link": r"\[\[[^\]]*\]\]",
    "html_tags": r"<(?!br\s*/?\s*>)[a-zA-Z][a-zA-Z0-9]*[^>]*>",
    # possessive, as Java would recurse by character
    "pipe_separated_template_fragment": r'(?<!\|)\|[a-zA-Z0-9_]+=(?:[^|"\\]++|\\[^\n])*+(?:\|[a-zA-Z0-9_]+=)',
    "unresolved_magic_words": r"__[A-Z]+__",
    "parser_functions": r"\{\{#(if|switch|ifeq|expr|rel2abs|titleparts):[^}]+\}\}",
    "wiki_table_remnants": r"(?:^|\n)(?:\{\||\|\}|\|\+|\|-|!|\|)",
    "category_tags": r"(?iu)\[\[Category:[^\]]*\]\]",
    "ref_tags": r"(?isu)<ref[^>]*>.*?</ref>",
    "nowiki_tags": r"(?isu)<nowiki[^>]*>.*?</nowiki>",
    "gallery_tags": r"(?isu)<gallery[^>]*>.*?</gallery>",
    "triple_apostrophe_bold": r"'''[^']+'''",
    "double_apostrophe_italic": r"''[^']+''",
    "equals_heading": r"(?:^|\n)={2,}[^=]+=+",
    "template_parameter_default": r"\{\{\{[^}]+\}\}\}",
    "unresolved_file_image": r"(?iu)\[\[(?:File|Image):[^\]]*\]\]",
    "html_entities": r"&[a-z0-9#]+;",
    "unicode_escape_sequence": r"\\u[0-9a-fA-F]{4}",
}
#: Fixed words: a match with one of the first is a template, one with a tag of the second formats text.
_TEMPLATE_WORDS, _FORMATTING = r"\||\{\{(?:show|Gold|Rune|Ability|Item|Hero)", r"<br|<p>|</p>|<strong|</strong"


#: Which matches of a kind count; of the others all do.
COUNTS: dict[str, Callable[[Column], Column]] = {
    "double_curly_braces_template": lambda m: m.rlike(_TEMPLATE_WORDS) | ~m.contains('":'),
    "double_apostrophe_italic": lambda m: (F.length(m) > 4) & ~m.startswith("''s"),
    "html_tags": lambda m: ~F.lower(m).rlike(_FORMATTING),
}


def findings(texts: DataFrame, most: int = 10, snippet: int = 300) -> DataFrame:
    """One row per text (item_id, text) and kind of leftover: the first matches, their number, the text's start.

    A parser function's match is its name. A null text has none.
    """

    def matches(name: str, pattern: str) -> Column:
        all_of = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(pattern), F.lit(int(name == "parser_functions")))
        return F.filter(all_of, COUNTS[name]) if name in COUNTS else all_of

    found = F.array(*[F.struct(F.lit(name).alias("type"), matches(name, p).alias("matches")) for name, p in PATTERNS.items()])
    each = texts.select("item_id", "text", F.explode(found).alias("f")).select("item_id", "text", "f.*").where(F.size("matches") > 0)
    return each.select("item_id", "type", F.slice("matches", 1, most).alias("matches"), F.size("matches").alias("match_count"), F.substring("text", 1, snippet).alias("snippet"))


def counts(found: DataFrame) -> DataFrame:
    return found.groupBy("type").agg(F.count("*").alias("n_findings"), F.sum("match_count").alias("n_matches")).orderBy(F.desc("n_findings"), "type")


def report(found: DataFrame) -> DataFrame:
    """One row: n_findings, by_type as an ordered list of counts."""
    listed = F.array_sort(F.collect_list(F.struct((-F.col("n_findings")).alias("o"), "type", "n_findings", "n_matches")))
    by_type = F.transform(listed, lambda x: F.struct(x["type"].alias("type"), x["n_findings"].alias("n_findings"), x["n_matches"].alias("n_matches")))
    return counts(found).agg(F.coalesce(F.sum("n_findings"), F.lit(0)).alias("n_findings"), by_type.alias("by_type"))
