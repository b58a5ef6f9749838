from tessella.operators import audit


def test_all_patterns_and_filters(spark):
    expected = {
        "[EXPR: 1+2]": {"expression_tag": ["[EXPR: 1+2]"]},
        '{{show|a {b}} {{"k": 1}} {{"k": {{Gold}}': {"double_curly_braces_template": ["{{show|a {b}}", '{{"k": {{Gold}}']},
        "{{plain}}": {"double_curly_braces_template": ["{{plain}}"]},
        "x?|v1=30": {"question_mark_pipe_values": ["?|v1="]},
        "x|a=1|b=2 y": {"pipe_separated_template_fragment": ["|a=1|b="]},
        "<P> <br/> <i> </i> <STRONG>": {"html_tags": ["<i>"]},
        "__TOC__": {"unresolved_magic_words": ["__TOC__"]},
        "{{#if:a}}": {"double_curly_braces_template": ["{{#if:a}}"], "parser_functions": ["if"]},
        "a\n|-\n! b": {"wiki_table_remnants": ["\n|-", "\n!"]},
        "[[category:A]]": {"unresolved_wiki_link": ["[[category:A]]"], "category_tags": ["[[category:A]]"]},
        "<ref>a\nb</REF>": {"html_tags": ["<ref>"], "ref_tags": ["<ref>a\nb</REF>"]},
        "<nowiki>a</nowiki>": {"html_tags": ["<nowiki>"], "nowiki_tags": ["<nowiki>a</nowiki>"]},
        "<gallery>a</gallery>": {"html_tags": ["<gallery>"], "gallery_tags": ["<gallery>a</gallery>"]},
        "'''bold'''": {"triple_apostrophe_bold": ["'''bold'''"], "double_apostrophe_italic": ["''bold''"]},
        "''s own'' it": {},
        "== H ==": {"equals_heading": ["== H =="]},
        "{{{p|d}}}": {"double_curly_braces_template": ["{{{p|d}}"], "template_parameter_default": ["{{{p|d}}}"]},
        "[[image:a]]": {"unresolved_wiki_link": ["[[image:a]]"], "unresolved_file_image": ["[[image:a]]"]},
        "&nbsp; &#160; \\u00e9": {"html_entities": ["&nbsp;", "&#160;"], "unicode_escape_sequence": ["\\u00e9"]},
        "x|a=" + "word " * 20_000 + "|b=": {"pipe_separated_template_fragment": ["|a=" + "word " * 20_000 + "|b="]},
    }
    rows = list(enumerate(expected))
    got = {}
    for r in audit.findings(spark.createDataFrame([*rows, (99, None)], "item_id int, text string")).collect():
        got.setdefault(r.item_id, {})[r.type] = r.matches
        assert r.match_count == len(r.matches)
    for k, text in rows:
        assert got.get(k, {}) == expected[text], text[:60]
    assert 99 not in got and len(audit.PATTERNS) == 20
