"""Wiki pages, templates, nested records and sheets on fixtures worked out by hand."""

import pytest
from pyspark.sql import functions as F

from tessella.functions import balanced, templates
from tessella.operators import audit, evaluate, nodes, wiki
from tessella.sources import folder, sheets

PAGE = """{{Hero infobox
| title = Moss Giant
| hid = 7
| primary attribute = Strength
| strength = 20
| strength growth = 2.5
| agility = 12
| intelligence = 10
| attack damage min = 30
| attack damage max = 36
| health regen = 0.5
| armor = -1
| roles = Carry, Support
}}
== Bio ==
{{Bio
| name = Old Moss
| lore = First.<br><br>Second.
}}
== Gallery ==
dropped
== Innate Abilities ==
{{Ability
| name = Root
| trait1 = Slow (move)
| value1 = 10/20
| trait2 alt = Range-up
| value2 alt = 5
| trait3 = Lonely
| notes =
* First note {{G|tick rate}}
** its sub
* abc
}}
== Abilities ==
{{Ability | trait1 = x}}
== Trivia ==

* [[Moss]] grows on the northern side of trees.
* short
* {{template that is long enough to count}}
=== Deeper ===
more"""


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([("m", PAGE), ("none", None), ("empty", "")], "title string, text string")


def test_sections(pages):
    found = {r.section: r.content for r in wiki.sections(pages).where("title = 'm'").collect()}
    assert list(found) == ["header", "Bio", "Innate Abilities", "Abilities", "Trivia", "= Deeper ="]
    assert found["= Deeper ="] == "more" and found["Abilities"] == "{{Ability | trait1 = x}}"


def test_repeated_and_bare_sections(spark):
    text = "== A ==\nfirst\n== B ==\n== A ==\nsecond\n"
    rows = wiki.sections(spark.createDataFrame([("t", text)], "title string, text string")).collect()
    assert [(r.section, r.content) for r in rows] == [("A", "second\n")]


def test_infobox_and_derived(pages):
    row = wiki.infobox(wiki.sections(pages).where("section = 'header'")).where("title = 'm'").first()
    assert (row.name, row.hero_id, row.strength, row.strength_growth, row.roles) == ("Moss Giant", 7, 20, 2.5, ["Carry", "Support"])
    assert (row.total_health, row.total_mana, row.damage_min, row.damage_max) == (560, 195, 50, 56)
    assert (row.total_health_regen, row.total_mana_regen, row.total_armor) == (2.3, 0.5, 1.0)
    empty = wiki.infobox(wiki.sections(pages).where("section = 'header'")).where("title = 'empty'").collect()
    assert [r.total_health for r in empty] == [None]


def test_bio(pages):
    row = wiki.bio(wiki.sections(pages).where("section = 'Bio'")).first()
    assert (row.real_name, row.alias, row.lore) == ("Old Moss", None, "First.\n\nSecond.")


def test_abilities_traits_notes(pages):
    found = wiki.abilities(wiki.sections(pages))
    assert [(r.kind, r.ability) for r in found.collect()] == [("innate_abilities", "Root")]
    traits = wiki.traits(found)
    assert sorted((r.number, r.modifier, r.trait, r.value) for r in traits.collect()) == [(1, "", "slow_move", "10/20"), (2, "alt", "range_up_alt", "5")]
    assert wiki.variables(traits).first().variables == {"Root value1": "10/20", "Root value2 alt": "5"}
    assert found.select(wiki.block_notes(F.col("block")).alias("n")).first().n == ["First note its sub"]


def test_notes_islands(spark):
    assert one(spark, wiki.notes(F.lit("loose line\n* first one\ngoes on\n\ndropped\n** orphan sub\n* second"))) == ["first one goes on", "orphan sub", "second"]
    assert one(spark, wiki.notes(F.lit(None).cast("string"))) == []


def test_trivia(pages):
    row = wiki.sections(pages).where("section = 'Trivia'").select(wiki.trivia(F.col("content")).alias("t")).first()
    assert row.t == ["Moss grows on the northern side of trees."]


def test_talents(spark):
    text = "| hero = Moss\n| t1left = attack speed\n| v1left = 15\n| t1right = s:value {{A|Root|Moss}} damage\n| v1right = 30\n| t2left = it's s:values longer\n| v2left = 2"
    rows = wiki.talents(spark.createDataFrame([("m", text), ("n", None)], "title string, text string"))
    got = {(r.title, r.level, r.branch): r.talent for r in rows.collect()}
    assert got["m", "level_10", "left"] == "+15 Attack Speed" and got["m", "level_10", "right"] == "30 Root damage"
    assert got["m", "level_15", "left"] == "it's 2s longer" and got["m", "level_25", "right"] == "Unknown Talent" and len(got) == 16


def test_versions(spark):
    text = "intro{{VersionTableElement|7.3|\n* One\n** Two\n:: Three\nplain\n{{Tal change|t1l=+5 armor;c|t4r=x}}\n}}{{VersionTableElement|7.2|* Old}}{{VersionTableElement|7.1|\n* A\n{{VersionTableEnd}}\n* B{{VersionTableElement|7.0|* C"
    rows = wiki.versions(spark.createDataFrame([("m", text), ("n", None)], "title string, text string")).orderBy("position").collect()
    assert [(r.version, r.most_recent) for r in rows] == [("7.3", True), ("7.2", False), ("7.1", False)]
    assert rows[0].changes == ["One", "  * Two", "    Three", "Level 10 Left Branch: +5 armor", "Level 25 Right Branch: x"] and rows[2].changes == ["A"]


def test_records(spark, pages):
    found = wiki.records(pages, {"sections": wiki.sections(pages)})
    assert {r.title: len(r.sections) for r in found.collect()} == {"m": 6, "none": 1, "empty": 1}


def test_templates(spark):
    assert one(spark, templates.constants(F.lit("{{G|Bonus Health}} {{G|no}}"))) == "22.0 [G:no]"
    assert one(spark, templates.text_templates(F.lit("{{Key press|Q}} {{cf|a|b}} {{Cl|item| Axe |x}} {{ValueColor|3|9|k}}"))) == "Q (a) b Axe (item) 9"
    assert one(spark, templates.without_remarks(F.lit("a ({{Symbol|Talent}} b (c) d) (e) {{Symbol|Daytime}} f"))) == "a  (e) f"
    assert one(spark, templates.talent_placeholders(F.lit("{{Talent|moss|2}} {{Talent|x|2}}"), F.lit("Moss"))) == "[TALENT:2] {{Talent|x|2}}"
    assert one(spark, templates.titled(F.lit("foo bar-baz it's"))) == "Foo Bar-Baz It'S"


def test_variables(spark):
    text = F.lit("{{#vardefine:a|1}}{{#vardefineecho:b|{{{x}}}}}{{#vardefineecho:c|2}} {{#var:a}} {{#var:z}}{{#vardefine:a|3}}")
    assert one(spark, templates.definitions(text)) == {"a": "3", "c": "2"}
    assert one(spark, templates.resolved(F.lit("{{#vardefineecho:c|2}} {{#var:a}} {{#var:z}}"), F.create_map(F.lit("a"), F.lit("3")))) == "2 3 [VAR:z]"


RECORD = """{"profile": {"name": "Moss", "age": 3, "bio": "LONG"}, "basics": {"b": 1, "a": "x"}, "odd": 1,
"abilities": [{"name": "Root", "mana": 5, "notes": ["one two", "three", "four five six"]}],
"guide": {"tips": {"early": ["a", "b"]}, "items": [{"title": "Axe", "n": 1}, {"n": 2}], "text": "t"}}"""


def test_nodes(spark):
    records = spark.createDataFrame([("m", RECORD.replace("LONG", "word " * 101)), ("n", None), ("x", "not json")], "record_id string, json string")
    top = nodes.top_nodes(records)
    assert [(r.node, r.n) for r in nodes.unmapped(top).collect()] == [("odd", 1)]
    got = {(r.primary_node, r.sub_node, r.chunk_index): r.text for r in nodes.dispatch(top, budget=3).collect()}
    assert got["basics", "root", 0] == '{"b":1,"a":"x"}' and got["profile", "metadata", 0] == '{"name":"Moss","age":3}'
    assert got["profile", "bio", 0] == "word " * 101 and got["abilities", "Root.core", 0] == '{"name":"Root","mana":5}'
    assert [got["abilities", "Root.notes", k] for k in (0, 1)] == ["one two | three", "four five six"]
    assert got["guide", "tips.early", 0] == '["a","b"]' and got["guide", "items.Axe", 0] == '{"title":"Axe","n":1}'
    assert got["guide", "items.item_1", 1] == '{"n":2}' and got["guide", "text", 0] == "t" and len(got) == 10


def test_contexts_and_samples(spark):
    ids = spark.createDataFrame([(1, ["b", "x", "a"]), (2, []), (3, ["a"])], "query_id int, chunk_ids array<string>")
    chunks = spark.createDataFrame([("a", "A"), ("b", "B")], "chunk_id string, content string")
    found = evaluate.contexts(ids, chunks)
    assert {r.query_id: (r.contexts, r.n_missing) for r in found.collect()} == {1: (["B", "A"], 1), 2: ([], 0), 3: (["A"], 0)}
    runs = spark.createDataFrame([(1, "yes"), (2, "yes"), (3, " ")], "query_id int, answer string")
    assert [r.query_id for r in evaluate.samples(runs, found).collect()] == [1]


def test_report_of_nothing(spark):
    found = audit.findings(spark.createDataFrame([(1, None)], "item_id int, text string"))
    assert audit.report(found).first().n_findings == 0


def test_sheets(spark, tmp_path):
    rows = spark.createDataFrame([("a \"q\"\nb", None), ("c,d", "1")], "question string, answer string")
    sheets.write_sheet(rows, str(tmp_path / "s"))
    assert sorted(tuple(r) for r in sheets.read_sheet(spark, str(tmp_path / "s")).collect()) == sorted([("a \"q\"\nb", None), ("c,d", "1")])
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "good.json").write_text('{"a": 1}')
    (tmp_path / "j" / "bad.json").write_text("{")
    assert {r.file: (r.json, r.error) for r in sheets.read_json_files(spark, str(tmp_path / "j")).collect()} == {"good.json": ('{"a": 1}', None), "bad.json": (None, "{")}
    sheets.write_records(spark.createDataFrame([("Old Moss's", 1)], "name string, n int"), "name", str(tmp_path / "r"))
    assert (tmp_path / "r" / "record=old_mosss").is_dir()


GUIDE = """{{hero intro
| intro = Big [[moss|green]] one.
| pros =
* Strong {{A|Root|Moss}}
** heals
| cons =
* Slow
}}
== Builds ==
{{build order | title = First
| lvl1 = Root
| lvl2 = Slam
| lvl1 = Roots
}}
{{build order |
| lvl10 = Grow
}}
== Tips & Tactics ==
=== General ===
* Keep ''calm''
not a bullet
=== Abilities ===
==== {{A|Root|Moss}} ====
* Root early
* Root late
==== {{A|Slam|Moss}} ====
* Slam
== Items ==
<section begin=Items />
'''Starting items:'''
* {{I|Tango}} heals
* nothing
'''Odd Phase:'''
* {{I|Boots|x}} ''fast''
'''Late game:'''
<section end=Items />
== Talents ==
"""


def test_guide_record(spark):
    pages = spark.createDataFrame([("Moss", GUIDE), ("none", "no guide"), ("null", None)], "title string, text string")
    got = {r.title: r for r in wiki.guide_records(pages).collect()}
    moss = got["Moss"]
    assert tuple(moss.gameplay_guide) == ("Big green one.", ["Strong Root", "heals"], ["Slow"])
    assert [(b.build_no, b.name, {e.key: e.value for e in b.progression}) for b in moss.ability_builds] == [(0, "First", {"2": "Slam", "1": "Roots"}), (1, "Unknown", {"10": "Grow"})]
    assert [(t.ability, t.tips) for t in moss.tips] == [(None, ["Keep calm"]), ("Root", ["Root early", "Root late"]), ("Slam", ["Slam"])]
    assert [(p.phase, [tuple(i) for i in p["items"]]) for p in moss.recommended_items] == [("odd_phase", [("Boots", "fast")]), ("starting_items", [("Tango", "heals")])]
    for title in ("none", "null"):
        assert got[title].gameplay_guide is None and not any((got[title].ability_builds, got[title].tips, got[title].recommended_items))


def test_balanced_blocks_of_any_depth(spark):
    deep = "{{Ability|name=" + "{{n|" * 12 + "x" + "}}" * 12 + "}}"
    assert one(spark, balanced.blocks(F.lit(f"a {deep} b {{{{Ability|c}}}}"), r"Ability\b")) == [deep, "{{Ability|c}}"]
    assert one(spark, balanced.blocks(F.lit("{{Ability|{{x}} open"), r"Ability\b")) == []
    assert one(spark, balanced.blocks(F.lit("}} {{Abilityx}} {{x|{{Ability|in}}}}"), r"Ability\b")) == ["{{Ability|in}}"]
    assert one(spark, balanced.blocks(F.lit(None).cast("string"), "x")) is None and one(spark, balanced.blocks(F.lit(""), "x")) == []
    remark = "( {{Symbol|Aghanim}} " + "(" * 12 + "y" + ")" * 12 + ")"
    assert one(spark, templates.without_remarks(F.lit(f"x {remark} z (({{{{Symbol|Talent}}}}) w) (q ({{{{Symbol|Talent}}}} open"))) == "x  z ( w) (q "


def test_references_in_the_order_of_the_page(spark):
    none = F.create_map().cast("map<string,string>")
    chain = "{{#vardefine:v0|z}}" + "".join(f"{{{{#vardefine:v{k}|{{{{#var:v{k - 1}}}}}.{k}}}}}" for k in range(1, 21)) + "{{#var:v20}}"
    assert one(spark, templates.resolved(F.lit(chain), none)) == "z." + ".".join(map(str, range(1, 21)))
    cycle = "{{#vardefine:a|1{{#var:b}}}}{{#vardefine:b|2{{#var:a}}}}{{#var:a}} {{#var:b}}"
    assert one(spark, templates.resolved(F.lit(cycle), none)) == "1[VAR:b] 21[VAR:b]"
    again = "{{#vardefine:a|1}}{{#vardefine:c|{{#var:a}}!}}{{#vardefineecho:a|2}} {{#var:c}} {{#var:a}}"
    assert one(spark, templates.resolved(F.lit(again), none)) == "2 1! 2"
    given = {f"c{k}": "{{#var:c%d}}+%d" % (k - 1, k) if k else "base" for k in range(20)} | {"p": "{{#var:q}}", "q": "x{{#var:p}}", "self": "{{#var:self}}"}
    got = one(spark, templates.closed(F.create_map(*[F.lit(x) for pair in given.items() for x in pair])))
    assert got["c19"] == "base+" + "+".join(map(str, range(1, 20))) and got["self"] == "[VAR:self]"
    assert all("[VAR:" in got[k] and "#var" not in got[k] for k in "pq")
    assert one(spark, templates.resolved(F.lit(None).cast("string"), none)) is None


def test_json_of_any_depth(spark):
    deep = '{"a":' * 15 + '"end"' + "}" * 15
    found = nodes.flatten(spark.createDataFrame([("r", "", deep), ("s", "p", "[1, 2]"), ("t", "", None)], "record_id string, path string, json string"))
    assert sorted((r.record_id, r.path, str(r.text)) for r in found.collect()) == [("r", ".".join("a" * 15), "end"), ("s", "p", "[1, 2]"), ("t", "", "None")]


def test_one_bad_part_leaves_the_others(spark):
    pages = spark.createDataFrame([("a",), ("b",)], "title string")
    talents = wiki.checked(spark.createDataFrame([("a", "x", "{{open"), ("b", "y", "{{fine}}")], "title string, t string, text string"), wiki.markup_error(F.col("text"))).drop("text")
    notes = spark.createDataFrame([("a", 1), ("a", 2)], "title string, n int")
    got = {r.title: r for r in wiki.records(pages, {"talents": talents, "notes": notes}).collect()}
    assert got["a"]._talents_parse_error == "1 braces open, 0 close" and got["a"].talents == [] and [n.n for n in got["a"].notes] == [1, 2]
    assert got["b"]._talents_parse_error is None and [t.t for t in got["b"].talents] == ["y"] and got["b"].notes == []


def test_a_second_run_reads_new_files_only(spark, tmp_path):
    source, out = tmp_path / "in", f"{tmp_path}/out"
    source.mkdir()
    (source / "moss.json").write_text('{"profile": {"name": "Moss"}, "trivia": ["old"]}')
    (source / "bad.json").write_text("{broken")
    (source / "skip.txt").write_text("{}")
    folder.ingest_folder(spark, str(source), out).awaitTermination(120)
    first = folder.chunks(spark, out).collect()
    assert {(r.name, r.primary_node) for r in first} == {("Moss", "trivia"), ("Moss", "profile")} and [r.start for r in folder.rejects(spark, out).collect()] == ["{broken"]
    (source / "fern.json").write_text('{"basics": {"a": 1}}')
    folder.ingest_folder(spark, str(source), out).awaitTermination(120)
    rows = folder.chunks(spark, out).collect()
    assert len(rows) == len(first) + 1 and {(r.name, r.batch) for r in rows} == {("Moss", 0), ("fern", 1)} and folder.rejects(spark, out).count() == 1


def test_variables_of_a_page(spark):
    text = "| mana = 1\n| name = Root\n| cooldown = 12/10 {{note}}\n| mana = 30 (x)\n| mana = 40\n| value1 = 5%\n| value2 big = {{#vardefineecho:own|7}}\n| value3 = {{#var:own}}0%\n| value4 = {{#var:nope}}\n| name = Slam\n| value1 = text"
    found = wiki.page_variables(spark.createDataFrame([("p", text), ("n", None)], "title string, text string"))
    assert {r["name"]: r.value for r in found.collect()} == {
        "Root cooldown": "12/10", "Root mana": "40", "Root value1": "5%", "Root value2 big": "7", "own": "7", "Root value3": "0.7", "Root value4": "[VAR:nope]", "Slam value1": "text",
    }
