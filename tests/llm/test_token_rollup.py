import random
from collections import Counter

from pyspark.sql import functions as F

from tessella.llm.common import list_files, new_path
from tessella.llm.token_rollup import TokenRollup, counted, deletes, inserts, pattern_count, revisions

SCHEMA = "source string, lang string, version string, tokens long"


def totals(rollup):
    return {(r.source, r.lang, r.version): (r.n_docs, r.n_tokens) for r in rollup.totals().collect()}


def brute(signed):
    docs, tokens = Counter(), Counter()
    for (*key, n), sign in signed:
        docs[tuple(key)] += sign
        tokens[tuple(key)] += sign * (n or 0)
    return {k: (docs[k], tokens[k]) for k in docs if docs[k] or tokens[k]}


def test_batches_add_up_once_each(spark, tmp_path):
    rng = random.Random(3)
    row = lambda: (rng.choice(["a", "b", None]), rng.choice(["en", None]), rng.choice(["v1", "v2"]), rng.choice([0, 7, None, 10**12]))
    first, gone, new = [row() for _ in range(60)], [], [row() for _ in range(20)]
    gone = first[:25]
    table = lambda rows: spark.createDataFrame(rows, SCHEMA)
    rollup = TokenRollup(spark, f"file://{tmp_path}/rollup")
    assert totals(rollup) == {} and rollup.committed() == []
    assert rollup.commit("load/1", inserts(table(first)))
    assert not rollup.commit("load/1", inserts(table(first)))
    assert totals(rollup) == brute([(r, 1) for r in first])
    assert rollup.commit("revise", revisions(table(gone), table(new)))
    expected = brute([(r, 1) for r in first + new] + [(r, -1) for r in gone])
    assert totals(rollup) == expected
    rollup.compact()
    assert totals(rollup) == expected
    assert not rollup.commit("revise", revisions(table(gone), table(new)))
    assert rollup.commit("nothing", inserts(table([])))
    assert rollup.commit("rest", deletes(table(first[25:] + new)))
    assert totals(rollup) == {}
    assert TokenRollup(spark, f"file://{tmp_path}/rollup").committed() == ["load/1", "nothing", "rest", "revise"]


def test_an_attempt_that_died_is_not_read(spark, tmp_path):
    rollup = TokenRollup(spark, f"file://{tmp_path}/rollup")
    rows = spark.createDataFrame([("a", "en", "v1", 5)], SCHEMA)
    spark.createDataFrame([("a", "en", "v1", 9, 99)], "source string, lang string, version string, n_docs long, n_tokens long").write.parquet(f"{rollup.folder}/sums/batch-dead")
    rollup.commit("1", inserts(rows))
    assert totals(rollup) == {("a", "en", "v1"): (1, 5)}


def test_counts_of_texts(spark):
    docs = spark.createDataFrame([("a b c", "s", "en", "x"), (None, "s", None, "y"), ("", None, "en", "z")], "text string, source string, lang string, version string")
    got = counted(docs, {"w": pattern_count("text", r"\w+"), "none": F.lit(None)})
    rows = sorted(map(str, got.collect()))
    assert len(rows) == 6 and sum(r.tokens for r in got.collect()) == 3
    assert counted(docs.limit(0), {"w": F.lit(1)}).count() == 0


def test_sums_of_many_keys_are_not_written_by_one_task(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rollup = TokenRollup(spark, new_path(spark, "many-keys"))
        rows = [(f"s{k}", "en", "words-1", k) for k in range(200)]
        rollup.commit("load", inserts(spark.createDataFrame(rows, "source string, lang string, version string, tokens long")))
        rollup.commit("nothing", inserts(spark.createDataFrame([], "source string, lang string, version string, tokens long")))
        assert max(len(list_files(p, ".parquet")) for p in rollup._parts()[0]) > 1
        rollup.compact()
        assert len(list_files(rollup._parts()[0][0], ".parquet")) > 1
        assert sorted((r.source, r.n_docs, r.n_tokens) for r in rollup.totals().collect()) == sorted((s, 1, n) for s, _, _, n in rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_counts_of_a_vocabulary(spark, tmp_path):
    import tiktoken

    from tessella.llm import pieces
    from tessella.llm.token_rollup import bpe_counted

    path = pieces.vocabulary_path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=pieces.default_pattern(), mergeable_ranks=pieces.read_ranks(path), special_tokens={})
    rng = random.Random(6)
    rows = [(rng.choice(["a", None]), rng.choice(["en", "fr"]), rng.choice([None, "", "one two\n three", "élan über 123 ", "<|endoftext|> x"])) for _ in range(50)]
    docs = spark.createDataFrame(rows, "source string, lang string, text string")
    rollup = TokenRollup(spark, f"file://{tmp_path}/bpe")
    assert rollup.commit("load", inserts(bpe_counted(docs, "bpe-50k", path)))
    assert rollup.commit("gone", deletes(bpe_counted(docs.limit(0), "bpe-50k", path)))
    assert totals(rollup) == brute([((s, lang, "bpe-50k", len(library.encode_ordinary(t or ""))), 1) for s, lang, t in rows])


def test_query_by_the_vocabulary(spark, tmp_path):
    """All documents but those under ten words, by the library."""
    from collections import Counter

    import tiktoken

    from tessella.llm import pieces, queries

    library = tiktoken.Encoding("own", pat_str=pieces.default_pattern(), mergeable_ranks=pieces.read_ranks(pieces.vocabulary_path("byte_bpe_50k.tiktoken")), special_tokens={})
    rng = random.Random(7)
    rows = [(k, rng.choice(["a", None]), rng.choice(["en", "fr"]), " ".join(rng.choices(["élan", "über", "12", "word"], k=rng.choice((3, 9, 10, 40)))) if k else None) for k in range(40)]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    docs, total = Counter(), Counter()
    for _, source, lang, text in rows:
        if text and len(text.split()) >= 10:
            docs[source, lang] += 1
            total[source, lang] += len(library.encode_ordinary(text))
    got = {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in queries.token_rollup_bpe(spark, str(tmp_path)).collect()}
    assert got == {k: (docs[k], total[k]) for k in docs}
