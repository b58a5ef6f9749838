import random
import re
from collections import Counter

from tessella.llm import quality

WORDS = r"[^\x20\x09-\x0D]+"


def base(text):
    text = text or ""
    words = re.findall(WORDS, text)
    lines = [x for x in text.split("\n") if re.search(WORDS, x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    many = Counter(windows)
    covered = {j for i, w in enumerate(windows) if many[w] > 1 for j in range(i, i + 5)}
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def texts():
    rng = random.Random(1)
    some = ["", None, " \n ", "a", "one two three four", "one two three four five", "x y \x0b\x0c z", "é😀 #*", "a b c d e a b c d e", "a a a a a a a", "l\nl\n l\nl"]
    for _ in range(150):
        words = rng.choices("abcdefgh", k=rng.randrange(120)) if rng.random() < 0.5 else [str(rng.random())[:6] for _ in range(60)] * rng.randrange(1, 3)
        some.append("".join(w + rng.choice((" ", " ", "\n", "  ")) for w in words))
    return some


def test_counts_are_those_of_brute_force(spark):
    rows = [(i if i % 7 else None, t, "x") for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    got = quality.assess(docs, carry=["doc_id", "text", "n_words"]).collect()
    assert len(got) == len(rows)
    for r in got:
        q = r["quality"]
        assert (q["n_words"], q["word_chars"], q["n_symbols"], q["n_dup_lines"], q["n_repeat_words"], q["base_failed"]) == base(r["text"]), r["text"]
        assert not (q["kept"] and q["base_failed"])
    assert quality.assess(docs.limit(0)).count() == 0


def test_fit_finds_the_rules_accuracies():
    rng = random.Random(2)
    counts, truth = Counter(), {}
    for _ in range(20_000):
        good = rng.random() < 0.8
        votes = tuple(rng.choices((0, 1, 2), (0.01, 0.09, 0.9) if good else (0.5, 0.1, 0.4))[0] for _ in quality.RULES)
        counts[votes] += 1
        truth.setdefault(votes, Counter())[good] += 1
    model = quality.fit(counts)
    assert abs(model.good - 0.8) < 0.03
    for bad, good in model.chances:
        assert abs(bad[0] - 0.5) < 0.05 and abs(good[2] - 0.9) < 0.03
    assert all(0.65 < a < 0.85 for a in model.accuracies().values())
    right = sum(n[model.log_odds(v) >= 0] for v, n in truth.items())
    assert right > 0.95 * 20_000
    assert quality.fit({}).good == quality.START_GOOD


def test_clean_texts_stay_and_junk_goes(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghijklmnoprstuw", k=rng.randrange(2, 9)))
    clean = [". ".join(" ".join(word() for _ in range(12)).capitalize() for _ in range(8)) + ".\n" + word() + " ends here." for _ in range(300)]
    junk = [" ".join(word() + rng.choice(("***", "###", "%%%")) for _ in range(80)) for _ in range(40)] + [" | ".join(word() for _ in range(60)) for _ in range(20)]
    docs = spark.createDataFrame([(i, t, i < 300) for i, t in enumerate(clean + junk)], "doc_id long, text string, clean boolean")
    for r in quality.assess(docs).collect():
        assert r["quality"]["kept"] == r["clean"]


def test_rules_that_only_speak_against_have_no_votes_for():
    model = quality.fit({(1,) * len(quality.RULES): 900, (0,) + (1,) * (len(quality.RULES) - 1): 100})
    for (_, _, for_good), (bad, good) in zip(quality.RULES.values(), model.chances):
        assert for_good or (bad[2], good[2]) == (0.0, 0.0)


def test_a_very_long_text(spark):
    rng = random.Random(8)
    long = "".join(str(rng.random())[2:8] + rng.choice((" ", "\n")) for _ in range(60_000))
    row = quality.assess(spark.createDataFrame([(1, long)], "doc_id long, text string"), carry=["doc_id"]).first()["quality"]
    assert (row["n_words"], row["word_chars"], row["n_symbols"], row["n_dup_lines"], row["n_repeat_words"], row["base_failed"]) == base(long)
