"""Quality by weak supervision: rules vote or abstain, expectation-maximisation weighs the votes.

Built-in functions only. The votes of all documents are counted per pattern on Spark (at most three
to the power of the rules' number), and the driver fits the model on those counts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, materialise, new_name, text_or_empty

SYMBOLS = r"[#*$%&|<>]"
#: Characters that end a sentence or a quotation.
CLOSING = ".!?:;\"')]}»”’…。！？"
WINDOW = 5

#: A word that ends in a letter, or in one with ordinary punctuation behind it.
PLAIN = r"\p{L}[.,;:!?\"'’”»)]{0,3}(?=[\x20\x09-\x0D]|$)"

#: name: (measure, votes bad where, votes good where); a rule abstains where neither holds. What
#: almost every text passes is no sign of a good one, so most rules only ever speak against a text.
RULES: dict[str, tuple[str, str, str | None]] = {
    "symbols": ("n_symbols / n_words", "x > 0.1", None),
    "plain_words": ("n_plain / n_words", "x < 0.6", "x > 0.8"),
    "repeated_lines": ("n_dup_lines / n_lines", "x > 0.5", None),
    "repeated_words": ("n_repeat_words / n_words", "x > 0.1", None),
    "capitals": ("n_capitals / word_chars", "x > 0.3", None),
    "word_length": ("word_chars / n_words", "x < 2.5 OR x > 12", None),
    "line_ends": ("n_closed_lines / n_lines", "x < 0.2", "x > 0.5"),
    "exclamations": ("n_exclamations / n_words", "x > 0.5", None),
}
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _measured(docs: DataFrame, text_col: str, at: str) -> DataFrame:
    """``docs`` with a struct column ``at`` of counts; each step is a projection of its own."""

    def put(df: DataFrame, **more: Column) -> DataFrame:
        return df.withColumns({f"{at}_{k}": v for k, v in more.items()})

    def c(name: str) -> Column:
        return F.col(f"{at}_{name}")

    text = text_or_empty(text_col)
    df = put(docs, words=F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lines=F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = put(df, n=F.size(c("words")), hashes=F.transform(c("words"), lambda w: F.xxhash64(w)))
    spots = F.sequence(F.lit(0), c("n") - WINDOW)
    df = put(df, windows=F.when(c("n") > WINDOW, F.transform(spots, lambda i: F.xxhash64(*[F.get(c("hashes"), i + k) for k in range(WINDOW)]))))
    # windows in order of their hash: equal ones are neighbours; only for texts that have any
    some = F.size(F.array_distinct(c("windows"))) < F.size(c("windows"))
    df = put(df, sorted=F.when(some, F.sort_array(F.transform(c("windows"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twice = F.transform(c("sorted"), lambda x, k: F.when((x["h"] == F.get(c("sorted"), k - 1)["h"]) | (x["h"] == F.get(c("sorted"), k + 1)["h"]), x["i"]))
    df = put(df, starts=F.sort_array(F.filter(twice, lambda i: i.isNotNull())))
    covered = F.aggregate(F.transform(c("starts"), lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(c("starts"), k + 1), p + WINDOW) - p)), F.lit(0), lambda s, x: s + x)
    counts = {
        "n_words": c("n"),
        "word_chars": F.length(F.array_join(c("words"), "")),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)),
        "n_lines": F.size(c("lines")),
        "n_dup_lines": F.size(c("lines")) - F.size(F.array_distinct(c("lines"))),
        "n_repeat_words": F.coalesce(covered, F.lit(0)),
        "n_plain": F.regexp_count(text, F.lit(PLAIN)),
        "n_capitals": F.regexp_count(text, F.lit(r"\p{Lu}")),
        "n_closed_lines": F.size(F.filter(c("lines"), lambda x: F.right(F.rtrim(x), F.lit(1)).isin(*CLOSING))),
        "n_exclamations": F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit(""))),
    }
    return df.select(*[F.col(f"`{x}`") for x in docs.columns], F.struct(*[v.cast("long").alias(k) for k, v in counts.items()]).alias(at))


def _votes(at: str) -> Column:
    """One vote per rule, as a digit each: 0 bad, 1 abstains, 2 good."""
    votes = []
    for name, (measure, bad, good) in RULES.items():
        names = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_plain", "n_capitals", "n_closed_lines", "n_exclamations")
        over, under = measure.split(" / ")
        x = f"try_divide(`{at}`.{over}, `{at}`.{under})"

        def sql(condition: str, x: str = x) -> str:
            parts = [f"`{at}`.{w}" if w in names else x if w == "x" else w for w in condition.split(" ")]
            return " ".join(parts)

        votes.append(F.expr(f"CASE WHEN {sql(bad)} THEN 0 WHEN {sql(good or 'false')} THEN 2 ELSE 1 END").alias(name))
    return F.array(*votes)


def _weight(bad: tuple[float, ...], good: tuple[float, ...], vote: int) -> float:
    """What a vote says for a good document; nothing, if it is never given."""
    return math.log(good[vote] / bad[vote]) if good[vote] and bad[vote] else 0.0


@dataclass(frozen=True)
class VoteModel:
    """Share of good documents, and of either kind the share that each rule gives its votes to.

    ``chances[rule][kind][vote]``, kind 0 bad and 1 good. Only votes count; a rule that abstains says nothing.
    """

    good: float
    chances: tuple[tuple[tuple[float, float, float], tuple[float, float, float]], ...]

    def log_odds(self, votes) -> float:
        return math.log(self.good / (1 - self.good)) + sum(_weight(bad, good, v) for (bad, good), v in zip(self.chances, votes) if v != 1)

    def accuracies(self) -> dict[str, float]:
        """For each rule, how likely a vote is right if good and bad documents are equally many."""
        found = {}
        for name, (bad, good) in zip(RULES, self.chances):
            right, wrong = bad[0] + good[2], good[0] + bad[2]
            found[name] = right / (right + wrong)
        return found

    def column(self, votes: Column) -> Column:
        odds = F.lit(math.log(self.good / (1 - self.good)))
        for k, (bad, good) in enumerate(self.chances):
            vote = F.get(votes, F.lit(k))
            odds = odds + F.when(vote == 0, _weight(bad, good, 0)).when(vote == 2, _weight(bad, good, 2)).otherwise(0.0)
        return odds


#: Where fitting starts, and as how many more documents that counts: a rule seldom speaks against a
#: good document, and a bad document breaks a few of the rules only.
START_GOOD, START_CHANCES, PRIOR_DOCUMENTS = 0.85, ((0.3, 0.1, 0.6), (0.02, 0.08, 0.9)), 10.0
#: The same for rules that never speak for a text.
START_AGAINST = ((0.3, 0.7, 0.0), (0.02, 0.98, 0.0))
#: The most good documents, and the fewest bad ones, that a rule may speak against, and the most bad
#: ones it may speak for. Bad documents are of several kinds; without these bounds, fitting can take
#: one common kind of them for good ones, or good ones for bad.
MOST_AGAINST_GOOD, LEAST_AGAINST_BAD, MOST_FOR_BAD = 0.02, 0.1, 0.6


def _bounded(bad: list[float], good: list[float]) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """The chances of the votes for bad and for good documents, within the bounds; abstaining takes the rest."""
    against_bad, against_good = max(bad[0], LEAST_AGAINST_BAD), min(good[0], MOST_AGAINST_GOOD)
    for_bad, for_good = min(bad[2], MOST_FOR_BAD, 1 - against_bad), max(good[2], bad[2])
    return (against_bad, 1 - against_bad - for_bad, for_bad), (against_good, 1 - against_good - min(for_good, 1 - against_good), min(for_good, 1 - against_good))


def fit(patterns: dict[tuple[int, ...], int], rounds: int = 50) -> VoteModel:
    """Expectation-maximisation over the counts of vote patterns; with no documents, the start.

    The first step takes the start for the chances; each later one weighs every pattern by its
    probability of being good under the model so far.
    """
    starts = tuple(START_CHANCES if good else START_AGAINST for _, _, good in RULES.values())
    model = VoteModel(START_GOOD, starts)
    for _ in range(rounds):
        weight = [[[PRIOR_DOCUMENTS * p for p in start[kind]] for kind in (0, 1)] for start in starts]
        total = [PRIOR_DOCUMENTS * (1 - START_GOOD), PRIOR_DOCUMENTS * START_GOOD]
        for votes, n in sorted(patterns.items()):
            good = 1 / (1 + math.exp(-max(-700.0, min(700.0, model.log_odds(votes)))))
            for kind, share in ((0, 1 - good), (1, good)):
                total[kind] += n * share
                for rule, vote in enumerate(votes):
                    weight[rule][kind][vote] += n * share
        shares = [[[x / sum(w) for x in w] for w in rule] for rule in weight]
        chances = tuple(_bounded(bad, good) for bad, good in shares)
        model = VoteModel(total[1] / sum(total), chances)
    return model


def assess(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None, into: str = "quality") -> DataFrame:
    """The columns ``carry`` of every row (all, if None) and a struct column ``into``.

    It holds the counts (windows are compared by their 64-bit hashes), ``votes`` (per rule 0 bad, 1 abstains, 2 good), ``base_failed``,
    ``log_odds`` of being good and ``kept``: not base_failed, and good is at least as likely as bad.
    Null texts count as empty and fail the base rule, as do all of under ten words. Repeated rows
    are judged alike; an empty table gives an empty result. A carried column that is called as
    ``into`` raises ValueError. The measured rows are stored once, for texts are read for the counts
    of votes and again for the verdict.
    """
    carry = docs.columns if carry is None else carry
    if into in carry:
        raise ValueError(f"the table has a column {into} already")
    extra = [] if text_col in carry else [text_col]
    measured = _measured(docs.select(*[F.col(f"`{x}`") for x in [*carry, *extra]]), text_col, into).select(*[F.col(f"`{x}`") for x in carry], into)
    stored = materialise(measured.withColumn(into, F.col(into).withField("votes", _votes(into))), "quality")
    q = F.col(into)
    failed = (q["n_words"] < 10) | (100 * q["n_repeat_words"] > 20 * q["n_words"])
    # the model is of those that the base rule leaves; at most 3 ** len(RULES) rows come to the driver
    counted = stored.where(~failed).groupBy(q["votes"].alias("votes")).count().collect()
    model = fit({tuple(r["votes"]): r["count"] for r in counted})
    odds = model.column(q["votes"])
    return stored.withColumn(into, q.withField("base_failed", failed).withField("log_odds", odds).withField("kept", ~failed & (odds >= 0)))


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``assess`` keeps, with all their columns."""
    into = new_name("quality").replace("-", "_")
    return assess(docs, text_col, into=into).where(F.col(into)["kept"]).select(*[F.col(f"`{c}`") for c in docs.columns])
