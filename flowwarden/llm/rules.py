"""Quality rules as weak supervision: votes, accuracies by expectation-maximisation, posterior quality. DataFrame and SQL functions only.

No rule decides alone. Each votes good or bad or abstains. What kind a document is stays hidden: good, or bad in
one of several ways. How often each rule is right on each kind is estimated over all documents, and what
counts is the probability of a good document given all votes.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame, functions as F

from .common import staged, text_or_empty

#: Rule: when it votes good, when it votes bad (else it abstains), over the columns of ``with_measures``.
RULES = {
    "length": ("n_words >= 100", "n_words < 50"),
    "symbols": ("100 * n_symbols <= n_words", "10 * n_symbols > n_words"),
    "repeated_lines": ("n_lines >= 5 AND 10 * n_dup_lines <= n_lines", "n_lines >= 5 AND 10 * n_dup_lines > 3 * n_lines"),
    "repeated_words": ("n_words >= 20 AND 10 * n_repeat_words <= n_words", "n_words >= 20 AND 10 * n_repeat_words > 3 * n_words"),
    "capitals": ("n_cased > 0 AND 10 * n_upper <= n_cased", "n_cased > 0 AND 10 * n_upper > 3 * n_cased"),
    "letters": ("n_words > 0 AND 10 * n_letters >= 9 * word_chars", "n_words > 0 AND 10 * n_letters < 8 * word_chars"),
    "word_length": ("n_cased > 0 AND word_chars BETWEEN 3 * n_words AND 10 * n_words", "n_cased > 0 AND word_chars NOT BETWEEN 3 * n_words AND 10 * n_words"),
    "sentence_ends": ("n_lines > 0 AND 10 * n_ended >= 6 * n_lines", "n_lines > 0 AND 10 * n_ended < 2 * n_lines"),
}
#: What is known before votes are counted, worth so many votes of each rule, and documents: the share of good documents,
#: how often a rule's vote is right on good ones, on the bad kind it is made for, and on any other bad kind.
PRIOR_VOTES = 20.0
GOOD_SHARE, RIGHT_ON_GOOD, RIGHT_ON_OWN, RIGHT_ON_OTHER = 0.9, 0.98, 0.9, 0.2
ROUNDS = 12

_BLANKS = " \t\n\x0b\x0c\r"
#: Bits for a word's number in a text; the rest of a bigint holds hash bits.
_PLACE_BITS = 30


@dataclass
class Accuracies:
    """``shares`` of the kinds of documents and ``right[kind][rule]``, how often that rule's vote is right on them.

    Kind 0 is good, where voting good is right. The others are bad, one for each rule, so that documents that
    break one rule only need not look like those that break another.
    """

    rules: list[str]
    shares: list[float]
    right: list[list[float]]

    @classmethod
    def before(cls, rules) -> "Accuracies":
        n = len(rules)
        bad = [[RIGHT_ON_OWN if i == j else RIGHT_ON_OTHER for j in range(n)] for i in range(n)]
        return cls([*rules], [GOOD_SHARE, *[(1 - GOOD_SHARE) / n] * n], [[RIGHT_ON_GOOD] * n, *bad])

    def with_kinds(self, voted: DataFrame) -> DataFrame:
        """Add ``kinds``, the probability of each kind given the votes (1 good, -1 bad, 0 none), if rules err independently."""
        tables = []                                     # of a kind: log of its share, then of each rule's bad vote, none and good vote
        for kind, (share, rights) in enumerate(zip(self.shares, self.right)):
            pairs = [(r, 1 - r) if kind == 0 else (1 - r, r) for r in rights]
            numbers = [log(share), *[x for good, bad in pairs for x in (log(bad), 0.0, log(good))]]
            tables.append("array(" + ", ".join(f"{x!r}D" for x in numbers) + ")")
        # the numbers stay data, so that Spark compiles one plan for all rounds
        df = voted.withColumn("_votes", F.array(*[f"vote_{r}" for r in self.rules]))
        df = df.withColumn("_logs", F.expr(
            f"transform(array({', '.join(tables)}), numbers -> aggregate(sequence(0, {len(self.rules) - 1}), get(numbers, 0), "
            "(total, i) -> total + get(numbers, 3 * i + 2 + get(_votes, i))))"))
        df = df.withColumn("_most", F.array_max("_logs")).withColumn("_odds", F.transform("_logs", lambda x: F.exp(x - F.col("_most"))))
        df = df.withColumn("_sum", F.aggregate("_odds", F.lit(0.0), lambda a, x: a + x))
        return df.withColumn("kinds", F.transform("_odds", lambda x: x / F.col("_sum"))).drop("_votes", "_logs", "_most", "_odds", "_sum")


def with_measures(df: DataFrame, text: str) -> DataFrame:
    """Add counts of words, characters, lines and repeats of the text.

    Words repeat if a window of three words that holds them comes twice in the text. Only texts in which window
    hashes repeat at all are searched: hash bits with the place below are sorted as plain numbers, and the windows that then
    neighbour an equal hash are compared as strings.
    """
    place = (1 << _PLACE_BITS) - 1
    top = (1 << 63 - _PLACE_BITS) - 1
    window = "concat_ws(' ', get(_words, {0}), get(_words, {0} + 1), get(_words, {0} + 2))"
    chars = lambda kept: F.char_length(F.regexp_replace(F.col(text), kept, "")).cast("bigint")
    df = df.withColumn("_bare", F.btrim(F.col(text), F.lit(_BLANKS)))
    df = df.withColumns({
        "_words": F.when(F.col("_bare") == "", F.array().cast("array<string>")).otherwise(F.split("_bare", "[ \t-\r]+", -1)),
        "_lines": F.filter(F.split(text, "\n", -1), lambda line: F.btrim(line, F.lit(_BLANKS)) != "")})
    df = df.withColumn("_hashes", F.expr(
        "transform(slice(_words, 1, greatest(size(_words) - 2, 0)), (w, i) -> xxhash64(w, get(_words, i + 1), get(_words, i + 2)))"))
    df = df.withColumn("_sorted", F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), F.sort_array(F.expr(
        f"transform(_hashes, (h, i) -> shiftleft(h & {top}L, {_PLACE_BITS}) | i)"))))
    beside = lambda array, part: f"({part('x')} <=> {part(f'get({array}, i - 1)')} OR {part('x')} <=> {part(f'get({array}, i + 1)')})"
    df = df.withColumn("_maybe", F.sort_array(F.expr(
        f"transform(filter(_sorted, (x, i) -> {beside('_sorted', lambda x: f'shiftright({x}, {_PLACE_BITS})')}),"
        f" x -> struct({window.format(f'cast(x & {place}L as int)')} AS words, cast(x & {place}L as int) AS at))")))
    df = df.withColumn("_again", F.sort_array(F.expr(
        f"transform(filter(_maybe, (x, i) -> {beside('_maybe', lambda x: f'{x}.words')}), x -> x.at)")))
    return df.withColumns({
        "n_words": F.size("_words").cast("bigint"), "word_chars": chars("[ \t-\r]+"), "n_symbols": chars(r"[^#*$%&|<>]+"),
        "n_letters": chars(r"\P{L}+"), "n_upper": chars(r"\P{Lu}+"), "n_cased": chars(r"[^\p{Lu}\p{Ll}]+"),
        "n_lines": F.size("_lines").cast("bigint"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
        "n_ended": F.size(F.filter("_lines", lambda line: line.rlike(r"""[.!?…。！？]["'»”)\]]*[ \t-\r]*$"""))).cast("bigint"),
        "n_repeat_words": F.coalesce(F.expr(
            "aggregate(transform(_again, (a, i) -> coalesce(least(get(_again, i + 1) - a, 3), 3)), 0L, (n, x) -> n + x)"), F.lit(0).cast("bigint")),
    }).drop("_bare", "_words", "_lines", "_hashes", "_sorted", "_maybe", "_again")


MEASURES = ("n_words", "word_chars", "n_symbols", "n_letters", "n_upper", "n_cased", "n_lines", "n_dup_lines", "n_ended", "n_repeat_words")


def with_votes(df: DataFrame, rules: dict[str, tuple[str, str]] = RULES) -> DataFrame:
    return df.withColumns({
        f"vote_{name}": F.expr(f"CASE WHEN {good} THEN 1 WHEN {bad} THEN -1 ELSE 0 END") for name, (good, bad) in rules.items()})


def estimate(voted: DataFrame, rules: dict[str, tuple[str, str]] = RULES, rounds: int = ROUNDS) -> Accuracies:
    """Expectation-maximisation over all documents.

    Documents with the same votes count together: at most 3 ^ rules rows, written once. Each round weighs them by
    the probability of each kind under the last accuracies and counts the votes anew; a row of sums for each
    kind reaches the driver. The first kind stays the good one because it starts there and keeps its prior votes. No
    documents: what is known before.
    """
    votes = [f"vote_{name}" for name in rules]
    patterns = staged(voted.groupBy(*votes).agg(F.count(F.lit(1)).alias("n")).coalesce(1).sortWithinPartitions(*votes), "vote_patterns")
    before = now = Accuracies.before(rules)
    sums = [F.expr("sum(weight) AS documents")]
    for vote in votes:
        sums += [F.expr(f"sum(if(if(kind = 0, {vote}, -{vote}) > 0, weight, 0D)) AS right_{vote}"), F.expr(f"sum(if({vote} <> 0, weight, 0D)) AS all_{vote}")]
    for _ in range(rounds):
        # outer: else the optimiser tests the array's size below, and so builds it twice
        weighed = now.with_kinds(patterns).select("n", *votes, F.posexplode_outer("kinds").alias("kind", "p")).withColumn("weight", F.col("n") * F.col("p"))
        found = {r["kind"]: r for r in weighed.groupBy("kind").agg(*sums).collect()}            # a row for each kind
        if not found:
            return before
        total = sum(r["documents"] for r in found.values())
        now = Accuracies(
            now.rules, [(found[k]["documents"] + PRIOR_VOTES * share) / (total + PRIOR_VOTES) for k, share in enumerate(before.shares)],
            [[(found[k][f"right_{v}"] + PRIOR_VOTES * known) / (found[k][f"all_{v}"] + PRIOR_VOTES) for v, known in zip(votes, row)]
             for k, row in enumerate(before.right)])
    return now


def judged(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: dict[str, tuple[str, str]] = RULES) -> tuple[DataFrame, Accuracies]:
    """``key``, the measures, a ``vote_<rule>`` for each rule and ``posterior`` of every document; the accuracies.

    Texts are read once: measures and votes are written (some 20 numbers a document), and both the accuracies
    and the result come from there. Nothing is shuffled but counts of vote patterns.

    Null texts count as empty, and those have no word, so some rules abstain. Texts are read whole; repeated rows and
    null keys are documents like any others; no rows, no result. Other columns are ignored, whatever their names.
    """
    plain = docs.select(F.col(key).alias("_key"), text_or_empty(text).alias("_text"))
    voted = with_votes(with_measures(plain, "_text").select("_key", *MEASURES), rules)
    voted = staged(voted, "votes")
    known = estimate(voted, rules)
    return known.with_kinds(voted).withColumn("posterior", F.get("kinds", F.lit(0))).drop("kinds").withColumnRenamed("_key", key), known
