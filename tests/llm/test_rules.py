"""Measures, votes and expectation-maximisation against plain versions."""

import math
import re
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from flowwarden.llm import oracle, queries, rules
from tests import compare
from tests.llm import helpers


def brute_measures(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    times = Counter(zip(words, words[1:], words[2:]))
    held = {j for i, g in enumerate(zip(words, words[1:], words[2:])) if times[g] > 1 for j in range(i, i + 3)}
    kinds = Counter(unicodedata.category(c) for c in t)
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", t)),
        "n_letters": sum(n for k, n in kinds.items() if k[0] == "L"), "n_upper": kinds["Lu"], "n_cased": kinds["Lu"] + kinds["Ll"],
        "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)),
        "n_ended": sum(bool(re.search(r"""[.!?…。！？]["'»”)\]]*[ \t-\r]*$""", x)) for x in lines), "n_repeat_words": len(held)}


def brute_votes(measures):
    out = []
    for good, bad in rules.RULES.values():
        to_python = lambda e: re.sub(r"(\w+) (NOT )?BETWEEN (.+) AND (.+)", r"\2(\3 <= \1 <= \4)", e).replace("AND", "and").replace("NOT", "not")
        out.append(1 if eval(to_python(good), {}, measures) else -1 if eval(to_python(bad), {}, measures) else 0)
    return tuple(out)


def brute_posteriors(votes, rounds=rules.ROUNDS):
    """Expectation-maximisation document by document."""
    j = len(rules.RULES)
    prior = [[rules.RIGHT_ON_GOOD] * j] + [[rules.RIGHT_ON_OWN if a == b else rules.RIGHT_ON_OTHER for b in range(j)] for a in range(j)]
    prior_share = [rules.GOOD_SHARE] + [(1 - rules.GOOD_SHARE) / j] * j
    right, share = prior, prior_share

    def kinds(v):
        odds = [share[k] * math.prod(1 if x == 0 else right[k][i] if (x > 0) == (k == 0) else 1 - right[k][i] for i, x in enumerate(v)) for k in range(j + 1)]
        return [o / sum(odds) for o in odds]

    for _ in range(rounds if votes else 0):
        p = [kinds(v) for v in votes]
        add = lambda k, i, test: math.fsum(q[k] for q, v in zip(p, votes) if test(v[i]))
        new = [[(add(k, i, lambda x: x and (x > 0) == (k == 0)) + rules.PRIOR_VOTES * prior[k][i]) / (add(k, i, bool) + rules.PRIOR_VOTES) for i in range(j)]
               for k in range(j + 1)]
        share = [(math.fsum(q[k] for q in p) + rules.PRIOR_VOTES * prior_share[k]) / (len(votes) + rules.PRIOR_VOTES) for k in range(j + 1)]
        right = new
    return [kinds(v)[0] for v in votes]


def check(rows, texts):
    votes = [brute_votes(brute_measures(t)) for t in texts]
    want = sorted(((repr(brute_measures(t)), v, p) for t, v, p in zip(texts, votes, brute_posteriors(votes))))
    got = sorted((repr({m: r[m] for m in rules.MEASURES}), tuple(r[f"vote_{n}"] for n in rules.RULES), r["posterior"]) for r in rows)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=1e-9)


def odd_texts():
    return [t for _, t in helpers.nasty_texts()] + [
        "a b c a b c", "a b c d a b", "x x x x", "One. Two!\n \nTwo!\nTwo!", " lead and trail ", "SHOUTED TEXT " * 30, "$$$ ### <b>| 100% " * 20,
        " odd\u0085line ends stay words", "Ends “so.”  \nand (so.)\nnot so", "ab c ab c", "a bc a bc a b c"]


def test_odd_documents(spark):
    texts = odd_texts()
    judged, _ = rules.judged(helpers.table(spark, list(enumerate(texts))).repartition(3))
    check(judged.collect(), texts)
    nothing, known = rules.judged(helpers.empty(spark))
    assert nothing.count() == 0 and known == rules.Accuracies.before(rules.RULES)


def test_repeated_windows_are_told_by_their_words(spark, monkeypatch):
    # with three hash bits left nearly all windows look repeated
    monkeypatch.setattr(rules, "_PLACE_BITS", 60)
    texts = [t for t in odd_texts() if len(t or "") < 5000]
    rows = rules.with_measures(helpers.table(spark, list(enumerate(texts))), "text").select("doc_id", "n_repeat_words").collect()
    assert all(r["n_repeat_words"] == brute_measures(texts[r["doc_id"]])["n_repeat_words"] for r in rows)


def test_no_rule_decides_alone(spark):
    """A vote that most rules gainsay does not drop a document, agreeing bad votes do."""
    judged, known = rules.judged(helpers.read(spark, "documents"))
    rows = judged.select("posterior", *[f"vote_{r}" for r in rules.RULES]).collect()
    single = [r["posterior"] for r in rows if list(r[1:]).count(-1) == 1]
    many = [r["posterior"] for r in rows if list(r[1:]).count(-1) >= 3]
    none = [r["posterior"] for r in rows if -1 not in r[1:] and list(r[1:]).count(1) >= 5]
    assert min(none) > 0.9 and max(single) > 0.5 and max(many) < 0.1
    assert known.shares[0] > 0.5 and all(x > 0.7 for x in known.right[0])


def test_op13(spark):
    got = queries.op13_quality_rules(spark, helpers.SF)
    docs = helpers.read(spark, "documents").collect()
    check(rules.judged(helpers.read(spark, "documents"))[0].collect(), [d["text"] for d in docs])
    assert compare.difference(compare.spark_rows(got), compare.duck_rows(compare.connect(helpers.SF), oracle.SQL["op13_quality_rules"])) is None
    label = {r["doc_id"]: r["quality"] for r in helpers.read(spark, "labels").collect()}
    rows = [r for r in got.collect() if r["doc_id"] in label and not r["base_failed"]]
    kept = {q: [r["kept"] for r in rows if label[r["doc_id"]] == q] for q in (0, 1)}
    assert sum(kept[1]) >= 0.98 * len(kept[1]) and sum(kept[0]) <= 0.2 * len(kept[0])
    assert not any(r["kept"] for r in got.collect() if r["base_failed"])


def test_native():
    source = open(rules.__file__, encoding="utf-8").read()
    assert not re.search(r"udf|mapIn|pandas|arrow|\.rdd", source)
