"""Templates, slots and planted items."""

import random
import re

from flowwarden.llm import decontam, queries
from tests.llm import helpers

ITEM = ("a train that left {0} at noon ran {1} km in {2} hours while the other train from {0} needed {3} hours "
        "so by how many km per hour was the first one faster than the second")


def run(spark, docs, items, **options):
    frame = spark.createDataFrame([(i, t, "x", "y") for i, t in items], "item_id bigint, text string, key string, hash string")
    return {(r["doc_id"], r["item_id"]): r for r in decontam.matches(helpers.table(spark, docs), frame, **options).collect()}


def test_templates():
    vocabulary = decontam.Vocabulary()
    t = decontam.Template("He paid $3.50 to Ada Lovelace, who ran 12 km. Then THREE Miles", vocabulary)
    assert t.shown(0, len(t.hash)) == (
        "he paid <unit> <number> to <name> who ran <number> <unit> then <number> <unit>",
        ["<unit> $", "<number> 3.50", "<name> ada lovelace", "<number> 12", "<unit> km", "<number> three", "<unit> miles"])


def test_reparameterised_items_are_found(spark):
    items = [(1, ITEM.format("Paris", 300, 4, 6))]
    docs = [
        (1, "Some text. " + ITEM.format("Paris", 300, 4, 6) + " More."), (2, ITEM.format("Rome", 420, 5, "seven").upper().replace("ROME", "Rome")),
        (3, ITEM.format("Oslo", 90, 2, 3).replace(" from Oslo", " from Bergen")),       # the name must stay the same
        (4, ITEM.format("Lima", 8, 8, 8)), (5, "nothing of the kind is written in this one"), (6, None), (7, ""), (None, ITEM.format("Bern", 1, 2, 3))]
    got = run(spark, docs, items)
    assert {k[0] for k in got} == {1, 2, None}
    assert not got[1, 1]["reparameterised"] and got[2, 1]["reparameterised"]
    assert got[1, 1]["covered_tokens"] == got[1, 1]["item_tokens"]


def test_short_and_odd_items(spark):
    items = [(1, "what is the capital of Peru"), (2, None), (3, ""), (4, "5 6 7 8"), (5, "... !!"), (None, "an item that has no number of its own at all here"), (6, "yes")]
    docs = [(1, "I ask: what is the capital of Chile"), (2, "what is the capital"), (3, "5 6 7 8"), (4, "an item that has no number of its own at all here")]
    assert set(run(spark, docs, items)) == {(1, 1), (4, None)}
    assert run(spark, [], items) == {} and run(spark, docs, []) == {}


def test_odd_documents(spark):
    rows = helpers.nasty_texts()
    passage = dict(rows)[15]
    got = run(spark, rows, [(1, passage)])
    assert {k[0] for k in got} == {15, 16}


def test_clean(spark):
    items = spark.createDataFrame([(1, "one two passage of a test that nobody should have seen before it is given")], "item_id bigint, text string")
    docs = helpers.table(spark, [(1, "x " + items.first()["text"]), (2, "fine"), (2, "fine"), (3, None), (None, "no id")])
    kept = decontam.clean(docs, items)
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 2, 2, 3] and kept.columns == docs.columns


def test_op2(spark):
    norm = lambda t: " ".join(re.findall(r"[^\W_]+", (t or "").lower()))
    docs = {d["doc_id"]: norm(d["text"]) for d in helpers.read(spark, "documents").collect()}
    items = {d["item_id"]: norm(d["text"]) for d in helpers.read(spark, "benchmark").collect()}
    got = {(r["doc_id"], r["item_id"]) for r in queries.op2_decontamination(spark, helpers.SF).collect()}
    assert got == {(k, i) for k, t in docs.items() for i, p in items.items() if f" {p} " in f" {t} "}


def test_planted_items_in_many_documents(spark):
    rng = random.Random(6)
    item = helpers.words(rng, 30, 10_000)
    docs = [(i, f"{helpers.words(rng, 40, 10_000)} {item if i % 3 == 0 else ''} {helpers.words(rng, 10, 10_000)}") for i in range(300)]
    assert {k[0] for k in run(spark, docs, [(9, item)])} == {i for i in range(300) if i % 3 == 0}


def test_verbatim_copies_of_number_rich_items(spark):
    items = [
        (1, "What is 12 plus 7?"), (2, "Peru 1821"), (3, "5 plus 6"), (4, "Compute 3 + 4 + 5 + 6 + 7 + 8 and then 9 + 10"),
        (5, "Sum 1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 of these 1 2 3 4 5"), (6, "A box of 12 eggs costs 3 dollars in 1999, 4 in 2000"),
        (7, "How far do 3 men get in 45 minutes at 7 km")]
    docs = [(i, f"Some words go before. {t} Some more come after.") for i, t in items]
    docs += [(10 + i, f"Some words go before. {re.sub('[0-9]+', lambda m: m[0] + '1', t)} Some more come after.") for i, t in items]
    got = run(spark, docs, items)
    assert {k for k in got if k[0] < 10} == {(i, i) for i, _ in items}
    assert not any(r["reparameterised"] for k, r in got.items() if k[0] < 10) and all(r["covered_tokens"] == r["item_tokens"] for k, r in got.items() if k[0] < 10)
    assert not {k for k in got if k[0] in (11, 12, 13, 15)}              # few words and other numbers are another text


def test_copies_in_other_context_lines_and_case(spark):
    items = [
        (1, "Which river flows through Rome"), (2, "Why did Ada Lovelace write to Charles Babbage about the engine"), (3, "As Anna has 5 apples she gives 2 to Ben today"),
        (4, "Die Straße von Anna’s Haus nach Bern ist heute lang und sehr nass"),
        (5, "When Maria Silva bought 14 loaves in Lisbon and sold 9 in Porto how many loaves were left for her to eat")]
    ways = [
        lambda t: f"It was asked, {t} and then more.", lambda t: f'some words "{t}" came next', lambda t: f"nothing eranha {t} more of it",
        lambda t: "Before. " + t.replace(" ", "\n") + "\nAfter.", lambda t: f"before {t.upper()} after", lambda t: f"before {t.lower()} after",
        lambda t: f"before {t.title()} after", lambda t: f"before {t}, after".replace("’", "'")]
    docs = [(10 * w + i, way(t)) for w, way in enumerate(ways) for i, t in items]
    other = [(100 + 10 * w + 3, way(items[2][1].replace("5", "8").replace("2", "3"))) for w, way in enumerate(ways[:6])]
    got = run(spark, docs + other, items)
    assert set(got) == {(10 * w + i, i) for w in range(len(ways)) for i, _ in items} | {(k, 3) for k, _ in other}
    assert all(r["reparameterised"] == (k[0] > 100) for k, r in got.items())


def test_reading_many_texts_at_once():
    rng, vocabulary = random.Random(2), decontam.Vocabulary()
    texts = ["", "12", "km 5", "Ada", "Lovelace ran 3", "km\n5 Ada", *[" ".join(rng.choices(["Ada", "ran", "5", "km", ".", "\n", "$", "won"], k=rng.randint(0, 30))) for _ in range(60)]]
    (keys, raw, ends), = decontam._parts(enumerate(texts))
    tokens = raw, decontam.np.array([vocabulary[x] for x in raw])
    for reading in decontam.READINGS:
        whole, one = decontam.Template("", vocabulary, reading, tokens), [decontam.Template(t, vocabulary, reading) for t in texts]
        assert whole.hash.tolist() == [h for t in one for h in t.hash.tolist()]
