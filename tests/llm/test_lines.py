"""Line dedup against a plain search for near lines."""

import random

import pytest

import corpus_pipeline
from flowwarden.llm import lines
from tests.llm import helpers


def distance_within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i:] == b[i + 1:] or a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def brute(rows, min_chars=10):
    """rows in key order -> their lines that stay."""
    seen, out = [], []
    for text in rows:
        kept = []
        for line in text.split("\n"):
            if len(line) < min_chars:
                if line not in seen or not line:
                    kept.append(line)
            elif not any(distance_within_one(line, s) for s in seen if len(s) >= min_chars):
                kept.append(line)
            seen.append(line)
        out.append("\n".join(kept))
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    base = ["".join(rng.choice("abc é日") for _ in range(rng.randint(8, 40))) for _ in range(40)]

    def changed(line):
        i, kind = rng.randrange(len(line) + 1), rng.randrange(5)
        return (line, line[:i] + rng.choice("abz") + line[i:], line[:i] + line[i + 1:], line[:i] + rng.choice("abz") + line[i + 1:],
                line[:i] + "zz" + line[i + 2:])[kind]
    return ["\n".join(changed(rng.choice(base)) for _ in range(rng.randint(0, 12))) for _ in range(80)]


def test_against_brute_force(spark, texts):
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in lines.drop_repeated_lines(helpers.table(spark, rows)).collect()}
    want = brute(texts)
    assert [got[i]["text"] for i in range(len(texts))] == want
    assert sum(r["n_removed"] for r in got.values()) > 100
    assert all(got[i]["n_lines"] == t.count("\n") + 1 for i, t in enumerate(texts))


def test_odd_documents(spark):
    rows = helpers.nasty_texts()
    got = lines.drop_repeated_lines(helpers.nasty(spark)).collect()
    assert len(got) == len(rows) and got[0]["hash"] == "clash"
    by = {r["doc_id"]: r["text"] for r in got if r["doc_id"] is not None}
    unnamed = {r["text"] for r in got if r["doc_id"] is None}
    base = dict(rows)[5]
    assert unnamed == {base, None}                              # null keys come first
    assert by[7] is None and by[8] == "" and by[5] == "" and by[9] == "" and by[25] == "tail  \n\n\n"
    assert by[23] == "same line that comes again\nthe last line is new"
    assert by[24] == "another line of this one"
    assert sum(r["doc_id"] == 23 for r in got) == 2


def test_no_rows(spark):
    out = lines.drop_repeated_lines(helpers.empty(spark))
    assert out.count() == 0 and set(helpers.SCHEMA.names) <= set(out.columns)


def test_a_hot_line(spark):
    rows = [(i, f"{'a very common line':>30}\nline number {i:06d} of its own") for i in range(400)]
    got = {r["doc_id"]: r["text"] for r in lines.drop_repeated_lines(helpers.table(spark, rows)).collect()}
    assert [got[i] for i in range(400)] == brute([t for _, t in rows])


def test_short_lines_that_are_equal(spark):
    texts = ["Menu\nHome\n\nthe first line of its own", "Home\nMenu\n\nHomes\nthe second line, its own", "今日は晴れです。\nMenu", "今日は晴れです。\nx\nx\n", "Menu\n今日も晴れです。"]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r["text"] for r in lines.drop_repeated_lines(helpers.table(spark, rows)).collect()}
    assert [got[i] for i in range(5)] == [texts[0], "\nHomes\nthe second line, its own", "今日は晴れです。", "x\n", "今日も晴れです。"]
    stage = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, helpers.table(spark, rows), "").collect()}
    assert stage == got
    assert {r["text"] for r in lines.drop_repeated_lines(helpers.table(spark, rows), exact_chars=10).collect()} == set(texts)
    found = spark.createDataFrame([(1, "Les.\nthe first of two documents"), (2, "Les.\nsomething else altogether")], "doc_id bigint, text string")
    assert sorted(r["text"] for r in lines.drop_repeated_lines(found).collect()) == ["Les.\nthe first of two documents", "something else altogether"]
