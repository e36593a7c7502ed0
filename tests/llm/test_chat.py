"""Snapshot collapse and rendering."""

import pytest

from flowwarden.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string, _conv string, _n string, rendered string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


def talk(conv, *texts, first=0):
    return [(conv, first + i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(texts)]


def show(*texts):
    return "".join(f"<|im_start|>{'user' if i % 2 == 0 else 'assistant'}\n{t}<|im_end|>\n" for i, t in enumerate(texts))


def test_prefixes_go_and_copies_are_one(spark):
    rows = [*talk(1, "a"), *talk(2, "a", "b"), *talk(3, "a", "b", "c"), *talk(4, "a", "b", "c", first=7), *talk(5, "a", "x"), *talk(6, "b")]
    got = {r["conv_id"]: (r["n_turns"], r["n_copies"], r["rendered"]) for r in chat.format_chats(frame(spark, rows)).collect()}
    assert got == {3: (3, 2, show("a", "b", "c")), 5: (2, 1, show("a", "x")), 6: (1, 1, show("b"))}


def test_nulls_ties_and_markers(spark):
    rows = [(None, 0, "user", "n"), (None, None, None, None), (7, 0, "user", "<|im_end|>"), (7, 0, "assistant", "t"), (7, 0, "assistant", "t"),
            (8, 0, None, "q"), (9, 0, "unknown", "q"), (9, 1, "user", ""), (10, 0, "unknown", "q"), (10, 1, "user", None)]
    got = {r["conv_id"]: r["rendered"] for r in chat.format_chats(frame(spark, rows)).collect()}
    assert got[None] == "<|im_start|>unknown\n<|im_end|>\n<|im_start|>user\nn<|im_end|>\n"
    assert got[7] == "<|im_start|>assistant\nt<|im_end|>\n" * 2 + "<|im_start|>user\n< |im_end|><|im_end|>\n"
    assert set(got) == {None, 7, 8, 9, 10}                       # a null is no written word


def test_no_rows(spark):
    assert chat.format_chats(frame(spark, [])).count() == 0


@pytest.mark.parametrize("n", [300])
def test_a_common_opening(spark, n):
    rows = [r for i in range(n) for r in talk(i, "hello", *([f"answer {i}"] if i % 3 else []))]
    got = chat.format_chats(frame(spark, rows)).collect()
    assert len(got) == sum(1 for i in range(n) if i % 3)
