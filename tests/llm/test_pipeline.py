"""The stages against plain versions of them, chained as the pipeline chains them."""

import random
import re

import public_tokenizers
import pytest

import __spark_entry__
import corpus_pipeline
from tests.llm import helpers, test_language, test_lines, test_sharding_packing, test_simhash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small corpus with copies, near copies, shared lines, an item, and texts without letters."""
    rng = random.Random(12)
    sentence = lambda n=14: helpers.words(rng, n, 5000).capitalize() + "."
    rows = [(i, "\n".join(sentence() for _ in range(rng.randint(1, 9)))) for i in range(150)]
    line = sentence()
    item = helpers.words(rng, 25, 9000)
    rows += [(200 + i, rows[i][1]) for i in range(20)]                                       # copies
    rows += [(300 + i, rows[30 + i][1].replace(" ", "  ") + "\n" + sentence(2)) for i in range(20)]    # near copies, other lines
    rows += [(400 + i, f"{sentence()}\n{line}\n{sentence()}") for i in range(20)]
    rows += [(500 + i, f"{sentence(30)} {item} {sentence(20)}") for i in range(5)]
    rows += [(600, None), (601, ""), (602, "123 456 !!"), (None, sentence(40)), (603, "x" * 3000), (604, "word " * 4000)]
    path = str(tmp_path_factory.mktemp("pipeline"))
    docs = [(i, t, ("en", "de")[k % 2] if k % 7 else None, f"src{k % 3}", len(t or "")) for k, (i, t) in enumerate(rows)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def brute(docs, items):
    """docs: rows of ``documents`` -> what each stage keeps, as (doc_id, text)."""
    judged = test_language.brute([(t, d, s, None) for _, t, d, s in docs], [(t, d) for _, t, d, _ in docs])
    kept = [(i, t) for (i, t, _, _), (_, confidence, by_text) in zip(docs, judged) if by_text is not None and confidence >= 0.5]
    yield kept
    kept = sorted(kept, key=lambda r: (r[0] is not None, r[0] or 0))
    fewer = test_lines.brute([t for _, t in kept])
    kept = [(i, new) for (i, old), new in zip(kept, fewer) if new == old or new.strip(" ")]
    yield kept
    prints = {i: test_simhash.brute_print(t) for i, t in kept}
    of = test_simhash.brute_groups(set(prints.values()), 4)
    least = {}
    for i, p in prints.items():
        if i is not None:
            least[of[p]] = min(i, least.get(of[p], i))
    kept = [(i, t) for i, t in kept if i is None or least[of[prints[i]]] == i]
    yield kept
    norm = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    yield [(i, t) for i, t in kept if not any(norm(p) in norm(t) for p in items if p)]


def test_stages(spark, folder, tmp_path):
    docs = corpus_pipeline.queries.documents(spark, folder)
    plain = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.collect()]
    items = [r["text"] for r in corpus_pipeline.queries.benchmark(spark, folder).collect()]
    key = lambda r: (r[0] is not None, r[0] or 0)
    for (name, stage), want in zip(corpus_pipeline.STAGES, brute(plain, items)):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == COLUMNS
        rows = docs.collect()
        assert sorted(((r["doc_id"], r["text"]) for r in rows), key=key) == sorted(want, key=key), name
        assert all(r["n_chars"] == len(r["text"]) for r in rows), name
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    test_sharding_packing.check_pieces(pieces, [t for _, t in want], 1024)
    whole = corpus_pipeline.run(spark, folder)
    by = lambda rows: sorted((r["doc_id"] or -1, r["start"], r["length"]) for r in rows)
    assert sum(r["length"] for r in whole.collect()) == sum(p["length"] for p in pieces)
    assert {r[0] for r in by(whole.collect())} == {r[0] for r in by(pieces)}


def test_stages_of_nothing_and_of_odd_documents(spark, folder):
    for docs in (helpers.empty(spark), helpers.nasty(spark)):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, folder)
            rows = out.collect()
            assert (out.columns == docs.columns) == (name != "packing") and len(rows) <= (n or 0) * 40
            assert n or not rows


def test_registered():
    names = [*__spark_entry__.queries()]
    assert [n for n in names if re.match(r"op\d+_", n)] == [n for n in names if n.startswith("op")]
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in names if n.startswith("op")} == set(range(1, 14)) and "pipeline" in names
    assert public_tokenizers.path(corpus_pipeline.queries.TOKENIZER)


def test_rows_that_share_an_id_keep_their_own_fate(spark, folder):
    rng = random.Random(4)
    a, b, c = (helpers.words(rng, 60, 9000) for _ in range(3))
    item = corpus_pipeline.queries.benchmark(spark, folder).where("text IS NOT NULL").first()["text"]
    rows = helpers.table(spark, [(0, a), (1, a), (1, b), (None, c), (None, f"{b} {item}"), (1, f"{c} {item}"), (2, c), (2, c)])
    texts = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)
    kept = corpus_pipeline.decontamination(spark, rows, folder)
    assert texts(kept) == sorted([(0, a), (1, a), (1, b), (None, c), (2, c), (2, c)], key=repr)
    assert texts(corpus_pipeline.near_duplicates(spark, kept, folder)) == sorted([(0, a), (1, b), (None, c), (2, c)], key=repr)
