"""Evidence fusion against the same sums in numpy."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowwarden.llm import language, queries
from tests.llm import helpers


def brute_grams(text):
    b = "".join(c if c.isascii() and c.isalpha() else c if not c.isascii() else " " for c in text.lower())
    raw = b" " + b" ".join(b.encode().split(b" ")) + b" "
    while b"  " in raw:
        raw = raw.replace(b"  ", b" ")
    codes = [raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2] for i in range(len(raw) - 2) if raw[i + 1] != 32]
    return [(c * 2654435761 % (1 << 32)) >> 20 for c in codes]


def softmax(x):
    e = np.exp(np.array(x) - max(x))
    return e / e.sum()


def brute(rows, trained, strength=20.0, evidence=64.0, trust=0.9):
    """rows: (text, declared, host, suffix) -> (language, confidence, text language)."""
    names = sorted({d for t, d in trained if t is not None and d is not None})
    counts, n = {x: np.full(language.BUCKETS, 0.5) for x in names}, defaultdict(int)
    for t, d in trained:
        if t is not None and d is not None:
            n[d] += 1
            for g in brute_grams(t):
                counts[d][g] += 1
    log_p = {x: np.log(c / c.sum()) for x, c in counts.items()}
    freq = np.array([n[x] / sum(n.values()) for x in names])
    k, seen = len(names), []
    for text, declared, host, suffix in rows:
        g = brute_grams(text or "")
        ll = [sum(log_p[x][i] for i in g) * evidence / (len(g) + evidence) for x in names] if g else None
        given = [(math.log(trust) if d == declared else math.log((1 - trust) / max(k - 1, 1))) if declared in names else 0.0 for d in names]
        local = np.array(ll or [0.0] * k) + given
        seen.append((ll, local, softmax(local + np.log(freq)), host, suffix))
    total = lambda rule: sum((s[2] for s in seen if rule(s)), np.zeros(k))
    out = []
    for ll, local, soft, host, suffix in seen:
        prior = np.full(k, 1 / k)
        for c in (total(lambda s: True), total(lambda s: s[4] == suffix), total(lambda s: s[4] == suffix and s[3] == host)):
            c = np.maximum(c - soft, 0)
            prior = (c + strength * prior) / (c.sum() + strength)
        post = softmax(local + np.log(prior))
        out.append((names[int(post.argmax())], post.max(), names[int(np.argmax(ll))] if ll else None))
    return out


def test_against_brute_force(spark):
    trained = [("the cat and the dog are in the house", "en"), ("le chat et le chien sont dans la maison", "fr"), ("der hund und die katze", "de"), (None, "en"), ("x", None)]
    rows = [("the house", "fr", "a", "com"), ("la maison", None, "a", "com"), ("und", "xx", "b", "de"), ("", "de", "b", "de"), (None, None, "b", "de"),
            ("123 !!", "fr", None, None), ("chat", None, None, None), ("chat", None, None, None), ("Ä" * 5000, "de", "c", "de"), ("der hund und der hund", "en", "a", "com")]
    model = language.train(spark.createDataFrame(trained, "text string, lang string"))
    df = spark.createDataFrame([(i, *r, "q") for i, r in enumerate(rows)], "doc_id bigint, text string, lang string, host string, suffix string, _host string")
    found = language.identify(df, model, F.col("text"), F.col("lang"), F.col("host"), F.col("suffix")).orderBy("doc_id").collect()
    for r, (name, confidence, by_text) in zip(found, brute(rows, trained)):
        assert (r["language"], r["text_language"]) == (name, by_text)
        assert r["confidence"] == pytest.approx(confidence, abs=1e-9)
        assert r["accepted"] == (by_text is not None and r["confidence"] >= 0.5) and r["_host"] == "q"


def test_odd_documents(spark):
    found = queries.identified(helpers.nasty(spark))
    rows = found.collect()
    assert len(rows) == len(helpers.nasty_texts()) and {r["language"] for r in rows} == {"en"}
    assert {r["doc_id"] for r in rows if not r["accepted"]} >= {7, 8, 11} and all(r["accepted"] for r in rows if r["doc_id"] == 5)
    assert queries.identified(helpers.empty(spark)).count() == 0


def test_no_language_known(spark):
    rows = queries.identified(helpers.table(spark, [(1, "text")], lang=None)).collect()
    assert rows[0]["language"] is None and not rows[0]["accepted"]


def test_pages(spark):
    df = spark.createDataFrame(
        [("http://WWW.A.example.FR:80/x", '<HTML class="q" lang="fr-CA"><!-- a --><script>b</script><p>c&amp;d</p>'), (None, None), ("no address", "<p lang='de'>x")],
        "url string, html string")
    got = df.select(language.address_host("url"), language.address_suffix("url"), language.markup_language("html"), language.markup_text("html")).collect()
    assert [tuple(r)[:3] for r in got] == [("www.a.example.fr", "fr", "fr"), (None, None, None), (None, None, None)]
    assert got[0][3].split() == ["c", "d"]


def test_op5_tells_languages_apart(spark):
    rows = queries.op5_language_id(spark, helpers.SF).collect()
    assert np.mean([r["language"] == r["lang"] for r in rows]) > 0.98
    pages = queries.page_languages(spark, helpers.SF).collect()
    assert len(pages) == helpers.read(spark, "pages").count() and np.mean([p["accepted"] for p in pages]) > 0.98


def test_gibberish_and_undeclared_languages_are_rejected(spark):
    docs = helpers.read(spark, "documents").select("doc_id", "text", "lang", "source")
    known = docs.where("lang <> 'es'")
    rng = random.Random(4)
    odd = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(n)) for n in (5, 20, 200) for _ in range(20)]
    odd += ["".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(n)) for n in (8, 100) for _ in range(20)]
    odd = spark.createDataFrame([(-1 - i, t, ("en", "xx", None)[i % 3], "s") for i, t in enumerate(odd)], "doc_id bigint, text string, lang string, source string")
    none = F.lit(None).cast("string")
    rows = language.identify(
        known.unionByName(odd).unionByName(docs.where("lang = 'es'")), language.train(known), F.col("text"), F.col("lang"), F.col("source"), none).collect()
    assert not [r for r in rows if r["accepted"] and (r["doc_id"] < 0 or r["lang"] == "es")] and any(r["lang"] == "es" for r in rows)
    clean = [r for r in rows if r["doc_id"] >= 0 and r["lang"] != "es" and r["text_language"] is not None]
    assert len(clean) > 100 and all(r["accepted"] == (r["confidence"] >= 0.5) for r in clean)


def test_more_declared_values_than_are_learnt(spark, monkeypatch):
    monkeypatch.setattr(language, "LANGUAGES", 2)
    rows = [(i, "die der und das ist nicht " * 5, "de") for i in range(9)] + [(20 + i, "the and of that is not " * 5, "en") for i in range(8)]
    rows += [(40 + i, "the and of that is not " * 5, f"free text {i}") for i in range(7)]
    docs = spark.createDataFrame([(i, t, d, "s") for i, t, d in rows], "doc_id bigint, text string, lang string, source string")
    model = language.train(docs)
    assert model.languages == ["de", "en"]
    none = F.lit(None).cast("string")
    found = {r["doc_id"]: r["language"] for r in language.identify(docs, model, F.col("text"), F.col("lang"), F.col("source"), none).collect()}
    assert all(found[i] == ("de" if i < 20 else "en") for i in found) and len(found) == 24
