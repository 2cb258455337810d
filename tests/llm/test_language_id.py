import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from support import SMALL

from tabulark.llm import bytes_kernel as bk
from tabulark.llm import language_id as li
from tabulark.llm import queries


def packed(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw])))


def bucket(gram):
    h = np.uint64(len(gram))
    with np.errstate(over="ignore"):
        for c in gram:
            h = h * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0 if c == " " else ord(c))
    return int(bk.mix(np.array([h]))[0] % np.uint64(li.BUCKETS))


def brute_grams(text):
    """Of each word with a gap before and after it."""
    out = Counter()
    words = re.findall(r"[^\W\d_]+", text.lower())
    for w in words:
        out.update(bucket(c) for c in w)
        out.update(bucket(g) for g in (f" {w} "[i : i + 2] for i in range(len(w) + 1)))
        out.update(bucket(g) for g in (f" {w} "[i : i + 3] for i in range(len(w))))
    return out


TEXTS = ["", "a", "Él está aquí.", "  x  y ", "123 !?", "Straße über ÄÖÜ", "😀 ok", "été", "a b\nc\td", "日本語 テキスト"]


def test_grams_equal_those_of_words():
    counts = li.Grams(*packed(TEXTS)).counts()
    for text, row in zip(TEXTS, counts):
        assert {int(i): int(row[i]) for i in np.flatnonzero(row)} == dict(brute_grams(text)), text
    assert li.Grams(*packed(TEXTS)).has_letter.tolist() == [any(c.isalpha() for c in t) for t in TEXTS]


def test_long_texts_have_the_grams_of_their_pieces():
    text = "lorem ipsum dolor sit amet été " * 3000
    data, offsets = packed([text])
    whole, letter = li.gram_means(data, offsets, li.Grams.counts)
    parts, _ = li.gram_means(data, offsets, li.Grams.counts, most=1000)
    assert letter.tolist() == [True] and np.allclose(whole, parts, atol=1e-9)
    unbroken, _ = li.gram_means(*packed(["é" * 9000]), li.Grams.counts, most=1000)
    assert abs(unbroken.sum() - 1) < 1e-6


@pytest.mark.parametrize("n", [2, 3, 4, 5, 6, 20, 150])
def test_codewords_differ_and_every_bit_splits(n):
    code = li.codewords(n).astype(int)
    apart = (code.shape[1] - code @ code.T) // 2 + 10**6 * np.eye(n, dtype=int)
    assert (np.abs(code.sum(0)) < n).all() and len({tuple(c) for c in code}) == n
    if n <= li.EXHAUSTIVE:
        assert code.shape[1] == 2 ** (n - 1) - 1 and apart.min() == 2 ** (n - 2)
    else:
        assert apart.min() >= code.shape[1] // 5
    assert li.codewords(0).shape == (0, 0) and li.codewords(1).shape == (1, 0)


def test_classifiers_reach_the_optimum():
    """The gradient of the weighted loss vanishes."""
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(300, 5)).astype(np.float32), np.where(rng.random((300, 2)) < 0.5, -1, 1).astype(np.float32)
    weight = np.full(300, 1 / 300, np.float32)
    w, b = li.logistic(x, y, weight, steps=3000)
    pull = -y / 300 / (1 + np.exp(y * (x @ w + b)))
    assert np.abs(x.T @ pull + li.RIDGE * w).max() < 1e-5 and np.abs(pull.sum(0)).max() < 1e-5


def test_decoding_by_hand():
    code = np.array([[1, 1, 1], [-1, 1, -1]], np.int8)
    trust = np.array([[0.5, 0.25, 0.25], [0.2, 0.2, 0.6]])
    model = li.LanguageModel(["a", "b"], code, np.zeros((3, 4)), np.zeros(3), trust, 2.0, 0.1)
    margins = np.array([[0.3, -0.1, -2.0]])
    d = [sum(t * np.log1p(np.exp(-c * m)) for c, m, t in zip(code[i], margins[0], trust[i])) for i in (0, 1)]
    assert np.allclose(model.distances(margins), [d])
    best, second, score, gap = model.decoded(np.array([d, [1.0, 1.0]]))
    assert best.tolist() == [int(d[1] < d[0]), 0] and second.tolist() == [1 - best[0], 1] and gap[1] == 0
    assert np.isclose(score[0], 1 / (1 + np.exp(-2 * abs(d[0] - d[1])))) and score[1] == 0.5


def test_gap_by_brute_force():
    rng = np.random.default_rng(3)
    gap = rng.random(200)
    right = rng.random(200) < gap + 0.3
    cost = lambda cut: (right & (gap < cut)).sum() + li.COST_OF_WRONG * (~right & (gap >= cut)).sum()
    got = li.calibrated_gap(gap, right)
    assert cost(got) == min(cost(c) for c in [li.LEAST_GAP, *(gap + 1e-9)])


def test_query_on_rows_held_out(spark):
    got = {r["doc_id"]: r for r in queries.op11_language_id(spark, SMALL).collect()}
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    assert len(got) == len(rows) and all(r["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) for k, r in got.items())
    held = [r for r in rows if got[r["doc_id"]]["held_out"] and any(c.isalpha() for c in r["text"])]
    right = sum(got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held)
    assert len(held) > 20 and right >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_labels_of_rows_held_out_change_nothing(spark, docs):
    spoiled = docs.withColumn("lang", F.when(li.learnable(F.col("doc_id")), F.col("lang")).otherwise("xx")).withColumn("source", F.lit(None).cast("string"))
    a, b = li.fit(docs), li.fit(spoiled.repartition(7))
    assert a.languages == b.languages and np.array_equal(a.weights, b.weights) and a.gap == b.gap


def test_a_hot_language_doesnt_crowd_out_others(spark):
    words = {"aa": "bla blub bli", "zz": "wox wux wix"}
    rows = [(i, words["aa"], "aa") for i in range(900)] + [(1000 + i, words["zz"], "zz") for i in range(12)] + [(2000, None, "aa"), (2001, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = li.fit(docs, rows=40)
    out = {r["text"]: r for r in li.identify(docs, model).select("doc.text", "lang_pred", "score").collect()}
    assert out[words["aa"]]["lang_pred"] == "aa" and out[words["zz"]]["lang_pred"] == "zz" and out[None]["lang_pred"] == "und"


def test_mixed_text_is_ambiguous(spark):
    words = {"aa": "bla blub bli blo", "zz": "wox wux wix wex"}
    docs = spark.createDataFrame([(i, f"{words[k]} " * (1 + i % 5), k) for i in range(100) for k in words], "doc_id long, text string, lang string")
    mixed = spark.createDataFrame([(0, words["aa"]), (1, f"{words['aa']} {words['zz']}")], "id long, text string")
    out = {r["doc"]["id"]: r for r in li.identify(mixed, li.fit(docs)).collect()}
    assert not out[0]["ambiguous"] and out[1]["gap"] < 0.5 * out[0]["gap"]


def test_defined_cases(spark, odd_docs, no_docs):
    none = li.fit(no_docs)
    assert {r["lang_pred"] for r in li.identify(odd_docs, none).collect()} == {"und"} and li.identify(no_docs, none).count() == 0
    one = li.fit(odd_docs)
    assert one.languages == ["en"]
    out = li.identify(odd_docs, one).collect()
    assert len(out) == odd_docs.count() and "doc" in out[0]["doc"].asDict()
    for r in out:
        letters = any(c.isalpha() for c in r["doc"]["text"] or "")
        assert (r["lang_pred"], r["score"]) == (("en", 1.0) if letters else ("und", 0.0))
