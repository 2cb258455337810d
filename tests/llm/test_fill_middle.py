import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from tabulark.llm import fill_middle as fm
from tabulark.llm import queries

TEXTS = ["", "a", "<P>", "<<P>x", "<PP>", "é<S>", "😀ab😀", "abc def", "a" * 1200, "é" * 1200, "<" * 515 + "M>", "x" * 511 + "<S>", "x" * 510 + "<S>", "x" * 509 + "<M>", "<S", "P>", "\u0000<M >\n"]


def units(text):
    return re.findall(r"[A-Za-z]+|[^A-Za-z]", text)


def random_texts(n, seed=1):
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(list("abPSM<>é😀 \n"), rng.integers(0, 1500))) for _ in range(n)]


def test_both_passes_by_brute_force():
    texts = TEXTS + random_texts(100)
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    for block in (1, 2, 7, fm.BLOCK):
        scan = fm.Scanned(data, offsets, block)
        assert scan.n_units.tolist() == [len(units(t)) for t in texts] and scan.n_points.tolist() == [len(t) for t in texts]
        assert scan.has_sentinel.tolist() == [any(s in t for s in ("<P>", "<S>", "<M>")) for t in texts]
        for share in (0, 0.3, 0.7, 1):
            u = np.floor(scan.n_units * share).astype(int)
            place, points = scan.cut(np.arange(len(texts)), u)
            head = ["".join(units(t)[:k]) for t, k in zip(texts, u)]
            assert (place - offsets[:-1]).tolist() == [len(h.encode()) for h in head] and points.tolist() == [len(h) for h in head]


def brute(doc_id, text):
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    text = text or ""
    u = units(text)
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return len(u), "plain", None, None, text
    return (len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_outputs_by_brute_force_and_round_trip(spark, docs, odd_docs):
    made = spark.createDataFrame(list(enumerate(TEXTS + random_texts(200, 2), 100_000)), "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(odd_docs.select("doc_id", "text")).unionByName(made)
    out = fm.fill_middle(both).withColumn("back", fm.restored(F.col("output"), F.col("form"))).collect()
    assert len(out) == both.count() and {r["form"] for r in out} == {"plain", "psm", "spm"}
    for r in out:
        d = r["doc"]
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == brute(d["doc_id"], d["text"])
        assert r["back"] == (d["text"] or "")


def test_defined_cases(spark, odd_docs, no_docs):
    assert fm.fill_middle(no_docs).count() == 0
    out = fm.fill_middle(odd_docs)
    assert out.select("doc.*").columns == odd_docs.columns and out.count() == odd_docs.count()
    (a,), (b,) = (fm.fill_middle(odd_docs.filter("doc_id IS NULL"), seed=s).select("output").distinct().collect() for s in ("1", "2"))
    assert a["output"].count("null") == b["output"].count("null") == 9


def test_a_text_longer_than_a_chunk(spark, monkeypatch):
    text = "Wörter und <Zeichen> " * 60_000
    doc = spark.createDataFrame([(4, text), (5, "x"), (6, text)], "doc_id long, text string")
    for r in fm.fill_middle(doc.repartition(1)).collect():
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == brute(r["doc"]["doc_id"], r["doc"]["text"])


def test_query_has_the_contract_columns(spark):
    from support import SMALL

    assert queries.op12_fill_middle(spark, SMALL).columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
