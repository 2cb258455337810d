import math

import duckdb
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from test_operators import _components
from tokenizers import Tokenizer

import corpus_pipeline
from tabulark.llm import bytes_kernel as bk
from tabulark.llm import queries, toxicity_crf
from tabulark.llm.scratch import Scratch

SMALL = "/root/testdata/sf0.01"  # enough labelled rows for significant words


def _score(model: toxicity_crf.ToxicityModel, text: str) -> float:
    """A text's toxicity by forward and backward sums over both tags, word by word."""
    expected, surest = 0.0, 1e-7
    for line in (text or "").split("\n"):
        w = toxicity_crf.Words.of(*bk.utf8(toxicity_crf.pa.array([line])))
        own = w.features.T.tolist()
        if not own:
            continue
        crf, n = model.crf, len(own)
        odds = [float(crf.bias + sum(crf.own[f] for f in fs) + (crf.before[own[i - 1][0]] if i else 0) + (crf.after[own[i + 1][0]] if i + 1 < n else 0)) for i, fs in enumerate(own)]
        emit = [(1.0, math.exp(max(-30, min(30, o)))) for o in odds]
        move = np.exp(crf.moves)
        forward, back = [emit[0]], [(1.0, 1.0)]
        for i in range(1, n):
            f = [sum(forward[-1][a] * move[a, b] for a in (0, 1)) * emit[i][b] for b in (0, 1)]
            forward.append((f[0] / sum(f), f[1] / sum(f)))
        for i in range(n - 2, -1, -1):
            b = [sum(move[a, c] * emit[i + 1][c] * back[0][c] for c in (0, 1)) for a in (0, 1)]
            back.insert(0, (b[0] / sum(b), b[1] / sum(b)))
        for f, b in zip(forward, back):
            p = f[1] * b[1] / (f[0] * b[0] + f[1] * b[1])
            p = min(max(p, 1e-7), 1 - 1e-7)
            expected, surest = expected + p, max(surest, p)
    z = model.weights[0] * math.log(expected + 1e-3) + model.weights[1] * math.log(surest / (1 - surest)) + model.weights[2]
    return 1 / (1 + math.exp(-max(-30, min(30, z))))


def _sql(sql: str, docs) -> dict:
    c = duckdb.connect()
    documents, benchmark = docs.select("doc_id", "text").toPandas(), SMALL + "/benchmark.parquet"  # noqa: F841
    c.sql(f"CREATE VIEW benchmark AS SELECT * FROM '{benchmark}'")
    c.register("documents", documents)
    out = c.sql(sql)
    return {r[out.columns.index("doc_id")]: dict(zip(out.columns, r)) for r in out.fetchall()}


def test_stages_by_brute_force(spark):
    """Each stage on its own input: scores by plain sums, SQL, all pairs of texts, and the tokenizer itself."""
    scratch = Scratch(spark, "test")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(scratch.keep(stage(spark, kept[-1], SMALL), name))
        assert name == "packing" or kept[-1].columns == columns
    texts = [{r["doc_id"]: r["text"] for r in k.select("doc_id", "text").collect()} for k in kept[:5]]
    model = toxicity_crf.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    assert set(texts[1]) == {i for i, t in texts[0].items() if _score(model, t) < 0.7} and len(texts[1]) < len(texts[0])
    assert all(texts[1][i] == texts[0][i] for i in texts[1])
    lines = _sql(queries.OP7_SQL, kept[1])
    assert {i: t or "" for i, t in texts[2].items()} == {i: r["text"] for i, r in lines.items()}
    assert kept[2].join(kept[1].select("doc_id", F.col("text").alias("before")), "doc_id").filter("text <> before AND n_chars <> length(text)").isEmpty()
    classes = _components(texts[2], 0.8)
    assert texts[3] == {i: t for i, t in texts[2].items() if classes[i] == i}
    found = _sql(queries.OP8_SQL, kept[3])
    assert texts[4] == {i: t for i, t in texts[3].items() if not found[i]["contaminated"]} and len(texts[4]) < len(texts[3])
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sizes = {i: len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in texts[4].items()}
    pieces = [(r["doc_id"], r["start"], r["length"]) for r in kept[5].collect()]
    assert sorted(pieces) == sorted((i, a, min(4096, n - a)) for i, n in sizes.items() for a in range(0, n, 4096))


def test_rows_alike_nulls_and_no_rows(spark, tmp_path):
    """Null ids and texts, rows alike, ties, and an empty table go through all stages."""
    long = " ".join(f"word{i}" for i in range(60))
    rows = [(1, long), (1, long), (2, long), (3, None), (4, ""), (None, "a null id and some words of its own"), (None, None), (5, "x\ny\nz\nx\ny\nz")]
    for name, docs in (("some", rows), ("none", [])):
        where = f"file://{tmp_path}/{name}"
        spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{where}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
        spark.createDataFrame([(1, "some other words"), (None, None)], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
        got = sorted((r["doc_id"] or 0, r["piece"]) for r in corpus_pipeline.run(spark, where).collect())
        assert got == ([(0, 0), (0, 0), (1, 0), (3, 0), (4, 0), (5, 0)] if docs else [])
