import pyarrow as pa
from pyspark.sql import functions as F

from tabulark.llm import line_dedup
from tabulark.llm.arrow_rows import BATCH_BYTES, carried


def test_batches_to_python_are_bounded_in_bytes(spark):
    """Long texts, twice in each row: a batch has few of them, and none is lost."""
    rows = spark.range(400, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("long text "), 10_000).alias("text"))
    sizes = carried(rows, "text", None).mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [len(b)], "size": [b.nbytes]}) for b in batches), "n long, size long").collect()
    assert sum(r["n"] for r in sizes) == 400 and max(r["size"] for r in sizes) <= 2 * BATCH_BYTES


def test_line_dedup_carries_texts_that_lose_nothing(spark):
    """Nulls, texts of lines without a word and odd line ends stay to the byte; n_lines counts them too."""
    same = "a\nb\nc\n"
    rows = spark.createDataFrame([(1, same), (2, "\n" + same + " \n\n"), (3, None), (4, "\n \n\t\r\n"), (5, "x\r\ny\n\n"), (None, "p\nq\n\nr"), (9, "p\nq\nr\ns")], "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in line_dedup.dedup_lines(rows).select("doc.doc_id", "text", "n_lines", "n_removed").collect()}
    assert got == {1: (same, 3, 0), 2: ("\n \n\n", 3, 3), 3: (None, 0, 0), 4: ("\n \n\t\r\n", 0, 0), 5: ("x\r\ny\n\n", 2, 0), None: ("p\nq\n\nr", 3, 0), 9: ("s", 4, 3)}
