"""Quality filter: fixed base rules, then an isolation forest over rule statistics.

The forest is grown on the documents labelled good of a bounded sample (FIT_ROWS of the labelled ones that a hash of
the id gives to the trees), as the common rows to isolate from; labels choose nothing else there.  Every document is counted and scored
from its whole text, in one narrow pass.  The cut on the anomaly score is calibrated on all other labelled documents that may be
learnt from, by a histogram of BINS bins of their scores; where these lack a class, on those of the sample too.

Defined cases: a null, empty or wordless text has zero counts and fails the base rules;
without labelled rows there is no forest and only the base rules decide; good labelled rows
alone cut above all scores seen in them, bad ones alone above all scores; ids labelled both ways aren't learnt from, and of an id's different texts one is, that of the least hash; repeated rows are judged each; other columns are carried in `doc`.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text_rules
from .arrow_rows import map_texts, quoted
from .scratch import Scratch

FIT_ROWS = 6_000
TREES = 200
SUBSAMPLE = 512
BINS = 10_000
#: A junk document kept costs one, a good one lost costs so many.
LOSS_OF_GOOD = 20.0
MIN_WORDS = 20
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def statistics(c: dict[str, np.ndarray]) -> np.ndarray:
    """Rule statistics of each document, a row each; ratios don't depend on the length."""
    words, lines = np.maximum(c["n_words"], 1), np.maximum(c["n_lines"], 1)
    return np.column_stack(
        [
            c["n_symbols"] / words,
            c["n_marks"] / words,
            c["n_upper"] / words,
            c["n_digits"] / words,
            c["n_dup_lines"] / lines,
            c["n_repeat_words"] / words,
            c["n_echoes"] / words,
            c["word_chars"] / words,
            np.log(np.maximum(c["n_distinct_words"], 1)) / np.log(np.maximum(words, 2)),
        ]
    ).astype(np.float64)


def base_failed(n_words: np.ndarray, n_repeat_words: np.ndarray) -> np.ndarray:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > 30 * n_words)


def _mean_path(n: float) -> float:
    """Mean path length of an unsuccessful search among n points."""
    return 0.0 if n < 2 else 2.0 * (np.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n if n > 2 else 1.0


@dataclass
class IsolationForest:
    """Random splits as arrays: node i of tree t goes to children[t, i] and the one after it."""

    feature: np.ndarray
    split: np.ndarray
    child: np.ndarray
    path: np.ndarray
    depth: int
    scale: float

    @classmethod
    def grow(cls, rows: np.ndarray, around: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = 7) -> IsolationForest:
        """Trees over `rows`, the common ones.

        A split is drawn from a node's range widened by the spread of `around` (all rows
        that may be met), inside the box of their values.  So what lies beyond the common
        rows falls into empty leaves near the root, even where those are all alike.
        """
        pad, bottom, top = around.std(0), around.min(0), around.max(0)
        rng = np.random.default_rng(seed)
        size = min(subsample, len(rows))
        depth = max(1, int(np.ceil(np.log2(max(size, 2)))))
        most = 8 * size
        shape = (trees, most)
        feature, split, child, path = np.zeros(shape, np.int32), np.full(shape, np.inf), np.zeros(shape, np.int32), np.zeros(shape)
        for t in range(trees):
            todo, used = [(0, rows[rng.choice(len(rows), size, replace=False)], 0, bottom, top)], 1
            while todo:
                node, part, level, floor, ceiling = todo.pop()
                if len(part) > 1 and used + 2 <= most:
                    low, high = np.maximum(floor, part.min(0) - pad), np.minimum(ceiling, part.max(0) + pad)
                    varied = np.flatnonzero(high > low)
                else:
                    varied = []
                if level >= depth or not len(varied):
                    child[t, node], path[t, node] = node, level + _mean_path(len(part))
                    continue
                f = int(rng.choice(varied))
                at = rng.uniform(low[f], high[f])
                right = part[:, f] > at
                feature[t, node], split[t, node], child[t, node] = f, at, used
                below, above = ceiling.copy(), floor.copy()
                below[f] = above[f] = at
                todo += [(used, part[~right], level + 1, floor, below), (used + 1, part[right], level + 1, above, ceiling)]
                used += 2
        return cls(feature, split, child, path, depth, max(_mean_path(size), 1e-9))

    def score(self, rows: np.ndarray) -> np.ndarray:
        """2 ** -(mean path / expected path): near 1 for anomalies, under 0.5 for the common."""
        total, each = np.zeros(len(rows)), np.arange(len(rows))
        for feature, split, child, path in zip(self.feature, self.split, self.child, self.path):
            node = np.zeros(len(rows), np.int32)
            for _ in range(self.depth):
                node = child[node] + (rows[each, feature[node]] > split[node])  # a leaf is its own child
            total += path[node]
        return 2.0 ** -(total / len(self.feature) / self.scale)


def calibrated(bins: list[tuple[int, int, int]], loss: float = LOSS_OF_GOOD) -> float:
    """The cut between bins that loses least; bins: (bin of BINS, 1 for good or 0, rows).  Equal losses: the highest cut.

    With good rows alone it is above all of them, with none it is 1.
    """
    good = sum(n for _, label, n in bins if label)
    if good == sum(n for *_, n in bins) or not good:
        return (max(b for b, *_ in bins) + 1) / BINS if good else 1.0
    by_bin: dict[int, list[int]] = {}
    for b, label, n in bins:
        by_bin.setdefault(b, [0, 0])[label] += n
    # Cutting below the first bin loses all good rows; each bin that is kept saves its good ones and keeps its bad ones.
    cost, best = loss * good, (loss * good, 0.0)
    edges = sorted(by_bin)
    for b, after in zip(edges, [*edges[1:], None]):
        cost += by_bin[b][0] - loss * by_bin[b][1]
        cut = b + 1 if after is None else (b + 1 + after) / 2
        if cost <= best[0]:
            best = (cost, cut / BINS)
    return best[1]


def training_rows(key: Column) -> Column:
    """Rows that may be learnt from: crc32 of the id as text (a null: empty), modulo 3, is not 1."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 3 != 1


def known_labels(labels: DataFrame, key: str, label: str) -> DataFrame:
    """(id, label) of ids that may be learnt from, each once; ids labelled both ways are left out."""
    ids = labels.select(F.col(quoted(key)).alias("id"), F.col(quoted(label)).cast("int").alias("label"))
    known = ids.filter(F.col("id").isNotNull() & F.col("label").isin(0, 1) & training_rows(F.col("id")))
    return known.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("most")).filter("label = most").drop("most")


def labelled(docs: DataFrame, ids: DataFrame, key: str, text: str, rows: int, per_class: bool = False) -> DataFrame:
    """(id, label, text) of the documents of at most `rows` known labels, chosen by a hash of the id; of an id's texts that of the least hash."""
    order = [F.xxhash64(F.col("id").cast("string")), "id"]
    chosen = [ids.filter(F.col("label") == v).orderBy(*order).limit(rows // 2) for v in (0, 1)] if per_class else [ids.orderBy(*order).limit(rows)]
    few = chosen[0] if len(chosen) == 1 else chosen[0].unionAll(chosen[1])
    texts = docs.select(F.col(quoted(key)).alias("id"), F.col(quoted(text)).cast("string").alias("text"))
    return texts.join(F.broadcast(few), "id").groupBy("id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # few has at most `rows` ids


def filter_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", carry: Sequence[str] | None = None, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc, the BASE counts, base_failed, anomaly, kept)."""
    names = list(text_rules.COUNTS)
    ids = known_labels(labels, key, label)
    for_trees = F.pmod(F.xxhash64(F.lit(11), F.col("id").cast("string")), F.lit(2)) == 0

    def count(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        return list(text_rules.rule_counts(data, offsets).values())

    sample = map_texts(labelled(docs, ids.filter(for_trees), key, text, fit_rows), "text", ["id", "label"], ", ".join(f"{n} long" for n in names), count)
    known = sample.select("doc.id", "doc.label", *names).toPandas().sort_values("id", kind="stable")  # at most fit_rows rows
    counts = {n: known[n].to_numpy() for n in names}
    passed = ~base_failed(counts["n_words"], counts["n_repeat_words"])
    rows, good = statistics(counts)[passed], known["label"].to_numpy()[passed] == 1
    forest = IsolationForest.grow(rows[good] if good.any() else rows, rows) if len(rows) else None

    def judge(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        c = text_rules.rule_counts(data, offsets)
        failed = base_failed(c["n_words"], c["n_repeat_words"])
        return [*[c[n] for n in BASE], failed, forest.score(statistics(c)) if forest else np.zeros(len(failed))]

    carry = list(docs.columns if carry is None else carry)
    keyed = docs.select(F.struct(*[F.col(quoted(c)) for c in carry]).alias("doc"), F.col(quoted(key)).alias("id"), F.col(quoted(text)).alias("text"))
    fields = ", ".join(f"{n} long" for n in BASE) + ", base_failed boolean, anomaly double"
    judged = Scratch(docs.sparkSession, "quality").keep(map_texts(keyed, "text", ["doc", "id"], fields, judge), "judged")
    scored = judged.filter("NOT base_failed").select(F.col("doc.id").alias("id"), F.least(F.floor(F.col("anomaly") * BINS), F.lit(BINS - 1)).cast("int").alias("bin"))

    def histogram(ids: DataFrame) -> list[tuple[int, int, int]]:
        return [tuple(r) for r in scored.join(ids.hint("merge"), "id").groupBy("bin", "label").agg(F.count("*").alias("n")).collect()]  # at most BINS of two labels

    bins = histogram(ids.filter(~for_trees))
    if len({label for _, label, _ in bins}) < 2:
        bins = histogram(ids)
    cut = calibrated(bins) if forest else 1.0
    return judged.select("doc.doc", *BASE, "base_failed", "anomaly", (~F.col("base_failed") & (F.col("anomaly") < cut)).alias("kept"))
