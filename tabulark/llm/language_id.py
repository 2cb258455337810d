"""Language identification by error-correcting output codes.

Every language has a codeword; each bit has a binary classifier, a logistic regression over hashed character n-grams of one to
three letters.  Decoding is loss-weighted: a language's distance is the sum over the bits of a loss of the classifier's margin, weighted by how often
that classifier is right on that language; the nearest codeword wins.  A prediction whose two nearest codewords
are closer to each other than a calibrated gap is flagged as ambiguous.

Classifiers are fitted on a sample of FIT_ROWS labelled rows at most, dealt evenly among languages and chosen by a hash of id and text;
a quarter of them gives weights, temperature and gap.  Every document is predicted from its whole text in one narrow pass.

Defined cases: a null text, or one without a letter, is `und` with score 0; with no labelled row so is every text; with one
language all other texts are in it, with score 1; of equally near codewords the first language by name wins; a null id may be learnt from; rows
alike are predicted alike; other columns are carried in `doc`.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bytes_kernel as bk
from .arrow_rows import map_texts, quoted

UNKNOWN = "und"
FIT_ROWS = 4_000
BUCKETS = 4_096
SIZES = (1, 2, 3)
#: Up to so many languages have a bit for every way to split them in two.
EXHAUSTIVE = 5
STEPS = 150
RIDGE = 1e-4
#: A wrong prediction that isn't flagged costs so many times what a right one that is flagged costs.
COST_OF_WRONG = 10.0
LEAST_GAP = 0.02
TEMPERATURES = np.geomspace(0.25, 64, 33)

_GAP, _LETTER, _INNER = 0, 1, 2


@lru_cache(maxsize=1)
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: is it a letter, a mark inside words or neither; and its lower case if that is one code point."""
    kind, lower = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint32)
    for c in range(0x33480):  # all letters and marks that are assigned
        category = unicodedata.category(chr(c))[0]
        if category in "LM":
            kind[c] = _LETTER if category == "L" else _INNER
            small = chr(c).lower()
            lower[c] = ord(small) if len(small) == 1 else c
    return kind, lower


def _code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all documents and their offsets; bytes that aren't UTF-8 count as the replacement character."""
    try:
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        before = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        return points, before[offsets]
    except UnicodeDecodeError:
        texts = [data[a:b].tobytes().decode(errors="replace") for a, b in zip(offsets[:-1], offsets[1:])]
        return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), np.concatenate(([0], np.cumsum([len(t) for t in texts])))


class Grams:
    """Buckets of all n-grams of some documents, by size; a gram may begin or end with a gap between words, not hold one."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS):
        kind, lower = _characters()
        points, offsets = _code_points(data, offsets)
        kinds = kind[points]
        n = len(offsets) - 1
        doc = np.repeat(np.arange(n), np.diff(offsets))
        self.has_letter = np.bincount(doc[kinds == _LETTER], minlength=n) > 0
        c = np.where(kinds == _GAP, np.uint64(0), lower[points].astype(np.uint64))
        # Each run of gaps counts once, and each document has one before its first word and after its last.
        first = np.zeros(len(c), bool)
        first[offsets[:-1][np.diff(offsets) > 0]] = True
        keep = (c != 0) | first | np.concatenate(([0], c[:-1])).astype(bool)
        c, doc = c[keep], doc[keep]
        at = np.searchsorted(doc, np.arange(n + 1))
        c, doc = np.insert(c, np.repeat(at, 2)[1:-1], 0), np.insert(doc, np.repeat(at, 2)[1:-1], np.repeat(np.arange(n), 2)) if n else doc
        self.n, self.parts = n, []
        for size in SIZES:
            m = max(len(c) - size + 1, 0)
            h, ok = np.full(m, size, np.uint64), doc[:m] == doc[size - 1 :][:m]
            for i in range(size):
                own = c[i : m + i]
                h = h * np.uint64(0x9E3779B97F4A7C15) + own
                ok &= (own != 0) | ((i in (0, size - 1)) and size > 1)
            ok &= (c[:m] != 0) | (c[size - 1 :][:m] != 0) if size == 2 else True
            self.parts.append(((bk.mix(h[ok]) % np.uint64(buckets)).astype(np.int32), doc[:m][ok]))
        self.total = sum(np.bincount(d, minlength=n) for _, d in self.parts)

    def counts(self, buckets: int = BUCKETS) -> np.ndarray:
        """How often a document has each bucket, a row each; for samples."""
        out = np.zeros((self.n, buckets), np.float32)
        for b, d in self.parts:
            np.add.at(out, (d, b), np.float32(1))
        return out

    def summed(self, weights: np.ndarray) -> np.ndarray:
        """Sums over a document's grams, a row each, for each row of weights."""
        out = np.zeros((self.n, len(weights)))
        for i, w in enumerate(weights):
            out[:, i] = sum(np.bincount(d, w[b], minlength=self.n) for b, d in self.parts)
        return out


def _pieces(data: np.ndarray, offsets: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The documents as they are, or the pieces of a single long one, cut at spaces where it has some: no gram is lost there."""
    if len(offsets) != 2 or len(data) <= 2 * most:
        yield data, offsets
        return
    at = 0
    while at < len(data):
        to = min(at + most, len(data))
        ahead = data[to : to + most]
        spaces, starts = np.flatnonzero(ahead == 0x20), np.flatnonzero((ahead & 0xC0) != 0x80)
        to = len(data) if not len(starts) else to + int(spaces[0] if len(spaces) else starts[0])
        yield data[at:to], np.array([0, to - at])
        at = to


def gram_means(data: np.ndarray, offsets: np.ndarray, of: Callable[[Grams], np.ndarray], most: int = bk.CHUNK_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """(sums that `of` makes of the grams of each document over their number, has a letter)."""
    sums, total, letter = 0, 0, False
    for piece in _pieces(data, offsets, most):
        grams = Grams(*piece)
        sums, total, letter = sums + of(grams), total + grams.total, letter | grams.has_letter
    return sums / np.maximum(total, 1)[:, None], letter


def codewords(languages: int, seed: int = 17) -> np.ndarray:
    """A row of -1 and 1 for each language.

    Few languages get all 2 ** (n - 1) - 1 splits in two; more get about 10 * log2(n) random ones, of the set whose nearest
    two rows are farthest apart among a hundred sets.
    """
    if languages < 2:
        return np.ones((languages, 0), np.int8)
    if languages <= EXHAUSTIVE:
        splits = np.arange(1, 2 ** (languages - 1))
        return np.array([np.where(splits >> max(i - 1, 0) & (i > 0), -1, 1) for i in range(languages)], np.int8)
    bits, rng, best, apart = int(np.ceil(10 * np.log2(languages))), np.random.default_rng(seed), None, -1
    for _ in range(100):
        code = rng.choice(np.array([-1, 1], np.int8), (languages, bits))
        code[0, np.abs(code.sum(0, dtype=np.int64)) == languages] *= -1  # a bit that doesn't split says nothing
        agree = code.astype(np.int32) @ code.T.astype(np.int32)
        nearest = (bits - (agree - 2 * bits * np.eye(languages, dtype=np.int32)).max()) // 2
        if nearest > apart:
            best, apart = code, nearest
    return best


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = STEPS, ridge: float = RIDGE) -> tuple[np.ndarray, np.ndarray]:
    """Weights and intercepts of a classifier for each column of y (-1 or 1), by accelerated gradient steps; weight: of each row, of sum 1."""
    w, b = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    rate = np.float32(1 / (0.25 * (weight * ((x**2).sum(1) + 1)).sum() + ridge))
    v, u, t = w.copy(), b.copy(), 1.0
    for _ in range(steps):
        pull = (-y * weight[:, None] / (1 + np.exp(np.clip(y * (x @ v + u), -50, 50)))).astype(np.float32)
        new_w, new_b = v - rate * (x.T @ pull + np.float32(ridge) * v), u - rate * pull.sum(0)
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        push = np.float32((t - 1) / after)
        v, u, t = new_w + push * (new_w - w), new_b + push * (new_b - b), after
        w, b = new_w, new_b
    return w, b


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # a row for each bit
    intercepts: np.ndarray
    trust: np.ndarray  # of each language in each bit, rows of sum 1
    temperature: float = 1.0
    gap: float = LEAST_GAP

    def distances(self, margins: np.ndarray) -> np.ndarray:
        """Weighted logistic losses of the margins, by document and language."""
        return np.column_stack([np.logaddexp(0, -margins * c) @ t for c, t in zip(self.code, self.trust)])

    def decoded(self, distances: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Nearest language, second nearest (itself if alone), score, relative gap between the two."""
        every = np.arange(len(distances))
        order = np.argsort(distances, 1, kind="stable")
        best, second = order[:, 0], order[:, min(1, distances.shape[1] - 1)]
        near, next_ = distances[every, best], distances[every, second]
        odds = np.exp(-self.temperature * (distances - near[:, None]))
        gap = (next_ - near) / np.maximum(next_, 1e-12) if distances.shape[1] > 1 else np.ones(len(distances))
        return best, second, 1 / odds.sum(1), gap


def fit_model(languages: list[str], label: np.ndarray, shares: np.ndarray, check: np.ndarray) -> LanguageModel:
    """label: index of each row's language; check: rows that calibrate, if every language has others."""
    code = codewords(len(languages))
    bits = code.shape[1]
    model = LanguageModel(languages, code, np.zeros((bits, shares.shape[1])), np.zeros(bits), np.full(code.shape, 1 / max(bits, 1)))
    if not bits:
        return model
    left = np.bincount(label[~check], minlength=len(languages))
    train = ~check | (left == 0)[label]
    # Frequent grams would else rule the steps.
    scale = 1 / np.sqrt(shares[train].mean(0) + 1e-5)
    x = shares * scale.astype(np.float32)
    share = 1 / np.bincount(label[train], minlength=len(languages)).astype(np.float64)[label[train]]
    w, b = logistic(x[train], code[label[train]].astype(np.float32), (share / share.sum()).astype(np.float32))
    model.weights, model.intercepts = np.ascontiguousarray((w.astype(np.float64) * scale[:, None]).T), b.astype(np.float64)
    margins = shares @ model.weights.T + model.intercepts
    held = check if check.any() else train
    right = (margins[held] * code[label[held]] > 0).astype(np.float64)
    per = np.bincount(label[held], minlength=len(languages))
    hits = np.column_stack([np.bincount(label[held], r, minlength=len(languages)) for r in right.T])
    trust = (hits + 1) / (per + 2)[:, None]
    model.trust = trust / trust.sum(1, keepdims=True)
    distances, truth = model.distances(margins[held]), label[held]
    every = np.arange(len(truth))
    losses = [np.mean(np.log(np.exp(-t * (distances - distances[every, truth][:, None])).sum(1))) for t in TEMPERATURES]
    model.temperature = float(TEMPERATURES[int(np.argmin(losses))])
    best, _, _, gap = model.decoded(distances)
    model.gap = calibrated_gap(gap, best == truth)
    return model


def calibrated_gap(gap: np.ndarray, right: np.ndarray) -> float:
    """The gap under which flagging costs least in all, LEAST_GAP or more; equal costs: the least."""
    order = np.argsort(gap, kind="stable")
    cost = np.concatenate(([0], np.cumsum(np.where(right[order], 1.0, -COST_OF_WRONG))))
    k = int(np.argmin(cost))
    return max(LEAST_GAP, 0.0 if not k else float(gap[order[k - 1]]) + 1e-12 if k == len(gap) else float(gap[order[k - 1]] + gap[order[k]]) / 2)


def learnable(key: Column) -> Column:
    """Rows that may be learnt from: crc32 of the id as text (a null: empty), modulo 4, is not 2."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 4 != 2


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = FIT_ROWS) -> LanguageModel:
    known = docs.select(F.col(quoted(key)).cast("string").alias("id"), F.col(quoted(text)).cast("string").alias("text"), F.col(quoted(lang)).cast("string").alias("lang"))
    known = known.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & learnable(F.col("id")))
    counts = known.groupBy("lang").count().orderBy("lang").collect()  # a row for each language
    languages = [r["lang"] for r in counts]
    if len(languages) < 2:
        return LanguageModel(languages, codewords(len(languages)), np.zeros((0, BUCKETS)), np.zeros(0), np.zeros((len(languages), 0)))
    each = max(rows // len(languages), 1)
    # About twice as many as needed by a hash, then the first ones of each language by that hash.
    order = F.xxhash64(F.lit(23), "id", "text")
    share = F.element_at(F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, (2 * each + 100) / r["count"])))]), F.col("lang"))
    few = known.withColumn("h", order).filter(F.shiftrightunsigned("h", 11) < share * F.lit(float(1 << 53)))
    first = Window.partitionBy("lang").orderBy("h", "id", "text")
    few = few.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= each)

    def shares(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        found, _ = gram_means(data, offsets, Grams.counts)
        return [pa.array([r.tobytes() for r in found.astype(np.float32)], pa.binary())]

    sample = map_texts(few, "text", ["lang", "h"], "shares binary", shares).select("doc.lang", "doc.h", "shares").toPandas()  # at most `rows` rows
    sample = sample.sort_values(["lang", "h"], kind="stable")
    x = np.frombuffer(b"".join(sample["shares"]), np.float32).reshape(len(sample), BUCKETS)
    return fit_model(languages, np.searchsorted(languages, sample["lang"].to_numpy(str)), x, sample["h"].to_numpy() % 4 == 0)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", carry: Sequence[str] | None = None) -> DataFrame:
    """(doc, lang_pred, score, second, gap, ambiguous); the last three are null where nothing is predicted."""
    names = np.array([*model.languages, UNKNOWN], object)

    def predict(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        means, letter = gram_means(data, offsets, lambda grams: grams.summed(model.weights))
        known = letter & bool(model.languages)
        if not model.languages:
            best = second = np.full(len(letter), -1)
            score = gap = np.zeros(len(letter))
        else:
            best, second, score, gap = model.decoded(model.distances(means + model.intercepts))
        return [
            pa.array(names[np.where(known, best, -1)], pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(names[second], pa.string(), mask=~known),
            pa.array(gap, mask=~known), pa.array(gap < model.gap, mask=~known),
        ]

    return map_texts(docs, text, carry, "lang_pred string, score double, second string, gap double, ambiguous boolean", predict)
