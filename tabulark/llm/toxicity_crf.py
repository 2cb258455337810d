"""Toxicity: a linear-chain conditional random field tags toxic words; marginals make document scores.

Labels are of documents, so words of the fitting sample are labelled first: a word is
toxic where its document is labelled toxic and the word is significantly bound to toxic
documents of the sample.  The field (two tags, features of the word, its ends and its
neighbours) is fitted to those tagged lines; lines are its sequences.  Forward-backward
gives each word's marginal; a logistic fit on the sample turns a document's marginals
into its score, and runs of words over one half become its offending byte ranges.

Fitting uses at most FIT_ROWS labelled documents of FIT_BYTES in all, half of each label, chosen by a hash of the id, none of them
held out; a document that would not fit in any more is passed over.  Their whole texts are read by the driver twice, a chunk at a time; what stays of them is 21 bytes
a word.  A word is bound to toxic documents if its counts in distinct sample texts are significant among all words
(Chernoff bound, Benjamini-Hochberg).  Scores depend on the text alone.  Scoring is one narrow pass over whole texts.

Defined cases: null, empty and wordless texts get the score of a text without toxic
words; without labelled rows of both classes every score is 0; ids labelled both ways aren't learnt from, and of an id's
different texts one is, that of the least hash; repeated rows are scored each; other columns are carried in `doc`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytes_kernel as bk
from .arrow_rows import map_texts
from .quality_forest import known_labels, labelled
from .scratch import Scratch

FIT_ROWS, FIT_BYTES = 3_000, 64 << 20
CUT = 0.7
BUCKETS = 1 << 18
EPOCHS = 30
#: A toxic word: in so many toxic texts of the sample at least, so much likelier there, and such a share of false finds expected.
LEAST_DOCS, LEAST_RATIO, FALSE_FINDS = 3, 8.0, 0.01
#: Long lines are worked on in segments of so many words at once.
SEGMENT = 128
_ENDS = 3  # bytes of a word's start and end that are features


@dataclass
class Words:
    """Words of some documents with hashed features, in lines."""

    doc: np.ndarray
    line: np.ndarray
    features: np.ndarray  # buckets: word, start, end
    hashes: np.ndarray
    start: np.ndarray
    end: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray, offsets: np.ndarray) -> Words:
        starts, ends, doc = bk.runs(data, offsets, bk.PLAIN_WORD)
        sums = bk.Prefix(data, fold=True)
        word = sums.hash(starts, ends)
        breaks = np.concatenate(([0], np.cumsum(data == 10)))
        line = breaks[starts] + doc
        mask = np.uint64(BUCKETS - 1)
        head = sums.hash(starts, np.minimum(starts + _ENDS, ends)) ^ np.uint64(0x1B873593)
        tail = sums.hash(np.maximum(ends - _ENDS, starts), ends) ^ np.uint64(0xCC9E2D51)
        features = np.stack([word & mask, bk.mix(head) & mask, bk.mix(tail) & mask]).astype(np.int32)
        return cls(doc, line, features, word, starts, ends)


class Lines:
    """Lines in segments of up to SEGMENT words, sorted by length, so that step t of all segments that long is one slice.

    `chain` has, for a place in their line over 0, the segments there and those before them; `joined` are all these
    segments, in order, and `joined_alive` how many of them have more than t words.
    """

    def __init__(self, line: np.ndarray):
        n = len(line)
        first = np.flatnonzero(np.concatenate((np.ones(min(1, n), bool), line[1:] != line[:-1])))
        long = np.diff(np.concatenate((first, [n])))
        parts = -(-long // SEGMENT)
        place = bk.ragged(np.zeros(len(first), np.int64), parts)
        start = np.repeat(first, parts) + place * SEGMENT
        length = np.diff(np.concatenate((start, [n])))
        order = np.argsort(-length, kind="stable")
        self.first, self.length, self.last = start[order], length[order], (start + length - 1)[order]
        self.steps = int(self.length[0]) if n else 0
        # How many segments have more than t words.
        self.alive = len(start) - np.cumsum(np.bincount(self.length, minlength=self.steps + 1))[: self.steps]
        rank = np.empty(len(start), np.int64)
        rank[order] = np.arange(len(start))
        self.opens = place[order] == 0
        self.chain = [(rank[at], rank[at - 1]) for k in range(1, int(parts.max(initial=0))) if len(at := np.flatnonzero(place == k))]
        in_chain = np.zeros(len(start), bool)
        for own, before in self.chain:
            in_chain[own] = in_chain[before] = True
        self.joined = np.flatnonzero(in_chain)
        self.joined_alive = len(self.joined) - np.cumsum(np.bincount(self.length[self.joined], minlength=self.steps + 1))[: self.steps]
        self.same = np.flatnonzero(line[1:] == line[:-1])


def shifted(values: np.ndarray, line: np.ndarray, by: int) -> np.ndarray:
    """The value of the word before (by=1) or after (by=-1) in the line, 0 at its ends."""
    out = np.zeros_like(values)
    if len(values) > 1:
        same = line[1:] == line[:-1]
        if by == 1:
            out[1:] = np.where(same, values[:-1], 0)
        else:
            out[:-1] = np.where(same, values[1:], 0)
    return out


def _back(e: np.ndarray, back: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The share of later weight on tag 1 at a word, from the next word's emission and share."""
    later_one, later_zero = e * back, 1 - back
    one, zero = m[1, 1] * later_one + m[1, 0] * later_zero, m[0, 1] * later_one + m[0, 0] * later_zero
    return one / (one + zero)


@dataclass
class LinearChainCrf:
    """Two tags: own, before and after are weights of a word's buckets; the rest are tag weights."""

    own: np.ndarray
    before: np.ndarray
    after: np.ndarray
    bias: float
    moves: np.ndarray  # log weights of tag to tag

    @classmethod
    def empty(cls) -> LinearChainCrf:
        return cls(np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, np.float32), -4.0, np.zeros((2, 2)))

    def emissions(self, w: Words) -> np.ndarray:
        """Log odds of the toxic tag by each word's features and those of its neighbours."""
        own = self.own[w.features[0]] + self.own[w.features[1]] + self.own[w.features[2]]
        return self.bias + own + shifted(self.before[w.features[0]], w.line, 1) + shifted(self.after[w.features[0]], w.line, -1)

    def marginals(self, odds: np.ndarray, lines: Lines, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """P(toxic) of each word; with pairs, expected moves between tags too."""
        e = np.exp(np.clip(odds, -30, 30))
        m = np.exp(self.moves)
        n, k = len(e), len(lines.first)
        forward, back = np.zeros(n), np.zeros(n)  # P(tag 1 | words so far); share of the later words' weight on tag 1
        enters, leaves = np.zeros(k), np.full(k, 0.5)  # the same just before a segment and at its last word
        if lines.chain:
            self._between(e, m, lines, enters, leaves)
        state = enters
        for t in range(lines.steps):
            at = lines.first[: lines.alive[t]] + t
            state = state[: len(at)]
            one, zero = (state * m[1, 1] + (1 - state) * m[0, 1]) * e[at], state * m[1, 0] + (1 - state) * m[0, 0]
            if not t:
                one, zero = np.where(lines.opens, e[at], one), np.where(lines.opens, 1.0, zero)
            state = one / (one + zero)
            forward[at] = state
        back[lines.last] = leaves
        for t in range(lines.steps - 2, -1, -1):
            at = lines.first[: lines.alive[t + 1]] + t
            back[at] = _back(e[at + 1], back[at + 1], m)
        expected = None
        if pairs:
            at = lines.same
            f, later_one, later_zero = forward[at], e[at + 1] * back[at + 1], 1 - back[at + 1]
            joint = np.stack([(1 - f) * m[0, 0] * later_zero, (1 - f) * m[0, 1] * later_one, f * m[1, 0] * later_zero, f * m[1, 1] * later_one])
            expected = (joint / joint.sum(0)).sum(1).reshape(2, 2)
        one = forward * back
        return one / (one + (1 - forward) * (1 - back)), expected

    @staticmethod
    def _between(e: np.ndarray, m: np.ndarray, lines: Lines, enters: np.ndarray, leaves: np.ndarray) -> None:
        """Fills the states between segments of long lines, by the products of each segment's matrices.

        Matrices are four arrays, from and to tag 0 or 1: ahead from the tag before a segment to that of its last word,
        behind from its last word to the first, whose emission is counted.
        """
        (m00, m01), (m10, m11) = m
        own, opens = lines.joined, lines.opens[lines.joined]
        first, last = lines.first[own], lines.last[own]
        ahead = np.zeros((4, len(own)))
        ahead[0] = ahead[3] = 1
        behind = ahead.copy()
        for t in range(lines.steps):
            k = lines.joined_alive[t]
            if not k:
                break
            a, b, c, d = ahead[:, :k]
            x = e[first[:k] + t]
            if t:
                new = (a * m00 + b * m10, (a * m01 + b * m11) * x, c * m00 + d * m10, (c * m01 + d * m11) * x)
            else:  # a line's first word follows no tag
                zero, one = np.where(opens[:k], 1.0, m00), np.where(opens[:k], 1.0, m01) * x
                new = (zero, one, np.where(opens[:k], 1.0, m10), np.where(opens[:k], 1.0, m11) * x)
            most = np.maximum(np.maximum(new[0], new[1]), np.maximum(new[2], new[3]))
            for i in range(4):
                np.divide(new[i], most, out=ahead[i, :k])
            a, b, c, d = behind[:, :k]
            x = e[last[:k] - t]  # the t-th word before the last
            if t:
                new = (m00 * a + m01 * c, m00 * b + m01 * d, (m10 * a + m11 * c) * x, (m10 * b + m11 * d) * x)
            else:
                new = (a, b, c * x, d * x)
            most = np.maximum(np.maximum(new[0], new[1]), np.maximum(new[2], new[3]))
            for i in range(4):
                np.divide(new[i], most, out=behind[i, :k])
        place = np.zeros(len(lines.first), np.int64)
        place[own] = np.arange(len(own))
        for here, before in lines.chain:
            a, b, c, d = ahead[:, place[before]]
            zero, one = (1 - enters[before]) * a + enters[before] * c, (1 - enters[before]) * b + enters[before] * d
            enters[here] = one / (zero + one)
        for here, before in reversed(lines.chain):
            a, b, c, d = behind[:, place[here]]
            zero, one = a * (1 - leaves[here]) + b * leaves[here], c * (1 - leaves[here]) + d * leaves[here]
            zero, one = m00 * zero + m01 * one, m10 * zero + m11 * one
            leaves[before] = one / (zero + one)

    def fit(self, parts: Sequence[tuple[Words, np.ndarray]], epochs: int = EPOCHS, rate: float = 0.5, decay: float = 1e-6) -> LinearChainCrf:
        """Full-batch Adagrad on the conditional log-likelihood of words and their tags, part by part."""
        lines = [Lines(w.line) for w, _ in parts]
        moved = np.zeros((2, 2))
        for w, tags in parts:
            same = np.flatnonzero(w.line[1:] == w.line[:-1])
            moved += np.bincount(tags[same] * 2 + tags[same + 1], minlength=4).reshape(2, 2)
        power = {k: np.zeros(BUCKETS) for k in ("own", "before", "after")}
        bias_power, move_power = 1e-8, np.full((2, 2), 1e-8)
        n = max(1, sum(len(tags) for _, tags in parts))
        for _ in range(epochs):
            grads = {k: np.zeros(BUCKETS) for k in power}
            all_missed, all_expected = 0.0, np.zeros((2, 2))
            for (w, tags), own in zip(parts, lines):
                p, expected = self.marginals(self.emissions(w), own, pairs=True)
                miss = tags - p
                for f in w.features:
                    grads["own"] += np.bincount(f, miss, BUCKETS)
                grads["before"] += np.bincount(w.features[0], shifted(miss, w.line, -1), BUCKETS)
                grads["after"] += np.bincount(w.features[0], shifted(miss, w.line, 1), BUCKETS)
                all_missed += miss.sum()
                all_expected += expected
            for k, g in grads.items():
                weight = getattr(self, k)
                g -= decay * n * weight
                power[k] += g * g
                weight += (rate * g / np.sqrt(power[k] + 1e-8)).astype(np.float32)
            bias_power += all_missed**2
            self.bias += rate * all_missed / np.sqrt(bias_power)
            g = moved - all_expected
            move_power += g * g
            self.moves += 0.2 * rate * g / np.sqrt(move_power)
        return self


class WordCounts:
    """In how many distinct toxic and other texts each word is."""

    def __init__(self):
        self.words, self.bad, self.good = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.n_bad = self.n_good = 0
        self.seen: set[int] = set()

    def add(self, w: Words, content: list[int], toxic: np.ndarray) -> None:
        """content: a hash of each text; toxic: 0 or 1 of each."""
        new = np.zeros(len(content), bool)
        for i, c in enumerate(content):
            new[i] = c not in self.seen
            self.seen.add(c)
        self.n_bad, self.n_good = self.n_bad + int((toxic[new] == 1).sum()), self.n_good + int((toxic[new] == 0).sum())
        at = np.flatnonzero(new[w.doc])
        # One hash for a word and its document tells each pair once.
        first = np.unique(w.hashes[at] ^ bk.mix(w.doc[at].astype(np.uint64)), return_index=True)[1]
        words, label = w.hashes[at[first]], toxic[w.doc[at[first]]]
        every, of = np.unique(np.concatenate((self.words, words)), return_inverse=True)
        bad, good = np.concatenate((self.bad, label)), np.concatenate((self.good, 1 - label))
        self.words, self.bad, self.good = every, np.bincount(of, bad, len(every)).astype(np.int64), np.bincount(of, good, len(every)).astype(np.int64)

    def bound(self) -> np.ndarray:
        """Hashes of the words bound to toxic texts, sorted."""
        if not self.n_bad or not len(self.words):
            return self.words[:0]
        n, share = self.bad + self.good, self.n_bad / (self.n_bad + self.n_good)
        seen = self.bad / n
        with np.errstate(divide="ignore", invalid="ignore"):
            far = seen * np.log(seen / share) + np.where(seen < 1, (1 - seen) * np.log((1 - seen) / max(1 - share, 1e-12)), 0)
        chance = np.where(seen > share, np.exp(-n * far), 1.0)  # at least that of so many toxic texts by accident
        order = np.sort(chance)
        fine = np.flatnonzero(order <= FALSE_FINDS * np.arange(1, len(order) + 1) / len(order))
        most = order[fine[-1]] if len(fine) else -1.0
        likelier = self.bad / self.n_bad > LEAST_RATIO * (self.good + 1) / max(1, self.n_good)
        return self.words[(chance <= most) & (self.bad >= LEAST_DOCS) & likelier]


def evidence(p: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """A document's features: log of the expected number of toxic words, and its surest word's log odds."""
    p = np.clip(p, 1e-7, 1 - 1e-7)
    expected = np.bincount(doc, p, n)
    surest = np.full(n, 1e-7)
    np.maximum.at(surest, doc, p)
    return np.column_stack([np.log(expected + 1e-3), np.log(surest / (1 - surest))])


def logistic(rows: np.ndarray, label: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weights and intercept by Newton steps."""
    x = np.column_stack([rows, np.ones(len(rows))])
    w = np.zeros(x.shape[1])
    penalty = ridge * np.diag([*[1.0] * rows.shape[1], 1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(len(w)), x.T @ (label - p) - penalty @ w)
    return w


@dataclass
class ToxicityModel:
    crf: LinearChainCrf
    weights: np.ndarray | None

    @classmethod
    def fit(cls, read: Callable[[], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]) -> ToxicityModel:
        """read: gives bytes, offsets and labels (0 or 1) of some documents after another, the same each time."""
        counts = WordCounts()
        for data, offsets, toxic in read():
            counts.add(Words.of(data, offsets), [xxhash.xxh3_64_intdigest(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])], toxic)
        if not counts.n_bad or not counts.n_good:
            return cls(LinearChainCrf.empty(), None)
        bound = counts.bound()
        del counts
        parts, labels, none = [], [], np.zeros(0, np.int64)
        for data, offsets, label in read():
            labels.append(label)
            w = Words.of(data, offsets)
            tags = (np.isin(w.hashes, bound) & (label[w.doc] == 1)).astype(np.int8)
            parts.append((Words(w.doc.astype(np.int32), w.line.astype(np.int32), w.features, none, none, none), tags))
        crf = LinearChainCrf.empty().fit(parts)
        rows = [evidence(crf.marginals(crf.emissions(w), Lines(w.line))[0], w.doc, len(label)) for (w, _), label in zip(parts, labels)]
        return cls(crf, logistic(np.concatenate(rows), np.concatenate(labels).astype(float)))

    def score(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        """Scores and the offending byte ranges of each document."""
        n = len(offsets) - 1
        w = Words.of(data, offsets)
        p, _ = self.crf.marginals(self.crf.emissions(w), Lines(w.line))
        if self.weights is None:
            scores, tagged = np.zeros(n), np.zeros(len(p), bool)
        else:
            z = evidence(p, w.doc, n) @ self.weights[:-1] + self.weights[-1]
            scores, tagged = 1 / (1 + np.exp(-np.clip(z, -30, 30))), p > 0.5
        joined = np.zeros(len(p), bool)
        joined[1:] = tagged[:-1] & (w.line[1:] == w.line[:-1])
        first = np.flatnonzero(tagged & ~joined)
        more = np.zeros(len(p), bool)
        more[:-1] = joined[1:] & tagged[1:]
        last = np.flatnonzero(tagged & ~more)
        base = offsets[w.doc[first]]
        ranges = pa.StructArray.from_arrays([pa.array(w.start[first] - base), pa.array(w.end[last] - base)], ["lo", "hi"])
        counts = np.concatenate(([0], np.cumsum(np.bincount(w.doc[first], minlength=n)))).astype(np.int32)
        return scores, pa.ListArray.from_arrays(pa.array(counts), ranges)


def in_chunks(rows: Iterator[tuple[str | None, int]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, offsets, labels) of texts with labels, about CHUNK_BYTES at once."""
    texts, labels, size = [], [], 0
    for text, label in rows:
        texts.append(text)
        labels.append(label)
        size += len(text or "")
        if size >= bk.CHUNK_BYTES:
            yield *bk.utf8(pa.array(texts, pa.large_string())), np.array(labels, np.int64)
            texts, labels, size = [], [], 0
    if texts:
        yield *bk.utf8(pa.array(texts, pa.large_string())), np.array(labels, np.int64)


def within(sizes: list[tuple[int, int]], most: int) -> list[int]:
    """Which of the documents, (label, bytes) in their order, fit in half of `most` bytes for each label."""
    left, out = {0: most // 2, 1: most // 2}, []
    for i, (label, size) in enumerate(sizes):
        if size <= left[label]:
            left[label] -= size
            out.append(i)
    return out


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = FIT_ROWS, most_bytes: int = FIT_BYTES) -> ToxicityModel:
    scratch = Scratch(docs.sparkSession, "toxicity")
    sample = labelled(docs, known_labels(labels, key, label), key, text, rows, per_class=True).repartition(16, "id").sortWithinPartitions("id")
    sample = scratch.keep(sample, "sample")  # at most `rows` rows
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    known = sorted((r["h"], r["id"], r["label"], r["size"]) for r in sample.select(F.xxhash64(F.col("id").cast("string")).alias("h"), "id", "label", size.alias("size")).collect())
    chosen = within([r[2:] for r in known], most_bytes)
    if len(chosen) < len(known):
        sample = sample.filter(F.col("id").isin([known[i][1] for i in chosen]))
    sample = sample.select("label", "text")
    model = ToxicityModel.fit(lambda: in_chunks((r["text"], r["label"]) for r in sample.toLocalIterator()))
    scratch.drop("sample")
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", carry: Sequence[str] | None = None) -> DataFrame:
    """(doc, score, spans: byte ranges of toxic runs)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 3 MB, whatever the data

    def score(data: np.ndarray, offsets: np.ndarray) -> list:
        return list(shared.value.score(data, offsets))

    return map_texts(docs, text, carry, "score double, spans array<struct<lo:long,hi:long>>", score)
