import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from tabulark.llm import bytes_kernel as bk
from tabulark.llm import fm_index, packing, suffix_dedup, suffix_sort, text_rules, word_bpe

def test_runs_are_the_words_of_the_pattern():
    texts = ["Hello wörld  foo\u00a0bar", "", None, "A1-b2 _c\x7fd", "日本 語"]
    data, offsets = bk.utf8(pa.array(texts))
    for member, pattern in ((bk.PLAIN_WORD, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), (bk.SPACED_WORD, r"[^\x20\x09-\x0D]+")):
        s, e, d = bk.runs(data, offsets, member)
        got = [[bytes(data[a:b]).decode() for a, b, i in zip(s, e, d) if i == k] for k in range(len(texts))]

        want = [re.findall(pattern, (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) if member is bk.PLAIN_WORD else t or "") for t in texts]
        assert [[x.lower() if member is bk.PLAIN_WORD else x for x in g] for g in got] == want

def test_rule_counts_by_brute_force():
    rng = random.Random(4)
    texts = ["", None] + ["".join(rng.choice(["a ", "b ", "cc ", "é# ", "\n", "$ ", "x\ty "]) for _ in range(rng.randint(0, 120))) for _ in range(150)]
    c = text_rules.rule_counts(*bk.utf8(pa.array(texts)))
    for i, t in enumerate(texts):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        covered = {k + j for k, x in enumerate(windows) if windows.count(x) > 1 for j in range(8)}
        lines, dup = t.split("\n"), 0
        for k, line in enumerate(lines):
            dup += bool(re.search(r"[^\x20\x09-\x0D]", line)) and line in lines[:k]
        assert tuple(int(c[n][i]) for n in text_rules.COUNTS[:5]) == (len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in t), dup, len(covered))

def test_suffix_array_and_search():
    rng = np.random.default_rng(1)
    for _ in range(30):
        text = rng.integers(1, 4, rng.integers(1, 80))
        index = fm_index.FMIndex(text, 5, sample=4)
        patterns = [rng.integers(1, 5, rng.integers(1, 5)) for _ in range(10)]
        right = np.zeros((10, 5), np.int64)
        for k, p in enumerate(patterns):
            right[k, 5 - len(p) :] = p
        low, high = index.intervals(right, np.array([len(p) for p in patterns]))
        for p, a, b in zip(patterns, low, high):
            want = [i for i in range(len(text) - len(p) + 1) if (text[i : i + len(p)] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want

def test_deep_shallow_orders_and_prefixes():
    rng = random.Random(2)
    for _ in range(150):
        base = bytes(rng.choices(b"ab" if rng.random() < 0.5 else b"abcdefgh", k=60))
        strings = [base[: rng.randint(0, 60)] + bytes(rng.choices(b"ab", k=rng.randint(0, 9))) for _ in range(rng.randint(0, 40))]
        order, lcp = suffix_sort.deep_shallow(strings, 0, rng.choice([0, 1, 4, 32]))
        assert [strings[i] for i in order] == sorted(strings)
        assert all(lcp[k] == suffix_sort.common_prefix(strings[order[k - 1]], strings[order[k]]) for k in range(1, len(order)))

def test_matches_by_brute_force():
    rng = random.Random(3)
    for _ in range(60):
        mid = bytes(rng.choices(b"ab", k=10))
        cuts = [(bytes(rng.choices(b"ab", k=rng.randint(0, 12))), mid + bytes(rng.choices(b"ab", k=rng.randint(0, 12)))) for _ in range(rng.randint(2, 8))]
        got = suffix_dedup.matches([a for a, _ in cuts], [b for _, b in cuts], 16)
        for i, (a, b) in enumerate(cuts):
            cover, want = set(), set()
            for x, y in got[i]:
                cover |= set(range(-x, y))
            for j, (c, d) in enumerate(cuts):
                if j != i:
                    x, y = suffix_sort.common_prefix(a, c), suffix_sort.common_prefix(b, d)
                    if x + y >= 16:
                        want |= set(range(-x, y))
            assert cover == want

def test_word_bpe_is_the_tokenizer():
    path = public_tokenizers.path("word_bpe_49k.json")
    plain, fast = Tokenizer.from_file(path), word_bpe.WordBpe(path)
    points = [chr(c) for lo, hi in word_bpe.RANGES for c in range(lo, hi)]
    texts = [f"a{x}b {x}{x} 1{x}2 !{x}?{x.upper()} '{x}s" for x in points]
    texts += ["don't can't WE'LL they've 'start ''s !'s x'd 're 'very", "<|endoftext|> a", "ΣΑΣ", "é", "中文 日本", "a\u00a0b\u2003c\x1cd\x85e", "½ ²3 Ⅷ", "", "  \n", "İ ǅ", "don’t “q” … €5", "'", "a'"]
    ids, offsets = fast.encode(texts)
    for i, t in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)

def test_best_fit_respects_all_capacities():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 100, 500)
    for rule in ("norm", "dot"):
        bins, offsets = packing.best_fit(lengths, (100, 3, 5000.0), rule=rule) if (lengths**2).max() <= 5000 else packing.best_fit(np.minimum(lengths, 70), (100, 3, 5000.0), rule=rule)
        own = lengths if (lengths**2).max() <= 5000 else np.minimum(lengths, 70)
        for b in range(bins.max() + 1):
            at = np.flatnonzero(bins == b)
            assert len(at) <= 3 and own[at].sum() <= 100 and (own[at] ** 2).sum() <= 5000
            order = at[np.argsort(offsets[at])]
            assert offsets[order].tolist() == np.concatenate(([0], np.cumsum(own[order])[:-1])).tolist()

def test_hashes_of_regular_ranges_differ():
    order = [bin(i).count("1") % 2 for i in range(4096)]
    data = np.array([97 + x for x in order] + [98 - x for x in order], np.uint8)
    for n in (16, 64, 65, 1024, 2048, 4096):
        h = bk.Prefix(data).hash(np.array([0, 4096]), np.array([n, 4096 + n]))
        assert h[0] != h[1]
    upper = bk.Prefix(np.frombuffer(b"ABC abc", np.uint8), fold=True).hash(np.array([0, 4]), np.array([3, 7]))
    assert upper[0] == upper[1]
