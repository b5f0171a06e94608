"""Divergence of sources, periodic runs and the n-gram join against brute force."""

import collections
import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from scenemill.llm import divergence, jaccard, periods

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile("[^\x20\x09-\x0d]+")


def plain_runs(words):
    """start, length, period of each run, by every lag from every word."""
    out, n = [], len(words)
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            e = i + q
            if e - s >= max(24, 3 * q) and not any(all(words[k] == words[k + p] for k in range(s, e - p)) for p in range(1, q)):
                out.append((s, e - s, q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text, plant=True):
    words = SPACED.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    if plant and doc_id is not None and h % 10 == 0 and words:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    return (
        doc_id, len(words), len(runs), *(best or (None, None, None)), best and 1000 * best[1] // best[2],
        hashlib.sha256("".join("%d,%d,%d\n" % r for r in runs).encode()).hexdigest(),
        hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in dropped).encode()).hexdigest(),
    )


def periodic_texts(draw, how_many):
    texts = []
    for _ in range(how_many):
        kinds = draw.choice([1, 2, 3, 40])
        w = [str(draw.randrange(kinds)) for _ in range(draw.choice([0, 3, 40, 150, 400]))]
        for _ in range(draw.randrange(3)):
            q = draw.choice([1, 2, 7, 15, 16, 17, 23, 24, 35, 36, 53, 54, 80])
            piece = [str(draw.randrange(kinds)) for _ in range(q)]
            if draw.random() < 0.4 and q > 6:  # a piece with a short period of its own
                piece = (piece[: max(1, q // 7)] * q)[: q - 1] + ["z"]
            at = draw.randrange(len(w) + 1)
            w[at:at] = (piece * 6)[: draw.randrange(2 * q, 5 * q + 1)]
        texts.append(" ".join(w))
    return texts


def test_runs_equal_brute_force(frame, odd_rows):
    draw = random.Random(11)
    rows = odd_rows + list(enumerate(periodic_texts(draw, 60), 100))
    rows += [(900, "x\x00 \x1f\x00y " * 30), (901, "a b " * 11 + "a b"), (902, "a b " * 12), (903, "é　z  " * 40)]
    got = periods.runs_of(frame(rows), repeat_tails=True).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(plain_row(i, t) for i, t in rows)
    assert collections.Counter(map(tuple, periods.runs_of(frame(rows[:30])).collect())) == collections.Counter(plain_row(i, t, False) for i, t in rows[:30])
    assert periods.runs_of(frame(rows).limit(0)).count() == 0


def test_runs_of_words_without_cubes_and_of_nested_squares():
    thue = [b"a" if bin(i).count("1") % 2 else b"b" for i in range(1 << 13)]
    short, long = [b"a"], [b"a", b"b"]
    while len(long) < 1500:
        short, long = long, long + short
    rows = periods.describe_words([1, 2], [thue, long])
    assert rows[0][2] == 0 and rows[0][3] is None
    want = plain_runs(long)
    assert rows[1][2] == len(want) and rows[1][7] == hashlib.sha256("".join("%d,%d,%d\n" % r for r in want).encode()).hexdigest()


def test_runs_in_one_long_text(frame):
    draw = random.Random(3)
    words = [str(draw.randrange(10**6)) for _ in range(150_000)]
    text = " ".join(words[:90_000] + words[60_000:90_000] * 2 + words[90_000:])
    assert len(text) > 1 << 20
    row = periods.runs_of(frame([(1, text)])).collect()[0]
    assert (row.n_runs, row.start, row.length, row.period, row.exponent_milli) == (1, 60_000, 90_000, 30_000, 3000)
    assert row.collapsed_sha256 == hashlib.sha256(" ".join(words).encode()).hexdigest()


def shingle_sets(rows):
    out = []
    for i, t in rows:
        w = SPACED.findall((t or "").translate(LOWER))
        out.append((i, {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set()))
    return out


def plain_components(rows):
    sets = shingle_sets(rows)
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, s) in enumerate(sets):
        for j, t in sets[:k]:
            if s and None not in (i, j) and abs(len(s) - len(t)) * 10 <= max(len(s), len(t)) and 100 * len(s & t) >= 90 * len(s | t):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return collections.Counter((i, len(s), None if i is None else find(i)) for i, s in sets)


def family(draw, n, words, least, most):
    """Texts that differ from one base in some words each."""
    base = [f"w{k}" for k in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for at in draw.sample(range(0, words, 3), draw.randint(least, most)):
            w[at] = f"u{draw.randrange(10**9)}"
        out.append(w)
    return out


@pytest.mark.parametrize("block", [512, 7])
def test_components_equal_brute_force(frame, odd_rows, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    draw = random.Random(block)
    rows = list(odd_rows) + [(14, "one two"), (15, "ONE\ttwo"), (16, "one two three"), (17, "one  two\x0bthree"), (18, "one two\x00three"), (19, "q r s t")]
    unlike = family(draw, 60, 300, 6, 9)  # about 0.85 to each other: not linked, and in one bucket often
    texts = [" ".join(w) for w in unlike]
    for w in unlike[::6]:
        w = list(w)
        w[draw.randrange(len(w))] = "other"
        w.insert(0, "more")
        texts.append(" ".join(w))
    texts += [" ".join(w) for w in family(draw, 20, 40, 0, 1) + family(draw, 20, 12, 0, 1) + family(draw, 20, 120, 0, 2)]
    rows += list(enumerate(texts, 100))
    rows += [(draw.randrange(300, 400), t) for t in draw.choices(texts, k=30)]  # copies, some under one id
    got = jaccard.component_ids(frame(rows)).collect()
    assert collections.Counter(map(tuple, got)) == plain_components(rows)


def test_components_of_odd_tables(frame):
    assert jaccard.component_ids(frame([(1, "a b c")]).limit(0)).count() == 0
    long = " ".join(f"t{k}" for k in range(200_000))
    got = {tuple(r) for r in jaccard.component_ids(frame([(5, long), (3, long + " end"), (4, None), (2, ""), (1, long[: len(long) // 2])])).collect()}
    assert len(long) > 1 << 20
    assert {(5, 199_998, 3), (3, 199_999, 3), (4, 0, 4), (2, 0, 2)} < got and len(got) == 5


def test_sketches_of_linked_sets_share_a_segment():
    draw = np.random.default_rng(1)
    starts = jaccard.band_starts(1 << 20)
    for _ in range(300):
        n = int(draw.integers(1, 2000))
        a = np.unique(draw.integers(0, 2**64, n, np.uint64))
        drop = int(draw.integers(0, n // 15 + 1))
        b = np.unique(np.concatenate([a[draw.permutation(n)[: n - drop]], draw.integers(0, 2**64, int(draw.integers(0, n // 15 + 1)), np.uint64)]))
        if not jaccard.linked(a, b):
            continue
        p, q = sorted((a, b), key=len)
        bands = [int(np.searchsorted(starts, len(x), side="right")) - 1 for x in (p, q)]
        assert bands[1] - bands[0] in (0, 1)
        x, y = (jaccard.segment_keys(z, bands[1], starts) for z in (p, q))
        assert (x == y).any()
        differing = len(p) + len(q) - 2 * len(np.intersect1d(p, q))
        assert (x != y).sum() <= differing <= jaccard.most_apart(len(p) + len(q)) < len(x)


def plain_audit(rows, top):
    words = [(lang or "", source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(LOWER))) for lang, source, text in rows]
    out = set()
    for lang in {w[0] for w in words}:
        own = [w for w in words if w[0] == lang]
        docs = collections.Counter(t for _, _, ws in own for t in set(ws))
        kept = {t for t in docs if docs[t] >= 3}
        groups = {s: collections.Counter(t for _, x, ws in own if x == s for t in ws if t in kept) for s in {w[1] for w in own}}
        whole = sum(groups.values(), collections.Counter())

        def p(counts, t):
            return 1 + 10**9 * (counts[t] + 1) // (sum(counts.values()) + len(kept))

        for s, mine in groups.items():
            pairs = [(o, sum((p(mine, t) - p(theirs, t)) ** 2 // p(theirs, t) for t in kept)) for o, theirs in groups.items() if o != s]
            terms = [(t, (p(mine, t) - p(whole, t)) ** 2 // p(whole, t)) for t in mine if p(mine, t) > p(whole, t)]
            for part, held in (("pair", pairs), ("term", terms)):
                held.sort(key=lambda r: (-r[1], r[0].encode()))
                out |= {(lang, s, part, item, value, k) for k, (item, value) in enumerate(held, 1) if part == "pair" or k <= top}
    return out


@pytest.mark.parametrize("sources, width", [(128, 2048), (2, 8)])
def test_divergence_equals_brute_force(spark, sources, width):
    draw = random.Random(sources)
    vocabulary = ["".join(draw.choice("abCdÉñ漢😀") for _ in range(draw.randint(1, 4))) for _ in range(60)]
    rows = [(draw.choice(["en", "de", None]), draw.choice(["a", "b", "é", "Z", None]), " ".join(draw.choices(vocabulary, k=draw.randrange(60)))) for _ in range(150)]
    rows += [("en", "empty", None), ("en", "signs", "12 --\x00 [] "), ("xx", "one", "word"), ("xx", "two", None), ("yy", "alone", "rare"), (None, "b", "don't stop-it x\x7fy " * 3)] + rows[:5]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").selectExpr("*", "'x' AS term", "1 AS n", "2 AS docs", "3 AS s").repartition(3)
    counted = divergence.kept_terms(divergence.term_counts(docs), 3, width)
    assert counted[0].count() == counted[0].select("lang", "block", "at").distinct().count()
    got = {tuple(r) for r in divergence.audit(docs, top=20, sources=sources, width=width).collect()}
    assert got == plain_audit(rows, 20)
    assert divergence.audit(docs.limit(0)).count() == 0


def test_shares_are_exact_far_beyond_a_long():
    count = np.array([0, 1, 10**13, 8 * 10**15], np.int64)
    whole = np.array([9 * 10**15] * 4, np.int64)
    assert divergence.shares(count, whole).tolist() == [1 + 10**9 * (int(c) + 1) // (9 * 10**15) for c in count]


def test_trees_share_equal_parts():
    counts = np.zeros((3, 1024), np.int64)
    counts[1, 5], counts[2, 700] = 4, 4
    left, right, roots, values = divergence.consed(counts)
    assert len(left) == 10 and max(len(x) for x in left) <= 4 and len(set(roots.tolist())) == 3 and values.tolist() == [0, 4]
    wholes = np.array([1024, 1028, 1028])
    to, back = divergence.priced(left, right, roots, values, wholes, 0, np.array([1, 2]))
    p = [divergence.shares(c, np.full(1024, w)) for c, w in zip(counts, wholes)]
    assert to.tolist() == [int(((p[0] - p[k]) ** 2 // p[k]).sum()) for k in (1, 2)] and back.tolist() == [int(((p[0] - p[k]) ** 2 // p[0]).sum()) for k in (1, 2)]
