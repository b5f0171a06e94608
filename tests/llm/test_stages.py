"""Every stage of the pipeline against a plain version of it, on odd rows, an empty table and clashing columns; models against plain sums."""

import hashlib
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from scenemill.llm import bpe, leaks, media, nearcopies, quality, repeats, toxicity
from scenemill.llm.storage import table

from .test_text_ops import brute_classes, brute_repeats, near_rows, repeat_rows

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)
EXTRA = ["'q' AS _score", "5 AS _empty", "7L AS _doc", "8L AS _crc", "'s' AS _spans", "'k' AS _kept", "'r' AS _row", "0.5 AS quality_score"]


@pytest.fixture(scope="module")
def clashing(frame):
    return lambda rows: frame(rows).selectExpr("*", *EXTRA)


@pytest.mark.parametrize("name", list(STAGES))
def test_odd_rows_empty_tables_and_clashing_names(spark, clashing, odd_rows, name):
    docs = clashing(odd_rows)
    none = STAGES[name](spark, docs.limit(0), SF)
    out = STAGES[name](spark, docs, SF)
    rows = out.collect()
    assert none.count() == 0 and {r.doc_id for r in rows} <= {i for i, _ in odd_rows}
    if name == "tokens":
        assert len(rows) == len(odd_rows)
        return
    assert out.columns == none.columns == docs.columns
    assert all((r._score, r._empty, r._doc, r._crc, r._spans, r._kept, r._row, r.score) == ("q", 5, 7, 8, "s", "k", "r", 3) for r in rows)


def test_keep_one_of_each_equals_brute_force(spark, clashing):
    rows = near_rows()
    kept = STAGES["near_copies"](spark, clashing(rows), SF).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted((i, dict(rows)[i]) for i in set(brute_classes(rows).values()))


def test_cut_repeats_equals_brute_force(spark, clashing):
    rows = [(i, re.sub("é", "e", t)) for i, t in repeat_rows()]  # of one byte a character, so no character is kept for the sake of a part
    got = {r.doc_id: r for r in STAGES["repeats"](spark, clashing(rows), SF).collect()}
    want = brute_repeats(rows)
    left = {i for i, t in rows if not t or want[i][1] < len(t)}
    assert set(got) == left
    for i in left:
        assert hashlib.sha256(got[i].text.encode()).hexdigest() == want[i][3] and got[i].n_chars == want[i][0] - want[i][1]


def test_cut_repeats_deals_large_groups_in_few_rows(spark, clashing, monkeypatch):
    passage = "".join(chr(97 + (i * i * 7 + i // 3) % 26) for i in range(300))
    rows = [(i, f"{i * 7919 % 1000:05d} {passage[: 100 + i]}#{passage[101 + i :]} {i:05d}") for i in range(90)]
    dealt, put = [], repeats.stored

    def counted(df, name):
        out = put(df, name)
        dealt.append((name, out.count()))
        return out

    monkeypatch.setattr(repeats, "GROUP", 10)
    monkeypatch.setattr(repeats, "stored", counted)
    got = {r.doc_id: len(r.text) for r in STAGES["repeats"](spark, clashing(rows), SF).collect()}
    want = brute_repeats(rows)
    assert got == {i: want[i][0] - want[i][1] for i, _ in rows if want[i][0] > want[i][1]}
    of = lambda kind: sum(n for name, n in dealt if name == kind)
    assert 0 < of("halves") < 8 * of("contexts"), dealt


def test_cut_repeats_keeps_characters_whole(spark, clashing):
    rows = repeat_rows()
    want = brute_repeats(rows)
    for r in STAGES["repeats"](spark, clashing(rows), SF).collect():
        assert 0 <= len(r.text.encode()) - (want[r.doc_id][0] - want[r.doc_id][1]) <= 2 * max(1, want[r.doc_id][2])


def plain_leaks(text, items):
    """Items of which, in some window of their class, BM25 share, shingles, question and answer reach the thresholds."""
    words = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", t.lower())
    held = {i: words(t) for i, t in items}
    mean = np.mean([len(w) for w in held.values()])
    df = {}
    for w in held.values():
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    doc, found = words(text), set()
    for i, t in items:
        w = held[i]
        if not w:
            continue
        idf = lambda x: np.log(1 + (len(held) - df[x] + 0.5) / (df[x] + 0.5))
        part = {x: idf(x) * w.count(x) * 2.2 / (w.count(x) + 1.2 * (0.25 + 0.75 * len(w) / mean)) for x in set(w)}
        span = leaks.span_of(len(w))
        question, answer = (set(words(x)) for x in leaks.halves(t))
        n = min(5, len(w))
        grams = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
        for p in range(max(1, -(-len(doc) // span) - 1)):
            here = doc[p * span : (p + 2) * span]
            have = set(here)
            seen = {tuple(here[k : k + n]) for k in range(len(here) - n + 1)}
            share = sum(v for x, v in part.items() if x in have) / sum(part.values())
            if share >= 0.7 - 1e-9 and len(grams & seen) >= 0.8 * len(grams) and all(len(s & have) >= 0.8 * len(s) for s in (question, answer)):
                found.add(i)
    return found


def test_leaks_equal_a_plain_version(spark):
    docs, bench = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "benchmark")
    items = [(r.item_id, r.text) for r in bench.collect()]
    got = {}
    for r in leaks.find_leaks(docs, bench).collect():
        got.setdefault(r.doc_id, set()).add(r.item_id)
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    some = sorted(got) + [i for i in sorted(texts) if i not in got][:60]
    assert {i: plain_leaks(texts[i], items) for i in some if i in got} == got
    assert all(not plain_leaks(texts[i], items) for i in some if i not in got)
    kept = {r.doc_id for r in STAGES["leaks"](spark, docs, "/root/testdata/sf0.01").collect()}
    assert kept == set(texts) - set(got)


def test_no_item_changes_what_another_matches(spark, frame):
    words = [f"alpha{i}" for i in range(10)]
    far = " ".join(f"{w} " + " ".join(f"filler{i}x{k}" for k in range(150)) for i, w in enumerate(words))
    make = lambda items: spark.createDataFrame(items, "item_id long, text string")
    short, long = (1, " ".join(words)), (2, " ".join(f"other{k}" for k in range(3000)))
    assert leaks.find_leaks(frame([(1, far)]), make([short])).count() == leaks.find_leaks(frame([(1, far)]), make([short, long])).count() == 0


def test_tokens_equal_tiktoken(spark):
    encoder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    docs = table(spark, SF, "documents")
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    assert all(r.ids == encoder.encode_ordinary(text[r.doc_id]) for r in STAGES["tokens"](spark, docs, SF).collect())


def test_quality_stage_keeps_what_its_model_scores(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = quality.fit(docs, labels)
    want = {r.doc_id for r in docs.collect() if model.score(quality.features([(r.text or "").encode()]))[0] >= 0.5}
    assert {r.doc_id for r in STAGES["quality"](spark, docs, SF).collect()} == want


def test_run_is_its_stages_in_turn(spark):
    docs = table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    rows = lambda df: sorted((r.doc_id, r.n_tokens, tuple(r.ids), r.decoded_sha256) for r in df.collect())
    assert rows(corpus_pipeline.run(spark, SF)) == rows(docs)


def test_quality_features_equal_plain_counts():
    text = "The cat, the CAT sat! 42 @ @\nsat sat"
    x = quality.features([text.encode()])[0]
    n, words = len(text), text.lower().split()
    shares = [sum(c.isupper() for c in text) / n, sum(c.isdigit() for c in text) / n, sum(c in ".,;:'\"()-?" for c in text) / n, sum(c in "!@" for c in text) / n,
              len(set(words)) / len(words), max(words.count(w) for w in words) / len(words), sum(a == b for a, b in zip(words, words[1:])) / len(words), 1 / n]
    upper = sum(c.isupper() for c in text) / sum(c.isalpha() for c in text)
    assert x == pytest.approx([np.log1p(n), np.log1p(len(words)), n / len(words), upper, *shares, *np.sqrt(shares)])


def test_preference_loss_is_least_at_the_weights():
    draw = np.random.default_rng(2)
    x = draw.normal(size=(300, 20))
    label = (x[:, 0] - 0.5 * x[:, 3] + draw.normal(size=300) > 0).astype(int)
    model = quality.learn(x, label)
    z = np.clip((x - model.centre) / model.scale, -8, 8)
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    few, many = sorted((good, bad), key=len)
    pick = np.random.default_rng(quality.SEED)
    d = (z[np.repeat(few, quality.PAIRS)] - z[pick.choice(many, len(few) * quality.PAIRS)]) * (1 if few is good else -1)
    loss = lambda w: np.log1p(np.exp(-d @ w)).mean() + quality.RIDGE / 2 * w @ w
    step = 1e-4
    slope = [(loss(model.weights + step * e) - loss(model.weights - step * e)) / (2 * step) for e in np.eye(20)]
    assert np.abs(slope).max() < 1e-4


def test_factorization_machine_is_the_sum_over_pairs():
    texts = [b"you awful group people", b"nice group", b"", b"awful awful awful weather today"]
    doc, term = toxicity.terms(texts)
    known = np.unique(term)
    column = np.full(toxicity.SPACE, -1, np.int32)
    column[known] = np.arange(len(known))
    draw = np.random.default_rng(1)
    model = toxicity.Model(column, -0.3, draw.normal(size=len(known)), draw.normal(size=(len(known), 8)))
    for i, score in enumerate(model.score(texts)):
        held = column[term[doc == i]]
        logit = -0.3 + model.weight[held].sum() + sum(float(model.vector[a] @ model.vector[b]) for k, a in enumerate(held) for b in held[:k])
        assert score == pytest.approx(1 / (1 + np.exp(-logit)))


def test_fingerprint_equals_a_plain_transform():
    samples = np.random.default_rng(7).integers(0, 255, 64 * 12, dtype=np.uint8)
    n, window = 64, [0.5 - 0.5 * np.cos(2 * np.pi * k / 63) for k in range(64)]
    turn = np.exp(-2j * np.pi * np.outer(np.arange(n // 2 + 1), np.arange(n)) / n)
    level = []
    for at in range(0, len(samples) - n + 1, 32):
        x = samples[at : at + n].astype(float)
        level.append([round(10 * np.log10(1 + abs(v) ** 2)) for v in turn @ ((x - x.mean()) * window)])
    want = []
    for f, row in enumerate(level):
        for b in range(1, n // 2):
            higher = row[b] > row[b - 1] and row[b] > row[b + 1] and row[b] >= np.mean(row) + 6
            if higher and (f == 0 or row[b] > level[f - 1][b]) and (f + 1 == len(level) or row[b] >= level[f + 1][b]):
                want.append((f, b))
    frames, bins = media.peaks(samples)
    assert len(want) > 20 and list(zip(frames.tolist(), bins.tolist())) == want
    pairs = [(t << 24) | (f << 16) | (g << 8) | (u - t) for i, (t, f) in enumerate(want) for u, g in want[i + 1 : i + 1 + media.FAN] if u - t <= media.SPAN]
    assert media.fingerprints(samples.tobytes()).tolist() == sorted(pairs)


def test_a_steady_tone_peaks_at_its_own_bin():
    tone = (128 + 100 * np.sin(2 * np.pi * 8 * np.arange(64 * 50) / 64)).astype(np.uint8)
    found = media.peaks(tone)[1].tolist()
    assert 8 in found and set(found) <= {8, 16, 24}  # and its overtones, as samples are whole numbers


def test_one_of_each_keeps_columns_without_an_order(spark):
    text = " ".join(f"w{k}" for k in range(40))
    docs = spark.createDataFrame([(1, text, {"a": 2}, [{"b": 1}]), (1, text, {"a": 1}, [{"b": 1}]), (2, text, {"c": 3}, []), (3, "other words", None, None)], "doc_id long, text string, extra map<string,int>, more array<map<string,int>>")
    got = sorted((r.doc_id, r.extra, r.more) for r in nearcopies.one_of_each(docs).collect())
    assert got == [(1, {"a": 1}, [{"b": 1}]), (3, None, None)]
