"""Tokens, repeats, near copies, leaks and shards against brute force."""

import base64
import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark import cloudpickle

from scenemill.llm import bpe, leaks, nearcopies, repeats, shards

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def test_bpe_equals_tiktoken(frame, odd_rows, monkeypatch):
    encoder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    got = bpe.digests(frame(odd_rows), RANKS, public_tokenizers.PATTERN).collect()
    want = collections.Counter()
    for i, t in odd_rows:
        ids = encoder.encode_ordinary(t or "")
        want[(i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())] += 1
    assert collections.Counter(map(tuple, got)) == want
    ids = {r.doc_id: r.ids for r in bpe.tokens(frame(odd_rows), RANKS, public_tokenizers.PATTERN).collect()}
    assert ids[10] == encoder.encode_ordinary(dict(odd_rows)[10])
    assert bpe.digests(frame(odd_rows).limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


@pytest.fixture(scope="module")
def encoder():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def test_bpe_equals_tiktoken_on_whole_tables(spark, encoder):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    text = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    for r in bpe.tokens(docs, RANKS, public_tokenizers.PATTERN).collect():
        assert r.ids == encoder.encode_ordinary(text[r.doc_id]) and r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def test_bpe_of_a_text_longer_than_a_block(frame, encoder):
    long = "It's 漢字 and 42 words,\n  " * (bpe.BLOCK // 20)
    assert len(long) > bpe.BLOCK
    got = {r.doc_id: r for r in bpe.digests(frame([(1, long), (2, "a word")]), RANKS, public_tokenizers.PATTERN).collect()}
    assert got[1].decoded_sha256 == hashlib.sha256(long.encode()).hexdigest() and got[2].n_tokens == 2
    ids = encoder.encode_ordinary(long)
    assert got[1].n_tokens == len(ids) and got[1].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_words_by_class_equal_the_pattern(monkeypatch):
    draw = random.Random(4)
    signs = "  \n\t'srtvemlldé漢😀٠123!.,-\u3000\u00a0\r x\u0301\x85\x1c\u200b\u180e"
    texts = ["".join(draw.choice(signs) for _ in range(draw.randint(0, 40))) for _ in range(20_000)] + ["z" * 500]
    assert bpe.WORD_PATTERN == public_tokenizers.PATTERN
    for piece in (bpe.PIECE, 50):  # in parts, too
        monkeypatch.setattr(bpe, "PIECE", piece)
        held = bpe.Words(bpe.WORD_PATTERN)
        for text in ["".join(texts[i : i + 30]) for i in range(0, len(texts), 30)] if piece == 50 else texts:
            held.add(text)
        words, numbers, sizes = held.close()
        want = [bpe._pattern(bpe.WORD_PATTERN).findall(t) for t in (["".join(texts[i : i + 30]) for i in range(0, len(texts), 30)] if piece == 50 else texts)]
        assert sizes.tolist() == [len(w) for w in want] and [words[i].decode() for i in numbers] == [w for x in want for w in x]
        times = dict(zip(words, np.bincount(numbers).tolist()))
        assert words == sorted(words, key=lambda w: (-times[w], w))


def test_any_other_pattern_is_run_as_it_is(frame):
    (row,) = bpe.tokens(frame([(1, "ab cd  ef")]), RANKS, r".{3}|.+").collect()
    assert b"".join(dict((v, k) for k, v in RANKS.items())[i] for i in row.ids) == b"ab cd  ef"
    assert row.ids == [i for w in (b"ab ", b"cd ", b" ef") for i in bpe.merge(w, RANKS)]


def test_merging_many_words_equals_merging_each(encoder):
    draw = random.Random(9)
    words = [bytes(draw.choice(b"abcdefeeeiou nt\xc3\xa9") for _ in range(draw.randint(1, 70))) for _ in range(5000)]
    got = bpe.Merger(RANKS).encode(words)
    assert all(np.frombuffer(b, "<u4").tolist() == bpe.merge(w, RANKS) == encoder._encode_single_piece(w) for w, b in zip(words, got))
    assert len(bpe.merge(b"ab" * 100_000, RANKS)) == len(encoder._encode_single_piece(b"ab" * 100_000))


def test_bpe_refuses_ids_of_text(spark):
    with pytest.raises(TypeError):
        bpe.digests(spark.createDataFrame([("x", "t")], "doc_id string, text string"), RANKS, public_tokenizers.PATTERN)


def test_bpe_packing():
    numbers = np.array([0, 1, 255, 256, 70_000, 2**31], np.uint32)
    assert (bpe.unpack(bpe.pack(numbers)) == numbers).all() and len(bpe.unpack(bpe.pack(numbers[:0]))) == 0


def brute_repeats(rows):
    seen, out = set(), {}
    for i, t in sorted(rows):
        raw = t.encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 99):
            w = raw[p : p + 100]
            gone[p : p + 100] |= w in seen
            seen.add(w)
        runs = int((np.diff(np.append(False, gone).astype(int)) == 1).sum())
        out[i] = (len(raw), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[~gone])).hexdigest())
    return out


def repeat_rows():
    draw = random.Random(3)
    words = ["".join(draw.choice("abcdeé") for _ in range(draw.randint(2, 8))) for _ in range(60)]
    text = lambda n: " ".join(draw.choice(words) for _ in range(n))
    shared, rows = [text(60) for _ in range(6)], []
    for i in range(120):
        t, kind = text(draw.randint(0, 80)), draw.random()
        if kind < 0.5:
            for _ in range(draw.randint(1, 4)):
                s = draw.choice(shared)
                at = draw.randint(0, len(s) // 2)
                t += " " + s[at : at + draw.randint(60, 300)] + " " + text(draw.randint(0, 20))
        elif kind < 0.6:
            t = "a" * draw.randint(90, 400)
        elif kind < 0.7:
            t = "Licence text. " * draw.randint(1, 40)
        elif kind < 0.8 and rows:
            t = draw.choice(rows)[1]
        rows.append((i * 3, t))
    return rows


@pytest.mark.parametrize("group", [repeats.GROUP, 20, 3])
def test_repeats_equal_brute_force(frame, monkeypatch, group):
    monkeypatch.setattr(repeats, "GROUP", group)
    rows = repeat_rows()
    got = {r.doc_id: tuple(r)[1:] for r in repeats.removal(frame(rows)).collect()}
    assert got == brute_repeats(rows)


def test_large_groups_of_repeats_are_dealt_in_few_rows(frame, monkeypatch):
    draw = random.Random(8)
    noise = lambda n: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    passage = noise(400)
    rows = [(i, noise(80) + passage[draw.randint(0, 40) : 400 - draw.randint(0, 40)] + noise(80)) for i in range(300)]
    rows += [(300 + i, passage[: (at := draw.randint(100, 300))] + "#" + passage[at + 1 :]) for i in range(100)]
    made, put = {"contexts": [], "halves": []}, repeats.stored

    def counted(df, name):
        out = put(df, name)
        made.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(repeats, "GROUP", 30)
    monkeypatch.setattr(repeats, "stored", counted)
    got = {r.doc_id: tuple(r)[1:] for r in repeats.removal(frame(rows)).collect()}
    assert got == brute_repeats(rows)
    assert made["halves"] and sum(made["halves"]) < 6 * sum(made["contexts"]), made


def test_repeats_in_texts_of_several_slices(frame, monkeypatch):
    cloudpickle.register_pickle_by_value(repeats)  # workers get the patched module
    try:
        monkeypatch.setattr(repeats, "SLICE", 150)
        draw = random.Random(6)
        noise = lambda n: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
        passages = [noise(130) for _ in range(60)]
        long = "".join(p + noise(draw.randint(30, 200)) for p in passages)
        rows = [*repeat_rows(), (1000, long), *((2000 + k, noise(50) + p + noise(50)) for k, p in enumerate(passages))]
        got = {r.doc_id: tuple(r)[1:] for r in repeats.removal(frame(rows)).collect()}
    finally:
        cloudpickle.unregister_pickle_by_value(repeats)
    assert got == brute_repeats(rows)


def test_repeats_odd_rows(frame, odd_rows):
    got = repeats.removal(frame(odd_rows)).collect()
    want = brute_repeats([(i, t or "") for i, t in dict(odd_rows).items() if i is not None])
    assert len(got) == len(odd_rows)
    assert all(tuple(r)[1:] == want[r.doc_id] for r in got if r.doc_id is not None)
    kept = repeats.without_repeats(frame(odd_rows))
    assert kept.count() == len(odd_rows) and kept.columns == frame(odd_rows).columns
    assert repeats.removal(frame(odd_rows).limit(0)).count() == 0


def test_maximal_repeats_name_every_occurrence():
    rows = [(b"cba", b"xyz1"), (b"cbd", b"xyz1"), (b"qqq", b"xyz2")]
    found = {(left, right, tuple(sorted(m))) for left, right, m in repeats.maximal_repeats(rows, 3)}
    assert (0, 3, (0, 1, 2)) in found and (2, 4, (0, 1)) in found


def near_rows():
    draw = random.Random(5)
    words = ["".join(draw.choice("abcdefgh") for _ in range(5)) for _ in range(900)]
    rows, at = [], 0
    for group in range(25):
        base = [draw.choice(words) for _ in range(draw.choice([8, 60, 200]))]
        for _ in range(draw.choice([1, 2, 6, 20])):
            w = list(base)
            for _ in range(draw.choice([0, 0, 1, 1, 2, 12])):
                w[draw.randrange(len(w))] = draw.choice(words)
            rows.append((at, " ".join(w)))
            at += 1
    draw.shuffle(rows)
    return rows


def brute_classes(rows):
    sets = [(i, set(nearcopies.regions(next(w for _, w in nearcopies.words_by_text([t.encode()], nearcopies.SPACED))).tolist()), t) for i, t in sorted(rows)]
    root = {i: i for i, _, _ in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, s, t) in enumerate(sets):
        for j, u, v in sets[:k]:
            if t == v or s and u and len(s & u) >= 0.8 * len(s | u):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i: top(i) for i, _, _ in sets}


def test_near_copies_equal_brute_force(frame):
    rows = near_rows()
    got = {r.doc_id: r.class_id for r in nearcopies.classes(frame(rows)).collect()}
    assert got == brute_classes(rows)
    kept = nearcopies.one_of_each(frame(rows))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(got.values())) and kept.columns == frame(rows).columns


def family_rows(members, pairs, seed=8):
    """Texts of one template, about 0.78 alike, among them pairs of about 0.82."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(7))
    template, texts = [word() for _ in range(400)], []
    own = lambda n: [word() for _ in range(n)]
    for _ in range(members):
        texts.append(template + own(56))
    for _ in range(pairs):
        common = own(10)
        texts += [template + common + own(46), template + common + own(46)]
    draw.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def test_near_copies_within_a_family_just_too_unlike(frame, monkeypatch):
    monkeypatch.setattr(nearcopies, "BLOCK", 40)
    rows = family_rows(150, 40)
    want = brute_classes(rows)
    assert len(set(want.values())) == 150 + 40
    assert {r.doc_id: r.class_id for r in nearcopies.classes(frame(rows)).collect()} == want


def test_near_copies_of_an_id_with_two_texts(frame):
    draw = random.Random(11)
    first, second = (" ".join("".join(draw.choice("abcdefghij") for _ in range(6)) for _ in range(150)) for _ in range(2))
    rows = [(1, first), (2, second + " ends here"), (3, first), (3, second), (4, first), (4, first), (5, "apart from all the others")]
    got = [(r.doc_id, r.class_id) for r in nearcopies.classes(frame(rows)).collect()]
    assert sorted(got) == [(1, 1), (2, 1), (3, 1), (3, 1), (4, 1), (4, 1), (5, 5)]


def test_near_copies_odd_rows(frame, odd_rows):
    got = nearcopies.classes(frame(odd_rows)).collect()
    assert len(got) == len(odd_rows)
    label = {r.doc_id: r.class_id for r in got}
    assert label[5] == label[6] == label[7] == 5 and label[1] == label[2] == 1 and label[None] is None and label[8] == 8
    assert nearcopies.classes(frame(odd_rows).limit(0)).count() == 0


def test_signatures_estimate_similarity():
    a, b = np.arange(1000, dtype=np.uint64), np.arange(200, 1200, dtype=np.uint64)
    x, y = nearcopies.signatures([nearcopies.mix(a), nearcopies.mix(b)])
    assert abs((x == y).mean() - 800 / 1200) < 0.15
    assert (nearcopies.signatures([nearcopies.mix(b), nearcopies.mix(a)])[1] == x).all()


def test_leaks(spark, frame):
    draw = random.Random(2)
    words = ["".join(draw.choice("abcdefghij") for _ in range(4)) for _ in range(400)]
    text = lambda n: " ".join(draw.choice(words) for _ in range(n))
    items = [(k, f"{text(draw.randint(6, 40))}. {text(draw.randint(5, 12))}.") for k in range(60)] + [(60, ""), (61, None), (62, "tiny item")]
    rows, want = [], set()
    for i in range(200):
        t = text(draw.randint(0, 400))
        if i % 5 == 0:
            k = draw.randrange(60)
            t = f"{t} {items[k][1].upper() if i % 10 == 0 else items[k][1]} {text(draw.randint(0, 300))}"
            want.add((i, k))
        elif i % 5 == 1:  # the question without the answer
            t += " " + items[draw.randrange(60)][1].split(".")[0]
        rows.append((i, t))
    rows += [(900, None), (901, "")]
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("term", spark.range(1).selectExpr("1").first()[0] * __import__("pyspark").sql.functions.lit(1))
    got = leaks.find_leaks(frame(rows), table).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    clean = leaks.without_leaks(frame(rows), table)
    assert {r.doc_id for r in clean.collect()} == {i for i, _ in rows} - {d for d, _ in want}
    assert leaks.find_leaks(frame(rows), table.limit(0)).count() == 0


def test_leaks_in_several_index_blocks(spark, frame, monkeypatch):
    monkeypatch.setattr(leaks, "INDEX_BYTES", 60)
    items = spark.createDataFrame([(k, f"alpha{k} beta{k} gamma{k} delta{k} epsilon{k} zeta{k} eta{k}") for k in range(6)], "item_id long, text string")
    rows = [(k, f"some words alpha{k} beta{k} gamma{k} delta{k} epsilon{k} zeta{k} eta{k} and more") for k in range(6)] + [(9, "clean")]
    assert {(r.doc_id, r.item_id) for r in leaks.find_leaks(frame(rows), items).collect()} == {(k, k) for k in range(6)}
    assert [r.doc_id for r in leaks.without_leaks(frame(rows), items).collect()] == [9]


def test_pivot_search_equals_scoring_everything():
    draw = np.random.default_rng(4)
    words = [f"w{i}" for i in range(80)]
    rows = [(k, " ".join(draw.choice(words, draw.integers(3, 15)))) for k in range(50)]
    hashed = {i: w for i, w in leaks.words_by_text([t.encode() for _, t in rows], leaks.ALNUM)}
    df = collections.Counter(int(x) for w in hashed.values() for x in np.unique(w).astype(np.int64))
    ix = leaks.build(rows, df, len(rows), np.mean([len(w) for w in hashed.values()]), 15)
    for threshold in (0.3, 0.6, 0.9):
        for _ in range(60):
            terms = np.sort(draw.choice(len(ix.vocabulary), 25, replace=False))
            score = np.zeros(len(rows))
            for t in terms:
                score[ix.item[ix.first[t] : ix.first[t + 1]]] += ix.share[ix.first[t] : ix.first[t + 1]]
            assert {i for i, _ in leaks.pivot_search(ix, terms, threshold)} == set(np.flatnonzero(score >= threshold - leaks.SLACK))


@pytest.mark.parametrize("n", [1, 2, 5, 40, 1000, 4097])
def test_permutation(n):
    p = shards.permute(np.arange(n), n, 7)
    assert sorted(p) == list(range(n)) and (shards.permute(p, n, 7, forward=False) == np.arange(n)).all()


def test_shards(frame, odd_rows):
    import zlib

    got = shards.assign(frame(odd_rows), 4).collect()
    sizes = collections.Counter(r.shard for r in got)
    assert len(got) == len(odd_rows) and max(sizes.values()) - min(sizes.values()) <= 1
    for k, n in sizes.items():
        assert sorted(r.slot for r in got if r.shard == k) == list(range(n))
    texts = dict(odd_rows)
    assert all((r.size, r.text_crc32) == (len((texts[r.doc_id] or "").encode()) + 16, zlib.crc32((texts[r.doc_id] or "").encode())) for r in got)
    again = shards.assign(frame(odd_rows).repartition(5), 4).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    for r in got:
        place = int(shards.permute(np.array([r.row_no]), len(got), 2024)[0])
        assert (place % 4, place // 4) == (r.shard, r.slot)
    assert shards.assign(frame(odd_rows).limit(0)).count() == 0


def test_merge_by_rank():
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"aab": 259}
    assert bpe.merge(b"abc", ranks) == [258] and bpe.merge(b"xabcd", ranks) == [120, 258, 100] and bpe.merge(b"aabb", ranks) == [259, 98]
    assert base64.b64encode(b"ab") == b"YWI="
