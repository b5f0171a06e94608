"""Documents linked by the Jaccard similarity of their word n-grams, found by a join of parity sketches.

A document's set holds the hashes of its distinct three-word shingles: words between ASCII white space, A to Z
lowered; of fewer words the whole sequence is one. Two documents link if 100 |A and B| >= PERCENT |A or B|. A set
without words is empty and links with nothing.

Sketch. Sets that link are nearly of one size, so sizes are parted into bands, each the sizes up to one and a half
times its first. A set is sketched for its own band, and for the next if it is near enough to it to link with one of
that; pairs meet in the band of the larger. There
at most D = (100 - PERCENT) (|A| + |B|) / (100 + PERCENT) shingles are in one set alone. A sketch has D + 1
segments of BITS bits; every shingle flips one bit. Two sketches differ in no more bits than there are shingles in
one set alone, so those of a linked pair are equal in a segment at least. Segments are joined by the hash of their
bits, which is their XOR-sum of a hash for each bit that is set: no link is missed, whatever the data.

Sets that are equal are one class from the start, by digest and size; one of a class is sketched. In each
segment's bucket every member is paired with the least one. A pair is dropped if whole sketches of one segment, of at
least twice as many bits as a set has shingles, are farther apart than a link allows; the rest is verified with
the sets themselves: first one pair for each member, with the partner of most segments, then those that would still
join two groups. What is left are buckets whose members are of unlike groups: there sketches are compared in cells of two
blocks of BLOCK members, so that no pair that shares a bucket is left out; a pair that is near enough goes on to be
verified, once for all its buckets. Members of one group are not compared with each other again. Only sets of such
pairs are ever moved. Components follow by rounds of joins.

Null texts have no words. Rows that share a doc_id are one document with the links of all their texts. A null doc_id
has a null component; ids are integers. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytehash import mix, words_by_text
from .leaks import shingles
from .nearcopies import components
from .storage import integer_id, stored

WORDS, PERCENT, BITS, BLOCK, BLOCK_WORDS, SLICE = 3, 90, 1024, 512, 1 << 18, 256


def _spaced() -> np.ndarray:
    """Byte to byte, A to Z lowered; 0 parts words. No UTF-8 text holds the byte that stands for a NUL."""
    table = np.arange(256, dtype=np.uint8)
    table[ord("A") : ord("Z") + 1] += 32
    table[0] = 255
    table[[9, 10, 11, 12, 13, 32]] = 0
    return table


PARTS = _spaced()


def shingle_set(words: np.ndarray, n: int = WORDS) -> np.ndarray:
    """Sorted hashes of the distinct shingles."""
    return np.unique(shingles(words, n))


def most_apart(sizes: int, percent: int = PERCENT) -> int:
    """How many shingles can be in one set alone if sets of so many shingles in sum link."""
    return (100 - percent) * sizes // (100 + percent)


def band_starts(largest: int, percent: int = PERCENT) -> np.ndarray:
    """The first size of each band; two sets that link are of one band or of neighbours."""
    starts = [1]
    while starts[-1] <= largest:
        starts.append(max(100 * starts[-1] // percent + 1, 3 * starts[-1] // 2))
    return np.array(starts, np.int64)


def segment_keys(held: np.ndarray, band: int, starts: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """A key per segment of a set's sketch for the pairs whose larger set is of this band."""
    segments = most_apart(2 * (int(starts[band + 1]) - 1), percent) + 1
    high = held >> np.uint64(32)
    place = (high * np.uint64(segments)) >> np.uint64(32)  # held is sorted, so segments follow each other
    bit = mix(place * np.uint64(BITS) + mix(held) % np.uint64(BITS))
    first = np.flatnonzero(np.diff(place, prepend=np.uint64(segments)))
    parity = np.zeros(segments, np.uint64)
    parity[place[first].astype(np.int64)] = np.bitwise_xor.reduceat(bit, first)
    return mix(parity + mix(np.arange(segments, dtype=np.uint64) + (np.uint64(band) << np.uint64(32)))).astype(np.int64)


def whole_sketch(held: np.ndarray) -> np.ndarray:
    """Parity of the shingles that fall on each of a power of two of bits, as longs."""
    width = 1 << max(6, (2 * len(held) - 1).bit_length())
    return np.packbits(np.bincount((held & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1).view(np.int64)


def _sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    for at in range(0, len(column), SLICE):
        for i, w in words_by_text([(t or "").encode() for t in column.slice(at, SLICE).to_pylist()], PARTS):
            yield at + i, shingle_set(w)


def described(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """id, n_shingles, digest, own and upper keys, and the whole sketch (bits) of each row (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = band_starts(1 << 40, percent)
        kind = pa.list_(pa.int64())
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                n, digest, own, upper, bits = [], [], [], [], []
                for _, held in _sets(part.column(1)):
                    n.append(len(held))
                    digest.append(hashlib.md5(held.tobytes()).digest())
                    band = int(np.searchsorted(starts, len(held), side="right")) - 1
                    own.append(segment_keys(held, band, starts, percent) if len(held) else None)
                    reaches = 100 * len(held) >= percent * int(starts[band + 1])
                    upper.append(segment_keys(held, band + 1, starts, percent) if len(held) and reaches else None)
                    bits.append(whole_sketch(held) if len(held) else None)
                columns = [part.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), *(pa.array(c, kind) for c in (own, upper, bits))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n_shingles", "digest", "own", "upper", "bits"])

    return rows.select("id", "text").mapInArrow(run, "id long, n_shingles long, digest binary, own array<long>, upper array<long>, bits array<long>")


def _set_rows(rows: DataFrame) -> DataFrame:
    """id, held: each row's set as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for _, s in _sets(part.column(1))], pa.binary())], names=["id", "held"])

    return rows.select("id", "text").mapInArrow(run, "id long, held binary")


def linked(p: np.ndarray, q: np.ndarray, percent: int = PERCENT) -> bool:
    both = len(np.intersect1d(p, q, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(p) + len(q) - both)


def sketch_distance(a: Column, b: Column) -> Column:
    """Unlike bits of two whole sketches; the wider one is folded first."""
    n = F.least(F.size(a), F.size(b))
    folded = lambda c: F.when(F.size(c) > n, F.zip_with(F.slice(c, 1, n), F.slice(c, n + 1, n), lambda x, y: x.bitwiseXOR(y))).otherwise(c)
    return F.aggregate(F.zip_with(folded(a), folded(b), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, v: s + v)


def _near(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sketches are no farther apart than a link allows. rows: id, n_shingles, bits."""
    side = lambda c: rows.select(F.col("id").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    close = sketch_distance(F.col("bits_a"), F.col("bits_b")) * (100 + percent) <= (F.col("n_a") + F.col("n_b")) * (100 - percent)
    return both.where(close).select("a", "b").distinct()


def _verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link, stored; sets are made anew of the texts in question."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [linked(np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8"), percent) for x, y in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs = stored(pairs, "near-pairs")
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    sets = stored(_set_rows(texts.join(ids, "id", "left_semi")), "sets")
    one = sets.select(F.col("id").alias("b"), F.col("held").alias("y"))
    other = sets.select(F.col("id").alias("a"), F.col("held").alias("x"))
    return stored(pairs.join(one, "b").join(other, "a").select("a", "b", "x", "y").mapInArrow(run, "a long, b long").distinct(), "links")


def cell_pairs(ids: np.ndarray, label: np.ndarray, side: np.ndarray, sizes: np.ndarray, sketches: list[np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """Pairs of ids of unlike labels whose sketches are near enough: one of each side, or any two where all are of one side."""
    if (label == label[0]).all():
        return np.zeros((0, 2), np.int64)
    least = min(map(len, sketches))
    bits = np.zeros((len(sketches), 64 * least), np.float32)
    for k, s in enumerate(sketches):
        bits[k] = np.unpackbits(np.bitwise_xor.reduce(s.reshape(-1, least), axis=0).view(np.uint8))
    ones = bits.sum(axis=1)
    i, j = np.flatnonzero(side == side.min()), np.flatnonzero(side == side.max())
    apart = ones[i][:, None] + ones[j] - 2 * (bits[i] @ bits[j].T)
    near = apart * (100 + percent) <= (100 - percent) * (sizes[i][:, None] + sizes[j])
    x, y = np.nonzero(near & (label[i][:, None] != label[j]))
    x, y = ids[i[x]], ids[j[y]]
    return np.unique(np.column_stack([np.minimum(x, y), np.maximum(x, y)]), axis=0)


def _mixed_pairs(members: DataFrame, rows: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """a, b of unlike groups that share a bucket (key; members id) and whose sketches are near."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, cell = None, []

        def close() -> pa.RecordBatch:
            ids, label, side, sizes, sketches = zip(*cell)
            found = cell_pairs(*(np.array(c, np.int64) for c in (ids, label, side, sizes)), [np.array(s, np.int64) for s in sketches], percent)
            return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

        for batch in batches:
            for key, i, j, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                if at != (key, i, j):
                    if cell:
                        yield close()
                    at, cell = (key, i, j), []
                cell.append(rest)
        if cell:
            yield close()

    labelled = members.select("key", "id").join(groups, "id", "left").select("key", "id", F.coalesce("label", "id").alias("label"))
    mixed = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
    unlike = stored(labelled.join(mixed, "key").join(rows.select("id", "n_shingles", "bits"), "id"), "unlike")
    blocks = unlike.groupBy("key").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(F.size("bits")) / BLOCK_WORDS)).alias("blocks"))
    cells = (
        unlike.join(blocks, "key").withColumn("p", F.pmod(F.xxhash64("id"), "blocks")).withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select("key", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"), "id", "label", (F.col("p") > F.col("q")).cast("int").alias("side"), "n_shingles", "bits")
    )
    return cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a long, b long").distinct()


def component_ids(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links reach) of every row."""
    texts = docs.select(integer_id(docs, "doc_id").alias("id"), "text")
    rows = stored(described(texts, percent), "sketches")
    filled = rows.where("id IS NOT NULL AND n_shingles > 0")
    copies = filled.groupBy("digest", "n_shingles").agg(F.min("id").alias("rep"), F.count("*").alias("times")).where("times > 1").drop("times")
    later = stored(filled.select("id", "digest", "n_shingles").join(copies, ["digest", "n_shingles"]).where("id <> rep").select("id", "digest", "rep").distinct(), "copies")
    # what is joined here grows with the documents, so it is never sent to all executors, however few there are
    single = filled.join(later.select("id", "digest").hint("shuffle_merge"), ["id", "digest"], "left_anti")
    segments = single.select("id", F.explode(F.concat("own", F.coalesce("upper", F.array().cast("array<long>")))).alias("key"))
    least = segments.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a <> z").select("key", "a")
    members = stored(segments.join(least.hint("shuffle_merge"), "key").where("id <> a"), "members")
    edges = stored(members.groupBy("a", F.col("id").alias("b")).agg(F.count("*").alias("n")), "edges")
    edges = stored(edges.join(_near(edges, single, percent), ["a", "b"]), "near-edges")
    first = edges.groupBy("b").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a")).select("a", "b")
    found = _verified(first, texts, percent)
    groups = components(found)
    side = lambda c: groups.select(F.col("id").alias(c), F.col("label").alias(f"{c}_label"))
    rest = (
        edges.join(first, ["a", "b"], "left_anti").join(side("a"), "a", "left").join(side("b"), "b", "left")
        .where(F.coalesce("a_label", "a") != F.coalesce("b_label", "b")).select("a", "b")
    )
    found = found.union(_verified(rest, texts, percent))
    mixed = _verified(_mixed_pairs(members, single, components(found), percent), texts, percent)
    links = found.union(mixed).union(later.select(F.col("rep").alias("a"), F.col("id").alias("b")))
    groups = components(links).select(F.col("id"), F.col("label"))
    return (
        rows.select("id", "n_shingles").join(groups, "id", "left")
        .select(F.col("id").alias("doc_id"), "n_shingles", F.coalesce("label", "id").alias("component_id"))
    )
