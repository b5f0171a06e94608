"""Near-duplicate documents by DartMinHash.

A document is the weighted set of its five-word shingles (words parted by white space, ASCII lowered; a
shorter text is one shingle): a shingle that occurs c times weighs 1 + floor(log2 c). Two texts are linked
if their weighted Jaccard similarity, sum of minima over sum of maxima, is 0.8 or more.

Signature. Each unit of a shingle's weight is a region. Into each region falls a Poisson process of darts
in time, whose arrival times, coordinates and marks are hashes of region and dart number alone; a document
sees the darts of its regions. Every one of K coordinates keeps its earliest dart. Darts are thrown until
time K (ln K + 4) / weight, about that many in all whatever the weight, and longer in the few documents
where a coordinate is still empty. Coordinates agree with the chance of the similarity. BANDS bands of
ROWS coordinates find a pair of similarity 0.8 with chance 1 - (1 - 0.8**5)**25 = 0.99995.

Groups. Equal texts are one class from the start, by MD5 and length. In each band every class is paired
with the least of its bucket. Pairs are checked against the shingles themselves: first one for each class,
with the partner of most bands; then, after the links found are followed, those pairs that would still join
two groups. Groups are the connected components of the verified links.

Where a bucket's members, its least aside, are still of unlike groups, all of them are compared with each
other: in blocks of BLOCK members or BLOCK_BYTES of regions, each pair of blocks in a cell of its own, overlaps
counted by matrix products. So every pair that shares a bucket is checked or in one group already. Cells
grow with the square of such a bucket, and go to as many tasks. Tests hold groups against brute force.

Null texts are empty; texts without words are copies of equal texts only. Rows that share a doc_id are one
document with all their texts. A null doc_id has a null class; ids are integers. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

from .bytehash import SPACED, mix, words_by_text
from .leaks import shingles
from .storage import free_name, integer_id, stored

BANDS, ROWS, SIMILARITY = 25, 5, 0.8
K = BANDS * ROWS
BLOCK, BLOCK_BYTES, COLUMNS = 512, 4 << 20, 2048


def regions(w: np.ndarray) -> np.ndarray:
    """A hash per unit of weight, sorted. The similarity of two documents is the Jaccard similarity of these sets."""
    s, times = np.unique(shingles(w), return_counts=True)
    weight = np.frexp(times.astype(float))[1]
    level = np.arange(weight.sum()) - np.repeat(np.cumsum(weight) - weight, weight)
    return np.sort(mix(np.repeat(s, weight) + level.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """K marks for each document's regions, all documents at once; of no regions, zeros."""
    sizes = np.array([len(x) for x in sets])
    marks, todo = np.zeros((len(sets), K), np.uint64), np.flatnonzero(sizes)
    end = K * (np.log(K) + 4) / np.maximum(sizes, 1)
    while len(todo):
        ids, owner = np.concatenate([sets[i] for i in todo]), np.repeat(np.arange(len(todo)), sizes[todo])
        at, stop, dart, darts = np.zeros(len(ids)), end[todo][owner], 0, []
        while len(ids):
            dart += 1
            h = mix(ids + np.uint64(dart * 0x9E3779B97F4A7C15 % (1 << 64)))
            at = at - np.log(((h >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53)
            early = np.flatnonzero(at < stop)
            ids, at, stop, owner, h = ids[early], at[early], stop[early], owner[early], mix(h[early])
            darts.append((owner * K + (h % np.uint64(K)).astype(np.int64), at, h))
        cell, at, h = (np.concatenate(x) for x in zip(*darts))
        best, mark = np.full(len(todo) * K, np.inf), np.zeros(len(todo) * K, np.uint64)
        np.minimum.at(best, cell, at)
        first = at == best[cell]
        np.maximum.at(mark, cell[first], h[first])
        full = np.isfinite(best).reshape(-1, K).all(axis=1)
        marks[todo[full]] = mark.reshape(-1, K)[full]
        todo = todo[~full]
        end[todo] *= 2
    return marks


def signature(region: np.ndarray) -> np.ndarray:
    """K marks; of no regions, none."""
    return signatures([region])[0] if len(region) else np.zeros(0, np.uint64)


def band_keys(marks: np.ndarray) -> np.ndarray:
    """Of each row of marks a key per band, band number included."""
    rows = marks.reshape(-1, BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), rows.shape[:2])
    for k in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, k])
    return key.astype(np.int64)


def _bytes(column: pa.Array) -> list[bytes]:
    return [(t or "").encode() for t in column.to_pylist()]


def _band_rows(texts: DataFrame) -> DataFrame:
    """id, band: a row per document and band."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                sets = [regions(w) for _, w in words_by_text(_bytes(part.column(1)), SPACED)]
                some = np.flatnonzero([len(x) for x in sets])
                keys = band_keys(signatures([sets[i] for i in some]))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(np.repeat(some, BANDS))), pa.array(keys.ravel())], names=["id", "band"])

    return texts.select("id", "text").mapInArrow(rows, "id long, band long")


def _region_rows(texts: DataFrame) -> DataFrame:
    """id, regions: each document's region hashes, cut to 32 bits, as bytes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                held = [np.unique((regions(w) >> np.uint64(32)).astype("<u4")).tobytes() for _, w in words_by_text(_bytes(part.column(1)), SPACED)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(held, pa.binary())], names=["id", "regions"])

    return texts.select("id", "text").mapInArrow(rows, "id long, regions binary")


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                p, q = np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")
                both = len(p) + len(q) - len(np.union1d(p, q))
                keep.append(both >= similarity * (len(p) + len(q) - both) - 1e-9)
            chosen = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"])
            yield chosen.filter(pa.array(keep, pa.bool_()))

    one = sets.select(F.col("id").alias("b"), F.col("regions").alias("y"))
    other = sets.select(F.col("id").alias("a"), F.col("regions").alias("x"))
    return pairs.join(one, "b").join(other, "a").select("a", "b", "x", "y").mapInArrow(rows, "a long, b long").distinct()


def linked_labels(label: np.ndarray, held: list[np.ndarray], side: np.ndarray, similarity: float) -> set[tuple[int, int]]:
    """Pairs of unlike labels that a similar pair of sets joins: one of each side, or any two where all are of one side."""
    if (label == label[0]).all():
        return set()
    a = np.flatnonzero(side == side.min())
    b = np.flatnonzero(side == side.max())
    sizes = np.array([len(x) for x in held])
    token, column = np.unique(np.concatenate(held), return_inverse=True)
    owner = np.repeat(np.arange(len(held)), sizes)
    in_a, in_b = (np.bincount(column[side[owner] == x], minlength=len(token)) for x in (side.min(), side.max()))
    shared = (in_a > 0) & (in_b > 0) & ((in_a > 1) | (len(a) < len(held)))
    number = np.cumsum(shared) - 1
    use = shared[column]
    owner, column = owner[use], number[column[use]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((len(a), len(b)), np.float32)
    for at in range(0, int(shared.sum()), COLUMNS):
        lo, hi = np.searchsorted(column, [at, at + COLUMNS])
        x = np.zeros((len(held), COLUMNS), np.float32)
        x[owner[lo:hi], column[lo:hi] - at] = 1
        both += x[a] @ x[b].T
    both = both.astype(float)
    near = both >= similarity * (sizes[a][:, None] + sizes[b] - both) - 1e-9
    i, j = np.nonzero(near & (label[a][:, None] != label[b]))
    p, q = label[a][i], label[b][j]
    return set(zip(np.minimum(p, q).tolist(), np.maximum(p, q).tolist()))


def _joined_labels(members: DataFrame, sets: DataFrame, groups: DataFrame, similarity: float) -> DataFrame:
    """a, b: labels of groups joined by a similar pair of one bucket, of buckets whose members (band, id) are of unlike groups."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, cell = None, []

        def close() -> pa.RecordBatch:
            found = linked_labels(
                np.array([c[0] for c in cell], np.int64), [np.frombuffer(c[2], "<u4") for c in cell], np.array([c[1] for c in cell]), similarity
            )
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for band, i, j, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                if key != (band, i, j):
                    if cell:
                        yield close()
                    key, cell = (band, i, j), []
                cell.append(rest)
        if cell:
            yield close()

    labelled = members.select("band", "id").distinct().join(groups, "id", "left").select("band", "id", F.coalesce("label", "id").alias("label"))
    mixed = labelled.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("band")
    unlike = stored(
        labelled.join(mixed, "band").join(sets.groupBy("id").agg(F.sum(F.octet_length("regions")).alias("size")), "id"), "unlike"
    )
    blocks = unlike.groupBy("band").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / BLOCK_BYTES)).alias("blocks"))
    own = F.pmod(F.xxhash64("id"), F.greatest("blocks", F.lit(1)))
    cells = (
        unlike.join(blocks, "band").select("band", "id", "label", own.alias("p"), F.explode(F.sequence(F.lit(0).cast("long"), F.greatest("blocks", F.lit(1)) - 1)).alias("q"))
        .select("band", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"), "label", F.when(F.col("p") > F.col("q"), 1).otherwise(0).alias("side"), "id")
    )
    return (
        cells.join(sets.select("id", "regions"), "id").select("band", "i", "j", "label", "side", "regions")
        .repartition("band", "i", "j").sortWithinPartitions("band", "i", "j").mapInArrow(rows, "a long, b long").distinct()
    )


def components(links: DataFrame) -> DataFrame:
    """id, label: of each linked id, the least id it is connected to.

    Each round takes the least label of the neighbours and then the label's own label, so paths shorten
    by half; rounds end when no label moves. Nothing is gathered per node: minima are combined.
    """
    both = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("label").alias("m"))
        moved = labels.join(near.withColumnRenamed("a", "id"), "id").select("id", "label", F.least("label", "m").alias("m"))
        roots = moved.select(F.col("id").alias("m"), F.col("m").alias("root"))
        new = stored(moved.join(roots, "m", "left").select("id", F.col("label").alias("old"), F.least("m", F.coalesce("root", "m")).alias("label")), "labels")
        if not new.where("old <> label").head(1):
            return new.select("id", "label")
        labels = new.select("id", "label")


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id (the least doc_id of its group), copy_of (the least doc_id with its text) of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(integer_id(docs, "doc_id").alias("id"), text.alias("text"))
    digests = stored(rows.select("id", F.unhex(F.md5(F.encode("text", "UTF-8"))).alias("digest"), F.octet_length("text").alias("n")), "digests")
    copies = digests.groupBy("digest", "n").agg(F.min("id").alias("rep"), F.count("*").alias("times")).where(F.col("rep").isNotNull())
    # every text outside `repeated` stands alone, so only texts that occur twice are joined
    repeated = stored(digests.join(copies.where("times > 1").drop("times"), ["digest", "n"]).select("id", "rep"), "copies").where("id is not null")
    later = repeated.where("id <> rep").distinct()
    copied = repeated.where("id <> rep").groupBy("id").agg(F.count("*").alias("copied"))
    # its least copy stands for an id, unless the id has another text too
    covered = digests.select("id").join(copied, "id").groupBy("id").agg(F.count("*").alias("rows"), F.max("copied").alias("copied")).where("rows = copied").select("id")
    bands = stored(_band_rows(rows.where("id is not null")), "bands").join(covered, "id", "left_anti")
    least = bands.groupBy("band").agg(F.min("id").alias("a"), F.count("*").alias("times")).where("times > 1").drop("times")
    members = stored(bands.join(least, "band").where("id <> a"), "members")
    edges = stored(members.groupBy("a", F.col("id").alias("b")).agg(F.count("*").alias("n")), "edges")
    near = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()
    sets = stored(_region_rows(rows.join(near, "id", "left_semi")), "regions")
    first = edges.groupBy("b").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a")).select("a", "b")
    found = stored(_similar(first, sets, similarity), "links")
    groups = components(found)
    side = lambda c: groups.select(F.col("id").alias(c), F.col("label").alias(f"{c}_label"))
    rest = (
        edges.join(first, ["a", "b"], "left_anti").join(side("a"), "a", "left").join(side("b"), "b", "left")
        .where(F.coalesce("a_label", "a") != F.coalesce("b_label", "b")).select("a", "b")
    )
    joined = _joined_labels(members, sets, groups, similarity)
    links = found.union(_similar(rest, sets, similarity)).union(joined).union(later.select(F.col("rep").alias("a"), F.col("id").alias("b")))
    groups = components(links).select(F.col("id").alias("doc_id"), F.col("label"))
    firsts = later.groupBy(F.col("id").alias("doc_id")).agg(F.min("rep").alias("first"))
    return (
        docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(groups, "doc_id", "left").join(firsts, "doc_id", "left")
        .select("doc_id", F.coalesce("label", "doc_id").alias("class_id"), F.coalesce("first", "doc_id").alias("copy_of"))
    )


def sortable(kind: DataType) -> bool:
    if isinstance(kind, StructType):
        return all(sortable(f.dataType) for f in kind.fields)
    return sortable(kind.elementType) if isinstance(kind, ArrayType) else not isinstance(kind, (MapType, VariantType))


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The document of least doc_id of each group, one row of it (the least, if it has more). Rows without an id stay.

    Columns that have no order, such as maps, are compared as JSON.
    """
    name, row = free_name(docs, "_kept"), free_name(docs, "_row")
    kept = classes(docs, similarity).where(F.col("doc_id") == F.col("class_id")).select(F.col("doc_id").alias(name)).distinct()
    rest = [c for c in docs.columns if c != "doc_id"]
    plain = [c if sortable(docs.schema[c].dataType) else F.to_json(F.struct(c)) for c in rest]
    least = F.min(F.struct(*rest)) if all(isinstance(c, str) for c in plain) else F.min_by(F.struct(*rest), F.struct(*plain))
    chosen = docs.join(kept, docs["doc_id"] == kept[name]).groupBy("doc_id").agg(least.alias(row))
    return chosen.select("doc_id", f"{row}.*").select(*docs.columns).unionByName(docs.where("doc_id is null"))
