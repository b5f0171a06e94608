"""How far the sources of a language differ in their words, priced on hash-consed segment trees.

Null text, lang and source are ''. Terms are stretches of letters A to Z, which are lowered, and of all characters
beyond ASCII. A language keeps the V terms of at least MIN_DOCS of its documents. A group (lang, source), and the
language as a whole, gives a kept term of `count` occurrences p = 1 + floor(SCALE (count + 1) / (N + V)), N its
count over all kept terms. The divergence of p from q at a term is f = floor((p - q)^2 / q). All arithmetic is exact.

Term ids. The kept terms of a language are dealt to blocks of about WIDTH by a hash and numbered in a block by
falling frequency: no table is sorted as a whole, all blocks are alike in size and mix, and rare terms, whose counts
repeat, are neighbours. A group's segment tree has the blocks as its upper level, added up by Spark; a block of all
sources is one group of Arrow rows.

Trees. A node is a pair of child nodes, a leaf a count. Equal pairs are one node: level by level, over all
sources of the block, pairs get the number of their kind, so equal subtrees are shared, all-zero ones above all.
Two trees are gone through together from the top: on each level the pairs of nodes that occur are kept once for
each pair of groups, down to the pairs of counts, which are priced; prices are then added on the way up. So a
pair of nodes is priced once, however often it occurs in the two trees. Both directions are priced together.

Where a language has more than SOURCES sources, they are parted in chunks and a block is one task for each two
chunks, so a task holds at most 2 SOURCES WIDTH counts, about. A pair of sources is a row of the result, so rows
grow with their square by definition. The best terms of a group are ranked with Spark's limit before the shuffle.

Documents without terms count for no term; their group gets a row for each other source of its language (0 if
V is 0). Repeated rows are documents of their own. Other columns, doc_id too, are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored

SCALE, MIN_DOCS, TOP, WIDTH, SOURCES, HELD = 10**9, 3, 200, 2048, 128, 1 << 18
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TERMS).split()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with it)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = {}
        size = 0

        def out() -> pa.RecordBatch:
            lang, source, term, n, docs = [], [], [], [], []
            for (a, b), (times, texts) in held.items():
                lang += [a] * len(times)
                source += [b] * len(times)
                term += [t.decode() for t in times]
                n += times.values()
                docs += [texts[t] for t in times]
            return pa.RecordBatch.from_arrays(
                [pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(term, pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())],
                names=["lang", "source", "term", "n", "docs"],
            )

        for batch in batches:
            for lang, source, text in zip(*batch.columns):
                times, texts = held.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
                size -= len(times)
                found = terms(text.as_py())
                times.update(found)
                texts.update(set(found))
                size += len(times)
                if size >= HELD:
                    yield out()
                    held.clear()
                    size = 0
        if size:
            yield out()

    named = docs.select(_name("lang"), _name("source"), "text")
    partial = named.mapInArrow(rows, "lang string, source string, term string, n long, docs long")
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _name(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("")).alias(column)


def share(count: Column, total: Column, kept: Column) -> Column:
    """p; decimals, as the product may be beyond a long."""
    product = (count.cast("decimal(19,0)") + F.lit(1).cast("decimal(1,0)")) * F.lit(SCALE).cast("decimal(10,0)")
    return F.lit(1) + F.call_function("div", product, (total + kept).cast("decimal(19,0)"))


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def shares(count: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """share() on arrays of longs: a long division by thousands, exact while 1,000 `whole` is a long."""
    digits, rest = np.zeros_like(count), count + 1
    for _ in range(3):
        rest = rest * 1000
        digits, rest = digits * 1000 + rest // whole, rest % whole
    return digits + 1


def consed(counts: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray]:
    """Trees over rows of counts (as wide as a power of two): the children of the nodes of each level from the top, the roots, the counts of leaves."""
    values, node = np.unique(counts, return_inverse=True)
    node = node.reshape(counts.shape)
    left, right = [], []
    while node.shape[1] > 1:
        width = int(node.max()) + 1
        kinds, above = np.unique(node[:, ::2] * width + node[:, 1::2], return_inverse=True)
        left.append(kinds // width)
        right.append(kinds % width)
        node = above.reshape(len(counts), -1)
    return left[::-1], right[::-1], node[:, 0], values


def priced(left: list, right: list, roots: np.ndarray, values: np.ndarray, wholes: np.ndarray, a: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of f over the trees of a and of each other row: f(p of a, p of the other), and f(p of the other, p of a).

    A count below 0 is no term and costs nothing. wholes: N + V of each row.
    """
    pair, x, y = np.arange(len(others)), np.full(len(others), roots[a]), roots[others]
    ways: list[np.ndarray] = []
    for go_left, go_right in zip(left, right):
        pair, x, y = np.tile(pair, 2), np.concatenate([go_left[x], go_right[x]]), np.concatenate([go_left[y], go_right[y]])
        wide_x, wide_y = int(x.max()) + 1, int(y.max()) + 1
        kinds, way = np.unique((pair * wide_x + x) * wide_y + y, return_inverse=True)
        ways.append(way)
        pair, x, y = kinds // wide_y // wide_x, kinds // wide_y % wide_x, kinds % wide_y
    none = values[x] < 0
    p, q = shares(np.maximum(values[x], 0), wholes[a]), shares(np.maximum(values[y], 0), wholes[others[pair]])
    square = np.where(none, 0, (p - q) ** 2)
    prices = [square // q, square // p]
    for way in reversed(ways):
        half = len(way) // 2
        prices = [v[way[:half]] + v[way[half:]] for v in prices]
    return prices[0], prices[1]


_CELL = "lang string, a long, b long, value long"


def _price_block(table: pa.Table) -> pa.Table:
    """One block of a language for two chunks of its sources; a row without a term stands for each source, and holds the block's size."""
    lang = table.column("lang")[0].as_py()
    s, at, n, whole, chunk = (table.column(c).to_numpy() for c in ("s", "at", "n", "whole", "chunk"))
    heads = at < 0
    order = np.argsort(s[heads])
    names, wholes, chunks, size = s[heads][order], whole[heads][order], chunk[heads][order], int(n[heads][0])
    counts = np.full((len(names), 1 << max(0, size - 1).bit_length()), -1, np.int64)
    counts[:, :size] = 0
    counts[np.searchsorted(names, s[~heads]), at[~heads]] = n[~heads]
    tree = consed(counts)
    a, b, value = [], [], []
    mixed = chunks[0] != chunks[-1]
    for k in range(len(names) - 1):
        others = np.arange(k + 1, len(names))
        others = others[chunks[others] != chunks[k]] if mixed else others
        if len(others):
            to, back = priced(*tree, wholes, k, others)
            own = np.full(len(others), names[k])
            a += [own, names[others]]
            b += [names[others], own]
            value += [to, back]
    columns = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in (a, b, value)]
    return pa.table([pa.array([lang] * len(columns[0]), pa.string()), *(pa.array(c, pa.int64()) for c in columns)], names=["lang", "a", "b", "value"])


def kept_terms(counts: DataFrame, min_docs: int = MIN_DOCS, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """lang, term, total, block, at, size of each kept term, and lang, kept (V), total (N) of each language that keeps any."""
    kept = stored(counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).drop("docs"), "terms")
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("whole"))
    block = kept.join(langs.select("lang", "kept"), "lang").withColumn("block", F.pmod(F.xxhash64("term"), F.ceil(F.col("kept") / width))).repartition("lang", "block")
    inside = Window.partitionBy("lang", "block")
    ids = block.select(
        "lang", "term", "total", "block", (F.row_number().over(inside.orderBy(F.desc("total"), "term")) - 1).cast("long").alias("at"), F.count("*").over(inside).alias("size")
    )
    return stored(ids, "term-ids"), stored(langs, "langs")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, sources: int = SOURCES, width: int = WIDTH) -> DataFrame:
    """lang, source, part (`pair` or `term`), item, value, rank of every group; see the head of the module."""
    counts = stored(term_counts(docs), "counts")
    ids, langs = kept_terms(counts, min_docs, width)
    rows = stored(counts.select("lang", "source", "term", "n").join(ids, ["lang", "term"]), "kept-counts")
    sums = rows.groupBy("lang", "source").agg(F.sum("n").alias("own"))
    number = (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long")
    groups = stored(
        docs.select(_name("lang"), _name("source")).distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
        .select("lang", "source", F.coalesce("own", F.lit(0)).alias("own"), F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("whole", F.lit(0)).alias("whole"), number.alias("s")),
        "groups",
    )
    pairs = _pairs(rows, ids, groups, sources)
    rated = rows.join(groups.select("lang", "source", "own", "kept", "whole"), ["lang", "source"]).select(
        "lang", "source", "term", share(F.col("n"), F.col("own"), F.col("kept")).alias("p"), share(F.col("total"), F.col("whole"), F.col("kept")).alias("q")
    )
    single = rated.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    ranked = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    return pairs.select("*", ranked).unionByName(single.select("*", ranked).where(F.col("rank") <= top))


def _pairs(rows: DataFrame, ids: DataFrame, groups: DataFrame, sources: int) -> DataFrame:
    """lang, source, part, item, value for each two sources of a language."""
    named = groups.withColumn("chunk", F.floor(F.col("s") / sources))
    some = named.where("kept > 0").select("lang", "source", "s", "chunk", (F.col("own") + F.col("kept")).alias("whole"))
    chunks = named.groupBy("lang").agg(F.max("chunk").alias("chunks"))
    blocks = ids.select("lang", "block", "size").distinct()
    heads = blocks.join(some, "lang").select("lang", "block", "s", "chunk", "whole", F.lit(-1).cast("long").alias("at"), F.col("size").alias("n"))
    body = rows.join(some, ["lang", "source"]).select("lang", "block", "s", "chunk", "whole", "at", "n")
    # a lone chunk meets itself; of more, each meets each other, and itself in a cell of its own
    cells = (
        heads.unionByName(body).join(chunks, "lang").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks"))))
        .select("lang", "block", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "s", "chunk", "whole", "at", "n")
    )
    values = cells.groupBy("lang", "block", "i", "j").applyInArrow(_price_block, _CELL).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    side = lambda c, name: groups.select("lang", F.col("s").alias(c), F.col("source").alias(name))
    priced_pairs = values.join(side("a", "source"), ["lang", "a"]).join(side("b", "item"), ["lang", "b"]).select("lang", "source", "item", "value")
    bare = groups.where("kept = 0").select("lang", "source")
    free = bare.join(bare.withColumnRenamed("source", "item"), "lang").where("source <> item").select("lang", "source", "item", F.lit(0).cast("long").alias("value"))
    return priced_pairs.unionByName(free).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
