"""N-gram Jaccard join with PartEnum signatures: which documents are linked, directly or through others.

Steps, each a Spark stage over all rows:
1. every text becomes its set of word shingles; equal sets form one node (partial aggregate on a
   128-bit hash of the set), so exact copies take no part in what follows;
2. every set gives its PartEnum signatures (see ``partenum``); rows of one signature meet in sorted
   order and name the smallest document among them as their centre;
3. two documents that share a signature share its centre. Each is compared exactly with its centre, in
   blocks of at most ``BLOCK`` documents (by ``BLOCK_ELEMENTS`` elements if they are long) that each get a
   copy of the centre: work and rows grow with the number of documents, however large a group is;
4. what is linked so far forms classes. Only centres whose documents lie in several classes go on: their
   documents are dealt into blocks of at most ``MEETING``, large classes into blocks of their own, and pairs of
   blocks are compared exactly unless both hold one class. A document is one row for each centre up to that many
   documents, and one for each block beyond. A task compares tiles of ``BLOCK`` of similar size and gives a
   spanning forest of the links found, never the pairs;
5. the connected components of all links carry each document's class.

Similarity is judged on 64-bit hashes of shingles, not on their words, in integers: ``100 * intersection >= percent * union``.

Defined results:
* a null or empty text, or one without words, has an empty set and is linked with nothing;
* a text of fewer words than a shingle is one shingle of all its words;
* rows without an id have ``component_id`` null and are linked with nothing;
* rows that repeat an id are one document: linked with each other and with what any of them is linked with;
* an empty table gives an empty result; only the two named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.llm import words as W
from tapewright.llm.components import connected_components
from tapewright.llm.partenum import shingle_sets, signatures
from tapewright.llm.scratch import Scratch

BLOCK = 512
BLOCK_ELEMENTS = 1 << 20
#: Documents of a block that meets other blocks; their elements are bounded too, so a task holds 16 MB of them.
MEETING = 4096
_COLUMNS = 2048
#: Sets that a task remembers to leave out copies of them before the shuffle.
_REMEMBERED = 1 << 17


def _sets(texts: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, elements, offsets) by slice."""
    for lo, data, offsets in W.slices(texts):
        starts, ends, before = W.spans(data, offsets, W.NOT_BLANK)
        yield lo, *shingle_sets(W.hashes(data, starts, ends), before, n)


def _content(elements: np.ndarray) -> bytes:
    return hashlib.blake2b(elements.tobytes(), digest_size=16).digest()


def _measured(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, content = np.zeros(len(batch), dtype=np.int64), [None] * len(batch)
            for lo, elements, offsets in _sets(batch.column(1), n):
                size[lo : lo + len(offsets) - 1] = np.diff(offsets)
                for i in np.flatnonzero(np.diff(offsets)).tolist():
                    content[lo + i] = _content(elements[offsets[i] : offsets[i + 1]])
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "n_shingles": size, "content": pa.array(content, pa.binary())})

    return run


def _signed(n: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for lo, elements, offsets in _sets(batch.column(1), n):
                new = np.zeros(len(offsets) - 1, dtype=bool)
                for i in np.flatnonzero(np.diff(offsets)).tolist():
                    key = _content(elements[offsets[i] : offsets[i + 1]])
                    new[i] = key not in seen
                    if len(seen) == _REMEMBERED:
                        seen.clear()
                    seen.add(key)
                sigs, who = signatures(elements, offsets, percent, 100)
                use = new[who]
                yield pa.RecordBatch.from_pydict({"sig": sigs[use].view(np.int64), "id": ids[lo + who[use]]})

    return run


def _centred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (sig, id): (centre, id) for all but the first of a signature, which is the centre."""
    last = None
    for batch in batches:
        sig, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(sig):
            continue
        first = np.ones(len(sig), dtype=bool)
        first[1:] = sig[1:] != sig[:-1]
        starts = np.flatnonzero(first)
        centre = ids[starts][np.cumsum(first) - 1]
        if last is not None and last[0] == sig[0]:
            stop = int(starts[1]) if len(starts) > 1 else len(sig)
            centre[:stop] = last[1]
            first[0] = False
        last = sig[-1], centre[-1]
        pairs = np.unique(np.stack([centre[~first], ids[~first]], axis=1), axis=0)
        yield pa.RecordBatch.from_pydict({"centre": pairs[:, 0], "id": pairs[:, 1]})


def _links(sets: list[np.ndarray], sides: np.ndarray, percent: int) -> np.ndarray:
    """Symmetric matrix of links; of sets on two sides only pairs across count."""
    m = len(sets)
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    if m <= 6:
        shared = np.zeros((m, m), dtype=np.int64)
        for i in range(m):
            for j in range(i):
                small, large = sorted((sizes[i], sizes[j]))
                if 100 * small >= percent * large:
                    shared[i, j] = shared[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
    else:
        row = W.rows_of(sizes)
        kinds, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        column = np.where(count > 1, np.cumsum(count > 1) - 1, -1)[place]
        row, column = row[column >= 0], column[column >= 0]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        dense = np.zeros((m, m), dtype=np.float64)
        for lo in range(0, int((count > 1).sum()), _COLUMNS):
            a, b = np.searchsorted(column, [lo, lo + _COLUMNS])
            part = np.zeros((m, _COLUMNS), dtype=np.float32)
            part[row[a:b], column[a:b] - lo] = 1
            dense += part @ part.T
        shared = dense.astype(np.int64)
    linked = 100 * shared >= percent * (sizes[:, None] + sizes[None, :] - shared)
    if sides.min() != sides.max():
        linked &= sides[:, None] != sides[None, :]
    return linked


def _forest(ids: np.ndarray, linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what the links connect, at most one per set."""
    left, out = np.ones(len(ids), dtype=bool), []
    for i in range(len(ids)):
        if left[i]:
            left[i] = False
            todo = [i]
            while todo:
                near = np.flatnonzero(linked[todo.pop()] & left)
                left[near] = False
                todo.extend(near.tolist())
                out.extend((int(ids[i]), int(ids[j])) for j in near)
    return out


def _meet(ids: np.ndarray, own: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Edges that connect what the links connect, of sets of two blocks only those across; at most one per set.

    Sets meet in tiles sorted by size. Tiles too unlike in size, or connected already, are not compared.
    """
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    tiles = []
    for side in np.unique(own):
        at = np.flatnonzero(own == side)
        at = at[np.argsort(sizes[at], kind="stable")]
        tiles.extend((side, at[k : k + BLOCK]) for k in range(0, len(at), BLOCK))
    across = tiles[0][0] != tiles[-1][0]
    root, out = list(range(len(sets))), []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for k, (side, a) in enumerate(tiles):
        for other, b in tiles[k:]:
            if across and side == other:
                continue
            if 100 * min(sizes[a].max(), sizes[b].max()) < percent * max(sizes[a].min(), sizes[b].min()):
                continue
            both = a if a is b else np.concatenate([a, b])
            if len({find(i) for i in both.tolist()}) == 1:
                continue
            sides = np.zeros(len(both), dtype=np.int64)
            sides[len(a) :] = 1
            for i, j in _forest(both, _links([sets[i] for i in both.tolist()], sides, percent)):
                p, q = find(i), find(j)
                if p != q:
                    root[q] = p
                    out.append((int(ids[i]), int(ids[j])))
    return out


def _as_edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    table = np.array(found, dtype=np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_pydict({"a": table[:, 0], "b": table[:, 1]})


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def _against_centre(n: int, percent: int):
    """From rows (centre, block, member, id, text) sorted by the first three, the centre's texts first: edges to the centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, centres = None, []
        for batch in batches:
            found: list[tuple[int, int]] = []
            keys = list(zip(*(batch.column(c).to_pylist() for c in range(2)), strict=True))
            member, ids = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for lo, elements, offsets in _sets(batch.column(4), n):
                for i in range(len(offsets) - 1):
                    own = elements[offsets[i] : offsets[i + 1]]
                    if keys[lo + i] != key:
                        key, centres = keys[lo + i], []
                    if not member[lo + i]:
                        centres.append(own.copy())
                    elif any(_similar(centre, own, percent) for centre in centres):
                        found.append((key[0], ids[lo + i]))
            yield _as_edges(found)

    return run


def _verified(n: int, percent: int):
    """From rows (centre, i, j, own, id, text) sorted by the first three: edges."""

    def edges(members: list[tuple[int, int, np.ndarray]]) -> list[tuple[int, int]]:
        if len(members) < 2:
            return []
        own, ids, sets = zip(*members, strict=True)
        return _meet(np.array(ids), np.array(own), list(sets), percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members = None, []
        for batch in batches:
            found: list[tuple[int, int]] = []
            keys = list(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True))
            own, ids = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            for lo, elements, offsets in _sets(batch.column(5), n):
                for i in range(len(offsets) - 1):
                    if keys[lo + i] != key:
                        found.extend(edges(members))
                        key, members = keys[lo + i], []
                    members.append((own[lo + i], ids[lo + i], elements[offsets[i] : offsets[i + 1]].copy()))
            yield _as_edges(found)
        yield _as_edges(edges(members))

    return run


def _blocks(n: Column, elements: Column, most: int) -> Column:
    return F.greatest(F.ceil(n / most), F.ceil(elements / BLOCK_ELEMENTS)).cast("int")


def _linked_to_centres(members: DataFrame, rows: DataFrame, scratch: Scratch, shingle: int, percent: int) -> DataFrame:
    """Edges between members and their centres."""
    groups = members.groupBy("centre").agg(_blocks(F.count(F.lit(1)), F.sum(F.col("size") + F.col("centre_size") / BLOCK), BLOCK).alias("blocks"))
    groups = scratch.save(groups, "groups")
    dealt = members.join(groups, "centre").select(F.col("member").alias("id"), "centre", F.pmod(F.xxhash64("member"), F.col("blocks")).cast("int").alias("block"), F.lit(True).alias("is_member"))
    leads = groups.select(F.col("centre").alias("id"), "centre", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(False).alias("is_member"))
    # A sort-merge join at every size: texts are the larger side, and members grow with them.
    texts = dealt.unionByName(leads).join(rows.hint("merge"), "id").select("centre", "block", "is_member", "id", "text")
    return texts.repartition("centre", "block").sortWithinPartitions("centre", "block", "is_member").mapInArrow(_against_centre(shingle, percent), "a bigint, b bigint")


def _placed(tagged: DataFrame, scratch: Scratch) -> DataFrame | None:
    """Rows (id, centre, own, i, j) of documents whose centre has several classes, one for each pair of blocks (i, j) in which they are compared; None if there are none."""
    parts = tagged.groupBy("centre", "class").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("elements"))
    parts = scratch.save(parts, "parts")
    several = parts.groupBy("centre").agg(F.min("class").alias("least"), F.max("class").alias("most")).where("least <> most").select("centre")
    several = scratch.save(several, "several")
    if several.isEmpty():
        return None
    parts = parts.join(several, "centre").withColumn("blocks", _blocks(F.col("n"), F.col("elements"), MEETING))
    # Large classes have blocks of their own, numbered behind those that the small ones share.
    is_large = F.col("blocks") > 1
    small = lambda c: F.sum(F.when(~is_large, F.col(c)).otherwise(0))
    shared = parts.groupBy("centre").agg(_blocks(small("n"), small("elements"), MEETING).alias("shared"), F.sum(F.when(is_large, F.col("blocks")).otherwise(0)).cast("int").alias("others"))
    shared = scratch.save(shared.select("centre", "shared", (F.col("shared") + F.col("others")).alias("all_blocks")), "shared")
    before = Window.partitionBy("centre").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    large = parts.where(is_large).select("centre", "class", "blocks", F.coalesce(F.sum("blocks").over(before), F.lit(0)).cast("int").alias("first"))
    large = scratch.save(large, "large")
    placed = tagged.join(shared, "centre").join(large, ["centre", "class"], "left")
    first = F.col("shared") + F.col("first")
    block = F.when(F.col("first").isNotNull(), first + F.pmod(F.xxhash64("member"), F.col("blocks"))).otherwise(F.pmod(F.xxhash64("member"), F.col("shared"))).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("all_blocks") - 1), lambda b: F.col("first").isNull() | (b < first) | (b >= first + F.col("blocks")))
    placed = placed.select(F.col("member").alias("id"), "centre", block.alias("own"), F.explode(others).alias("other"))
    return placed.select("id", "centre", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))


def _linked_across_classes(members: DataFrame, classes: DataFrame, rows: DataFrame, scratch: Scratch, shingle: int, percent: int) -> DataFrame | None:
    """Edges between documents of one centre that lie in different classes so far; None if there are none to compare."""
    own = members.select("centre", "member", "size").unionByName(members.select("centre", F.col("centre").alias("member"), F.col("centre_size").alias("size")).distinct())
    tagged = own.join(classes, F.col("member") == F.col("node"), "left").select("centre", "member", "size", F.coalesce("component", "member").alias("class"))
    placed = _placed(scratch.save(tagged, "tagged"), scratch)
    if placed is None:
        return None
    texts = placed.join(rows.hint("merge"), "id").select("centre", "i", "j", "own", "id", "text")
    return texts.repartition("centre", "i", "j").sortWithinPartitions("centre", "i", "j").mapInArrow(_verified(shingle, percent), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: id, n_shingles, component_id (the smallest id that links lead to, its own included)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-duplicates")
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    sets = scratch.save(rows.mapInArrow(_measured(shingle), "id bigint, n_shingles bigint, content binary"), "sets")
    same = sets.where("id is not null and content is not null").groupBy("content").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("n"))
    # Written, here and for groups below, so that the join has a shuffle of its own on either side, which adaptive execution can split at a hot key.
    same = scratch.save(same.where("n > 1").drop("n"), "same")
    nodes = scratch.save(sets.join(same, "content", "left").select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("node", "id")).alias("node")), "nodes")
    # An id with texts of several nodes stands for itself, so that all its texts are compared.
    node = F.when(F.min("node") == F.max("node"), F.min("node")).otherwise(F.col("id"))
    node_of = nodes.where("id is not null").groupBy("id").agg(node.alias("node"), F.max("n_shingles").alias("size"))
    split = nodes.where("n_shingles > 0").join(node_of.select("id", F.col("node").alias("b")), "id").where("node <> b").select(F.col("node").alias("a"), "b")

    signed = rows.where("id is not null").mapInArrow(_signed(shingle, percent), "sig bigint, id bigint")
    stars = signed.repartition("sig").sortWithinPartitions("sig", "id").mapInArrow(_centred, "centre bigint, id bigint").distinct()
    own = node_of.select("id", "node", "size")
    members = (
        stars.join(own, "id")
        .select(F.col("centre").alias("id"), F.col("node").alias("member"), "size")
        .join(own.select("id", F.col("node").alias("centre"), F.col("size").alias("centre_size")), "id")
        .where("centre <> member")
        .select("centre", "member", "size", "centre_size")
        .distinct()
    )
    members = scratch.save(members, "members")
    linked = scratch.save(_linked_to_centres(members, rows, scratch, shingle, percent), "linked")
    classes = scratch.save(connected_components(linked.unionByName(split), Scratch(spark, "components")), "classes")
    more = _linked_across_classes(members, classes, rows, scratch, shingle, percent)
    if more is not None:
        known = classes.select(F.col("node").alias("a"), F.col("component").alias("b"))
        classes = connected_components(known.unionByName(more), Scratch(spark, "components"))
    scratch.drop("members")
    return nodes.join(classes, "node", "left").select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component", "node").alias("component_id"))
