"""SimHash fingerprints of whole texts and their near-duplicate components, found in BK-trees.

A BK-tree keeps fingerprints so that a node's child hangs on the edge that
carries the integer Hamming distance to it; a search with radius r that is at
distance d from a node follows only the edges d - r ... d + r.

One tree of all documents would not scale: fingerprints of unrelated texts are
all about 32 bits apart, so a search meets a fixed part of any tree. The forest
is therefore sharded by the pigeonhole rule: cut into k blocks, two fingerprints
within r bits agree on at least k - r blocks, so they meet in the shard of these
blocks' values. Each shard has its own tree. A shard of more than ``SHARD``
fingerprints is cut into trees of at most about that size, and each such tree is
sent to every slice of the shard's queries. Trees travel by shuffle, not by a
broadcast variable, because all of them together grow with the corpus and would
pass through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ligandloom.llm.common import raw, words_of
from ligandloom.llm.components import components
from ligandloom.session import stored

RADIUS = 4
WIDTH = 4
#: Fingerprints in one tree.
SHARD = 2048
#: Cells are searched together until they hold so many fingerprints, and a frontier is cut at so many places.
CHUNK, FRONTIER = 1 << 16, 1 << 20


def fingerprint(text: bytes | None, width: int = WIDTH) -> int:
    """64 majority bits over the XXH64 (seed 42) of all shingles, as a signed integer; no word: 0."""
    words = words_of(text)
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - width + 1)
    if n == 1:
        digests = [xxhash.xxh64_digest(joined, 42)]
    else:
        ends = list(accumulate(len(w) + 1 for w in words))
        starts = [0, *ends]
        digest = xxhash.xxh64_digest
        digests = [digest(joined[s : e - 1], 42) for s, e in zip(starts, ends[width - 1 :])]
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        bits = np.unpackbits(np.frombuffer(b"".join(digests[at : at + (1 << 16)]), np.uint8))
        counts += bits.reshape(-1, 64).sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > n).view(">i8")[0])


def fingerprint_column(text: str | Column, width: int = WIDTH) -> Column:
    """Fingerprint of a text column as bigint; null texts have fingerprint zero."""

    @F.arrow_udf("bigint")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t.as_py(), width) for t in texts], pa.int64())

    return run(raw(text))


def build_forest(fps: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """BK-trees of all groups at once: (root of each row's group, sorted edge keys, their children).

    ``group`` is sorted. Rows are inserted in their order, a level of all
    trees at a time: the first row at a distance from a node becomes the
    child on that edge, the others go on to it. An edge's key is
    65 * parent + distance.
    """
    n = len(fps)
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    root = np.repeat(first, np.diff(np.r_[first, n]))
    keys, children = [], []
    active = np.setdiff1d(np.arange(n), first, assume_unique=True)
    at = root[active]
    while len(active):
        key = at * 65 + np.bitwise_count(fps[active] ^ fps[at])
        edges, chosen, inverse = np.unique(key, return_index=True, return_inverse=True)
        keys.append(edges)
        children.append(active[chosen])
        at = active[chosen][inverse]
        rest = at != active
        active, at = active[rest], at[rest]
    if not keys:
        return root, np.empty(0, np.int64), np.empty(0, np.int64)
    key, child = np.concatenate(keys), np.concatenate(children)
    order = np.argsort(key)
    return root, key[order], child[order]


def search_forest(
    fps: np.ndarray, forest: tuple, queries: np.ndarray, query_fps: np.ndarray, roots: np.ndarray, radius: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query, node) within the radius. Frontiers of all queries advance together, in bounded pieces."""
    _, keys, children = forest
    todo = [(queries, query_fps, roots)]
    while todo:
        q, f, node = todo.pop()
        if len(q) > FRONTIER:
            half = len(q) // 2
            todo += [(q[:half], f[:half], node[:half]), (q[half:], f[half:], node[half:])]
            continue
        d = np.bitwise_count(f ^ fps[node]).astype(np.int64)
        near = d <= radius
        if near.any():
            yield q[near], node[near]
        lo = np.searchsorted(keys, node * 65 + np.maximum(d - radius, 0))
        hi = np.searchsorted(keys, node * 65 + np.minimum(d + radius, 64), "right")
        size = hi - lo
        total = int(size.sum())
        if total:
            at = np.repeat(lo - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(total)
            todo.append((np.repeat(q, size), np.repeat(f, size), children[at]))


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining the components of each pair (a, b); a label is the least row of its component."""
    while True:
        x, y = label[a], label[b]
        split = x != y
        if not split.any():
            return label
        x, y = x[split], y[split]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped


def local_links(fps: np.ndarray, cell: np.ndarray, role: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, fingerprint) that span the components inside each cell, fewer than there are rows.

    Bit 1 of ``role``: a node of the cell's tree; bit 2: a query.
    """
    label = np.arange(len(fps))
    nodes = np.flatnonzero(role & 1)
    forest = build_forest(fps[nodes], cell[nodes])
    cells, first = np.unique(cell[nodes], return_index=True)
    queries = np.flatnonzero(role & 2)
    where = np.searchsorted(cells, cell[queries])
    there = (where < len(cells)) & (cells[np.minimum(where, len(cells) - 1)] == cell[queries]) if len(cells) else None
    if there is None or not there.any():
        return fps[:0], fps[:0]
    queries, roots = queries[there], first[where[there]]
    for q, node in search_forest(fps[nodes], forest, queries, fps[queries], roots, radius):
        other = nodes[node]
        label = _merge(label, q, other)
    linked = np.flatnonzero(label != np.arange(len(fps)))
    return fps[linked], fps[label[linked]]


def _masks(n: int, radius: int) -> list[int]:
    """Bit masks of the agreeing blocks: the fewest blocks for which a shard of unrelated texts holds about 64."""
    for k in range(radius + 1, 2 * radius + 1):
        if n <= 64 * 2 ** (64 * (k - radius) // k):
            break
    cuts = [64 * i // k for i in range(k + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    masks = [sum(m) for m in combinations(block, k - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(distinct: DataFrame, fp: str = "fp", radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """(a, b) links between distinct fingerprints within ``radius`` bits: they span the components.

    Every pair within the radius is met in some cell; a cell returns a
    spanning forest of its pairs, never all of them.
    """
    masks = _masks(distinct.count(), radius)
    keys = F.array(*[F.xxhash64(F.lit(i), F.col(fp).bitwiseAND(F.lit(m))) for i, m in enumerate(masks)])
    rows = distinct.select(F.col(fp).alias("fp"), F.explode(keys).alias("key"))
    sizes = rows.groupBy("key").count()
    large = sizes.where(F.col("count") > shard).select("key", F.ceil(F.col("count") / shard).cast("int").alias("m"))
    mine = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("m"))
    cells = (
        rows.join(large, "key", "left").fillna(1, ["m"])
        .withColumn("a", mine).select("fp", "key", "a", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("j"))
        .select(
            "fp",
            F.xxhash64("key", F.least("a", "j"), F.greatest("a", "j")).alias("cell"),
            F.when(F.col("a") == F.col("j"), 3).when(F.col("a") < F.col("j"), 1).otherwise(2).alias("role"),
        )
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def solve(parts: list[tuple]) -> pa.RecordBatch:
            fps, cell, role = (np.concatenate(x) for x in zip(*parts))
            a, b = local_links(fps.view(np.uint64), cell, role, radius)
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, b)], ["a", "b"])

        for batch in batches:
            held.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
            if sum(len(x[0]) for x in held) >= CHUNK:
                fps, cell, role = (np.concatenate(x) for x in zip(*held))
                cut = int(np.searchsorted(cell, cell[-1]))  # the last cell may go on
                held = [(fps[cut:], cell[cut:], role[cut:])]
                if cut:
                    yield solve([(fps[:cut], cell[:cut], role[:cut])])
        if held:
            yield solve(held)

    return (
        cells.repartition("cell").sortWithinPartitions("cell", "fp")
        .mapInArrow(search, "a bigint, b bigint").distinct()
    )


def group_fingerprints(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, root, component_id) for each distinct fingerprint of ``prints`` (doc_id, fp).

    root is the least fingerprint of the component, component_id the least
    doc_id in it (null when none of its documents has an id).
    """
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    roots = components(links(distinct, "fp", radius), "a", "b")
    tagged = stored(
        distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
        .select("fp", F.coalesce("root", "fp").alias("root"), "least"),
        "tagged",
    )
    ids = tagged.groupBy("root").agg(F.min("least").alias("component_id"))
    return tagged.select("fp", "root").join(ids, "root")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document.

    Null and empty texts have fingerprint zero and are linked like any other;
    repeated rows stay repeated; a row without id joins a component but never
    names it. An empty table gives an empty result.
    """
    prints = stored(docs.select(F.col(key).alias("doc_id"), fingerprint_column(text).alias("fp")), "prints")
    groups = group_fingerprints(prints, radius).select("fp", "component_id")
    return prints.join(groups, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_per_group(docs: DataFrame, text: str = "text", key: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the row with the least id.

    All columns are kept whatever their names. Rows that repeat an id inside
    a component leave one row, that with the least text; a component in which no
    row has an id keeps one row as well. Only rows without an id of their own are fingerprinted a second time.
    """
    prints = stored(docs.select(F.col(key).alias("doc_id"), fingerprint_column(text).alias("fp")), "prints")
    groups = stored(group_fingerprints(prints, radius), "groups")
    several = stored(prints.groupBy("doc_id").count().where("count > 1 or doc_id is null").select("doc_id"), "several")
    whole = docs.select(F.struct("*").alias("row"), F.col(key).alias("doc_id"))
    # where an id is a row's own, it alone says whether the row stays
    stay = prints.join(groups, "fp").where("doc_id = component_id").select("doc_id").join(several, "doc_id", "left_anti")
    once = whole.join(stay, "doc_id", "left_semi").select("row.*")
    if several.isEmpty():
        return once
    again = whole.where("doc_id is null").unionByName(whole.join(several, "doc_id", "left_semi").select("row", "doc_id"))
    body = F.col("row").getField(text)
    marked = again.select("row", "doc_id", raw(body).alias("body"), fingerprint_column(body).alias("fp"))
    kept = marked.join(groups, "fp").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    return once.unionByName(kept.groupBy("root").agg(F.min_by("row", "body").alias("row")).select("row.*"))
