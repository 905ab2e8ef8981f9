"""MinHash near-dedup with tensored banding.

Two small collections of half-keys are made per set of shingles, each half-key of a few minhashes. A
table's key is one half-key of the first collection with one of the second, so ``m`` half-keys in
each give ``m * m`` tables for ``2 * m`` half-keys of minhashes. Two sets miss each other in all
tables only if they agree on no half-key of one collection; at similarity 0.85 and the numbers below
that is about five in a million, and less above.

The product is taken late. A half-key that only one set has cannot be part of a shared table key, so
half-keys are counted first, one row each, and only shared ones are combined. Tables that hold the
same sets are one table.

Candidates are verified on their whole sets. A component needs no link inside it, so each table first
compares its members with one of them. Tables that still hold several components are compared with
their centre, the member that has most shingles in common with other components, and what is left
then is settled exactly: by the triangle inequality only members can be alike whose distances to the
centre differ by no more than the limit, and two members have no more in common than either of them
has with other components at all.

Equal sets are one node. Shingles are 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stmtlens.llm.common import batch
from stmtlens.llm.graph import roots
from stmtlens.llm.shingle_sets import Hashes, node_of, sets_of, shingles, told_texts
from stmtlens.session import discard, written

WIDTH = 5
PERCENT = 85
HALF_KEYS = 10  # in each of the two collections
MINHASHES = 2  # in a half-key
COLUMNS = 1 << 12  # shingles hashed at a time
_TURNS = np.random.default_rng(11).integers(
    1, 1 << 63, size=(2 * HALF_KEYS * MINHASHES, 1), dtype=np.uint64
)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX[0]
    x ^= x >> np.uint64(29)
    x *= _MIX[1]
    return x


def half_keys(own: np.ndarray) -> np.ndarray:
    """Half-keys of a set (one shingle or more): first collection, then second."""
    least = np.full(len(_TURNS), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(own), COLUMNS):
        some = _mixed(own[None, at : at + COLUMNS] ^ _TURNS)
        np.minimum(least, some.min(axis=1), out=least)
    found = np.arange(2 * HALF_KEYS, dtype=np.uint64)
    for k in range(MINHASHES):
        found = _mixed(found + least[k::MINHASHES])
    return found


_SKETCHED = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("told", pa.int64()),
        ("node", pa.int64()),
        ("n", pa.int64()),
        ("first", pa.list_(pa.int64())),
        ("second", pa.list_(pa.int64())),
    ]
)


def sketched(texts: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id, told, node, n, first, second``: of each text a hash of its set of shingles, the size
    of the set, and the two collections of half-keys; without words ``node`` is null and ``n`` 0."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for rows in batches:
            nodes, sizes, first, second = [], [], [], []
            for text in rows["text"].to_pylist():
                own = shingles(text.encode(), width, hashes)
                keys = half_keys(own).view(np.int64) if len(own) else np.zeros(0, dtype=np.int64)
                nodes.append(node_of(own) if len(own) else None)
                sizes.append(len(own))
                first.append(keys[:HALF_KEYS])
                second.append(keys[HALF_KEYS:])
            yield batch(
                {"doc_id": rows["doc_id"], "told": rows["told"], "node": nodes, "n": sizes,
                 "first": first, "second": second},
                _SKETCHED,
            )

    return texts.mapInArrow(
        compute,
        "doc_id long, told long, node long, n long, first array<long>, second array<long>",
    )


def _shared(rows: DataFrame) -> DataFrame:
    """``key`` of more than one node; hot keys are combined before they are shuffled."""
    ends = rows.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"))
    return ends.where("lo <> hi").select("key")


def meetings(nodes: DataFrame) -> DataFrame:
    """``key, node, n``: members of the tables that hold more than one node.

    Of tables that hold the same nodes one is left.
    """
    halves = nodes.select("node", "n", F.explode(F.concat("first", "second")).alias("key"))
    shared = halves.join(_shared(halves), "key", "left_semi")
    known = shared.groupBy("node").agg(F.collect_set("key").alias("known"))
    both = written(
        nodes.join(known, "node").select(
            "node", "n", F.array_intersect("first", "known").alias("first"),
            F.array_intersect("second", "known").alias("second"),
        ),
        "half-keys",
    )
    tables = both.select("node", "n", "second", F.explode("first").alias("a")).select(
        "node", "n", "a", F.explode("second").alias("b")
    )
    members = tables.select(F.xxhash64("a", "b").alias("key"), "node", "n")
    told = members.groupBy("key").agg(
        F.min("node").alias("lo"), F.max("node").alias("hi"), F.count(F.lit(1)).alias("members"),
        F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"),
    ).where("lo <> hi")
    one = told.groupBy("members", "x", "y").agg(F.min("key").alias("key")).select("key")
    return members.join(one, "key", "left_semi")


def _ordered(pairs: DataFrame) -> DataFrame:
    a, b = F.least("node", "x.node"), F.greatest("node", "x.node")
    return pairs.select(a.alias("a"), b.alias("b")).distinct()


def _stars(met: DataFrame, turn: Column) -> DataFrame:
    """``key, x``: of each table the member that comes first by ``turn``."""
    one = F.struct("node", "n", "root", "shared")
    return met.groupBy("key").agg(F.min_by(one, F.struct(turn, "node")).alias("x"))


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b, common, united``: sizes of intersection and union of each pair."""
    left, right = sets.toDF("a", "own"), sets.toDF("b", "other")
    common = F.size(F.array_intersect("own", "other")).cast("long")
    both = pairs.join(left, "a").join(right, "b")
    return both.select("a", "b", common.alias("common"), (F.size("own") + F.size("other")).alias("sum")).select(
        "a", "b", "common", (F.col("sum") - F.col("common")).alias("united")
    )


def _rooted(met: DataFrame, links: DataFrame | None) -> DataFrame:
    if links is None:
        return met.withColumn("root", F.col("node"))
    return met.join(roots(links), "node", "left").withColumn("root", F.coalesce("root", "node"))


def _open(met: DataFrame) -> DataFrame:
    """Tables that still hold nodes of several components."""
    ends = met.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    return met.join(ends.where("lo <> hi").select("key"), "key", "left_semi")


def _with_shared(met: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``met`` with ``shared``, how many shingles a node has that other components have too, and
    without the nodes for which that is too few to be like any of them."""
    nodes = met.select("node", "root").distinct()
    each = nodes.join(sets, "node").select("node", "root", F.explode("shingles").alias("shingle"))
    ends = each.groupBy("shingle").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    told = each.join(ends.where("lo <> hi").select("shingle"), "shingle", "left_semi")
    shared = told.groupBy("node").agg(F.count(F.lit(1)).alias("shared"))
    found = met.drop("shared").join(shared, "node")
    # With the smallest partner of a table no more than ``shared`` is common.
    sizes = found.groupBy("key").agg(F.min("n").alias("least"))
    united = F.col("n") + F.greatest(F.col("least") - F.col("shared"), F.lit(0))
    able = found.join(sizes, "key").where(100 * F.col("shared") >= percent * united)
    return _open(able.drop("least"))


def _may_be_alike(percent: int) -> Column:
    """Of a row and its ``x``: another component, and enough that can be common."""
    most = F.least("shared", "x.shared")
    return (F.col("root") != F.col("x.root")) & (
        100 * most >= percent * (F.col("n") + F.col("x.n") - most)
    )


def _near_pivot(met: DataFrame, centres: DataFrame, tested: DataFrame, percent: int) -> DataFrame:
    """Pairs that may be alike by their distances to the centre of a table they share, all of which
    are in ``tested``. Tables of one centre are one, cut into cells as wide as the limit."""
    limit = 1 - percent / 100
    far = 1 - F.col("common") / F.col("united")
    members = _pivoted(met, centres).drop("key", "apart").distinct()
    placed = members.join(tested, ["a", "b"]).select(
        "centre", F.struct("node", "n", "root", "shared", far.alias("far")).alias("x"),
        F.floor(far / limit).alias("cell"),
    )
    around = F.explode(F.array(F.col("cell"), F.col("cell") + 1)).alias("cell")
    near = placed.select("centre", "cell", "x.*").join(
        placed.select("centre", "x", around), ["centre", "cell"]
    )
    return near.where(
        _may_be_alike(percent) & (F.abs(F.col("far") - F.col("x.far")) <= limit + 1e-9)
    )


def _pivoted(met: DataFrame, centres: DataFrame) -> DataFrame:
    """Members of tables, each but the centre with the pair ``a, b`` of it and the centre; ``apart``
    if they were of different components when the centre was chosen."""
    return met.join(centres, "key").where("node <> x.node").select(
        "key", F.col("x.node").alias("centre"), "node", "n", "root", "shared",
        F.least("node", "x.node").alias("a"), F.greatest("node", "x.node").alias("b"),
        (F.col("root") != F.col("x.root")).alias("apart"),
    )


def _links(met: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """``a, b``: links that connect all nodes that meet and are alike."""
    tested = links = None

    def settle(pairs: DataFrame) -> None:
        """Compare new pairs and add those alike to the links."""
        nonlocal tested, links
        if tested is not None:
            pairs = pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti")
        new = written(_compared(pairs, sets), "compared")
        alike = new.where(100 * F.col("common") >= percent * F.col("united")).select("a", "b")
        tested = new if tested is None else tested.unionByName(new)
        links = alike if links is None else links.unionByName(alike)

    # At first nothing is known but sizes.
    first = _rooted(met, None).withColumn("shared", F.col("n"))
    star = first.join(_stars(first, F.xxhash64("node")), "key")
    settle(_ordered(star.where(_may_be_alike(percent))))
    rooted = _open(_rooted(met.select("key", "node", "n"), links))
    met = written(_with_shared(rooted, sets, percent), "meetings")
    if met.isEmpty():
        return links
    centres = written(_stars(met, -F.col("shared")), "centres")
    settle(_pivoted(met, centres).where("apart").select("a", "b").distinct())
    # What was shared before the new links bounds what is shared now.
    left = written(_open(_rooted(met.select("key", "node", "n", "shared"), links)), "meetings")
    if left.isEmpty():
        return links
    # Only where that did not connect all, the others' distances to the centre matter.
    settle(_pivoted(left, centres).select("a", "b").distinct())
    settle(_ordered(_near_pivot(left, centres, tested, percent)))
    return links


def components(
    docs: DataFrame, width: int = WIDTH, percent: int = PERCENT,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``, one row per input row.

    Documents are linked if ``100 * common >= percent * united`` of their sets of ``width``-word
    shingles; a text of fewer words is one shingle. Texts without words, and null texts, have an
    empty set and are linked with nothing: their component is their own id. Rows that repeat an id
    are documents of their own. Null ids are never the smallest; a component of documents without
    ids has a null id and all of them are kept. Other columns are left out. An empty table gives no
    rows.
    """
    texts = told_texts(docs, id_col, text_col)
    rows = written(sketched(texts, width), "sketches")
    nodes = rows.where("node IS NOT NULL").select("node", "n", "first", "second").dropDuplicates(["node"])
    met = written(meetings(nodes), "meetings")
    links = None
    if not met.isEmpty():
        # One text speaks for all of the same set.
        speaks = rows.groupBy("node").agg(F.min("told").alias("told"))
        told = speaks.join(met.select("node"), "node", "left_semi").select("told")
        sets = written(sets_of(texts, told, width), "shingle-sets")
        links = _links(met, sets, percent)
    least = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"))
    rooted = _rooted(least, links)
    whole = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(whole, "root").select("node", "component_id")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return (
        rows.join(named, "node", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))
    )
