"""SimHash near-duplicates: fingerprints of word shingles, joined by shared blocks, verified by Hamming distance."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations, pairwise
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.common import saved, table
from gradeloom.llm.components import connected_components
from gradeloom.llm.pieces import slices

#: Words of a shingle, most differing bits of a link, seed of the shingle hash.
SHINGLE, DISTANCE, SEED = 4, 4, 42
#: Members of a block group that are compared in full.
SMALL = 32

_BITS = np.array([[b >> i & 1 for i in range(8)] for b in range(256)], np.int64)
_COLUMN = 256 * np.arange(8)


def simhash(text: bytes, size: int = SHINGLE) -> int:
    """The 64-bit fingerprint of UTF-8 bytes: a bit is set if more than half of the shingles' hashes have it.

    Only A-Z is lower-cased, words are runs without \\x20 and \\x09-\\x0D, shingles count as often as they
    occur, fewer words than `size` are one shingle, and no words give 0.
    """
    words = text.lower().split()
    if not words:
        return 0
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    n, begins = max(1, len(words) - size + 1), np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], SEED) for a, b in zip(begins[:n].tolist(), ends[min(size, len(words)) - 1 :].tolist(), strict=True)], np.uint64)
    counts = np.bincount((h.astype("<u8").view(np.uint8).reshape(n, 8) + _COLUMN).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int(np.packbits(2 * counts.ravel() > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """(id, fp) of every row; fp is the fingerprint as a signed long; a null text is an empty one."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                texts = part.column(1).cast(pa.binary()).to_pylist()
                fps = np.array([simhash(t or b"", size) for t in texts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps)], names=["id", "fp"])

    rows = docs.select(id_col, text_col)
    return rows.mapInArrow(work, f"id {rows.schema[id_col].dataType.simpleString()}, fp long")


def block_count(fingerprints: int, distance: int = DISTANCE) -> int:
    """The least number of blocks by which evenly spread fingerprints meet about one other each by chance.

    It decides how much is compared, never what is found: more blocks make longer keys, but more of them.
    """
    fits = (m for m in range(distance + 1, 4 * distance) if comb(m, distance) * fingerprints <= 2.0 ** (64 * (m - distance) / m + 1))
    return next(fits, 4 * distance)


def block_masks(blocks: int, distance: int = DISTANCE) -> list[int]:
    """Masks of all choices of blocks - distance blocks: close fingerprints are equal under one of them at least."""
    cut = [64 * i // blocks for i in range(blocks + 1)]
    masks = [(1 << b) - (1 << a) for a, b in pairwise(cut)]
    return [reduce(int.__or__, chosen) for chosen in combinations(masks, blocks - distance)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _groups(nodes: DataFrame, blocks: int, distance: int) -> DataFrame:
    """(which, key, n, fp, copies): the members of all groups of two or more that share the bits of a mask."""
    masks = F.array(*(F.lit(_signed(m)).cast("long") for m in block_masks(blocks, distance)))
    keyed = nodes.select("fp", "copies", F.posexplode(masks).alias("which", "mask")).select("which", F.col("mask").bitwiseAND(F.col("fp")).alias("key"), "fp", "copies")
    shared = keyed.groupBy("which", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return saved(keyed.join(shared, ["which", "key"]), "blocks")


def _near(u: str, v: str, distance: int):
    return F.bit_count(F.col(u).bitwiseXOR(F.col(v))) <= distance


def _compared(groups: DataFrame, distance: int) -> DataFrame:
    """Links (u, v) in groups that are compared in full."""
    other = groups.select("which", "key", F.col("fp").alias("v"))
    pairs = groups.select("which", "key", F.col("fp").alias("u")).join(other, ["which", "key"])
    return pairs.where((F.col("u") < F.col("v")) & _near("u", "v", distance)).select("u", "v").distinct()


def _led(groups: DataFrame, distance: int) -> DataFrame:
    """Links (u, v) of groups' members to the one with most copies."""
    head = groups.groupBy("which", "key").agg(F.max_by("fp", F.struct("copies", "fp")).alias("u"))
    return groups.join(head, ["which", "key"]).where((F.col("u") != F.col("fp")) & _near("u", "fp", distance)).select("u", F.col("fp").alias("v")).distinct()


def _around(nodes: DataFrame, distance: int) -> DataFrame:
    """Links (u, v) through the points within half the (even) distance of each fingerprint.

    Two fingerprints at most `distance` apart share such a point, and all that share one are at most
    `distance` apart; so links to the least of them join exactly what belongs together, with a fixed number
    of rows for each fingerprint, however many are alike.
    """
    points = nodes.select("fp", F.lit(0).alias("from"), F.col("fp").alias("point"))
    done = points
    for _ in range(distance // 2):
        points = points.select("fp", "point", F.explode(F.sequence(F.col("from"), F.lit(63))).alias("bit")).select("fp", (F.col("bit") + 1).alias("from"), F.col("point").bitwiseXOR(F.expr("shiftleft(1L, bit)")).alias("point"))
        done, points = done.unionByName(points), points.where("from < 64")
    done = done.select("fp", "point")
    least = done.groupBy("point").agg(F.min("fp").alias("u"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return done.join(least, "point").where("fp != u").select("u", F.col("fp").alias("v")).distinct()


def links(nodes: DataFrame, distance: int = DISTANCE, blocks: int | None = None, small: int = SMALL) -> DataFrame:
    """Links (u, v) that connect all fingerprints (fp, copies) at most `distance` bits apart, directly or by others.

    Each link is one of two fingerprints so close, and any two so close are connected. Groups that share the
    bits of a mask are compared in full up to `small` members; fingerprints of larger groups are dealt into
    more, smaller blocks, and where even these are crowded they are linked to one member of their group,
    and, if that does not connect the whole group, through the points around them. So each fingerprint
    costs a bounded number of rows, and no group is ever paired with itself.
    """
    if distance % 2 or not 0 < distance < 16:
        raise ValueError("distance must be an even number from 2 to 14")
    if blocks is None:
        blocks = block_count(nodes.count(), distance)
    groups = _groups(nodes, blocks, distance)
    found = [_compared(groups.where(F.col("n") <= small), distance)]
    crowd = saved(groups.where(F.col("n") > small).select("fp", "copies").distinct(), "crowd")
    if not crowd.isEmpty():
        finer = _groups(crowd, blocks + 3, distance)
        crowded = finer.where(F.col("n") > small)
        found += [_compared(finer.where(F.col("n") <= small), distance), _led(crowded, distance)]
        joined = saved(reduce(DataFrame.union, found), "simhash_links")
        label = connected_components(joined).withColumnRenamed("node", "fp")
        labelled = crowded.join(label, "fp", "left").select("which", "key", "fp", F.coalesce("component", "fp").alias("component"))
        apart = labelled.groupBy("which", "key").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a != b")
        rest = crowded.join(apart, ["which", "key"], "left_semi").select("fp").distinct()
        found = [joined, _around(rest, distance)]
    return saved(reduce(DataFrame.union, found), "simhash_links")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, blocks: int | None = None, size: int = SHINGLE, small: int = SMALL) -> DataFrame:
    """(id, fp, component_id) for every row; component_id is the least id that links of the fingerprints reach.

    Rows with equal fingerprints are one node, so copies never meet in pairs. Null counts as the empty text;
    texts without words share fingerprint 0, which links like any other; repeated rows and ids keep their
    rows; a component in which no row has an id has none; texts of any length are taken whole; other columns
    are ignored; an empty table gives no rows.
    """
    rows = saved(fingerprints(docs, id_col, text_col, size), "simhash")
    nodes = saved(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies")), "simhash_nodes")
    label = connected_components(links(nodes.select("fp", "copies"), distance, blocks, small)).withColumnRenamed("node", "fp")
    known = nodes.join(label, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    known = saved(known, "simhash_known")
    least = known.groupBy("component").agg(F.min("least").alias("component_id"))
    return rows.join(known.join(least, "component").select("fp", "component_id"), "fp").select("id", "fp", "component_id")


def op13_simhash(spark, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and the component of its links."""
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
