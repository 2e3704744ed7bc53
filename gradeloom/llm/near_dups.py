"""MinHash near-duplicates: DartMinHash signatures, banded candidates, exact verification, classes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil, log, log1p

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.llm.common import forgetful, saved, table
from gradeloom.llm.components import connected_components
from gradeloom.llm.pieces import slices
from gradeloom.llm.words import words

#: Words of a shingle, least similarity, chance that a pair of that similarity shares no band, coordinates at most.
SHINGLE, SIMILARITY, MISS, COORDINATES = 5, 0.8, 1e-4, 128
#: Members of a group that are compared in full.
SMALL = 32
#: Rounds in which large groups are split by what their members have beyond the head.
PRUNED = 2
#: Groups of a node by which a pair that meets in several of them is told to have met before.
TOLD = 32
#: Most keys for which a sketch tells those of one member from shared ones, and slots in a chunk of it.
SKETCHED, CHUNK = 2**27, 2**19


def banding(least: float = SIMILARITY) -> tuple[int, int]:
    """(bands, rows): the longest bands by which a pair of similarity `least` shares none with probability MISS at most.

    For .8 these are 24 bands of 5. Below some .07 even single rows take more than COORDINATES.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be above 0 and at most 1")
    need = [(ceil(log(MISS) / log1p(-(least**rows))) if least < 1 else 1, rows) for rows in range(1, COORDINATES + 1)]
    return next((b for b in reversed(need) if b[0] * b[1] <= COORDINATES), need[0])


_POISSON = np.cumsum(np.exp(-1) / np.cumprod([1.0, *range(1, 13)]))


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on whole arrays."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of a text's runs of `size` words; fewer words are one run, no words none."""
    own = words(text)
    if not own:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, own), np.uint64, len(own))
    n = max(1, len(own) - size + 1)
    out = np.full(n, min(len(own), size), np.uint64)
    for i in range(min(size, len(own))):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(out, return_counts=True)


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], k: int = 120) -> np.ndarray:
    """DartMinHash of weighted sets, none empty: a row of k dart names for each.

    Each unit of weight of an element is a region; in each unit of rank it gets a Poisson number of darts,
    drawn from hashes of element, unit and rank alone, so equal regions of two sets hold equal darts.
    A dart falls on one of k coordinates; each coordinate keeps its dart of least rank. A set of weight w
    looks at ranks below t / w only, where t darts are enough to meet all coordinates nearly always; for
    sets with a coordinate unmet the ranks are doubled. Two coordinates agree with the probability of the
    weighted Jaccard similarity, and the work for a set is its weight or t, whichever is more.
    """
    weight = np.array([c.sum() for _, c in sets], float)
    out = np.zeros((len(sets), k), np.uint64)
    limit = k * (np.log(k) + 3) / weight
    todo = np.arange(len(sets))
    while len(todo):
        x = np.concatenate([np.repeat(sets[i][0], sets[i][1]) for i in todo])
        unit = np.concatenate([np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) for c in (sets[i][1] for i in todo)]).astype(np.uint64)
        owner = np.repeat(np.arange(len(todo)), weight[todo].astype(int))
        ranks = np.ceil(limit[todo]).astype(int)[owner]
        rank = np.arange(ranks.sum()) - np.repeat(np.cumsum(ranks) - ranks, ranks)
        owner = np.repeat(owner, ranks)
        cell = _mix(np.repeat(_mix(x + unit * np.uint64(0xD1342543DE82EF95)), ranks) + rank.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))
        darts = np.searchsorted(_POISSON, (cell >> np.uint64(11)) * 2.0**-53)
        number = np.arange(darts.sum()) - np.repeat(np.cumsum(darts) - darts, darts)
        owner, rank = np.repeat(owner, darts), np.repeat(rank, darts)
        name = _mix(np.repeat(cell, darts) + (number + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        at = rank + (name >> np.uint64(32)) * 2.0**-32
        kept = at < limit[todo][owner]
        owner, name, at = owner[kept], name[kept], at[kept]
        place = owner * k + ((name & np.uint64(0xFFFFFFFF)) * np.uint64(k) >> np.uint64(32)).astype(int)
        order = np.argsort(-at)  # the last write to a coordinate is that of least rank
        found = np.zeros(len(todo) * k, np.uint64)
        met = np.zeros(len(todo) * k, bool)
        found[place[order]], met[place] = name[order], True
        out[todo] = found.reshape(-1, k)
        missed = ~met.reshape(-1, k).all(1)
        limit[todo[missed]] *= 2
        todo = todo[missed]
    return out


def band_keys(signature: np.ndarray, bands: int = 24) -> np.ndarray:
    """A 64-bit key of each band of each signature."""
    rows = signature.shape[1] // bands
    cut = signature.reshape(len(signature), bands, rows)
    key = np.tile(np.arange(bands, dtype=np.uint64), (len(signature), 1))
    for r in range(rows):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + cut[:, :, r])
    return key.view(np.int64)


def _node(text: str | None, own: tuple[np.ndarray, np.ndarray]) -> bytes:
    """Equal for texts with the same shingles equally often, and for equal texts without words."""
    if not len(own[0]):
        return xxhash.xxh3_128_digest(b"text" + (text or "").encode())
    return xxhash.xxh3_128_digest(own[0].tobytes() + own[1].tobytes())


def _groups(some: list[int], sets: list, most: int = 250_000) -> Iterator[list[int]]:
    """Parts of the list whose signatures together look at about `most` cells; one set at least."""
    part, cells = [], 0
    for i in some:
        part.append(i)
        cells += max(int(sets[i][1].sum()), 1000)
        if cells >= most:
            yield part
            part, cells = [], 0
    if part:
        yield part


def sketch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY, size: int = SHINGLE) -> DataFrame:
    """(id, node, weight, bands): the class of exactly equal shingles and the band keys of each text."""

    bands, rows_each = banding(least)

    @forgetful()
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col, 1_000_000):
                texts = part.column(1).to_pylist()
                sets = [shingles(t, size) for t in texts]
                some = [i for i, s in enumerate(sets) if len(s[0])]
                keys: list = [[] for _ in texts]
                for group in _groups(some, sets):
                    for i, row in zip(group, band_keys(signatures([sets[i] for i in group], bands * rows_each), bands), strict=True):
                        keys[i] = row
                columns = [part.column(0), pa.array([_node(t, s) for t, s in zip(texts, sets, strict=True)], pa.binary()), pa.array([int(c.sum()) for _, c in sets], pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "node", "weight", "bands"])

    rows = docs.select(id_col, text_col)
    return rows.mapInArrow(work, f"id {rows.schema[id_col].dataType.simpleString()}, node binary, weight long, bands array<long>")


def features(docs: DataFrame, wanted: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """(node, hashes, counts) of the wanted (node, id), from their whole texts."""

    @forgetful()
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                texts = part.column(0).to_pylist()
                sets = [shingles(t, size) for t in texts]
                columns = [pa.array([f(t, s) for t, s in zip(texts, sets, strict=True)], pa.binary()) for f in (_node, lambda t, s: s[0].tobytes(), lambda t, s: s[1].astype("<u4").tobytes() if (s[1] > 1).any() else b"")]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "hashes", "counts"])

    ids = wanted.select(F.col("id").alias("_wanted"))
    texts = docs.select(F.col(id_col).alias("_id"), text_col).join(ids, F.col("_id").eqNullSafe(F.col("_wanted")), "left_semi").select(text_col)
    return texts.mapInArrow(work, "node binary, hashes binary, counts binary").join(wanted.select("node"), "node", "left_semi")


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of (sorted hashes, counts)."""
    shared = _held(a, b).sum()
    return shared / (a[1].sum() + b[1].sum() - shared)


def _held(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How much of each element of b is in a."""
    at = np.minimum(np.searchsorted(a[0], b[0]), len(a[0]) - 1)
    return np.where(a[0][at] == b[0], np.minimum(b[1], a[1][at]), 0)


def against_head(head: tuple, own: tuple, light: int, least: float) -> tuple[bool, bool, float, np.ndarray]:
    """(linked, open, limit, added): what the comparison of a set with the head of its group tells about the others.

    Two sets of a group share at most the lesser of what each shares with the head, and what both have
    beyond the head. `light` is the least weight in the group, so a set needs some amount of shared weight
    to be similar to any other. If it has that much in common with the head, it stays open, for partners of at
    most the weight `limit`. All other partners must have some of its elements beyond the head, too: of
    those, as many in the order of hashes are returned that a partner's cannot all be among the rest.
    """
    held = _held(head, own)
    shared, weight = held.sum(), own[1].sum()
    need = least / (1 + least) * (weight + max(light, least * weight)) - shared - 1e-9
    more = own[1] - held
    beyond = more > 0
    left = more.sum() - np.concatenate([[0], np.cumsum(more[beyond])])
    enough = left < need
    limit = shared * (1 + least) / least - weight + 1e-6
    return bool(shared / (head[1].sum() + weight - shared) >= least), bool(need <= 0), float(limit), own[0][beyond][: int(enough.argmax()) if enough.any() else len(left) - 1]


def compared(pairs: DataFrame, feature: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(u, v, u_pop, pop, linked, open, limit, weight, keys) of pairs (u, v, light, prune, u_pop, pop), by exact comparison of all shingles.

    weight is that of v. Where prune is set, keys name the groups in which v may meet partners that it
    shares more with than the head u (see against_head); else they are empty, open is true and limit infinite.
    """

    def weighted(hashes: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
        h = np.frombuffer(hashes, np.uint64)
        return h, np.frombuffer(counts, "<u4").astype(np.int64) if counts else np.ones(len(h), np.int64)

    @forgetful()
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked, opened, limits, weights, keys = [], [], [], [], []
            for i in range(batch.num_rows):
                u, light, prune, *sets = (batch.column(k)[i].as_py() for k in (0, 4, 5, 6, 7, 8, 9))
                head, own = weighted(*sets[:2]), weighted(*sets[2:])
                link, stays, limit, added = against_head(head, own, light, least)
                linked.append(link)
                opened.append(stays or not prune)
                limits.append(limit if prune else np.inf)
                weights.append(int(own[1].sum()))
                keys.append(_mix(added ^ np.uint64(int.from_bytes(u[:8], "little"))).view(np.int64) if prune else ())
            columns = [*batch.columns[:4], pa.array(linked, pa.bool_()), pa.array(opened, pa.bool_()), pa.array(limits, pa.float64()), pa.array(weights, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["u", "v", "u_pop", "pop", "linked", "open", "limit", "weight", "keys"])

    one = feature.withColumnsRenamed({"node": "u", "hashes": "uh", "counts": "uc"})
    two = feature.withColumnsRenamed({"node": "v", "hashes": "vh", "counts": "vc"})
    rows = pairs.join(one, "u").join(two, "v").select("u", "v", "u_pop", "pop", "light", "prune", "uh", "uc", "vh", "vc")
    return rows.mapInArrow(work, "u binary, v binary, u_pop long, pop long, linked boolean, open boolean, limit double, weight long, keys array<long>")


def shared_keys(members: DataFrame) -> DataFrame:
    """members (keys and other columns) without the keys that no other row holds; keys of a row are distinct.

    A key of one member makes no pair, and most are such. They are told by a sketch before they become rows:
    keys fall on slots, eight or more for each, and a slot met once holds no shared key. The slots met twice are at most
    SKETCHED bits (16 MB), the only thing that passes the driver. A slot may be met twice by chance, which leaves a key
    that pairs nothing; a shared key is never taken away. With more keys than SKETCHED all of them stay.
    """
    spark = members.sparkSession
    total = members.agg(F.sum(F.size("keys"))).first()[0] or 0
    if not 0 < total <= SKETCHED:
        return members
    bits = min(max(8 * total - 1, CHUNK).bit_length(), SKETCHED.bit_length() - 1)

    def slots(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = _mix(keys.view(np.uint64)) >> np.uint64(64 - bits)
        return (at >> np.uint64(3)).astype(np.int64), np.left_shift(1, (at & np.uint64(7)).astype(np.int64)).astype(np.uint8)

    @forgetful()
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(2**bits // 8, np.uint8), np.zeros(2**bits // 8, np.uint8)
        for batch in batches:
            keys, times = np.unique(batch.column(0).flatten().to_numpy(), return_counts=True)
            place, bit = slots(keys)
            # Keys that share a slot within a batch count as well: all but one of each slot are told by their order.
            _, first = np.unique(place * 8 + np.log2(bit).astype(np.int64), return_index=True)
            again = (times > 1) | ((once[place] & bit) > 0)
            again[np.setdiff1d(np.arange(len(keys)), first)] = True
            np.bitwise_or.at(twice, place[again], bit[again])
            np.bitwise_or.at(once, place, bit)
        step = CHUNK // 8
        for chunk in range(len(once) // step):
            part = slice(chunk * step, (chunk + 1) * step)
            if once[part].any():
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([once[part].tobytes()], pa.binary()), pa.array([twice[part].tobytes()], pa.binary())], names=["chunk", "once", "twice"])

    def merge(found: pa.Table) -> pa.Table:
        once, twice = np.zeros(CHUNK // 8, np.uint8), np.zeros(CHUNK // 8, np.uint8)
        for a, b in zip(found.column("once"), found.column("twice"), strict=True):
            one = np.frombuffer(a.as_py(), np.uint8)
            twice |= np.frombuffer(b.as_py(), np.uint8) | (once & one)
            once |= one
        return pa.table({"chunk": found.column("chunk")[:1], "twice": pa.array([twice.tobytes()], pa.binary())})

    marks = members.select("keys").coalesce(64).mapInArrow(mark, "chunk int, once binary, twice binary")
    met = np.zeros(2**bits // 8, np.uint8)
    for row in marks.groupBy("chunk").applyInArrow(merge, "chunk int, twice binary").collect():
        met[row.chunk * (CHUNK // 8) : (row.chunk + 1) * (CHUNK // 8)] = np.frombuffer(row.twice, np.uint8)
    known = spark.sparkContext.broadcast(met.tobytes())

    @forgetful()
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = np.frombuffer(known.value, np.uint8)
        for batch in batches:
            at = batch.schema.get_field_index("keys")
            keys = batch.column(at)
            flat, sizes = keys.flatten().to_numpy(), keys.value_lengths().to_numpy()
            place, bit = slots(flat)
            stays = (met[place] & bit) > 0
            ends = np.concatenate([[0], np.cumsum(stays)])[np.concatenate([[0], np.cumsum(sizes)])]
            left = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat[stays], pa.int64()))
            yield batch.set_column(at, "keys", left)

    return members.mapInArrow(keep, members.schema)


MEMBER = ("node", "class", "weight", "pop", "limit")


def _led(h: str, more: tuple[str, ...] = ()) -> list:
    """The columns of a struct h of a member as those of a head."""
    return [F.col(f"{h}.{x}").alias("head" if x == "node" else f"head_{x}") for x in (*MEMBER, *more)]


def _apart(least: float) -> Column:
    """Whether a member and a head of other class may be similar enough by their weights.

    No pair whose weights differ more can be; limits come from heads that both were compared with.
    """
    close = (F.least("weight", "head_weight") >= least * F.greatest("weight", "head_weight")) & (F.col("weight") <= F.col("head_limit")) & (F.col("head_weight") <= F.col("limit"))
    return (F.col("class") != F.col("head_class")) & close


def placed(large: DataFrame, most: int) -> DataFrame:
    """Members of groups (key, n, heavy, MEMBER) with place, that of the `most` first of each group, and met.

    met holds the least TOLD of the keys in which the node's limit rules out nobody: two nodes that
    have such a key in common are compared there.
    """
    order = Window.partitionBy("key").orderBy(F.desc("pop"), F.desc("node"))
    place = large.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).groupBy("key", "node").agg(F.min("place").alias("place"))
    met = large.where("limit >= heavy").groupBy("node").agg(F.slice(F.sort_array(F.collect_set("key")), 1, TOLD).alias("met"))
    return large.join(place, ["key", "node"], "left").join(met, "node", "left")


def once(members: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Rows of placed members, each with a head of its group that stands before it and may be similar.

    Near copies are together in nearly all of their groups. Such a pair is a row only where no key of met that both
    have comes before that of the group: with that key it is compared, in this round or when one of the two is a
    head there.
    """
    head = members.where("place is not null").select("key", F.struct(*MEMBER, "place", "met").alias("h")).select("key", *_led("h", ("place", "met")))
    before = F.col("place").isNull() | (F.col("place") > F.col("head_place"))
    first = F.coalesce(F.array_min(F.array_intersect("met", "head_met")) >= F.col("key"), F.lit(True))
    return members.join(head, "key").where((F.col("node") != F.col("head")) & before & _apart(least) & first)


def near_links(groups: DataFrame, feature: DataFrame, least: float = SIMILARITY) -> DataFrame | None:
    """Links (u, v) between similar nodes of groups (key, node, weight); None without groups. See linked()."""
    found = linked(groups, feature, least)
    return found and found[0]


def linked(groups: DataFrame, feature: DataFrame, least: float = SIMILARITY) -> tuple[DataFrame, DataFrame] | None:
    """Links (u, v) between similar nodes of groups (key, node, weight), and their components; None without groups.

    Every pair of one group that is similar enough is linked, directly or by others, and all pairs are never
    listed. In each round, the members of a group are compared with its head, the node that has most company.
    What a member lacks in common with the head rules out most partners at once, and the rest meet in smaller
    groups, named by what they have beyond the head (against_head). Groups whose members hang together
    already are done. Groups of at most SMALL members are compared in full. What of a large group is left
    after PRUNED rounds is compared with many heads, sixteen times as many in each further round. Near copies are
    together in nearly all of their groups, so there a pair is a row in the first of them only.

    Components are carried on: those of the rounds before stand for all links of these. Groups may come with n,
    the count of their rows.
    """

    company = groups if "n" in groups.columns else groups.join(groups.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key")
    popular = company.groupBy("node").agg(F.sum("n").alias("pop"))
    groups = groups.select("key", "node", "weight").join(popular, "node").withColumn("class", F.col("node")).withColumn("limit", F.lit(float("inf")))
    member = F.struct(*MEMBER)
    told, fresh, stars, turn = [], [], None, 0

    def components() -> DataFrame:
        links = reduce(DataFrame.unionByName, fresh).where("linked").select("u", "v")
        if stars is not None:
            links = links.union(stars.where("node != component"))
        fresh.clear()
        return connected_components(links)

    while True:
        split = turn < PRUNED
        head = [F.max_by(member, F.struct("pop", "node")).alias("h")] if split else []
        size = groups.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("weight").alias("light"), F.max("weight").alias("heavy"), F.min("class").alias("a"), F.max("class").alias("b"), *head).where("a != b")
        size = size.select("key", "n", "light", "heavy", *(_led("h") if split else []))
        groups = saved(groups.join(size, "key"), "near_groups")
        if groups.isEmpty():
            break
        few = F.col("n") <= (SMALL if turn else 2)
        large = groups.where(~few)
        if split:
            rows = (large if turn else groups.where(~few | _apart(least))).where(F.col("node") != F.col("head"))  # two of a group are a head and another
        else:
            large = saved(placed(large, 64 * 16 ** (turn - PRUNED)), "near_places")
            rows = once(large, least)
        pairs = rows.select(F.col("head").alias("u"), F.col("node").alias("v"), "light", (F.lit(split) & (F.col("n") > SMALL)).alias("prune"), F.col("head_pop").alias("u_pop"), "pop")
        if turn:
            own = groups.where(few).select("key", *MEMBER, "light")
            two = own.select("key", member.alias("h")).select("key", *_led("h"))
            both = own.join(two, "key").where(((F.col("head_pop") > F.col("pop")) | (F.col("head_pop") == F.col("pop")) & (F.col("head") > F.col("node"))) & _apart(least))
            pairs = pairs.unionByName(both.select(F.col("head").alias("u"), F.col("node").alias("v"), "light", F.lit(False).alias("prune"), F.col("head_pop").alias("u_pop"), "pop"))
        pairs = pairs.groupBy("u", "v").agg(F.min("light").alias("light"), F.max("prune").alias("prune"), F.max("u_pop").alias("u_pop"), F.max("pop").alias("pop"))
        now = saved(compared(pairs, feature, least), "near_told")
        told.append(now)
        fresh.append(now)
        if split:
            rest = large.where(F.col("node") != F.col("head"))
            still = now.where("open").select(F.col("u").alias("head"), F.col("v").alias("node"), F.lit(True).alias("open"), F.col("limit").alias("new_limit"))
            rest = rest.join(still, ["head", "node"], "left").where((F.col("n") <= SMALL) | F.col("open"))
            rest = rest.withColumn("limit", F.when(F.col("n") <= SMALL, F.col("limit")).otherwise(F.least("limit", "new_limit")))
        else:
            rest = large.where("place is null")
            if rest.isEmpty():
                break
        if turn:
            stars = components()
            leader = stars.withColumnRenamed("component", "leader")
        else:  # nodes with one leader hang together; that is enough for the second round
            leader = now.where("linked").groupBy("v").agg(F.max_by("u", F.struct("u_pop", "u")).alias("leader")).withColumnRenamed("v", "node")
        rest = rest.join(leader, "node", "left").select("key", "node", "weight", "pop", "limit", "leader")
        if split:  # only then pairs have keys
            apart = shared_keys(now.where(F.size("keys") > 0).select(F.col("v").alias("node"), "weight", "pop", "keys")).join(leader, "node", "left")
            rest = rest.unionByName(apart.select(F.explode("keys").alias("key"), "node", "weight", "pop", F.lit(float("inf")).alias("limit"), "leader"))
        groups = saved(rest.withColumn("class", F.coalesce("leader", "node")).drop("leader"), "near_rest")
        turn += 1
    if not told:
        return None
    links = reduce(DataFrame.unionByName, told).where("linked").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    return links, components() if fresh else stars


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY, size: int = SHINGLE) -> DataFrame:
    """(id, class_id, links) for every row: near-duplicate classes of texts whose shingles of `size` words are similar.

    Texts with equal shingles are one node from the start, so copies never meet in pairs. Nodes that
    share a band are a group, and near_links finds the similar pairs in it. Classes are the connected
    components of these links, class_id the least id in it, links the number of links found at the row's
    node. Words and shingles are as in words() and shingles(); texts without words are alike only if
    equal; null counts as empty; a class of null ids has a null class_id. Repeated rows and ids keep their
    rows; texts of any length are taken whole; other columns are ignored; an empty table gives no rows.
    """
    rows = saved(sketch(docs, id_col, text_col, least, size), "sketches")
    nodes = rows.groupBy("node").agg(F.min("id").alias("id"), F.first("weight").alias("weight"), F.first("bands").alias("bands"))
    bands = nodes.select("node", "weight", F.explode("bands").alias("key"))
    shared = bands.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = saved(bands.join(shared, "key"), "buckets")
    wanted = members.select("node").distinct().join(nodes.select("node", "id"), "node")
    feature = saved(features(docs, wanted, id_col, text_col, size), "features")
    found = linked(members, feature, least)
    known = nodes.select("node", "id")
    if found is None:
        known = known.select("node", "id", F.col("node").alias("component"), F.lit(0).cast("long").alias("links"))
    else:
        links, label = found
        degree = links.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("links"))
        known = known.join(label, "node", "left").join(degree, "node", "left").select("node", "id", F.coalesce("component", "node").alias("component"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
    known = saved(known, "near_nodes")
    least_id = known.groupBy("component").agg(F.min("id").alias("class_id"))
    by_node = known.join(least_id, "component").select("node", "class_id", "links")
    return rows.select("id", "node").join(by_node, "node").select("id", "class_id", "links")


def op3_near_dups(spark, sf_dir: str) -> DataFrame:
    """Every document's near-duplicate class."""
    docs = table(spark, sf_dir, "documents")
    return near_classes(docs).withColumnRenamed("id", "doc_id")
