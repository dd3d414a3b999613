"""Near-duplicate documents by BagMinHash.

A document is the multiset of its five-word shingles. A shingle of weight w (its count) takes part in
the weight levels 1 to w. Levels are joined in blocks of doubling width, 1, 1, 2, 4, ..., each with a
Poisson process of its own, seeded by shingle and block; a point has a time, a slot and a level, and counts where
the level is within the weight. A slot keeps its earliest point. Two documents agree in a slot with
probability sum(min) / sum(max) of their weights, the weighted Jaccard similarity. Points are drawn in rising time
until the latest slot is settled, so a document costs about slots * ln(slots) points and one look at each shingle.

Slots are banded; documents that agree in a band meet in a bucket, and buckets connect families. Copies
(equal multisets) are one document here. A family is compared within tasks, in blocks of bounded documents and shingles (on average; a document is never cut), every
block with every other. A task takes one document after the other as centre and compares all others with it,
until all documents that have not been centre are of one class: every pair has then been compared or is of one
class already, a group of near copies costs few centres, and only links that join classes leave the task.
"""

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, query, table
from .components import components

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 40, 6         # at similarity 0.8 all bands miss with probability 5e-6
SHARE = 2_000               # documents in a block of a family
SHINGLES = 4_000_000        # shingles in it (8 bytes each)
MAX_WORDS = 300_000         # word hashes kept by a task

_U = np.uint64
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], dtype=_U)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit permutation (splitmix finaliser)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) >= MAX_WORDS:
            self.clear()
        self[word] = value
        return value


@lru_cache(maxsize=1)
def _word_hashes() -> WordHashes:
    return WordHashes()


def shingles(text: str, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes in order, counts). Words end at ASCII blanks, A-Z lower-cased.

    A text of fewer words is one shingle; without words it has none.
    """
    found = text.encode().lower().split()
    if not found:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    h = np.fromiter(map(_word_hashes().__getitem__, found), dtype=_U, count=len(found))
    n = min(words, len(h))
    total = np.full(len(h) - n + 1, n, dtype=_U)
    for i in range(n):
        total = mix(total * ODD[i % 5] + h[i:len(h) - n + 1 + i])
    return np.unique(total, return_counts=True)


def signature(items: np.ndarray, weights: np.ndarray, slots: int) -> np.ndarray:
    """Earliest time in each slot; all infinite for an empty multiset."""
    times = np.full(slots, np.inf)
    if not len(items):
        return times
    seed, width, cover = [], [], []
    start, block = 0, 0
    while True:
        size = 1 if block < 2 else 1 << (block - 1)
        salt = mix(np.array([block], _U))
        deep = weights > start
        if not deep.any():
            break
        seed.append(mix(items[deep] + salt))
        width.append(np.full(len(seed[-1]), size, dtype=np.float64))
        cover.append(np.minimum(weights[deep] - start, size))
        start, block = start + size, block + 1
    seed, width, cover = map(np.concatenate, (seed, width, cover))
    now, drawn = np.zeros(len(seed)), 0
    while len(seed):
        # the n-th point depends on seed and n alone, not on how many are drawn at once
        many = max(1, 6 * slots // len(seed))
        n = np.arange(drawn, drawn + many, dtype=_U)
        first = mix(seed[:, None] + n[None, :] * ODD[0])
        second = mix(first ^ ODD[2])
        gap = -np.log((first >> _U(11)).astype(np.float64) * 2.0 ** -53 + 2.0 ** -54) / (width[:, None] * slots)
        at = now[:, None] + np.cumsum(gap, axis=1)
        level = ((second >> _U(32)) % width[:, None].astype(_U)).astype(np.int64)
        valid = level < cover[:, None]
        np.minimum.at(times, (second & _U(0xFFFFFFFF))[valid] % _U(slots), at[valid])
        now, drawn = at[:, -1], drawn + many
        going = now < times.max()
        seed, width, cover, now = seed[going], width[going], cover[going], now[going]
    return times


def bands(times: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A 64-bit key of each band."""
    rows = times.view(_U).reshape(bands, -1)
    key = np.arange(bands, dtype=_U)
    for i in range(rows.shape[1]):
        key = mix(key * ODD[i % 5] + rows[:, i])
    return key.view(np.int64)


def expanded(items: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A set whose intersections are as large as those of the multiset: the n-th copy is an item of its own."""
    if counts.max(initial=1) == 1:
        return items
    nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    again = np.repeat(items, counts)
    return np.where(nth == 0, again, mix(again ^ mix(nth.astype(_U))))


def joining_links(sets: list[np.ndarray], side: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Pairs of similar sets (by place) that connect all pairs of similar sets.

    Where ``side`` has two values, only pairs across it count.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets])
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    start = np.cumsum(size) - size
    company = np.add.reduceat(np.bincount(ids)[ids], start) / size
    order = np.argsort(-company, kind="stable")
    two, of, waiting, links = side.min() != side.max(), np.arange(n), np.ones(n, bool), []
    flag = np.zeros(ids.max() + 1, dtype=np.int32)
    while True:
        left = order[waiting[order]]
        if not len(left) or (of[left] == of[left[0]]).all() or two and (side[left] == side[left[0]]).all():
            return links
        spared = np.bincount(of[left]).argmax() if len(left) < n else -1
        centre = left[of[left] != spared][0]
        waiting[centre] = False
        own = ids[start[centre]:start[centre] + size[centre]]
        flag[own] = 1
        both = np.add.reduceat(flag[ids], start)
        flag[own] = 0
        near = both >= least * (size + size[centre] - both)
        near &= of != of[centre]
        if two:
            near &= side != side[centre]
        found = np.flatnonzero(near)
        _, first = np.unique(of[found], return_index=True)
        links += [(int(centre), int(x)) for x in found[first]]
        of[np.isin(of, of[found])] = of[centre]


def signatures(rows: DataFrame) -> DataFrame:
    """id, h, f1, f2 (of the multiset; null without words), keys."""
    def run(batches):
        for batch in batches:
            f1, f2, keys = [], [], []
            for text in batch["text"]:
                items, counts = shingles(text.as_py())
                if not len(items):
                    f1.append(None), f2.append(None), keys.append([])
                    continue
                weight = counts.astype(_U)
                f1.append(int((mix(items ^ ODD[3]) * weight).sum().view(np.int64)))
                f2.append(int((mix(items ^ ODD[4]) * weight).sum().view(np.int64)))
                keys.append(bands(signature(items, counts, BANDS * ROWS)))
            yield pa.record_batch({"id": batch["id"], "h": batch["h"], "f1": pa.array(f1, pa.int64()), "f2": pa.array(f2, pa.int64()),
                                   "keys": pa.array(keys, pa.list_(pa.int64()))})
        _word_hashes.cache_clear()      # a reused worker does not keep it for later stages

    return rows.mapInArrow(run, "id bigint, h bigint, f1 bigint, f2 bigint, keys array<bigint>")


def multisets(rows: DataFrame) -> DataFrame:
    """rep, items (binary: the expanded multiset), n (their number) of rows with rep and text."""
    def run(batches):
        for batch in batches:
            sets = [expanded(*shingles(t.as_py())) for t in batch["text"]]
            yield pa.record_batch({"rep": batch["rep"], "items": pa.array([s.tobytes() for s in sets], pa.binary()),
                                   "n": pa.array([len(s) for s in sets], pa.int64())})
        _word_hashes.cache_clear()

    return rows.mapInArrow(run, "rep bigint, items binary, n bigint")


def block_counts(families: DataFrame, features: DataFrame, share: int) -> DataFrame:
    """family, blocks: so many that a block has about ``share`` documents and ``SHINGLES`` shingles at most."""
    sized = families.join(features.select("rep", "n"), "rep").groupBy("family").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("n"))
    return sized.select("family", F.greatest(F.ceil(F.col("docs") / share), F.ceil(F.col("n") / SHINGLES)).cast("int").alias("blocks"))


def family_links(families: DataFrame, features: DataFrame, least: float, share: int = SHARE) -> DataFrame:
    """Links a, b that connect all similar documents of a family (rep, family); stored."""
    placed = families.join(block_counts(families, features, share), "family").withColumn("own", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "rep", "family", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    key = ["family", "low", "high"]
    dealt = placed.join(features.select("rep", "items"), "rep").repartition(*key).sortWithinPartitions(*key, "rep")

    def run(batches):
        def close():
            if len(reps) > 1:
                found = joining_links(sets, np.array(side), least)
                if found:
                    yield pa.record_batch([pa.array([reps[i] for i, _ in found], pa.int64()),
                                           pa.array([reps[j] for _, j in found], pa.int64())], names=["a", "b"])

        current, reps, sets, side = None, [], [], []
        for batch in batches:
            keys = zip(*(batch[c].to_pylist() for c in key))
            for k, rep, own, items in zip(keys, batch["rep"].to_pylist(), batch["own"].to_pylist(), batch["items"]):
                if k != current:
                    yield from close()
                    current, reps, sets, side = k, [], [], []
                reps.append(rep)
                side.append(own)
                sets.append(np.frombuffer(items.as_py(), _U))
        yield from close()

    return materialise(dealt.mapInArrow(run, "a bigint, b bigint"))


def near_documents(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """doc_id, h (hash of the text), class_id (smallest doc_id of its class), kept of every row.

    Documents are linked at a weighted Jaccard similarity of ``least`` or more of their five-word shingles,
    and classes are what links connect; the row of the smallest doc_id, then h, is kept. Equal multisets are copies; texts
    without words (null, empty, blank) link with nothing and are kept. Repeated rows get equal results. A null doc_id is below
    all others, so it is the class_id where its class has one.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    signed = materialise(signatures(rows))
    worded = signed.where("f1 is not null")
    reps = materialise(worded.groupBy("f1", "f2").agg(F.min(F.struct("id", "h")).alias("one"), F.first("keys").alias("keys"))
                       .withColumn("rep", F.monotonically_increasing_id()))
    keyed = reps.select("rep", F.explode("keys").alias("key"))
    buckets = keyed.groupBy("key").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).where("least <> most")
    joined = keyed.join(buckets.select("key", F.col("least").alias("b")), "key").where("rep <> b").select(F.col("rep").alias("a"), "b")
    families = components(joined).select(F.col("id").alias("rep"), F.col("component").alias("family"))
    families = materialise(families)
    asked = families.select("rep").join(reps.select("rep", "one.id", "one.h"), "rep")
    features = materialise(multisets(
        rows.join(asked, rows["id"].eqNullSafe(asked["id"]) & (rows["h"] == asked["h"])).select("rep", "text").dropDuplicates(["rep"])))
    links = family_links(families, features, least)
    classes = reps.select("f1", "f2", "rep", F.col("one").alias("first"))
    classes = classes.join(components(links).withColumnRenamed("id", "rep"), "rep", "left")
    classes = materialise(classes.withColumn("component", F.coalesce("component", "rep")))
    lowest = materialise(classes.groupBy("component").agg(F.min("first").alias("lowest")))
    classes = materialise(classes.join(lowest, "component").select("f1", "f2", "lowest"))
    own = F.struct("id", "h")
    return signed.select("id", "h", "f1", "f2").join(classes, ["f1", "f2"], "left").select(
        F.col("id").alias("doc_id"), "h", F.coalesce("lowest", own)["id"].alias("class_id"),
        F.coalesce(F.col("lowest").eqNullSafe(own), F.lit(True)).alias("kept_row"), F.col("lowest").isNull().alias("alone")).select(
        "doc_id", "h", "class_id", (F.col("kept_row") | F.col("alone")).alias("kept"))


def drop_near_copies(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Rows of ``docs`` (any columns), one of each class; repeated rows count as copies even without words."""
    found = near_documents(docs, least).where("kept").select(
        F.coalesce("doc_id", F.lit(-(1 << 63)).cast("bigint")).alias("__d"), F.col("h").alias("__h")).distinct()
    keyed = docs.withColumns({"__d": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63)).cast("bigint")),
                              "__h": F.xxhash64(F.coalesce("text", F.lit("")))})
    return keyed.join(found, ["__d", "__h"]).dropDuplicates(["__d", "__h"]).drop("__d", "__h")


@query("op10_bag_minhash")
def op10(spark, base):
    return near_documents(table(spark, base, "documents")).select("doc_id", "class_id", "kept")
