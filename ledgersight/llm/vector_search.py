"""Nearest neighbours by randomly rotated one-bit codes.

A vector is turned by a random rotation and kept as the signs of its components, one bit each, with two
correction scalars: its length, and the inner product of the turned unit vector with its sign vector. A
query is turned too and cut to ``QUERY_BITS`` bits per component, so the inner product of query and signs is a sum of
bit counts of packed words. Divided by the correction it estimates the true inner product without bias,
within a bound known per vector. The best by estimate are computed exactly; then every vector whose
upper bound reaches the last of those is computed exactly as well.
"""

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import query, table
from .vector_dedup import usable

EPSILON = 3.0           # standard deviations of the estimate's error that the bound covers
ROUNDING = 1e-12        # of both lengths' product: what the estimate may lose in doubles
QUERY_BITS = 8
SHARD = 32_768          # vectors a task holds while queries pass
PART = 1_024            # queries that pass one copy of a shard
AT_ONCE = 32            # queries estimated together


@lru_cache(maxsize=8)
def rotation(dimension: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng([41, dimension]).normal(size=(dimension, dimension)))[0]


def _matrix(column) -> np.ndarray:
    """Vectors as they are: an inner product depends on their lengths."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _scaled(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vectors over a power of two near their largest entry, its exponent), so that no length leaves the doubles."""
    power = np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1]
    return np.ldexp(vectors, -power), power


def _pack(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as 64-bit words."""
    packed = np.packbits(bits, axis=1, bitorder="little")
    short = -packed.shape[1] % 8
    return np.ascontiguousarray(np.pad(packed, ((0, 0), (0, short)))).view(np.uint64)


class Codes:
    """One-bit codes of some vectors (rows of ``vectors``)."""

    def __init__(self, vectors: np.ndarray):
        self.dim = d = vectors.shape[1]
        vectors, power = _scaled(vectors)
        length = np.linalg.norm(vectors, axis=1)
        turned = vectors / length[:, None] @ rotation(d)
        self.length = np.ldexp(length, power[:, 0])
        self.words = _pack(turned > 0)
        self.ones = np.bitwise_count(self.words).sum(1, dtype=np.int64)
        self.match = np.abs(turned).sum(1) / np.sqrt(d)
        self.error = np.sqrt(np.maximum(0, 1 - self.match ** 2)) / self.match / np.sqrt(max(1, d - 1))

    def estimate(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(estimates, bounds of their errors), a row per query."""
        d, top = self.dim, (1 << QUERY_BITS) - 1
        turned = queries @ rotation(d)
        low = turned.min(1, keepdims=True)
        step = np.maximum((turned.max(1, keepdims=True) - low) / top, 1e-300)
        level = np.rint((turned - low) / step).astype(np.int64)
        total = np.zeros((len(queries), len(self.words)), dtype=np.uint32)
        for bit in range(QUERY_BITS):
            plane = _pack(level >> bit & 1)
            for word in range(plane.shape[1]):
                ones = np.bitwise_count(plane[:, word, None] & self.words[None, :, word])
                total += np.left_shift(ones, bit, dtype=np.uint32)
        picked = low * self.ones[None, :] + step * total       # sum of the query where the code is 1
        signed = (2 * picked - (low * d + step * level.sum(1, keepdims=True))) / np.sqrt(d)
        scale = self.length / self.match
        norm = np.linalg.norm(queries, axis=1, keepdims=True)
        rounding = step * np.sqrt(1 / 3) * scale[None, :]
        bound = EPSILON * (norm * (self.length * self.error)[None, :] + rounding)
        return signed * scale[None, :], bound + ROUNDING * norm * self.length[None, :]


def best(queries: np.ndarray, q_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, codes: Codes, k: int):
    """(query number, vector number, exact score) of each query's k best, ties to the smaller id."""
    scaled, power = _scaled(queries)
    guess, bound = codes.estimate(scaled)
    own = q_ids[:, None] == ids[None, :]
    guess[own] = -np.inf
    first = min(2 * k, len(ids))
    tried = np.argpartition(-guess, first - 1, axis=1)[:, :first]
    exact = np.einsum("qd,qkd->qk", queries, vectors[tried])
    exact[np.take_along_axis(own, tried, 1)] = -np.inf
    last = np.sort(exact, axis=1)[:, -min(k, first)]
    # -inf: fewer than k candidates were tried, so all are taken
    chosen = ~(np.ldexp(guess + bound, power) < last[:, None])      # scores beyond the doubles are not dropped
    np.put_along_axis(chosen, tried, True, 1)
    q, v = np.nonzero(chosen & ~own)
    score = np.empty(len(q))
    for start in range(0, len(q), 65_536):
        part = slice(start, start + 65_536)
        score[part] = np.einsum("nd,nd->n", queries[q[part]], vectors[v[part]])
    order = np.lexsort((ids[v], -score, q))
    q, v, score = q[order], v[order], score[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    keep = place < k
    return q[keep], v[keep], score[keep]


def distinct(ids: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Ids and vectors without repeated rows, and how many different rows an id has at most."""
    _, place, times = np.unique(ids, return_inverse=True, return_counts=True)
    if times.max() == 1:
        return ids, vectors, 1
    seen, keep = set(), times[place] == 1
    for i in np.flatnonzero(~keep):
        row = ids[i], vectors[i].tobytes()
        keep[i] = row not in seen
        seen.add(row)
    return ids[keep], vectors[keep], int(np.unique(ids[keep], return_counts=True)[1].max())


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, rows_per_shard: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id, score: for each vec_id of ``queries`` its k vec_ids of ``vectors`` of largest inner product.

    Both have vec_id and embedding. A row of the query's own vec_id is no candidate. Null or zero
    vectors, those with null or non-finite components and those of another dimension than the query take no
    part; null vec_ids neither. Equal scores go to the smaller vec_id. Repeated rows count once; where rows of one vec_id
    differ, on either side, its score with another vec_id is the largest of theirs. Vectors are dealt to shards and queries to parts, both of
    bounded size; every shard meets every part and gives each query's k best.
    """
    def clean(df, role):
        ok = usable(df.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding")).where("vec_id is not null")
        return ok.select("vec_id", "embedding", F.size("embedding").alias("dim"), F.lit(role).alias("role"))

    candidates, asked = clean(vectors, 0), clean(queries, 1)
    shards = max(1, -(-candidates.count() // rows_per_shard))
    parts = max(1, -(-asked.count() // PART))
    spread = lambda n: F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    both = candidates.withColumn("shard", spread(shards)).withColumn("part", every(parts)).unionByName(
        asked.withColumn("part", spread(parts)).withColumn("shard", every(shards)))
    both = both.withColumn("shard", F.col("shard") * parts + F.col("part")).drop("part")
    key = ["shard", "dim"]
    dealt = both.repartitionByRange(shards * parts, "shard").sortWithinPartitions(*key, "role", "vec_id")

    def run(batches):
        current, held, codes, ids, base, most = None, [], None, None, None, 1
        for batch in batches:
            shard, dim, role = (batch[c].to_numpy() for c in ("shard", "dim", "role"))
            start = 0
            while start < batch.num_rows:
                key = shard[start], dim[start]
                same = (shard == key[0]) & (dim == key[1]) & (role == role[start])
                end = start + int(np.argmin(same[start:])) if not same[start:].all() else batch.num_rows
                part = batch.slice(start, end - start)
                if key != current:
                    current, held, codes = key, [], None
                if role[start] == 0:
                    held.append(part)
                elif held:
                    if codes is None:
                        ids = np.concatenate([p["vec_id"].to_numpy() for p in held])
                        base = np.concatenate([_matrix(p["embedding"]) for p in held])
                        ids, base, most = distinct(ids, base)
                        codes = Codes(base)
                    for a in range(0, part.num_rows, AT_ONCE):
                        some = part.slice(a, AT_ONCE)
                        q_ids, q = some["vec_id"].to_numpy(), _matrix(some["embedding"])
                        i, j, score = best(q, q_ids, base, ids, codes, k * most)
                        yield pa.record_batch({"query_id": pa.array(q_ids[i]), "vec_id": pa.array(ids[j]), "score": pa.array(score)})
                start = end

    found = dealt.mapInArrow(run, "query_id bigint, vec_id bigint, score double")
    found = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


@query("op4_one_bit_search")
def op4(spark, base):
    rows = table(spark, base, "embeddings")
    return nearest(rows, rows.where(F.col("vec_id") % 20 == 0))
