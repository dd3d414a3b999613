"""Near-duplicate vectors by spherical-cap filters.

A filter is a direction of a randomly rotated product code: the space is cut into two blocks, each with
the same number of random unit codewords, and every pair of codewords is a direction. A vector's home
is the direction nearest to it, found block by block. A vector is also list-decoded to all directions
whose inner product with it comes within ``reach`` of its home's: codewords of the first block are
taken in falling order until no partner of the second block suffices. For a pair above the threshold
the other's home is within reach but for chance: both scores of a direction differ by a random term of
standard deviation sin(angle) / sqrt(dimension), and ``reach`` is 6 of those of a difference.
Vectors meet at (label, direction): each home member against all that were decoded to it. Every link is
found once from each side, so link counts need no pairs; a task emits counts and a local spanning forest.
"""

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, query, table
from .components import components

SIGMAS = 6.0
MEMBERS = 64        # home members a direction should have on average
CODEWORDS = (3, 64)  # least and most per block
SHARE = 2_000       # members or probes one task compares at a time in a full cell


@lru_cache(maxsize=8)
def code(dimension: int, codewords: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rotation, codewords of block one, of block two), the same everywhere."""
    draw = np.random.default_rng([20, dimension, codewords])
    rotation = np.linalg.qr(draw.normal(size=(dimension, dimension)))[0]
    half = max(1, dimension // 2)
    blocks = [draw.normal(size=(codewords, n)) for n in (half, max(1, dimension - half))]
    return rotation, *(b / np.linalg.norm(b, axis=1, keepdims=True) for b in blocks)


def decode(vectors: np.ndarray, codewords: int, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(home of each row, row numbers, directions they are decoded to)."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    rotation, one, two = code(vectors.shape[1], codewords)
    turned = unit @ rotation
    half = one.shape[1]
    a, b = turned[:, :half] @ one.T / math.sqrt(2), turned[:, half:half + two.shape[1]] @ two.T / math.sqrt(2) if vectors.shape[1] > 1 else np.zeros((len(unit), codewords))
    home = a.argmax(1) * codewords + b.argmax(1)
    best_b = b.max(1)
    least = a.max(1) + best_b - reach
    rows, found = [], []
    order = np.argsort(-a, axis=1)
    for place in range(codewords):
        i = order[:, place]
        top = np.take_along_axis(a, i[:, None], 1)[:, 0]
        going = np.flatnonzero(top + best_b >= least)       # the others are done: later ones score lower
        if not len(going):
            break
        r, j = np.nonzero(top[going, None] + b[going] >= least[going, None])
        rows.append(going[r])
        found.append(i[going[r]] * codewords + j)
    return home, np.concatenate(rows), np.concatenate(found)


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows whose vector has only finite components and is not zero."""
    x = F.col(column)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.where(x.isNotNull() & ~bad & F.exists(x, lambda v: v != 0))


def _matrix(column) -> np.ndarray:
    """Vectors divided by a power of two near their largest entry: no cosine changes, and no length leaves the doubles."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return np.ldexp(values, -np.frexp(np.abs(values).max(axis=1, keepdims=True))[1])


def cells(reps: DataFrame, codewords: int, threshold: float) -> DataFrame:
    """label, dim, cell, member (1 home, 0 decoded), rep, n, embedding."""
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            dims = batch["dim"].to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                reach = SIGMAS * math.sqrt(2 * (1 - threshold ** 2) / max(1, dim - 1))
                home, rows, found = decode(_matrix(part["embedding"]), codewords, reach)
                take = pa.array(np.concatenate([np.arange(part.num_rows), rows]))
                out = part.take(take)
                yield pa.record_batch({
                    "label": out["label"], "dim": out["dim"], "cell": pa.array(np.concatenate([home, found])),
                    "member": pa.array(np.repeat([1, 0], [part.num_rows, len(rows)]), pa.int32()),
                    "rep": out["rep"], "n": out["n"], "embedding": out["embedding"]})

    kind = dict(reps.dtypes)
    return reps.mapInArrow(run, f"label {kind['label']}, dim int, cell bigint, member int, rep bigint, n bigint, "
                                f"embedding {kind['embedding']}")


def _compare(ids, vectors, m_ids, m_vectors, m_n, threshold):
    """(links of each probe, (id, smaller id) that span what is linked here)."""
    norms, m_norms = np.linalg.norm(vectors, axis=1), np.linalg.norm(m_vectors, axis=1)
    near = vectors @ m_vectors.T / (norms[:, None] * m_norms[None, :]) >= threshold
    near &= ids[:, None] != m_ids[None, :]
    links = near @ m_n
    some, m_some = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
    if not len(some):
        return links, []
    near = near[np.ix_(some, m_some)]
    low, m_low = ids[some].copy(), m_ids[m_some].copy()
    none = np.iinfo(np.int64).max
    while True:
        new = np.minimum(low, np.where(near, m_low[None, :], none).min(1))
        m_new = np.minimum(m_low, np.where(near, new[:, None], none).min(0))
        if (new == low).all() and (m_new == m_low).all():
            break
        low, m_low = new, m_new
    return links, [(a, b) for a, b in zip(np.concatenate([ids[some], m_ids[m_some]]).tolist(),
                                          np.concatenate([low, m_low]).tolist()) if a != b]


def links(cells: DataFrame, threshold: float) -> DataFrame:
    """rep, other, links: other null where links are counted, links null where a linked pair is told."""
    share = max(SHARE, cells.count() // 500)
    sizes = cells.groupBy("label", "dim", "cell").agg(F.sum("member").alias("m"), F.sum(1 - F.col("member")).alias("p"))
    full = F.broadcast(materialise(sizes.where(f"m > {share} or p > {share}").select(     # 1000 rows at most
        "label", "dim", "cell", F.ceil(F.col("m") / share).cast("int").alias("mp"), F.ceil(F.col("p") / share).cast("int").alias("pp"))))
    at = ["label", "dim", "cell"]
    own = F.xxhash64("rep")
    dealt = cells.join(full, at, "left").withColumns({
        "mp": F.greatest(F.coalesce("mp", F.lit(1)), F.lit(1)), "pp": F.greatest(F.coalesce("pp", F.lit(1)), F.lit(1))})
    # a member goes to its part and all parts of probes, a probe the other way round
    mine = F.pmod(own, F.when(F.col("member") == 1, F.col("mp")).otherwise(F.col("pp"))).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.when(F.col("member") == 1, F.col("pp")).otherwise(F.col("mp")) - 1))
    dealt = dealt.withColumn("mine", mine).withColumn("other", others).withColumns({
        "ms": F.when(F.col("member") == 1, F.col("mine")).otherwise(F.col("other")),
        "ps": F.when(F.col("member") == 1, F.col("other")).otherwise(F.col("mine"))})
    key = [*at, "ms", "ps"]
    dealt = dealt.select(*key, "member", "rep", "n", "embedding").repartition(*key).sortWithinPartitions(*key, F.desc("member"), "rep")

    def run(batches):
        current, held = None, []
        for batch in batches:
            keys = list(zip(*(batch[c].to_pylist() for c in key)))
            member = batch["member"].to_numpy()
            start = 0
            while start < batch.num_rows:
                end = start + 1
                while end < batch.num_rows and keys[end] == keys[start] and member[end] == member[start]:
                    end += 1
                part = batch.slice(start, end - start)
                if keys[start] != current:
                    current, held = keys[start], []
                if member[start]:
                    held.append(part)
                elif held:
                    ids, vectors = part["rep"].to_numpy(), _matrix(part["embedding"])
                    counted = np.zeros(len(ids), dtype=np.int64)
                    told = []
                    for block in held:
                        n, pairs = _compare(ids, vectors, block["rep"].to_numpy(), _matrix(block["embedding"]), block["n"].to_numpy(), threshold)
                        counted += n
                        told += pairs
                    hit = np.flatnonzero(counted)
                    a = ids[hit].tolist() + [x for x, _ in told]
                    b = [None] * len(hit) + [y for _, y in told]
                    c = counted[hit].tolist() + [None] * len(told)
                    yield pa.record_batch([pa.array(x, pa.int64()) for x in (a, b, c)], names=["rep", "other", "links"])
                start = end

    return dealt.mapInArrow(run, "rep bigint, other bigint, links bigint")


def near_vectors(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row.

    Rows are compared within equal labels that are not null, and within equal dimension. Null or zero
    vectors and those with null or non-finite components link with nothing. Equal vectors are compared
    once and linked with each other. Repeated vec_ids are separate rows for the counts. A null vec_id takes part
    and gets the smallest id of its component that is not null.
    """
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding", "label")
    good = usable(rows.where(F.col("label").isNotNull()))
    reps = materialise(good.groupBy("label", "embedding").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n"))
                       .withColumn("dim", F.size("embedding")).withColumn("rep", F.monotonically_increasing_id()))
    size = reps.agg(F.count(F.lit(1)), F.approx_count_distinct("label")).first()
    codewords = min(CODEWORDS[1], max(CODEWORDS[0], round(math.sqrt(size[0] / max(1, size[1]) / MEMBERS))))
    dealt = materialise(cells(reps, codewords, threshold))
    found = materialise(links(dealt, threshold))
    joined = components(found.where("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    counted = found.where("links is not null").groupBy("rep").agg(F.sum("links").alias("links"))
    known = reps.select("rep", "first", "n", "label", "embedding").join(joined.withColumnRenamed("id", "rep"), "rep", "left").join(
        counted, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    known = materialise(known)
    least = materialise(known.groupBy("component").agg(F.min("first").alias("component_id")))
    facts = materialise(known.join(least, "component").select(
        "label", "embedding", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"))
    return rows.join(facts, ["label", "embedding"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(True)).alias("kept"))


@query("op3_cap_filter_dedup")
def op3(spark, base):
    return near_vectors(table(spark, base, "embeddings"))
