"""Best-fit packing after dominance reduction.

The instance is the histogram of piece lengths: at most ``capacity`` different lengths, whatever the
number of pieces. The reduction goes through the lengths from the largest; where few pieces fit beside
one, it looks for a set that dominates every other way to fill its sequence and fixes that set for as
many pieces as there are. What is left is packed best-fit, longest first, equal sequences at once.
The resulting patterns hold length classes; pieces get a rank within their length, and rank ranges are
handed to the patterns, so no task or driver holds the pieces.
"""

import zlib
from bisect import bisect_left, bisect_right, insort
from dataclasses import dataclass, field

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import read_ranks
from .common import documents, materialise, query, table

CAPACITY = 2048


@dataclass
class Plan:
    """Patterns: ([(length, how many), ...], number of sequences filled so)."""

    patterns: list = field(default_factory=list)
    fixed: int = 0          # sequences fixed by the reduction

    def add(self, content, times):
        if times:
            self.patterns.append((content, times))


class Histogram:
    """Lengths with pieces left, in order, and their counts."""

    def __init__(self, counts: dict[int, int]):
        self.count = {k: n for k, n in counts.items() if n > 0}
        self.lengths = sorted(self.count)

    def take(self, length: int, n: int) -> None:
        self.count[length] -= n
        if not self.count[length]:
            del self.count[length]
            del self.lengths[bisect_left(self.lengths, length)]

    def largest(self, limit: int, without: tuple = ()) -> int:
        """Longest length up to ``limit`` with a piece left beside those in ``without``; 0 if none."""
        at = bisect_right(self.lengths, limit) - 1
        while at >= 0 and self.count[self.lengths[at]] <= without.count(self.lengths[at]):
            at -= 1
        return self.lengths[at] if at >= 0 else 0

    def smallest(self, n: int, without: int) -> int | None:
        """Sum of the n shortest pieces beside one of length ``without``; None if there are fewer."""
        total, need = 0, n
        for length in self.lengths:
            have = min(need, self.count[length] - (length == without))
            total, need = total + have * length, need - have
            if not need:
                return total
        return None


def dominating(left: Histogram, a: int, capacity: int) -> tuple | None:
    """Lengths of a set with ``a`` that dominates all feasible sets with it, where one is known."""
    room = capacity - a
    single = left.largest(room, (a,))
    if not single:
        return (a,)
    if single == room:
        return a, single                    # an exact fit replaces whatever else would be there
    two, three = left.smallest(2, a), left.smallest(3, a)
    if two is None or two > room:
        return a, single                    # one piece at most fits beside it
    if three is not None and three <= room:
        return None
    # two at most fit beside it: the best pair, and the largest smaller half of any pair
    best, pair, half = 0, None, 0
    for r in reversed(left.lengths[:bisect_right(left.lengths, room)]):
        if left.count[r] <= (a == r):
            continue
        s = left.largest(min(r, room - r), (a, r))
        if s:
            half = max(half, s)
            if r + s > best:
                best, pair = r + s, (r, s)
    if single >= best:
        return a, single
    # the pair holds the longest piece that fits and, as its other half, one at least as long as the
    # shorter half of any pair: each feasible set can be exchanged for it piece by piece
    return (a, *pair) if pair[0] == single and pair[1] >= half else None


def reduce_instance(left: Histogram, plan: Plan, capacity: int) -> None:
    """Fix dominating sets, from the longest length down, until a pass over all lengths fixes none."""
    changed = True
    while changed:
        changed, at = False, len(left.lengths) - 1
        while at >= 0:
            a = left.lengths[at] if at < len(left.lengths) else left.lengths[-1]
            found = dominating(left, a, capacity)
            if found:
                use = {x: found.count(x) for x in found}
                times = min(left.count[x] // n for x, n in use.items())
                plan.add(sorted(use.items(), reverse=True), times)
                plan.fixed += times
                for x, n in use.items():
                    left.take(x, n * times)
                changed = True
                at = bisect_right(left.lengths, a) - 1
            else:
                at = bisect_left(left.lengths, a) - 1


def best_fit(left: Histogram, plan: Plan, capacity: int) -> None:
    """Longest first, each piece into the fullest sequence that takes it; equal sequences together."""
    open_rooms, rooms = {}, []       # room -> [(content, sequences)], and the rooms in order

    def put(room, content, times):
        if times:
            if room not in open_rooms:
                insort(rooms, room)
            open_rooms.setdefault(room, []).append((content, times))

    for a in reversed(list(left.lengths)):
        n = left.count[a]
        while n:
            at = bisect_left(rooms, a)
            room = rooms[at] if at < len(rooms) else capacity
            each = room // a         # the piece's equals follow it into the same sequence
            if at < len(rooms):
                content, times = open_rooms[room].pop()
                if not open_rooms[room]:
                    del open_rooms[room], rooms[at]
            else:
                content, times = [], -(-n // each)
            full = min(times, n // each)
            put(room - each * a, content + [(a, each)], full)
            n -= full * each
            times -= full
            if n and times:          # fewer than fill one more
                put(room - n * a, content + [(a, n)], 1)
                n, times = 0, times - 1
            if content:
                put(room, content, times)
    for groups in open_rooms.values():
        for content, times in groups:
            plan.add(content, times)


def plan_lengths(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Patterns that hold every piece of the histogram once."""
    left, plan = Histogram(counts), Plan()
    reduce_instance(left, plan, capacity)
    best_fit(left, plan, capacity)
    return plan


def slots(plan: Plan) -> np.ndarray:
    """Rows (length, first rank, pieces per sequence, first sequence, offset), ordered by length and rank."""
    rows, rank, sequence = [], {}, 0
    for content, times in plan.patterns:
        offset = 0
        for length, each in content:
            first = rank.get(length, 0)
            rows.append((length, first, each, sequence, offset))
            rank[length] = first + each * times
            offset += each * length
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = 0, ranks: str | None = None,
           tokenizer: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each text's ids and ``end_id``, cut only where too long.

    Ids are those of ``tokenizer`` without added special tokens. The rank file holds the same vocabulary
    and gives the same ids at a quarter of the time, so it is used wherever no special token's
    string is in the text. Of a text that is cut, the first piece holds the remainder.
    """
    ranks = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    tokenizer = tokenizer or public_tokenizers.path("byte_bpe_50k.json")

    def run(batches):
        import tiktoken
        from tokenizers import Tokenizer

        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(ranks), special_tokens={})
        slow = Tokenizer.from_file(tokenizer)
        special = [t.content for t in slow.get_added_tokens_decoder().values()]

        def cut(text):
            ids = (slow.encode(text, add_special_tokens=False).ids if any(s in text for s in special)
                   else fast.encode_ordinary(text))
            ids = np.array(ids + [end_id], dtype="<u4")
            head = (len(ids) - 1) % capacity + 1
            borders = [0, *range(head, len(ids) + 1, capacity)]
            return [(k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(borders, borders[1:]))]

        for batch in batches:
            rows = [(d, *p) for d, t in zip(batch["doc_id"].to_pylist(), batch["text"]) for p in cut(t.as_py())]
            yield pa.record_batch([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [()] * 5)],
                                  names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return documents(docs).mapInArrow(run, "doc_id bigint, piece bigint, start bigint, length bigint, ids_crc32 bigint")


def pack(pieces: DataFrame, capacity: int = CAPACITY, share: int = 200_000) -> DataFrame:
    """``pieces`` with sequence_id and offset.

    Every row is placed once, repeated rows and null doc_ids too; lengths lie from 1 to ``capacity``.
    Pieces of a length that many have are ranked in several groups of about ``share`` or a 500th of all.
    """
    spark = pieces.sparkSession
    # the number stays with its row, so ranks are the same whenever they are computed
    stored = materialise(pieces.withColumn("row", F.monotonically_increasing_id()))
    counts = {r["length"]: r["count"] for r in stored.groupBy("length").count().collect()}   # capacity rows at most
    if counts and not 0 < min(counts) <= max(counts) <= capacity:
        raise ValueError("a piece is empty or longer than the capacity")
    share = min(share, max(500, sum(counts.values()) // 500))
    groups = spark.createDataFrame([(k, -(-n // share)) for k, n in counts.items()], "length bigint, groups int")
    salted = stored.join(F.broadcast(groups), "length").withColumn("salt", F.pmod(F.xxhash64("row"), "groups"))
    table_of = np.array(sorted((r["length"], r["salt"], r["count"]) for r in salted.groupBy("length", "salt").count().collect()),
                        dtype=np.int64).reshape(-1, 3)      # capacity + 500 rows, or rows / share, at most
    before = np.cumsum(table_of[:, 2]) - table_of[:, 2]
    starts = {}
    for (length, salt, _), total in zip(table_of.tolist(), before.tolist()):
        starts[length, salt] = total - starts.setdefault((length, None), total)
    shared = spark.sparkContext.broadcast((slots(plan_lengths(counts, capacity)), starts))

    def place(batches):
        rows, starts = shared.value
        key = rows[:, 0] << 48 | rows[:, 1]
        for batch in batches:
            length = batch["length"].to_numpy()
            first = np.array([starts[x] for x in zip(length.tolist(), batch["salt"].to_pylist())], dtype=np.int64)
            rank = first + batch["n"].to_numpy() - 1
            slot = rows[np.searchsorted(key, length << 48 | rank, side="right") - 1]
            at = rank - slot[:, 1]
            out = {c: batch[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")}
            yield pa.record_batch(out | {"sequence_id": pa.array(slot[:, 3] + at // slot[:, 2]),
                                         "offset": pa.array(slot[:, 4] + at % slot[:, 2] * length)})

    from pyspark.sql.window import Window
    ranked = salted.withColumn("n", F.row_number().over(Window.partitionBy("length", "salt").orderBy("row")).cast("bigint"))
    return ranked.mapInArrow(place, "doc_id bigint, piece bigint, start bigint, length bigint, ids_crc32 bigint, "
                                    "sequence_id bigint, offset bigint")


@query("op5_best_fit_packing")
def op5(spark, base):
    return pack(pieces(table(spark, base, "documents"))).withColumn("piece", F.col("piece").cast("int"))
