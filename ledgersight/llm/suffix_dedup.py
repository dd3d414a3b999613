"""Removal of repeated byte strings by suffix sorting.

Two equal strings of ``LENGTH`` bytes must meet before they can be sorted together. Each has an anchor: of its
windows of ``GRAM`` bytes the one of lowest hash, the leftmost of equals. Equal strings have equal anchors at equal
places. Neighbouring starts share an anchor; together they form one stretch of text. Stretches of an anchor that
occurs once hold no repeat. Equal stretches are counted once, with their number. The different stretches of an
anchor are sorted by ``suffix_array``; a string is repeated where a neighbour in that order begins with the same bytes.
Before, each is cut to what it has in common with any other, counted from the anchor: equal strings lie alike around it.
Anchors of too many stretches are split by more bytes around them.

``suffix_array`` groups suffixes linearly: groups begin as first letters and are taken in descending order; the group
taken is final, each of its suffixes points to the nearest suffix before it in a smaller group, and those pointed at
go to a new group right above their old one, the more often the higher. Groups end as suffixes of equal Lyndon
prefix. A second pass walks the pointers from each placed suffix and emits every group's order; nothing is renamed
or sorted again.
"""

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bag_minhash import mix
from .common import documents, materialise, query, table

LENGTH = 200
GRAM = 32
FULL = 256          # different stretches of an anchor that are sorted together; fuller ones are split
PIECE = 1 << 16     # starts of one text, and about the bytes of several, that are hashed together
PLACE_BITS = 18     # for the places in two pieces
STEPS = (84, 16)    # starts that stay together when a crowded anchor is split, and when what is still crowded is split again

_U = np.uint64
_FACTORS = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def suffix_array(text) -> list[int]:
    """Starts of the suffixes of a sequence of positive numbers, in order (the empty suffix left out)."""
    s = [*text, 0]
    n = len(s)
    order = sorted(range(n), key=s.__getitem__)
    place, group, size = [0] * n, [0] * n, [0] * n
    first = 0
    for k, i in enumerate(order):
        if s[i] != s[order[first]]:
            first = k
        place[i], group[i] = k, first
        size[first] += 1
    before, pointed = [-1] * n, [0] * n
    last = n - 1
    while last > 0:
        g = group[order[last]]
        targets, most = [], 1
        for i in sorted(order[g:last + 1]) if g < last else (order[last],):
            p = i - 1
            while p >= 0 and group[p] >= g:
                p = before[p]
            before[i] = p
            if p >= 0:
                if pointed[p]:
                    pointed[p] += 1
                    if pointed[p] > most:
                        most = pointed[p]
                else:
                    pointed[p] = 1
                    targets.append(p)
        while targets:
            moved, rest = {}, []
            for p in targets:
                if pointed[p] < most:
                    rest.append(p)
                    continue
                pointed[p] = 0
                old = group[p]
                size[old] -= 1
                end = old + size[old]
                other, at = order[end], place[p]
                order[at], place[other] = other, at
                order[end], place[p] = p, end
                moved.setdefault(old, []).append(p)
            for old, them in moved.items():
                new = old + size[old]
                size[new] = len(them)
                for p in them:
                    group[p] = new
            targets = rest
            most = max((pointed[p] for p in targets), default=0)
        last = g - 1
    out, next_, placed = [-1] * n, list(range(n)), [False] * n
    out[0] = n - 1
    placed[n - 1] = True
    for k in range(n):
        i = out[k] - 1
        while i >= 0 and not placed[i]:
            g = group[i]
            out[next_[g]] = i
            next_[g] += 1
            placed[i] = True
            i = before[i]
    return out[1:]


def _words(data: bytes) -> np.ndarray:
    """The eight bytes at every place as one number."""
    return np.ndarray((len(data) - 7,), "<u8", data, 0, (1,)).astype(_U)


def _digests(words: np.ndarray, first: np.ndarray, end: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A hash of the bytes from ``first`` to ``end`` and of ``place``: each eight bytes are mixed with their number and added."""
    size = end - first
    many = (size + 7) // 8
    begin = np.cumsum(many) - many
    number = np.arange(begin[-1] + many[-1]) - np.repeat(begin, many)
    at = np.minimum(np.repeat(first, many) + 8 * number, np.repeat(end - 8, many))      # the last eight may overlap those before
    parts = np.add.reduceat(mix(words[at] + (number.astype(_U) + _U(1)) * _FACTORS[0]), begin)
    return mix(parts ^ mix((size << 16 | place).astype(_U)))


def stretches(pieces: list[bytes]) -> tuple[np.ndarray, ...]:
    """(piece, anchor hash, hash of the stretch and its anchor's place, first start, last start, anchor place) of all strings of ``LENGTH`` bytes.

    All pieces, ``2 ** PLACE_BITS`` bytes at most, go through the same few array operations. A string lies in one piece. Windows are
    compared by their hash with the place in its lowest bits, so the smallest one is also the leftmost of equals.
    """
    texts = [(k, x) for k, x in enumerate(pieces) if len(x) >= LENGTH]
    if not texts:
        none = np.zeros(0, dtype=np.int64)
        return none, none.astype(_U), none.astype(_U), none, none, none
    data, size = b"".join(x for _, x in texts), np.array([len(x) for _, x in texts])
    base = np.cumsum(size) - size
    words = _words(data)
    n = len(data) - GRAM + 1
    h = words[:n] * _FACTORS[0]
    for k in range(1, GRAM // 8):
        h += words[8 * k:8 * k + n] * _FACTORS[k]
    h = mix(h)
    low = h >> _U(PLACE_BITS) << _U(PLACE_BITS)
    low |= np.arange(n, dtype=_U)
    window, width = LENGTH - GRAM + 1, 1
    while 2 * width <= window:
        low = np.minimum(low[width:], low[:-width])
        width *= 2
    if window > width:
        low = np.minimum(low[window - width:], low[:width - window])
    new = np.ones(len(low), dtype=bool)
    np.not_equal(low[1:], low[:-1], out=new[1:])
    new[base] = True
    first = np.flatnonzero(new)
    owner = np.searchsorted(base, first, side="right") - 1
    last = np.minimum(np.append(first[1:], len(low)) - 1, (base + size - LENGTH)[owner])
    inside = first <= last                      # other starts run into the next piece
    first, last, owner = first[inside], last[inside], owner[inside]
    at = (low[first] & _U((1 << PLACE_BITS) - 1)).astype(np.int64)
    w, base = _digests(words, first, last + LENGTH, at - first), base[owner]
    return np.array([k for k, _ in texts])[owner], h[at], w, first - base, last - base, at - base


def anchors(rows: DataFrame) -> DataFrame:
    """d, h, key, w (hash of the stretch and the anchor's place in it), s, e (first and last start), p (the anchor's place in it)."""
    def run(batches):
        def found(pieces):
            k, key, w, s, e, at = stretches([x for _, _, x in pieces])
            row, off = np.array([x[0] for x in pieces])[k], np.array([x[1] for x in pieces])[k]
            return row, key.view(np.int64), w.view(np.int64), (s + off).astype(np.int32), (e + off).astype(np.int32), (at - s).astype(np.int32)

        for batch in batches:
            out, pieces, held = [], [], 0
            for k, text in enumerate(batch["text"]):
                data = text.as_py().encode()
                for off in range(0, len(data) - LENGTH + 1, PIECE):
                    pieces.append((k, off, data[off:off + PIECE + LENGTH - 1]))
                    held += len(pieces[-1][2])
                    if held >= PIECE:
                        out.append(found(pieces))
                        pieces, held = [], 0
            if pieces:
                out.append(found(pieces))
            if out:
                row, key, w, s, e, p = (pa.array(np.concatenate(c)) for c in zip(*out))
                yield pa.record_batch({"d": batch["d"].take(row), "h": batch["h"].take(row), "key": key, "w": w, "s": s, "e": e, "p": p})

    return rows.select("d", "h", "text").mapInArrow(run, "d bigint, h bigint, key bigint, w bigint, s int, e int, p int")


def _common(a: bytes, b: bytes) -> int:
    """How many first bytes are the same."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


def _shared(sides: list[bytes]) -> list[int]:
    """The most first bytes each has in common with another."""
    order = sorted(range(len(sides)), key=sides.__getitem__)
    most = [0] * len(sides)
    for i, j in zip(order, order[1:]):
        n = _common(sides[i], sides[j])
        most[i], most[j] = max(most[i], n), max(most[j], n)
    return most


def candidates(texts: list[bytes], starts: list[int], places: list[int]) -> list[tuple[int, int]]:
    """first start and number of starts of each stretch whose strings may occur in another one of the same anchor.

    Equal strings have their anchor at equal places, so a string that reaches farther from it than all
    other stretches agree, to the left or to the right, occurs in none of them.
    """
    left = _shared([t[:p][::-1] for t, p in zip(texts, places)])
    right = _shared([t[p:] for t, p in zip(texts, places)])
    first = [max(0, p - a) for p, a in zip(places, left)]
    return [(f, min(n, p + b - LENGTH + 1) - f) for f, n, p, b in zip(first, starts, places, right)]


def repeated(texts: list[bytes], starts: list[int]) -> list[np.ndarray]:
    """For each stretch (with its number of starts) which starts have their string elsewhere among them."""
    joined, base = bytearray(), []
    for t in texts:
        base.append(len(joined))
        joined += t
        joined.append(0)
    # the byte after a stretch sorts below all others: text bytes are raised by two
    ends = {b + len(t) for b, t in zip(base, texts)}
    order = suffix_array([1 if i in ends else b + 2 for i, b in enumerate(joined)])
    owner = np.zeros(len(joined), dtype=bool)
    for b, n in zip(base, starts):
        owner[b:b + n] = True
    order = np.array(order)
    a, b = order[:-1], order[1:]
    both = np.flatnonzero(owner[a] & owner[b])
    flagged = np.zeros(len(joined), dtype=bool)
    data = bytes(joined)
    for x, y in zip(a[both].tolist(), b[both].tolist()):
        if data[x:x + LENGTH] == data[y:y + LENGTH]:
            flagged[x] = flagged[y] = True
    return [flagged[b:b + n] for b, n in zip(base, starts)]


def _runs(flags: np.ndarray) -> list[int]:
    """first, last, first, last, ... of the runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    edge[1::2] -= 1
    return edge.tolist()


def sorted_runs(windows: DataFrame) -> DataFrame:
    """key, w, runs of repeated starts, for groups g of several stretches (g, key, w, off, text binary, n starts, p).

    ``off`` is where text begins in the whole stretch, ``p`` the anchor's place in text.
    """
    dealt = windows.repartition("g").sortWithinPartitions("g", "key", "w")

    def run(batches):
        def close():
            parts = [(row, f, n) for row, (f, n) in zip(rows, candidates(*zip(*((r[3], r[4], r[5]) for r in rows)))) if n > 0] if len(rows) > 1 else []
            if len(parts) > 1:
                for (row, f, _), flags in zip(parts, repeated([r[3][f:f + n + LENGTH - 1] for r, f, n in parts], [n for _, _, n in parts])):
                    if flags.any():
                        yield row[0], row[1], [row[2] + f + i for i in _runs(flags)]

        group, rows = None, []
        for batch in batches:
            out = []
            for g, *row in zip(*(batch[c].to_pylist() for c in ("g", "key", "w", "off", "text", "n", "p"))):
                if g != group:
                    out += close()
                    group, rows = g, []
                rows.append(row)
            yield _batch(out)
        yield _batch(list(close()))

    def _batch(out):
        return pa.record_batch({"key": pa.array([x[0] for x in out], pa.int64()), "w": pa.array([x[1] for x in out], pa.int64()),
                                "runs": pa.array([x[2] for x in out], pa.list_(pa.int32()))})

    return dealt.mapInArrow(run, "key bigint, w bigint, runs array<int>")


def split_groups(windows: DataFrame, step: int) -> DataFrame:
    """Stretches (g, key, w, off, text, n, p) of crowded groups in parts of ``step`` starts, grouped by what these have in common.

    Starts are parted by their distance from the anchor. All strings of a part hold one longer gram around it, and equal
    strings lie alike around the anchor, so they are in parts of the same distance and gram. ``v`` is the hash of a part's text.
    """
    far = LENGTH - GRAM

    def run(batches):
        def digest(*parts):
            return int.from_bytes(hashlib.blake2b(b"".join(parts), digest_size=8).digest(), "little", signed=True)

        for batch in batches:
            out = []
            for g, key, w, off, t, n, p in zip(*(batch[c].to_pylist() for c in names)):
                for near in range(max(0, p - n + 1) // step * step, p + 1, step):      # distance of the part's last start
                    last = min(near + step - 1, far)
                    a, b = max(0, p - last), min(n, p - near + 1)
                    if a < b:
                        text = t[a:b + LENGTH - 1]
                        out.append((digest(g.to_bytes(8, "little", signed=True), bytes((near,)), t[p - near:p + LENGTH - last]), digest(bytes((p - a,)), text),
                                    key, w, off + a, text, b - a, p - a))
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 8, kinds)], names=["g", "v", *names[1:]])

    names = ["g", "key", "w", "off", "text", "n", "p"]
    kinds = [pa.int64()] * 4 + [pa.int32(), pa.binary(), pa.int32(), pa.int32()]
    return windows.select(*names).mapInArrow(run, "g bigint, v bigint, key bigint, w bigint, off int, text binary, n int, p int")


def parted(windows: DataFrame, step: int) -> tuple[DataFrame, DataFrame]:
    """(one of each different part with the kinds its group has, runs of the parts that occur several times)."""
    parts = materialise(split_groups(windows, step))
    different = materialise(parts.groupBy("g", "v").agg(
        F.count(F.lit(1)).alias("c"), F.min(F.struct("key", "w", "off", "text", "n", "p")).alias("one")))
    whole = parts.join(different.where("c > 1").select("g", "v"), ["g", "v"]).select("key", "w", F.array("off", F.expr("off + n - 1")).alias("runs"))
    several = different.groupBy("g").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    return different.join(several, "g").select("g", "kinds", "one.*"), whole


def single_strings(windows: DataFrame) -> DataFrame:
    """key, w, runs of length one, for stretches of groups too full to be sorted in one task.

    Every string of such a stretch is a row of its 128-bit hash; those of several stretches are repeated.
    """
    def run(batches):
        for batch in batches:
            rows = [(g, k, w, off + i, t[i:i + LENGTH]) for g, k, w, off, t, n in zip(*(batch[c].to_pylist() for c in ("g", "key", "w", "off", "text", "n")))
                    for i in range(n)]
            yield pa.record_batch({"g": pa.array([r[0] for r in rows], pa.int64()), "key": pa.array([r[1] for r in rows], pa.int64()),
                                   "w": pa.array([r[2] for r in rows], pa.int64()), "i": pa.array([r[3] for r in rows], pa.int32()),
                                   "x": pa.array([hashlib.blake2b(r[4], digest_size=16).digest() for r in rows], pa.binary())})

    each = materialise(windows.mapInArrow(run, "g bigint, key bigint, w bigint, i int, x binary"))
    often = each.groupBy("g", "x").agg(F.min("w").alias("low"), F.max("w").alias("high")).where("low <> high").select("g", "x")
    return each.join(often, ["g", "x"]).groupBy("key", "w").agg(
        F.flatten(F.array_sort(F.collect_list(F.array("i", "i")))).alias("runs"))


def repeated_spans(rows: DataFrame) -> DataFrame:
    """d, h, spans (byte start, end exclusive; they may overlap) of the rows (d, h, text)."""
    found = materialise(anchors(rows))
    windows = found.groupBy("key", "w").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("d", "h", "s", "e", "p")).alias("one"))
    windows = materialise(windows)
    totals = windows.groupBy("key").agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("kinds")).where("total > 1")
    shared = materialise(windows.join(totals, "key").select("key", "w", "c", "kinds", "one.*"))
    several = shared.where("kinds > 1")
    body = F.encode("text", "utf-8")
    asked = rows.select("d", "h", "text").dropDuplicates(["d", "h"]).join(several, ["d", "h"]).select(
        "key", "w", "kinds", "p", F.substring(body, F.col("s") + 1, F.col("e") - F.col("s") + LENGTH).alias("text"), (F.col("e") - F.col("s") + 1).alias("n"))
    asked = materialise(asked)
    asked = asked.withColumns({"g": F.col("key"), "off": F.lit(0)})
    sorted_, crowded, runs = asked.where(f"kinds <= {FULL}"), asked.where(f"kinds > {FULL}"), []
    for step in STEPS:
        split, again = parted(crowded, step)
        runs.append(again)
        sorted_ = sorted_.unionByName(split.where(f"kinds <= {FULL}"), allowMissingColumns=True)
        crowded = split.where(f"kinds > {FULL}")
    runs = reduce(DataFrame.unionByName, [*runs, single_strings(crowded)], sorted_runs(sorted_))
    # a stretch that occurs again is repeated as a whole
    whole = shared.where("c > 1").select("key", "w", F.array(F.lit(0), F.col("e") - F.col("s")).alias("runs"))
    known = materialise(whole.unionByName(runs.join(shared.where("c = 1").select("key", "w"), ["key", "w"])))
    def at(i):
        return F.get("runs", i.cast("int"))

    number = F.sequence(F.lit(0), (F.size("runs") / 2).cast("int") - 1)
    places = found.join(known, ["key", "w"]).select("d", "h", F.transform(number, lambda i: F.struct(
        (F.col("s") + at(2 * i)).alias("a"), (F.col("s") + at(2 * i + 1) + LENGTH).alias("b"))).alias("part"))
    # copies of a row have equal parts; different parts of a row share no span but by runs of different steps, which does no harm
    return places.groupBy("d", "h").agg(F.sort_array(F.flatten(F.collect_set("part"))).alias("spans"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes that stay) of every row.

    A byte goes when a string of ``LENGTH`` bytes over it also starts elsewhere, in any row or in its own; strings do
    not cross rows and are judged on the input. Null and empty texts have no bytes. Repeated rows are elsewhere for each
    other, so all their strings repeat. What stays may cut a character.
    """
    rows = documents(docs).withColumns({"d": F.coalesce("doc_id", F.lit(-(1 << 63)).cast("bigint")), "h": F.xxhash64("text")})
    joined = rows.join(materialise(repeated_spans(rows)), ["d", "h"], "left").select("doc_id", "text", "spans")

    def run(batches):
        for batch in batches:
            n_bytes, removed, n_spans, kept = [], [], [], []
            for text, spans in zip(batch["text"], batch["spans"]):
                data, out, at, gone, runs = text.as_py().encode(), [], 0, 0, 0
                for span in spans.as_py() or ():
                    a, b = span["a"], span["b"]
                    if a > at or not runs:
                        out.append(data[at:a])
                        runs += 1
                        at = a
                    if b > at:
                        gone += b - at
                        at = b
                out.append(data[at:])
                n_bytes.append(len(data)), removed.append(gone), n_spans.append(runs), kept.append(b"".join(out))
            yield pa.record_batch({"doc_id": batch["doc_id"], "n_bytes": pa.array(n_bytes, pa.int64()), "n_removed": pa.array(removed, pa.int64()),
                                   "n_spans": pa.array(n_spans, pa.int64()), "kept": pa.array(kept, pa.binary())})

    return joined.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


@query("op7_suffix_dedup")
def op7(spark, base):
    return remove_repeats(table(spark, base, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
