"""Spelling variants by neighbourhoods over a reduced alphabet.

Every letter is hashed to one of a few symbols. Words that differ by one edit have reduced words that are equal or differ
by one edit, so each word generates the full one-edit neighbourhood of its reduced word (itself, deletions,
replacements, insertions) as 64-bit polynomial hashes and joins the hashes of the reduced vocabulary; the original strings are then compared. A
hash two reduced words share by chance only adds a candidate. Before the join, neighbours that no reduced word
has are dropped by a bit map of the vocabulary's hashes, whose size has a bound (``BITS``); it passes others by chance.
"""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, materialise, query, table

RUN = "[a-zÀ-ÿ]"          # after lower-casing A-Z
SYMBOLS = 16
MODULUS = 97                        # one occurrence in so many loses a letter
SHORTEST, FEWEST = 5, 3
BITS = (15, 30)                     # bit map: least and most bits, as powers of two; 128 MB at most
HELD = 200_000                      # words a task counts before it emits them
BASE, MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
BLOCK = 1_000_000                   # neighbours made at a time


def count_words(docs: DataFrame, modulus: int = MODULUS, shortest: int = SHORTEST) -> DataFrame:
    """word, n: the runs of all texts with their altered forms, of at least ``shortest`` letters."""
    pattern = f"{RUN}{{{shortest},}}"

    def run(batches):
        runs, held = re.compile(pattern), defaultdict(int)

        def emit():
            batch = pa.record_batch([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return batch

        for batch in batches:
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                start = zlib.crc32(b"%s:" % (b"" if doc is None else str(doc).encode()))
                # bytes.lower changes A-Z alone
                for word, n in Counter(runs.findall(text.as_py().encode().lower().decode())).items():
                    h = zlib.crc32(word.encode(), start)
                    if h % modulus == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                        if len(word) < shortest:
                            continue
                    held[word] += n
                if len(held) > HELD:
                    yield emit()
        yield emit()

    parts = documents(docs).mapInArrow(run, "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def symbols_of(words: list[str], symbols: int) -> np.ndarray:
    """Rows of symbols from 1 on, for words of one length."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").reshape(len(words), -1).astype(np.uint64)
    return (points * np.uint64(2654435761) >> np.uint64(11)) % np.uint64(symbols) + np.uint64(1)


class Reduced:
    """Hashes of reduced words of one length and of what one edit makes of them; arithmetic is modulo 2**64."""

    def __init__(self, words: list[str], symbols: int):
        self.digits, self.symbols = symbols_of(words, symbols), symbols
        rows, n = self.digits.shape
        self.power = np.full(n + 2, BASE, dtype=np.uint64)
        self.power[0] = 1
        self.power = np.multiply.accumulate(self.power)
        self.prefix = np.zeros((rows, n + 1), dtype=np.uint64)
        for i in range(n):
            self.prefix[:, i + 1] = self.prefix[:, i] * np.uint64(BASE) + self.digits[:, i]
        self.key = self.prefix[:, n]
        self.suffix = self.key[:, None] - self.prefix * self.power[n::-1][:n + 1]

    def neighbours(self, rows: slice):
        """Blocks of hashes, one row for each word; a hash may come twice."""
        d, p, s, key = self.digits[rows], self.prefix[rows], self.suffix[rows], self.key[rows]
        m, n = d.shape
        yield key[:, None]
        step = max(1, BLOCK // (m * self.symbols))
        each = np.arange(1, self.symbols + 1, dtype=np.uint64)
        for a in range(0, n + 1, step):
            b, last = min(a + step, n), min(a + step, n + 1)
            if b > a:
                place = self.power[n - 1 - np.arange(a, b)]
                yield p[:, a:b] * place + s[:, a + 1:b + 1]
                yield (key[:, None, None] + (each[None, None, :] - d[:, a:b, None]) * place[None, :, None]).reshape(m, -1)
            place = self.power[n - np.arange(a, last)]
            yield ((p[:, a:last] * np.uint64(BASE) * place + s[:, a:last])[:, :, None] + each * place[None, :, None]).reshape(m, -1)


def slots(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys * np.uint64(MIX)) >> np.uint64(64 - bits)


def _by_length(words: list[str]):
    order = defaultdict(list)
    for at, word in enumerate(words):
        order[len(word)].append(at)
    return {n: at for n, at in order.items() if n}


def _reduced(vocabulary: DataFrame, symbols: int, bits: int) -> DataFrame:
    """key, slot, other, other_n: the reduced vocabulary."""
    def run(batches):
        for batch in batches:
            words = batch["word"].to_pylist()
            for at in _by_length(words).values():
                key = Reduced([words[i] for i in at], symbols).key
                part = batch.take(pa.array(at))
                yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(slots(key, bits).astype(np.int64)), part["word"], part["n"]],
                                      names=["key", "slot", "other", "other_n"])

    return vocabulary.select("word", "n").mapInArrow(run, "key bigint, slot bigint, other string, other_n bigint")


def _bit_map(reduced: DataFrame, bits: int) -> np.ndarray:
    """The slots in use: 2**bits bits, whatever the vocabulary's size."""
    slot = F.col("slot") + 1
    rows = reduced.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    out = np.zeros((1 << bits - 15, 4096), dtype=np.uint8)
    for r in rows.toLocalIterator():
        out[r["bucket"] - 1] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out.ravel()


def _neighbours(vocabulary: DataFrame, used, symbols: int, bits: int) -> DataFrame:
    """key, word: neighbours of each reduced word that the bit map passes."""
    def run(batches):
        for batch in batches:
            words = batch["word"].to_pylist()
            for n, places in _by_length(words).items():
                group = [words[i] for i in places]
                share = max(1, BLOCK // (2 * (n + 1) * symbols))
                for first in range(0, len(group), share):
                    part = group[first:first + share]
                    made, rows, keys = Reduced(part, symbols), [], []
                    for block in made.neighbours(slice(None)):
                        slot = slots(block, bits)
                        i, j = np.nonzero(used.value[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8) & 1)
                        rows.append(i)
                        keys.append(block[i, j])
                    found = np.unique(np.stack([np.concatenate(rows).astype(np.uint64), np.concatenate(keys)], axis=1), axis=0)
                    yield pa.record_batch([pa.array(np.ascontiguousarray(found[:, 1]).view(np.int64)),
                                           pa.array(part, pa.string()).take(pa.array(found[:, 0].astype(np.int64)))], names=["key", "word"])

    return vocabulary.select("word").mapInArrow(run, "key bigint, word string")


def near_words(vocabulary: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """word, other, other_n: all pairs of words one inserted, deleted or replaced code point apart, from both sides.

    ``vocabulary`` has distinct words with their n.
    """
    bits = min(BITS[1], max(BITS[0], (64 * vocabulary.count()).bit_length()))
    reduced = materialise(_reduced(vocabulary, symbols, bits))
    used = vocabulary.sparkSession.sparkContext.broadcast(_bit_map(reduced, bits))
    tasks = int(vocabulary.sparkSession.conf.get("spark.sql.shuffle.partitions"))      # small rows, much work on each
    made = _neighbours(vocabulary.repartition(tasks, "word"), used, symbols, bits)
    pairs = made.join(reduced.drop("slot"), "key")
    return pairs.where(F.levenshtein("word", "other", 1) == 1).select("word", "other", "other_n")


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the last form of each word in ``forms`` (word, form), by doubling.

    A form has at least twice the word's n, so chains end and the rounds grow with the logarithm of their length.
    """
    up, moved = materialise(forms.select("word", F.col("form").alias("root"))), True
    while moved:
        further = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = materialise(up.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                                  F.col("next").isNotNull().alias("moved")))
        up, moved = new.drop("moved"), not new.where("moved").isEmpty()
    return up


def variants(counted: DataFrame, fewest: int = FEWEST, ratio: int = 2, symbols: int = SYMBOLS) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word counted at least ``fewest`` times.

    ``counted`` has word and n; counts of a repeated word add up, null and empty words are left out. An empty table gives no rows.
    """
    vocabulary = materialise(counted.where("word <> ''").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= fewest))
    near = near_words(vocabulary, symbols)
    first = F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("form")))
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), first.alias("best"))
    known = materialise(vocabulary.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(-F.col("best.n") >= ratio * F.col("n"), F.col("best")).alias("best"))
        .select("word", "n", "n_near", F.col("best.form").alias("form"), (-F.col("best.n")).alias("form_n")))
    last = roots(known.where("form is not null"))
    return known.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


@query("op11_spelling_variants")
def op11(spark, base):
    return variants(count_words(table(spark, base, "documents")))
