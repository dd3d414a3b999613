"""Bounded-space online packing.

Each partition keeps at most ``WINDOWS`` open windows. A document goes whole into the open window with the least
room that takes it; if none does, a new window is opened while there are fewer than the bound; else the document's head fills the
fullest window, which is emitted, and the rest goes on. So every emitted window is full. What is open at a
partition's end is merged: groups of ``FAN`` partitions give their windows to one task, which packs them by the
same rule and leaves at most ``WINDOWS`` again, until one group is left. Its windows are joined and cut; the last
tokens of all, fewer than a window, are cut at powers of two, which need no padding.

Ids of a text are those of its chunks between spaces and line ends, which the tokenizer drops and never joins
across; a worker keeps the ids of the chunks and words it has met, up to ``CACHE`` of each.
"""

import re
import zlib
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, materialise, query, table

CAPACITY = 2048
WINDOWS = 8             # open windows of a partition
FAN = 32                # partitions whose open windows meet in one task
CACHE = 1_000_000         # chunks and words a worker remembers
CHUNK = 48              # longest of them, in characters
OUT = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
OPEN = f"{OUT}, part bigint, ids binary"


class ChunkIds(dict):
    """Ids of chunks as little-endian 32-bit numbers; a missing chunk is encoded when it is asked for.

    A chunk of plain signs and Latin letters is lower-cased and split here as the tokenizer does it, and its words,
    which recur more often than chunks, go to the tokenizer's model. Any other chunk goes to the tokenizer whole.
    """

    PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]*")
    WORDS = re.compile("'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer, self.words = Tokenizer.from_file(path), {}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # the model reads bytes as signs: a byte that is no visible sign by itself is one of the signs from 256 on
        hidden = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
        self.signs = {b: 256 + k for k, b in enumerate(hidden)}

    def _word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            tokens = self.tokenizer.model.tokenize(word.encode().decode("latin-1").translate(self.signs))
            found = b"".join([t.id.to_bytes(4, "little") for t in tokens])
            if len(self.words) >= CACHE:
                self.words.clear()
            if len(word) <= CHUNK:
                self.words[word] = found
        return found

    def __missing__(self, chunk: str) -> bytes:
        if self.PLAIN.fullmatch(chunk) and not any(s in chunk for s in self.special):
            ids = b"".join(map(self._word, self.WORDS.findall(chunk.lower())))
        else:
            found = self.tokenizer.encode(chunk, add_special_tokens=False).ids
            ids = b"".join([i.to_bytes(4, "little") for i in found])
        if len(self) >= CACHE:
            self.clear()
        if len(chunk) <= CHUNK:
            self[chunk] = ids
        return ids

    def text(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


@lru_cache(maxsize=2)
def chunk_ids(path: str) -> ChunkIds:
    """One per worker."""
    return ChunkIds(path)


class Windows:
    """Open windows of one stream; a part is [doc_id, start, doc_tokens, ids]."""

    def __init__(self, capacity: int, bound: int):
        self.capacity, self.bound, self.open = capacity, bound, []     # [room, parts], in order of age

    @staticmethod
    def _cut(parts: list, n: int) -> tuple[list, list]:
        """The first n tokens of the parts, and the rest."""
        head = []
        for at, (doc, start, total, ids) in enumerate(parts):
            have = len(ids) // 4
            if have > n:
                if n:
                    head.append((doc, start, total, ids[:4 * n]))
                return head, [(doc, start + n, total, ids[4 * n:]), *parts[at + 1:]]
            head.append(parts[at])
            n -= have
            if not n:
                return head, parts[at + 1:]
        return head, []

    def put(self, parts: list):
        """Place parts that belong together; gives the windows that became full."""
        length = sum(len(p[3]) for p in parts) // 4
        while length:
            if length >= self.capacity:
                head, parts = self._cut(parts, self.capacity)
                length -= self.capacity
                yield head
                continue
            best = None
            for window in self.open:
                if window[0] >= length and (best is None or window[0] < best[0]):
                    best = window
            if best is None and len(self.open) < self.bound:
                best = [self.capacity, []]
                self.open.append(best)
            if best is None:
                best = min(self.open, key=lambda w: w[0])
                head, parts = self._cut(parts, best[0])
                length -= best[0]
                best[0] = 0
                best[1] += head
            else:
                best[0] -= length
                best[1] += parts
                length = 0
            if not best[0]:
                self.open.remove(best)
                yield best[1]

    def close(self):
        """What is open, joined, in full windows and then in powers of two."""
        parts = [p for _, parts in sorted(self.open, key=lambda w: w[0]) for p in parts]
        length = sum(len(p[3]) for p in parts) // 4
        self.open = []
        while length:
            size = min(self.capacity, length) if length >= self.capacity else 1 << (length.bit_length() - 1)
            head, parts = self._cut(parts, size)
            length -= size
            yield head


class Rows:
    """Output rows, collected until they are emitted as a batch."""

    def __init__(self, level: int):
        self.level, self.part, self.count, self.rows = level, 0, 0, []

    def add(self, parts: list, is_open: bool = False) -> None:
        offset, sequence = 0, (self.level << 56) + (self.part << 24) + self.count
        for doc, start, total, ids in parts:
            n = len(ids) // 4
            self.rows.append((doc, start, n, zlib.crc32(ids), total, sequence, offset, self.part, bytes(ids) if is_open else None))
            offset += n
        self.count += 1

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) if self.rows else [()] * 9
        self.rows = []
        return pa.record_batch([pa.array(c, pa.int64()) for c in columns[:8]] + [pa.array(columns[8], pa.binary())],
                               names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "part", "ids"])


def _stream(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, windows: int) -> DataFrame:
    end = end_id.to_bytes(4, "little")

    def run(batches):
        ids_of, open_, rows = chunk_ids(tokenizer), Windows(capacity, windows), Rows(0)
        rows.part = TaskContext.get().partitionId()
        for batch in batches:
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                ids = memoryview(ids_of.text(text.as_py()) + end)
                for full in open_.put([(doc, 0, len(ids) // 4, ids)]):
                    rows.add(full)
            yield rows.batch()
        for _, parts in open_.open:
            rows.add(parts, is_open=True)
        yield rows.batch()

    return documents(docs).mapInArrow(run, OPEN)


def _merge(left: DataFrame, level: int, fan: int, capacity: int, windows: int, last: bool) -> DataFrame:
    """One round: the open windows of ``fan`` parts become full ones and at most ``windows`` open ones."""
    def run(batches):
        open_, rows, window, parts = Windows(capacity, windows), Rows(level), None, []

        def flush():
            if parts:
                for full in open_.put(list(parts)):
                    rows.add(full)
            parts.clear()

        def end():
            flush()
            for rest in open_.close() if last else [p for _, p in open_.open]:
                rows.add(rest, is_open=not last)
            open_.open = []

        first = True
        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("into", "sequence_id", "doc_id", "start", "doc_tokens", "ids")]
            for into, sequence, *part in zip(*columns):
                if first or into != rows.part:
                    end()
                    first, window, rows.part, rows.count = False, None, into, 0
                if sequence != window:
                    flush()
                    window = sequence
                parts.append(part)
            yield rows.batch()
        end()
        yield rows.batch()

    dealt = left.withColumn("into", F.expr(f"part div {fan}")).repartition("into").sortWithinPartitions("into", "sequence_id", "offset")
    return dealt.mapInArrow(run, OPEN)


def pack_online(docs: DataFrame, capacity: int = CAPACITY, windows: int = WINDOWS, end_id: int = 1, tokenizer: str | None = None,
                fan: int = FAN) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece.

    Null and empty texts are the end id alone. Rows of one doc_id, equal ones too, and rows of a null doc_id are documents of
    their own; their pieces carry the doc_id. Special tokens' strings in a text are special tokens, as the tokenizer has it. All
    sequences hold ``capacity`` tokens but the last ones, which hold powers of two. An empty table gives no rows.
    """
    if not 2 <= fan or not 1 <= windows:
        raise ValueError("a round must merge parts, and a stream needs a window")
    tokenizer = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    stored = materialise(_stream(docs, tokenizer, end_id, capacity, windows))
    done, level = [stored.where("ids is null")], 0
    left = stored.where("ids is not null")
    parts = left.agg(F.max("part")).first()[0]
    while parts is not None:
        level, last = level + 1, parts < fan
        stored = materialise(_merge(left, level, fan, capacity, windows, last))
        done.append(stored.where("ids is null"))
        left, parts = stored.where("ids is not null"), None if last else parts // fan
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("part", "ids")


@query("op12_online_packing")
def op12(spark, base):
    return pack_online(table(spark, base, "documents"))
