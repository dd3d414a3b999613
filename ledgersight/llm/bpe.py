"""Byte-level BPE: a lazily determinised transducer encodes, a UTF-8 automaton decodes.

A token sequence is the BPE encoding of its bytes exactly when every two neighbours are the
encoding of their own bytes. Reading tokens off a trie with that neighbour test is therefore a
nondeterministic transducer with one accepting path per input. ``Transducer`` determinises it
while it reads: a state is the set of live hypotheses (tokens not yet emitted, last token, place
in the trie); tokens on which all hypotheses agree are emitted. A hypothesis dies once no token
continues its bytes, so the lookahead is below the longest token. States and transitions are kept
in a table of bounded size that is emptied when full, which changes speed and never results.
"""

import base64
import gc
import struct
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, query, table

MAX_STATES = 400_000    # states kept at once by one worker
MAX_WORDS = 1_000_000     # encoded words kept at once by one worker
KEPT_WORD = 64          # longer words are encoded again each time
MAX_PAIRS = 2_000_000   # tested neighbours kept at once by one worker
ROOT = 0


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Transducer:
    """Encodes byte strings; ``ranks`` maps the bytes of a token to its id, which is its merge rank."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES):
        self.ranks, self.max_states = ranks, max_states
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.child: dict[int, int] = {}
        self.token, self.inner = [-1], [True]       # of each place: its token, whether longer tokens pass it
        for text, rank in ranks.items():
            if self.merge(text) != [rank]:          # in no encoding
                continue
            node = ROOT
            for byte in text:
                key = node << 8 | byte
                node = self.child.get(key) or self._grow(key)
            self.token[node] = rank
        self.fits: dict[int, bool] = {}
        self.left: dict[int, list] = {}
        self.right: dict[int, list] = {}
        self._reset()

    def _grow(self, key: int) -> int:
        self.inner[key >> 8] = True
        self.token.append(-1)
        self.inner.append(False)
        self.child[key] = len(self.token) - 1
        return self.child[key]

    def _reset(self) -> None:
        start = ((), -1, ROOT)
        self.number, self.states, self.next = {(start,): 0}, [(start,)], [{}]

    def merge(self, text: bytes) -> list[int]:
        """The definition: join the neighbours whose union has the lowest rank until none has one."""
        parts = [text[i:i + 1] for i in range(len(text))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, 1 << 62), i)
                           for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 62:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _edge(self, token: int, end: int) -> list[tuple[bytes, int]]:
        """Parts that stand at one end of a token while it is merged, with the rank that ends each."""
        text, until, edge = self.bytes_of[token], 1 << 62, []
        while True:
            edge.append((text, until))
            if len(text) == 1:
                return edge
            until = self.ranks[text]
            parts = [text[i:i + 1] for i in range(len(text))]
            while len(parts) > 2:
                _, at = min((self.ranks.get(a + b, 1 << 62), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
                parts[at:at + 2] = [parts[at] + parts[at + 1]]
            text = parts[end]

    def _neighbours(self, a: int, b: int) -> bool:
        """Whether a, b is the encoding of its bytes: no merge across the border comes first.

        On equal ranks the merge further left is made first.
        """
        if a < 0:
            return True
        known = self.fits.get(a << 20 | b)
        if known is None:
            if len(self.fits) > MAX_PAIRS:
                self.fits.clear()
            left, right = self.left.get(a), self.right.get(b)
            if left is None:
                left = self.left[a] = self._edge(a, 1)
            if right is None:
                right = self.right[b] = self._edge(b, 0)
            rank = self.ranks.get
            known = True
            for x, x_until in left:
                for y, y_until in right:
                    joined = rank(x + y)
                    if joined is not None and joined < x_until and joined <= y_until:
                        known = False
                        break
                if not known:
                    break
            self.fits[a << 20 | b] = known
        return known

    def _step(self, state: int, byte: int) -> tuple[tuple[int, ...], int]:
        """(tokens emitted, next state) on reading ``byte``; found once per state and byte."""
        live, child, fits, tokens, inner = [], self.child.get, self.fits.get, self.token, self.inner
        for waiting, last, node in self.states[state]:
            below = child(node << 8 | byte)
            if below is None:
                continue
            if inner[below]:
                live.append((waiting, last, below))
            token = tokens[below]
            if token >= 0:
                known = fits(last << 20 | token)
                if known or known is None and self._neighbours(last, token):
                    live.append((waiting + (token,), token, ROOT))
        first, sure = live[0][0], 0
        while sure < len(first):
            for other, _, _ in live:
                if len(other) <= sure or other[sure] != first[sure]:
                    break
            else:
                sure += 1
                continue
            break
        key = tuple([(waiting[sure:], last, node) for waiting, last, node in live] if sure else live)
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.states)
            self.states.append(key)
            self.next.append({})
        self.next[state][byte] = found = first[:sure], to
        return found

    def encode(self, text: bytes) -> list[int]:
        if text in self.ranks:
            return [self.ranks[text]]
        if len(self.states) > self.max_states:
            self._reset()
        out, state, following = [], 0, self.next
        for byte in text:
            emitted, state = following[state].get(byte) or self._step(state, byte)
            if emitted:
                out += emitted
        for waiting, _, node in self.states[state]:
            if node == ROOT:
                out += waiting
        return out


class Words(dict):
    """Word to its ids as little-endian 32-bit numbers; words not met since half of the room filled are forgotten."""

    def __init__(self, transducer: Transducer):
        self.transducer, self.older = transducer, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            found = self.transducer.encode(word.encode())
            ids = struct.pack(f"<{len(found)}I", *found)
        if len(word) <= KEPT_WORD:
            if len(self) >= MAX_WORDS // 2:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids


# lead byte -> (bytes that follow, lowest and highest first follower), from the UTF-8 definition
def _lead(byte: int) -> tuple[int, int, int] | None:
    if 0xC2 <= byte <= 0xDF:
        return 1, 0x80, 0xBF
    if 0xE0 <= byte <= 0xEF:
        return 2, 0xA0 if byte == 0xE0 else 0x80, 0x9F if byte == 0xED else 0xBF
    if 0xF0 <= byte <= 0xF4:
        return 3, 0x90 if byte == 0xF0 else 0x80, 0x8F if byte == 0xF4 else 0xBF
    return None


class Utf8Machine:
    """Incremental decoding: the state is the character begun; bytes that begin none give U+FFFD.

    ``step`` takes a state and the bytes of one token to (text, state); steps from a token are kept
    in a table, so decoding costs one look-up per token.
    """

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of, self.known = bytes_of, {}
        # text of the tokens that are whole characters, None for others
        self.whole = [None] * (max(bytes_of, default=-1) + 1)
        for i, b in bytes_of.items():
            text, rest = self.step(b"", b)
            if not rest and "\ufffd" not in text:
                self.whole[i] = text

    @staticmethod
    def step(state: bytes, more: bytes) -> tuple[str, bytes]:
        out = []
        for byte in more:
            if state:
                need, low, high = _lead(state[0])
                if len(state) > 1:
                    low, high = 0x80, 0xBF
                if low <= byte <= high:
                    state += bytes((byte,))
                    if len(state) == need + 1:
                        out.append(state.decode())
                        state = b""
                    continue
                out.append("�")
                state = b""
            if byte < 0x80:
                out.append(chr(byte))
            elif _lead(byte):
                state = bytes((byte,))
            else:
                out.append("�")
        return "".join(out), state

    def stream(self, ids) -> Iterator[str]:
        """Text as it becomes certain, token by token; a character cut off at the end gives U+FFFD."""
        state, known = b"", self.known
        for i in ids:
            found = known.get((state, i))
            if found is None:
                found = known[state, i] = self.step(state, self.bytes_of.get(i, b""))
            text, state = found
            yield text
        if state:
            yield "�"


    def text(self, ids) -> str:
        """All of ``stream``; where every token is whole characters, the state never leaves the start."""
        try:
            parts = [self.whole[i] for i in ids]
        except IndexError:
            parts = [None]
        return "".join(self.stream(ids)) if None in parts else "".join(parts)


@lru_cache(maxsize=2)
def _words(path: str) -> Words:
    return Words(Transducer(read_ranks(path)))


@lru_cache(maxsize=2)
def _machine(path: str) -> Utf8Machine:
    return Utf8Machine({i: b for b, i in read_ranks(path).items()})


def encode(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, text -> doc_id, ids (binary, little-endian unsigned 32-bit numbers).

    Each match of the public pattern is encoded on its own, without special tokens. A null or empty
    text has no ids. Repeated rows and null doc_ids are encoded like others; other columns are left out.
    ``vocabulary`` is a file of ranks that every executor has at the same path.
    """
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(batches):
        words, pieces = _words(path), regex.compile(public_tokenizers.PATTERN).findall
        for batch in batches:
            ids = [b"".join(map(words.__getitem__, pieces(t.as_py()))) for t in batch["text"]]
            yield pa.record_batch({"doc_id": batch["doc_id"], "ids": pa.array(ids, pa.binary())})

    return documents(docs).mapInArrow(run, "doc_id bigint, ids binary")


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, ids -> doc_id, text. Ids outside the vocabulary and null ids decode to nothing;
    bytes that are no UTF-8 decode to U+FFFD."""
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(batches):
        machine = _machine(path)
        for batch in batches:
            texts = [machine.text(memoryview(i.as_py() or b"").cast("I")) for i in batch["ids"]]
            yield pa.record_batch({"doc_id": batch["doc_id"], "text": pa.array(texts, pa.string())})

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def digest(docs: DataFrame) -> DataFrame:
    """Per document the number of ids and the hashes of ids and of the text decoded from them.

    One Arrow stage encodes and decodes, so ids cross to no other worker.
    """
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(batches):
        words, machine, pieces = _words(path), _machine(path), regex.compile(public_tokenizers.PATTERN).findall
        gc.disable()        # the tables hold no cycles, and looking for some walks all of them
        try:
            for batch in batches:
                counts, hashes, decoded = [], [], []
                for text in batch["text"]:
                    ids = b"".join(map(words.__getitem__, pieces(text.as_py())))
                    whole = machine.text(memoryview(ids).cast("I")).encode()
                    counts.append(len(ids) // 4)
                    hashes.append(sha256(ids).hexdigest())
                    decoded.append(sha256(whole).hexdigest())
                yield pa.record_batch({"doc_id": batch["doc_id"], "n_tokens": pa.array(counts, pa.int64()),
                                       "ids_sha256": pa.array(hashes, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())})
        finally:
            gc.enable()

    return documents(docs).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


@query("op1_byte_bpe")
def op1(spark, base):
    return digest(table(spark, base, "documents"))
