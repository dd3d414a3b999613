"""Language-model scores by a gated recurrent network with class-factored output.

Every training token is counted. The ``TOP`` most frequent tokens are symbols of their own, in classes of
``PER_CLASS``; every other word belongs to a class by its ending. The probability of a token is that of its class given
the state, times its share of the class: a softmax over the class's tokens given the state for frequent tokens, and
(count + 1) / (class tokens + class words + 1) for the others, so rare and unseen words are scored by all counts
of the corpus. The network reads symbols; its state runs from the first token of a text to its end in
windows, so a whole text is scored.

Training is truncated backpropagation in numpy over every token of every training document: documents run through
lanes one after the other, and the state is carried between the windows of a document. Each document is dealt to one
round; tasks train copies of the network on their documents, and Spark averages the copies after each round.
Words outside the ``HEAD`` most frequent are looked up by a join, so nothing that grows with the corpus is broadcast.
"""

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, materialise, query, remainder, table

TOP, PER_CLASS = 512, 32
ENDINGS = 48                # classes of words by ending
HIDDEN = 24
HEAD = 150_000              # words whose counts every task holds
WINDOW = 32                 # tokens backpropagated through
ROUNDS = 3
LANES = 64
LEAST_STEPS = 60            # updates a task makes in a round; it goes over its documents again until then
HELD = 1 << 20              # tokens a task gathers before it trains on them
KEPT = 400_000              # distinct words a task counts before it hands them on
PIECE = 2 << 20             # bytes of text a task splits into tokens at once
END = b""


def tokens(text: str) -> list[bytes]:
    """Words between ASCII blanks, A-Z lower-cased, and the end."""
    found = text.encode().lower().split()
    found.append(END)
    return found


def pieces(texts: pa.Array):
    """The texts in turn, about ``PIECE`` bytes at a time."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64) // PIECE
    borders = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(texts)]
    for i, j in zip(borders, borders[1:]):
        if i < j:
            yield texts.slice(i, j - i)


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """``tokens`` of the texts, one text after the other, and how many each has."""
    plain = pc.ascii_trim_whitespace(pc.ascii_lower(texts))
    # a blank at its end gives a text its end, the empty token; an empty text is its end alone
    found = pc.ascii_split_whitespace(pc.if_else(pc.equal(plain, ""), plain, pc.binary_join_element_wise(plain, "", " ")))
    return found.flatten(), found.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def ending(word: bytes) -> str:
    return word.decode()[-2:]


@dataclass
class Lexicon:
    total: int                      # training tokens
    kinds: int                      # distinct training tokens
    head: dict[bytes, tuple]        # token -> (symbol, count), most frequent first
    ends: dict[str, int]            # ending -> symbol; other endings have the last one
    sizes: np.ndarray               # tokens + words + 1 of each class of endings
    mass: np.ndarray                # training tokens of each symbol

    def symbol(self, word: bytes) -> int:
        known = self.head.get(word)
        return known[0] if known else self.ends.get(ending(word), TOP + ENDINGS - 1)


class Reader:
    """Looks many tokens up in a lexicon at once."""

    def __init__(self, words: Lexicon):
        self.head = pa.array(list(words.head), pa.binary()).cast(pa.string())
        self.ends = pa.array(list(words.ends), pa.string())
        # the last entries stand for words beyond the head and for other endings
        self.symbol_of = np.array([s for s, _ in words.head.values()] + [0], dtype=np.int64)
        self.end_symbol = np.array([*words.ends.values(), TOP + ENDINGS - 1], dtype=np.int64)

    def __call__(self, found: pa.Array):
        """(places in the head, -1 beyond it; symbols; the tokens beyond the head)."""
        at = self._places(found, self.head)
        symbols, beyond = self.symbol_of[at], np.flatnonzero(at < 0)
        tail = found.take(pa.array(beyond))
        symbols[beyond] = self.end_symbol[self._places(pc.utf8_slice_codeunits(tail, -2), self.ends)]
        return at, symbols, tail

    @staticmethod
    def _places(found: pa.Array, known: pa.Array) -> np.ndarray:
        return pc.fill_null(pc.index_in(found, value_set=known), -1).to_numpy(zero_copy_only=False)


def frequent(counts: DataFrame) -> DataFrame:
    """The end and the words of the highest counts, at most ``HEAD``; words of like count are all in or all out.

    The border comes from a histogram of at most 64 x 32 steps, so no task and no driver orders all words.
    """
    step = F.floor(F.log2("n") * 32)
    border, room = None, HEAD
    for r in counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        room -= r["count"]
        if room < 0:
            break
        border = r["step"]
    end = F.col("w") == ""
    return counts.where(end if border is None else end | (step >= border))


def lexicon(counts: DataFrame) -> Lexicon:
    """From the stored counts (w, n): frequent words and class totals."""
    total, kinds = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    head = sorted(frequent(counts).collect(), key=lambda r: (-r["n"], r["w"]))      # at most HEAD + 1 rows
    top = {r["w"]: i + 1 for i, r in enumerate([r for r in head if r["w"]][:TOP - 1])} | {"": 0}
    rest = materialise(counts.where(~F.col("w").isin(list(top))).groupBy(F.substring("w", -2, 2).alias("e")).agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")))
    few = rest.orderBy(F.desc("n"), "e").limit(ENDINGS - 1).collect()
    all_n, all_v = rest.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    ends = {r["e"]: TOP + i for i, r in enumerate(few)}
    sizes, mass = np.ones(ENDINGS), np.zeros(TOP + ENDINGS)
    for i, r in enumerate(few):
        sizes[i], mass[TOP + i] = r["n"] + r["v"] + 1, r["n"]
    mass[-1] = all_n - sum(r["n"] for r in few)
    sizes[-1] = mass[-1] + all_v - sum(r["v"] for r in few) + 1
    known = {}
    for r in head:
        w = r["w"].encode()
        s = top.get(r["w"])
        known[w] = (ends.get(r["w"][-2:], TOP + ENDINGS - 1) if s is None else s, r["n"])
        if s is not None:
            mass[s] = r["n"]
    return Lexicon(int(total or 0), int(kinds), known, ends, sizes, mass)


CLASSES = TOP // PER_CLASS + ENDINGS


def class_of(symbols: np.ndarray) -> np.ndarray:
    return np.where(symbols < TOP, symbols // PER_CLASS, symbols - TOP + TOP // PER_CLASS)


def _sigmoid(minus: np.ndarray) -> None:
    """The logistic function of the negated values, in place."""
    np.exp(minus, out=minus)
    minus += 1
    np.reciprocal(minus, out=minus)


def _by_unit(x: np.ndarray) -> np.ndarray:
    """(units, steps * lanes) of (steps, units, lanes)."""
    return np.ascontiguousarray(x.transpose(1, 0, 2)).reshape(x.shape[1], -1)


class Network:
    """Parameters in one vector; the input vectors stand for embedding and projection in one."""

    SHAPES = {"e": (TOP + ENDINGS, 3 * HIDDEN), "u": (HIDDEN, 3 * HIDDEN), "wc": (HIDDEN, CLASSES), "bc": (CLASSES,),
              "ww": (TOP, HIDDEN), "bw": (TOP,)}

    def __init__(self, flat: np.ndarray):
        self.flat, at = flat, 0
        for name, shape in self.SHAPES.items():
            n = math.prod(shape)
            setattr(self, name, flat[at:at + n].reshape(shape))
            at += n

    @classmethod
    def start(cls, mass: np.ndarray) -> "Network":
        """Random weights; output biases are the corpus frequencies."""
        net = cls(np.zeros(sum(math.prod(s) for s in cls.SHAPES.values()), dtype=np.float32))
        draw = np.random.default_rng(6)
        for name in ("e", "u", "wc", "ww"):
            w = getattr(net, name)
            w[:] = draw.normal(0, 0.1 if name != "u" else HIDDEN ** -0.5, w.shape)
        share = np.bincount(class_of(np.arange(len(mass))), weights=mass + 0.5, minlength=CLASSES)
        net.bc[:] = np.log(share / share.sum())
        net.bw[:] = np.log(mass[:TOP] + 0.5)
        return net

    def step(self, symbols: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The states (HIDDEN, lanes) after the lanes' next symbols; symbol 0 starts a text."""
        if not symbols.all():
            h = h * (symbols != 0)
        x = self.e.take(symbols, 0).T
        a = -self.u[:, :2 * HIDDEN].T @ h
        a -= x[:2 * HIDDEN]
        _sigmoid(a)
        z, r = a[:HIDDEN], a[HIDDEN:]
        r *= h
        new = self.u[:, 2 * HIDDEN:].T @ r
        new += x[2 * HIDDEN:]
        np.tanh(new, out=new)
        h = h - new
        h *= z
        h += new
        return h

    def log_probabilities(self, h: np.ndarray, symbols: np.ndarray, softmax: bool = True):
        """(natural log of each symbol's probability after state h, class softmax, rows of frequent symbols by class, borders of
        their classes, their softmax); softmaxes are (choices, rows).

        Without ``softmax`` only the first is computed to its end.
        """
        h = np.ascontiguousarray(h.T)
        c = class_of(symbols)
        logits = self.wc.T @ h
        logits += self.bc[:, None]
        logits -= logits.max(0)
        out = logits[c, np.arange(len(c))]
        p = np.exp(logits, out=logits)
        whole = p.sum(0)
        out -= np.log(whole)
        if softmax:
            p /= whole
        order = np.argsort(c.astype(np.int8), kind="stable")        # one product for each class
        borders = np.searchsorted(c[order], np.arange(TOP // PER_CLASS + 1))
        often = order[:borders[-1]]
        q = np.empty((PER_CLASS, len(often)), dtype=h.dtype)
        if len(often):
            states, w = h.take(often, 1), self.ww.reshape(-1, PER_CLASS, HIDDEN)
            for k, (i, j) in enumerate(zip(borders, borders[1:])):
                if i < j:
                    np.matmul(w[k], states[:, i:j], out=q[:, i:j])
            q += self.bw.reshape(-1, PER_CLASS).T.take(c[often], 1)
            q -= q.max(0)
            own = q[symbols[often] % PER_CLASS, np.arange(len(often))]
            np.exp(q, out=q)
            sums = q.sum(0)
            out[often] += own - np.log(sums)
            if softmax:
                q /= sums
        return out, p, often, borders, q

    def window(self, inputs: np.ndarray, targets: np.ndarray, valid: np.ndarray, h: np.ndarray):
        """(gradient, last state, log-probability, valid tokens) over a window of (steps, lanes).

        Padded places are not valid. Symbol 0 as input starts a text: the state is zero there. Inside, lanes are the last
        axis, so that gates and states of a step are whole blocks of memory.
        """
        steps, lanes = inputs.shape
        going, starts, padded = inputs != 0, (inputs == 0).any(1), ~valid.all(1)
        first, last = -self.u[:, :2 * HIDDEN].T, self.u[:, 2 * HIDDEN:].T.copy()
        read = inputs.ravel()
        x = np.ascontiguousarray(self.e.take(read, 0).reshape(steps, lanes, 3 * HIDDEN).transpose(0, 2, 1))
        was, new, states = (np.empty((steps, HIDDEN, lanes), dtype=x.dtype) for _ in range(3))
        gates = np.empty((steps, 2 * HIDDEN, lanes), dtype=x.dtype)
        z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
        h = h.T
        for t in range(steps):
            was[t] = h
            if starts[t]:
                was[t] *= going[t]
            h, a, n, s = was[t], gates[t], new[t], states[t]
            np.matmul(first, h, out=a)
            a -= x[t, :2 * HIDDEN]
            _sigmoid(a)
            np.matmul(last, np.multiply(r[t], h, out=s), out=n)
            n += x[t, 2 * HIDDEN:]
            np.tanh(n, out=n)
            np.subtract(h, n, out=s)
            s *= z[t]
            s += n
            if padded[t]:
                s[:] = np.where(valid[t], s, h)
            h = s
        rows = np.flatnonzero(valid.ravel())
        # the state before a token predicts it: targets follow inputs by one place
        hs, y = _by_unit(states), targets.ravel()
        whole = len(rows) == len(y)
        if not whole:
            hs, y = hs.take(rows, 1), y[rows]
        logp, p, often, borders, q = self.log_probabilities(hs.T, y)
        grad = Network(np.zeros_like(self.flat))
        p[class_of(y), np.arange(len(y))] -= 1
        grad.wc[:], grad.bc[:] = hs @ p.T, p.sum(1)
        dh = self.wc @ p
        if len(often):
            q[y[often] % PER_CLASS, np.arange(len(often))] -= 1
            seen, more, w = hs.take(often, 1), np.zeros((HIDDEN, len(often) + 1), dtype=q.dtype), self.ww.reshape(-1, PER_CLASS, HIDDEN)
            by_class, bias = grad.ww.reshape(w.shape), grad.bw.reshape(-1, PER_CLASS)
            for k, (i, j) in enumerate(zip(borders, borders[1:])):
                if i < j:
                    part = q[:, i:j]
                    np.matmul(part, seen[:, i:j].T, out=by_class[k])
                    part.sum(1, out=bias[k])
                    np.matmul(w[k].T, part, out=more[:, i:j])
            place = np.full(len(y), len(often))         # the last column is zero
            place[often] = np.arange(len(often))
            dh += more.take(place, 1)
        if not whole:
            some, dh = dh, np.zeros((HIDDEN, steps * lanes), dtype=x.dtype)
            dh[:, rows] = some
        dh_all = np.ascontiguousarray(dh.reshape(HIDDEN, steps, lanes).transpose(1, 0, 2))
        back = np.zeros((HIDDEN, lanes), dtype=x.dtype)
        moved = np.empty((steps, 3 * HIDDEN, lanes), dtype=x.dtype)
        by_n, by_z, by_r = (1 - z) * (1 - new * new), (was - new) * z * (1 - z), was * r * (1 - r)
        first, last = np.negative(first.T), last.T.copy()
        drh = np.empty_like(back)
        for t in reversed(range(steps)):
            d, m = dh_all[t], moved[t]
            d += back
            if padded[t]:
                d *= valid[t]
                passed = back * ~valid[t]
            np.multiply(d, by_n[t], out=m[2 * HIDDEN:])
            np.matmul(last, m[2 * HIDDEN:], out=drh)
            np.multiply(d, by_z[t], out=m[:HIDDEN])
            np.multiply(drh, by_r[t], out=m[HIDDEN:2 * HIDDEN])
            np.matmul(first, m[:2 * HIDDEN], out=back)
            d *= z[t]
            back += d
            drh *= r[t]
            back += drh
            if padded[t]:
                back += passed
            if starts[t]:
                back *= going[t]
        r *= was
        units, before, kept = _by_unit(moved), _by_unit(was), _by_unit(r)
        grad.u[:, :2 * HIDDEN] = before @ units[:2 * HIDDEN].T
        grad.u[:, 2 * HIDDEN:] = kept @ units[2 * HIDDEN:].T
        grad.e[:] = np.array([np.bincount(read, unit, len(self.e)) for unit in units]).T
        return grad.flat, h.T, float(logp.sum()), len(rows)


class Adam:
    def __init__(self, size: int, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(size, np.float32), np.zeros(size, np.float32), 0, rate

    def update(self, flat: np.ndarray, grad: np.ndarray) -> None:
        """One step on the parameters, in place; the gradient's memory is used up."""
        self.t += 1
        norm = np.linalg.norm(grad)
        if norm > 1:
            grad *= 1 / norm
        part = grad - self.m
        part *= 0.1
        self.m += part
        grad *= grad
        grad -= self.v
        grad *= 0.01
        self.v += grad
        np.divide(self.m, 1 - 0.9 ** self.t, out=part)
        part *= self.rate
        np.divide(self.v, 1 - 0.99 ** self.t, out=grad)
        np.sqrt(grad, out=grad)
        grad += 1e-6
        part /= grad
        flat -= part


def even(lengths: list[int], most: int) -> list[list[int]]:
    """Numbers of texts in at most ``most`` lanes of like length, longest lane first."""
    lanes = [(0, k, []) for k in range(min(most, len(lengths)))]
    for i in sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True):
        tokens_, k, held = lanes[0]
        held.append(i)
        heapq.heapreplace(lanes, (tokens_ + lengths[i], k, held))
    return [held for _, _, held in sorted(lanes, key=lambda x: (-x[0], x[1]))]


def dealt(texts: list[np.ndarray]) -> list[np.ndarray]:
    """At most ``LANES`` lanes of like length that hold each text whole, longest lane first."""
    draw = np.random.default_rng(len(texts))
    return [np.concatenate([texts[held[i]] for i in draw.permutation(len(held))]) for held in even([*map(len, texts)], LANES)]


def train(net: Network, texts: list[np.ndarray], adam: Adam) -> int:
    """Truncated backpropagation over all tokens of the texts (symbols, the end last), in place; returns the tokens seen.

    The end of a text is the start symbol of the next one in its lane. Where few lanes are left, windows share an update.
    """
    seen, lanes = 0, dealt(texts)
    length = np.array([len(x) for x in lanes], dtype=np.int64)
    first, joined = np.cumsum(length) - length, np.concatenate(lanes) if lanes else None
    while lanes:
        h, before = np.zeros((len(lanes), HIDDEN), dtype=np.float32), np.zeros(len(lanes), dtype=np.int64)
        waiting = 0
        for t in range(0, length[0], WINDOW):
            live = int(np.searchsorted(-length, -t, side="left"))           # lanes longer than t
            at = np.arange(t, min(t + WINDOW, length[0]))[:, None]
            rows, valid = np.empty((len(at) + 1, live), dtype=np.int64), at < length[:live]
            rows[0], rows[1:] = before[:live], joined.take(at + first[:live], mode="clip")
            if not valid[-1].all():
                rows[1:][~valid] = 0
            before = rows[-1]
            g, h, _, n = net.window(rows[:-1], rows[1:], valid, h[:live])
            grad, waiting, seen = grad + g if waiting else g, waiting + n, seen + n
            if 2 * waiting >= LANES * WINDOW or t + WINDOW >= length[0]:
                grad /= waiting
                adam.update(net.flat, grad)
                waiting = 0
        if adam.t >= LEAST_STEPS:
            break
    return seen


def teach(batches, flat: np.ndarray, words: Lexicon, rate: float):
    """(tokens seen, parameters times tokens) after training a copy of the network on all tokens of the batches' texts."""
    own, texts, held, seen = Network(flat.copy()), [], 0, 0
    adam = Adam(len(flat), rate)
    read = Reader(words)
    for batch in batches:
        for piece in pieces(batch["text"]):
            found, n = split(piece)
            for row in np.split(read(found)[1].astype(np.int16), np.cumsum(n)[:-1]):
                texts.append(row)
                held += len(row)
                if held >= HELD:
                    seen, texts, held = seen + train(own, texts, adam), [], 0
    seen += train(own, texts, adam)
    if seen:
        yield pa.record_batch({"seen": pa.array([float(seen)]), "flat": pa.array([(own.flat * seen).astype(np.float64)])})


def score_texts(net: Network, texts: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
    """log10 probability of each symbol sequence without the counts of rare words; states run through whole texts.

    Texts run through lanes one after the other, as in training: the end of a text starts the next one from the zero state.
    """
    out, share = np.zeros(len(texts)), np.concatenate([np.zeros(TOP), np.log(sizes)])
    if not len(texts):
        return out
    sizes_ = np.array([*map(len, texts)], dtype=np.int64)
    dealt_ = even(sizes_.tolist(), 8 * LANES)
    order = np.concatenate(dealt_)
    joined, owners = np.concatenate([texts[i] for i in order]), np.repeat(order, sizes_[order])
    length = np.array([sizes_[held].sum() for held in dealt_])
    first = np.cumsum(length) - length
    h, before, kept = np.zeros((HIDDEN, len(length)), dtype=np.float32), np.zeros(len(length), dtype=np.int64), []

    def add():
        states, symbols, whose = zip(*kept)
        y = np.concatenate(symbols)
        logp = net.log_probabilities(np.concatenate(states, 1).T, y, softmax=False)[0] - share[y]
        np.add.at(out, np.concatenate(whose), logp)
        kept.clear()

    for t in range(0, length[0], WINDOW):
        live = np.searchsorted(-length, -np.arange(t, min(t + WINDOW, length[0])), side="left").tolist()     # lanes longer than each step
        # places behind a lane's end are not read
        at = first[:live[0]] + np.arange(t, t + len(live))[:, None]
        rows, owner = joined.take(at, mode="clip"), owners.take(at, mode="clip")
        held = 0
        for now, whose, n in zip(rows, owner, live):
            h = net.step(before[:n], h[:, :n])
            kept.append((h, now[:n], whose[:n]))
            before, held = now, held + n
            if held >= LANES * WINDOW:
                add()
                held = 0
        if kept:
            add()
    return out / math.log(10)


def token_counts(docs: DataFrame) -> DataFrame:
    """w, n over all tokens of the documents; stored."""
    def run(batches):
        held, rows = [], 0

        def together():
            return pa.concat_tables(held).group_by("w", use_threads=False).aggregate([("n", "sum")]).select(["w", "n_sum"]).rename_columns(["w", "n"])

        for batch in batches:
            for piece in pieces(batch["text"]):
                seen = pc.value_counts(split(piece)[0])
                held.append(pa.table({"w": seen.field(0), "n": seen.field(1)}))
                rows += len(seen)
                if rows > 2 * KEPT:
                    held = [together()]
                    rows = len(held[0])
                    if rows > KEPT:
                        yield from held[0].to_batches()
                        held, rows = [], 0
        if held:
            yield from together().to_batches()

    return materialise(docs.select("text").mapInArrow(run, "w string, n bigint").groupBy("w").agg(F.sum("n").alias("n")))


def fit(docs: DataFrame, words: Lexicon, rounds: int = ROUNDS) -> Network:
    """The network after ``rounds`` averaged rounds; each trains on the documents (doc_id, text) that their hash deals to it."""
    net = Network.start(words.mass)
    spark = docs.sparkSession
    for round_ in range(rounds):
        shared = spark.sparkContext.broadcast((net.flat, words))
        rate = 0.02 / (1 + round_)

        def run(batches, shared=shared, rate=rate):
            yield from teach(batches, *shared.value, rate)

        # copies of a text are dealt to rounds by their ids
        h = F.pmod(F.xxhash64(F.lit("round"), "doc_id", "text"), F.lit(rounds))
        copies = docs.where(h == round_).select("text").mapInArrow(run, "seen double, flat array<double>")
        whole = materialise(copies)
        total = whole.agg(F.sum("seen")).first()[0]
        if total:
            mean = whole.select(F.posexplode("flat")).groupBy("pos").agg(F.sum("col").alias("v")).toPandas()    # one row a parameter
            flat = np.zeros(len(net.flat))
            flat[mean["pos"].to_numpy()] = mean["v"].to_numpy() / total
            net = Network(flat.astype(np.float32))
    return net


def score(docs: DataFrame, modulus: int = 7, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Learns from rows whose crc32(doc_id as text) mod ``modulus`` is not ``held_out``. A null text is empty: its end is its
    only token. Rows of equal doc_id and null doc_ids are scored like others.
    """
    rows = documents(docs).withColumn("held_out", remainder("doc_id", modulus) == held_out)
    training = rows.where("not held_out")
    counts = token_counts(training)
    words = lexicon(counts)
    net = fit(training, words)
    shared = docs.sparkSession.sparkContext.broadcast((net.flat, words))

    def run(batches):
        flat, words = shared.value
        net = Network(flat)
        read = Reader(words)
        # the last entry stands for words beyond the head
        log_of = np.log10(np.array([n for _, n in words.head.values()] + [0], dtype=np.float64) + 1)
        for batch in batches:
            symbols, columns, tails = [], [], []
            for piece in pieces(batch["text"]):
                found, n = split(piece)
                at, row, tail = read(found)
                logs, first = log_of[at], np.cumsum(n) - n          # every text has a token, its end
                symbols += np.split(row, first[1:])
                n_known = np.add.reduceat((at >= 0).astype(np.int64), first)
                columns.append((n, n_known, np.add.reduceat(logs, first), np.add.reduceat(np.where(row >= TOP, logs, 0), first)))
                joined = pc.binary_join(pa.ListArray.from_arrays(np.append(0, np.cumsum(n - n_known)).astype(np.int32), tail), " ")
                tails.append(pc.if_else(pa.array(n > n_known), joined, None))
            if not symbols:
                continue
            n_tokens, n_known, base, more = map(np.concatenate, zip(*columns))
            score = score_texts(net, symbols, words.sizes) + more
            yield pa.record_batch({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "n_tokens": pa.array(n_tokens, pa.int64()),
                                   "n_known": pa.array(n_known, pa.int64()), "base": pa.array(base, pa.float64()),
                                   "score": pa.array(score, pa.float64()), "tail": pa.concat_arrays(tails)})

    scored = materialise(rows.select("doc_id", "held_out", "text").mapInArrow(
        run, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, score double, tail string")
        .withColumn("row", F.monotonically_increasing_id()))
    # words beyond the head: their counts come by a join; none of them is frequent
    tail = scored.where("tail is not null").select("row", F.explode(F.split("tail", " ")).alias("w"))
    tail = tail.join(counts, "w").groupBy("row").agg(F.sum(F.log10(F.col("n") + 1)).alias("more"), F.count(F.lit(1)).alias("known"))
    base = F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * math.log10(words.total + words.kinds + 1)
    return scored.drop("tail").join(tail, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(words.total).cast("bigint").alias("train_tokens"), base.alias("base_score"),
        (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"))


@query("op6_recurrent_lm")
def op6(spark, base):
    return score(table(spark, base, "documents"))
