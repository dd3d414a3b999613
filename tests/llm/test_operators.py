"""The operators against brute force, library answers and SQL, and on odd rows."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgersight.llm import ORACLE, QUERIES, bag_minhash, bpe, components, line_dedup, packing, pii, recurrent_lm, suffix_dedup, toxicity, vector_dedup, vector_search
from tests.conftest import BASE
from tests.oracle import connect, difference

SCHEMA = "doc_id bigint, text string, lang string, n_lines bigint, d bigint, key string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows and clashing names."""
    long = " ".join(f"word{i % 977} a.b@c-{i}.org" for i in range(4_000))
    rows = [(1, None), (2, ""), (3, " \n \n"), (4, "Same line here\nother text of it"), (5, "same line here \nmore"), (5, "same line here \nmore"),
            (6, long), (7, long + " end"), (None, "Same line here"), (8, "1" * 3_000 + " " + "a." * 3_000), (9, "é" * 500 + "\n" + "é" * 500)]
    return spark.createDataFrame([(i, t, "x", 7, 1, "k") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def transducer():
    return bpe.Transducer(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), max_states=2_000)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=40) | st.text(alphabet="aeiounst ", max_size=60))
def test_encoding_equals_merging(transducer, text):
    data = text.encode()
    assert transducer.encode(data) == ([transducer.ranks[data]] if data in transducer.ranks else transducer.merge(data))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=4), max_size=12))
def test_streamed_text_is_python_s(pieces):
    machine = bpe.Utf8Machine(dict(enumerate(pieces)))
    ids = range(len(pieces))
    assert "".join(machine.stream(ids)) == machine.text(ids) == b"".join(pieces).decode("utf-8", "replace")


def test_op1_equals_the_library(spark):
    import tiktoken
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{BASE}/documents.parquet").collect()}
    for r in QUERIES["op1_byte_bpe"](spark, BASE).collect():
        ids = library.encode_ordinary(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_bpe_odd(odd, nothing):
    back = sorted((r.doc_id or 0, r.text) for r in bpe.decode(bpe.encode(odd)).collect())
    assert back == sorted((r.doc_id or 0, r.text or "") for r in odd.collect())
    assert bpe.digest(nothing).count() == 0


def test_spelling_evidence_and_score(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = {r.doc_id: r for r in QUERIES["op2_kneser_ney_toxicity"](spark, "/root/testdata/sf0.01").collect()}
    assert len(out) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out.values())
    pairs = [(out[r.doc_id].score, r.toxic) for r in labels.collect() if r.doc_id in out and out[r.doc_id].held_out]
    good, bad = [s for s, t in pairs if t], [s for s, t in pairs if not t]
    assert sum((g > b) + (g == b) / 2 for g in good for b in bad) / len(good) / len(bad) > 0.9     # held-out AUC
    assert sum(b >= 0.7 for b in bad) / len(bad) < 0.02


def test_toxicity_odd(spark, odd, nothing):
    labels = spark.createDataFrame([(4, 1), (None, 1), (9, None)], "doc_id bigint, toxic int")
    assert toxicity.score(odd, toxicity.fit(odd, labels)).count() == odd.count()
    assert toxicity.score(nothing, toxicity.fit(nothing, labels)).count() == 0
    model, curve = toxicity.Model({"^ab": 1.0}, {"^a": 0.5}), np.array([0.0, 1.0, 0.0, 0.0])
    assert toxicity.drop_toxic(odd, (model, curve)).columns == odd.columns


def brute_links(rows, threshold):
    out = {}
    for (i, v, a), (j, w, b) in itertools.product(rows, rows):
        ok = lambda x: x is not None and all(c is not None and math.isfinite(c) for c in x) and any(x)
        if i != j and a is not None and a == b and ok(v) and ok(w) and len(v) == len(w):
            x, y = np.array(v), np.array(w)
            if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                out.setdefault(i, set()).add(j)
    return out


def test_near_vectors_equal_brute_force(spark):
    draw = np.random.default_rng(1)
    rows = [(i, draw.normal(size=16).tolist(), i % 3) for i in range(60)]
    rows += [(100 + i, (np.array(rows[i % 5][1]) * 2 + draw.normal(size=16) * 0.05 * (i % 7)).tolist(), (i % 5) % 3) for i in range(60)]
    rows += [(300, rows[0][1], 0), (301, None, 0), (302, [0.0] * 16, 0), (303, rows[0][1], None), (304, [float("nan")] * 16, 0), (305, [None] * 16, 0), (306, [1.0], 0), (307, [2.0], 0)]
    want = brute_links(rows, 0.98)
    got = vector_dedup.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect()
    assert {r.vec_id: r.n_links for r in got} == {i: len(want.get(i, ())) for i, _, _ in rows}
    for r in got:
        seen, todo = {r.vec_id}, [r.vec_id]
        while todo:
            new = want.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        assert (r.component_id, r.kept) == (min(seen), r.vec_id == min(seen))


def test_full_cells_are_split(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "SHARE", 7)
    draw = np.random.default_rng(2)
    rows = [(i, (np.ones(8) + draw.normal(size=8) * 0.05).tolist(), 0) for i in range(60)]
    want = brute_links(rows, 0.98)
    got = vector_dedup.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect()
    assert {r.vec_id: r.n_links for r in got} == {i: len(want.get(i, ())) for i, _, _ in rows}


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a bigint, b bigint")
    assert {r.id: r.component for r in components.components(edges).collect()} == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_search_recall_and_scores(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    data = {r.vec_id: np.array(r.embedding, dtype=float) for r in rows.collect()}
    hits = total = 0
    got = QUERIES["op4_one_bit_search"](spark, "/root/testdata/sf0.01").collect()
    for q in (i for i in data if i % 20 == 0):
        best = sorted(((-float(v @ data[q]), i) for i, v in data.items() if i != q))[:20]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 21))
        assert all(abs(r.score - float(data[q] @ data[r.vec_id])) < 1e-9 for r in mine)
        hits, total = hits + len({r.vec_id for r in mine} & {i for _, i in best}), total + 20
    assert hits / total >= 0.95


def test_search_of_vectors_of_all_lengths(spark):
    draw = np.random.default_rng(5)
    data = draw.normal(size=(900, 24)) * np.exp(draw.normal(size=(900, 1)) * 2)
    data[::7] *= 1e-160                             # lengths whose squares leave the doubles
    data[3::7] = data[3::7] + 5 * data[3]
    data[:200:40] *= 1e150
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id bigint, embedding array<double>")
    got = vector_search.nearest(df, df.where("vec_id % 20 = 0"), rows_per_shard=400).collect()
    hits = total = 0
    for q in range(0, 900, 20):
        exact = [float(data[q] @ v) for v in data]
        best = sorted((-s, i) for i, s in enumerate(exact) if i != q)[:20]
        mine = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r for r, _, _ in mine] == list(range(1, 21))
        assert all(abs(s - exact[i]) <= 1e-12 * np.linalg.norm(data[q]) * np.linalg.norm(data[i] / 1e9) * 1e9 for _, i, s in mine)
        hits, total = hits + len({i for _, i, _ in mine} & {i for _, i in best}), total + 20
    assert hits / total >= 0.99


def test_search_equal_scores_of_one_dimension(spark):
    df = spark.createDataFrame([(i, [0.1 * (1 + i % 3)]) for i in range(200)], "vec_id bigint, embedding array<double>")
    got = vector_search.nearest(df, df.where("vec_id % 100 = 0"), k=5).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == [(q, n + 1, 3 * n + 2) for q in (0, 100) for n in range(5)]


def test_search_odd(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0]), (None, [1.0, 1.0])],
                                 "vec_id bigint, embedding array<double>")
    got = vector_search.nearest(rows, rows.where("vec_id % 20 = 0"), k=5).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == [(0, 1, 1), (0, 2, 20), (20, 1, 0), (20, 2, 1)]
    assert vector_search.nearest(rows.limit(0), rows.limit(0)).count() == 0


def test_search_bound_covers_errors():
    draw = np.random.default_rng(8)
    base, queries = draw.normal(size=(3_000, 64)), draw.normal(size=(40, 64))
    guess, bound = vector_search.Codes(base).estimate(queries)
    assert (np.abs(guess - queries @ base.T) <= bound).mean() > 0.99


def test_search_counts_repeated_rows_once(spark):
    draw = np.random.default_rng(3)
    data = {i: [draw.normal(size=16)] for i in range(60)}
    data[7].append(data[3][0] * 1.5)                # one id, different rows: the better one counts
    data[0].append(data[9][0] * 2)
    rows = [(i, v.tolist()) for i, vs in data.items() for v in vs] + [(i, data[i][0].tolist()) for i in (0, 0, 3, 3, 4, 20)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = vector_search.nearest(df, df.where("vec_id % 20 = 0"), k=10, rows_per_shard=30).collect()
    for q in (0, 20, 40):
        best = sorted((-max(float(v @ x) for v in vs for x in data[q]), i) for i, vs in data.items() if i != q)[:10]
        assert [(r["rank"], r.vec_id) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == [(n + 1, i) for n, (_, i) in enumerate(best)]


def best_possible(items, capacity):
    best = [len(items)]

    def place(i, rooms):
        if len(rooms) < best[0]:
            if i == len(items):
                best[0] = len(rooms)
                return
            for k in {r: k for k, r in enumerate(rooms) if r >= items[i]}.values():
                rooms[k] -= items[i]
                place(i + 1, rooms)
                rooms[k] += items[i]
            place(i + 1, rooms + [capacity - items[i]])

    place(0, [])
    return best[0]


def test_reduction_loses_no_optimum():
    draw = random.Random(1)
    for _ in range(400):
        capacity = draw.choice([10, 20, 37])
        items = sorted((draw.randint(1, capacity) for _ in range(draw.randint(0, 9))), reverse=True)
        plan = packing.plan_lengths(Counter(items), capacity)
        content = Counter()
        for pattern, times in plan.patterns:
            assert sum(a * n for a, n in pattern) <= capacity
            for a, n in pattern:
                content[a] += n * times
        assert content == Counter(items)
        if plan.fixed == sum(t for _, t in plan.patterns):
            assert plan.fixed == best_possible(items, capacity)


def test_pieces_are_the_tokenizer_s(spark, odd):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{BASE}/documents.parquet").select("doc_id", "text").unionByName(
        odd.select("doc_id", "text").where("doc_id <> 5").withColumn("doc_id", F.col("doc_id") + 10_000)).unionByName(
        spark.createDataFrame([(20_000, "a<|endoftext|>b"), (20_001, "ǅ߿ꯍ١  x  y"), (20_002, "it's\r\n  12ab")], "doc_id bigint, text string"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = packing.pack(packing.pieces(docs)).collect()
    for i, text in texts.items():
        ids = library.encode(text, add_special_tokens=False).ids + [0]
        mine = sorted((r for r in got if r.doc_id == i), key=lambda r: r.piece)
        assert [r.start for r in mine] == [sum(m.length for m in mine[:k]) for k in range(len(mine))] and len(mine) == -(-len(ids) // 2048)
        assert all(r.ids_crc32 == zlib.crc32(np.array(ids[r.start:r.start + r.length], "<u4").tobytes()) for r in mine)
    for _, rows in itertools.groupby(sorted(got, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        at = 0
        for r in rows:
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert len({r.sequence_id for r in got}) <= 1.02 * sum(r.length for r in got) / 2048 + 1


def test_packing_odd(odd, nothing):
    assert packing.pack(packing.pieces(odd)).where("piece = 0").count() == odd.count()
    assert packing.pack(packing.pieces(nothing)).count() == 0


def test_network_gradient():
    draw = np.random.default_rng(0)
    n = recurrent_lm.TOP + recurrent_lm.ENDINGS
    net = recurrent_lm.Network(recurrent_lm.Network.start(np.arange(n)[::-1].astype(float)).flat.astype(float))
    x, y, valid = draw.integers(0, n, (5, 3)), draw.integers(0, n, (5, 3)), np.ones((5, 3), bool)
    valid[3:, 1] = False
    h = draw.normal(size=(3, recurrent_lm.HIDDEN)) * 0.1
    grad = net.window(x, y, valid, h)[0]
    for i in draw.choice(np.flatnonzero(grad), 20):
        old, seen = net.flat[i], []
        for d in (1e-5, -1e-5):
            net.flat[i] = old + d
            seen.append(net.window(x, y, valid, h)[2])
        net.flat[i] = old
        assert abs((seen[1] - seen[0]) / 2e-5 - grad[i]) < 1e-4 * (abs(grad[i]) + 1)


def test_class_probabilities_sum_to_one():
    n = recurrent_lm.TOP + recurrent_lm.ENDINGS
    net = recurrent_lm.Network.start(np.ones(n))
    h = np.random.default_rng(1).normal(size=(1, recurrent_lm.HIDDEN)).astype(np.float32)
    p = np.exp(net.log_probabilities(np.repeat(h, n, 0), np.arange(n))[0])
    assert abs(p.sum() - 1) < 1e-4


def test_language_model_base_and_gain(spark):
    texts = {r.doc_id: (r.text or "").encode().lower().split() + [b""] for r in spark.read.parquet(f"{BASE}/documents.parquet").collect()}
    counts = Counter(w for i, ws in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    total, kinds = sum(counts.values()), len(counts)
    got = QUERIES["op6_recurrent_lm"](spark, BASE).collect()
    for r in got:
        ws = texts[r.doc_id]
        base = sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in ws)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(counts[w] > 0 for w in ws), total) and abs(base - r.base_score) < 1e-6 * (1 - base)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_training_reads_whole_documents(monkeypatch):
    """Untrained (rate 0) windows give each text's whole log-probability, as scoring with its state through the text does."""
    draw, words = random.Random(7), [f"w{i}" for i in range(60)]
    texts = ["", "w1", *(" ".join(draw.choices(words, k=n)) for n in (5, 31, 32, 127, 128, 129, 700, 3_000)), *["w3 w4"] * 90]
    head = {b"": (0, 1)} | {w.encode(): (i + 1, 1) for i, w in enumerate(words[:50])}
    lexicon = recurrent_lm.Lexicon(1, 1, head, {"55": recurrent_lm.TOP}, np.ones(recurrent_lm.ENDINGS), np.ones(recurrent_lm.TOP + recurrent_lm.ENDINGS))
    net, read, window = recurrent_lm.Network.start(lexicon.mass), [], recurrent_lm.Network.window
    monkeypatch.setattr(recurrent_lm, "LEAST_STEPS", 1)

    def kept(self, inputs, targets, valid, h):
        out = window(self, inputs, targets, valid, h)
        read.append((Counter(zip(inputs[valid].tolist(), targets[valid].tolist())), out[2]))
        return out

    monkeypatch.setattr(recurrent_lm.Network, "window", kept)
    batch = recurrent_lm.pa.record_batch({"text": recurrent_lm.pa.array(texts)})
    out = list(recurrent_lm.teach([batch], net.flat, lexicon, 0.0))[0]
    rows = [np.array([lexicon.symbol(w) for w in recurrent_lm.tokens(t)]) for t in texts]
    assert out["seen"][0].as_py() == sum(map(len, rows))
    assert sum((r for r, _ in read), Counter()) == sum((Counter(zip([0, *r[:-1].tolist()], r.tolist())) for r in rows), Counter())
    want = recurrent_lm.score_texts(net, rows, lexicon.sizes).sum() * math.log(10)
    assert abs(sum(x for _, x in read) - want) < 1e-4 * abs(want)


def test_texts_share_lanes_while_they_are_scored(monkeypatch):
    """Steps follow from the longest text and not from one chunk of texts after the other; each text scores as it does alone."""
    draw, n = np.random.default_rng(5), recurrent_lm.TOP + recurrent_lm.ENDINGS
    net, sizes = recurrent_lm.Network.start(draw.random(n) * 9), draw.random(recurrent_lm.ENDINGS) * 9 + 1
    net.flat += draw.normal(0, 0.2, len(net.flat)).astype(np.float32)
    texts = [np.append(draw.integers(1, n, k), 0) for k in (0, 1, 31, 32, 33, 900, *draw.integers(0, 12, 1_800))]
    alone, calls, step = np.array([recurrent_lm.score_texts(net, [x], sizes)[0] for x in texts[:300]]), [], recurrent_lm.Network.step
    monkeypatch.setattr(recurrent_lm.Network, "step", lambda *a: calls.append(1) or step(*a))
    got = recurrent_lm.score_texts(net, texts, sizes)
    assert np.allclose(got[:300], alone, rtol=1e-5) and len(calls) == 901
    assert len(recurrent_lm.score_texts(net, [], sizes)) == 0


def test_tokens_are_split_and_looked_up_many_at_once(spark, monkeypatch):
    """Tasks split and look up whole pieces of text, as ``tokens`` and ``Lexicon.symbol`` do for one text and one word."""
    draw, signs = random.Random(11), " \t\n\x0b\x0c\r\x1c\x1f\x85\xa0\u3000\0AbÄßé\U0001d4b3"
    texts = ["", " ", " a  B ", *("".join(draw.choices(signs, k=draw.randrange(9))) for _ in range(3_000))]
    want = [recurrent_lm.tokens(t) for t in texts]
    counts = Counter(w for ws in want for w in ws)
    head = {w: (i, n) for i, (w, n) in enumerate(counts.most_common(40))}
    ends = {e: recurrent_lm.TOP + i for i, e in enumerate(("ab", "b", "Äß", "é\U0001d4b3"))}
    lexicon = recurrent_lm.Lexicon(1, 1, head, ends, np.ones(recurrent_lm.ENDINGS), np.ones(recurrent_lm.TOP + recurrent_lm.ENDINGS))
    monkeypatch.setattr(recurrent_lm, "PIECE", 1_000)
    monkeypatch.setattr(recurrent_lm, "KEPT", 50)
    monkeypatch.setattr(recurrent_lm, "tokens", None)
    got, read, cut = [], recurrent_lm.Reader(lexicon), list(recurrent_lm.pieces(recurrent_lm.pa.array(texts)))
    assert sum(map(len, cut)) == len(texts) and len(cut) > 5
    for piece in cut:
        found, n = recurrent_lm.split(piece)
        at, symbols, tail = read(found)
        words = [w.encode() for w in found.to_pylist()]
        assert symbols.tolist() == [lexicon.symbol(w) for w in words] and [w.encode() for w in tail.to_pylist()] == [w for w in words if w not in head]
        assert [i >= 0 for i in at] == [w in head for w in words]
        got += [words[j - k:j] for j, k in zip(np.cumsum(n), n)]
    assert got == want
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    assert {r.w.encode(): r.n for r in recurrent_lm.token_counts(docs).collect()} == counts
    assert not recurrent_lm.token_counts(docs.where("false")).count()


def test_language_model_odd(odd, nothing):
    got = recurrent_lm.score(odd).collect()
    assert len(got) == odd.count() and all(math.isfinite(r.score) for r in got)
    assert recurrent_lm.score(nothing).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=40))
def test_suffix_array_is_sorted(text):
    assert suffix_dedup.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


@pytest.mark.parametrize("full", [suffix_dedup.FULL, 1])
def test_repeats_equal_brute_force(spark, odd, full, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "FULL", full)
    draw = random.Random(4)
    shared = "".join(draw.choice("abcde ") for _ in range(900))
    rows = [(i, "".join(draw.choice("abc") for _ in range(150)) + shared[i * 9:i * 9 + 150 + 30 * i] + "é") for i in range(12)] + [(90, "xy" * 300), (91, None), (92, "q" * 201)]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id bigint, text string, d int, spans int")
    data = {i: (t or "").encode() for i, t in rows}
    seen = Counter(x[k:k + 200] for x in data.values() for k in range(len(x) - 199))
    for r in suffix_dedup.remove_repeats(docs).collect():
        x = data[r.doc_id]
        gone = np.zeros(len(x) + 1, bool)
        for k in range(len(x) - 199):
            if seen[x[k:k + 200]] > 1:
                gone[k:k + 200] = True
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(x), gone.sum(), (np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        assert bytes(r.kept) == bytes(b for b, g in zip(x, gone) if not g)


@pytest.mark.parametrize("full", [1, 9])
def test_crowded_anchors_are_split_before_their_strings_are_rows(spark, full, monkeypatch):
    """One phrase in many texts: more bytes around it part what differs, and what is left stays right."""
    monkeypatch.setattr(suffix_dedup, "FULL", full)
    seen, real = [], suffix_dedup.single_strings
    monkeypatch.setattr(suffix_dedup, "single_strings", lambda windows: seen.append(windows.agg({"n": "sum"}).first()[0] or 0) or real(windows))
    draw = random.Random(7)
    word = lambda n: "".join(draw.choice("abcdefgh ") for _ in range(n))
    phrase, tail, head = word(60), word(170), word(170)
    rows = [(i, word(250) + phrase + word(250)) for i in range(60)] + [(100 + i, word(250) + phrase + tail + word(50)) for i in range(6)] + [
        (200 + i, word(50) + head + phrase + word(250)) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    data = {i: t.encode() for i, t in rows}
    count = Counter(x[k:k + 200] for x in data.values() for k in range(len(x) - 199))
    for r in suffix_dedup.remove_repeats(docs).collect():
        x, gone = data[r.doc_id], np.zeros(560, bool)
        for k in range(len(x) - 199):
            if count[x[k:k + 200]] > 1:
                gone[k:k + 200] = True
        assert r.n_removed == gone.sum()
        assert bytes(r.kept) == bytes(b for b, g in zip(x, gone) if not g)
    assert seen[0] < (3_000 if full == 1 else 1)


def test_anchors_of_many_pieces_at_once():
    """Every start has one anchor inside its string; equal strings have the same one at the same place, in whatever piece and call they are."""
    draw, seen = random.Random(3), {}
    for letters in (b"x", b"ab", bytes(range(97, 123))):
        core = bytes(draw.choices(letters, k=900))
        pieces = [core[draw.randrange(300):][:n] for n in (0, 199, 200, 201, 500, 600)] + [bytes(draw.choices(letters, k=700)), b"", core]
        calls = [suffix_dedup.stretches(pieces), *(suffix_dedup.stretches([x]) for x in pieces)]
        for n, call in enumerate(calls):
            starts, whole = Counter(), {}
            for k, key, w, s, e, at in zip(*(c.tolist() for c in call)):
                text = pieces[k] if n == 0 else pieces[n - 1]
                assert 0 <= s <= e <= at <= s + 168
                assert whole.setdefault((key, w), (text[s:e + 200], at - s)) == (text[s:e + 200], at - s)
                for x in range(s, e + 1):
                    starts[k, x] += 1
                    assert seen.setdefault(text[x:x + 200], (key, at - x)) == (key, at - x)
            assert set(starts.values()) <= {1} and len(starts) == sum(max(0, len(x) - 199) for x in (pieces if n == 0 else pieces[n - 1:n]))


def test_stretches_of_long_texts_end_at_pieces(spark, monkeypatch):
    """A text of several pieces, copies of its rows and a repeat over the border of two pieces."""
    monkeypatch.setattr(suffix_dedup, "PIECE", 512)
    draw = random.Random(8)
    word = lambda n: "".join(draw.choice("abcdefgh ") for _ in range(n))
    phrase = word(700)
    rows = [(1, word(430) + phrase + word(900)), (2, word(37) + phrase[100:] + word(5_000) + phrase[:333]), (3, word(800)), (3, None), (4, phrase[200:450])] + [(5, word(1_500))] * 3
    count = Counter((t or "")[k:k + 200] for _, t in rows for k in range(len(t or "") - 199))
    want = Counter()
    for i, t in rows:
        x, gone = (t or "").encode(), np.zeros(len(t or "") + 1, bool)
        for k in range(len(x) - 199):
            if count[x[k:k + 200].decode()] > 1:
                gone[k:k + 200] = True
        want[i, len(x), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), bytes(b for b, g in zip(x, gone) if not g)] += 1
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got.collect()) == want


def test_candidates_keep_every_repeated_string():
    draw = random.Random(2)
    for _ in range(60):
        core = bytes(draw.randrange(97, 100) for _ in range(420))
        texts, places, starts = [], [], []
        for _ in range(5):
            a, b = draw.randint(0, 168), draw.randint(200, 368)
            t = bytearray(core[200 - a:200 + b])
            for _ in range(draw.randint(0, 2)):
                t[draw.randrange(len(t))] = 120
            if len(t) >= 200:
                texts.append(bytes(t)), places.append(a), starts.append(min(a, len(t) - 200) + 1)
        kept = suffix_dedup.candidates(texts, starts, places)
        for i, (t, p, n) in enumerate(zip(texts, places, starts)):
            for k in range(n):
                if any(j != i and 0 <= q - (p - k) < m and u[q - (p - k):][:200] == t[k:k + 200] for j, (u, q, m) in enumerate(zip(texts, places, starts))):
                    assert kept[i][0] <= k < sum(kept[i])


def test_suffix_odd(odd, nothing):
    got = suffix_dedup.remove_repeats(odd).collect()
    assert len(got) == odd.count() and {r.n_bytes for r in got if r.doc_id in (1, 2)} == {0}
    assert suffix_dedup.remove_repeats(nothing).count() == 0


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    def ok(kind, m):
        digits = re.sub("[^0-9]", "", m)
        check = sum(int(x) if i % 2 == 0 else sum(divmod(2 * int(x), 10)) for i, x in enumerate(reversed(digits))) % 10 == 0
        return (kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m.split(".")) or kind == "phone" and 9 <= len(digits) <= 15
                or kind == "card" and 12 <= len(digits) <= 19 and check)
    found = sorted((m.start(), k, kind, m.end()) for k, kind in enumerate(PLAIN) for m in re.finditer(PLAIN[kind], text) if ok(kind, m[0]))
    return [(kind, a, b) for a, _, kind, b in found]


def test_base_spans_equal_plain_patterns(spark, odd):
    draw = random.Random(5)
    made = ["".join(draw.choice(["1", "4", "0", ".", "-", " ", "@", "a", "+", "(", ")", "a@b.c", "..", "127.0.0.1", "4111 1111 1111 1111", "é"])
                    for _ in range(draw.randint(1, 60))) for _ in range(400)]
    rows = spark.createDataFrame([(t,) for t in made + ["a@b.c..d@e.f", "1" * 5_000, "0001.2.3.4 01.300.1.1", "x@" + "a." * 5_000]], "text string").unionByName(odd.select(F.coalesce("text", F.lit("")).alias("text")))
    for r in rows.select("text", pii.base_spans(F.col("text")).alias("s")).collect():
        assert [(s.kind, s.start, s.end) for s in r.s] == plain_spans(r.text)


def test_context_finds_unseen_identifiers(spark):
    rows = [(i, f"some words then contact {a}{i}@mail.org now") for i, a in enumerate("abcdefghijklmnopqrst")] + [(99, "other words then contact ké9@mail.örg now"), (98, "other 123 things")]
    found = pii.find(spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, spans int"))
    got = {r.doc_id: r for r in found.collect()}
    assert [(s.kind, s.start, s.end) for s in got[99].spans] == [("email", 25, 37)] and not got[99].base and not got[98].spans
    text = found.where("doc_id = 0").select(pii.redact(F.col("text"), F.col("spans")).alias("t")).first().t
    assert text == "some words then contact [email] now"


def test_pii_odd(odd, nothing):
    assert pii.find(odd).count() == odd.count() and pii.find(nothing).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    assert difference(QUERIES[name](spark, BASE), connect(BASE), ORACLE[name]) is None


@pytest.mark.parametrize("fanout", [2, 3])
def test_line_dedup_odd(odd, nothing, fanout):
    got = line_dedup.drop_repeated_lines(odd, batches=5, fanout=fanout).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got}
    assert by[None].text == "Same line here" and by[4].text == "other text of it" and by[5].text == "more"
    assert (by[1].n_lines, by[3].n_lines, by[3].text, by[9].n_dropped) == (1, 3, " \n \n", 0)
    assert line_dedup.drop_repeated_lines(nothing).count() == 0


def test_signature_estimates_weighted_jaccard():
    a, b = (np.arange(60, dtype=np.uint64) * 7919 + 1, np.arange(20, 80, dtype=np.uint64) * 7919 + 1)
    n, m = np.arange(60) % 9 + 1, (np.arange(20, 80) * 3) % 8 + 1
    wa, wb = dict(zip(a.tolist(), n.tolist())), dict(zip(b.tolist(), m.tolist()))
    keys = wa.keys() | wb.keys()
    want = sum(min(wa.get(k, 0), wb.get(k, 0)) for k in keys) / sum(max(wa.get(k, 0), wb.get(k, 0)) for k in keys)
    got = (bag_minhash.signature(a, n, 4_096) == bag_minhash.signature(b, m, 4_096)).mean()
    assert abs(got - want) < 0.03
    ea, eb = bag_minhash.expanded(a, n), bag_minhash.expanded(b, m)
    assert abs(len(np.intersect1d(ea, eb)) / len(np.union1d(ea, eb)) - want) < 1e-12


def classes_by_force(texts, least=0.8):
    bags = {i: Counter(zip(*[(t or "").encode().lower().split()[k:] for k in range(5)])) for i, t in texts.items()}
    of = {i: i for i in texts}
    for i, j in itertools.combinations(sorted(texts), 2):
        both = (bags[i] & bags[j]).total()
        if both and both / (bags[i] | bags[j]).total() >= least:
            low, high = sorted((of[i], of[j]))
            of = {k: low if c == high else c for k, c in of.items()}
    return of


@pytest.mark.parametrize("share", [2_000, 3])
def test_classes_equal_brute_force(spark, share, monkeypatch):
    monkeypatch.setattr(bag_minhash.family_links, "__defaults__", (share,))
    draw = random.Random(6)
    base = [f"w{draw.randint(0, 400)}" for _ in range(200)]
    texts = {}
    for i in range(40):
        words = list(base)
        for _ in range(draw.randint(0, 9)):
            words[draw.randrange(200)] = f"z{draw.randint(0, 9999)}"
        texts[i] = " ".join(words)
    texts |= {50: "a b c", 51: "A  b\tc", 52: "", 53: None, 54: " ".join(["la la la la la"] * 30), 55: " ".join(["la la la la la"] * 28)}
    want = classes_by_force(texts)
    want[51] = 50
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in texts.items()], "doc_id bigint, text string, h int, rep int")
    assert {r.doc_id: r.class_id for r in bag_minhash.near_documents(docs).collect()} == want
    left = bag_minhash.drop_near_copies(docs)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == set(want.values())


def test_blocks_are_bounded_by_shingles(spark, monkeypatch):
    families = spark.createDataFrame([(i, i // 4) for i in range(8)], "rep bigint, family bigint")
    features = spark.createDataFrame([(i, bytearray(), 3_000_000 if i < 4 else 10) for i in range(8)], "rep bigint, items binary, n bigint")
    assert {r.family: r.blocks for r in bag_minhash.block_counts(families, features, 2_000).collect()} == {0: 3, 1: 1}
    assert {r.family: r.blocks for r in bag_minhash.block_counts(families, features, 1).collect()} == {0: 4, 1: 4}
    texts = {i: " ".join(f"w{k}" for k in range(i % 3, 150)) for i in range(20)}
    monkeypatch.setattr(bag_minhash, "SHINGLES", 300)
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    assert {r.doc_id: r.class_id for r in bag_minhash.near_documents(docs).collect()} == classes_by_force(texts)


def test_near_documents_odd(odd, nothing):
    assert bag_minhash.near_documents(odd).count() == odd.count()
    assert bag_minhash.drop_near_copies(odd).count() == 9      # 7 is near 6, one of both rows 5 goes
    assert bag_minhash.near_documents(nothing).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline
    docs = spark.read.parquet(f"{BASE}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.materialise(stage(spark, before, BASE))
        assert after.columns == docs.columns and after.count() <= before.count()
        assert after.join(before, "doc_id", "left_anti").count() == 0
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, before, BASE)
    assert packed.select("doc_id").distinct().count() == before.count()
