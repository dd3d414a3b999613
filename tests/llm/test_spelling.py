"""Spelling variants against all pairs."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgersight.llm import QUERIES, spelling
from tests.conftest import BASE


def brute_counts(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
            if h % 97 == 0:
                i = h % len(word)
                word = word[:i] + word[i + 1:]
            counts[word] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(counts, fewest=3):
    n = {w: c for w, c in counts.items() if c >= fewest}
    # all pairs, by the letters a word has left without one
    left = {}
    for w in n:
        for x in {w} | {w[:i] + w[i + 1:] for i in range(len(w))}:
            left.setdefault(x, set()).add(w)
    near = {w: set() for w in n}
    for group in left.values():
        for a in group:
            near[a] |= {b for b in group if a != b and one_edit(a, b)}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def as_dict(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def test_query_equals_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{BASE}/documents.parquet").select("doc_id", "text").collect()]
    got = as_dict(QUERIES["op11_spelling_variants"](spark, BASE))
    assert got == brute_variants(brute_counts(rows))
    assert any(form for form, *_ in got.values())


@pytest.mark.parametrize("symbols", [1, 3, 16])
def test_any_alphabet_finds_all_pairs(spark, symbols):
    draw = random.Random(symbols)
    words = {"".join(draw.choice("abcé") for _ in range(draw.randint(1, 6))) for _ in range(250)} | {"x" * 300, "x" * 301, "x" * 299 + "y"}
    counts = {w: draw.randint(3, 40) for w in words}
    df = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    assert as_dict(spelling.variants(df, symbols=symbols)) == brute_variants(counts)


def test_neighbourhood_holds_every_edit():
    word = "abcde"
    made = spelling.Reduced([word], 4)
    found = set(np.concatenate([b.ravel() for b in made.neighbours(slice(None))]).tolist())
    digits = made.digits[0].tolist()

    def key(d):
        k = 0
        for x in d:
            k = (k * spelling.BASE + x) % 2 ** 64
        return k

    want = {key(digits)}
    for i in range(6):
        want |= {key(digits[:i] + [s] + digits[i:]) for s in range(1, 5)}
        if i < 5:
            want |= {key(digits[:i] + [s] + digits[i + 1:]) for s in range(1, 5)} | {key(digits[:i] + digits[i + 1:])}
    assert found == want


def test_long_words_are_made_in_blocks(monkeypatch):
    whole = {k for b in spelling.Reduced(["abcdefghij" * 5], 4).neighbours(slice(None)) for k in b.ravel().tolist()}
    monkeypatch.setattr(spelling, "BLOCK", 10)
    assert whole == {k for b in spelling.Reduced(["abcdefghij" * 5], 4).neighbours(slice(None)) for k in b.ravel().tolist()}


def test_chains_end_in_their_root(spark):
    chain = [("w%02d" % i, "w%02d" % (i + 1)) for i in range(20)]
    got = {r.word: r.root for r in spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {w: "w20" for w, _ in chain}


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "Garden garden GARDEN gardén gardén gardén Ärger ärger"), (3, "Garden garden GARDEN"), (None, "garden gardens gardens gardens"),
            (5, "x" * 50_000 + " 123 ×÷×÷× ×÷×÷× ×÷×÷×"), (6, " ".join(["gardin"] * 4_000))]
    docs = spark.createDataFrame([(d, t, 1, "w", "k") for d, t in rows], "doc_id bigint, text string, n int, word string, key string")
    got = as_dict(spelling.variants(spelling.count_words(docs)))
    assert got == brute_variants(brute_counts(rows))
    assert got["garden"][0] == "gardin" and got["gardens"][1] == "gardin"
    assert spelling.variants(spelling.count_words(docs.limit(0))).count() == 0
    twice = spark.createDataFrame([("about", 2), ("about", 2), (None, 9), ("", 9)], "word string, n bigint")
    assert as_dict(spelling.variants(twice)) == {"about": (None, "about", 4, 0, None)}


def test_words_are_counted_in_bounded_parts(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"alpha beta{'x' * (i % 9)} gamma") for i in range(60)], "doc_id bigint, text string").coalesce(1)
    whole = {r.word: r.n for r in spelling.count_words(docs).collect()}
    assert whole == brute_counts([(r.doc_id, r.text) for r in docs.collect()])
    assert docs.select(F.count("*")).first()[0] == 60
