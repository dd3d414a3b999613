"""run() of the pipeline against plain versions of its stages on planted documents."""

import pickle
import random
import re
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

import corpus_pipeline
from ledgersight.llm import bag_minhash, toxicity
from tests.llm.test_operators import classes_by_force, plain_spans

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def planted():
    draw = random.Random(11)
    words = [f"{a}{b}{c}" for a in ("bal", "mor", "ten", "sil", "gar") for b in "aeiou" for c in ("n", "m", "rd", "st")]
    nasty = ["zqxhate", "zqxkill", "zqxscum", "zqxvile"]

    def line(n=14):
        return " ".join(draw.choice(words) for _ in range(n))

    docs = {i: "\n".join(line() for _ in range(5)) for i in range(120)}
    labels = [(i, 0) for i in range(120)]
    for i in range(200, 260):
        docs[i] = " ".join(draw.choice(nasty) if k % 2 else draw.choice(words) for k in range(40))
        labels.append((i, 1))
    shared = line()
    for i in (3, 7, 11):
        docs[i] += "\n" + shared
    whole = line(200)
    docs |= {300: whole, 301: whole + " " + line(3), 302: "write to anna7@mail.org or 10.0.0.1 " + line(), 303: None, 304: "", 305: line(5_000)}
    return docs, labels


def plain_stages(docs, toxic):
    """doc_id -> text after the first four stages."""
    kept = {i: t or "" for i, t in docs.items() if i not in toxic}
    key = lambda x: re.sub(r"[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\v\f\r"))
    holders = defaultdict(set)
    for i, t in kept.items():
        for x in t.split("\n"):
            holders[key(x)].add(i)
    kept = {i: "\n".join(x for x in t.split("\n") if len(key(x)) < 10 or min(holders[key(x)]) == i) for i, t in kept.items()}
    of = classes_by_force(kept)
    kept = {i: t for i, t in kept.items() if of[i] == i}        # texts without words are copies of nothing
    out = {}
    for i, t in kept.items():
        parts, at = [], 0
        for kind, a, b in plain_spans(t):
            parts += [t[at:a], f"[{kind}]"] if a >= at else []
            at = max(at, b)
        out[i] = "".join(parts) + t[at:]
    return out


def test_run_equals_plain_stages(spark, tmp_path):
    docs, labels = planted()
    rows = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs.items()], DOCS)
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    table = spark.createDataFrame([(i, 3, t) for i, t in labels], "doc_id bigint, quality int, toxic int")
    table.write.parquet(str(tmp_path / "labels.parquet"))
    toxic = {r.doc_id for r in toxicity.score(rows, toxicity.fit(rows, table)).where("score >= 0.7").collect()}
    assert toxic == set(range(200, 260))
    want = plain_stages(docs, toxic)
    assert 301 not in want and "[email]" in want[302] and "[ip]" in want[302]

    got, places = defaultdict(list), defaultdict(list)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    assert set(got) == set(want)
    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    for i, text in want.items():
        ids, at = [*tokenizer.encode(text, add_special_tokens=False).ids, 0], 0
        for r in sorted(got[i], key=lambda r: r.piece):
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in places.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048


def test_toxicity_model_is_small_and_exact():
    draw = random.Random(5)
    signs = "abcdefghijklmnop\u00e9\u4e00\U0001f600"
    values = {"".join(draw.choice(signs) for _ in range(draw.randint(1, toxicity.ORDER))): draw.random() for _ in range(50_000)}
    seen, new = ({k: v for k, v in values.items() if (len(k) > 3) == c} for c in (True, False))
    stored = pickle.dumps(toxicity.Model(seen, new))
    tracemalloc.start()
    model = pickle.loads(stored)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 40 * len(values)
    words = ["".join(draw.choice(signs + "z") for _ in range(draw.randint(1, 9))) for _ in range(3_000)]
    want = {}
    for w in words:
        want[w] = 0.0
        for context, sign in toxicity.sequences(w):
            want[w] += seen.get(context + sign, new.get(context, 0.0))
    assert model.evidence([*dict.fromkeys(words)]) == want == model.words


def test_toxic_texts_pass_python_once(spark):
    docs = spark.createDataFrame([(1, "zqxhate zqxhate", "en"), (2, None, "en"), (3, "fine", "en")], "doc_id bigint, text string, lang string")
    model = toxicity.Model({"^zqx": 9.0}, {"^": 0.0})
    kept = toxicity.drop_toxic(docs, (model, np.array([-1.0, 0.0, 1.0, 1.0])))
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(2, None), (3, "fine")] and kept.columns == docs.columns
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "coalesce(text" not in plan


def test_word_hashes_do_not_stay_with_a_worker(spark):
    rows = spark.createDataFrame([(1, 1, "one two three four five six seven")], "id bigint, h bigint, text string").coalesce(1)
    assert len(bag_minhash.signatures(rows).collect()) == 1

    def kept(batches):
        for batch in batches:
            yield pa.record_batch({"n": pa.array([len(bag_minhash._word_hashes())] * batch.num_rows, pa.int64())})

    assert [r.n for r in spark.range(8).repartition(8).mapInArrow(kept, "n bigint").collect()] == [0] * 8
