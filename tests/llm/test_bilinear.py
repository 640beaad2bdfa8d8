"""The language model against plain probabilities, its gradient against differences, its scores against the base."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from copperline.llm import bilinear, bytesplit

TRAINING = "crc32(cast(cast(doc_id AS string) AS binary)) % 7 <> 2"
COLUMNS = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def words_of(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()


def plain_base(rows):
    """The contract's columns but the model's score."""
    held = {i: None if i is None else zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    counts = Counter(w for i, t in rows if held[i] is False for w in [*words_of(t), None])
    total, kinds = sum(counts.values()), len(counts)
    out = []
    for i, t in rows:
        tokens = [*words_of(t), None]
        out.append((i, held[i], len(tokens), sum(counts[w] > 0 for w in tokens), total, sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in tokens)))
    return out


def near(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-6))


@pytest.fixture
def some(monkeypatch):
    monkeypatch.setattr(bilinear, "HEAD", 300)  # so that other words go through the join
    rng = np.random.default_rng(1)
    nouns = [[f"{a}{n}{e}" for n in range(200)] for a, e in (("b", "en"), ("c", "os"), ("d", "ly"))]
    rows = [(i, " ".join(rng.choice(nouns[i % 3], rng.integers(0, 60), p=np.arange(200, 0, -1) / 20100))) for i in range(500)]
    return rows + [(500, None), (501, ""), (502, " \t "), (503, "Ünïcode Äö B1EN b1en " + "neverseen" * 3), (None, "b1en b2en"), (7, "b1en"), (7, "b1en"), (504, "x")]


def test_columns_of_the_base(spark, some):
    docs = spark.createDataFrame(some, "doc_id long, text string").withColumns({"hash": F.lit("x"), "score": F.lit(1), "n": F.lit(None).cast("int"), "row": F.lit(2)}).repartition(3)
    got = bilinear.score_texts(docs, TRAINING)
    assert got.columns == COLUMNS
    rows = got.collect()
    for a, b in zip(sorted((tuple(r)[:6] for r in rows), key=repr), sorted(plain_base(some), key=repr), strict=True):
        assert all(near(x, y) for x, y in zip(a, b, strict=True)), (a, b)
    assert all(math.isfinite(r.score) and r.score <= 0 for r in rows)
    held = [r for r in rows if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)


def fitted(spark, some):
    learned = spark.createDataFrame([r for r in some if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 != 2], "doc_id long, text string").coalesce(1)
    counts = bilinear.word_counts(learned).cache()
    return counts, bilinear.fit(counts, learned)


def test_scores_are_sums_of_normalised_probabilities(spark, some, monkeypatch):
    counts, (known, model) = fitted(spark, some)
    everything = {r.hash: (r.ending, r.c) for r in counts.collect()}
    head = dict(zip(known.hashes.tolist(), known.classes.tolist(), strict=True))
    assert len(head) < len(everything)

    def of_class(h, ending):
        return head[h] if h in head else bilinear.WORDS + int(known.groups[ending])

    inside = {}  # of each class, the probabilities of all that can be said with it
    for h, (ending, c) in everything.items():
        k = of_class(h, ending)
        inside.setdefault(k, []).append(1.0 if k < bilinear.WORDS or k == bilinear.END else (c - known.discount) / known.group_tokens[k - bilinear.WORDS])
    for g in range(bilinear.GROUPS):
        inside.setdefault(bilinear.WORDS + g, []).append(10 ** known.unknown[g])
    for k, shares in inside.items():
        assert math.isclose(sum(shares), 1, rel_tol=1e-9), k

    def class_shares(before):
        v = sum(model.R[h].astype(float) * model.C[i] for i, h in enumerate(before))
        scores = np.exp(model.Q.astype(float) @ v + model.b)
        return scores / scores.sum()

    monkeypatch.setattr(bilinear, "fit", lambda *_: (known, model))
    docs = spark.createDataFrame(some, "doc_id long, text string")
    got = sorted(((r.doc_id, r.score) for r in bilinear.score_texts(docs, TRAINING).collect()), key=repr)
    wanted = []
    for i, text in some:
        words = bilinear.Texts.of(*bytesplit.text_buffer(spark.createDataFrame([(text,)], "t string").toArrow().column("t"))) if len(wanted) < 40 or i is None or i > 499 else None
        if words is None:
            continue
        before, total = [bilinear.END] * bilinear.ORDER, 0.0
        for h, ending in zip(words.hashes.tolist(), words.endings.tolist(), strict=True):
            k = of_class(h, ending)
            total += math.log10(class_shares(before)[k])
            if k >= bilinear.WORDS:
                g = k - bilinear.WORDS
                total += math.log10((everything[h][1] - known.discount) / known.group_tokens[g]) if h in everything else known.unknown[g]
            before = [k, *before[:-1]]
        wanted.append((i, total + math.log10(class_shares(before)[bilinear.END])))
    for i, score in wanted:
        assert any(a == i and math.isclose(b, score, rel_tol=1e-5, abs_tol=1e-4) for a, b in got), (i, score)


def test_gradient_is_that_of_the_objective():
    rng = np.random.default_rng(2)
    frequencies = rng.integers(1, 50, bilinear.CLASSES).astype(float)
    model = bilinear.Model(rng.standard_normal(bilinear.Model.size()) * 0.3)
    trainer = bilinear.Trainer(model, frequencies, 0.1, 1)
    trainer.odds = trainer.odds.astype(np.float64)
    context, classes = rng.integers(0, bilinear.CLASSES, (bilinear.ORDER, 30)), rng.integers(0, bilinear.CLASSES, 30)
    context[:, :10], drawn = context[:1, :10], np.array([3, 3, 7, 250])

    def objective():
        v = sum(model.R[context[i]] * model.C[i] for i in range(bilinear.ORDER))
        sure = (v * model.Q[classes]).sum(1) + model.b[classes] - trainer.odds[classes]
        false = v @ model.Q[drawn].T + model.b[drawn] - trainer.odds[drawn]
        return (-np.log1p(np.exp(-sure)) - np.log1p(np.exp(false)).sum(1)).mean()

    gradient = trainer.gradient(context, classes, drawn)
    for place in [*rng.integers(0, bilinear.Model.size(), 60).tolist(), *np.argsort(-np.abs(gradient))[:40].tolist()]:
        was = model.flat[place]
        model.flat[place] = was + 1e-5
        up = objective()
        model.flat[place] = was - 1e-5
        slope = (up - objective()) / 2e-5
        model.flat[place] = was
        assert abs(slope - gradient[place]) < 1e-4 * max(1, abs(slope)), place


def test_large_scores_do_not_overflow():
    model = bilinear.Model(np.random.default_rng(3).standard_normal(bilinear.Model.size()).astype(np.float32) * 9)
    context, classes = np.zeros((bilinear.ORDER, 300), np.uint8), np.arange(300).astype(np.uint8)
    logs = model.log_probabilities(context, classes)
    assert np.isfinite(logs).all() and abs(np.exp(logs[:256]).sum() - 1) < 1e-4


@pytest.mark.parametrize("span", [7, 1 << 19])
def test_contexts_start_anew_with_each_text(monkeypatch, span):
    monkeypatch.setattr(bytesplit, "SPAN_BYTES", span)
    import pyarrow as pa

    data, offsets = bytesplit.text_buffer(pa.array(["one two three four", None, "Two", "a  bb"]))
    words = bilinear.Texts.of(data, offsets)
    assert words.endings.tolist() == [int.from_bytes(w[-2:]) for w in (b"ne", b"wo", b"ee", b"ur", b"wo", b"a", b"bb")]
    assert words.hashes[1] == words.hashes[4]
    classes, firsts = words.sequence(np.array([1, 2, 3, 4, 2, 5, 6], np.uint8))
    e = bilinear.END
    assert classes.tolist() == [1, 2, 3, 4, e, e, 2, e, 5, 6, e] and firsts.tolist() == [0, 5, 6, 8]
    assert bilinear.contexts(classes, firsts).tolist() == [[e, 1, 2, 3, 4, e, e, 2, e, 5, 6], [e, e, 1, 2, 3, e, e, e, e, e, 5], [e, e, e, 1, 2, e, e, e, e, e, e]]


def test_no_rows_and_no_training(spark):
    assert bilinear.score_texts(spark.createDataFrame([], "doc_id long, text string"), TRAINING).collect() == []
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = bilinear.score_texts(spark.createDataFrame([(held, "never learned")], "doc_id long, text string"), TRAINING).first()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (True, 3, 0, 0, 0.0)
    assert math.isclose(row.score, 3 * math.log10(1 / bilinear.CLASSES), rel_tol=0.3)


def test_query_at_the_smallest_size(spark):
    rows = __spark_entry__.queries()["op11_lm_scoring"](spark, "/root/testdata/sf0.001").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 200 and sum(r.score for r in held) > 0.9 * sum(r.base_score for r in held)  # both are negative
    texts = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for a, b in zip(sorted(tuple(r)[:6] for r in rows), sorted(plain_base(texts)), strict=True):
        assert all(near(x, y) for x, y in zip(a, b, strict=True)), (a, b)
