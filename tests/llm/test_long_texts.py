"""Texts beyond what the operators work on at once, and the mixture's draw, against plain versions."""

import random

import numpy as np
import pytest
import xxhash

from copperline.llm import bytesplit, decontam, langid, mixing, ngram_join, suffix_dedup

LETTERS = "abcdefghij"


def long_pair():
    """(two long texts that share a passage of 300 words, one of the first with few words changed, an item of its end)."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice(LETTERS) for _ in range(rng.randint(3, 9)))
    one, two = [[word() for _ in range(110_000)] for _ in range(2)]
    two[90_000:90_300] = one[70_000:70_300]
    near = list(one)
    for at in range(50, len(near), 200):
        near[at] = word()
    return one, two, near, one[-40:-20]


@pytest.fixture(scope="module")
def texts():
    return long_pair()


def shingles(words, k):
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def test_long_texts_join(spark, texts):
    one, two, near, _ = texts
    rows = [(1, " ".join(one)), (2, " ".join(two)), (3, " ".join(near)), (4, " ".join(one).upper())]
    assert min(len(t) for _, t in rows) > bytesplit.SPAN_BYTES
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()}
    sets = {1: shingles(one, 3), 2: shingles(two, 3), 3: shingles(near, 3)}
    assert 100 * len(sets[1] & sets[3]) >= 90 * len(sets[1] | sets[3])
    assert got == {1: (len(sets[1]), 1), 2: (len(sets[2]), 2), 3: (len(sets[3]), 1), 4: (len(sets[1]), 1)}


def test_long_texts_share_a_passage(spark, texts):
    one, two, _, _ = texts
    docs = spark.createDataFrame([(1, " ".join(one)), (2, " ".join(two))], "doc_id long, text string")
    got = {(r.doc_id, r.first_word, r.last_word) for r in suffix_dedup.repeated_spans(docs).collect()}
    assert got == {(1, 70_000, 70_300), (2, 90_000, 90_300)}


def test_a_benchmark_at_the_end_of_a_long_text(spark, texts):
    one, two, _, item = texts
    docs = spark.createDataFrame([(1, " ".join(one)), (2, " ".join(two))], "doc_id long, text string")
    items = spark.createDataFrame([("q", " ".join(item).upper())], "item_id string, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.contaminated) for r in decontam.decontaminate(docs, items).collect()}
    assert got == {1: (len(one), len(item), True), 2: (len(two), 0, False)}


def test_language_of_a_long_text(spark):
    rows = [(k, "some text here to learn from", "en") for k in range(8)] + [(8 + k, "andere worte hier zum lernen", "de") for k in range(8)]
    docs = spark.createDataFrame([*rows, (40, "1 2 3 " * 50 + "worte zum lernen andere " * 30_000, None)], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs).where("doc_id = 40").collect()}
    assert got[40][0] == "de" and got[40][1] > 0.9


@pytest.mark.parametrize("span", [1, 7, 64])
def test_words_and_their_hashes_do_not_depend_on_the_parts_of_a_text(monkeypatch, span):
    rng = random.Random(span)
    raw = ["".join(rng.choice("abé \n\tXYZ中") for _ in range(n)).encode() for n in (0, 1, 5, 40, 300, 2000)]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in raw])])
    whole = [*bytesplit.words(data, offsets), *bytesplit.word_hashes(data, offsets)]
    monkeypatch.setattr(bytesplit, "SPAN_BYTES", span)
    parts = [*bytesplit.words(data, offsets), *bytesplit.word_hashes(data, offsets)]
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(whole, parts, strict=True))
    sets = list(ngram_join.shingle_sets(data, offsets, 3))
    monkeypatch.undo()
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(sets, ngram_join.shingle_sets(data, offsets, 3), strict=True))


def spark_hash(*values):
    """Spark's xxhash64 of longs, (int,) tuples for ints and strings; nulls pass."""
    seed = 42
    for v in values:
        if v is not None:
            raw = v.encode() if isinstance(v, str) else v[0].to_bytes(4, "little", signed=True) if isinstance(v, tuple) else v.to_bytes(8, "little", signed=True)
            seed = xxhash.xxh64_intdigest(raw, seed=seed)
    return seed - (1 << 64) if seed >> 63 else seed


def plain_permuted(x, n, key):
    for i in range(mixing.ROUNDS):
        other = (spark_hash(key, (i,)) % n - x) % n
        if spark_hash(key, (i,), max(x, other), (1,)) & 1:
            x = other
    return x


def plain_draw(rows, plans, block, seed):
    """(sorted (doc_id, size, taken), {(skey, shard): slots}) of rows (doc_id, text, source), drawn slot by slot."""
    taken, shards = [], {}
    for p in plans:
        own = sorted((r for r in rows if ("t" if r[2] is None else "s" + r[2]) == p.skey), key=lambda r: (r[0], spark_hash(r[1])))
        spans, at = [], 0
        for i, t, _ in own:
            spans.append((i, at, at + len((t or "").split())))
            at = spans[-1][2]
        cover = [0] * at  # how often each word of the stream is taken
        take, full = int(p.target), at // block
        blocks = -(-at // block)
        slot = 0
        while take and sum(cover) < take:
            epoch, place = divmod(slot, blocks)
            b = plain_permuted(place, full, spark_hash((seed,), p.skey, epoch)) if place < full else full
            for w in range(b * block, min(b * block + block, at)):
                if sum(cover) == take:
                    break
                cover[w] += 1
            shard = (p.skey, spark_hash((seed,), p.skey, slot) % p.n_shards)
            shards[shard] = shards.get(shard, 0) + 1
            slot += 1
        taken += [(i, b - a, sum(cover[a:b])) for i, a, b in spans]
    return sorted(taken), shards


def test_every_document_takes_what_a_plain_draw_gives(spark):
    rng = random.Random(4)
    size = {"big": 90, "a": 30, "Ä": 9, None: 25, "tiny": 2}
    rows = [(k, " ".join(f"w{rng.randrange(9)}" for _ in range(rng.randint(0, size[s]))), s) for k in range(90) for s in [rng.choice(["big", "big", "a", "Ä", None] + ["tiny"] * (k < 20))]]
    rows += [(200, None, "a"), (201, "", "void"), (7, "x y z", "a"), (7, "x y z", "a"), (7, "z y", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    options = {"block": 16, "shard_words": 300}
    made = mixing.mix(docs, **options)
    plans = made.plans.collect()
    assert plans[0].n_shards > 2
    taken, shards = plain_draw(rows, plans, 16, mixing.SEED)
    report = mixing.mix_report(docs, **options).collect()
    assert sorted((r.doc_id, r.size, r.taken) for r in report) == taken and any(t > s for _, s, t in taken)
    found = mixing.slots(made.plans, 16).groupBy("skey", "shard").count().collect()
    assert {(r.skey, r.shard): r["count"] for r in found} == shards
