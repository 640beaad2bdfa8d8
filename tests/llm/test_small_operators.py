"""Token counts, token files, decontamination, language ID and mixing against brute force, with awkward rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from copperline.llm import bytesplit, decontam, idfiles, langid, mixing, tokens
from copperline.llm.queries import tokenizer_file

AWKWARD = [None, "", " ", "\n\n a\t b ", "don't  stop's 'S x'll", "é à ï ÷ ×, ß. x y　z \u0085 q", "<|endoftext|> a<|endoftext|>b ,<|endoftext|>", "a" * 9000 + " b", "x,y.z;w:!?", "日本語 テキスト、 。", "1 2  3   4\r\n5", "tab\tand\x1cfs \x1f x", "👍🏽 ok", "end ", " start", "A'b 'c. d'"]


def texts(seed=1, n=60):
    rng = random.Random(seed)
    letters = "abcdefghijklmnopéèàñß'.,;:!? \n\t0123456789ABC-_() "
    return AWKWARD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 300))) for _ in range(n)]


def docs_of(spark, rows):
    """A table with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", 1, 2, "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_words long, start long, row string")


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts(spark, name):
    rows = list(enumerate(texts()))
    path = tokenizer_file(name)
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.token_counts(docs_of(spark, rows), path, max_tokens=50).collect()}
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        count = lambda x: len(t.encode(x, add_special_tokens=False).ids)
    else:
        import sentencepiece

        t = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda x: len(t.encode(x))
    for i, x in rows:
        n = count(x or "")
        assert got[i] == (len((x or "").encode()), n, n > 50), repr(x)


def test_cache_of_the_encoder_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_PIECES", 50)
    from tokenizers import Tokenizer

    path = tokenizer_file()
    encoder, library = tokens.Encoder(path), Tokenizer.from_file(path)
    for seed in range(6):
        batch = [t or "" for t in texts(seed, 20)]
        raw = [b.encode() for b in batch]
        offsets = np.concatenate([[0], np.cumsum([len(b) for b in raw])])
        ids, lens = encoder.encoded(np.frombuffer(b"".join(raw), np.uint8), offsets)
        assert ids.tolist() == [x for b in batch for x in library.encode(b, add_special_tokens=False).ids]
        assert lens.tolist() == [len(library.encode(b, add_special_tokens=False).ids) for b in batch]


@pytest.mark.parametrize("kind", [idfiles.BIT_PLANES, idfiles.BYTE_PLANES])
def test_token_files_round_trip(spark, kind):
    from tokenizers import Tokenizer

    rows = list(enumerate(texts())) + [(3, "same id"), (3, "same id"), (None, "no id")]
    random.Random(4).shuffle(rows)
    path = tokenizer_file()
    manifest = idfiles.write_ids(docs_of(spark, rows), path, kind=kind, block=100, file_ids=500)
    got = idfiles.read_ids(manifest, with_ids=True).collect()
    assert manifest.count() > 4 and len(got) == len(rows)
    library, at = Tokenizer.from_file(path), 0
    expected = sorted(((i is not None, i or 0, (t or "")) for i, t in rows), key=lambda r: (r[0], r[1], r[2].encode()))
    for (known, i, t), r in zip(expected, sorted(got, key=lambda r: r.start), strict=True):
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) == (i if known else None, at, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes())
        at += len(ids)
    assert idfiles.read_ids(idfiles.write_ids(docs_of(spark, []), path)).count() == 0


def test_planes_are_transposed_blocks():
    ids = np.array([0, 1, 2, 50256, 2**32 - 1, 7, 7, 7, 9], np.uint32)
    for kind in (1, 2):
        planes = idfiles.to_planes(ids, kind)
        assert len(planes) == (32 if kind == 1 else 4) and (idfiles.from_planes(planes, len(ids), kind) == ids).all()
    assert len(idfiles.to_planes(np.array([50256], np.uint32), 1)) == 16 and len(idfiles.to_planes(np.zeros(3, np.uint32), 1)) == 1


def test_damaged_id_file(tmp_path):
    import pyarrow as pa

    out = pa.BufferOutputStream()
    writer = idfiles.FileWriter(out, block=10)
    writer.add(np.array([1]), np.array([False]), np.array([25]), np.arange(25, dtype=np.uint32) * 1000)
    size = writer.close()
    data = bytearray(out.getvalue().to_pybytes())
    assert len(data) == size

    class Source:
        def read_at(self, n, at):
            return bytes(data[at : at + n])

    reader = idfiles.FileReader(Source(), size)
    assert [x for _, _, pieces in reader.documents() for p in pieces for x in p.tolist()] == [k * 1000 for k in range(25)]
    data[9] ^= 255
    with pytest.raises(Exception):  # noqa: B017
        idfiles.FileReader(Source(), size).chunk(0)
    with pytest.raises(ValueError, match="whole"):
        idfiles.FileReader(Source(), size - 1)


def words_of(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute_contamination(rows, items, window=10):
    out = {}
    for i, t in rows:
        w, hit, owners = words_of(t), set(), set()
        for item, x in items:
            q = words_of(x)
            for s in range(max(len(q) - window, 0) + 1) if q and item is not None else ():
                g = q[s : s + window]
                for p in range(len(w) - len(g) + 1):
                    if w[p : p + len(g)] == g:
                        hit.update(range(p, p + len(g)))
                        owners.add(str(item))
        out[i] = (len(w), len(hit), len(owners), hashlib.sha256(",".join(sorted(owners)).encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("size", [1 << 20, 200])
def test_decontamination(spark, size):
    rng = random.Random(9)
    word = lambda: rng.choice(["Alpha", "beta", "é", "Γ", "x1", "of", "日本"])
    items = [(k, rng.choice([" ", ", ", "-"]).join(word() for _ in range(rng.choice([3, 9, 10, 11, 25])))) for k in range(12)] + [(20, None), (21, " .,! "), (None, "alpha beta"), (0, "of of of beta")]
    rows = [(k, " ".join(word() for _ in range(rng.randint(0, 60))) + f" {items[k % 12][1].upper() if k % 3 == 0 else ''} " + word()) for k in range(80)] + [(100, None), (101, ""), (102, "!!"), (103, items[2][1]), (103, items[2][1])]
    tests = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.decontaminate(docs_of(spark, rows), tests, automaton_bytes=size).collect()
    expected = brute_contamination(rows, items)
    assert len(got) == len(rows) and any(r.contaminated for r in got) and not all(r.contaminated for r in got)
    for r in got:
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == expected[r.doc_id]


@pytest.mark.parametrize("size", [1 << 20, 60])
def test_items_of_one_and_two_words(spark, size):
    rng = random.Random(4)
    word = lambda: f"w{rng.randint(0, 60)}"
    items = [(1, "w7"), (2, "W7 w8"), (3, "w8"), (4, "é"), (5, " ".join(word() for _ in range(30)))]
    rows = [(k, " ".join(word() for _ in range(rng.randint(0, 40)))) for k in range(60)] + [(60, "w7"), (61, "É é"), (62, "w7, w8"), (63, "w9 " + items[4][1]), (64, "w7w8")]
    got = decontam.decontaminate(docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string"), automaton_bytes=size).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got} == brute_contamination(rows, items)


def test_hit_bytes_point_into_the_original(spark):
    text = "É —  The QUICK,\n\nbrown fox! é"
    docs, tests = docs_of(spark, [(1, text)]), spark.createDataFrame([(1, "the quick brown fox")], "item_id long, text string")
    row = decontam.mark(docs, tests).first()
    assert [text.encode()[s.first : s.last + 1].decode() for s in row.bytes] == ["The QUICK,\n\nbrown fox"]
    assert not decontam.mark(docs, tests.limit(0)).first().spans


def test_language_model_probabilities_sum_to_one():
    model = langid.train({"a": [b"the cat sat on the mat", b"abc"], "b": ["für über".encode()]}, least_count=1)
    sums = np.exp2(-model.bits.astype(float)).sum(1)
    assert np.allclose(sums[:, :], 1, atol=0.2) and (sums < 1.0001).all()


def test_code_lengths_do_not_depend_on_batches():
    model = langid.train({"a": [b"some text here to learn from"] * 3, "b": [b"andere worte hier zum lernen"] * 3})
    raw = [b"some words", b"", "hier für".encode(), b"x" * 50]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in raw])])
    together = model.code_lengths(np.frombuffer(b"".join(raw), np.uint8), offsets)
    for k, b in enumerate(raw):
        assert np.allclose(model.code_lengths(np.frombuffer(b, np.uint8), np.array([0, len(b)])), together[k])


def test_language_id_on_held_out_rows(spark):
    import os

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("the supplied tables are not here")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in rows)


def test_languages_with_long_documents_only_are_learned(spark):
    short, long = "some text here to learn from ", "andere worte hier zum lernen " * 1200
    assert len(long) > langid.SAMPLE_CHARS
    rows = [(k, short, "a") for k in range(20)] + [(20 + k, long, "b") for k in range(20)] + [(50, "123", "c"), (51, "456", "c"), (52, "789", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert sorted(model.languages) == ["a", "b"]
    assert {r.lang_pred for r in langid.predict(docs.where("lang = 'b'"), model).collect()} == {"b"}
    assert {r.lang_pred for r in langid.identify(docs.where("lang = 'b'")).collect()} == {"b"}


def test_a_text_with_letters_at_its_end_only_is_learned_from_to_its_end(spark, monkeypatch):
    taken = {}
    monkeypatch.setattr(langid, "train", lambda samples: taken.update(samples))
    rows = [(0, "1" * 40_000 + "end of it", "en"), (1, "2" * 40_000, "de"), (3, "begin" + "3" * 40_000 + "middle" + "4" * 40_000, "fr")]
    langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(taken) == {"en", "fr"} and taken["en"][0].endswith(b"end of it") and taken["fr"][0].startswith(b"begin3")
    assert b"3" in taken["fr"][0] and taken["fr"][0].endswith(b"4" * 1024)
    assert all(len(t[0]) == langid.SAMPLE_CHARS for t in taken.values())


def test_extra_columns_of_any_name_and_repeated_rows_leave_predictions_alone(spark):
    rows = [(k, "some text here to learn from", "en") for k in range(8)] + [(8 + k, "andere worte hier zum lernen", "de") for k in range(8)]
    docs = spark.createDataFrame(rows + rows[:1] * 2, "doc_id long, text string, lang string")
    more = docs.selectExpr("*", "'x' AS lang_pred", "0.1 AS score", "7 AS held_out", "'h' AS hash", "3 AS part", "1 AS rank", "9 AS bits_per_byte")
    plain = sorted(langid.identify(docs).select("doc_id", "lang_pred", "score").collect())
    assert len(plain) == len(rows) + 2
    assert sorted(langid.identify(more).select("doc_id", "lang_pred", "score").collect()) == plain


def test_language_id_without_letters_or_labels(spark):
    rows = [(0, None, "en"), (1, "12 !?", "en"), (3, "some text", "en"), (4, "more text of it", None), (None, "text", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.held_out) for r in langid.identify(docs).collect()}
    assert got[0][0] == got[1][0] == "und" and got[4][0] == "en" and got[None] == ("en", False)
    assert {r.lang_pred for r in langid.identify(docs.selectExpr("doc_id", "text", "string(null) lang")).collect()} == {"und"}
    assert langid.identify(docs.limit(0)).count() == 0


def water_fill(sizes, weights=(1, 2, 3), cap=3):
    """Targets by repeated resharing of the excess."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * w[s] / sum(w[t] for t in rest) for s in rest}
        over = [s for s in rest if share[s] > cap * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: float(cap * sizes[s]) for s in over}


def mix_rows(seed):
    rng = random.Random(seed)
    size = lambda s: rng.randint(0, 900 if s == "big" else 40)
    rows = [(k, " \n".join(f"w{rng.randrange(50)}" for _ in range(size(s))), s) for k in range(260) for s in [rng.choice(["big", "big", "big", "a", "Ä", "z", None, "tiny"])] if s != "tiny" or k < 30]
    return rows + [(300, None, "a"), (301, "", "void"), (302, " \t", None), (5, "x y z", "a"), (5, "x y z", "a")]


def test_mix(spark):
    rows = mix_rows(1)
    docs = spark.createDataFrame([(i, t, s, 0, 0) for i, t, s in rows], "doc_id long, text string, source string, row long, size string")
    got = mixing.mix_report(docs).collect()
    assert len(got) == len(rows) and sorted(map(repr, got)) == sorted(map(repr, mixing.mix_report(docs.repartition(7)).collect()))
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    targets = water_fill(sizes)
    for s, target in targets.items():
        own = [r for r in got if r.source == s]
        assert all(r.source_size == sizes[s] and abs(r.target - target) < 1e-6 * max(1, target) and 0 <= r.taken <= 3 * r.size for r in own)
        assert abs(sum(r.taken for r in own) - target) < 1 + 1e-6
    assert mixing.mix_report(docs.limit(0)).count() == 0


def test_permutation_reaches_every_block(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 3, 17, 100):
        got = [r.p for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(99).cast("long")).alias("p")).collect()]
        assert sorted(got) == list(range(n))
    assert got != sorted(got)


def test_mixed_documents_hold_the_words_taken(spark):
    rows = [r for r in mix_rows(2) if r[0] not in (5,)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = {r.doc_id: r.taken for r in mixing.mix_report(docs).collect()}
    made = mixing.mixed_documents(docs, ["doc_id", "text", "source"]).collect()
    words, copies = {}, {}
    original = {i: (t or "").split() for i, t, _ in rows}
    for r in made:
        own = r.text.split()
        it = iter(original[r.doc_id])
        assert own and all(w in it for w in own)  # a subsequence
        words[r.doc_id] = words.get(r.doc_id, 0) + len(own)
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert words == {i: n for i, n in taken.items() if n} and max(copies.values()) <= 3


def test_words_and_hashes():
    raw = ["The  cat sat", "", "a", " b\x0bc ", "THE"]
    data = np.frombuffer("".join(raw).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in raw])])
    starts, ends, bounds = bytesplit.words(data, offsets)
    found = [data[a:b].tobytes().decode() for a, b in zip(starts, ends, strict=True)]
    assert found == ["The", "cat sat", "a", "b", "c", "THE"] and bounds.tolist() == [0, 2, 2, 3, 5, 6]
    hashes, _ = bytesplit.word_hashes(data, offsets)
    assert hashes[0] == hashes[5] and len(set(hashes.tolist())) == 5


def test_one_automaton_scans_long_texts_in_lanes():
    rng = random.Random(2)
    vocabulary = ["a", "b", "Ä", "d7", "of", "the", "x", "yy", "zz", "end"]
    items = [(str(k), " ".join(rng.choice(vocabulary) for _ in range(n))) for k, n in enumerate([2, 4, 9, 10, 11, 12, 30, 60, 0])]
    machine = decontam.Automaton.unpacked(decontam.Automaton.of(items, 10).packed())
    rows = [" ".join(rng.choice(vocabulary) for _ in range(n)) for n in (0, 1, 3, 2000, 40, 700)]
    for k, at in ((7, 3), (6, 5), (5, 4)):
        own = rows[at].split()
        own[250:250] = items[k][1].upper().split()
        rows[at] = ", ".join(own)
    raw = [t.encode() for t in rows]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in raw])])
    n_words, hits, met = machine.scan(np.frombuffer(b"".join(raw), np.uint8), offsets)
    expected = brute_contamination(list(enumerate(rows)), items)
    for d, t in enumerate(rows):
        spans = decontam.merged(hits[hits[:, 0] == d, 1:]) if (hits[:, 0] == d).any() else []
        owners = sorted(str(machine.items[i]) for i in met[met[:, 0] == d, 1])
        assert (n_words[d], sum(b - a + 1 for a, b, _, _ in spans), len(owners), hashlib.sha256(",".join(owners).encode()).hexdigest(), bool(spans)) == expected[d]
        for a, b, first, last in spans:
            assert words_of(raw[d][first:last].decode()) == words_of(t)[a : b + 1]


def test_a_large_benchmark_takes_one_scan_of_the_documents(spark, monkeypatch):
    monkeypatch.setattr(decontam, "GROUP_BYTES", 2000)
    rng = random.Random(3)
    items = [(k, " ".join(f"w{rng.randint(0, 3000)}" for _ in range(40))) for k in range(300)]
    rows = [(k, " ".join(f"w{rng.randint(0, 3000)}" for _ in range(50)) + (" " + items[k][1] if k % 5 == 0 else "")) for k in range(60)]
    made = decontam.decontaminate(docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string"), automaton_bytes=4000)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan
    expected = brute_contamination(rows, items)
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in made.collect()} == expected


def ppm_bits(samples, text, symbol, n_symbols, order=3, least=2):
    """Code length of a text under each language by plain prediction by partial matching, method C with exclusion."""
    trees, seen = {}, {}
    for name, texts in samples.items():
        trees[name] = {}
        for t in texts:
            own = [0] * order + [symbol[b] for b in t]
            for i in range(order, len(own)):
                for k in range(order + 1):
                    context = tuple(own[i - k : i])
                    node = trees[name].setdefault(context, {})
                    node[own[i]] = node.get(own[i], 0) + 1
        for context, node in trees[name].items():
            seen[context] = max(seen.get(context, 0), sum(node.values()))

    def chance(tree, context, x):
        if context and seen.get(context, 0) < least:
            return chance(tree, context[1:], x)
        node = tree.get(context, {})
        lower = (lambda y: chance(tree, context[1:], y)) if context else (lambda y: 1 / n_symbols)
        total, kinds = sum(node.values()), len(node)
        if not total:
            return lower(x)
        if x in node:
            return node[x] / (total + kinds)
        return kinds / (total + kinds) * lower(x) / (1 - sum(lower(y) for y in node))

    own = [0] * order + [symbol[b] for b in text]
    return [-sum(np.log2(chance(trees[name], tuple(own[i - order : i]), own[i])) for i in range(order, len(own))) for name in sorted(samples)]


def test_code_lengths_are_exact(monkeypatch):
    samples = {"a": [b"the cat sat on the mat, the hat", "ünder thé".encode()], "b": ["für über alle matten".encode(), b"der hat"], "c": [b"x"]}
    model = langid.train(samples)
    rows = [b"the matter, Over there", "ça für 12".encode(), b"", b"z", b"a b", b"qqq the the"]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in rows])])
    symbols = model.bits.shape[1]
    expected = [ppm_bits(samples, t, model.symbol.tolist(), symbols) for t in rows]
    for chunk in (langid.CHUNK, 5, 2, 1):
        monkeypatch.setattr(langid, "CHUNK", chunk)
        assert np.allclose(model.code_lengths(np.frombuffer(b"".join(rows), np.uint8), offsets), expected, rtol=1e-5, atol=1e-5)


def test_pieces_of_equal_hash_are_told_apart(monkeypatch):
    weak = bytesplit.hash_pieces
    monkeypatch.setattr(bytesplit, "hash_pieces", lambda *a: weak(*a) % np.uint64(7))
    encode, _ = tokens.library(tokenizer_file())
    texts = [t for t in AWKWARD if t] + ["w" * 5000 + " end", "the cat sat on the mat the tac", ""]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in raw])])
    expected = encode(texts)
    own = tokens.Encoder(tokenizer_file())
    for _ in range(2):
        ids, lens = own.encoded(np.frombuffer(b"".join(raw), np.uint8), offsets)
        assert lens.tolist() == [len(x) for x in expected] and ids.tolist() == [x for e in expected for x in e]


def test_code_lengths_are_exact_with_many_symbols_and_languages():
    letters = ["".join(chr(c) for c in range(lo, lo + 30)) for lo in (0x61, 0xC0, 0x391, 0x410, 0x5D0, 0x905, 0xE01, 0x10D0)]
    rng = np.random.Generator(np.random.PCG64(5))
    text = lambda k: "".join(rng.choice(list(letters[k] + "  "), 300)).encode()
    samples = {f"l{k}": [text(k), text(k)] for k in range(len(letters))}
    model = langid.train(samples)
    assert model.width > 64 and model.marks.shape[1] == 2
    rows = [t[:60] for k in range(len(letters)) for t in (text(k),)] + [b"mixed " + text(3)[:20] + text(6)[:20]]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in rows])])
    expected = [ppm_bits(samples, t, model.symbol.tolist(), model.width) for t in rows]
    assert np.allclose(model.code_lengths(np.frombuffer(b"".join(rows), np.uint8), offsets), expected, rtol=1e-5, atol=1e-4)
    held = sum(v.nbytes for v in (model.pairs, model.escape, model.marks, model.before))
    assert held < len(model.escape) * model.width * len(samples) * 4 / 10  # a tenth of the full table


def test_training_takes_one_of_equal_rows_and_a_part_of_long_ones(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_CHARS", 50)
    taken = {}
    monkeypatch.setattr(langid, "train", lambda samples: taken.update(samples))
    rows = [(1, "same text", "en")] * 300 + [(k, f"text {k} " + "é" * 500, "fr") for k in range(40)] + [(1, "other text", "en"), (3, None, "de"), (5, "1 2 3", "de"), (None, "x", "de")]
    langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_docs=10)
    assert taken["en"] == [b"other text", b"same text"] and set(taken) == {"en", "fr"}
    assert len(taken["fr"]) == 10 and all(len(t.decode()) == 50 for t in taken["fr"])


def test_long_texts_are_encoded_in_parts(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(bytesplit, "SPAN_BYTES", 64)
    path = tokenizer_file()
    encoder, library = tokens.Encoder(path), Tokenizer.from_file(path)
    for t in [" ".join(t for t in texts(7) if t), "x" * 500, "word " * 200 + "é" * 300 + ", end"]:
        raw = np.frombuffer(t.encode(), np.uint8)
        expected = library.encode(t, add_special_tokens=False).ids
        ids, lens = encoder.encoded(raw, np.array([0, len(raw)]))
        assert ids.tolist() == expected and lens.tolist() == encoder.counts(raw, np.array([0, len(raw)])).tolist() == [len(expected)]


def test_files_dealt_otherwise_give_the_same_rows(spark):
    """Rows of one id whose texts begin alike are ordered by all of their text."""
    path = tokenizer_file()
    rows = [(7, "the same beginning " * 8 + f"and end {i}") for i in range(60)] + [(7, None), (7, None), (3, "x")]
    first = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    second = spark.createDataFrame(rows[::-1], "doc_id long, text string").repartition(7)
    one, two = ([tuple(r) for r in idfiles.read_ids(idfiles.write_ids(d, path)).orderBy("start").collect()] for d in (first, second))
    assert one == two and len(one) == len(rows)
