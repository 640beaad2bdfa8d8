"""Suffix-array dedup, nearest neighbours and chat repair against brute force."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from copperline.llm import ann, bytesplit, chat, suffix_dedup


def covered(rows, least):
    """(doc, word) pairs in a run of ``least`` words that another document has too."""
    words, seen = {}, {}
    for i, t in rows:
        if i is not None:
            words.setdefault(i, []).append((t or "").encode().lower().split())
    for i, lists in words.items():
        for w in lists:
            for k in range(len(w) - least + 1):
                seen.setdefault(tuple(w[k : k + least]), set()).add(i)
    return {(i, p) for i, lists in words.items() for w in lists for k in range(len(w) - least + 1) if len(seen[tuple(w[k : k + least])]) > 1 for p in range(k, k + least)}


def passages(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    shared = [[word() for _ in range(n)] for n in (50, 55, 70, 130, 49, 20)]
    rows = []
    for k in range(150):
        w = [word() for _ in range(rng.randint(0, 150))]
        for s in rng.sample(shared, rng.choice([0, 0, 1, 2])):
            at = rng.randint(0, len(w))
            w[at:at] = s
        rows.append((k, " ".join(w)))
    rows += [(200 + k, rows[3][1].upper()) for k in range(25)] + [(300, " ".join(["to"] * 400)), (301, " ".join(["to"] * 90)), (302, " ".join(["of"] * 300))]
    return rows + [(400, None), (401, ""), (None, rows[3][1]), (402, "solo " + " ".join(map(str, range(60))) + " again " + " ".join(map(str, range(60)))), (403, rows[5][1]), (403, rows[5][1])]


@pytest.mark.parametrize("chunk", [8192, 16])
def test_repeated_spans(spark, monkeypatch, chunk):
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    rows = passages(chunk)
    df = spark.createDataFrame([(i, t, 0, "a") for i, t in rows], "doc_id long, text string, pos int, anchor string")
    got = suffix_dedup.repeated_spans(df).collect()
    assert all(r.n_words == r.last_word - r.first_word >= 50 for r in got)
    assert {(r.doc_id, p) for r in got for p in range(r.first_word, r.last_word)} == covered(rows, 50)
    assert 402 not in {r.doc_id for r in got} and 302 not in {r.doc_id for r in got}


def test_passages_that_end_in_a_stock_sentence(spark):
    """50 shared words whose only minimiser lies in a sentence of 1000 other documents; each goes on differently."""
    rng = random.Random(5)
    some = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]

    def least(words):
        data, offsets = bytesplit.text_buffer(pa.array([" ".join(words)]))
        return suffix_dedup.grams(bytesplit.word_hashes(data, offsets)[0], suffix_dedup.GRAM).min()

    stock = min((some(12) for _ in range(2000)), key=least)
    rows = [(k, " ".join(some(60) + stock + some(60))) for k in range(1000)]
    for k in range(20):
        rare = some(38)
        rows += [(2000 + 2 * k + i, " ".join(some(60) + rare + stock + some(60))) for i in range(2)]
    got = suffix_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {(r.doc_id, p) for r in got for p in range(r.first_word, r.last_word)} == covered(rows, 50)
    assert {r.doc_id for r in got} == set(range(2000, 2040))


@pytest.mark.parametrize("seed", range(20))
def test_shared_windows_wherever_the_stream_is_cut(seed):
    rng = np.random.default_rng(seed)
    rows = np.unique(np.stack([rng.integers(0, 12, 150), rng.integers(0, 6, 150), rng.integers(0, 40, 150)], axis=1), axis=0)
    found, ends = set(), []
    for part in np.split(rows, np.sort(rng.integers(0, len(rows), 6))):
        seen = suffix_dedup.Shared()
        for batch in np.split(part, np.sort(rng.integers(0, len(part) + 1, 3))):
            found |= set(map(tuple, seen.add(batch).tolist()))
        ends += seen.ends().tolist()
    found |= {(d, p) for h, d, p in ends if len({e[1] for e in ends if e[0] == h}) > 1}
    assert found == {(d, p) for h, d, p in rows.tolist() if len({r[1] for r in rows.tolist() if r[0] == h}) > 1}


def test_repeated_spans_of_nothing(spark):
    assert suffix_dedup.repeated_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_minimisers_cover_every_window():
    codes = np.random.default_rng(1).integers(0, 40, 500, dtype=np.uint64)
    at = set(suffix_dedup.minimisers(codes, 9).tolist())
    assert all(any(p in at for p in range(k, k + 9)) for k in range(len(codes) - 8)) and len(suffix_dedup.minimisers(codes[:5], 9)) == 0


def exact(rows, k, every):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows])
    out = {}
    for q in ids[ids % every == 0]:
        s = (x * x[ids == q][0]).sum(1)
        keep = ids != q
        order = np.lexsort((ids[keep], -s[keep]))[:k]
        out[int(q)] = [(int(ids[keep][o]), float(s[keep][o])) for o in order]
    return out


def recall(got, expected):
    met = sum(len({v for v, _ in want} & {r.vec_id for r in got if r.query_id == q}) for q, want in expected.items())
    return met / sum(len(want) for want in expected.values())


@pytest.mark.parametrize(("make", "block"), [("clusters", 32), ("noise", 32), ("norms", 64)])
def test_recall(spark, make, block):
    rng = np.random.default_rng(7)
    n, d = 1500, 24
    if make == "clusters":
        x = rng.standard_normal((30, d))[rng.integers(0, 30, n)] + 0.1 * rng.standard_normal((n, d))
    else:
        x = rng.standard_normal((n, d)) * (rng.uniform(0.2, 3, (n, 1)) if make == "norms" else 1)
    x = x.astype(np.float32).astype(float)
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = ann.search(df, k=10, every=20, block=block).collect()
    expected = exact(rows, 10, 20)
    assert recall(got, expected) >= 0.9
    for r in got:
        assert abs(r.score - float(np.dot(x[r.query_id], x[r.vec_id]))) < 1e-9
    for q in expected:
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, 11)) and [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)


def test_windows_of_clusters_are_small_and_those_of_noise_the_table(spark):
    rng = np.random.default_rng(11)
    n, d = 6000, 16
    clusters = rng.standard_normal((150, d))[np.arange(n) % 150] + 0.05 * rng.standard_normal((n, d))
    for x, small in ((clusters, True), (rng.standard_normal((n, 48)), False)):
        rows = [(int(i), v.tolist()) for i, v in enumerate(x)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
        blocks, how, _ = ann.indexed(df.select("vec_id", df.embedding.alias("vec")), 20, 20, 32, ann.RECALL)
        assert blocks.select("ordering").distinct().count() == how.orderings
        got, expected = ann.search(df, k=20, every=20, block=32).collect(), exact(rows, 20, 20)
        if small:
            assert how.share < 0.5 and recall(got, expected) >= 0.9
        else:
            assert how.share <= 1 and (how.orderings, how.reach) == (1, how.n_blocks) and recall(got, expected) == 1


def test_cheapest_windows():
    away = np.array([[0, 9], [9, 0], [1, 1], [0, 0]])
    assert ann.cheapest(away, 0.75, 100) == ann.Windows(2, 0, 100)
    assert ann.cheapest(away, 1, 100) == ann.Windows(2, 1, 100)
    assert ann.cheapest(away, 1, 3) == ann.Windows(1, 3, 3)


def test_ties_and_unusable_vectors(spark):
    v = [0.6, 0.8, 0.0]
    rows = [(k, v) for k in range(45)] + [(60, None), (61, []), (62, [0.0, 0.0, 0.0]), (63, [1.0, None, 0.0]), (64, [float("nan"), 1.0, 0.0]), (65, [float("inf"), 0.0, 0.0]), (66, [1.0, 2.0]), (None, v), (3, v), (80, [0.1, 0.1, 0.1])]
    df = spark.createDataFrame([(*r, 1, 0.5) for r in rows], "vec_id long, embedding array<double>, rank int, score double")
    got = ann.search(df, k=20, every=20, block=8).collect()
    assert {r.query_id for r in got} == {0, 20, 40, 80}
    for q in (0, 20, 40):
        assert [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == [i for i in range(21) if i != q][:20]
    assert ann.search(df.limit(0)).count() == 0
    assert ann.search(spark.createDataFrame([(20, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")).count() == 1


def test_hilbert_keys_are_a_curve():
    for dims, bits in ((2, 4), (3, 3)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = ann.hilbert_keys(grid, bits)
        assert sorted(keys.tolist()) == list(range(len(grid)))
        assert np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(1).max() == 1


def brute_cost(roles, costs):
    """The least cost over all assignments of roles and merges."""
    least = float("inf")
    for ways in itertools.product(itertools.product((1, 2, 3), (0, 1)), repeat=len(roles)):
        state, total = chat.START, 0.0
        for role, (new, merged) in zip(roles, ways, strict=True):
            total += 0 if role == new else costs.unknown if role == 0 else costs.relabel
            if merged:
                total += costs.merge if state == new else float("inf")
            elif (state, new) in chat.BETWEEN:
                total += costs.insert * len(chat.BETWEEN[state, new])
            else:
                total = float("inf")
            state = new
        least = min(least, total + costs.insert * len(chat.AFTER[state]))
    return least


def path_cost(roles, made, costs):
    total = 0.0
    for role, (new, merged, before) in zip(roles, made, strict=True):
        total += (0 if role == new else costs.unknown if role == 0 else costs.relabel) + costs.merge * merged + costs.insert * before
    return total + costs.insert * len(chat.AFTER[made[-1][0]])


@pytest.mark.parametrize("costs", [chat.Costs(), chat.Costs(merge=5, relabel=1, unknown=0.5, insert=2), chat.Costs(merge=1, relabel=9, unknown=9, insert=1)])
def test_repair_is_cheapest(costs):
    for n in range(1, 5):
        for roles in itertools.product(range(4), repeat=n):
            made = chat.repair(list(roles), costs)
            assert path_cost(roles, made, costs) == brute_cost(roles, costs)


def conversations(seed):
    rng = random.Random(seed)
    rows = []
    for conv in range(40):
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "user", "assistant", "system", " Human ", "BOT", "tool", None]), rng.choice(["hi", "", None, "a <|end|> b"])))
    rows += [(100, t, rng.choice(["user", "assistant", "system", "x"]), f"t{t}") for t in range(600)] + [(None, 1, "user", "n"), (101, None, "assistant", "m"), (101, None, "assistant", "m")]
    return rows


def test_chats_in_parts_equal_whole_repair(spark):
    rows = conversations(3)
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(*r, 0, "c") for r in rows], "conv_id long, turn long, role string, text string, part int, code string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = chat.format_chats(df).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == len(rows)
    costs, by_conv = chat.Costs(), {}
    for r in sorted(got, key=lambda r: r.place):
        by_conv.setdefault(r.conv_id, []).append(r)
    assert len({r.place // (1 << 33) for r in by_conv[100]}) > 1  # one conversation over several partitions
    for own in by_conv.values():
        codes = [chat.ALIASES.get((r.role or "").strip().lower(), 0) for r in own]
        assert abs(sum(r.cost for r in own) - path_cost(codes, chat.repair(codes, costs), costs)) < 1e-9
        text = "".join(r.rendered for r in own)
        turns = [t.split("|>\n", 1) for t in text.split("<|") if t and not t.startswith("end|>")]
        shape = [t[0] for t in turns]
        shape = shape[1:] if shape[0] == "system" else shape
        assert shape == ["user", "assistant"] * (len(shape) // 2) and shape
        assert text.count("<|end|>\n") == len(turns) and text.endswith("<|end|>\n")
    assert chat.format_chats(df.limit(0)).count() == 0


def test_vectors_of_any_size_take_part(spark):
    """Norms whose squares are no doubles any more, and norms so small that theirs are zero."""
    rng = np.random.default_rng(11)
    base = rng.standard_normal((80, 6))
    for size in (1e200, 1e-200):
        rows = [(i, (base[i] * size).tolist()) for i in range(80)] + [(100 + i, (base[i] / size).tolist()) for i in range(10)]
        got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5, every=20, block=8).collect()
        assert {r.query_id for r in got} == {0, 20, 40, 60, 100} and all(r.rank <= 5 for r in got)


def test_scores_far_below_their_norms():
    """Rows at right angles to the query: an error of the rough product follows the norms, not the score."""
    rng = np.random.default_rng(12)
    query = rng.standard_normal(64) * 1e9
    rows = rng.standard_normal((4000, 64)) * 1e9
    rows -= np.outer(rows @ query / (query @ query), query)
    ids = np.arange(4000)
    scores = (rows * query).sum(1)
    wanted = np.lexsort((ids, -scores))[:20]
    (found, _), = ann.top(query[None, :], np.array([-1]), rows, ids, 20)
    assert found.tolist() == wanted.tolist()
