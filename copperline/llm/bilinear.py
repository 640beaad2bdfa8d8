"""Scores of texts by a log-bilinear neural language model, trained by noise-contrastive estimation (operator 11).

Tokens are lower-cased words and one end a text. A token has a class: each of the ``WORDS`` most frequent words is one of its own,
the end another; all other words go by their ending (last two bytes), the ``GROUPS`` - 1 heaviest endings and the rest.
The model predicts the class from the classes of the ``ORDER`` tokens before it, and the word within its class:

* log-bilinear: v = sum over i of C[i] * R[h[i]], score of class k = v . Q[k] + b[k]; the softmax over all classes, a
  matrix product for a batch of tokens, normalises it;
* a word that training has seen c times has (c - D) of its class's N tokens, and what training has not seen has the
  D * V that the class's V words give off; D is the absolute discount n1 / (n1 + 2 n2) of all words. So the
  probabilities of all known words and of "unknown, with this ending" sum to one in each context.

1. Words of all training texts are counted (summed in tasks, then by hash) into a written table, which grows with the corpus.
2. Training: each task runs NCE (``NOISE`` draws from the class frequencies, shared by a batch of ``BATCH`` tokens) over all texts
   of its partition, from common parameters; the tasks' parameters are averaged, weighted by tokens, in Spark. A first
   round over one text in ``PILOT`` gives the second round, over all of them, its start.
3. Scoring: one pass gives a text's class scores, and the counts of words among the ``HEAD`` most frequent, which every task
   has. Its other words, distinct and counted, are exploded and joined with the table of counts; their sums go back to
   their texts.

Words are known by 64-bit hashes. Bounds: the driver sees the head, two numbers for each of 65,536 endings, and the parameters
(some 17,000 numbers). The parameters depend on how texts are dealt to partitions, within the noise of training.

Defined results: null or empty text, or text of white space, is the end alone. Rows with a null id are scored and not
learned from; their held_out is null. Repeated rows each count and each have a row. Without any training text N and V are 0, all
tokens are unknown and all classes alike. An empty table gives no rows. Long texts are learned and scored whole. Extra
columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copperline.llm import bytesplit
from copperline.llm.common import stored

#: Classes: words of their own, and endings (K = WORDS + GROUPS + 1 is 256, a byte).
WORDS, GROUPS = 191, 64
END = WORDS + GROUPS
CLASSES = END + 1
#: Tokens of context, size of a vector.
ORDER, DIMS = 3, 24
#: Words whose counts every task holds.
HEAD = 1 << 17
#: Tokens of a step, noise draws for it, tokens that are scored at once.
BATCH, NOISE, SCORED = 1024, 40, 1024
#: One training text in so many makes the first round; steps of the rounds.
PILOT = 8
RATES = (0.3, 0.15)
SEED = 20260101
#: The end's hash; no word has it but by chance.
_END_HASH = -0x61C8864680B583EB

_SHAPES = {"R": (CLASSES, DIMS), "C": (ORDER, DIMS), "Q": (CLASSES, DIMS), "b": (CLASSES,)}


class Vocabulary(NamedTuple):
    """What training has counted, as far as every task needs it."""

    tokens: int  # N
    words: int  # V, the end among them
    discount: float
    groups: np.ndarray  # of each ending, its group
    group_tokens: np.ndarray  # N of each group, without words of their own
    group_words: np.ndarray
    hashes: np.ndarray  # of the head, ascending
    counts: np.ndarray
    classes: np.ndarray
    class_tokens: np.ndarray
    least: int  # the head holds all words of so many tokens and more

    @property
    def unknown(self) -> np.ndarray:
        """log10 of what each group leaves for unknown words."""
        given = self.discount * self.group_words / np.maximum(self.group_tokens, 1)
        return np.log10(np.where(self.group_words > 0, given, 1.0))


class Texts(NamedTuple):
    """The words of some rows of text, and where each row's begin."""

    hashes: np.ndarray  # int64
    endings: np.ndarray
    bounds: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray, offsets: np.ndarray) -> Texts:
        starts, ends, bounds = bytesplit.words(data, offsets)
        base = int(offsets[0])
        low = bytesplit.LOWER[data[base : int(offsets[-1])]]
        hashes = bytesplit.hash_pieces(low, starts - base, ends - base).view(np.int64)
        if not len(ends):
            return cls(hashes, np.zeros(0, np.int64), bounds)
        last, before = (low[np.maximum(ends - base - k, 0)].astype(np.int64) for k in (1, 2))
        return cls(hashes, np.where(ends - starts > 1, before, 0) * 256 + last, bounds)

    def sequence(self, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(classes of all tokens, the end after each row's words; each row's first token)."""
        return np.insert(classes, self.bounds[1:], END), self.bounds[:-1] + np.arange(len(self.bounds) - 1)


def contexts(classes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """[ORDER, n]: the classes of the tokens before each token, nearest first; before a text there are ends."""
    place = np.arange(len(classes)) - np.repeat(firsts, np.diff(np.append(firsts, len(classes))))
    out = np.full((ORDER, len(classes)), END, np.uint8)
    for i in range(1, ORDER + 1):
        inside = place[i:] >= i
        out[i - 1, i:][inside] = classes[:-i][inside]
    return out


class Model:
    """The parameters, as views of one vector."""

    def __init__(self, flat: np.ndarray):
        self.flat, at = flat, 0
        for name, shape in _SHAPES.items():
            size = int(np.prod(shape))
            setattr(self, name, flat[at : at + size].reshape(shape))
            at += size

    @staticmethod
    def size() -> int:
        return sum(int(np.prod(s)) for s in _SHAPES.values())

    @classmethod
    def fresh(cls, class_tokens: np.ndarray) -> Model:
        model = cls(np.zeros(cls.size(), np.float32))
        rng = np.random.default_rng(SEED)
        model.R[:], model.Q[:] = (rng.standard_normal((CLASSES, DIMS)) * 0.1 for _ in range(2))
        model.C[:] = 1
        model.b[:] = np.log(noise(class_tokens))
        return model

    def hidden(self, context: np.ndarray) -> np.ndarray:
        out = (self.R * self.C[0]).take(context[0], axis=0)
        for i in range(1, ORDER):
            out += (self.R * self.C[i]).take(context[i], axis=0)
        return out

    def log_probabilities(self, context: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """Natural logarithm of each class after its context, normalised over all classes."""
        out, sides = np.empty(len(classes)), np.column_stack([self.Q, self.b])
        # Exponentials of scores under this bound can't overflow; else the largest is taken off first.
        tame = sum((np.abs(self.R).max(0) * np.abs(c) for c in self.C), np.zeros(DIMS)) @ np.abs(self.Q).max(0) + np.abs(self.b).max() < 60
        ones = np.ones(CLASSES, np.float32)
        for i in range(0, len(classes), SCORED):
            v = self.hidden(context[:, i : i + SCORED])
            v = np.column_stack([v, np.ones(len(v), np.float32)])
            scores = v @ sides.T
            own = scores[np.arange(len(v)), classes[i : i + SCORED]].astype(np.float64)
            top = 0.0 if tame else scores.max(1)
            np.exp(scores if tame else scores - top[:, None], out=scores)
            out[i : i + SCORED] = own - top - np.log(scores @ ones)
        return out


def noise(class_tokens: np.ndarray) -> np.ndarray:
    return (class_tokens + 1) / (class_tokens.sum() + CLASSES)


def _gathered(out: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """out[at] += rows, places repeated."""
    order = np.argsort(at, kind="stable")
    own = at.take(order)
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    out[own[first]] += np.add.reduceat(rows.take(order, axis=0), first, axis=0)


class Trainer:
    """Noise-contrastive estimation by Adagrad steps."""

    def __init__(self, model: Model, class_tokens: np.ndarray, rate: float, seed: int):
        self.model, self.rate = model, rate
        self.odds = np.log(NOISE * noise(class_tokens)).astype(np.float32)
        self.share = np.cumsum(noise(class_tokens))
        self.rng = np.random.default_rng(seed)
        self.squares = np.full(Model.size(), 1e-2, np.float32)

    def gradient(self, context: np.ndarray, classes: np.ndarray, drawn: np.ndarray) -> np.ndarray:
        """Of the mean log-likelihood of telling the tokens from the noise."""
        m, grad = self.model, Model(np.zeros(Model.size(), np.float32))
        v = m.hidden(context)
        own, false = m.Q.take(classes, axis=0), m.Q[drawn]
        right = 1 / (1 + np.exp(np.einsum("ij,ij->i", v, own) + (m.b - self.odds)[classes]))
        wrong = -1 / (1 + np.exp((self.odds - m.b)[drawn] - v @ false.T))
        back = right[:, None] * own + wrong @ false
        _gathered(grad.Q, classes, right[:, None] * v)
        np.add.at(grad.Q, drawn, wrong.T @ v)
        grad.b += np.bincount(classes, right, CLASSES) + np.bincount(drawn, wrong.sum(0), CLASSES)
        for i in range(ORDER):  # of R[h] * C[i], summed by class first
            both = np.zeros_like(m.R)
            _gathered(both, context[i], back)
            grad.R += both * m.C[i]
            grad.C[i] = (both * m.R).sum(0)
        return grad.flat / len(classes)

    def learn(self, context: np.ndarray, classes: np.ndarray) -> None:
        for i in range(0, len(classes), BATCH):
            drawn = np.minimum(np.searchsorted(self.share, self.rng.random(NOISE)), CLASSES - 1)
            grad = self.gradient(context[:, i : i + BATCH], classes[i : i + BATCH], drawn)
            self.squares += grad * grad
            self.model.flat += self.rate * grad / np.sqrt(self.squares)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def _spans(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    for batch in batches:
        data, offsets = bytesplit.text_buffer(batch.column(column))
        for i, j in bytesplit.spans(offsets):
            yield batch.slice(i, j - i), Texts.of(data, offsets[i : j + 1])


def word_counts(texts: DataFrame) -> DataFrame:
    """(hash, ending, c) of each word of the texts, and of the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, own in _spans(batches, 1):
            hashes, first, n = np.unique(own.hashes, return_index=True, return_counts=True)
            columns = np.append(hashes, _END_HASH), np.append(own.endings[first], -1).astype(np.int32), np.append(n, rows.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["hash", "ending", "n"])

    counted = texts.mapInArrow(run, "hash long, ending int, n long")
    return counted.groupBy("hash", "ending").agg(F.sum("n").alias("c"))


def vocabulary(counts: DataFrame) -> Vocabulary:
    """From (hash, ending, c): everything in a few bounded aggregates."""
    size = F.floor(F.log2("c") * 16)
    by_size = counts.groupBy(size.alias("size")).agg(F.count("*").alias("n"), F.min("c").alias("c")).orderBy(F.desc("size")).collect()  # some hundred rows
    least, room = 1 << 62, HEAD
    for r in by_size:
        if r.n > room:
            break
        least, room = r.c, room - r.n
    head = counts.where(F.col("c") >= least).toArrow()
    by_ending = counts.groupBy("ending").agg(F.sum("c").alias("c"), F.count("*").alias("v"), F.count_if(F.col("c") == 1).alias("n1"), F.count_if(F.col("c") == 2).alias("n2")).toArrow()
    endings, tokens, words = (by_ending.column(n).to_numpy() for n in ("ending", "c", "v"))
    n1, n2 = (int(by_ending.column(n).to_numpy().sum()) for n in ("n1", "n2"))
    real = endings >= 0

    groups = np.full(1 << 16, GROUPS - 1, np.uint8)
    heaviest = np.lexsort((endings[real], -tokens[real]))[: GROUPS - 1]
    groups[endings[real][heaviest]] = np.arange(len(heaviest))
    group_tokens = np.bincount(groups[endings[real]], tokens[real], GROUPS)
    group_words = np.bincount(groups[endings[real]], words[real], GROUPS)

    order = np.argsort(head.column("hash").to_numpy())
    hashes, ending, c = (head.column(n).to_numpy()[order] for n in ("hash", "ending", "c"))
    classes = np.where(ending < 0, END, WORDS + groups[ending]).astype(np.uint8)
    own = np.lexsort((hashes, -c, ending < 0))[: min(WORDS, int((ending >= 0).sum()))]
    group_tokens -= np.bincount(groups[ending[own]], c[own], GROUPS)
    group_words -= np.bincount(groups[ending[own]], minlength=GROUPS)
    classes[own] = np.arange(len(own))
    own_tokens = np.zeros(WORDS)
    own_tokens[: len(own)] = c[own]
    ends = tokens[~real].sum()
    discount = float(np.clip(n1 / max(n1 + 2 * n2, 1), 0.1, 0.9))
    return Vocabulary(int(tokens.sum()), int(words.sum()), discount, groups, group_tokens, group_words, hashes, c, classes, np.concatenate([own_tokens, group_tokens, [ends]]), int(least))


def trained(texts: DataFrame, vocabulary: Vocabulary, start: Model, rate: float) -> Model:
    """The mean, by tokens, of what each partition's task learns from all of its texts."""
    own = np.flatnonzero(vocabulary.classes < WORDS)
    hashes, classes_of, groups, frequencies, flat = vocabulary.hashes[own], vocabulary.classes[own], vocabulary.groups, vocabulary.class_tokens, start.flat

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        trainer, n = Trainer(Model(flat.copy()), frequencies, rate, SEED + TaskContext.get().partitionId()), 0
        for _, words in _spans(batches, 1):
            classes = (WORDS + groups[words.endings]).astype(np.uint8)
            if len(hashes):
                at = np.minimum(np.searchsorted(hashes, words.hashes), len(hashes) - 1)
                found = hashes[at] == words.hashes
                classes[found] = classes_of[at[found]]
            classes, firsts = words.sequence(classes)
            trainer.learn(contexts(classes, firsts), classes)
            n += len(classes)
        if n:
            places = np.arange(Model.size(), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(trainer.model.flat.astype(np.float64) * n), pa.array(np.full(len(places), n))], names=["place", "value", "n"])

    sums = texts.mapInArrow(run, "place int, value double, n long").groupBy("place").agg((F.sum("value") / F.sum("n")).alias("value")).toArrow()
    if not sums.num_rows:
        return start
    flat = np.empty(Model.size(), np.float32)
    flat[sums.column("place").to_numpy()] = sums.column("value").to_numpy()
    return Model(flat)


def fit(counts: DataFrame, texts: DataFrame) -> tuple[Vocabulary, Model]:
    """The vocabulary and the model of the training texts (doc_id, text), whose ``word_counts`` are a stored table."""
    known = vocabulary(counts)
    model = Model.fresh(known.class_tokens)
    if known.tokens:
        model = trained(texts.where(F.pmod(F.xxhash64("text"), F.lit(PILOT)) == 0), known, model, RATES[0])
        model = trained(texts, known, model, RATES[1])
    return known, model


_SCORED = "doc_id long, n_tokens long, head_known long, head_base double, score double, rest array<long>, rest_n array<int>"


def class_scores(texts: DataFrame, known: Vocabulary, model: Model) -> DataFrame:
    """Of each text: its score with all words outside the head as unknown, the head's share of the base, and those words."""
    flat, end_known = model.flat, int(known.class_tokens[END] > 0)
    unknown = known.unknown
    log_group = np.log10(np.maximum(known.group_tokens, 1))
    base = np.log10(known.counts + 1.0)
    grouped = (known.classes >= WORDS) & (known.classes < END)
    group_of = np.where(grouped, known.classes.astype(np.int64) - WORDS, 0)
    within = np.where(grouped, np.log10(np.maximum(known.counts - known.discount, 0.1)) - log_group[group_of], 0.0)
    hashes, classes_of, groups = known.hashes, known.classes, known.groups
    end_base = float(np.log10(known.class_tokens[END] + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_model = Model(flat.copy())
        for rows, words in _spans(batches, 1):
            group = groups[words.endings]
            classes = (WORDS + group).astype(np.uint8)
            inside, own_base, found = unknown[group], np.zeros(len(classes)), np.zeros(len(classes), bool)
            if len(hashes):
                at = np.minimum(np.searchsorted(hashes, words.hashes), len(hashes) - 1)
                found = hashes[at] == words.hashes
                classes[found], inside[found], own_base[found] = classes_of[at[found]], within[at[found]], base[at[found]]
            sequence, firsts = words.sequence(classes)
            logs = own_model.log_probabilities(contexts(sequence, firsts), sequence) / np.log(10)
            score = np.add.reduceat(logs, firsts) + _row_sums(inside, words.bounds)
            rest, rest_n, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [0]
            for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
                h, c = np.unique(words.hashes[a:b][~found[a:b]], return_counts=True)
                rest.append(h)
                rest_n.append(c)
                ends.append(ends[-1] + len(h))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(x).astype(t))) for x, t in ((rest, np.int64), (rest_n, np.int32))]
            sums = np.diff(words.bounds) + 1, _row_sums(found.astype(np.int64), words.bounds) + end_known, _row_sums(own_base, words.bounds) + end_base, score
            columns = [rows.column(0), *map(pa.array, sums), *lists]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _SCORED.split(", ")])

    return texts.mapInArrow(run, _SCORED)


def _row_sums(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The sum of each row's entries; rows may be empty."""
    out = np.zeros(len(bounds) - 1, x.dtype)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        out[full] = np.add.reduceat(x, bounds[:-1][full])
    return out


def score_texts(docs: DataFrame, training: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``training``: a SQL condition on ``doc_id``; the texts where it holds are learned from.
    """
    texts = _texts(docs, id_col, text_col)
    learned = texts.where(training)
    counts = stored(word_counts(learned), "lm-counts")
    known, model = fit(counts, learned)

    made = class_scores(texts, known, model).withColumn("row", F.monotonically_increasing_id())
    made = stored(made, "lm-scored")
    # What a word outside the head gains over an unknown one of its ending.
    unknown = (known.unknown + np.log10(np.maximum(known.group_tokens, 1))).tolist()
    special = [(e, unknown[g]) for e, g in enumerate(known.groups.tolist()) if g < GROUPS - 1]  # fewer than GROUPS
    given = F.coalesce(F.create_map(*[F.lit(x) for pair in special for x in pair])[F.col("ending")] if special else F.lit(None), F.lit(unknown[GROUPS - 1]))
    few = counts.where((F.col("c") < known.least) & (F.col("ending") >= 0))
    few = few.select("hash", F.log10(F.col("c") + 1.0).alias("base"), (F.log10(F.col("c") - known.discount) - given).alias("gain"))
    asked = made.select("row", F.explode(F.arrays_zip("rest", "rest_n")).alias("word")).select("row", F.col("word.rest").alias("hash"), F.col("word.rest_n").alias("n"))
    met = asked.join(few, "hash").groupBy("row").agg(F.sum("n").alias("rest_known"), F.sum(F.col("n") * F.col("base")).alias("rest_base"), F.sum(F.col("n") * F.col("gain")).alias("rest_gain"))
    rows = made.drop("rest", "rest_n").join(met, "row", "left")
    return rows.select(
        "doc_id",
        F.when(F.col("doc_id").isNotNull(), ~F.expr(training)).alias("held_out"),
        "n_tokens",
        (F.col("head_known") + F.coalesce("rest_known", F.lit(0))).alias("n_known"),
        F.lit(known.tokens).cast("long").alias("train_tokens"),
        (F.col("head_base") + F.coalesce("rest_base", F.lit(0.0)) - F.col("n_tokens") * float(np.log10(known.tokens + known.words + 1))).alias("base_score"),
        (F.col("score") + F.coalesce("rest_gain", F.lit(0.0))).alias("score"),
    )
