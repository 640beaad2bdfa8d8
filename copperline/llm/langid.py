"""Language ID by prediction by partial matching (operator 8).

For each language a variable-order tree of byte contexts (up to three symbols) holds the counts of a bounded
training sample. Escape probabilities follow PPM's method C with exclusion. Once trained, the statistics are
frozen, so the trees compile into a sparse table of code lengths: a row for every pair of a context and a symbol
that the sample holds, an escape for every context, each with a value for every language. A text's score under a
language is its exact code length; contexts that are not in a tree fall back to their longest suffix that is.

Symbols: ASCII letters without case, every other byte from 0x80 that the sample holds, one symbol for all
remaining ASCII bytes, one for bytes that the sample has not.

The sample is bounded by ``SAMPLE_DOCS`` documents of each language and ``SAMPLE_CHARS`` characters of a document, which
a longer text gives in ``SAMPLE_PARTS`` parts spread evenly from its start to its end; this bounds training only,
predictions take whole texts, part by part.

Defined results: null text, or text without a letter, gives ``und`` with score 0; without any labelled row
all texts do. A tie goes to the language that sorts first. Repeated rows give repeated rows. Null ids are
never trained on and are not held out. Extra columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from copperline.llm import bytesplit

ORDER = 3
#: Bound of the training sample: documents of each language, and characters that a document gives, in parts from all of it.
SAMPLE_DOCS = 400
SAMPLE_CHARS = 16 << 10
SAMPLE_PARTS = 16
#: A context of the sample is kept if it occurs so often in some language.
LEAST_COUNT = 2
#: Positions that are scored at once.
CHUNK = 1 << 18

_LETTER = re.compile(r"[^\W\d_]")  # and number signs that are no letters, so each find is asked again


def has_letter(text: str | None) -> bool:
    return bool(text) and any(m.group().isalpha() for m in _LETTER.finditer(text))


@dataclass
class Model:
    """Code lengths of the (context, symbol) pairs that the sample holds; other symbols cost a context's escape and then what they cost after its suffix."""

    languages: list[str]
    symbol: np.ndarray  # of each byte
    width: int  # symbols
    row_of: np.ndarray  # of each three symbols: the longest context in a tree
    shorter: np.ndarray  # of each context: its suffix
    escape: np.ndarray  # [context, language], in bits; 0 where the language has no such context
    marks: np.ndarray  # [context, words]: a bit for each symbol that has a pair
    before: np.ndarray  # [context, words]: pairs before a word's first
    pairs: np.ndarray  # [pair, language], in bits

    def lookup(self, rows: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """[position, language]: bits of each symbol after the context of that row."""
        word = rows * self.marks.shape[1] + (symbols >> 6)
        bit = np.left_shift(np.uint64(1), (symbols & 63).astype(np.uint64))
        mark = self.marks.reshape(-1)[word]
        at = self.before.reshape(-1)[word] + np.bitwise_count(mark & (bit - np.uint64(1)))
        lost = np.flatnonzero((mark & bit) == 0)
        at[lost] = 0
        out = self.pairs[at]
        if len(lost):  # the empty context has all symbols
            out[lost] = self.escape[rows[lost]] + self.lookup(self.shorter[rows[lost]], symbols[lost])
        return out

    @property
    def bits(self) -> np.ndarray:
        """[context, symbol, language]: the table in full, for tests of small models."""
        n = len(self.escape)
        return self.lookup(np.repeat(np.arange(n), self.width), np.tile(np.arange(self.width), n)).reshape(n, self.width, -1)

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """[text, language]: bits of each text."""
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        base, end = int(offsets[0]), int(offsets[-1])
        for a in range(base, end, CHUNK):
            b = min(a + CHUNK, end)
            own = np.full(b - a + ORDER, self.symbol[0x20], np.int32)  # the chunk after the symbols before it
            before = self.symbol[data[max(base, a - ORDER) : b]]
            own[len(own) - len(before) :] = before
            begun = offsets[np.searchsorted(offsets, a - ORDER, "right") : np.searchsorted(offsets, b)]
            context = np.zeros(b - a, np.int64)
            for back in range(ORDER, 0, -1):  # each text follows ORDER blanks
                symbols = own[ORDER - back : len(own) - back].copy()
                for k in range(back):
                    at = begun + k - a
                    symbols[at[(at >= 0) & (at < b - a)]] = self.symbol[0x20]
                context = context * self.width + symbols
            bits = self.lookup(self.row_of[context], own[ORDER:])
            rows = np.arange(np.searchsorted(offsets, a, "right") - 1, np.searchsorted(offsets, b))
            rows = rows[np.minimum(offsets[rows + 1], b) > np.maximum(offsets[rows], a)]
            out[rows] += np.add.reduceat(bits, np.maximum(offsets[rows] - a, 0), axis=0, dtype=np.float64)
        return out


def train(samples: dict[str, list[bytes]], least_count: int = LEAST_COUNT) -> Model:
    """The model of the texts of each language."""
    languages = sorted(samples)
    folded = {k: [bytesplit.LOWER[np.frombuffer(t, np.uint8)] for t in samples[k]] for k in languages}
    symbol, n = np.zeros(256, np.int32), 1  # 0: all ASCII but letters
    for b in range(ord("a"), ord("z") + 1):
        symbol[b] = symbol[b - 32] = n
        n += 1
    seen = np.zeros(256, bool)
    for texts in folded.values():
        for t in texts:
            seen[t] = True
    other = n
    symbol[0x80:] = other
    for b in np.flatnonzero(seen[0x80:]) + 0x80:
        n += 1
        symbol[b] = n
    a = n + 1

    grams: list[dict[str, tuple[np.ndarray, np.ndarray]]] = [{} for _ in range(ORDER + 1)]  # codes of context and symbol, counts
    for k, texts in folded.items():
        parts = [np.concatenate([np.zeros(ORDER, np.int64), symbol[t]]) for t in texts if len(t)]
        for order in range(ORDER + 1):
            codes = []
            for s in parts:
                code = np.zeros(len(s) - ORDER, np.int64)
                for i in range(order, -1, -1):
                    code = code * a + s[ORDER - i : len(s) - i]
                codes.append(code)
            grams[order][k] = np.unique(np.concatenate(codes), return_counts=True) if codes else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    contexts, pairs = [np.zeros(1, np.int64)], [np.arange(a)]  # of each order, those that the trees have; all symbols after nothing
    for order in range(1, ORDER + 1):
        kept = []
        for codes, counts in grams[order].values():
            context, inverse = np.unique(codes // a, return_inverse=True)
            kept.append(context[np.bincount(inverse, counts, len(context)) >= least_count])
        contexts.append(np.unique(np.concatenate(kept)))
        every = np.unique(np.concatenate([codes for codes, _ in grams[order].values()]))
        pairs.append(every[np.isin(every // a, contexts[order])])
    row = [np.searchsorted(c, p // a) for c, p in zip(contexts, pairs, strict=True)]

    escape, bits = [], []
    for k in languages:
        escapes, layers, here = [], [], np.full(a, 1 / a)
        for order in range(ORDER + 1):
            below = here[np.searchsorted(pairs[order - 1], pairs[order] % a**order)] if order else here
            codes, n_of = grams[order][k]
            counts = np.zeros(len(pairs[order]))
            own = np.isin(codes, pairs[order])
            counts[np.searchsorted(pairs[order], codes[own])] = n_of[own]
            sums = lambda x, order=order: np.bincount(row[order], x, len(contexts[order]))
            total, distinct = sums(counts), sums(counts > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                free = np.where(total > 0, distinct / (total + distinct) / np.maximum(1 - sums(np.where(counts > 0, below, 0)), 1e-12), 1)
                here = np.where(counts > 0, counts / (total + distinct)[row[order]], free[row[order]] * below)
            escapes.append(-np.log2(free))
            layers.append(-np.log2(here))
        escape.append(np.concatenate(escapes))
        bits.append(np.concatenate(layers))

    starts = np.cumsum([0] + [len(c) for c in contexts])
    row_of, shorter = np.zeros(1, np.int32), [np.zeros(1, np.int64)]
    for order in range(1, ORDER + 1):
        row_of = np.tile(row_of, a)  # by the suffix that is one symbol shorter
        shorter.append(row_of[contexts[order]].astype(np.int64))
        row_of[contexts[order]] = starts[order] + np.arange(len(contexts[order]))
    marks = np.zeros((int(starts[-1]), -(-a // 64)), np.uint64)
    for r, p, start in zip(row, pairs, starts, strict=False):
        np.bitwise_or.at(marks, (r + start, p % a >> 6), np.left_shift(np.uint64(1), (p % a & 63).astype(np.uint64)))
    held = np.bitwise_count(marks).reshape(-1)
    before = (np.cumsum(held, dtype=np.int64) - held).reshape(marks.shape)
    return Model(languages, symbol, a, row_of, np.concatenate(shorter), np.stack(escape, -1).astype(np.float32), marks, before, np.stack(bits, -1).astype(np.float32))


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sampled(text: Column) -> Column:
    """The text, or SAMPLE_CHARS characters of a longer one in parts of equal length, the first at its start, the last at its end."""
    ends = [k * SAMPLE_CHARS // SAMPLE_PARTS for k in range(SAMPLE_PARTS + 1)]
    chars = F.length(text).cast("long")
    parts = [F.substring(text, F.floor((chars - (e - b)) * k / (SAMPLE_PARTS - 1)).cast("int") + 1, F.lit(e - b)) for k, (b, e) in enumerate(zip(ends, ends[1:]))]
    return F.when(F.length(text) <= SAMPLE_CHARS, text).otherwise(F.concat(*parts))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS) -> Model | None:
    """Train on at most ``sample_docs`` different documents a language, of those that are not held out; None without any.

    The sample takes the smallest hashes of ids, so it is the same each time; of a long document it takes parts from
    all of it. Any letter of a whole text makes it one to learn from. Only narrow rows (language, id, hash of the text) are sorted, those of a language first by
    the partition that they are read in, so that no task takes all of a language: its first rows are among the first of
    their partitions. The texts of the chosen rows are then read, one of equal ones.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out() & F.col("text").rlike(r"\p{L}"))
    keys = ["lang", "doc_id", "hash"]
    chosen = rows.select("lang", "doc_id", F.xxhash64("text").alias("hash"), F.spark_partition_id().alias("part"))
    for group in (["lang", "part"], ["lang"]):
        rank = F.dense_rank().over(Window.partitionBy(*group).orderBy(F.xxhash64("doc_id"), "doc_id", "hash"))
        chosen = chosen.withColumn("rank", rank).where(F.col("rank") <= sample_docs).select(*keys, "part").distinct()
    chosen = chosen.select(*keys).distinct()
    whole = rows.select("lang", "doc_id", F.xxhash64("text").alias("hash"), "text")
    taken = whole.join(chosen.hint("broadcast"), keys, "left_semi")  # sample_docs rows a language
    taken = taken.select(*keys, sampled(F.col("text")).alias("text")).groupBy(*keys).agg(F.min("text").alias("text"))
    samples: dict[str, list[bytes]] = {}
    for r in taken.collect():
        samples.setdefault(r.lang, []).append(r.text.encode())
    return train({k: sorted(v) for k, v in samples.items()}) if samples else None


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: list[str] = ()) -> DataFrame:
    """(doc_id, lang_pred, score, bits_per_byte) of each row, and the columns of ``keep``; score is the posterior of the best."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *keep)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            data, offsets = bytesplit.text_buffer(batch.column(1))
            n = batch.num_rows
            pred, prob, rate = np.full(n, "und", object), np.zeros(n), np.zeros(n)
            letters = np.fromiter((has_letter(t.as_py()) for t in batch.column(1)), bool, n)
            for i, j in bytesplit.spans(offsets) if model else ():
                bits = model.code_lengths(data, offsets[i : j + 1])
                best = bits.argmin(1)
                least = bits[np.arange(j - i), best]
                own = letters[i:j]
                pred[i:j][own] = np.array(model.languages, object)[best[own]]
                prob[i:j][own] = (1 / np.exp2(-np.minimum(bits - least[:, None], 1000)).sum(1))[own]
                rate[i:j] = least / np.maximum(np.diff(offsets[i : j + 1]), 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred.tolist(), pa.string()), pa.array(prob), pa.array(rate)], names=[*batch.schema.names, "lang_pred", "score", "bits_per_byte"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(score, f"{fields}, lang_pred string, score double, bits_per_byte double")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Fit on the labelled rows that are not held out and predict every row: doc_id, held_out, lang_pred, score, bits_per_byte."""
    out = predict(docs, fit(docs, id_col, text_col, lang_col), id_col, text_col)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "bits_per_byte")
