"""Language-model scoring with Brown classes: exchange clustering and class bigrams."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import as_bytes, field, fold, materialize, table

#: The end of a text, counted as a token; no word has white space.
END = b"\n"
#: Types that are clustered first: the most frequent words (END among them), and for all other words
#: the classes of their last three bytes. All are fixed in number, so this bigram table is too.
WORDS, ENDINGS = 768, 256
TYPES = WORDS + ENDINGS
CLASSES = 64
#: Frequent words, with their counts, that every scoring task has at hand; others are joined.
HEAD = 100_000
#: How often a frequent word must be seen to get a class of its own, by the classes around it.
SEEN = 10
#: Distinct tokens that a task counts before it passes them on.
FLUSH = 400_000
#: Class bigrams are backed off to class frequencies with this weight.
BACKOFF = 20.0


def tokens(text: bytes | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, then the end."""
    words = text.lower().split() if text else []
    words.append(END)
    return words


def ending(word: bytes) -> int:
    return crc32(word[-3:]) % ENDINGS


def _f(v: np.ndarray) -> np.ndarray:
    return v * np.log(np.maximum(v, 1e-12))


def gains(table: np.ndarray, after: np.ndarray, before: np.ndarray, own: float = 0.0) -> np.ndarray:
    """What each class adds to the likelihood of the class bigrams ``table`` if a type joins it: ``after`` and
    ``before`` count the classes around the type, ``own`` its repeats; the table holds none of these."""
    left, right, d = table.sum(1), table.sum(0), np.diag(table)
    rows, cols = _f(table + after) - _f(table), _f(table + before[:, None]) - _f(table)
    gain = rows.sum(1) - np.diag(rows) + cols.sum(0) - np.diag(cols)
    gain += _f(d + after + before + own) - _f(d)
    return gain - (_f(left + after.sum() + own) - _f(left) + _f(right + before.sum() + own) - _f(right))


def exchange(bigrams: np.ndarray, classes: int, sweeps: int = 8) -> np.ndarray:
    """Classes of the types whose bigram counts are given: each type in turn goes to the class
    that gives the class bigrams the largest likelihood, until a sweep moves none. Types start
    in classes by rank of frequency; ties go to the lowest class."""
    n = len(bigrams)
    b = bigrams.astype(np.float64)
    rank = np.argsort(-(b.sum(0) + b.sum(1)), kind="stable")
    of = np.empty(n, np.int64)
    of[rank] = np.minimum(np.arange(n), np.arange(n) % classes)
    member = np.zeros((n, classes))
    member[np.arange(n), of] = 1
    table = member.T @ b @ member
    for _ in range(sweeps):
        moved = 0
        for w in rank:
            total = b[w].sum() + b[:, w].sum()
            if not total:
                continue
            own = b[w, w]
            after, before = b[w] @ member, b[:, w] @ member
            old = of[w]
            after[old] -= own
            before[old] -= own
            table[old] -= after
            table[:, old] -= before
            table[old, old] -= own
            gain = gains(table, after, before, own)
            new = int(np.argmax(gain))
            if gain[new] <= gain[old] + 1e-9:
                new = old
            table[new] += after
            table[:, new] += before
            table[new, new] += own
            if new != old:
                member[w, old], member[w, new], of[w] = 0, 1, new
                moved += 1
        if not moved:
            break
    return of


@dataclass
class ClassModel:
    """What scoring needs; all of bounded size but ``counts``, a table of all training tokens."""

    counts: DataFrame
    tokens: int
    distinct: int
    head: dict[bytes, tuple[int, int]]  # token to its type and count
    floor: int | None  # the smallest count in head, if it has any
    of: np.ndarray  # the class of each type: clustered ones, then placed words
    move: np.ndarray  # log10 P(class | class before), flat
    emit: np.ndarray  # log10 P(type | class), for endings less the log of their unseen mass
    learned: bool


def _type_ids(words: list[bytes], types: dict[bytes, int]) -> list[int]:
    get = types.get
    return [i if (i := get(w)) is not None else WORDS + crc32(w[-3:]) % ENDINGS for w in words]


def count_tokens(docs: DataFrame, text_col: str) -> DataFrame:
    """``(token, c)`` over all rows; each task adds up before anything is shuffled."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            cols = [pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())]
            return pa.RecordBatch.from_arrays(cols, names=["token", "c"])

        for b in batches:
            for t in as_bytes(b.column(0)):
                seen.update(tokens(t))
                if len(seen) > FLUSH:
                    yield out()
                    seen.clear()
        yield out()

    made = docs.select(text_col).mapInArrow(counted, "token binary, c long")
    return made.groupBy("token").agg(F.sum("c").alias("c"))


def count_bigrams(docs: DataFrame, text_col: str, types: dict[bytes, int]) -> np.ndarray:
    """Counts of each type after each, over all rows; a text begins after END."""
    end = types[END]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, waiting, size = np.zeros(TYPES * TYPES, np.int64), [], 0
        for b in batches:
            for t in as_bytes(b.column(0)):
                ids = np.array([end, *_type_ids(tokens(t), types)], np.int64)
                waiting.append(ids[:-1] * TYPES + ids[1:])
                size += len(ids)
                if size > TYPES * TYPES:
                    sums += np.bincount(np.concatenate(waiting), minlength=len(sums))
                    waiting, size = [], 0
        if waiting:
            sums += np.bincount(np.concatenate(waiting), minlength=len(sums))
        at = np.flatnonzero(sums)
        cols = [pa.array(at.astype(np.int32)), pa.array(sums[at])]
        yield pa.RecordBatch.from_arrays(cols, names=["cell", "n"])

    made = docs.select(text_col).mapInArrow(counted, "cell int, n long")
    cells = made.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(TYPES * TYPES, np.int64)
    out[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    return out.reshape(TYPES, TYPES)


def count_cells(docs: DataFrame, text_col: str, types: dict[bytes, int], cells: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``(cell, n)``: how often each number occurs among those that ``cells`` makes of the types of a text, which
    begins after END. Each task adds up before anything is shuffled."""
    end = types[END]

    def summed(waiting: list[np.ndarray]) -> pa.RecordBatch:
        at, n = np.unique(np.concatenate([np.empty(0, np.int64), *waiting]), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(at), pa.array(n)], names=["cell", "n"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for b in batches:
            for t in as_bytes(b.column(0)):
                waiting.append(cells(np.array([end, *_type_ids(tokens(t), types)], np.int64)))
                size += len(waiting[-1])
                if size > TYPES * TYPES:
                    yield summed(waiting)
                    waiting, size = [], 0
        yield summed(waiting)

    made = docs.select(text_col).mapInArrow(counted, "cell long, n long")
    return made.groupBy("cell").agg(F.sum("n").alias("n"))


def place(docs: DataFrame, text_col: str, types: dict[bytes, int], of: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """``of`` with better classes for the placed words (types from TYPES on): each leaves the class of its
    ending for the one that gives the class bigrams ``pairs`` the largest likelihood, by the classes before and
    after it over all rows; ties go to the lowest class. All see the same classes around them, so the words
    are placed side by side; of each word a task has the counts of CLASSES classes on two sides at most."""

    def around(ids: np.ndarray) -> np.ndarray:
        x, y = ids[:-1], ids[1:]
        y_placed, x_placed = (y >= TYPES) & (x != y), (x >= TYPES) & (x != y)
        before = (y[y_placed] * 2) * CLASSES + of[x[y_placed]]
        after = (x[x_placed] * 2 + 1) * CLASSES + of[y[x_placed]]
        return np.concatenate([before, after])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for w, seen in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sides = np.zeros(2 * CLASSES)
                for cell in seen:
                    sides[cell["at"]] = cell["n"]
                before, after, old = sides[:CLASSES], sides[CLASSES:], of[w]
                table = pairs.copy()
                table[old] -= after
                table[:, old] -= before
                gain = gains(np.maximum(table, 0), after, before)
                new = int(np.argmax(gain))
                found.append(new if gain[new] > gain[old] + 1e-9 else int(old))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.int32())], names=["w", "k"])

    cells = count_cells(docs, text_col, types, around)
    word, at = F.expr(f"cell div {2 * CLASSES}").alias("w"), F.expr(f"cast(cell % {2 * CLASSES} as int)").alias("at")
    seen = cells.select(word, F.struct(at, "n").alias("s")).groupBy("w").agg(F.collect_list("s").alias("s"))
    new = seen.mapInArrow(placed, "w long, k int").toArrow()
    of = of.copy()
    of[new["w"].to_numpy()] = new["k"].to_numpy()
    return of


def fit(docs: DataFrame, *, text_col: str = "text") -> ClassModel:
    """Learn from all rows of ``docs``. Nulls are empty texts, which have the end alone.

    The driver gets the HEAD most frequent words at most, the bigram counts of the types and sums;
    the counts of all tokens stay a table in the shared folder."""
    counts = materialize(count_tokens(docs, text_col), "token-counts")
    whole = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n, v = whole.n or 0, whole.v
    # The most frequent words by a histogram of counts in steps of 1 %: no sort of all tokens.
    step = F.floor(F.log(F.col("c")) / F.lit(math.log(1.01))).cast("int")
    bars = counts.groupBy(step.alias("b")).agg(F.count("*").alias("n")).collect()
    low, room = None, HEAD
    for bar in sorted(bars, key=lambda r: -r.b):
        if bar.n > room:
            break
        low, room = bar.b, room - bar.n
    rows = counts.where(step >= low).toArrow() if low is not None else pa.table({"token": pa.array([], pa.binary()), "c": pa.array([], pa.int64())})
    frequent = sorted(zip(rows["c"].to_pylist(), rows["token"].to_pylist(), strict=True), key=lambda r: (-r[0], r[1]))
    frequent = [(c, bytes(w)) for c, w in frequent]
    types = {w: i for i, (_, w) in enumerate(x for x in frequent if x[1] != END) if i < WORDS - 1}
    types[END] = WORDS - 1
    bigrams = count_bigrams(docs, text_col, types)
    of = exchange(bigrams, CLASSES)
    least = max(SEEN, frequent[-1][0]) if frequent else None
    own = [(w, c) for c, w in frequent if c >= SEEN and w not in types]
    by_end = F.expr(f"crc32(substring(token, -3, 3)) % {ENDINGS}").cast("int")
    tail = counts.where(~F.col("token").isin(*types))
    tail = tail if least is None else tail.where(F.col("c") < least)
    mass = tail.groupBy(by_end.alias("e")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()
    rest, unseen = np.zeros(ENDINGS), np.ones(ENDINGS)
    for r in mass:
        rest[r.e], unseen[r.e] = r.n, r.n + r.v + 1
    size = np.concatenate([bigrams.sum(0)[:WORDS], rest, [c for _, c in own]])
    member = np.zeros((TYPES, CLASSES))
    member[np.arange(TYPES), of] = 1
    pairs = member.T @ bigrams @ member
    if own:
        of = np.concatenate([of, of[[WORDS + ending(w) for w, _ in own]]])
        types |= {w: TYPES + i for i, (w, _) in enumerate(own)}
        of = place(docs, text_col, types, of, pairs)
        cells = count_cells(docs, text_col, types, lambda ids: of[ids[:-1]] * CLASSES + of[ids[1:]]).toArrow()
        pairs = np.zeros(CLASSES * CLASSES)
        pairs[cells["cell"].to_numpy()] = cells["n"].to_numpy()
        pairs = pairs.reshape(CLASSES, CLASSES)
    share = (pairs.sum(0) + 1) / (pairs.sum() + CLASSES)
    p = (pairs + BACKOFF * share) / (pairs.sum(1, keepdims=True) + BACKOFF)
    emit = np.log10((size + 0.5) / np.bincount(of, size + 0.5, CLASSES)[of])
    emit[WORDS:TYPES] -= np.log10(unseen)
    head = {w: (types[w] if w in types else WORDS + ending(w), c) for c, w in frequent}
    return ClassModel(
        counts, n, v, head, frequent[-1][0] if frequent else None,
        of, np.log10(p).ravel(), emit, n > 0,
    )


def score(docs: DataFrame, model: ClassModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_tokens, n_known, base_score, score)``, a row for each row of ``docs``.

    A word has the probability of its class after the class before it, times its own within the
    class; a word without a class of its own stands in the class of its ending, with its count plus one
    among such words of that ending. Frequent words are looked up where the text is; the others are
    joined with the table of counts by word, and only their sums go back to the texts. Null and
    empty texts have the end alone; a model of no texts gives every token the same probability.
    """
    n_all, v_all = model.tokens, model.distinct
    head, of, move, emit, end = model.head, model.of, model.move, model.emit, WORDS - 1
    in_tail = (np.arange(len(of)) >= WORDS) & (np.arange(len(of)) < TYPES)
    index = {w: i for i, w in enumerate(head)}
    kind = np.array([*(i for i, _ in head.values()), end], np.int64)  # the last of both is for words not at hand
    log = np.array([*(math.log10(c + 1) for _, c in head.values()), 0.0])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(5)]
            for t in as_bytes(b.column(1)):
                words = tokens(t)
                at = np.array([index.get(w, -1) for w in words], np.int64)
                ids, logs, lost = kind[at], log[at], np.flatnonzero(at < 0)
                rare = [words[j] for j in lost]
                ids[lost] = [end if w == END else WORDS + ending(w) for w in rare]
                k = of[ids]
                s = move[of[end] * CLASSES + k[0]] + move[k[:-1] * CLASSES + k[1:]].sum() + emit[ids].sum()
                s += logs[in_tail[ids]].sum()
                for c, x in zip(cols, (len(words), len(words) - len(rare), logs.sum(), s, rare), strict=True):
                    c.append(x)
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()))
            made = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *made], names=["id", "n", "known", "base", "own", "rare"])

    spec = [("n", T.LongType()), ("known", T.LongType()), ("base", T.DoubleType()), ("own", T.DoubleType())]
    spec = [T.StructField(n, k) for n, k in spec] + [T.StructField("rare", T.ArrayType(T.BinaryType()))]
    here = docs.select(id_col, text_col).mapInArrow(local, T.StructType([field(docs, id_col, "id"), *spec]))
    here = materialize(here.withColumn("row", F.monotonically_increasing_id()), "token-scores")
    rare = here.select("row", F.explode("rare").alias("token"))
    counts = model.counts
    if model.floor is not None:
        counts = counts.where(F.col("c") <= model.floor)
    of_join = F.log10(F.col("c") + 1)
    found = rare.join(counts, "token").groupBy("row").agg(
        F.sum(of_join).alias("logs"), F.sum(F.when(F.col("token") != F.lit(END), of_join)).alias("ending_logs"), F.count("*").alias("more")
    )
    logs = F.coalesce("logs", F.lit(0.0))
    flat = math.log10(n_all + v_all + 1)
    own = F.col("own") + F.coalesce("ending_logs", F.lit(0.0)) if model.learned else F.col("n") * F.lit(-flat)
    return here.drop("rare").join(found, "row", "left").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        (F.col("base") + logs - F.col("n") * F.lit(flat)).alias("base_score"),
        own.alias("score"),
    )


def op9_class_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all ``documents``, learned from those not in fold 2 of 7."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs.where(fold(F.col("doc_id"), 7) != 2))
    found = score(docs, model)
    return found.select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id"), 7) == 2, F.lit(False)).alias("held_out"),
        "n_tokens", "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score", "score",
    )
