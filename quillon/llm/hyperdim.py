"""Language identification with hyperdimensional profiles."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import as_bytes, fold, table, with_columns

DIMS = 512
SEED = 20
#: n-gram vectors that a worker keeps (DIMS * 4 bytes each); it starts anew beyond.
CACHE = 30_000
#: Characters and texts that are encoded at once; a longer text is taken alone.
CHUNK, TEXTS = 1 << 18, 256
#: Letters of a chunk up to which trigrams are numbered by a table, not by sorting.
ALPHABET = 128
SPACE = 32
UNKNOWN = "und"


class Encoder:
    """Trigrams of letters as vectors of +1 and -1, and their bundles.

    A letter's vector is drawn from a generator seeded by its code point. A trigram binds (by
    product) its first letter rotated twice, its second rotated once and its third. All that is no
    letter is one space between words, with a space at either end of a text."""

    def __init__(self) -> None:
        self.alpha = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        self.letters: dict[int, np.ndarray] = {}
        self.rows: dict[int, int] = {}
        self.vectors = np.empty((CACHE, DIMS), np.float32)

    def letter(self, c: int) -> np.ndarray:
        if c not in self.letters:
            bits = np.random.default_rng([SEED, c]).integers(0, 2, DIMS)
            self.letters[c] = (2 * bits - 1).astype(np.float32)
        return self.letters[c]

    def bound(self, keys: list[int]) -> np.ndarray:
        """The vectors of distinct trigrams, each three code points of 21 bits; CACHE at most."""
        new = [k for k in keys if k not in self.rows]
        if len(self.rows) + len(new) > CACHE:
            self.rows, self.letters, new = {}, {}, keys
        mask = (1 << 21) - 1
        for k in new:
            first, second, third = self.letter(k >> 42), self.letter(k >> 21 & mask), self.letter(k & mask)
            self.rows[k] = at = len(self.rows)
            self.vectors[at] = np.roll(first, 2) * np.roll(second, 1) * third
        return self.vectors[[self.rows[k] for k in keys]]

    def _numbered(self, c: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct trigrams of ``c``, and which of them stands at each place of ``ok``."""
        present = np.zeros(0x110000, bool)
        present[c] = True
        letters = np.flatnonzero(present)
        n = len(letters)
        code = np.zeros(0x110000, np.int64)
        code[letters] = np.arange(n)
        x = code[c]
        at = ((x[:-2] * n + x[1:-1]) * n + x[2:])[ok]
        if n <= ALPHABET:
            seen = np.zeros(n**3, bool)
            seen[at] = True
            distinct = np.flatnonzero(seen)
            number = np.empty(n**3, np.int64)
            number[distinct] = np.arange(len(distinct))
            at = number[at]
        else:
            distinct, at = np.unique(at, return_inverse=True)
        a, b, z = distinct // n**2, distinct // n % n, distinct % n
        return letters[a] << 42 | letters[b] << 21 | letters[z], at

    def bundles(self, texts: list[str], group: np.ndarray, groups: int) -> np.ndarray:
        """For each of ``groups``, the sum of the vectors of all trigrams, repeats included, of the
        texts that ``group`` gives to it."""
        out = np.zeros((groups, DIMS))
        padded = [f" {t} " for t in texts]
        whole = np.frombuffer("".join(padded).encode("utf-32-le", "replace"), "<u4")
        owner = np.repeat(np.arange(len(padded)), [len(t) for t in padded])
        c = np.where(self.alpha[whole], whole, SPACE).astype(np.int64)
        again = (c[1:] == SPACE) & (c[:-1] == SPACE) & (owner[1:] == owner[:-1])
        keep = np.concatenate([[True], ~again]) if len(c) else np.zeros(0, bool)
        c, owner = c[keep], owner[keep]
        if len(c) < 3:
            return out
        ok = owner[:-2] == owner[2:]
        keys, at = self._numbered(c, ok)
        g = group[owner[:-2][ok]]
        for low in range(0, len(keys), CACHE // 2):
            n = min(CACHE // 2, len(keys) - low)
            here = (at >= low) & (at < low + n)
            counts = np.bincount(g[here] * n + at[here] - low, minlength=groups * n)
            out += counts.reshape(groups, n).astype(np.float32) @ self.bound(keys[low : low + n].tolist())
        return out


def _chunks(rows: Iterable[tuple[object, bytes | None]]) -> Iterator[tuple[list, list[str]]]:
    """Lower-cased texts with what stands beside them, some at a time."""
    tags, texts, size = [], [], 0
    for tag, text in rows:
        t = (text or b"").decode("utf-8", "replace").lower()
        if texts and (size + len(t) > CHUNK or len(texts) == TEXTS):
            yield tags, texts
            tags, texts, size = [], [], 0
        tags.append(tag)
        texts.append(t)
        size += len(t)
    if texts:
        yield tags, texts


def fit(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """The prototype of each non-null language: the bundle of all trigrams of all its texts.

    Every task sends one vector a language, summed by dimension in Spark, so the driver gets
    languages x DIMS numbers whatever the input. Texts without letters add nothing; no labelled
    texts give no prototypes."""

    def bundled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, sums = Encoder(), {}
        for b in batches:
            rows = zip(b.column(0).to_pylist(), as_bytes(b.column(1)), strict=True)
            for langs, texts in _chunks(rows):
                names, group = np.unique(langs, return_inverse=True)
                for name, v in zip(names.tolist(), enc.bundles(texts, group, len(names)), strict=True):
                    sums[name] = sums.get(name, 0) + v
        for lang, v in sums.items():
            cols = [pa.array([lang] * DIMS), pa.array(range(DIMS), pa.int32()), pa.array(v)]
            yield pa.RecordBatch.from_arrays(cols, names=["lang", "dim", "v"])

    known = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string"), text_col)
    made = known.mapInArrow(bundled, "lang string, dim int, v double")
    rows = made.groupBy("lang", "dim").agg(F.sum("v").alias("v")).collect()
    protos: dict[str, np.ndarray] = {}
    for r in rows:
        protos.setdefault(r.lang, np.zeros(DIMS))[r.dim] = r.v
    return {k: v for k, v in sorted(protos.items()) if v.any()}


def with_language(
    df: DataFrame, protos: dict[str, np.ndarray], *, text_col: str = "text",
    out: str = "lang_pred", score: str = "lang_score",
) -> DataFrame:
    """``df`` with the language whose prototype has the largest cosine with the whole text, and
    that cosine (0 if negative). Null texts, texts without letters, and all texts when nothing
    was learned: ``und`` and 0. Ties go to the first language in order."""
    names = list(protos)
    unit = np.array([protos[k] / np.linalg.norm(protos[k]) for k in names]).reshape(-1, DIMS)
    keep: list[Encoder] = []

    def judged(texts: Iterable[bytes | None]) -> list[list]:
        enc = keep[0] if keep else keep.append(Encoder()) or keep[0]
        langs, scores = [], []
        for _, part in _chunks((None, t) for t in texts):
            v = enc.bundles(part, np.arange(len(part)), len(part))
            size = np.linalg.norm(v, axis=1)
            cos = v @ unit.T / np.maximum(size, 1e-9)[:, None] if names else np.zeros((len(part), 1))
            best = cos.argmax(axis=1)
            known = [bool(names) and any(map(str.isalpha, t)) for t in part]
            langs += [names[i] if k else UNKNOWN for i, k in zip(best, known, strict=True)]
            top = np.clip(cos[np.arange(len(part)), best], 0, 1) * known
            scores += top.tolist()
        return [langs, scores]

    new = [(out, T.StringType(), pa.string()), (score, T.DoubleType(), pa.float64())]
    return with_columns(df, text_col, new, judged)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all ``documents``, learned from those not in fold 1 of 3."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    protos = fit(docs.where(fold(F.col("doc_id"), 3) != 1))
    found = with_language(docs.select("doc_id", "text"), protos)
    held_out = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out")
    return found.select("doc_id", held_out, "lang_pred", F.col("lang_score").alias("score"))
