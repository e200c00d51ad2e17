"""Token counts by an exact histogram of encoded lengths."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillon.llm.common import materialize, table, with_columns

#: A rank file of a byte-level BPE: base64 token and rank on each line.
VOCABULARY = os.environ.get("QUILLON_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
CONTEXTS = (128, 256, 512, 1024, 2048, 4096, 8192, 16384, 32768)
QUANTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


_ENCODERS: dict[str, object] = {}


def encoder(ranks: bytes, pattern: str):  # noqa: ANN201
    """The encoding of the content of a rank file, made once in each worker."""
    import base64

    import tiktoken

    name = hashlib.sha256(ranks).hexdigest()
    if name not in _ENCODERS:
        made = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _ENCODERS[name] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=made, special_tokens={})
    return _ENCODERS[name]


def with_length(
    docs: DataFrame, *, text_col: str = "text", out: str = "n_tokens", vocabulary: str = VOCABULARY
) -> DataFrame:
    """``docs`` with the encoded length of each whole text; null and empty texts have 0. Only the driver
    reads the vocabulary; executors get its content (some MB) as a broadcast."""
    import public_tokenizers

    with open(vocabulary, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())
    pattern, kept = public_tokenizers.PATTERN, []

    def counted(texts: Iterable[bytes | None]) -> list[list]:
        if not kept:
            kept.append(encoder(ranks.value, pattern))
        enc = kept[0]
        return [[len(enc.encode_ordinary(t.decode("utf-8", "replace"))) if t else 0 for t in texts]]

    return with_columns(docs, text_col, [(out, T.LongType(), pa.int64())], counted)


def histogram(docs: DataFrame, *, length_col: str = "n_tokens") -> DataFrame:
    """``(length, docs, tokens, docs_from, tokens_from, docs_to)``: documents of each length, and those
    at least (``_from``) or at most (``_to``) as long. Only a row for each length is ever sorted,
    and there are no more lengths than tokens in the longest text. Null lengths don't count."""
    by = docs.where(F.col(length_col).isNotNull()).groupBy(F.col(length_col).alias("length"))
    by = by.agg(F.count("*").alias("docs"))
    by = by.withColumn("tokens", F.col("length") * F.col("docs"))
    down, up = Window.orderBy(F.desc("length")), Window.orderBy("length")
    return by.select(
        "length", "docs", "tokens", F.sum("docs").over(down).alias("docs_from"),
        F.sum("tokens").over(down).alias("tokens_from"), F.sum("docs").over(up).alias("docs_to"),
    )


def answers(hist: DataFrame, *, contexts: Sequence[int] = CONTEXTS, quantiles: Sequence[float] = QUANTILES) -> DataFrame:
    """``(measure, at, value)`` from the histogram alone: documents, tokens, the shortest length that
    a share of documents doesn't exceed, and for each context limit the documents beyond it, the
    tokens kept when texts are cut to it, and those lost.

    A limit reads one row, that of the shortest length beyond it: its suffix sums are the documents and
    tokens beyond the limit. No documents: sums 0, quantiles null."""
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("double")
    n, all_tokens = F.max("docs_from"), zero(F.max("tokens_from"))
    rows = [("documents", 0.0, zero(n)), ("tokens", 0.0, all_tokens)]
    hist = hist.join(F.broadcast(hist.agg(n.alias("all"))))
    for q in quantiles:
        rows.append(("quantile", float(q), F.min(F.when(F.col("docs_to") >= F.col("all") * q, F.col("length"))).cast("double")))
    for c in contexts:
        beyond = F.min(F.when(F.col("length") > c, F.struct("length", "docs_from", "tokens_from")))
        lost = zero(beyond["tokens_from"]) - zero(beyond["docs_from"]) * c
        rows.append(("docs_over", float(c), zero(beyond["docs_from"])))
        rows.append(("tokens_kept", float(c), all_tokens - lost))
        rows.append(("tokens_lost", float(c), lost))
    made = hist.agg(*(v.alias(f"v{i}") for i, (_, _, v) in enumerate(rows)))
    pairs = [F.struct(F.lit(m).alias("measure"), F.lit(a).alias("at"), F.col(f"v{i}").alias("value")) for i, (m, a, _) in enumerate(rows)]
    return made.select(F.explode(F.array(*pairs)).alias("r")).select("r.*")


def every_limit(hist: DataFrame) -> DataFrame:
    """``(measure, at, value)`` for the context limits where anything changes: the documents of each length
    that occurs, those beyond it, and the tokens kept and lost when texts are cut to it."""
    kept = F.col("all_tokens") - F.col("lost")
    docs_beyond, tokens_beyond = F.col("docs_from") - F.col("docs"), F.col("tokens_from") - F.col("tokens")
    rows = hist.join(F.broadcast(hist.agg(F.max("tokens_from").alias("all_tokens"))))
    rows = rows.withColumn("lost", tokens_beyond - docs_beyond * F.col("length"))
    found = {"docs_of_length": F.col("docs"), "docs_over": docs_beyond, "tokens_kept": kept, "tokens_lost": F.col("lost")}
    pairs = [F.struct(F.lit(m).alias("measure"), F.col("length").cast("double").alias("at"), v.cast("double").alias("value")) for m, v in found.items()]
    return rows.select(F.explode(F.array(*pairs)).alias("r")).select("r.*")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all ``documents`` from the histogram of their encoded lengths: totals, quantiles,
    and what is kept and lost at the usual context limits and at every length that occurs."""
    docs = table(spark, sf_dir, "documents").select("text")
    hist = materialize(histogram(with_length(docs)), "histogram")
    return answers(hist).union(every_limit(hist)).distinct()
