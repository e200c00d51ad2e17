"""Structured Streaming over append-only logs."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillon.sources.tables import shared_dir


def follow(spark: SparkSession, path: str, schema: str, *, kind: str = "json") -> DataFrame:
    """A stream of the files that are added to a folder."""
    return spark.readStream.schema(schema).format(kind).load(path)


def drain(stream: DataFrame, *, mode: str = "append", path: str | None = None) -> DataFrame:
    """Run a stream over all that is there, into Parquet with a checkpoint (each file counts once however
    often a run is repeated), and read the result."""
    spark = stream.sparkSession
    base = path or f"{shared_dir(spark)}/quillon-stream-{uuid.uuid4().hex}"
    query = (
        stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{base}/state")
        .trigger(availableNow=True).start(f"{base}/rows")
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


def checked(stream: DataFrame, text: str, seal: str) -> DataFrame:
    """The stream with ``tampered``: the text's SHA-256 isn't its seal."""
    return stream.withColumn("tampered", F.sha2(F.col(text), 256) != F.col(seal))


def claims(stream: DataFrame, key: str, order: str, discards: Column) -> DataFrame:
    """``(key, order, outcome)`` of a ledger of claims: a claim on a free key is ACCEPTED and on a taken one
    a COLLISION; a discard frees it (DISCARD), or finds it free (IGNORED). The state is one flag a key;
    the rows of a batch are taken in order."""
    kind = stream.schema[key].dataType.simpleString(), stream.schema[order].dataType.simpleString()

    def step(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        taken = state.get[0] if state.exists else False
        rows = pd.concat(list(parts)).sort_values("o")
        outcomes = []
        for gone in rows["gone"].tolist():
            outcomes.append(("DISCARD" if taken else "IGNORED") if gone else ("COLLISION" if taken else "ACCEPTED"))
            taken = not gone
        state.update((taken,))
        yield pd.DataFrame({key: [name[0]] * len(rows), order: rows["o"].tolist(), "outcome": outcomes})

    slim = stream.select(F.col(key).alias("k"), F.col(order).alias("o"), F.coalesce(discards, F.lit(False)).alias("gone"))
    schema = f"{key} {kind[0]}, {order} {kind[1]}, outcome string"
    return slim.groupBy("k").applyInPandasWithState(step, schema, "taken boolean", "append", GroupStateTimeout.NoTimeout)


def truncation_rate(stream: DataFrame, ts: str, arm: str, cut: Column, *, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Rate of cut rows by arm and tumbling window; windows close behind the watermark. An extension."""
    by = stream.withWatermark(ts, late).groupBy(F.window(ts, size).alias("w"), arm)
    out = by.agg(F.count("*").alias("n"), F.count_if(cut).alias("k"))
    return out.select(F.col("w.start").alias("start"), arm, "n", "k")


def append_index(stream: DataFrame, index: str, keys: Sequence[str]) -> None:
    """Add to a Parquet index the entries whose key it hasn't: a batch that is run again adds nothing."""
    spark = stream.sparkSession
    state = f"{index}-state"

    def add(batch: DataFrame, _: int) -> None:
        fresh = batch.dropDuplicates(list(keys))
        try:
            known = spark.read.parquet(index)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
                raise
        else:
            fresh = fresh.join(known.select(*keys), list(keys), "left_anti")
        fresh.write.mode("append").parquet(index)

    stream.writeStream.foreachBatch(add).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
