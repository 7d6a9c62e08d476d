"""What the operators of this subpackage share: tables, the shared folder and lineage cuts."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from offerlens.session import ensure_checkpoint_dir

#: Fixed value: what counts as a word.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path under the folder that the cluster names in spark.checkpoint.dir."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet to the shared folder and read it back: later reads need no recomputation."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def worker_cache(name: str) -> dict:
    """A dict that lives as long as the Python worker, so that tasks reuse what earlier tasks made."""
    home = sys.modules.setdefault("_llm_worker_cache", types.ModuleType("_llm_worker_cache"))
    return home.__dict__.setdefault(name, {})


def drop_worker_caches() -> None:
    """Free what ``worker_cache`` keeps: steps that use none of it call this, since a reused worker brings it along from earlier steps."""
    sys.modules.pop("_llm_worker_cache", None)


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of equal keys, over batch borders; rows must arrive sorted by ``keys``."""
    held, parts = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch[k].to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows - 1, dtype=bool)
        for c in columns:
            new |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
        for a, z in zip(cuts, cuts[1:], strict=False):
            key = tuple(c[a] for c in columns)
            if parts and key != held:
                yield held, pa.Table.from_batches(parts)
                parts = []
            held = key
            parts.append(batch.slice(a, z - a))
    if parts:
        yield held, pa.Table.from_batches(parts)
