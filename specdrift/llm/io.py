"""Reading the given tables and what is beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from specdrift.plans.shared import discard, remove, shared_dir, stored  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def extended(schema: StructType, ddl: str) -> StructType:
    """A new schema: the fields of ``schema`` and then those of ``ddl``."""
    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public tokenizer file is on this machine (and on every executor)."""
    import public_tokenizers

    return public_tokenizers.path(name)
