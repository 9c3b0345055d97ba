"""Rows in blocks, and a dictionary for each block: how a text meets a table of counts that no task can hold.

Documents go to blocks of some megabytes of text. Every block asks for the different keys of its texts once, the keys are
joined with the sharded table, and the answers go back to the block. What a task holds is one block and its answers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datascry.llm.base import partitions, text_bytes

BLOCK_BYTES = 16 << 20


def in_blocks(docs: DataFrame, text_col: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`docs` with a column _block, one shuffle. Rows are dealt by their number, so equal ids or texts do not meet in one block."""
    n_blocks = max(1, -(-text_bytes(docs, text_col) // block_bytes))
    n_blocks = max(n_blocks, min(partitions(docs.sparkSession), 8))
    dealt = docs.withColumn("_block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_blocks)).cast("int"))
    return dealt.repartition(max(n_blocks, partitions(docs.sparkSession)), "_block")


def answered(blocked: DataFrame, answers: DataFrame, run: Callable, schema: str) -> DataFrame:
    """run(rows, answers) -> pandas frame, once per block, with the block's rows and its answers (none: an empty frame)."""

    def both(rows, found):
        return run(rows, found)

    return blocked.groupBy("_block").cogroup(answers.groupBy("_block")).applyInPandas(both, schema)
