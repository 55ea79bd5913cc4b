"""Long runs over keyed inputs that can be stopped anywhere and go on: what is done is a table, what is left an anti-join.

    root/contract        what the run was asked to do, written once; a run under another contract is refused
    root/outputs         results by key, in versions
    root/done            key, digest of its input, digest and number of its results, in versions

Pages of keys are worked on one after another. Each page's results become visible at once, then its keys are noted as done; a
page that was stopped between the two is done again and replaces its own results, so the end is the same.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import versions
from tessera.operators.integrity import finished, row_digest, state


class OtherContract(RuntimeError):
    """The run's folder belongs to a run that was asked to do something else."""


def contract_digest(contract: dict) -> str:
    return hashlib.sha256(json.dumps(contract, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def remaining(inputs: DataFrame, done: DataFrame | None, key: str) -> DataFrame:
    """Inputs with their digest that are not done yet, or were done for another input."""
    dated = inputs.withColumn("input_digest", row_digest(inputs.columns))
    return dated if done is None else dated.join(done.select(key, "input_digest"), [key, "input_digest"], "left_anti")


def run(spark: SparkSession, inputs: DataFrame, key: str, contract: dict, work: Callable[[DataFrame], DataFrame], root: str, pages: int = 8) -> DataFrame:
    """The results of work(inputs) by key, going on from where a run of the same contract stopped.

    inputs: one row a key. work gives rows with the key, none or more for each input. Returns the table done.
    """
    try:
        versions.write_once(spark, f"{root}/contract", {"contract": contract, "digest": contract_digest(contract)})
    except ValueError as e:
        raise OtherContract(f"{root} belongs to a run with another contract") from e
    for page in range(pages):
        here = inputs.where(F.pmod(F.xxhash64(key), F.lit(pages)) == page)
        done = versions.read(spark, f"{root}/done") if versions.numbers(spark, f"{root}/done") else None
        left = remaining(here, done, key)
        if left.isEmpty():
            continue
        made = work(left.drop("input_digest"))
        keys = left.select(key, "input_digest")
        versions.merge(spark, f"{root}/outputs", made, [key], [key], combine=lambda old, new, k=keys: old.join(k.select(key), key, "left_anti").unionByName(new), drop=keys)
        stored = versions.read(spark, f"{root}/outputs").join(keys.select(key), key, "left_semi")
        told = finished(state(stored, [c for c in stored.columns], [key])).select(key, F.col("digest").alias("output_digest"), "n_rows")
        versions.merge(spark, f"{root}/done", keys.join(told, key, "left").na.fill(0, ["n_rows"]), [key], [key])
    return versions.read(spark, f"{root}/done")
