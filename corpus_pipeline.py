"""The corpus pipeline: documents to a deduplicated, clean, weighted sample.

Each stage works on all that the one before kept, written as Parquet and read
again, as a cluster would between jobs.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from voxmill.llm import common, decontam, langid, mixing, pii, simhash

STAGES = [
    ("language", langid.stage),
    ("near_duplicates", simhash.stage),
    ("decontamination", decontam.stage),
    ("pii", pii.stage),
    ("mixing", mixing.stage),
]

#: Hashes, Bloom filters and ciphers of the stages aren't in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """All stages over the documents of ``sf_dir``.

    With a shared ``folder``, stages that were written there to their end are
    read again, so a run that stopped goes on where it was.  Checkpoints and
    scratch tables of a stage are deleted once it is written, and without a
    ``folder`` so is the stage before.
    """
    docs, before = common.table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        out = os.path.join(folder, f"{k}-{name}") if folder else common.scratch(spark, f"stage-{name}")
        if not (folder and common.complete(spark, out)):
            with common.swept(spark):
                stage(spark, docs, sf_dir).write.mode("overwrite").parquet(out)
        if before and not folder:
            common.delete(spark, before)
        docs, before = spark.read.parquet(out), out
    return docs
