"""Incremental refresh: new export files are prepared and appended, old ones are not re-read.

A full reload of the table on every refresh does not scale; a file stream with checkpointed
progress processes each file once, and an interrupted run continues where it stopped.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from armwatch.operators.prepare import prepare_plasma, prepare_profile, prepare_safety
from armwatch.sources.contract import RAW_PLASMA, RAW_PROFILE, RAW_SAFETY
from armwatch.sources.tables import STRICT_CSV, save_rows

_MODULES = {"safety": (prepare_safety, RAW_SAFETY), "plasma": (prepare_plasma, RAW_PLASMA),
            "profile": (prepare_profile, RAW_PROFILE)}


def refresh_from_files(spark: SparkSession, module: str, source: str, header: Sequence[str],
                       target: str, missing: str, checkpoint: str,
                       edges: Mapping[str, Sequence[float]]) -> None:
    """Process every file in ``source`` not seen before and return when done.

    ``header`` is the header line of the export files. ``edges`` fixes the inner cut points of
    the quantile bins, so that rows of different batches fall into the same bins.
    """
    prepare, contract = _MODULES[module]
    contract.check(header, raw=True)

    def append(batch: DataFrame, batch_id: int) -> None:
        data, rejected = prepare(batch, edges=dict(edges))
        # One folder per batch, overwritten on a retry: a repeated batch adds nothing twice.
        save_rows(data, f"{target}/batch={batch_id}", mode="overwrite")
        save_rows(rejected, f"{missing}/batch={batch_id}", mode="overwrite")

    stream = (spark.readStream.schema(contract.struct(header, raw=True))
              .options(**STRICT_CSV).csv(source))
    (stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())
