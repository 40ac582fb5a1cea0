"""Arrow batches that bring only so much text to a Python worker at once."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Most rows and bytes of a batch.
ROWS, BYTES = 1000, 4 << 20


def bounded(df: DataFrame) -> DataFrame:
    """df, with its session's batches no larger than these, also when df is read later: 10,000 long texts fill a worker's memory."""
    conf = df.sparkSession.conf
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(rows)) <= ROWS:
        conf.set(rows, str(ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BYTES))
    return df
