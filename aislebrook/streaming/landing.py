"""Sales files that arrive in a landing folder, streamed into the sales store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.cleaning import clean_sales
from ..sources.readers import union_files
from ..sources.sales_store import SalesStore


# Further columns of the store, and the header parts that identify them.
STORE_COLUMNS = {"AMOUNT": ["net_amount", "net amount", "amount"], "BILL_NO": ["bill_no", "bill no", "bill number"]}


def ingest_batch(store: SalesStore, raw: DataFrame, batch: int, source: str = "landing", origin: str | None = None) -> None:
    """Clean one batch of raw sales and store it as the origin's batch of this number, so
    a batch that is delivered again replaces itself and no other origin's."""
    store.append(clean_sales(raw, keep=STORE_COLUMNS), f"{source}-{batch}", batch, origin=origin or source)


def stream_origin(query_id: str) -> str:
    """Whose batch numbers a landing stream's are."""
    return f"landing {query_id}"


def landing_ingest(
    spark: SparkSession, landing: str, names: list[str], store: SalesStore, checkpoint: str, max_files: int = 1000
) -> StreamingQuery:
    """Process all CSV files now in the folder that no earlier run has seen. Every file
    has the header `names`; `max_files` bounds one batch, not the run."""
    raw = (
        spark.readStream.option("header", True)
        .option("maxFilesPerTrigger", max_files)
        .schema(", ".join(f"`{n}` string" for n in names))
        .csv(landing)
    )
    def ingest(df: DataFrame, batch: int) -> None:
        # The query's id lies in its checkpoint: a new checkpoint counts batches anew.
        query = df.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        ingest_batch(store, df, batch, origin=stream_origin(query))

    return (
        raw.writeStream.foreachBatch(ingest)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def ingest_attachments(store: SalesStore, files: list[DataFrame], source: str, batch: int) -> None:
    """Store the sales of several attachments as one batch."""
    store.append(clean_sales(union_files(files), keep=STORE_COLUMNS), source, batch)
