"""Pages that arrive in a folder, read as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lectern.operators.extract import extract
from lectern.operators.speech import speechify
from lectern.settings import Settings
from lectern.sources.tables import readable

PAGE_SCHEMA = "page_id long, url string, html string"


def read_pages(spark: SparkSession, folder: str, files_at_once: int = 64) -> DataFrame:
    return spark.readStream.schema(PAGE_SCHEMA).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def write_utterances(pages: DataFrame, out: str, checkpoint: str, cfg: Settings | None = None, **trigger) -> StreamingQuery:
    """Utterances of each micro-batch, in a folder named by its number, so a batch that is run again replaces itself."""

    def batch(rows: DataFrame, number: int) -> None:
        speechify(extract(readable(rows)), cfg).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return pages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
