"""Documents put together from a stream of pages that come in any order (an extension).

State is kept for each document until its last page is there: a list of its pages and a timer. A document of which pages
are missing when the timer ends comes out with those that are there. State lives in the checkpoint, so a query that is
stopped or fails goes on where it was.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.pages import PAGE_END

DOCUMENTS = "doc_id long, text string, total_pages long, pages_with_text long, complete boolean"
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Pages(StatefulProcessor):
    """Holds a document's pages until there are as many as it has, or until it has waited long enough."""

    def __init__(self, wait_seconds: float):
        self.wait = int(wait_seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pages = handle.getListState("pages", "page_num int, page_text string")
        self.count = handle.getValueState("count", "n long, total long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, total = self.count.get() if self.count.exists() else (0, 0)
        if not n:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait)
        for batch in rows:
            self.pages.appendList([(int(p), t if isinstance(t, str) else "") for p, t in zip(batch["page_num"], batch["page_text"], strict=True)])
            n, total = n + len(batch), max(total, int(batch["total_pages"].max()))
        if n >= total:
            yield self._document(key, True)
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        else:
            self.count.update((n, total))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.count.exists():
            yield self._document(key, False)

    def _document(self, key: tuple, complete: bool) -> pd.DataFrame:
        pages = sorted((p, t) for p, t in self.pages.get())
        some = [t for _, t in pages if t.strip()]
        self.pages.clear()
        self.count.clear()
        text = "".join(t + PAGE_END for t in some)
        return pd.DataFrame([(key[0], text, len(pages), len(some), complete)], columns=["doc_id", "text", "total_pages", "pages_with_text", "complete"])

    def close(self) -> None:
        pass


def documents_of_pages(pages: DataFrame, wait_seconds: float = 3600.0) -> DataFrame:
    """A stream of documents, as operators.pages.assemble gives them, from a stream of pages (doc_id, page_num, total_pages,
    page_text); `complete` says whether all pages were there. Null texts are blank. Pages that come after their document
    is out begin it anew, and come out when the timer of `wait_seconds` ends."""
    pages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    own = pages.select("doc_id", "page_num", "total_pages", "page_text")
    return own.groupBy("doc_id").transformWithStateInPandas(_Pages(wait_seconds), outputStructType=DOCUMENTS, outputMode="append", timeMode="ProcessingTime")


def assemble_inbox(spark: SparkSession, inbox: str, table: str, checkpoint: str, wait_seconds: float = 3600.0) -> StreamingQuery:
    """Works off the files of pages in the inbox and stops; a later call goes on where this one ended, and looks at the
    timers. Batches without data are off for the session, or the timers would keep the query from ending."""
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    pages = spark.readStream.schema("doc_id long, page_num int, total_pages int, page_text string").option("maxFilesPerTrigger", 1).parquet(inbox)
    out = documents_of_pages(pages, wait_seconds)
    return out.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
