"""Continuous ingest: each micro-batch of documents becomes a segment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from findery.plans.index import SearchIndex
from findery.sources.documents import normalized


def stream_into(raw: DataFrame, index: SearchIndex, checkpoint: str, upsert: bool = True, available_now: bool = False) -> StreamingQuery:
    """Feeds a streaming DataFrame of raw documents to the index, by update or by add.

    An update replaces the documents of the same keys, so a batch that is delivered again leaves the same documents live.
    """

    def batch(df: DataFrame, _: int) -> None:
        docs = normalized(df)
        index.update(docs) if upsert else index.add(docs)

    writer = raw.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
