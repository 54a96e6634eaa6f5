"""Materialised views: a query's rows kept as a written table, refreshed when asked or as a stream arrives."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from weftgraph.session import GraphSession
from weftgraph.sources.snapshots import snapshot


class MaterializedView:
    """The rows of a query as of its last refresh."""

    def __init__(self, session: GraphSession, text: str, params: dict[str, Any] | None = None):
        self.session, self.text, self.params = session, text, params
        self.rows: DataFrame = snapshot(session.compile(text, params))

    def refresh(self) -> DataFrame:
        self.rows = snapshot(self.session.compile(self.text, self.params))
        return self.rows

    def follow(self, stream: DataFrame, take: Callable[[DataFrame], None], **options: Any) -> StreamingQuery:
        """For each micro-batch of a stream: take(batch), which changes the graph, then a refresh."""

        def batch(df: DataFrame, _: int) -> None:
            take(df)
            self.refresh()

        writer = stream.writeStream.foreachBatch(batch)
        for k, v in options.items():
            writer = writer.trigger(**v) if k == "trigger" else writer.option(k, v)
        return writer.start()
