"""Counts of what a stream did, observed on the way: its output is not read again."""

from __future__ import annotations

import threading
from collections import Counter

from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


class ObservedCounts(StreamingQueryListener):
    """Sums of the counts that the batches of one run of a query observed under a name.

    A batch is counted when its progress is reported, which is after it has been written; one that failed and runs
    again in a later run is counted there.
    """

    def __init__(self, name: str) -> None:
        self.name = name
        self.counts: dict[str, Counter] = {}
        self.over: dict[str, threading.Event] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        row = event.progress.observedMetrics.get(self.name)
        if row is not None:
            own = self.counts.setdefault(str(event.progress.runId), Counter())
            own.update({k: v or 0 for k, v in row.asDict().items()})

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.over.setdefault(str(event.runId), threading.Event()).set()

    def of(self, run: StreamingQuery, timeout: float = 60.0) -> Counter:
        """The sums of a run that has ended; its last event may still be on the way."""
        self.over.setdefault(str(run.runId), threading.Event()).wait(timeout)
        return self.counts.get(str(run.runId), Counter())
