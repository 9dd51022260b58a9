"""Interim progress of streams."""

from __future__ import annotations

import logging

from pyspark.sql.streaming import StreamingQueryListener

log = logging.getLogger(__name__)


class Progress(StreamingQueryListener):
    """Rows so far by query, kept in `rows` and logged after every micro-batch."""

    def __init__(self):
        self.rows: dict[str, int] = {}

    def onQueryStarted(self, event):
        self.rows[str(event.id)] = 0

    def onQueryProgress(self, event):
        key = str(event.progress.id)
        self.rows[key] = self.rows.get(key, 0) + event.progress.numInputRows
        log.info("batch %d of %s: %d rows so far", event.progress.batchId, key, self.rows[key])

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        if event.exception:
            log.error("%s ended: %s", event.id, event.exception)
