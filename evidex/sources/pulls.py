"""Scheduled pulls: which sources are due, and one run over those that are. An outside clock calls ``run_due``."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Pull:
    """A source with the queries it is asked and how often; ``read`` gives the documents of one query, from saved answers or a service."""

    source: str
    every: dt.timedelta
    read: Callable[[str], DataFrame]
    queries: tuple[str, ...] = field(default=("",))


def due(pulls: list[Pull], last: dict[str, dt.datetime], now: dt.datetime) -> list[Pull]:
    """The pulls never run, or last run at least their interval ago."""
    return [p for p in pulls if p.source not in last or now - last[p.source] >= p.every]


def run_due(pulls: list[Pull], last: dict[str, dt.datetime], now: dt.datetime, ingest: Callable[[DataFrame, str], object], tries: int = 3) -> dict[str, str]:
    """Runs what is due: all queries of a source are one batch for ``ingest`` (documents, source). Returns a status by source.

    A query that fails ``tries`` times is left out; a source is ``failed`` if all of its queries or the
    ingestion fail, ``partial`` if some do, else ``completed``. One failing source does not stop the others.
    """
    status = {}
    for pull in due(pulls, last, now):
        found, lost = None, 0
        for query in pull.queries:
            for attempt in range(tries):
                try:
                    rows = pull.read(query)
                    found = rows if found is None else found.unionByName(rows, allowMissingColumns=True)
                    break
                except Exception:  # a service's failures are of any kind
                    lost += attempt + 1 == tries
        try:
            if found is None:
                raise LookupError("no query gave an answer")
            ingest(found, pull.source)
            status[pull.source] = "partial" if lost else "completed"
        except Exception:
            status[pull.source] = "failed"
    return status
