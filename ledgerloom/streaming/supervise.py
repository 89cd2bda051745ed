"""Keeps a set of streaming queries together: one that ends takes the others with it."""

from __future__ import annotations

import json
import signal
import threading
import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def supervise(queries: Sequence[StreamingQuery], poll_s: float = 1.0, stop: threading.Event | None = None) -> int:
    """0 after a signal or ``stop``; 1 if a query ended by itself. All queries are stopped before it returns."""
    asked = stop or threading.Event()
    if threading.current_thread() is threading.main_thread():
        for s in (signal.SIGTERM, signal.SIGINT):
            signal.signal(s, lambda *_: asked.set())
    code = 0
    try:
        while not asked.wait(poll_s):
            if any(not q.isActive for q in queries):
                code = 1
                break
    finally:
        for q in queries:
            if q.isActive:
                q.stop()
    return code


def _offsets(value: object) -> dict[tuple[str, str], int]:
    """Offsets by topic and partition, from the JSON that Spark reports; none for sources that have no such offsets."""
    try:
        parsed = json.loads(value) if isinstance(value, str) else value
        return {(topic, p): int(o) for topic, parts in parsed.items() for p, o in parts.items()}
    except (ValueError, TypeError, AttributeError):
        return {}


def lag(query: StreamingQuery) -> list[dict[str, object]]:
    """(source, topic, partition, lag) as of a query's last progress: records of the broker that it has not taken yet.

    Never below zero: the end may be newer than the broker's last answer. Sources without broker offsets give no rows.
    """
    progress = query.lastProgress
    sources = progress["sources"] if isinstance(progress, dict) else (progress.sources if progress else [])
    out = []
    for s in sources:
        get = s.get if isinstance(s, dict) else lambda k, s=s: getattr(s, k, None)
        end, latest = _offsets(get("endOffset")), _offsets(get("latestOffset"))
        out += [{"source": get("description"), "topic": t, "partition": int(p), "lag": max(0, latest[t, p] - end.get((t, p), 0))} for t, p in sorted(latest)]
    return out


def retrying(each: Callable[[DataFrame, int], None], attempts: int = 5, first_s: float = 0.1, longest_s: float = 5.0, transient: tuple[type[Exception], ...] = (OSError, TimeoutError, ConnectionError), sleep: Callable[[float], None] = time.sleep) -> Callable[[DataFrame, int], None]:
    """``each`` of a micro-batch, tried again after ``transient`` errors with doubling waits; the last error is raised.

    A batch's tables are committed once, so trying again is harmless. Other errors are raised at once.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        for attempt in range(attempts):
            try:
                return each(batch, batch_id)
            except transient:
                if attempt == attempts - 1:
                    raise
                sleep(min(longest_s, first_s * 2**attempt))

    return run
