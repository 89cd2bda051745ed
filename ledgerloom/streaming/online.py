"""Features of events as they arrive, in keyed state: velocity, first use of a device, first country.

A customer's state is one value: the recent payments in order of time, the devices, the first country and the last event.
It is read and written once per micro-batch, whatever the number of events, and each event costs a binary search. All of
it expires together: an event that comes more than the time to live after the customer's last one finds nothing, and
every event renews all of it; the store drops what no event renews. An event that was seen before gets its cached
answer and changes nothing. Rows of a micro-batch are taken in the order of ``seq``; a customer's share of a micro-batch
is held in memory, which the source's limit of rows per trigger bounds.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

WINDOW_MS = 300_000
TTL_MS = 2_592_000_000
OUTPUT = "customer_id string, event_id string, velocity int, new_device boolean, cross_border boolean, baseline_country string"
#: The session setting that the keyed state needs.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class Customer:
    """What is known of one customer."""

    def __init__(self, last: int | None = None, home: str | None = None, payments: list[str] = (), instants: list[int] = (), devices: list[str] = ()):
        self.last, self.home = last, home
        self.at = dict(zip(payments, instants, strict=True))
        self.line = sorted(zip(instants, payments, strict=True))
        self.devices = dict.fromkeys(devices)

    def stored(self) -> tuple:
        return self.last, self.home, [p for _, p in self.line], [ms for ms, _ in self.line], list(self.devices)

    def observe(self, payment: str, device: str, country: str, ms: int, window_ms: int, ttl_ms: int) -> tuple:
        """(velocity, new_device, cross_border, baseline_country) of an event; the event counts itself."""
        if self.last is not None and ms - self.last > ttl_ms:
            self.__init__()
        if self.last is None:
            self.home = country
        self.last = ms if self.last is None else max(self.last, ms)
        for _, outdated in self.line[: bisect_left(self.line, (ms - window_ms,))]:
            del self.at[outdated]
        del self.line[: bisect_left(self.line, (ms - window_ms,))]
        if payment in self.at:
            self.line.pop(bisect_left(self.line, (self.at[payment], payment)))
        self.at[payment] = ms
        insort(self.line, (ms, payment))
        velocity = bisect_right(self.line, ms, key=lambda entry: entry[0])
        fresh = device not in self.devices
        self.devices[device] = None
        return velocity, fresh, self.home != country, self.home


class CustomerFeatures(StatefulProcessor):
    """Input: customer_id, event_id, payment_id, device_id, country, ms, seq."""

    def __init__(self, window_ms: int = WINDOW_MS, ttl_ms: int = TTL_MS):
        self.window_ms, self.ttl_ms = window_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.customer = handle.getValueState("customer", "last bigint, home string, payments array<string>, instants array<bigint>, devices array<string>", self.ttl_ms)
        self.answers = handle.getMapState("answers", "event_id string", "velocity int, new_device boolean, cross_border boolean, baseline_country string", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        events = pd.concat(list(rows)).sort_values("seq", kind="stable")
        known = Customer(*self.customer.get()) if self.customer.exists() else Customer()
        out, fresh = [], {}
        for e in events.itertuples(index=False):
            answer = fresh.get(e.event_id)
            if answer is None and self.answers.containsKey((e.event_id,)):
                answer = tuple(self.answers.getValue((e.event_id,)))
            if answer is None:
                answer = fresh[e.event_id] = known.observe(e.payment_id, e.device_id, e.country, int(e.ms), self.window_ms, self.ttl_ms)
            out.append((key[0], e.event_id, *answer))
        for event_id, answer in fresh.items():
            self.answers.updateValue((event_id,), answer)
        if fresh:
            self.customer.update(known.stored())
        yield pd.DataFrame(out, columns=["customer_id", "event_id", "velocity", "new_device", "cross_border", "baseline_country"])

    def close(self) -> None:
        pass


def online_features(events: DataFrame, window_ms: int = WINDOW_MS, ttl_ms: int = TTL_MS) -> DataFrame:
    """The features of a stream of events; needs the RocksDB state store."""
    return events.groupBy("customer_id").transformWithStateInPandas(CustomerFeatures(window_ms, ttl_ms), OUTPUT, "Append", "ProcessingTime")


class FirstAnswers(StatefulProcessor):
    """Keeps the first answer of each key and gives it to all that ask later; it expires some time after it was given."""

    def __init__(self, ttl_ms: int = TTL_MS):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", "answer string", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        asked = pd.concat(list(rows)).sort_values("seq", kind="stable")
        if not self.kept.exists():
            self.kept.update((asked["answer"].iloc[0],))
        yield pd.DataFrame({"cache_key": key[0], "seq": asked["seq"], "answer": self.kept.get()[0]})

    def close(self) -> None:
        pass


def cached_answers(answers: DataFrame, ttl_ms: int = TTL_MS) -> DataFrame:
    """(cache_key, seq, answer): of all answers ever given for a key, such as decisions of a source event, the first wins.

    Input: cache_key, answer (text, not null), seq. Needs the RocksDB state store.
    """
    return answers.groupBy("cache_key").transformWithStateInPandas(FirstAnswers(ttl_ms), "cache_key string, seq bigint, answer string", "Append", "ProcessingTime")
