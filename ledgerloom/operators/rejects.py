"""Rows that fail to parse: valid ones become typed envelopes, each other one keeps its raw value and gets its reasons.

One pass parses each value strictly and walks it against the contract of its topic. It finds the structural faults, and
gives the values at the contract's fields as text. What is nearly unique (ids, texts, instants, numbers) is cast there.
The columns with few distinct values (enums, booleans, codes, lists of codes, integers) are only read there: their
distinct values are found by partial aggregation, each is cast once, and those that can't be cast make the invalid-value
dictionary with their reasons. The dictionary is joined back to the rows, by broadcast while its measured size allows it.
What has a structural fault or an invalid value is rejected with all its reasons, the rest is the loaded table: valid
rows, rejected rows and dictionary come from the same pass, which is written once. Valid rows are never shuffled.

JSON strictness (RFC 8259) and numbers as written can't be had from Spark's JSON functions, which is why the pass is in
Python, with Arrow batches; everything after it is joins, aggregates and casts of Spark.

Defined results: a null value, an empty text and a topic without contract are rejected; a name that occurs twice in an
object is allowed if each of its values is valid, and the last one counts; very long and deeply nested values are
parsed whole (nesting beyond the interpreter's stack is rejected as malformed); values that aren't UTF-8 are rejected;
rows are told apart by a number of their own, so equal rows and null coordinates get their own results; an empty table
gives empty results; other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.contracts import Bad, Contract, Number, contracts_of, parse_json
from ledgerloom.session import materialize

#: Rows of the contract table at most; it describes formats and doesn't grow with the data.
MAX_CONTRACT_ROWS = 10_000
#: Bytes of the values and reasons of one column that a task remembers; then it starts anew.
REMEMBERED_BYTES = 4 << 20
#: Bytes of a table that may be broadcast: the dictionary, and the numbers of the rows that it rejects.
MAX_BROADCAST_BYTES = 32 << 20
#: Kinds whose columns have few distinct values.
FEW_VALUES = ("enum", "boolean", "code", "code_list", "integer")
COORDINATES = ["source_topic", "source_partition", "source_offset"]

_ROW = "rid bigint, source_topic string, source_partition int, source_offset bigint, kafka_micros bigint"
_SCREEN = f"{_ROW}, raw binary, faults array<string>, suspects array<struct<path:string,token:string,reason:string>>, cells array<string>, more array<struct<k:int,token:string>>"
_ARROW = pa.schema([
    ("rid", pa.int64()), ("source_topic", pa.string()), ("source_partition", pa.int32()), ("source_offset", pa.int64()), ("kafka_micros", pa.int64()), ("raw", pa.binary()), ("faults", pa.list_(pa.string())),
    ("suspects", pa.list_(pa.struct([("path", pa.string()), ("token", pa.string()), ("reason", pa.string())]))), ("cells", pa.list_(pa.string())), ("more", pa.list_(pa.struct([("k", pa.int32()), ("token", pa.string())]))),
])


def read_contracts(fields: DataFrame) -> dict[str, Contract]:
    rows = [r.asDict() for r in fields.limit(MAX_CONTRACT_ROWS + 1).collect()]
    if len(rows) > MAX_CONTRACT_ROWS:
        raise ValueError(f"more than {MAX_CONTRACT_ROWS} contract fields")
    return contracts_of(rows)


def _token(value: object) -> str:
    """A value as JSON text in ASCII, numbers as written: the key of the dictionary."""
    if isinstance(value, Number):
        return str.__str__(value)
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k)}:{_token(v)}" for k, v in value.items()) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_token, value)) + "]"
    return json.dumps(value)


def _clean(text: str) -> str:
    """Text that UTF-8 can hold: a lone half of a surrogate pair becomes the replacement character."""
    return text if text.isascii() else text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


class Reader:
    """What the pass does with the messages of one contract."""

    def __init__(self, contract: Contract):
        self.contract = contract
        in_pairs = {k for pair in contract.equal for k in pair}
        #: Rules whose values are judged by the dictionary; those that are compared with each other are cast here.
        self.listed = {k for k, r in enumerate(contract.rules) if r.kind in FEW_VALUES and k not in in_pairs}
        self.known: dict[tuple, tuple] = {}
        self.held = 0

    def _cast(self, k: int, value: object) -> tuple[object, str | None]:
        """(the cast value or the ``Bad`` that says why there is none, its text)."""
        key = (k, type(value), value if isinstance(value, (str, bool)) or value is None else _token(value))
        found = self.known.get(key)
        if found is None:
            try:
                cast = self.contract.rules[k].cast(value)
                found = (cast, None if isinstance(cast, dict) else _token(value) if isinstance(cast, list) else _clean(str(cast)))
            except Bad as bad:
                found = (bad, _token(value))
            self.held += 200 + len(found[1] or "") * 2
            if self.held > REMEMBERED_BYTES:
                self.known.clear()
                self.held = 0
            self.known[key] = found
        return found

    def read(self, message: object) -> tuple[list[str], list[dict], list[str | None], list[dict]]:
        """(structural faults, suspects with their reasons, the text of each rule's last value, further listed values)."""
        faults, values = self.contract.walk(message)
        suspects, more, last = [], [], {}
        cells: list[str | None] = [None] * len(values)
        for k, found in enumerate(values):
            if k in self.listed:
                tokens = [_token(v) for v in found]
                more += [{"k": k, "token": t} for t in tokens[:-1]]
                cells[k] = tokens[-1] if tokens else None
                continue
            for value in found:
                cast, text = self._cast(k, value)
                if isinstance(cast, Bad):
                    suspects.append({"path": self.contract.rules[k].path, "token": text, "reason": str(cast)})
                else:
                    last[k], cells[k] = cast, text
        for a, b in self.contract.equal:
            if a in last and b in last and last[a] != last[b]:
                faults.append(f"differs:{self.contract.rules[a].path}")
        return faults, suspects, cells, more


def _decode(raw: bytes | None) -> tuple[object, str | None]:
    if raw is None:
        return None, "null_value"
    try:
        return parse_json(raw.decode("utf-8")), None
    except ValueError:
        return None, "malformed_json"


def _screen(contracts: dict[str, Contract], load: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers = {topic: Reader(c) for topic, c in contracts.items()}
        kept = {topic: [load or k in r.listed for k in range(len(r.contract.rules))] for topic, r in readers.items()}
        rid = TaskContext.get().partitionId() << 40
        for batch in batches:
            out: list[list] = [[] for _ in _ARROW]
            for topic, partition, offset, micros, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                reader, suspects, cells, more = readers.get(topic), [], [], []
                if reader is None:
                    faults = ["unknown_topic"]
                else:
                    message, fault = _decode(raw)
                    if fault:
                        faults = [fault]
                    else:
                        faults, suspects, cells, more = reader.read(message)
                        if not load:
                            cells = [c if keep else None for c, keep in zip(cells, kept[topic], strict=True)]
                for into, value in zip(out, (rid, topic, partition, offset, micros, raw if load else None, faults, suspects, cells, more), strict=True):
                    into.append(value)
                rid += 1
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, _ARROW, strict=True)], schema=_ARROW)

    return run


def _input(records: DataFrame) -> DataFrame:
    return records.select(
        F.col("source_topic").cast("string"), F.col("source_partition").cast("int"), F.col("source_offset").cast("bigint"),
        F.unix_micros("kafka_timestamp").alias("kafka_micros"), F.col("raw_value").cast("binary").alias("raw"),
    )


def _cast_once(contracts: dict[str, Contract]):
    """Distinct values (topic, k, token) to those that can't be cast, with the reason."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for topic, k, token in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rule = contracts[topic].rules[k]
                try:
                    rule.cast(parse_json(token))
                except Bad as bad:
                    for into, value in zip(out, (topic, k, rule.path, token, str(bad)), strict=True):
                        into.append(value)
            kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], names=["source_topic", "k", "path", "token", "reason"])

    return run


def _small(df: DataFrame, size: Column) -> DataFrame:
    """``df`` as a broadcast side if it measures little enough."""
    return F.broadcast(df) if (df.agg(F.sum(size).alias("b")).first()["b"] or 0) <= MAX_BROADCAST_BYTES else df


class Screened:
    """The outcome of the pass over the broker records, written once to the shared folder.

    Without ``load`` it keeps only what tells which records fail and why.
    """

    def __init__(self, records: DataFrame, fields: DataFrame, load: bool = True):
        self.contracts = read_contracts(fields)
        self.found = materialize(_input(records).mapInArrow(_screen(self.contracts, load), _SCREEN), "screened")
        listed = self._listed(self.found, [])
        distinct = listed.groupBy("source_topic", "k", "token").agg(F.lit(1).alias("_")).drop("_")
        invalid = distinct.mapInArrow(_cast_once(self.contracts), "source_topic string, k int, path string, token string, reason string")
        self.dictionary = materialize(invalid, "dictionary")
        joined = self._listed(self.found, ["rid", *COORDINATES]).join(_small(self.dictionary, F.octet_length("token") + 100), ["source_topic", "k", "token"])
        #: (rid, coordinates, fault) of the rows that the dictionary rejects.
        self.by_value = materialize(joined.select("rid", *COORDINATES, F.concat_ws(":", "reason", "path").alias("fault")), "by-value")

    def _listed(self, rows: DataFrame, keep: list[str]) -> DataFrame:
        """One row per value of the listed columns: ``keep``, source_topic, k, token."""
        which = {t: Reader(c).listed for t, c in self.contracts.items()}
        of_topic = F.coalesce(*[F.when(F.col("source_topic") == t, F.array(*[F.lit(k) for k in sorted(ks)]).cast("array<int>")) for t, ks in which.items()], F.array().cast("array<int>")) if which else F.array().cast("array<int>")
        cells = F.transform(of_topic, lambda k: F.struct(k.alias("k"), F.get("cells", k).alias("token")))
        every = F.explode(F.filter(F.concat(cells, F.col("more")), lambda c: c["token"].isNotNull()))
        return rows.select(*{**dict.fromkeys(keep), "source_topic": None}, every.alias("c")).select("*", "c.k", "c.token").drop("c")

    def _at_once(self) -> Column:
        return (F.size("faults") > 0) | (F.size("suspects") > 0)

    def _by_value_ids(self) -> DataFrame:
        return _small(self.by_value.select("rid").distinct(), F.lit(16))

    def invalid_values(self) -> DataFrame:
        """The invalid-value dictionary of all columns: (source_topic, path, token, reason)."""
        others = self.found.select("source_topic", F.explode("suspects").alias("s")).select("source_topic", "s.*")
        once = others.groupBy("source_topic", "path", "token", "reason").agg(F.lit(1).alias("_")).drop("_")
        return self.dictionary.drop("k").unionByName(once)

    def rejected(self) -> DataFrame:
        """Coordinates, raw value and sorted reasons of every row that fails."""
        by_value = self.by_value.groupBy("rid").agg(F.collect_set("fault").alias("by_value"))
        named = F.transform("suspects", lambda s: F.concat_ws(":", s["reason"], s["path"]))
        joined = self.found.join(_small(by_value, F.lit(400)), "rid", "left").filter(self._at_once() | F.col("by_value").isNotNull())
        none = F.array().cast("array<string>")
        return joined.select(
            *COORDINATES, F.timestamp_micros("kafka_micros").alias("kafka_timestamp"), F.col("raw").cast("string").alias("_corrupt_record"),
            F.array_sort(F.array_distinct(F.concat("faults", named, F.coalesce("by_value", none)))).alias("reasons"),
        )

    def coordinates(self) -> DataFrame:
        """One row per failing record."""
        at_once = self.found.filter(self._at_once()).select("rid", *COORDINATES)
        both = at_once.unionByName(self.by_value.select("rid", *COORDINATES)).groupBy("rid", *COORDINATES).agg(F.lit(1).alias("_"))
        return both.select(*COORDINATES)

    def valid(self, topic: str) -> DataFrame:
        """The valid records of one topic as flat typed rows with their coordinates."""
        contract = self.contracts[topic]
        rows = self.found.filter((F.col("source_topic") == topic) & ~self._at_once()).join(self._by_value_ids(), "rid", "left_anti")
        listed = Reader(contract).listed
        columns = [_typed(F.col("cells")[k], kind, contract.rules[k].kind, k in listed).alias(name) for name, kind, k in _flat_columns(contract)]
        return rows.select(*COORDINATES, F.timestamp_micros("kafka_micros").alias("kafka_timestamp"), *columns)


def _typed(text: Column, kind: str, value_kind: str, is_token: bool) -> Column:
    """A cell as its type; tokens are JSON texts."""
    if value_kind == "timestamp":
        return F.timestamp_micros(text.try_cast("bigint"))
    if kind == "array<string>":
        return F.from_json(text, kind)
    if is_token and kind == "string":
        return F.from_json(F.concat(F.lit('{"v":'), text, F.lit("}")), "struct<v:string>")["v"]
    return text if kind == "string" else text.try_cast(kind)


#: Spark's type for each kind of value.
_TYPES = {"uuid": "string", "text": "string", "enum": "string", "integer": "bigint", "number": "double", "boolean": "boolean", "code": "string", "code_list": "array<string>", "timestamp": "timestamp"}


def _flat_columns(contract: Contract) -> list[tuple[str, str, int]]:
    """(column, type, rule) of a contract's leaves. A leaf of the same name at another level is told apart by its path."""
    names: dict[str, int] = {}
    leaves = [(r, k) for k, r in enumerate(contract.rules) if r.kind != "object"]
    for r, _ in leaves:
        short = r.path.rpartition(".")[2]
        names[short] = names.get(short, 0) + 1
    columns = []
    for r, k in leaves:
        short = r.path.rpartition(".")[2]
        name = short if names[short] == 1 else "_".join(r.path.split(".")[-2:]).removeprefix("payload_")
        columns.append((name, "int" if short == "schema_version" else _TYPES[r.kind], k))
    return columns
