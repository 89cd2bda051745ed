"""Column functions against Python."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import functions as F

from ledgerloom.functions import hashing, rules
from ledgerloom.functions import text as X


def values(spark, rows, *columns):
    frame = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, v string")
    return [tuple(r)[1:] for r in frame.select("k", *columns).orderBy("k").collect()]


def test_text(spark):
    found = values(spark, ["   usd ", None, "", "a\tb"], X.trim_white("v"), X.code("v"), X.request_key("v"))
    assert found == [("usd", "USD", "usd"), (None, None, None), ("", "", None), ("a\tb", "A\tB", None)]
    assert values(spark, ["x" * 256, "x" * 255], X.request_key("v").isNull()) == [(True,), (False,)]
    assert values(spark, ["\U0001f642" * 3], X.cut("v", 2)) == [("\U0001f642" * 2,)]


def test_ids(spark):
    good = "50000000-0000-4000-8000-0000000000AB"
    found = values(spark, [good, good + "\n", good.replace("4000", "1000"), "x", None], X.is_uuid("v"), X.is_uuid4("v"), X.bad_uuid("v"), X.canonical_uuid("v"))
    assert found == [(True, True, False, good.lower()), (False, False, True, good.lower()), (True, False, False, good.replace("4000", "1000").lower()), (False, False, True, None), (None, None, True, None)]


def test_uuid5_is_pythons(spark):
    names = ["", "a", "decision:model:é", "x" * 500] + [f"n{k}" for k in range(40)]
    assert values(spark, names, hashing.uuid5(F.col("v"))) == [(str(uuid.uuid5(uuid.NAMESPACE_URL, n)),) for n in names]


def test_fingerprint_layout(spark):
    fields = {"fingerprint_version": F.lit(1), "customer_id": F.lit("cust-123"), "merchant_id": F.lit("merchant-9"), "device_id": F.lit("device-7"), "amount_minor": F.lit(1250), "currency": F.lit("USD"), "country": F.lit("IN")}
    canonical = "fingerprint_version:1:1\ncustomer_id:8:cust-123\nmerchant_id:10:merchant-9\ndevice_id:8:device-7\namount_minor:4:1250\ncurrency:3:USD\ncountry:2:IN\n"
    assert values(spark, ["x"], hashing.canonical_fields(fields), hashing.fingerprint(fields)) == [(canonical, hashlib.sha256(canonical.encode()).hexdigest())]
    assert values(spark, ["é", None], hashing.canonical_fields({"v": F.col("v")})) == [("v:2:é\n",), ("v:0:\n",)]


def test_rules_keep_order_and_ignore_null_conditions(spark):
    table = [("second", F.col("v") == "b"), ("first", F.length("v") > 0), ("never", F.lit(None).cast("boolean"))]
    text = rules.error_text(table)
    found = values(spark, ["b", "a", "", None], text, rules.error_codes(text), rules.first_error(text))
    assert found == [("second,first", ["second", "first"], "second"), ("first", ["first"], "first"), ("", [], None), ("", [], None)]


def test_json_keys(spark):
    found = values(spark, ['{"a":1,"b":2}', '{"b":2,"a":null}', '{"a":1}', '{"a":1,"b":2,"c":3}', "x", None], X.json_keys_differ("v", ["a", "b"]))
    assert found == [(False,), (False,), (True,), (True,), (None,), (None,)]


def test_random_ids(spark):
    from ledgerloom.functions import hashing
    from ledgerloom.functions import text as X

    found = spark.range(200).select(hashing.random_uuid().alias("u")).withColumn("good", X.is_uuid4("u")).collect()
    assert len({r.u for r in found}) == 200 and all(r.good for r in found)
