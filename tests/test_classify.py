from conftest import rows
from shop import shop_tables
from pyspark.sql import functions as F

from tallyward.operators import classify as c
from tallyward.operators import pii as p


def test_seed_rules_on_shop(spark):
    customers = shop_tables(spark)["customers"]
    got = {(r["column"], r["rule"]) for r in rows(c.classify_columns(customers))}
    assert {("email", "Email Address"), ("ssn", "US SSN"), ("ip_address", "IP Address"),
            ("phone", "Phone Number"), ("first_name", "Name Columns"), ("last_name", "Name Columns")} <= got
    assert ("country", "Email Address") not in got
    levels = {r["column"]: r["sensitivity_level"]
              for r in rows(c.max_sensitivity(c.classify_columns(customers), "column"))}
    assert levels["ssn"] == "restricted" and levels["email"] == "confidential"
    assert c.system_rules(spark).count() == 8


def test_names_match_in_empty_table_and_bad_rules_do_not(spark):
    empty = spark.createDataFrame([], "Salary int, note string")
    rules = c.seed_rules() + [c.ClassificationRule("bad", "X", "public", "regex", "(["),
                              c.ClassificationRule("odd", "X", "weird", "keyword", keywords=("NOTE",))]
    got = rows(c.classify_columns(empty, rules))
    assert {(r["column"], r["rule"]) for r in got} == {("Salary", "Financial"), ("note", "odd")}
    assert {r["confidence"] for r in got} == {0.9}
    level = rows(c.max_sensitivity(c.classify_columns(empty, rules), "column"), "column")
    assert {r["column"]: r["sensitivity_level"] for r in level} == {"Salary": "confidential", "note": "public"}


def test_overwrite_may_lower(spark):
    assets = spark.createDataFrame([("a", "restricted"), ("b", "internal")], "asset_id string, sensitivity_level string")
    levels = spark.createDataFrame([("a", "public")], "asset_id string, sensitivity_level string")
    got = {r["asset_id"]: r["sensitivity_level"] for r in rows(c.overwrite_sensitivity(assets, levels))}
    assert got == {"a": "public", "b": "internal"}


def test_shop_entities(spark):
    shop = shop_tables(spark)
    hits = p.detect_pii_values(shop["customers"], asset="customers").unionByName(
        p.detect_pii_values(shop["payments"], asset="payments")
    )
    got = {r["column"]: r["entity"] for r in rows(p.pick_entity(hits))}
    assert got == {"email": "EMAIL_ADDRESS", "phone": "PHONE_NUMBER", "ssn": "US_SSN",
                   "ip_address": "IP_ADDRESS", "card_number": "CREDIT_CARD"}
    card = [r for r in rows(p.record_pii(p.pick_entity(hits))) if r["column"] == "card_number"][0]
    assert (card["category"], card["sensitivity_level"], card["confidence"]) == ("PCI:CREDIT_CARD", "restricted", 1.0)


def test_checksums(spark):
    df = spark.createDataFrame(
        [("DE89370400440532013000", "4111 1111 1111 1112"), ("GB82WEST12345698765432", "x 4111-1111-1111-1111 y"),
         ("DE89370400440532013001", "none"), (None, "")], "iban string, card string")
    iban = p.DEFAULT_RECOGNIZERS[5]
    card = p.DEFAULT_RECOGNIZERS[4]
    got = df.select(iban.fires(F.col("iban")).alias("i"), card.fires(F.col("card")).alias("c")).collect()
    assert [r["i"] for r in got] == [True, True, False, None]
    assert [r["c"] for r in got] == [False, True, False, False]


def test_pick_prefers_weight_then_priority(spark):
    hits = spark.createDataFrame(
        [("t", "a", "PERSON", 0.85), ("t", "a", "IP_ADDRESS", 0.6), ("t", "a", "MADE_UP", 1.0),
         ("t", "b", "EMAIL_ADDRESS", 1.0), ("t", "b", "CREDIT_CARD", 1.0), ("t", "c", "US_SSN", 0.39)],
        "asset string, column string, entity string, score double")
    got = {r["column"]: r["entity"] for r in rows(p.pick_entity(hits))}
    assert got == {"a": "PERSON", "b": "CREDIT_CARD"}


def test_bump_and_names_and_strategy(spark):
    df = spark.createDataFrame([("unclassified", "public"), ("unclassified", "internal"), ("restricted", "internal")],
                               "cur string, new string")
    got = [r[0] for r in df.select(p.bump_sensitivity(F.col("cur"), F.col("new"))).collect()]
    assert got == ["unclassified", "internal", "restricted"]
    names = spark.createDataFrame([("t", "contact_555_123_4567"), ("t", "city")], "asset string, column string")
    assert [(r["column"], r["entity"]) for r in rows(p.detect_pii_names(names))] == [("contact_555_123_4567", "PHONE_NUMBER")]
    cats = spark.createDataFrame([("database",), ("iam",), ("datalake",)], "c string")
    assert [r[0] for r in cats.select(p.pii_strategy(F.col("c"))).collect()] == ["values", "skipped", "column_names"]
