from conftest import rows
from shop import shop_tables

from tallyward.operators import etl, risk


def test_risk_tiers(spark):
    answers = [("p", {"prohibited_use": True, "biometric": True}), ("h", {"essential_services": True, "human_interaction": True}),
               ("l", {"human_interaction": True, "generates_content": True}), ("n", {}), ("f", {"biometric": False})]
    df = spark.createDataFrame(answers, "model_id string, responses map<string,boolean>")
    got = {r["model_id"]: r for r in rows(risk.risk_score(df))}
    assert {k: (v["score"], v["risk_tier"]) for k, v in got.items()} == {
        "p": (100, "unacceptable"), "h": (40, "high"), "l": (20, "limited"), "n": (0, "minimal"), "f": (0, "minimal")}
    assert len(got["h"]["required_actions"]) == 6 and len(got["h"]["risk_factors"]) == 2
    assert got["p"]["risk_factors"] == ["Prohibited use case under the EU AI Act"]


def test_requirements(spark):
    nested = {r["framework"]: len(r["requirements"]) for r in rows(risk.framework_requirements(spark))}
    assert nested == {"GDPR": 5, "DPDPA": 3, "EU_AI_ACT": 5, "PCI_DSS": 3}
    models = spark.createDataFrame([("a", "high"), ("b", "limited"), ("c", None)], "id string, risk_tier string")
    got = rows(risk.requirements_for_model(models))
    assert {m: sum(r["model_id"] == m for r in got) for m in "abc"} == {"a": 15, "b": 13, "c": 11}


def test_compliance_and_audit(spark):
    m = spark.createDataFrame([("compliant",), ("compliant",), ("open",)], "status string")
    total = [r for r in rows(risk.compliance_summary(m)) if r["is_total"]][0]
    assert total["count"] == 3 and total["compliance_rate"] == 0.667
    audit = spark.createDataFrame([(str(i), "asset.updated" if i % 2 else "login", "asset", i) for i in range(10)],
                                  "id string, action string, resource_type string, occurred_at int")
    assert [r["occurred_at"] for r in risk.audit_search(audit, "asset.updated", limit=2).collect()] == [9, 7]
    assert {r["family"]: r["count"] for r in rows(risk.audit_by_family(audit))} == {"asset": 5, "login": 5}


def test_reports_match_plain_sql(spark):
    shop = shop_tables(spark)
    for name, df in shop.items():
        df.createOrReplaceTempView(name)
    cases = [
        (etl.customer_revenue(shop["orders"], shop["customers"]),
         "SELECT c.id, c.country, sum(o.total_amount), count(o.id) FROM orders o JOIN customers c ON c.id = o.customer_id WHERE o.status = 'paid' GROUP BY 1, 2"),
        (etl.daily_sales(shop["orders"]),
         "SELECT order_date, sum(total_amount), count(*) FROM orders WHERE status IN ('paid', 'shipped') GROUP BY 1"),
        (etl.product_performance(shop["order_items"], shop["products"]),
         "SELECT p.id, p.name, p.category, sum(quantity), sum(quantity * unit_price) FROM order_items i JOIN products p ON p.id = i.product_id GROUP BY 1, 2, 3"),
        (etl.payment_summary(shop["payments"], shop["orders"]),
         "SELECT o.id, o.total_amount, sum(amount) FROM payments p JOIN orders o ON o.id = p.order_id GROUP BY 1, 2"),
        (etl.customer_360(shop["customers"], shop["orders"]),
         "SELECT c.id, c.email, c.country, count(o.id), sum(o.total_amount) FROM customers c LEFT JOIN orders o ON o.customer_id = c.id GROUP BY 1, 2, 3"),
    ]
    for df, sql in cases:
        assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, map(tuple, spark.sql(sql).collect())))
