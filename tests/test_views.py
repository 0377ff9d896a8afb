from tallyfold.plans import views


def test_sql_over_views(spark, tiny):
    assert "invoices" in views.register_tables(spark, tiny)
    assert views.register_queries(spark, tiny, ["discrepancies", "read_contracts"]) == ["discrepancies", "read_contracts"]
    got = spark.sql("select severity, count(*) as n from discrepancies where document_type = 'invoice' group by severity").collect()
    assert {r["severity"] for r in got} <= {"rounding", "material"}
    plan = spark.sql("select document_id from read_contracts where document_id is not null")._jdf.queryExecution().toString()
    assert "contracts" in plan or "Scan" in plan
