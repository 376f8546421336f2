"""Input validation messages and the report layout."""

from fraudframe.operators import detect
from fraudframe.plans import flows


def test_validate_model_input_messages(spark):
    few = spark.createDataFrame([(1.0, 1)] * 5, "amount double, is_fraud int")
    r = detect.validate_model_input(few, ["amount", "is_fraud"]).first()
    assert not r["ok"] and r["message"].startswith("Insufficient data")
    one_class = spark.createDataFrame([(1.0, 0)] * 12, "amount double, is_fraud int")
    r = detect.validate_model_input(one_class, ["amount", "is_fraud"]).first()
    assert not r["ok"] and "both fraud and legitimate" in r["message"]
    r = detect.validate_model_input(one_class, ["amount", "merchant"]).first()
    assert not r["ok"] and "merchant" in r["message"]
    good = spark.createDataFrame([(1.0, i % 2) for i in range(12)], "amount double, is_fraud int")
    assert detect.validate_model_input(good, ["amount", "is_fraud"]).first()["ok"]


def test_validate_source(spark):
    df = spark.createDataFrame([(1, "a")], "x int, y string")
    assert detect.validate_source(df, "upload.csv").first()["ok"]
    assert not detect.validate_source(df, "upload.xlsx").first()["ok"]
    assert not detect.validate_source(df.select("x"), "upload.csv").first()["ok"]
    assert not detect.validate_source(df.limit(0), "upload.csv").first()["ok"]


def test_report_text_layout(spark):
    rows = [(float(a), f, m) for a, f, m in
            [(10, 1, "Gas Station"), (20, 1, "Gas Station"), (30, 0, "Hotel"), (5, 1, "Hotel")]]
    df = spark.createDataFrame(rows, "amount double, is_fraud int, merchant string")
    text = flows.report_text(flows.summary_report(df))
    lines = text.splitlines()
    assert lines[0] == "=== FRAUD DETECTION ANALYSIS REPORT ==="
    assert "Total Transactions: 4" in lines and "Fraud Rate: 75.00%" in lines
    assert "Date Range: Not available" in lines
    assert "Average Fraud Amount: $11.67" in lines and "Median Fraud Amount: $10.00" in lines
    assert lines.index("- Gas Station: 2 transactions") < lines.index("- Hotel: 1 transactions")
    assert lines[-1] == "=== END OF REPORT ==="
