import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))

from furrow.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def churn(spark):
    rows = [
        ("C001", 28, "上海", 99.0, "月付", "否"), ("C002", None, "北京", 129.0, "年付", "否"),
        ("C003", 45, "上海", 199.0, "月付", "是"), ("C004", 37, "深圳", None, "季度", "否"),
        ("C005", 37, "深圳", 159.0, "季度", "否"),
    ]
    return spark.createDataFrame(
        rows, "customer_id string, age bigint, city string, monthly_fee double, "
              "contract_type string, churn string")


@pytest.fixture(scope="session")
def small_analysis(spark):
    rows = [("C001", 20, "x", None, "yes"), ("C002", None, "x", None, "no"),
            ("C003", 40, "x", None, "yes"), ("C004", 30, "x", "value", "no")]
    return spark.createDataFrame(
        rows, "customer_id string, age bigint, constant string, mostly_missing string, "
              "churn string")


def segment_rows(target):
    rows = []
    for i in range(20):
        amount = None if i == 3 else 1000 if i == 19 else i
        rows.append((f"R{i:03d}", amount, f"segment-{i}", target(i)))
    return [*rows, ("R020", 21, "segment-20", None)]


SEGMENT_ROLES = {"row_id": "id", "amount": "continuous_numeric", "segment": "nominal_category",
                 "target": "target"}


@pytest.fixture(scope="session")
def segments(spark):
    rows = segment_rows(lambda i: "yes" if i % 2 else "no")
    return spark.createDataFrame(
        rows, "row_id string, amount bigint, segment string, target string")


@pytest.fixture(scope="session")
def priced_segments(spark):
    rows = segment_rows(lambda i: 1.5 if i % 2 else 0.5)
    return spark.createDataFrame(
        rows, "row_id string, amount bigint, segment string, target double")
