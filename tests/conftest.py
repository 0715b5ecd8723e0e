import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", f"/tmp/warehouse-{os.getpid()}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def session(spark):
    from quern.session import Session, set_active_session

    made = Session(spark)
    set_active_session(made)
    return made


@pytest.fixture(scope="session")
def vendas(session):
    rows = [
        (1, "Sao Paulo", "SP", 200.0, "2025-01-15"), (2, "Campinas", "SP", 180.0, "2025-01-20"), (3, "Santos", "SP", 160.0, "2025-02-01"),
        (4, "Sao Paulo", "SP", 120.0, "2025-02-10"), (5, "Rio de Janeiro", "RJ", 250.0, "2025-01-18"), (6, "Niteroi", "RJ", 90.0, "2025-02-05"),
        (7, "Rio de Janeiro", "RJ", 300.0, "2025-03-01"), (8, "Belo Horizonte", "MG", 150.0, "2025-01-22"), (9, "Uberlandia", "MG", 80.0, "2025-02-15"),
        (10, "Sao Paulo", "SP", 175.0, "2025-03-10"), (11, "Campinas", "SP", 110.0, "2025-03-12"), (12, "Belo Horizonte", "MG", 95.0, "2025-03-15"),
    ]
    return session.createDataFrame(rows, "id int, cidade string, estado string, valor double, data string").withColumn("data", __import__("pyspark.sql.functions", fromlist=["x"]).to_date("data"))
