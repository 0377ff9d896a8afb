import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    from tallyfold.sources.tables import ship

    ship(s)
    return s


@pytest.fixture(scope="session")
def tiny():
    d = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not Path(d).is_dir():
        pytest.skip("the test tables are not here")
    return d
