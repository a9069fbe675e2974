import os
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")




def _session():
    from pyspark.sql import SparkSession

    warehouse = tempfile.mkdtemp(prefix="warehouse-")
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "4g").config("spark.sql.warehouse.dir", warehouse)
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


#: Started here, since test modules make column constants when they are read.
SPARK = _session()


@pytest.fixture(scope="session")
def spark():
    return SPARK


@pytest.fixture(scope="session")
def sf():
    return DATA
