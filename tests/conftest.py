import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from shelfwise.session import BASE_CONF

    b = (SparkSession.builder.master("local[4]").appName("shelfwise-tests")
         .config("spark.sql.shuffle.partitions", "4")
         .config("spark.driver.memory", "4g"))
    for k, v in BASE_CONF.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    # tests only: the checkpoint folder is unset, so take a scratch one
    if s.sparkContext.getCheckpointDir() is None:
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="shelfwise-test-ckpt-"))
    yield s
    s.stop()
