import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.driver.memory", "6g")
        .config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


FILES = (
    "ord long, path string, root string, size long, mtime double, raw_name string, full_hash string, duration double, fingerprint array<long>, "
    "fingerprint_version int, image_fingerprint array<long>, audio_fingerprint array<long>"
)


@pytest.fixture(scope="session")
def make_files(spark):
    """Rows of the files table from dicts; what is not given is null."""
    names = [x.strip().split(" ")[0] for x in FILES.split(",")]

    def make(rows):
        filled = []
        for i, row in enumerate(rows):
            base = {"ord": i, "path": f"/r/{i}.mkv", "root": "/r", "size": 1, "mtime": 0.0, "raw_name": str(i), **row}
            filled.append(tuple(base.get(n) for n in names))
        return spark.createDataFrame(filled, FILES)

    return make
