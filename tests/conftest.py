import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from data_paths import ROOT, SMALL  # noqa: E402

sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from stockroom.session import ensure_checkpoint_dir, get_spark, ship_package

    # Plans that tests read show whole paths, however long the scratch folder's is.
    s = get_spark(os.environ.get("TEST_MASTER", "local[*]"), 8, extra={"spark.sql.maxMetadataStringLength": "2000"})
    ensure_checkpoint_dir(s)
    ship_package(s)
    yield s


@pytest.fixture(scope="session")
def small_tables(spark):
    from stockroom.sources import RetailTables

    return RetailTables.from_testdata(spark, SMALL)
