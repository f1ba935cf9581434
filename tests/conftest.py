import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from holdfast.session import local_session  # noqa: E402
from holdfast.sources.subscribers import subscribers  # noqa: E402

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    # Without merging of small partitions, even few rows fall into several chunks.
    session = local_session(
        "tests",
        "8",
        **{
            "spark.checkpoint.dir": str(shared),
            "spark.sql.adaptive.coalescePartitions.enabled": "false",
        },
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def people(spark):
    """The subscriber table of the smallest size, held in memory."""
    rows = subscribers(spark, SMALL).cache()
    rows.count()
    return rows


def values(df, *columns):
    """Rows as tuples, in the order Spark returns them."""
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
