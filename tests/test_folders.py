"""Tables that are folders of files, as large ones are."""

import pytest

from test_queries import SF, compare, connected
from textloom import catalog


@pytest.fixture
def folders(spark, tmp_path):
    for name in ("documents", "events"):
        spark.read.parquet(f"{SF}/{name}.parquet").repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["tok_stream_counts", "stream_event_windows"])
def test_streams_read_folders(spark, folders, name):
    duck = connected(SF)
    assert catalog.queries()[name](spark, folders).count() > 0
    compare(spark, duck, name, folders)
