"""Streams over a table of part files against the same table as one file."""

import pytest

from sitlake.plans import catalogue

from .conftest import DATA
from .oracle import rows_of


@pytest.mark.parametrize("name", ["stream_session", "stream_daily"])
def test_part_files_are_read(spark, tmp_path, name):
    query = catalogue.queries()[name]
    spark.read.parquet(f"{DATA}/events.parquet").repartition(3).write.parquet(f"file://{tmp_path}/events.parquet")
    got, want = query(spark, f"file://{tmp_path}"), query(spark, DATA)
    got, want = (rows_of(df.columns, [tuple(r) for r in df.collect()]) for df in (got, want))
    assert got == want and got
