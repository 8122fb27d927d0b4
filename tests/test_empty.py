"""Every core query over tables without rows."""

from pathlib import Path

import pytest

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    if not DATA.exists():
        pytest.skip("no test tables")
    root = tmp_path_factory.mktemp("empty")
    for path in DATA.glob("*.parquet"):
        if path.stem not in ("lineitem", "orders", "customer", "part", "supplier", "nation", "region", "events", "embeddings"):
            spark.read.parquet(str(path)).limit(0).coalesce(1).write.parquet(str(root / path.name))
    return str(root)


def test_core_queries_on_empty_tables(spark, empty):
    from auditlake.plans import catalog

    for name, query in catalog.queries().items():
        rows = query(spark, empty).count()
        assert rows == 0, name
