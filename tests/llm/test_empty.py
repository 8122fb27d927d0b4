"""Every query of the llm operators over tables without rows."""

from pathlib import Path

import pytest

DATA = Path("/root/testdata/sf0.001")


def test_llm_queries_on_empty_tables(spark, tmp_path):
    if not DATA.exists():
        pytest.skip("no test tables")
    from auditlake.llm import queries

    for name in ("sources", "repositories", "observations", "documents", "reading_labels", "pack_limits", "baseline_entries", "baseline_raw"):
        spark.read.parquet(str(DATA / f"{name}.parquet")).limit(0).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    for name, query in queries.queries().items():
        assert query(spark, str(tmp_path)).count() == 0, name
