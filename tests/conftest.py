from __future__ import annotations

import os
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory) -> SparkSession:
    folder = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", (folder / "shared").as_uri())
        .config("spark.sql.warehouse.dir", str(folder / "warehouse"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir() -> str:
    return SMALL


def tables(sf_dir: str):
    """A DuckDB connection with every table as a view."""
    import duckdb

    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        source = f"{path}/*.parquet" if path.is_dir() else path
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{source}'")
    return con


def canonical(frame) -> list[str]:
    """Rows as sorted texts; whole floats count as integers and all missing values as one."""

    def plain(v):
        if v is None or type(v).__name__ in ("NAType", "NaTType") or v != v:
            return None
        if isinstance(v, float) and v == int(v) and abs(v) < 1 << 53:
            return int(v)
        return v.item() if hasattr(v, "item") else v

    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(repr([plain(v) for v in row]) for row in frame.itertuples(index=False, name=None))
