import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def plain(value):
    """Values that both engines give alike."""
    import decimal

    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return "nan" if value != value else round(value, 9)
    return value


@pytest.fixture(scope="session")
def duck():
    """rows(sql, folder): what DuckDB gives for SQL over the Parquet tables in a folder, as sorted rows by sorted column names."""
    import duckdb

    def rows(sql: str, folder: str):
        con = duckdb.connect()
        con.execute("SET TimeZone='UTC'")
        for name in TABLES:
            path = Path(folder, f"{name}.parquet")
            if path.exists():
                con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
        got = con.execute(sql)
        names = [d[0] for d in got.description]
        order = sorted(range(len(names)), key=names.__getitem__)
        return [names[i] for i in order], sorted([tuple(plain(r[i]) for i in order) for r in got.fetchall()], key=repr)

    return rows


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted([tuple(plain(v) for v in r) for r in df.select(*[f"`{c}`" for c in names]).collect()], key=repr)
