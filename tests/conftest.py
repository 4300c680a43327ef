import os
import shutil
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    tmp = tmp_path_factory.mktemp("spark")
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", str(tmp / "warehouse")).config("spark.checkpoint.dir", str(tmp / "shared")).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
    shutil.rmtree(tmp, ignore_errors=True)


SF = "/root/testdata/sf0.001"


def rows_of(df):
    """Rows as sorted tuples of plain values, columns by name."""
    cols = sorted(df.columns)

    def plain(v):
        if isinstance(v, float):
            return f"{v:.9g}"
        return str(v) if not isinstance(v, (list, tuple)) else str([plain(x) for x in v])

    return sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())


def duck_rows(sql, sf=SF):
    import glob

    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    cur = c.execute(sql)
    names = [d[0] for d in cur.description]
    order = [names.index(n) for n in sorted(names)]

    def plain(v):
        if isinstance(v, float):
            return f"{v:.9g}"
        return str(v) if not isinstance(v, (list, tuple)) else str([plain(x) for x in v])

    return sorted(names), sorted(tuple(plain(r[i]) for i in order) for r in cur.fetchall())
