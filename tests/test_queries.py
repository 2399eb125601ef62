"""Every registered query of the reference's operators against its SQL, and those without SQL against plain Python."""

import duckdb
import pytest
from pyspark.sql import functions as F

from foliant.functions import metrics
from foliant.plans import catalogue
from foliant.plans.registry import turns

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_its_sql(spark, con, name):
    frame = catalogue.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    got = sorted(str(tuple(r)) for r in frame.select(*columns).collect())
    assert got == sorted(map(str, con.execute(f"SELECT {', '.join(columns)} FROM ({catalogue.ORACLES[name]})").fetchall()))


def test_which_have_no_sql():
    assert set(catalogue.QUERIES) - set(catalogue.ORACLES) == {"ocr_clean", "token_edit_distance"}


def test_token_edit_distance(spark):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1] / max(len(a), len(b)) if a or b else 0.0

    rows = turns(spark, SF).select("plain", "next", metrics.token_distance(F.col("plain"), F.col("next")).alias("d")).collect()
    assert rows and all(r["d"] == pytest.approx(distance(r["plain"].split(), r["next"].split())) for r in rows)
