import pytest
from parity import duck, rows

from glintspan.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_as_sql(spark, con, name):
    mine, theirs = catalogue.QUERIES[name](spark, SF).toPandas(), con.sql(catalogue.ORACLES[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_rows_only(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_result_is_the_same_for_any_number_of_partitions(spark):
    out = []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        out.append(rows(catalogue.QUERIES["q_sequence_features"](spark, SF).toPandas()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert out[0] == out[1]


def test_hexagons_of_points_on_borders_are_as_in_sql(spark, tmp_path):
    con = duck(SF)
    con.sql("CREATE OR REPLACE VIEW events AS SELECT row_number() OVER () AS event_id, TIMESTAMP '2024-01-01' + INTERVAL 1 SECOND * k AS ts, CAST(k % 7 AS BIGINT) AS user_id, 'l' || k AS event_type, v AS value, '{\"k\": ' || k || '}' AS props FROM range(-100, 100) a(k), (VALUES (0.0::DOUBLE), (12.5), (-25.0), (NULL)) b(v)")
    con.sql(f"COPY events TO '{tmp_path}/events.parquet'")
    mine, theirs = catalogue.QUERIES["q_hex_bins"](spark, str(tmp_path)).toPandas(), con.sql(catalogue.ORACLES["q_hex_bins"]).df()
    assert rows(mine) == rows(theirs)
