"""Every query with a SQL twin gives the twin's rows."""

import duckdb
import pytest

import __spark_entry__ as contract
from foldstack.queries.modelling import QUERIES as MODELLING
from foldstack.queries.oracle import ORACLE
from foldstack.queries.relational import QUERIES as RELATIONAL

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def _sorted_rows(frame):
    columns = sorted(frame.columns)
    frame = frame[columns].sort_values(columns).reset_index(drop=True)
    return columns, [tuple(map(repr, row)) for row in frame.itertuples(index=False)]


#: Model queries take their time; these stand for the others, which the same SQL forms check.
FITTED = ("evaluate_model", "predictions_csv", "train_model")
UNFITTED = ("artifact_manifest", "manifest_ranges", "manifest_verify", "split_renewed", "split_reuse", "verify_one_file")


@pytest.mark.parametrize("name", sorted((set(ORACLE) - set(MODELLING)) | set(FITTED) | set(UNFITTED)))
def test_matches_sql(spark, sf, duck, name):
    ours = _sorted_rows(contract.queries()[name](spark, sf).toPandas())
    theirs = _sorted_rows(duck.sql(ORACLE[name]).df())
    assert ours[0] == theirs[0]
    assert len(ours[1]) == len(theirs[1])
    different = [pair for pair in zip(ours[1], theirs[1]) if pair[0] != pair[1]]
    assert not different, different[:3]


def test_registry_is_complete():
    assert set(RELATIONAL) | set(MODELLING) == set(ORACLE)
    assert set(RELATIONAL) | set(MODELLING) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())
