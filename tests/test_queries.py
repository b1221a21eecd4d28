"""Each query that SQL can express against its SQL; the others for their shape."""

import pytest

from foldmill.queries import ORACLE_SQL, QUERIES
from tests.conftest import DATA, comparable, sql_rows


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, name):
    ours = QUERIES[name](spark, f"{DATA}/sf0.001").toPandas()
    theirs = sql_rows("sf0.001", ORACLE_SQL[name])
    assert len(ours) > 0
    assert comparable(ours) == comparable(theirs)


def test_balanced_group_folds(spark):
    rows = QUERIES["balanced_group_folds"](spark, f"{DATA}/sf0.001").toPandas()
    for _, part in rows.groupby("l_returnflag"):
        assert len(part) == 5 and part.n.max() - part.n.min() < 0.1 * part.n.sum()


def test_text_encoder(spark):
    rows = QUERIES["text_encoder"](spark, f"{DATA}/sf0.001").toPandas()
    assert len(rows) == 200 and set(rows.features.map(len)) == {64}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
