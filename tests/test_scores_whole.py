"""rating_scores weighs every frequent pair of tags: at sf0.01 these are 29,136."""

from tagloom.plans import registry
from tests import oracle

SF_DIR = "/root/testdata/sf0.01"


def test_all_pairs_count(spark):
    sql = registry.ORACLE["rating_scores"]
    assert "LIMIT" not in sql and "place <=" not in sql and "LIMIT 25000" in registry.ORACLE["rating_softmax"]
    con = oracle.connect(SF_DIR)
    assert con.execute(f"{sql[: sql.index(', pr AS (')]} SELECT count(*) FROM p").fetchone() == (29136,)
    assert oracle.same(registry.QUERIES["rating_scores"](spark, SF_DIR), con, sql)
