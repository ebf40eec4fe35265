"""Every query with an SQL twin gives the twin's rows."""

import pytest
from conftest import DATA, same_as_sql

from lemmaforge.plans.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    same_as_sql(spark, duck, QUERIES[name], SQL[name])


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())


def test_whole_plan(spark):
    out = QUERIES["lemmatize_conversations"](spark, DATA)
    r = out.where("size(tokens) > 3").first()
    for t in r.tokens:
        assert r.text[t.start : t.end] == t.token
    assert r.analyzed_text == " ".join(t.lemma for t in r.tokens if t.lemma)
    assert [t.position for t in r.es_tokens] == list(range(len(r.es_tokens)))
