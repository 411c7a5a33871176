from framelode.llm.queries import ORACLES, QUERIES


def test_oracles_are_sql_of_registered_queries():
    assert set(ORACLES) <= set(QUERIES)
    assert all(isinstance(sql, str) for sql in ORACLES.values())
