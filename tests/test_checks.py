"""Every registered query against its check SQL on whole tables."""

import datetime
import decimal
import math

import pytest

from waymark import catalog

QUERIES, CHECKS = catalog.all_queries(), catalog.all_checks()


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, (datetime.date, datetime.datetime)):
        return str(value)
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float, decimal.Decimal)):
        return round(float(value), 9)
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    picked = [tuple(plain(row[i]) for i in order) for row in rows]
    return sorted(columns), sorted(picked, key=lambda row: [(v is None, str(v)) for v in row])


def test_every_check_has_a_query():
    assert set(CHECKS) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck, sf_dir):
    result = QUERIES[name](spark, sf_dir)
    got = table(result.columns, [tuple(row) for row in result.collect()])
    if name not in CHECKS:
        assert got[0]
        return
    cursor = duck.execute(CHECKS[name])
    columns = [column[0] for column in cursor.description]
    assert got == table(columns, cursor.fetchall())
