"""Interaction features of tables with many values."""

import pytest

from hearthline.operators import features


def _rows(spark):
    # 60 cities and types, of which the first are the most frequent; one row lacks each field.
    rows = [(k * 100 + i, f"c{k:02}", f"t{k:02}", float(k + i + 1), k + i) for k in range(60) for i in range(1 + (k < 10))]
    rows += [(9000, None, None, 5.0, 5), (9001, "c59", "t59", None, None)]
    return spark.createDataFrame(rows, "id long, city_cleaned string, property_type_cleaned string, price_per_m2 double, rooms int")


@pytest.mark.parametrize("limit", [{}, {"max_values": 10}])
def test_every_value_has_its_product(spark, limit):
    df = _rows(spark)
    got = [r.asDict() for r in features.interactions(df, **limit).collect()]
    assert len(got) == 72
    for first, prefix, key, value in (("c", "price_m2_city", "city_cleaned", "price_per_m2"), ("t", "rooms_type", "property_type_cleaned", "rooms")):
        for r in got:
            assert limit or prefix not in r
            for name in (f"{first}{k:02}" for k in range(60)):
                column = f"{prefix}_{name}"
                product = r[column] if column in r else None if r[prefix] is None else r[prefix].get(name, 0)
                assert product == (None if r[value] is None else r[value] * (r[key] == name))
