"""Addresses outside the gazetteer meet by their wording; a postal code doesn't keep them apart, nor does a slip."""

from plotwise.llm import addresses
from tests.llm.test_addresses import TOWNS


def test_unknown_wordings(spark):
    rows = [("a", "未知市新町1-2-3"), ("b", "〒999-9999 未知市新町1-2-3"), ("c", "〒888-8888 未知市新町1丁目2番3号"), ("d", "〒999-9999 未知市新町1-2-4"), ("e", "未知市新街1-2-3"), ("f", "遠方市古田1-2-3"), ("g", "遠方市別沢1-2-3"), ("a", "未知市新町1-2-3")]
    towns = spark.createDataFrame(TOWNS, "postal_code string, prefecture string, prefecture_latin string, city string, city_latin string, town string, town_latin string")
    df = spark.createDataFrame(rows, "id string, address string")
    got = {(r.id_a, r.id_b) for r in addresses.same_place(df, towns).collect()}
    assert got == {("a", "b"), ("a", "c"), ("a", "e"), ("b", "c"), ("b", "e"), ("c", "e")}
    places = {r.id: (r.members, r.links) for r in addresses.places(df, towns).collect()}
    assert places == {"a": (3, 3), "b": (3, 3), "c": (3, 3), "d": (1, 0), "e": (1, 3), "f": (1, 0), "g": (1, 0)}
    assert addresses.places(df.limit(0), towns).count() == 0
