"""Copies of benchmark items with names first in sentences, attached units, number words and few words."""

from barloom.llm.decontaminate import leaks

ITEMS = [
    (0, "Tom has 5 apples. Mia has 7 apples. How many apples do they have together?"),
    (1, "the old red train went 5km past our green farm and then came back home"),
    (2, "she bought three loaves of bread and seven jars of honey at our market"),
    (3, "12 + 30 - 5 * 2 = 32"),
]


def test_reparameterised_copies_are_found(spark):
    docs = [
        (0, "We read this. Bob has 9 apples. Ann has 4 apples. How many apples do they have together?"),
        (1, "the old red train went 80 miles past our green farm and then came back home"),
        (2, "she bought 9 loaves of bread and 12 jars of honey at our market"),
        (3, "as a sum, 12 + 30 - 5 * 2 = 32, they wrote"),
        (4, "as a sum, 12 + 30 - 5 * 2 = 33, they wrote"),
        (5, "Tom has a cat. Mia has a dog. How many of them have names is not known to us at all"),
    ]
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leaks(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    assert got == {(k, k) for k in range(4)}
