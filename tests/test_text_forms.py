"""Forms of text that SQL cannot repeat."""

import hashlib

from cellweave.operators import text
from cellweave.plans import grid_queries as Q

FORMS = [(1, "the ﬁrst ﬂoor ofﬁce is ｆｕｌｌ ＷＩＤＴＨ in №\u00a07 today", "the first floor office is full WIDTH in No 7 today"), (2, "e\u0301t\u00e9 – ok", "été - ok"), (3, None, None), (4, "", "")]


def test_one_form_of_each_letter(spark, tmp_path):
    spark.createDataFrame([x[:2] for x in FORMS], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x.digest for x in Q.text_norm(spark, str(tmp_path)).collect()}
    assert got == {i: t if t is None else hashlib.md5(t.encode()).hexdigest() for i, _, t in FORMS}


def test_quotes_are_found_in_any_form(spark):
    docs = spark.createDataFrame([(1, "so: " + FORMS[0][1] + " they say"), (2, "nothing of the kind stands in this other text")], "doc_id long, text string")
    quotes = spark.createDataFrame([(7, FORMS[0][2])], "item_id long, text string")
    assert [tuple(x) for x in text.quoted(docs, quotes).collect()] == [(7, 1)]
