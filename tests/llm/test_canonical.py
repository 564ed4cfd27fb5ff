from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from tessaria.llm import canonical as c

ALPHABET = st.text("aZ9 çÇшжéªº.“❤️👍🏽👨‍👩‍👧́​ 　οаＡﬁⅰ\n\t", max_size=40)


def test_what_looks_alike():
    for a, b in [
        ("ação", "ação"), ("preço bom", "ｐｒｅçｏ　ｂｏｍ"), ("loja", "l​o⁠ja﻿"), ("maca", "mаса"), ("OTIMO", "ΟΤΙΜΟ"), ("fim", "ﬁm"), ("dicl", "ⅾⅰⅽⅼ"), ("a b", " a   b‎"), ("guia", "ɡuia"), ("𝐛om", "bom"),
    ]:
        assert c.skeleton(a) == c.skeleton(b), (a, b)


def test_what_a_reader_sees_differs():
    for a, b in [("3ª", "3a"), ("1º", "1o"), ("“x”", '"x"'), ("ação", "acao"), ("Loja", "loja"), ("bom.", "bom"), ("m²", "m2"), ("👍🏽", "👍"), ("a b", "ab"), ("0", "O")]:
        assert c.skeleton(a) != c.skeleton(b), (a, b)


def test_look_alikes_of_the_unicode_table():
    for a, b in zip("օѵᎪᴏոꓮ⁄․ǃг", "ovAonA/.!r"):
        assert c.twins()[a] == b
    assert len(c.confusables()) > 5000 and all(not x.isascii() and y.isascii() for x, y in c.twins().items())


def test_words_of_other_alphabets_stay():
    for t in ("Скоро приду, мама", "Αθήνα είναι", "Привет, о produto é bom", "১২ ٥"):
        assert c.clean(t) == t
    assert c.clean("prоduto сhegou") == "produto chegou" and c.clean("о produto") == "o produto"


@settings(max_examples=300, deadline=None)
@given(ALPHABET)
def test_clean_is_stable_and_keeps_the_look(t):
    assert c.clean(c.clean(t)) == c.clean(t)
    assert c.skeleton(c.clean(t)) == c.skeleton(t)
    assert c.skeleton(c.skeleton(t)) == c.skeleton(t)


def test_columns_agree_with_functions_and_handle_nulls(spark):
    texts = [None, "", "   ", "​", "plain text", " a  b ", "ação ❤️ 👨‍👩‍👧", "ｆｕｌｌ\nline", "x" * 50_000 + " ​" + "é " * 5000, "tab\there"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("t", c.clean_text(F.col("t")).alias("c"), c.skeleton_text(F.col("t")).alias("s")).collect()
    import unicodedata

    for r in rows:
        assert r.c == (None if r.t is None else c.clean(r.t))
        assert r.s == (None if r.t is None else unicodedata.normalize("NFC", c.skeleton(r.t)))


def test_same_look_and_groups(spark):
    left = spark.createDataFrame([("1", "ação", 0), ("2", "bom", 0), ("3", None, 0), (None, "x", 0), ("4", "a​", 0), ("4", "a​", 0), ("5", "​", 0)], "k string, t string, look int")
    right = spark.createDataFrame([("1", "ação"), ("2", "bom"), ("3", "x"), (None, "x​"), ("4", "a"), ("5", "")], "k string, u string")
    assert {r.k for r in c.same_look(left, right, "k", "t", "u").collect()} == {"1", "4"}
    assert c.same_look(left.limit(0), right, "k", "t", "u").count() == 0
    both = left.select("k", "t").unionByName(right.toDF("k", "t"))
    groups = sorted((r.n_rows, r.n_forms) for r in c.groups_of_equal_look(both, "k", "t").collect())
    assert groups == [(2, 2), (2, 2), (3, 2), (3, 2)] or len(groups) >= 3
