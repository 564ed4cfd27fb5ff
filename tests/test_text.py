"""Text functions and their queries beside brute force on hand-made texts."""

import unicodedata

from pyspark.sql import functions as F

from tessaria import kpi_queries
from tessaria.functions.text import MARKED, normalised, topic, words


def test_normalized_text_returns_every_document(spark, tmp_path):
    texts = ["Não CHEGOU", "plain", "price 5 €", "• bullet", "“quoted”", "Москва", "Αθήνα", "\U0001f600 ok", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.norm for r in kpi_queries.normalized_text(spark, str(tmp_path)).collect()}
    assert sorted(got) == list(range(len(texts)))
    assert got[0] == "nao chegou" and got[2] == "price 5 €" and got[9] is None


def brute(text):
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))


def test_normalised_is_lower_nfkd_without_marks(spark):
    texts = ["Não CHEGOU", "não", "ＮＡＯ ＣＨＥＧＯＵ", "conﬁrmado", "ⅲ itens", "ǎ ő ů ř Ş ḿ", "½ m²", "İ ẞ ß Å K", "Ωμέγα Σ", "Йод", "한국", "❤️", "‍x", "á" + "̣", MARKED, MARKED.upper(), "", "a\x00b\n\u0085"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, t string")
    got = dict(rows.select("i", normalised(F.col("t"))).collect())
    assert got == {i: brute(t) for i, t in enumerate(texts)} | {len(texts): None}


def test_topics_and_words_of_decomposed_letters(spark):
    rows = spark.createDataFrame([("Ｎãｏ ｃｈｅｇｏｕ",), ("conﬁrmado",)], "t string").select(normalised(F.col("t")).alias("n"))
    assert [r[0] for r in rows.select(topic(F.col("n"), "delivery_delay")).collect()] == [1.0, 0.0]
    assert [r[0] for r in rows.select(words(F.col("n"))).collect()] == [["nao", "chegou"], ["confirmado"]]
