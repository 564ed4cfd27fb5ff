"""Both columns of problem 6 come out in one form."""

from tessaria.llm import queries


def test_panel_and_reviews_come_out_alike(spark, tmp_path):
    texts = ["Ótimo  produto", "Ótimo produto", "ｂｏｍ", "a​b", None]
    spark.createDataFrame([(f"r{i}", f"o{i}", t) for i, t in enumerate(texts)], "review_id string, order_id string, review_comment_message string").write.parquet(f"{tmp_path}/olist_order_reviews_dataset.parquet")
    spark.createDataFrame([(f"o{i}", t) for i, t in enumerate(texts)], "order_id string, review_text string").write.parquet(f"{tmp_path}/panel.parquet")
    every = queries.QUERIES
    panel = {r.order_id: r.review_text for r in every["p6_canonical_panel"](spark, str(tmp_path)).collect()}
    reviews = {r.order_id: r.review_comment_message for r in every["p6_canonical_reviews"](spark, str(tmp_path)).collect()}
    assert panel == reviews and len(panel) == len(texts) and panel["o4"] is None
