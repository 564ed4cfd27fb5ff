"""Every query of the subpackage on the smallest tables, beside its SQL where there is one."""

import pytest

from tessaria.llm.queries import QUERIES, SQL
from tests.compare import compare


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, small, name):
    assert compare(spark, small, QUERIES[name], SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_over_whole_tables(spark, small, name):
    rows = QUERIES[name](spark, small)
    assert rows.count() > 0 and len(set(rows.columns)) == len(rows.columns)


def test_found_cases_come_from_the_operators(spark, small):
    """Rows of pN_found are those that the operators' own results name."""
    scores = QUERIES["p4_term_scores"](spark, small).where("tf >= 2 AND df BETWEEN 2 AND 8").select("order_id", "term")
    assert sorted(scores.collect()) == sorted(QUERIES["p4_found"](spark, small).collect())
    kinds = QUERIES["p10_statistics"](spark, small).where("kind <> 'prose'").select("doc_id", "kind")
    assert sorted(kinds.collect()) == sorted(QUERIES["p10_found"](spark, small).collect())
    leaks = QUERIES["p8_leaks"](spark, small).where("longest >= 12").select("doc_id", "item_id")
    assert sorted(leaks.collect()) == sorted(QUERIES["p8_found"](spark, small).collect())


def test_canonical_texts_of_equal_comments_are_equal(spark, small):
    """Where p6_found names an order, its two texts are one after the clean-up, but for white space."""
    found = {r.order_id for r in QUERIES["p6_found"](spark, small).collect()}
    norm = lambda t: " ".join((t or "").split())
    reviews = {}
    for r in QUERIES["p6_canonical_reviews"](spark, small).collect():
        reviews.setdefault(r.order_id, set()).add(norm(r.review_comment_message))
    panel = {}
    for r in QUERIES["p6_canonical_panel"](spark, small).collect():
        panel.setdefault(r.order_id, set()).add(norm(r.review_text))
    assert found and all(reviews[o] & panel[o] for o in found)


def test_masked_texts_hold_no_item_that_was_found(spark, small):
    """After masking, a second pass finds no email and no number of a revealing shape."""
    from tessaria.llm import pii

    masked = QUERIES["p3_sanitised_reviews"](spark, small).select("review_comment_message")
    again = pii.sanitised(masked, "review_comment_message", pii.learn(masked)).select("pii.kinds")
    left = {k for r in again.collect() for k in r.kinds}
    assert not left & {"email", "address"}
