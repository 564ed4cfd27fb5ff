"""Queries of this subpackage, each with its SQL where there is one."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaria.llm import canonical, distinctive, leakage, mixing, percentiles, pii, prose
from tessaria.plans.materialize import cut
from tessaria.sources.tables import norm_id, norm_state, table

REVIEWS = "olist_order_reviews_dataset"


PS = (0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
WIDTH = 0.001  # days: a percentile's middle is wrong by 43 seconds at most
STEP = 4096  # cells of WIDTH that a cell of the joinable state spans: about four days


def _delivery_rows(spark: SparkSession, d: str) -> DataFrame:
    """(customer_state, week, cell) of delivery_days; an order's repeated rows count once. Only a hash of the id is
    shuffled: rows that share it besides state, week and value are repeats."""
    rows = table(spark, d, "panel").select(norm_state("customer_state").alias("customer_state"), F.to_date("week").alias("week"), percentiles.finite(F.col("delivery_days")).alias("v"), F.xxhash64(norm_id("order_id")).alias("id"))
    rows = rows.where(F.col("v").isNotNull()).distinct()
    return cut(rows.select("customer_state", F.date_format("week", "yyyy-MM-dd").alias("week"), percentiles.cell_of(F.col("v"), WIDTH).alias("cell")))


def _delivery_percentiles(rows: DataFrame, weekly: DataFrame, groups: list[str]) -> DataFrame:
    """By the states of weeks, joined, and passes over the rows."""
    out = percentiles.percentiles(percentiles.merge(weekly, groups), groups, PS, WIDTH, rows=rows, step=STEP)
    return out.select(*groups, "p", "n", "rank", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), F.round((F.col("low") + F.col("high")) / 2, 6).alias("value"), F.lit(WIDTH / 2).alias("max_error"))


def p1_percentiles_by_state_week(spark: SparkSession, d: str) -> DataFrame:
    rows = _delivery_rows(spark, d)
    return _delivery_percentiles(rows, percentiles.coarse(rows, ["customer_state", "week"], STEP), ["customer_state", "week"])


def p1_percentiles_by_state(spark: SparkSession, d: str) -> DataFrame:
    """Whole span per state, from the joined states of the weeks."""
    rows = _delivery_rows(spark, d)
    return _delivery_percentiles(rows, percentiles.coarse(rows, ["customer_state", "week"], STEP), ["customer_state"])


def p1_percentiles_by_quarter(spark: SparkSession, d: str) -> DataFrame:
    """All states per quarter of the week, from the same weekly states."""
    q = F.concat(F.substring("week", 1, 4), F.lit("Q"), F.quarter(F.col("week").cast("date")).cast("string"))
    rows = _delivery_rows(spark, d)
    weekly = percentiles.coarse(rows, ["customer_state", "week"], STEP)
    return _delivery_percentiles(rows.withColumn("quarter", q), weekly.withColumn("quarter", q), ["quarter"])


def _reviews(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, REVIEWS).select(norm_id("review_id").alias("review_id"), norm_id("order_id").alias("order_id"), "review_comment_message")


def _panel_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "panel").select(norm_id("order_id").alias("order_id"), "review_text")


def _pii_terms(spark: SparkSession, d: str) -> DataFrame:
    return pii.learn(_reviews(spark, d).select("review_comment_message"), _panel_texts(spark, d).select("review_text"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    terms = _pii_terms(spark, d)
    reviews = pii.kinds_of(_reviews(spark, d), F.col("review_id"), "review_comment_message", terms, "review")
    return reviews.unionByName(pii.kinds_of(_panel_texts(spark, d), F.col("order_id"), "review_text", terms, "panel"))


def p3_sanitised_reviews(spark: SparkSession, d: str) -> DataFrame:
    out = pii.sanitised(_reviews(spark, d), "review_comment_message", _pii_terms(spark, d))
    return out.select("review_id", "order_id", F.col("pii.text").alias("review_comment_message"), F.array_join(F.array_sort(F.array_distinct("pii.kinds")), ",").alias("kinds"))


def p3_sanitised_panel(spark: SparkSession, d: str) -> DataFrame:
    out = pii.sanitised(_panel_texts(spark, d), "review_text", _pii_terms(spark, d))
    return out.select("order_id", F.col("pii.text").alias("review_text"), F.array_join(F.array_sort(F.array_distinct("pii.kinds")), ",").alias("kinds"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    found = distinctive.scores(_panel_texts(spark, d), "order_id", "review_text", min_tf=2, min_df=2, max_df=8)
    return found.select(F.col("record").alias("order_id"), "term")


def p4_term_scores(spark: SparkSession, d: str) -> DataFrame:
    s = distinctive.scores(_panel_texts(spark, d), "order_id", "review_text")
    return s.select(F.col("record").alias("order_id"), "term", F.col("tf").cast("long").alias("tf"), "df", "cf", F.round("ridf", 6).alias("ridf"), F.round("score", 6).alias("score"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    comments = _reviews(spark, d).where(F.col("order_id").isNotNull() & F.col("review_comment_message").isNotNull())
    shown = F.regexp_replace("review_comment_message", r"[\s\p{Z}\p{Cf}]+", "") != ""
    comments = comments.where(shown)
    one = comments.groupBy("order_id").agg(F.min("review_id").alias("least"), F.max("review_id").alias("most")).where(F.col("least") == F.col("most")).select("order_id")
    alike = canonical.same_look(_panel_texts(spark, d), comments, "order_id", "review_text", "review_comment_message")
    return alike.join(one, "order_id", "left_semi")


def p6_canonical_reviews(spark: SparkSession, d: str) -> DataFrame:
    return _reviews(spark, d).select("review_id", "order_id", canonical.clean_text(F.col("review_comment_message")).alias("review_comment_message"))


def p6_canonical_panel(spark: SparkSession, d: str) -> DataFrame:
    return _panel_texts(spark, d).select("order_id", canonical.clean_text(F.col("review_text")).alias("review_text"))


def p6_equal_look_groups(spark: SparkSession, d: str) -> DataFrame:
    both = _panel_texts(spark, d).toDF("id", "t").unionByName(_reviews(spark, d).select(F.col("order_id").alias("id"), F.col("review_comment_message").alias("t")))
    return canonical.groups_of_equal_look(both, "id", "t")


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    found = leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.withColumn("coverage", F.round("coverage", 6))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_leaks(spark, d).select("doc_id", "item_id")


def p8_leaked_items(spark: SparkSession, d: str) -> DataFrame:
    """Per item: documents that leak it, the best coverage, the longest passage."""
    return p8_leaks(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.max("coverage").alias("best_coverage"), F.max("longest").alias("longest"))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    sizes = mixing.sized(table(spark, d, "documents"))
    return mixing.draw(sizes, mixing.plan(sizes, table(spark, d, "mix_targets")))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    sizes = mixing.sized(table(spark, d, "documents"))
    shares = mixing.plan(sizes, table(spark, d, "mix_targets"))
    return mixing.report(mixing.draw(sizes, shares), shares)


def p10_statistics(spark: SparkSession, d: str) -> DataFrame:
    out = prose.judged(table(spark, d, "documents").select("doc_id", "text"))
    return out.select("doc_id", *prose.COUNTS, *[F.round(c, 6).alias(c) for c in prose.FIGURES], F.array_join("reasons", ",").alias("reasons"), "kind", F.array_join("published", ",").alias("published"))


def p10_plain_figures(spark: SparkSession, d: str) -> DataFrame:
    """The figures of p10_statistics that SQL can say."""
    out = prose.judged(table(spark, d, "documents").select("doc_id", "text"))
    figures = ("mean_word_length", "symbol_ratio", "letter_share", "terminal_line_share", "ellipsis_line_share", "alphabetic_word_share", "common_word_share", "distinct_word_share", "repeated_line_share", "hash_ratio", "symbol_word_share")
    return out.select("doc_id", *prose.COUNTS, *[F.round(c, 6).alias(c) for c in figures])


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return prose.judged(table(spark, d, "documents").select("doc_id", "text")).where(F.col("kind") != "prose").select("doc_id", "kind")


QUERIES = {
    "p1_percentiles_by_state_week": p1_percentiles_by_state_week,
    "p1_percentiles_by_state": p1_percentiles_by_state,
    "p1_percentiles_by_quarter": p1_percentiles_by_quarter,
    "p3_found": p3_found,
    "p3_sanitised_reviews": p3_sanitised_reviews,
    "p3_sanitised_panel": p3_sanitised_panel,
    "p4_found": p4_found,
    "p4_term_scores": p4_term_scores,
    "p6_found": p6_found,
    "p6_canonical_reviews": p6_canonical_reviews,
    "p6_canonical_panel": p6_canonical_panel,
    "p6_equal_look_groups": p6_equal_look_groups,
    "p8_found": p8_found,
    "p8_leaks": p8_leaks,
    "p8_leaked_items": p8_leaked_items,
    "p9_mixture": p9_mixture,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_statistics": p10_statistics,
    "p10_plain_figures": p10_plain_figures,
}


def _percentile_sql(group: str, columns: str) -> str:
    return f"""
WITH v AS (SELECT DISTINCT lower(trim(order_id)) AS id, nullif(upper(trim(customer_state)), '') AS customer_state, strftime(week AT TIME ZONE 'UTC', '%Y-%m-%d') AS week, delivery_days AS v
           FROM panel WHERE NOT isnan(delivery_days) AND NOT isinf(delivery_days)),
g AS (SELECT {group}, floor(v / {WIDTH})::BIGINT AS cell FROM v),
r AS (SELECT *, row_number() OVER (PARTITION BY {columns} ORDER BY cell) AS k, count(*) OVER (PARTITION BY {columns}) AS n FROM g),
p AS (SELECT unnest([{", ".join(f"{p}::DOUBLE" for p in PS)}]) AS p)
SELECT {columns}, p, n, k AS rank, round(cell * {WIDTH}::DOUBLE, 6) AS low, round((cell + 1) * {WIDTH}::DOUBLE, 6) AS high,
       round((cell * {WIDTH}::DOUBLE + (cell + 1) * {WIDTH}::DOUBLE) / 2, 6) AS value, {WIDTH / 2}::DOUBLE AS max_error
FROM r JOIN p ON k = greatest(ceil(p * n), 1)"""


SQL = {
    "p1_percentiles_by_state_week": _percentile_sql("customer_state, week", "customer_state, week"),
    "p1_percentiles_by_state": _percentile_sql("customer_state", "customer_state"),
    "p1_percentiles_by_quarter": _percentile_sql("concat(week[1:4], 'Q', quarter(week::DATE)) AS quarter", "quarter"),
}


@lru_cache
def _prototypes() -> str:
    """A SQL map of each composed character that the canonical form changes (context apart) to what it becomes."""
    pairs = []
    for i in (*range(0x80, 0xAC00), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0xE0000, 0xE01F0)):
        c = chr(i)
        to = unicodedata.normalize("NFC", "".join(map(canonical.prototype, unicodedata.normalize("NFD", c))))
        if to != unicodedata.normalize("NFC", c):
            pairs.append((c, to.replace("'", "''")))
    said = lambda xs: ", ".join(f"'{x}'" for x in xs)
    return f"MAP([{said(c for c, _ in pairs)}], [{said(x for _, x in pairs)}])"


def _canonical(column: str) -> str:
    each = f"lambda c: CASE WHEN c < chr(128) THEN c ELSE coalesce({_prototypes()}[c], c) END"
    text = f"nfc_normalize({column})"
    return f"CASE WHEN regexp_matches({column}, '[^\\x00-\\x7f]') THEN nfc_normalize(array_to_string(list_transform(regexp_extract_all({text}, '(?s).'), {each}), '')) ELSE {column} END"


_LETTERS, _WORDS = r"[\p{L}\p{Nl}\p{No}]+", r"[\p{L}\p{N}]+"
_S, _W, _L = f"[{prose.SPACE}]", f"[^{prose.SPACE}]", r"\p{L}"


def _terms_sql(tail: str) -> str:
    return f"""
WITH t AS (SELECT DISTINCT nullif(lower(trim(order_id)), '') AS id, review_text FROM panel WHERE review_text <> '' AND trim(order_id) <> ''),
w AS (SELECT id, review_text, unnest(regexp_extract_all(lower({_canonical("review_text")}), '{_LETTERS}')) AS term FROM t),
f AS (SELECT id, term, max(n) AS tf FROM (SELECT id, review_text, term, count(*) AS n FROM w WHERE length(term) >= {distinctive.LEAST_LETTERS} GROUP BY ALL) GROUP BY ALL),
s AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM f GROUP BY 1), n AS (SELECT count(DISTINCT id) AS n FROM t),
p AS (SELECT id AS order_id, term, tf, df, cf, -log2(df / n) + log2(1 - exp(-cf / n)) AS ridf FROM f JOIN s USING (term), n) {tail}"""


def _looks_sql() -> str:
    look = lambda c: f"trim(regexp_replace({_canonical(c)}, '\\s+', ' ', 'g'))"
    return f"""
WITH r AS (SELECT nullif(lower(trim(order_id)), '') AS order_id, nullif(lower(trim(review_id)), '') AS review_id, review_comment_message AS u, {look("review_comment_message")} AS look FROM {REVIEWS} WHERE review_comment_message IS NOT NULL),
shown AS (SELECT * FROM r WHERE look <> '' AND order_id IS NOT NULL),
one AS (SELECT order_id FROM shown GROUP BY 1 HAVING count(DISTINCT review_id) = 1),
p AS (SELECT nullif(lower(trim(order_id)), '') AS order_id, review_text AS t, {look("review_text")} AS look FROM panel WHERE review_text IS NOT NULL)
SELECT DISTINCT order_id FROM p JOIN shown USING (order_id, look) JOIN one USING (order_id) WHERE t <> u"""


def _groups_sql() -> str:
    look = lambda c: f"md5(trim(regexp_replace({_canonical(c)}, '\\s+', ' ', 'g')))"
    return f"""
WITH t AS (SELECT review_text AS t, {look("review_text")} AS look FROM panel WHERE review_text IS NOT NULL
  UNION ALL SELECT review_comment_message, {look("review_comment_message")} FROM {REVIEWS} WHERE review_comment_message IS NOT NULL)
SELECT look, count(*) AS n_rows, count(DISTINCT t) AS n_forms FROM t GROUP BY 1 HAVING count(DISTINCT t) > 1"""


def _clean_sql(table_name: str, columns: str, column: str) -> str:
    """Line by line; joiners and selectors behind an emoji are put aside as private signs and put back."""
    emoji = "[\\x{2600}-\\x{27bf}\\x{2b00}-\\x{2bff}\\x{1f000}-\\x{1faff}\\x{e000}\\x{e001}]"
    text = f"regexp_replace({column}, '\\r\\n|[\\r\\x0b\\x0c\\x{{85}}\\x{{2028}}\\x{{2029}}]', chr(10), 'g')"
    text = f"regexp_replace(replace({text}, chr(9), ' '), '[\\x00-\\x08\\x0e-\\x1f\\x7f]', '', 'g')"
    for _ in range(3):
        for code, private in (("200d", 0xE000), ("fe0f", 0xE001)):
            text = f"regexp_replace({text}, '({emoji})\\x{{{code}}}', '\\1' || chr({private}), 'g')"
    lines = f"list_transform(string_split({_canonical('t')}, chr(10)), lambda l: trim(regexp_replace(l, ' +', ' ', 'g'), ' '))"
    back = f"translate(array_to_string({lines}, chr(10)), chr({0xE000}) || chr({0xE001}), chr({0x200D}) || chr({0xFE0F}))"
    return f"WITH a AS (SELECT {columns}, {text} AS t FROM {table_name}) SELECT * EXCLUDE (t), nfc_normalize({back}) AS {column} FROM a"


def _leaks_sql() -> str:
    ws = lambda c: f"regexp_extract_all(strip_accents(lower({_canonical(c)})), '{_WORDS}')"
    runs = f"unnest(list_transform(range(1, len(w) - {leakage.LEAST - 2}), lambda i: array_to_string(w[i:i + {leakage.LEAST - 1}], ' ')))"
    return f"""
WITH d AS (SELECT doc_id, {ws("text")} AS w FROM documents), e AS (SELECT item_id, {ws("text")} AS w FROM eval_items),
ds AS (SELECT DISTINCT doc_id, {runs} AS run FROM d), es AS (SELECT DISTINCT item_id, {runs} AS run FROM e)
SELECT DISTINCT doc_id, item_id FROM ds JOIN es USING (run)"""


def _figures_sql() -> str:
    common = ", ".join(f"'{w}'" for w in sorted(prose.COMMON))
    ends = prose.TERMINAL.replace("'", "''")
    share = lambda a, b, name: f"round(CASE WHEN {b} > 0 THEN ({a})::DOUBLE / ({b}) ELSE 0 END, 6) AS {name}"
    return f"""
WITH a AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
b AS (SELECT doc_id, t, list_filter(regexp_extract_all(lower(t), '{_LETTERS}'), lambda w: length(w) > 0) AS w, regexp_extract_all(t, '{_W}+') AS k,
      list_filter(list_transform(string_split(t, chr(10)), lambda l: regexp_replace(regexp_replace(l, '^{_S}+', ''), '{_S}+$', '')), lambda l: length(l) > 0) AS l FROM a),
c AS (SELECT *, len(w) AS nw, len(k) AS nk, len(l) AS nl, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS letters, coalesce(list_sum(list_transform(k, lambda x: length(x))), 0) AS shown,
      len(list_filter(w, lambda x: list_contains([{common}], x))) AS nc FROM b)
SELECT doc_id, length(t)::BIGINT AS n_chars, (CASE WHEN nl > 0 THEN nw ELSE 0 END)::BIGINT AS n_words, nl::BIGINT AS n_lines, (CASE WHEN nl > 0 THEN nc ELSE 0 END)::BIGINT AS n_common,
  {share("letters", "nw", "mean_word_length")}, {share("len(regexp_extract_all(t, '" + prose.SYMBOL.replace("'", "''") + "'))", "nk", "symbol_ratio")}, {share("letters", "shown", "letter_share")},
  {share(f"len(list_filter(l, lambda x: regexp_matches(x, '[{ends}]$')))", "nl", "terminal_line_share")}, {share(f"len(list_filter(l, lambda x: regexp_matches(x, '{prose.ELLIPSIS}')))", "nl", "ellipsis_line_share")},
  {share("len(list_filter(k, lambda x: regexp_matches(x, '" + _L + "')))", "nk", "alphabetic_word_share")}, {share("nc", "nw", "common_word_share")}, {share("len(list_distinct(w))", "nw", "distinct_word_share")},
  {share("nl - len(list_distinct(l))", "nl", "repeated_line_share")}, {share("len(regexp_extract_all(t, '#|…|[.][.][.]'))", "nw", "hash_ratio")}, {share(f"len(list_filter(k, lambda x: NOT regexp_matches(x, '[{prose.SIGN}]')))", "nk", "symbol_word_share")}
FROM c"""


SQL |= {
    "p4_found": _terms_sql("SELECT order_id, term FROM p WHERE tf >= 2 AND df BETWEEN 2 AND 8"),
    "p4_term_scores": _terms_sql("SELECT order_id, term, tf, df, cf, round(ridf, 6) AS ridf, round(tf * ridf, 6) AS score FROM p"),
    "p6_found": _looks_sql(),
    "p6_equal_look_groups": _groups_sql(),
    "p6_canonical_reviews": _clean_sql(REVIEWS, "nullif(lower(trim(review_id)), '') AS review_id, nullif(lower(trim(order_id)), '') AS order_id", "review_comment_message"),
    "p6_canonical_panel": _clean_sql("panel", "nullif(lower(trim(order_id)), '') AS order_id", "review_text"),
    "p8_found": _leaks_sql(),
    "p10_plain_figures": _figures_sql(),
}
