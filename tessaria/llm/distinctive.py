"""How characteristic a term is of a record: residual inverse document frequency times record frequency.

    score = tf * ( -log2(df / N) - -log2(1 - exp(-cf / N)) )

df records of N hold the term, cf times in all. The second part is the idf that a Poisson model expects from cf alone,
so a term spread evenly scores about 0 and one concentrated in few records scores high.

Scale: a record's rows are reduced to its distinct texts (one exchange of the texts), then one Arrow pass counts terms
inside each text. Postings are never grouped across rows for the statistics: df and cf are summed inside each batch and
leave it as one row per term. Only records whose rows carry different texts (found by comparing hashes first) go through
an exact grouping by record and term. Postings below the asked tf are not even emitted. The statistics are joined back
by broadcast below a checked size; beyond it by a shuffle whose hot terms adaptive execution splits.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessaria.llm.canonical import clean
from tessaria.plans.materialize import cut, small_side

LEAST_LETTERS = 4
MAX_BROADCAST_ROWS = 200_000
_LETTERS = re.compile(r"[^\W\d_]+")
FLUSH = 100_000


def terms(text: str, least: int = LEAST_LETTERS) -> list[str]:
    """Longest runs of letters of the cleaned text, in lower case, at least so long."""
    return [w for w in _LETTERS.findall(clean(text).lower()) if len(w) >= least]


_COUNTED = T.StructType(
    [T.StructField("record", T.StringType()), T.StructField("term", T.StringType())] + [T.StructField(c, T.LongType()) for c in ("tf", "df", "cf")] + [T.StructField("open", T.BooleanType())]
)


def _count(min_tf: int, least: int) -> Callable:
    """Rows of three kinds: statistics of a batch (record null), postings of single-text records from min_tf on, and all
    postings of records with several texts (open)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, cf = Counter(), Counter()

        def sums() -> pd.DataFrame:
            out = pd.DataFrame({"record": None, "term": list(df), "tf": 0, "df": list(df.values()), "cf": [cf[t] for t in df], "open": False}, columns=_COUNTED.names)
            df.clear()
            cf.clear()
            return out

        for batch in batches:
            rows = []
            for record, text, several in zip(batch["record"], batch["text"], batch["several"]):
                found = terms(text, least)
                if several:
                    rows += [(record, t, n, 0, 0, True) for t, n in Counter(found).items()]
                    continue
                cf.update(found)
                once = set(found)
                df.update(once)
                if min_tf <= 1 or len(once) < len(found):
                    rows += [(record, t, n, 0, 0, False) for t, n in Counter(found).items() if n >= min_tf]
            if rows:
                yield pd.DataFrame(rows, columns=_COUNTED.names)
            if len(df) > FLUSH:
                yield sums()
        if df:
            yield sums()

    return run


def residual_idf(df_: Column, cf: Column, n: Column) -> Column:
    return -F.log2(df_ / n) + F.log2(1 - F.exp(-cf / n))


def scores(df: DataFrame, record: str, text: str, min_tf: int = 1, min_df: int = 1, max_df: int | None = None, least: int = LEAST_LETTERS) -> DataFrame:
    """(record, term, tf, df, cf, ridf, score) of every posting within the given bounds.

    N counts the records with text, df and cf are over all of them. Records with a null id, null, empty or invisible
    text have no terms; an empty table gives no rows; a term repeated in a record counts in tf and cf; repeated rows of
    a record count once, and where its rows carry different texts a term's tf is the largest of them; other columns are
    ignored.
    """
    rows = df.where(F.col(record).isNotNull() & F.col(text).isNotNull() & (F.col(text) != "")).select(F.col(record).cast("string").alias("record"), F.col(text).alias("text"))
    texts = F.xxhash64("text")
    per = rows.groupBy("record").agg(F.min(texts).alias("a"), F.max(texts).alias("z"))
    seen = cut(per.groupBy(F.when(F.col("a") != F.col("z"), F.col("record")).alias("several")).agg(F.count(F.lit(1)).alias("n")))
    total = seen.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("N"))
    several = seen.where("several IS NOT NULL").select(F.col("several").alias("_r"), F.lit(True).alias("several"))
    flagged = rows.distinct().join(small_side(several, MAX_BROADCAST_ROWS), F.col("record") == F.col("_r"), "left").select("record", "text", F.coalesce("several", F.lit(False)).alias("several"))
    counted = cut(flagged.mapInPandas(_count(min_tf, least), _COUNTED))
    merged = counted.where("open").groupBy("record", "term").agg(F.max("tf").alias("tf"))
    stats = counted.where("record IS NULL").select("term", "df", "cf").unionByName(merged.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")))
    stats = stats.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
    bound = F.col("df") >= min_df
    if max_df is not None:
        bound &= F.col("df") <= max_df
    posts = counted.where("record IS NOT NULL AND NOT open").select("record", "term", "tf").unionByName(merged.where(F.col("tf") >= min_tf))
    kept = posts.join(small_side(cut(stats.where(bound)), MAX_BROADCAST_ROWS), "term").crossJoin(F.broadcast(total))  # total is one row
    ridf = residual_idf(F.col("df"), F.col("cf"), F.col("N"))
    return kept.select("record", "term", "tf", "df", "cf", ridf.alias("ridf"), (F.col("tf") * ridf).alias("score"))
