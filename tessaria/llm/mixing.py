"""Mixing sources to target weights by capped water-filling, in tokens of a public tokenizer.

Each source gets its weight's share of the total. A source that cannot reach it (its documents times their greatest
repetition) is clamped at its most, and what it lacks is shared out over the others in proportion to their weights,
until no source is above its cap. A source's allotment is then drawn as whole repetitions of all its documents plus a
seeded sample for the fraction: documents in the order of a hash of their id, up to the tokens that are missing.

Scale: tokens are counted once, in Arrow batches. The sample needs no sort of a source: ids are hashed to 65536 ranges,
the tokens of the ranges are summed, all documents of the ranges before the last needed one are taken, and only that
range is put in order. A source that holds a third of all documents is so spread over as many ranges. The driver sees
one row per target.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Sequence
from dataclasses import dataclass, replace

import pandas as pd
from pyspark import SparkFiles, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessaria.plans.materialize import cut, small_side

TOKENIZER_DIR = "/opt/tokenizers"
TOKENIZER = "byte_bpe_50k.tiktoken"
#: Fixed value: the pre-tokenization pattern that belongs to the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
RANGES = 1 << 16
MAX_BROADCAST_RANGES = 500_000
_loaded: dict = {}


def ship_vocabulary(spark: SparkSession, folder: str = TOKENIZER_DIR, name: str = TOKENIZER) -> None:
    """Lets Spark serve the rank file to every executor; only the driver needs the folder."""
    if not os.path.exists(f"{folder}/{name}"):
        raise FileNotFoundError(f"no vocabulary {folder}/{name}")
    spark.sparkContext.addFile(f"{folder}/{name}")


def tokenizer(folder: str = TOKENIZER_DIR, name: str = TOKENIZER):
    """The public byte-level BPE of a rank file, loaded once per process; in tasks, from what was shipped."""
    if (folder, name) not in _loaded:
        import tiktoken

        with open(SparkFiles.get(name) if TaskContext.get() else f"{folder}/{name}", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[folder, name] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[folder, name]


def token_count(text: Column, folder: str = TOKENIZER_DIR, name: str = TOKENIZER) -> Column:
    """Tokens of a whole text; 0 for null and empty ones. ship_vocabulary comes first."""

    @F.pandas_udf(T.LongType())
    def count(texts: pd.Series) -> pd.Series:
        t = tokenizer(folder, name)
        return pd.Series([len(t.encode_ordinary(x)) if x else 0 for x in texts], dtype="int64")

    return count(text)


@dataclass(frozen=True)
class Share:
    """A target and what it gets: tokens there are, the most it may give, its allotment."""

    source: str
    target: float
    max_repeats: int
    tokens: int
    allotted: float = 0.0
    clamped: bool = False

    @property
    def most(self) -> int:
        return self.tokens * self.max_repeats

    @property
    def whole(self) -> int:
        return int(self.allotted // self.tokens) if self.tokens else 0

    @property
    def rest(self) -> float:
        return self.allotted - self.whole * self.tokens if self.tokens else 0.0


def fill(shares: Sequence[Share], total: float) -> list[Share]:
    """Capped water-filling of `total` tokens; less is filled where all sources together cannot give it."""
    open_, done, left = list(shares), [], float(total)
    while open_:
        weight = sum(s.target for s in open_)
        over = [s for s in open_ if weight <= 0 or s.most <= left * s.target / weight]
        if not over:
            done += [replace(s, allotted=left * s.target / weight) for s in open_]
            break
        for s in over:
            got = float(s.most) if s.target > 0 else 0.0
            done.append(replace(s, allotted=got, clamped=True))
            left -= got
        open_ = [s for s in open_ if s not in over]
    return sorted(done, key=lambda s: s.source)


def source_key(c: Column) -> Column:
    c = F.lower(F.trim(c))
    return F.when(c != "", c)


def sized(docs: DataFrame, folder: str = TOKENIZER_DIR, name: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, n_tokens), one row per document, materialised. Repeated rows of an id are one document, its
    longest; documents without id, source or tokens cannot be drawn."""
    ship_vocabulary(docs.sparkSession, folder, name)
    rows = docs.where(F.col("doc_id").isNotNull()).select("doc_id", source_key(F.col("source")).alias("source"), token_count(F.col("text"), folder, name).alias("n_tokens"))
    rows = rows.where(F.col("source").isNotNull() & (F.col("n_tokens") > 0))
    best = F.max(F.struct("n_tokens", "source")).alias("b")
    return cut(rows.groupBy("doc_id").agg(best).select("doc_id", "b.source", "b.n_tokens"))


def plan(sizes: DataFrame, targets: DataFrame, total: int | None = None) -> list[Share]:
    """The filled shares of all targets. total: tokens to draw; by default as many as the targeted sources have.

    Targets of one source under several spellings are one: shares are added, the smallest repetition holds. A null,
    NaN or negative share or repetition counts as 0.
    """
    have = sizes.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    share = F.greatest(F.coalesce(F.nanvl(F.col("target_share").cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0))
    want = targets.select(source_key(F.col("source")).alias("source"), share.alias("t"), F.greatest(F.coalesce(F.col("max_repeats"), F.lit(0)), F.lit(0)).alias("m")).where(F.col("source").isNotNull())
    want = want.groupBy("source").agg(F.sum("t").alias("t"), F.min("m").alias("m"))
    rows = want.join(have, "source", "left").collect()  # one row per target
    shares = [Share(r["source"], r["t"], r["m"], r["tokens"] or 0) for r in rows]
    return fill(shares, total if total is not None else sum(s.tokens for s in shares))


def draw(sizes: DataFrame, shares: Sequence[Share], seed: int = 42) -> DataFrame:
    """(doc_id, source, n_tokens, repeats) of the documents drawn at least once."""
    spark = sizes.sparkSession
    rows = spark.createDataFrame([(s.source, s.whole, s.rest) for s in shares], "source string, whole long, rest double")
    h = F.xxhash64(F.col("doc_id"), F.lit(seed))
    docs = sizes.join(F.broadcast(rows), "source").withColumn("h", h).withColumn("range", F.shiftrightunsigned("h", 48))  # one row per target
    per = docs.groupBy("source", "range").agg(F.sum("n_tokens").alias("k"))
    before = F.coalesce(F.sum("k").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = cut(per.withColumn("before", before).select(F.col("source").alias("_s"), F.col("range").alias("_r"), "before", "k"))
    docs = docs.join(small_side(per, MAX_BROADCAST_RANGES), (F.col("source") == F.col("_s")) & (F.col("range") == F.col("_r")))
    whole_range = F.col("before") + F.col("k") <= F.col("rest")
    edge = ~whole_range & (F.col("before") < F.col("rest"))
    in_order = Window.partitionBy("source", "range").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    cut_off = docs.where(edge).withColumn("to", F.col("before") + F.sum("n_tokens").over(in_order))
    # the document at the edge is taken if that comes nearer to the allotment
    more = cut_off.withColumn("extra", (F.col("to") - F.col("n_tokens") / 2 <= F.col("rest")).cast("long")).drop("to")
    full = docs.where(~edge).withColumn("extra", whole_range.cast("long"))
    drawn = full.unionByName(more).withColumn("repeats", F.col("whole") + F.col("extra"))
    return drawn.where("repeats > 0").select("doc_id", "source", "n_tokens", "repeats")


def report(drawn: DataFrame, shares: Sequence[Share]) -> DataFrame:
    """One row per target: its share, tokens there are, tokens allotted and drawn, documents, the share reached, whether
    the target could be reached."""
    spark = drawn.sparkSession
    weight = sum(s.target for s in shares) or 1.0
    rows = spark.createDataFrame(
        [(s.source, s.target / weight, s.max_repeats, s.tokens, s.allotted, s.clamped) for s in shares],
        "source string, target_share double, max_repeats int, available_tokens long, allotted_tokens double, clamped boolean",
    )
    got = drawn.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("drawn_tokens"), F.count(F.lit(1)).alias("n_docs"), F.max("repeats").alias("most_repeats"))
    zero = {"drawn_tokens": 0, "n_docs": 0, "most_repeats": 0}
    out = rows.join(got, "source", "left").fillna(zero)
    total = F.sum("drawn_tokens").over(Window.partitionBy())  # one row per target
    return out.withColumn("actual_share", F.coalesce(F.try_divide("drawn_tokens", total), F.lit(0.0)))
