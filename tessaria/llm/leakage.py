"""Evaluation texts leaking into training text: greedy string tiling over running Karp-Rabin fingerprints.

Words of the canonical text, without case and accents, are compared. Every run of `least` words of an item is a seed,
known by a rolling fingerprint. A document's fingerprints are computed for all its places at once; where one equals a
seed's, the match is verified word by word and extended as far as it goes. Tiling then repeatedly marks the longest
match whose words are still unmarked in both texts, so passages that were reordered or cut into parts each count, and
reports coverage, tiles and the longest one for each document and item.

Scale: a document is cut into words once, by one task, and only documents that share a seed with an item go on, each with
the items it shares it with. While the items hold at most `block_words` words together, all their seeds (16 bytes each)
are broadcast. Beyond, seeds are joined by a shuffle instead, for any number of items: of every `least` - SELECT + 1
neighbouring runs of SELECT words the one of the least fingerprint is taken on both sides, so a shared passage shares one
of them, and some third of the words is shuffled. Items never pass through the driver, and no work but the tiling of
matched pairs depends on their number.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessaria.llm.canonical import clean, foreign, prototype
from tessaria.llm.layout import TABLE, Runs, laid_out
from tessaria.plans.materialize import cut, small_side

LEAST = 12
BLOCK_WORDS = 2_000_000
SLICE_CHARS = 2_000_000
SELECT, MAX_BROADCAST_TEXT, MAX_BROADCAST_PAIRS = 8, 64 << 20, 1_000_000
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_WORD = re.compile(r"[^\W_]+")


def _bare(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


def words(text: str) -> list[str]:
    """What is compared: longest runs of letters or digits of the canonical text, in lower case, without accents."""
    return _WORD.findall(_bare(clean(text).lower()))


IN, DROP, CONTEXT = 1, 2, 4


@lru_cache
def _folding() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point: whether it belongs to words, leaves no trace, or needs its text to be judged; what it folds to."""
    kinds, to = np.zeros(TABLE + 1, np.uint8), np.arange(TABLE + 1, dtype=np.uint32)
    for i in range(TABLE):
        c = chr(i)
        bare = _bare("".join(map(prototype, unicodedata.normalize("NFD", c))).lower())
        if c.isalnum() and foreign(c) or len(bare) > 1:
            kinds[i] = CONTEXT
        elif not bare:
            kinds[i] = DROP
        else:
            to[i] = min(ord(bare), TABLE)
            kinds[i] = IN if _WORD.match(bare) else 0
    kinds[TABLE] = CONTEXT
    return kinds, to


def word_codes(texts: list[str]) -> list[np.ndarray]:
    """64-bit codes of the words of each text, the same on every machine; all texts are cut and folded at once."""
    kinds, to = _folding()
    out: list[np.ndarray] = []
    for part in _slices(texts):
        codes, bounds = laid_out(part)
        kind = kinds[codes]
        if (odd := np.unique(np.searchsorted(bounds, np.flatnonzero(kind == CONTEXT), "right") - 1)).size:
            part = list(part)
            for i in odd:  # texts with ligatures or other alphabets: their words as `words` has them
                part[i] = " ".join(words(part[i]))
            codes, bounds = laid_out(part)
            kind = np.where(kinds[codes] == CONTEXT, IN, kinds[codes])
        if (gone := kind == DROP).any():
            bounds = bounds - np.append(0, np.cumsum(gone))[bounds]
            codes, kind = codes[~gone], kind[~gone]
        runs = Runs(kind == IN, bounds)
        out += np.split(runs.hashes(to[codes]), np.cumsum(runs.count)[:-1])
    return out


def _slices(texts: list[str]) -> Iterator[list[str]]:
    """Neighbouring texts of SLICE_CHARS together; a longer one is a slice of its own."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > SLICE_CHARS:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def fingerprints(codes: np.ndarray, least: int) -> np.ndarray:
    """The Karp-Rabin fingerprint of every run of `least` words, modulo 2**64."""
    n = len(codes) - least + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(least):
            out = out * BASE + codes[j : j + n]
    return out


def selected(codes: np.ndarray, least: int) -> np.ndarray:
    """Seeds of which any two texts that share `least` words in a row share one: the least of neighbouring fingerprints."""
    size = min(SELECT, least)
    f = fingerprints(codes, size)
    n = len(f) - (least - size)
    if n <= 0:
        return np.empty(0, np.uint64)
    return np.unique(np.min([f[j : j + n] for j in range(least - size + 1)], axis=0))


def seeds_of(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(place in the document, place in the item) of equal fingerprints; arguments are codes of words."""
    f, g = fingerprints(doc, least), fingerprints(item, least)
    order = np.argsort(g, kind="stable")
    g = g[order]
    left, right = np.searchsorted(g, f, "left"), np.searchsorted(g, f, "right")
    return [(int(d), int(order[k])) for d in np.flatnonzero(right > left) for k in range(left[d], right[d])]


def tile(doc: list[str], item: list[str], seeds: list[tuple[int, int]], least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in doc, place in item, length) of the tiles, the longest first."""
    at = set(seeds)
    free_d, free_i = [True] * len(doc), [True] * len(item)
    runs: list[tuple[int, int, int]] = []  # as a heap: minus length, place in doc, place in item
    for d, i in at:
        if (d - 1, i - 1) not in at:  # each maximal run is extended once, from its first seed
            n = 0
            while d + n < len(doc) and i + n < len(item) and doc[d + n] == item[i + n]:
                n += 1
            if n >= least:
                runs.append((-n, d, i))
    heapq.heapify(runs)
    tiles = []
    while runs:
        n, d, i = heapq.heappop(runs)
        free = [free_d[d + k] and free_i[i + k] for k in range(-n)]
        if all(free):
            tiles.append((d, i, -n))
            for k in range(-n):
                free_d[d + k] = free_i[i + k] = False
            continue
        k = 0
        while k < -n:  # what earlier tiles left of the run
            e = k
            while e < -n and free[e]:
                e += 1
            if e - k >= least:
                heapq.heappush(runs, (k - e, d + k, i + k))
            k = e + 1
    return tiles


_LEAKS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("item_id", T.LongType())]
    + [T.StructField(c, T.LongType()) for c in ("n_tiles", "longest", "matched_words", "item_words")]
)


_SEEDS = T.StructType([T.StructField("id", T.LongType()), T.StructField("seed", T.LongType())])
_MATCHED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("item_id", T.LongType())])


def _seeds(of: Callable[[np.ndarray], np.ndarray]) -> Callable:
    """(id, seed) of every text of (id, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [of(c).astype(np.int64) for c in word_codes(batch.iloc[:, 1].tolist())]
            yield pd.DataFrame({"id": np.repeat(batch.iloc[:, 0].to_numpy(), [len(x) for x in found]), "seed": np.concatenate(found) if found else []})

    return run


def _matched(shared, least: int) -> Callable:
    """Documents with each item they share a seed with; shared: seeds in order, and the item of each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seeds, items = shared.value
        for batch in batches:
            texts = batch["text"].tolist()
            codes = word_codes(texts)
            ends = np.cumsum([len(c) for c in codes])
            f = fingerprints(np.concatenate([*codes, np.empty(0, np.uint64)]), least).astype(np.int64)
            left, right = np.searchsorted(seeds, f, "left"), np.searchsorted(seeds, f, "right")
            hits = np.flatnonzero(right > left)
            docs = np.searchsorted(ends, hits, "right")
            inside = hits + least <= ends[docs] if len(hits) else np.zeros(0, bool)
            pairs = {(d, i) for h, d in zip(hits[inside].tolist(), docs[inside].tolist()) for i in items[left[h] : right[h]].tolist()}
            yield pd.DataFrame([(batch["doc_id"].iloc[d], texts[d], i) for d, i in sorted(pairs)], columns=_MATCHED.names)

    return run


def _tiled(least: int) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, last, known = [], None, {}
            for doc_id, text, item_id, passage in zip(batch["doc_id"], batch["text"], batch["item_id"], batch["passage"]):
                if last is None or last[0] != text:
                    ws = words(text)
                    last = (text, ws, word_codes([" ".join(ws)])[0])
                if passage not in known:
                    ws = words(passage)
                    known[passage] = (ws, word_codes([" ".join(ws)])[0])
                item, item_codes = known[passage]
                tiles = tile(last[1], item, seeds_of(last[2], item_codes, least), least)
                if tiles:
                    rows.append((doc_id, item_id, len(tiles), tiles[0][2], sum(t[2] for t in tiles), len(item)))
            yield pd.DataFrame(rows, columns=_LEAKS.names)

    return run


def leaks(docs: DataFrame, evals: DataFrame, least: int = LEAST, block_words: int = BLOCK_WORDS, min_coverage: float = 0.0) -> DataFrame:
    """(doc_id, item_id, n_tiles, longest, matched_words, item_words, coverage) of every document that holds `least`
    consecutive words of an item, where the tiles cover at least the share `min_coverage` of the item's words.

    docs: doc_id, text; evals: item_id, text; other columns are ignored. Null and empty texts and null ids give no
    rows; items shorter than `least` words cannot leak; repeated documents or items are reported under each of their
    ids, repeated rows once; empty tables give an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & (F.col("text") != ""))
    evals = evals.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("passage")).where(F.col("item_id").isNotNull() & (F.col("passage") != "")).distinct()
    index = cut(evals.mapInPandas(_seeds(lambda c: fingerprints(c, least)), _SEEDS))
    if index.limit(block_words + 1).count() <= block_words:
        known = index.orderBy("seed").toPandas()  # at most block_words rows of two numbers
        shared = spark.sparkContext.broadcast((known["seed"].to_numpy(np.int64), known["id"].to_numpy(np.int64)))
        found = docs.mapInPandas(_matched(shared, least), _MATCHED)
    else:
        pick = _seeds(lambda c: selected(c, least))
        ours, theirs = docs.mapInPandas(pick, _SEEDS).toDF("doc_id", "seed"), evals.mapInPandas(pick, _SEEDS).toDF("item_id", "seed")
        pairs = cut(ours.join(theirs, "seed").select("doc_id", "item_id").distinct())
        found = docs.join(small_side(pairs, MAX_BROADCAST_PAIRS), "doc_id")
    small = (evals.agg(F.sum(F.octet_length("passage"))).first()[0] or 0) <= MAX_BROADCAST_TEXT
    tiled = found.join(F.broadcast(evals) if small else evals, "item_id").mapInPandas(_tiled(least), _LEAKS)
    best = tiled.groupBy("doc_id", "item_id").agg(F.max(F.struct("matched_words", "longest", "n_tiles", "item_words")).alias("b")).select("doc_id", "item_id", "b.*")
    return best.withColumn("coverage", F.col("matched_words") / F.col("item_words")).where(F.col("coverage") >= min_coverage)
