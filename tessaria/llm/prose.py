"""Per-document text statistics, and fixed-threshold rules that tell prose from lists, tables and junk.

Statistics are vectorised: whole Arrow columns of texts are cut into lines, tokens and words at once, counted by compiled
regular expressions and summed per document; a word is judged once per batch, however often it occurs. It is one narrow
scan without any exchange. Rules compare the figures with thresholds that are constants of this module, and every rule
that a document fails is recorded by name. `published` are the thresholds of published web corpus filters (MassiveText's
quality rules, C4's line rule); they are recorded, but alone they do not tell a short note from junk, so `kinds`, whose
thresholds set lists, tables and junk apart, decide the kind: that of the first one that fails.

Null text has zero statistics and fails no rule, as does text without any sign. Length, case, language and line layout
alone decide no kind.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessaria.llm.layout import TABLE, Runs, laid_out

#: Common words of the languages at hand.
COMMON = frozenset(
    """
    a à ao aos as às com como da das de dela dele depois do dos e é ela ele em entre era essa esse esta está este eu foi foram há isso já mais mas me mesmo meu minha muito na nas nem no nos não nós o os ou para pela pelo
    por porque quando que quem se sem ser seu só sua também tem uma um você
    al algo ante con cuando del desde donde el ella ellos en es esta este fue ha hay hasta la las le lo los más mi muy ni o para pero por que qué se ser si sin sobre su sus también todo un una unos y ya
    about after all an and any are as at be because been before but by can for from had has have he her his i if in into is it its my no not of on one only or our she so than that the their there they this to up was we were what
    when which who will with would you
    """.split()
)
#: What ends a sentence, vowels, and signs that a line of a list starts with.
TERMINAL, VOWELS = ".!?…:;\"”’»)", "aeiouyà-æè-ïò-öù-ýāēīōū"
SPACE = r"\s\x0b\x1c-\x1f\x{85}\p{Z}"
BULLET = rf"^(?:[-*•·–—+>▪◦‣]|\[[ xX]?\]|\(?[0-9]{{1,3}}[.)]|\(?[a-zA-Z]{{1,2}}\))[{SPACE}]+"
SIGN = r"\p{L}\p{N}"
SYMBOL = rf"[^{SIGN}{SPACE}.,;:!?'\"()\-–—“”‘’%/$ªº]"
SAID = rf"[^{SPACE}]*[{SIGN}][^{SPACE}]*"
ELLIPSIS = r"(?:\.\.\.|…)$"
SHORT_LINE, RUN, SLICE_BYTES = 7, 6, 4 << 20

COUNTS = ("n_chars", "n_words", "n_lines", "n_common")
FIGURES = (
    "mean_word_length", "symbol_ratio", "letter_share", "terminal_line_share", "bullet_line_share", "short_line_word_share", "words_per_line",
    "common_word_share", "repeated_line_share", "distinct_word_share", "top_bigram_share", "repeated_run_share", "vowel_word_share",
    "symbol_word_share", "field_line_share", "fields_per_line", "words_per_field", "ellipsis_line_share", "alphabetic_word_share", "hash_ratio",
)
STATS = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS] + [T.StructField(c, T.DoubleType()) for c in FIGURES])
_ARROW = pa.struct([pa.field(c, pa.int64()) for c in COUNTS] + [pa.field(c, pa.float64()) for c in FIGURES])


def _count(texts: pa.Array, pattern: str) -> np.ndarray:
    return pc.count_substring_regex(texts, pattern).to_numpy(zero_copy_only=False).astype(np.int64)


def _true(flags: pa.Array) -> np.ndarray:
    return flags.to_numpy(zero_copy_only=False).astype(bool)


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.divide(part, whole, out=np.zeros(len(whole)), where=whole > 0)


LETTER_, SIGN_, SPACE_, ALPHA_, VOWEL_ = 1, 2, 4, 8, 16


@lru_cache
def _table() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point its classes and its small letter; from TABLE on all count as letters."""
    flags, low = np.zeros(TABLE + 1, np.uint8), np.arange(TABLE + 1, dtype=np.uint32)
    vowels = re.compile(f"[{VOWELS}]")
    for i in range(TABLE):
        c = chr(i)
        kind, small = unicodedata.category(c), c.lower()
        if len(small) == 1 and ord(small) < TABLE:
            low[i] = ord(small)
        alpha, space = kind[0] == "L", kind[0] == "Z" or c in "\t\n\r\f\x0b\x1c\x1d\x1e\x1f\x85"
        flags[i] = LETTER_ * (alpha or kind in ("Nl", "No")) + SIGN_ * (alpha or kind[0] == "N") + SPACE_ * space + ALPHA_ * alpha + VOWEL_ * bool(vowels.match(small))
    flags[TABLE] = LETTER_ + SIGN_ + ALPHA_
    return flags, low


def _repeats(owner: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes (of 48 bits) of each owner, and how often its commonest one occurs; fewer than 65536 owners."""
    keys = np.sort(owner.astype(np.uint64) << np.uint64(48) | hashes >> np.uint64(16))
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, int)
    who, times = (keys[first] >> np.uint64(48)).astype(int), np.diff(np.append(first, len(keys)))
    most = np.zeros(n, np.int64)
    np.maximum.at(most, who, times)
    return np.bincount(who, None, n), most


@lru_cache
def _common() -> np.ndarray:
    text = " ".join(sorted(COMMON))
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.unique(Runs(codes != 32, np.array([0, len(codes)])).hashes(codes))


class _Groups:
    """Sums over the parts (lines, words) of each of `n` documents."""

    def __init__(self, owner: np.ndarray, n: int) -> None:
        self.owner, self.n = owner, n

    def sum(self, x: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(self.owner, None if x is None else x.astype(float), self.n)

    def most(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The commonest code of each document (of equals the first) and how often it occurs; -1 and 0 without any."""
        code, times = np.full(self.n, -1), np.zeros(self.n, np.int64)
        if not len(codes):
            return code, times
        order = np.lexsort((codes, self.owner))  # stable: the first of equals comes first
        o, c = self.owner[order], codes[order]
        start = np.flatnonzero(np.append(True, (o[1:] != o[:-1]) | (c[1:] != c[:-1])))
        k = np.diff(np.append(start, len(o)))
        best = np.lexsort((order[start], -k, o[start]))
        docs, at = np.unique(o[start][best], return_index=True)
        code[docs], times[docs] = c[start][best][at], k[best][at]
        return code, times


def _fields(lines: pa.Array, of: _Groups) -> list[np.ndarray]:
    """Share of lines that one separator cuts into the same number of fields, that number, and words per field."""
    lines = pc.if_else(pc.match_substring(lines, "\t"), lines, pc.utf8_trim(lines, " ;,|\r"))
    comma = _count(lines, ",") - _count(lines, rf",[{SPACE}]") - _true(pc.match_substring_regex(lines, ",$")) + pc.count_substring(lines, " , ").to_numpy(zero_copy_only=False)
    n_lines = of.sum()
    best = np.zeros((3, of.n))
    for sign, cuts in (("\t", None), (";", None), ("|", None), (",", comma), ("  ", _count(lines, " {2,}"))):
        cuts = pc.count_substring(lines, sign).to_numpy(zero_copy_only=False).astype(np.int64) if cuts is None else cuts
        some = cuts > 0
        k, times = _Groups(of.owner[some], of.n).most(cuts[some])
        mine = k[of.owner]
        # lines that lack some fields, or hold more, still are rows of the same table
        near = (times[of.owner] > 0) & ((cuts == mine) | (mine > 1) & ((mine + 1) // 2 <= cuts) & (cuts <= mine + 2))
        words = np.zeros(len(cuts))
        words[near] = _count(pc.replace_substring(lines.filter(pa.array(near)), sign, " "), SAID)
        rows = of.sum(near)
        one = np.array([_share(rows, n_lines), np.where(times > 0, k + 1.0, 0.0), _share(of.sum(words), (k + 1) * rows)])
        better = (times > 0) & ((one[0] > best[0]) | (one[0] == best[0]) & ((one[1] > best[1]) | (one[1] == best[1]) & (one[2] > best[2])))
        best[:, better] = one[:, better]
    return list(best)


def _statistics(texts: pa.Array) -> pa.StructArray:
    n = len(texts)
    flags, small = _table()
    chars = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
    codes, bounds = laid_out(texts.to_pylist())
    kinds_ = flags[codes]
    token = Runs(kinds_ & SPACE_ == 0, bounds)
    told = token.any(kinds_)
    of_token = _Groups(np.repeat(np.arange(n), token.count), n)
    tokens, shown_chars = token.count, of_token.sum(token.length)
    split = pc.split_pattern(texts, "\n")
    lines, owner = pc.utf8_trim_whitespace(pc.list_flatten(split)), pc.list_parent_indices(split).to_numpy()
    shown = pc.utf8_length(lines).to_numpy(zero_copy_only=False) > 0
    lines, of = lines.filter(pa.array(shown)), _Groups(owner[shown], n)
    n_lines = of.sum()
    bare = pc.replace_substring_regex(lines, BULLET, "")
    line_codes, line_bounds = laid_out(bare.to_pylist())
    sizes = Runs(flags[line_codes] & SPACE_ == 0, line_bounds).count
    word = Runs(kinds_ & LETTER_ != 0, bounds)
    h, said = word.hashes(small[codes]), word.any(kinds_)
    spoken = _Groups(np.repeat(np.arange(n), word.count), n)
    n_words, letters, common = word.count, spoken.sum(word.length), spoken.sum(_common()[np.minimum(np.searchsorted(_common(), h), len(_common()) - 1)] == h)
    n_distinct, _ = _repeats(spoken.owner, h, n)
    beside = spoken.owner[1:] == spoken.owner[:-1]
    _, most_pairs = _repeats(spoken.owner[1:][beside], (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])[beside], n)
    runs = np.zeros(max(0, len(h) - RUN + 1), np.uint64)
    for j in range(RUN if len(runs) else 0):
        runs = runs * np.uint64(0x94D049BB133111EB) + h[j : j + len(runs)]
    whole = spoken.owner[: len(runs)] == spoken.owner[RUN - 1 :] if len(runs) else np.zeros(0, bool)
    n_runs = np.bincount(spoken.owner[: len(runs)][whole], None, n)
    distinct_runs, _ = _repeats(spoken.owner[: len(runs)][whole], runs[whole], n)
    line_numbers = lines.dictionary_encode().indices.to_numpy().astype(np.uint64) << np.uint64(16)
    distinct_lines, _ = _repeats(of.owner, line_numbers, n)
    has_lines = n_lines > 0
    zero = np.zeros(n)
    columns = [
        chars, n_words * has_lines, n_lines, common * has_lines,
        _share(letters, n_words),
        _share(_count(texts, SYMBOL), tokens),
        _share(letters, shown_chars),
        _share(of.sum(_true(pc.match_substring_regex(lines, f"[{TERMINAL}]$"))), n_lines),
        _share(of.sum(_true(pc.not_equal(bare, lines))), n_lines),
        _share(of.sum(np.where(sizes <= SHORT_LINE, sizes, 0)), of.sum(sizes)),
        _share(of.sum(sizes), n_lines),
        _share(common, n_words),
        np.where(has_lines, 1 - _share(distinct_lines, n_lines), zero),
        _share(n_distinct, n_words),
        np.where(n_words > 1, _share(most_pairs, n_words - 1), zero),
        np.where(n_words > RUN, 1 - _share(distinct_runs, n_runs), zero),
        _share(spoken.sum(said & VOWEL_ != 0), n_words),
        _share(of_token.sum(told & SIGN_ == 0), tokens),
        *_fields(bare, of),
        _share(of.sum(_true(pc.match_substring_regex(lines, ELLIPSIS))), n_lines),
        _share(of_token.sum(told & ALPHA_ != 0), tokens),
        _share(_count(texts, r"#|…|\.\.\."), n_words),
    ]
    return pa.StructArray.from_arrays([pa.array(np.asarray(x, np.int64 if i < len(COUNTS) else np.float64)) for i, x in enumerate(columns)], fields=list(_ARROW))


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Neighbouring texts of some SLICE_BYTES together, each counted as 256 bytes at least; a longer one is a slice of its own."""
    at = np.cumsum(np.maximum(pc.binary_length(texts).to_numpy(zero_copy_only=False), 256)) // SLICE_BYTES
    ends = [*np.flatnonzero(np.diff(at)) + 1, len(texts)]
    start = 0
    for e in ends:
        yield texts.slice(start, e - start)
        start = e


def statistics_batch(texts: pa.Array) -> pa.Array:
    texts = pc.fill_null(texts, "")
    parts = [_statistics(s) for s in _slices(texts)] if len(texts) else []
    return pa.concat_arrays(parts) if parts else pa.array([], _ARROW)


statistics_of = F.arrow_udf(statistics_batch, STATS)


def statistics(text: str | None) -> tuple:
    """The statistics of one text."""
    return tuple(statistics_batch(pa.array([text], pa.string()))[0].as_py().values())


def published() -> list[tuple[str, Column]]:
    """(rule, what fails it) of published filters."""
    c = F.col
    some = c("n_words") > 0
    return [
        ("words_50_to_100000", some & ~c("n_words").between(50, 100_000)),
        ("mean_word_length_3_to_10", some & ~c("mean_word_length").between(3, 10)),
        ("hashes_and_ellipses_0.1", c("hash_ratio") > 0.1),
        ("bullet_lines_0.9", c("bullet_line_share") > 0.9),
        ("ellipsis_lines_0.3", c("ellipsis_line_share") > 0.3),
        ("alphabetic_words_0.8", (c("n_lines") > 0) & (c("alphabetic_word_share") < 0.8)),
        ("two_common_words", some & (c("n_common") < 2)),
        ("repeated_lines_0.3", c("repeated_line_share") > 0.3),
        ("line_ends_0.1", (c("n_lines") > 0) & (c("terminal_line_share") < 0.1)),
        ("distinct_words_0.1", some & (c("distinct_word_share") < 0.1)),
    ]


def kinds() -> list[tuple[str, str, Column]]:
    """(kind, rule, what fails it), in the order in which a kind is decided."""
    c = F.col
    many = c("n_words") >= 12
    return [
        ("table", "field_lines", (c("n_lines") >= 2) & (c("field_line_share") >= 0.6) & (c("fields_per_line") >= 3) & (c("words_per_field") <= 4)),
        ("table", "field_pairs", (c("n_lines") >= 3) & (c("field_line_share") >= 0.8) & (c("fields_per_line") == 2) & (c("words_per_field") <= 3) & (c("common_word_share") < 0.3)),
        ("junk", "repeated_lines", (c("n_lines") >= 4) & (c("repeated_line_share") > 0.5)),
        ("junk", "repeated_pair", many & (c("top_bigram_share") > 0.2)),
        ("junk", "repeated_runs", many & (c("repeated_run_share") > 0.8)),
        ("list", "short_lines", (c("n_lines") >= 3) & (c("short_line_word_share") >= 0.7) & (c("words_per_line") <= 5)),
        ("list", "bullet_lines", (c("n_lines") >= 3) & (c("bullet_line_share") >= 0.9) & (c("words_per_line") <= 8)),
        ("junk", "few_letters", (c("n_chars") > 20) & (c("letter_share") < 0.5)),
        ("junk", "symbols", (c("n_chars") > 20) & (c("symbol_ratio") > 0.5)),
        ("junk", "symbol_words", many & (c("symbol_word_share") >= 0.25)),
        ("junk", "word_length", many & ((c("mean_word_length") > 10) | (c("mean_word_length") < 2.5))),
        ("junk", "no_vowels", (c("n_words") >= 5) & (c("vowel_word_share") < 0.6)),
        ("junk", "no_common_words", many & (c("common_word_share") < 0.08)),
    ]


def judged(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the statistics, `reasons` (names of the failed rules that decide a kind, in order), `kind` (of the first;
    else prose) and `published` (names of the failed published rules)."""
    out = docs.withColumn("_s", statistics_of(F.col(text))).select(*[x for x in docs.columns if x not in STATS.names], "_s.*")
    decide = kinds()
    failed = lambda rules: F.array_compact(F.array(*[F.when(bad, F.lit(rule)) for rule, bad in rules]))
    kind = F.coalesce(*[F.when(bad, F.lit(k)) for k, _, bad in decide], F.lit("prose"))
    return out.withColumns({"reasons": failed([(rule, bad) for _, rule, bad in decide]), "kind": kind, "published": failed(published())})
