"""One consistent form for text that looks the same but differs in its characters.

`skeleton` decides what looks the same: decompose canonically, replace every character by its prototype, decompose
again. A prototype is nothing for an invisible character, a plain space for any other white space, the compatibility
form for a change of width or font only (rule over the Unicode decomposition tags), and one form of all look-alikes.
Look-alikes come from Unicode's own table of confusables, as it is shipped with Spark (in its ICU library): characters with
the same Unicode prototype become one, the ASCII twin of their own case where there is one, else an ordinary letter or
sign, else one of themselves; a prototype of several characters is taken part by part. Superscripts and ordinals, digits,
symbols and emoji, typographic quotes, letter case and the accents of Latin letters are kept: a reader sees them, and so
are ASCII look-alikes (0 and O, 1 and l), because a typo is to show. Runs of white space count as one space, outer ones as
none.

`clean` is the form texts are brought to: the skeleton composed again, but line breaks and the invisible joiners and
selectors inside emoji are kept, and so are words of other alphabets. A look-alike letter becomes Latin in a word that has
Latin letters too, and in a word of look-alikes alone if the text has no other letter of such an alphabet. Both leave a
text of plain Latin letters as it is, which a JVM regular expression detects, so such rows never pay for Python. Null
stays null, an empty or invisible text becomes empty.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata
import zipfile
from collections.abc import Callable
from functools import lru_cache
from pathlib import Path

import pandas as pd
import pyspark
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Invisible characters besides those of category Cf.
INVISIBLE = "͏ᅟᅠ឴឵ㅤﾠ"
SAME_GLYPH_TAGS = ("<wide>", "<narrow>", "<font>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>")
#: Found in a text that may differ from its canonical form: a character outside those known to be their own, or two spaces.
NOT_PLAIN = "[^\x20-\x7e\u00a1-\u00ac\u00ae-\u00b4\u00b6-\u0130\u0134-\u013e\u0141-\u0148\u014a-\u017e\u2013\u2014\u2018\u2019\u201c\u201d\u2022\u2026\u20ac\u2600-\u27bf\U0001f300-\U0001faff]|  "


_NOT_PLAIN = re.compile(NOT_PLAIN)


@lru_cache
def confusables() -> dict[str, str]:
    """Unicode's confusables (UTS 39), each character's prototype, from the ICU data file of the Spark distribution.

    The file: a header of its own length, then big-endian offsets and sizes of keys (code point in 24 bits, length of the
    prototype less one in 8), of values (the prototype, or its place in the strings if longer) and of UTF-16 strings.
    """
    homes = [Path(pyspark.__file__).parent, *([Path(os.environ["SPARK_HOME"])] if "SPARK_HOME" in os.environ else [])]
    jar = next((j for h in homes for j in sorted(h.glob("jars/icu4j-*.jar"))), None)
    if jar is None:
        raise FileNotFoundError(f"no ICU library in {[str(h / 'jars') for h in homes]}")
    with zipfile.ZipFile(jar) as z:
        raw = z.read("com/ibm/icu/impl/data/icudata/confusables.cfu")
    data = raw[struct.unpack(">H", raw[:2])[0] :]
    key_at, n_keys, value_at, n_values, text_at, n_text = struct.unpack(">6i", data[12:36])
    keys, values = struct.unpack(f">{n_keys}I", data[key_at : key_at + 4 * n_keys]), struct.unpack(f">{n_values}H", data[value_at : value_at + 2 * n_values])
    text = data[text_at : text_at + 2 * n_text]
    return {chr(k & 0xFFFFFF): chr(v) if k >> 24 == 0 else text[2 * v : 2 * (v + (k >> 24) + 1)].decode("utf-16-be") for k, v in zip(keys, values)}


@lru_cache
def twins() -> dict[str, str]:
    """The ASCII twin of every letter or mark that has one and is no ordinary writing of its own. Digits of other scripts
    stay: many look like another digit than they are."""
    shape = confusables()
    ascii_of: dict[str, list[str]] = {}
    for a in map(chr, range(0x21, 0x7F)):
        ascii_of.setdefault(shape.get(a, a), []).append(a)
    out = {}
    for c, s in shape.items():
        kind = unicodedata.category(c)
        letter = kind[0] == "L"
        if s not in ascii_of or not _NOT_PLAIN.match(c) or not letter and kind[0] != "P" and kind != "Sm" or kind in ("Pi", "Pf") or "QUOTATION" in unicodedata.name(c, "") or own_form(c).isascii():
            continue
        wanted = str.isupper if kind in ("Lu", "Lt") else str.islower if letter else str.isprintable
        twin = min(ascii_of[s], key=lambda a: (not wanted(a), not a.isalpha(), a))
        if twin not in "'\"`" and (letter or not twin.isalnum()):
            out[c] = twin
    return out


@lru_cache(maxsize=70_000)
def prototype(c: str) -> str:
    """What one decomposed character is replaced by."""
    if (twin := twins().get(c)) is not None:
        return twin
    if (own := own_form(c)) != c:
        return "".join(map(prototype, unicodedata.normalize("NFD", own)))
    return shared_form(c)


def _sort(c: str) -> str:
    """What may stand for what: letters, marks or signs; '' for what stays as it is."""
    kind = unicodedata.category(c)
    if kind[0] in "LM":
        return kind[0]
    return "S" if kind == "Sm" or kind[0] == "P" and kind not in ("Pi", "Pf") and "QUOTATION" not in unicodedata.name(c, "") else ""


@lru_cache
def ordinary() -> frozenset[str]:
    """Decomposed characters of ordinary writing, which are their own."""
    return frozenset("".join(unicodedata.normalize("NFD", c) for c in map(chr, range(0x21, 0x3000)) if not _NOT_PLAIN.match(c)))


@lru_cache
def alike() -> dict[tuple[str, str], list[str]]:
    """The characters of each Unicode prototype and sort that may stand for it, decomposed and in their own form."""
    out: dict[tuple[str, str], list[str]] = {}
    shape = confusables()
    for c in {*shape, *shape.values(), *ordinary()}:
        if len(c) == 1 and (sort := _sort(c)) and unicodedata.normalize("NFD", c) == c and own_form(c) == c and c not in twins():
            out.setdefault((shape.get(c, c), sort), []).append(c)
    return out


@lru_cache(maxsize=70_000)
def shared_form(c: str) -> str:
    """The one form of the characters that look like this one, which has no ASCII twin."""
    shape, sort = confusables().get(c, c), _sort(c)
    if not sort or c in ordinary() or set(shape) <= set("'\"`"):
        return c
    if sort == "M" and not "\u0300" <= c <= "\u036f" and (len(shape) > 1 or unicodedata.combining(shape) != unicodedata.combining(c)):
        return c  # a mark that would change places with others
    case = str.isupper if c.isupper() else str.islower if c.islower() else str.isprintable
    same = min(alike().get((shape, sort), [c]), key=lambda a: (a not in ordinary(), not case(a), a != shape, not _latin(a), a))
    pair = c.swapcase()
    if same == pair or len(shape) > 1 and confusables().get(pair) == shape and not any(map(case, shape)):
        return c  # letter case shows
    if len(shape) == 1 or same in ordinary() or sort != "L" and any(map(str.isalnum, shape)):
        return same
    return "".join(x if x.isascii() else prototype(x) for x in unicodedata.normalize("NFD", shape.replace("rn", "m")))


@lru_cache(maxsize=70_000)
def own_form(c: str) -> str:
    """The prototype of a character that keeps its alphabet."""
    kind = unicodedata.category(c)
    if kind == "Cf" or c in INVISIBLE or 0xFE00 <= ord(c) <= 0xFE0F or 0xE0100 <= ord(c) <= 0xE01EF:
        return ""
    if kind[0] == "Z" or c in "\t\n\r\x0b\x0c\x85":
        return " "
    if kind == "Cc":
        return ""
    tag, _, rest = unicodedata.decomposition(c).partition(" ")
    if tag in SAME_GLYPH_TAGS or tag == "<compat>" and kind in ("Ll", "Lu", "Lt", "Nl"):
        return "".join(own_form(chr(int(x, 16))) for x in rest.split())
    return c


class _Table(dict):
    """A mapping of code points for str.translate, filled as they are met."""

    def __init__(self, of: Callable[[str], str]) -> None:
        self.of = of

    def __missing__(self, code: int) -> str:
        self[code] = out = self.of(chr(code))
        return out


_PROTOTYPE = _Table(prototype)
_OWN = _Table(lambda c: own if len(own := own_form(c)) != 1 or prototype(own) == prototype(c) else c)
_MARK = _Table(lambda c: prototype(c) if _sort(c) == "S" else c)


def skeleton(text: str) -> str:
    """Equal for two texts exactly if they look the same."""
    own = unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).translate(_OWN))
    return " ".join(unicodedata.normalize("NFD", own.translate(_PROTOTYPE)).split())


_JOINED = re.compile("(?<=[\u2600-\u27bf\u2b00-\u2bff\U0001f000-\U0001faff])[\u200d\ufe0f]+")


#: Latin-1 bytes that are their own canonical form, and the line break.
_OWN_BYTES = bytes([10, *range(0x20, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0xB5), *range(0xB6, 0x100)])


def _plain_latin(text: str) -> str | None:
    """The canonical form of a text of plain Latin-1 letters, without looking at single characters; else None."""
    if "  " in text:
        return None
    try:
        odd = text.encode("latin-1").translate(None, _OWN_BYTES)
    except UnicodeEncodeError:
        return text.strip(" ") if not _NOT_PLAIN.search(text) else None
    if odd:
        return None
    return text.strip(" ") if "\n" not in text else "\n".join(x.strip(" ") for x in text.split("\n"))


def clean(text: str) -> str:
    """The one form that a text is brought to; line breaks and the inside of emoji are kept."""
    if (known := _plain_latin(text)) is not None:
        return known
    kept = own_words(text)
    lines = []
    for line in re.split("\r\n|[\n\r  \x85\x0b\x0c]", text):
        out, i = [], 0
        for m in _JOINED.finditer(line):
            out += [skeleton_keep(line[i : m.start()], kept), m.group()]
            i = m.end()
        out.append(skeleton_keep(line[i:], kept))
        lines.append(" ".join("".join(out).split(" ")).strip(" "))
    return unicodedata.normalize("NFC", re.sub("  +", " ", "\n".join(lines)))


_WORD = re.compile(r"(?:[^\W\d_][\u0300-\u036f]*)+")


@lru_cache(maxsize=70_000)
def _latin(c: str) -> bool:
    return unicodedata.normalize("NFKD", c)[0].isascii() or unicodedata.name(c, "").startswith("LATIN")


@lru_cache(maxsize=70_000)
def foreign(c: str) -> bool:
    """A letter or digit of another alphabet that looks like no Latin letter, with or without accents."""
    return c.isalnum() and not _latin(c) and c not in twins() and not ((p := prototype(c))[:1].isascii() and all(map(unicodedata.combining, p[1:])))


def own_words(text: str) -> bool:
    """Whether words of other alphabets stay: some letter of the text is of one and looks like no Latin letter."""
    if not any(map(_may_be_foreign, (c for c in set(unicodedata.normalize("NFD", text)) if not c.isascii()))):
        return False
    return any(map(foreign, (c for c in set(_latin_words(text)) if not c.isascii())))


@lru_cache(maxsize=70_000)
def _may_be_foreign(c: str) -> bool:
    return any(map(foreign, c + own_form(c) + prototype(c)))


def _latin_words(text: str) -> str:
    """The decomposed text, with the words that have a Latin letter in Latin as far as they look so."""
    text = unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).translate(_OWN)).translate(_MARK)
    return _WORD.sub(lambda m: m.group().translate(_PROTOTYPE) if any(map(_latin, m.group())) else m.group(), text)


def skeleton_keep(text: str, own: bool) -> str:
    """The skeleton of a piece of a text, white space and (if own) words without any Latin letter as they are."""
    twin = _latin_words(text) if own else unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).translate(_OWN)).translate(_PROTOTYPE)
    return unicodedata.normalize("NFD", twin)


def _udf(f):
    @F.pandas_udf(T.StringType())
    def each(texts: pd.Series) -> pd.Series:
        return texts.map(f, na_action="ignore")

    return each


_clean_udf = _udf(clean)
_skeleton_udf = _udf(skeleton)


def clean_text(text: Column) -> Column:
    """`clean` as a column; plain texts stay in the JVM."""
    plain = ~text.rlike(NOT_PLAIN)
    return F.when(plain, F.trim(text)).otherwise(_clean_udf(F.when(~plain, text)))


def skeleton_text(text: Column) -> Column:
    """A column equal for texts that look the same: the skeleton composed again (as plain texts are)."""
    plain = ~text.rlike(NOT_PLAIN)
    return F.when(plain, F.trim(text)).otherwise(_composed_udf(F.when(~plain, text)))


_composed_udf = _udf(lambda t: unicodedata.normalize("NFC", skeleton(t)))


def with_clean(df: DataFrame, column: str, to: str = "clean") -> DataFrame:
    return df.withColumn(to, clean_text(F.col(column)))


def groups_of_equal_look(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(look, n_rows, n_forms): per appearance with at least two different spellings, its rows and its spellings.

    Grouped by a 128-bit digest of the skeleton, with map-side counts per (digest, digest of the spelling), also of 128
    bits, so a text that a third of all rows share leaves each map task as one row.
    """
    look = df.where(F.col(text_col).isNotNull()).select(F.unhex(F.md5(skeleton_text(F.col(text_col)))).alias("look"), F.unhex(F.md5(text_col)).alias("form"))
    forms = look.groupBy("look", "form").agg(F.count(F.lit(1)).alias("n"))
    groups = forms.groupBy("look").agg(F.sum("n").alias("n_rows"), F.count("form").alias("n_forms")).where("n_forms > 1")
    return groups.select(F.lower(F.hex("look")).alias("look"), "n_rows", "n_forms")


def same_look(left: DataFrame, right: DataFrame, key: str, left_text: str, right_text: str) -> DataFrame:
    """Keys for which some left and some right text are different strings of one appearance.

    Only digests are shuffled: both sides are reduced to distinct (key, digest of the skeleton, digest of the string),
    which is what is grouped by equal skeleton. Null and invisible texts and null keys give no case.
    """

    def side(df: DataFrame, text: str) -> DataFrame:
        shown = skeleton_text(F.col(text))
        s = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, shown.alias("_s"), F.unhex(F.md5(text)).alias("form"))
        return s.where(F.col("_s") != "").select(key, F.unhex(F.md5("_s")).alias("look"), "form").distinct()

    a, b = side(left, left_text), side(right, right_text).withColumnRenamed("form", "other")
    return a.join(b, [key, "look"]).where(F.col("form") != F.col("other")).select(key).distinct()
