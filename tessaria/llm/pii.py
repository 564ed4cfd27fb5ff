"""Personal information in free text, found by what terms reveal and replaced by typed placeholders.

Information-theoretic sanitisation in two passes over all texts.

Pass 1 counts co-occurrence. The protected entities are known at first by a few words that announce one (PRIOR), by forms
that are written for one kind only (PRIOR_SHAPES), by the owners of email addresses and by people who introduce
themselves. For every term the corpus tells how strongly it reveals an entity: for the shape of a number, the share of
its numbers that an announcing word names; for a word in front of a number, the share of numbers behind it whose shape
reveals a kind; for a word of running text, how much more often than by chance it is a part of an owner's name or stands
next to such a part. A term whose disclosure exceeds the thresholds is protected. An address of a mailbox and a street
with its number are entities by definition, whatever stands around them.

Pass 2 generalises every protected item to its type: numbers of a revealing shape or behind a revealing word, and runs of
revealing words that form a given name with a surname. A number behind a word that is known to announce something else
(an order, an invoice, a product) is kept whatever its form, as are given names alone and names of shops.

Texts are read in their canonical form (look-alike letters, odd spaces, invisible characters), and placeholders are
put at the matching place of the text as it was written: the rest of it does not change.

Scale: both passes are narrow scans in Arrow batches. Counts are combined inside each batch and again before the
exchange, so only the vocabulary is shuffled. The protected terms are broadcast below a checked number of terms; beyond
it each text is joined with the protected ones of its own terms, under a record key.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessaria.llm.canonical import NOT_PLAIN, prototype
from tessaria.plans.materialize import cut

KINDS = ("email", "phone", "id_number", "address", "name")
PLACEHOLDER = {k: f"[{k.upper()}]" for k in KINDS}
MAX_BROADCAST_TERMS = 500_000
#: How far in front of a number a word announces it, and how many words a name has at most.
NEAR_CHARS, NEAR_WORDS, NAME_WORDS = 40, 2, 8
#: Thresholds. Bits above chance and share of a word's uses, for names; share of numbers of a revealing
#: shape behind a word, the support and share under which a word is known to announce something else, and the share of
#: announced numbers of a shape.
NAME_BITS, NAME_SHARE, NAME_SUPPORT = 4.0, 0.02, 2
CUE_SHARE, CUE_SUPPORT, OTHER_SUPPORT, OTHER_SHARE, SHAPE_SHARE = 0.15, 3, 12, 0.04, 0.5
#: Words that announce a number, each counted as CUE_SUPPORT certain observations before the corpus is read.
PRIOR = {
    "phone": ("tel", "telefone", "fone", "cel", "celular", "zap", "whats", "whatsapp", "liguem", "ligue", "phone", "mobile", "móvil"),
    "id_number": ("cpf", "c.p.f", "rg", "r.g", "identidade", "documento", "dni", "ssn"),
}
#: Shapes of numbers (see shape_of) that are written for one kind, counted alike, and how people introduce themselves.
PRIOR_SHAPES = {"phone": ("+12", "+13", "(10", "(11", "(12"), "id_number": ("999.999.999-99", "999.999.999/99", "99.999.999-9", "99.999.999-x")}
INTRODUCED = re.compile(r"(?:meu nome e|me chamo|chamo-me|mi nombre es|me llamo|my name is)\s+(?=[a-z])")
SHORT_CUES = frozenset(w for ws in PRIOR.values() for w in ws if len(w) < 3)
#: Kinds of streets, titles inside street names, what follows a count, name particles, kinds of shops.
STREET = r"rua|r\.|avenida|av\.?|travessa|trav\.|tv\.|alameda|al\.|rodovia|rod\.|estrada|estr\.|praca|pca\.|largo|viela|beco|ladeira|calle|street"
TITLE = r"prof|profa|dr|dra|cel|gal|gen|cap|ten|sgt|sta|sto|s|pe|fr|eng|des|ver|dep|sen|pres|mons|d|mal|alm|com|exp"
COUNTED = r"dias?|vezes|unidades?|pecas?|anos?|meses|mes|semanas?|horas?|h|min|minutos?|reais|km|x|%|days?|veces"
PARTICLES = frozenset(("de", "da", "do", "dos", "das", "e", "di", "del", "la", "van", "von"))
SHOPS = frozenset(("loja", "lojas", "casa", "vendedor", "bazar", "atelier", "emporio", "transportadora", "marca", "mercado", "armazem", "livraria", "padaria", "shop", "store", "tienda"))

EMAIL = re.compile(
    r"(?<![\w.+-])([a-z0-9][a-z0-9._+-]*)\s?(?:@|[(\[{<]\s?(?:arroba|at)\s?[)\]}>]|\barroba\b)\s?[a-z0-9][a-z0-9-]*(?:(?:\.|\s?[(\[]\s?(?:ponto|dot)\s?[)\]]\s?|\sponto\s)[a-z0-9][a-z0-9-]*)+"
)
ADDRESS = re.compile(
    rf"(?<![\w.])(?:{STREET})\s+(?:(?:(?:{TITLE})\.\s*|[a-z][a-z'-]*\s+|\d{{1,2}} de ){{0,5}}[a-z][a-z'-]*)(?:\s*,\s*(?:n\w?[.º°]?\s*)?|\s+(?:n[ºo°]?\.?|numero|num\.?)\s*|\s*,?\s*km\s*|\s+(?=\d{{2}}))"
    rf"(?:km\s*)?\d{{1,6}}(?![\d/.,-]?\d)(?!\s*(?:{COUNTED})\b)(?:\s*,?\s*(?:apto?|apartamento|casa|bloco|sala|sitio|lote|km)\.?\s*\d+)*(?:\s*,?\s*cep:?\s*\d{{5}}-?\d{{3}})?"
    r"|(?<![\w.])(?:quadra|qd\.?)\s*\d+\w?\s*,?\s*(?:lote|lt\.?)\s*\d+"
)
#: Forms that numbers of interest are written in.
NUMBER = re.compile(
    r"(?<![\w@.,/-])(?:"
    r"\d{3}\.\d{3}\.\d{3}\s?[-/]\s?\d{2}|\d{2}\.\d{3}\.\d{3}-[\dx]"
    r"|\+\s?55\s?\(?\d{2}\)?[\s.-]?(?:9[\s.]?)?\d{4}[\s.-]?\d{4}|\(0?\d{2}\)\s?(?:9[\s.]?)?\d{4}[\s.-]?\d{4}"
    r"|\d{3} \d{3} \d{3} \d{2}|\d{3}\.\d{3}\.\d{3}|\d{2}[\s.]\d{4,5}[\s.-]\d{4}|0\d{2} \d{8,9}|\d{4,5}[-\s.]\d{4}|\d{8,14}|\d{7,8}[-]?[\dx]"
    r")(?![\w]|[-/.]\d)"
)
CEP = re.compile(r"\d{5}-\d{3}(?!\d)")
WORD, DIGIT = re.compile(r"[a-z]+(?:\.[a-z]+)*"), re.compile(r"\d")
NAME_WORD = re.compile(r"[a-z]+")
_NOT_PLAIN = re.compile(NOT_PLAIN.removesuffix("|  "))
_FOLD = {c: d[0] for c in range(0xC0, 0x180) if len(d := unicodedata.normalize("NFD", chr(c)).lower()) > 1 or d.isascii()}


def readable(text: str) -> tuple[str, list[int] | None]:
    """The canonical form of a text, and for each of its characters (and its end) the place in the text; None: the same."""
    if not _NOT_PLAIN.search(text):
        return text, None
    out, at, i, n = [], [], 0, len(text)
    while i < n:
        j = i + 1
        while j < n and unicodedata.combining(text[j]):
            j += 1
        piece = unicodedata.normalize("NFC", "".join(map(prototype, unicodedata.normalize("NFD", text[i:j])))) if text[i] != "\n" else "\n"
        out.append(piece)
        at += [i] * len(piece)
        i = j
    return "".join(out), [*at, n]


def folded(text: str) -> str:
    """Lower case without accents, character by character."""
    low = text.lower()
    if low.isascii():
        return low
    return low.translate(_FOLD) if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text).translate(_FOLD)


ANNOUNCED = {folded(w): k for k, ws in PRIOR.items() for w in ws}


def words_before(f: str, start: int) -> list[str]:
    """The nearest NEAR_WORDS words with a meaning between the number before and a place, the nearest first, with distances."""
    near = f[max(0, start - NEAR_CHARS) : start]
    digits = [m.end() for m in DIGIT.finditer(near)]
    found = [w for w in WORD.findall(near[digits[-1] if digits else 0 :]) if len(w) > 2 or w in SHORT_CUES]
    return [f"{w}@{d}" for d, w in enumerate(reversed(found[-NEAR_WORDS:]), 1)]


def shape_of(number: str) -> str:
    """'+' or '(' and how many digits, of a number that begins so; else each digit as 9, without spaces around - and /."""
    if number[0] in "+(":
        return f"{number[0]}{len(DIGIT.findall(number))}"
    return re.sub(r"\s?([-/])\s?", r"\1", DIGIT.sub("9", number))


def certain_items(f: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]], list[str]]:
    """Emails and addresses; the numbers outside them, with their shape; the emails' owners."""
    spans, owners, numbers = [], [], []
    if "@" in f or "arroba" in f or "at" in f and ("(at" in f or "[at" in f):
        for m in EMAIL.finditer(f):
            spans.append((m.start(), m.end(), "email"))
            owners.append(m.group(1))
    if any(c.isdigit() for c in f):
        for m in ADDRESS.finditer(f):
            if not any(a < m.end() and m.start() < b for a, b, _ in spans):
                spans.append((m.start(), m.end(), "address"))
        for m in NUMBER.finditer(f):
            if not any(a < m.end() and m.start() < b for a, b, _ in spans) and not CEP.match(f, m.start()):
                numbers.append((m.start(), m.end(), shape_of(m.group())))
    return spans, numbers, owners


def blank(f: str, spans: list) -> str:
    for a, b, *_ in spans:
        f = f[:a] + "\0" * (b - a) + f[b:]
    return f


def owner_parts(owner: str) -> tuple[str, str] | None:
    parts = [p for p in re.split(r"[._-]", owner.partition("+")[0].rstrip("0123456789")) if p]
    return (parts[0], parts[-1]) if len(parts) > 1 and all(p.isalpha() and len(p) > 2 for p in (parts[0], parts[-1])) else None


def introduced(c: str, f: str, at: int) -> tuple[str, str] | None:
    """The first and last word of the name that begins at a place, where it is written with capitals."""
    last, parts = at, []
    for m in NAME_WORD.finditer(f, at):
        capital = c[m.start()].isupper()
        if f[last : m.start()].strip(" ") or not capital and m.group() not in PARTICLES:
            break
        if capital and m.end() - m.start() > 2:
            parts.append(m.group())
        last = m.end()
    return (parts[0], parts[-1]) if len(parts) > 1 else None


def observe(text: str, counts: Counter) -> None:
    """Adds what one text tells: words, neighbours written as names, owners of addresses, words in front of numbers."""
    c, _ = readable(text)
    f = folded(c)
    spans, numbers, owners = certain_items(f)
    for o in owners:
        if p := owner_parts(o):
            counts["owner", p[0], p[1]] += 1
    for a, _, shape in numbers:
        near = words_before(f, a)
        for w in near:
            counts["cue", w, shape] += 1
            if w.partition("@")[0] in ANNOUNCED:  # what stands before it does not announce the number
                break
        counts["shape", shape, next((k for w in near if (k := ANNOUNCED.get(w.partition("@")[0]))), "?")] += 1
    for m in INTRODUCED.finditer(f):
        if p := introduced(c, f, m.end()):
            counts["owner", p[0], p[1]] += 1
    rest = blank(f, spans) if spans else f
    found = [(m.start(), m.end()) for m in NAME_WORD.finditer(rest)]
    counts.update(("word", rest[a:b], "") for a, b in found)
    if c.isupper():
        return
    last = None
    for a, b in found:
        w = rest[a:b]
        if c[a].isupper() and b - a > 2:
            if last and rest[last[1] : a].strip(" .") == "":
                counts["pair", last[0], w] += 1
            last = (w, b)
        elif last and (w in PARTICLES or b - a == 1) and rest[last[1] : a].strip(" ") == "":
            last = (last[0], b)
        else:
            last = None


_COUNTS = T.StructType([T.StructField("what", T.StringType()), T.StructField("a", T.StringType()), T.StructField("b", T.StringType()), T.StructField("n", T.LongType())])


def _observe_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: Counter = Counter()
    make = lambda: pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["what", "a", "b", "n"])
    for batch in batches:
        for t in batch.iloc[:, 0]:
            if t:
                observe(t, counts)
        if len(counts) > 200_000:
            yield make()
            counts.clear()
    if counts:
        yield make()


def corpus_counts(texts: DataFrame) -> DataFrame:
    """(what, a, b, n) over all texts of the only column; counts of parts of a corpus are merged by adding n."""
    return texts.where(F.col(texts.columns[0]).isNotNull()).mapInPandas(_observe_batches, _COUNTS).groupBy("what", "a", "b").agg(F.sum("n").alias("n"))


def protected_terms(counts: DataFrame) -> DataFrame:
    """(term, role, strength): given and family names with their bits, words in front of numbers and ('#') shapes by kind.

    A name part's evidence is how often it owns an email address or stands beside one that does, in a pair written as a
    name. Its disclosure is log2 of that share of its uses over the share among all words. A shape reveals a kind by the
    share of its numbers that are announced as such; a word in front of numbers by the share of numbers of shapes that
    reveal the kind among all it precedes; role 'other' are words that precede many numbers of which next to none do.
    """
    spark = counts.sparkSession
    owner = counts.where(F.col("what") == "owner")
    first, family = owner.groupBy(F.col("a").alias("t")).agg(F.sum("n").alias("n")), owner.groupBy(F.col("b").alias("t")).agg(F.sum("n").alias("n"))
    pair = counts.where(F.col("what") == "pair").select("a", "b", "n")
    word = counts.where(F.col("what") == "word").select(F.col("a").alias("t"), F.col("n").alias("uses"))
    beside_family = pair.join(family.select(F.col("t").alias("b")), "b").groupBy(F.col("a").alias("t")).agg(F.sum("n").alias("n"))
    beside_first = pair.join(first.select(F.col("t").alias("a")), "a").groupBy(F.col("b").alias("t")).agg(F.sum("n").alias("n"))
    total = word.agg(F.sum("uses").alias("all_uses"))

    def revealed(own: DataFrame, beside: DataFrame, role: str) -> DataFrame:
        seen = own.unionByName(beside).groupBy("t").agg(F.sum("n").alias("n")).join(word, "t", "left")
        uses = F.greatest(F.coalesce("uses", F.lit(0)), "n")
        sums = seen.agg(F.sum("n").alias("all_n"))
        seen = seen.crossJoin(F.broadcast(sums)).crossJoin(F.broadcast(total))  # two single rows
        share = F.col("n") / uses
        bits = F.log2(share / (F.col("all_n") / F.greatest(F.coalesce("all_uses", F.lit(0)), "all_n")))
        ok = (F.col("n") >= NAME_SUPPORT) & (share >= NAME_SHARE) & ((bits >= NAME_BITS) | (share >= 0.5)) & ~F.col("t").isin(*PARTICLES, *SHOPS)
        return seen.where(ok).select(F.col("t").alias("term"), F.lit(role).alias("role"), bits.alias("strength"), "n")

    n = lambda k: F.coalesce(F.sum(F.when(F.col("b") == k, F.col("n"))), F.lit(0))
    best, total_n = F.greatest("p", "i"), F.col("all_n")
    mine = F.when(F.col("p") >= F.col("i"), "phone").otherwise("id_number")
    known = spark.createDataFrame([("shape", x, k, CUE_SUPPORT) for k, xs in PRIOR_SHAPES.items() for x in xs], _COUNTS)
    shape = counts.where(F.col("what") == "shape").unionByName(known).groupBy(F.col("a").alias("shape")).agg(n("phone").alias("p"), n("id_number").alias("i"), F.sum("n").alias("all_n"))
    shape = shape.where((best >= CUE_SUPPORT) & (best / total_n >= SHAPE_SHARE)).select("shape", mine.alias("kind"), (best / total_n).alias("strength"))
    prior = spark.createDataFrame([("cue", f"{folded(w)}@{d}", k, CUE_SUPPORT) for k, ws in PRIOR.items() for w in ws for d in range(1, NEAR_WORDS + 1)], _COUNTS)
    seen = counts.where(F.col("what") == "cue").join(shape, F.col("b") == F.col("shape"), "left").select("what", "a", F.coalesce("kind", F.lit("?")).alias("b"), "n")
    cue = seen.unionByName(prior)
    cue = cue.groupBy(F.col("a").alias("term")).agg(n("phone").alias("p"), n("id_number").alias("i"), F.sum("n").alias("all_n"))
    kind = F.when((best >= CUE_SUPPORT) & (best / F.col("all_n") >= CUE_SHARE), mine).when((F.col("all_n") >= OTHER_SUPPORT) & (best / F.col("all_n") < OTHER_SHARE), "other")
    cues = cue.select("term", kind.alias("role"), (best / F.col("all_n")).alias("strength")).where(F.col("role").isNotNull())
    names = revealed(first, beside_family, "given").unionByName(revealed(family, beside_first, "family"))
    # a term with evidence for both parts of a name has the role with more of it
    names = names.groupBy("term").agg(F.max(F.struct("n", "role", "strength")).alias("s")).select("term", "s.role", "s.strength")
    shapes = shape.select(F.concat(F.lit("#"), "shape").alias("term"), F.col("kind").alias("role"), "strength")
    return names.unionByName(cues).unionByName(shapes)


class Terms:
    """Protected terms in memory: of the whole corpus, or those of one text."""

    def __init__(self, rows) -> None:
        self.given, self.family, self.cue = set(), set(), {}
        for term, role in rows:
            if role == "given":
                self.given.add(term)
            elif role == "family":
                self.family.add(term)
            else:
                self.cue[term] = role

    def number_kind(self, f: str, start: int, shape: str) -> str | None:
        """The kind of a number by its shape, else by the nearest word that tells one; a shape gives way only to 'other'."""
        kind = self.cue.get(f"#{shape}")
        for w in words_before(f, start):
            role = self.cue.get(w)
            if role == "other":
                return None
            if role:
                return kind or role
        return kind

    def names(self, f: str) -> list[tuple[int, int, str]]:
        words = [(m.start(), m.end(), m.group()) for m in NAME_WORD.finditer(f)]
        out, i = [], 0
        while i < len(words):
            a, b, w = words[i]
            j, end = i + 1, None
            if w in self.given and not (i and words[i - 1][2] in SHOPS):
                last = b
                while j < len(words) and j - i < NAME_WORDS:
                    x, y, v = words[j]
                    if f[last:x].strip(" .") or ("." in f[last:x] and last - words[j - 1][0] > 1):
                        break
                    last = y
                    if v in self.family or end and v in self.given:
                        end = y if v in self.family or end else end
                        j += 1
                    elif v in PARTICLES or y - x == 1 or v in self.given:
                        j += 1
                    else:
                        break
            if end:
                out.append((a, end, "name"))
                while i < len(words) and words[i][0] < end:
                    i += 1
            else:
                i += 1
        return out


def find(text: str, terms: Terms) -> list[tuple[int, int, str]]:
    """Personal items of a text as (start, end, kind), in the text as written."""
    c, at = readable(text)
    f = folded(c)
    spans, numbers, _ = certain_items(f)
    spans += [(a, b, k) for a, b, shape in numbers if (k := terms.number_kind(f, a, shape))]
    spans += terms.names(blank(f, spans) if spans else f)
    spans.sort()
    return [(at[a], at[b - 1] + 1 if at[b] > at[b - 1] else at[b], k) for a, b, k in spans] if at else spans


def mask(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, i = [], 0
    for a, b, k in spans:
        out += [text[i:a], PLACEHOLDER[k]]
        i = b
    return "".join([*out, text[i:]])


_FOUND = T.StructType([T.StructField("text", T.StringType()), T.StructField("kinds", T.ArrayType(T.StringType()))])


def _treat(texts: pd.Series, terms_of) -> pd.DataFrame:
    rows = []
    for i, t in enumerate(texts):
        spans = find(t, terms_of(i)) if t else []
        rows.append((t if not spans else mask(t, spans), [k for _, _, k in spans]))
    return pd.DataFrame(rows, columns=["text", "kinds"])


def _own_terms(text: str) -> list[str]:
    """All terms by which a text may be judged: its words, and the words in front of its numbers."""
    f = folded(readable(text)[0])
    _, numbers, _ = certain_items(f)
    return list({*NAME_WORD.findall(f), *(w for a, _, _ in numbers for w in words_before(f, a)), *(f"#{x}" for _, _, x in numbers)})


@F.pandas_udf(T.ArrayType(T.StringType()))
def own_terms(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: _own_terms(t) if t else [])


def sanitised(df: DataFrame, text: str, terms: DataFrame, max_broadcast: int = MAX_BROADCAST_TERMS) -> DataFrame:
    """df with `pii` (text: with placeholders, kinds: of all items in order).

    terms: protected_terms, materialised. Null text gives null text and no kinds, empty text stays empty.
    """
    spark = df.sparkSession
    known = terms.select("term", "role").limit(max_broadcast + 1).collect() if max_broadcast else None
    if known is not None and len(known) <= max_broadcast:
        shared = spark.sparkContext.broadcast(Terms(map(tuple, known)))

        @F.pandas_udf(_FOUND)
        def treat(texts: pd.Series) -> pd.DataFrame:
            return _treat(texts, lambda i, t=shared.value: t)

        return df.withColumn("pii", treat(F.col(text)))

    @F.pandas_udf(_FOUND)
    def treat_own(texts: pd.Series, own: pd.Series) -> pd.DataFrame:
        return _treat(texts, lambda i: Terms((x["term"], x["role"]) for x in (own.iloc[i] if own.iloc[i] is not None else ())))

    keyed = cut(df.withColumn("_row", F.monotonically_increasing_id()))
    own = keyed.select("_row", F.explode(own_terms(F.col(text))).alias("term")).join(terms.select("term", "role"), "term")
    own = own.groupBy("_row").agg(F.collect_list(F.struct("term", "role")).alias("_own"))
    return keyed.join(own, "_row", "left").withColumn("pii", treat_own(F.col(text), F.col("_own"))).drop("_row", "_own")


def learn(*texts: DataFrame) -> DataFrame:
    """Protected terms from all given one-column tables, materialised."""
    whole = texts[0].toDF("text")
    for t in texts[1:]:
        whole = whole.unionByName(t.toDF("text"))
    return cut(protected_terms(cut(corpus_counts(whole))))


def kinds_of(df: DataFrame, key: Column, text: str, terms: DataFrame, source: str) -> DataFrame:
    """(src, record_id, kind), distinct, of rows with a key."""
    rows = sanitised(df.select(key.alias("record_id"), F.col(text).alias("_t")).where(F.col("_t").isNotNull() & F.col("record_id").isNotNull()), "_t", terms)
    return rows.select(F.lit(source).alias("src"), "record_id", F.explode("pii.kinds").alias("kind")).distinct()
