"""Text functions: expressions, and an Arrow function for texts beyond the letters of a table."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Latin letters with a mark, and the letters without it.
MARKED = "àáâãäåèéêëìíîïòóôõöùúûüýÿñç"
PLAIN = "aaaaaaeeeeiiiiooooouuuuyync"
#: Words that carry no topic.
STOP = tuple(
    """
    the a an and or but if then than that this these those of in on at to for from by with is are was were be been being am do does did doing have has had having it its it's i we you he she they them my our your their as
    not no so very just too also more most much many any all some such only own same s t can will would should could there here when what which who whom how why about into over under again further once
    """.split()
)
#: What counts as a complaint of each topic, in text without case and accents.
TOPICS = {
    "delivery_delay": "atras|nao chegou|ainda nao receb|ainda nao chegou|nao receb|demor|fora do prazo|nao foi entregue|ate agora nao|nada ate agora|nao entregue|aguardando entrega",
    "product_quality": "quebrad|defeit|danific|estrag|pessima qualidade|de pessima|nao funciona|veio ruim|maquita|material ruim|qualidade ruim",
    "wrong_item": "errad|diferente do|nao era o|outro produto|trocad|nao corresponde",
    "missing_item": "faltando|veio so|so veio|incompleto|faltou|apenas uma parte",
    "positive": "otim|excelent|adorei|recomend|perfeito|chegou antes|super rapid|muito bom|amei|maravilhos|chegou rapido",
}


def bare(text: str) -> str:
    """Lower case, decomposed for compatibility, without combining marks."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))


@F.pandas_udf(T.StringType())
def _bare(text: pd.Series) -> pd.Series:
    return text.map(bare, na_action="ignore")


def normalised(text: Column) -> Column:
    """`bare` of a text. A text of ASCII and the letters of MARKED alone never leaves the JVM; others go through Arrow."""
    low = F.lower(text)
    beyond = low.rlike(rf"[^\x00-\x7f{MARKED}]")
    return F.when(beyond, _bare(F.when(beyond, text))).otherwise(F.translate(low, MARKED, PLAIN))


def topic(text: Column, name: str) -> Column:
    """1.0 where a normalised text speaks of the topic, else 0.0."""
    return text.rlike(TOPICS[name]).cast("double")


def words(text: Column) -> Column:
    """Words of a normalised text without stop words, repeats kept."""
    return F.filter(F.regexp_extract_all(text, F.lit(r"[a-z][a-z'\-]{2,}"), F.lit(0)), lambda w: ~w.isin(*STOP))


def words_and_pairs(text: Column) -> Column:
    """Words and pairs of neighbouring words."""
    w = words(text)
    n = F.size(w)
    pairs = F.zip_with(F.slice(w, 1, F.greatest(n - 1, F.lit(0))), F.slice(w, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(w, F.when(n > 1, pairs).otherwise(F.array().cast("array<string>")))
