"""Look-alikes beyond ASCII, and groups by digests of 128 bits."""

from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from tessaria.llm import canonical as c

ODD = st.text("aZ çéßæ оҫаӕβкмт̡̦͂̌́ͅ​ µμϲΑᾶǎʙĸⲕꜳЫ", max_size=20)


def test_a_prototype_need_not_be_ascii():
    for a, b in [("preҫo", "preço"), ("Cӕsar", "Cæsar"), ("straβe", "straße"), ("nᾶo", "não"), ("vocȇ", "você"), ("a―b", "a—b"), ("a∣b", "a|b"), ("ꜳ", "aa"), ("ө", "ɵ"), ("т", "ᴛ")]:
        assert c.skeleton(a) == c.skeleton(b), (a, b)
        if any(x.isascii() and x.isalpha() for x in a):
            assert c.clean(a) == c.clean(b) == b, (a, b)


def test_ordinary_writing_stays_its_own():
    for a, b in [("ã", "ă"), ("ě", "ĕ"), ("œ", "oe"), ("æ", "ae"), ("ẞ", "ß"), ("Θ", "θ"), ("Ѣ", "ѣ"), ("1º", "1o"), ("m²", "m2"), ("’", "'"), ("٥", "o"), ("1", "l"), ("rn", "m")]:
        assert c.skeleton(a) != c.skeleton(b), (a, b)
    for t in ("как мама", "ᾶ ἀγάπη"):
        assert c.clean(t) == t


@settings(max_examples=300, deadline=None)
@given(ODD)
def test_clean_keeps_the_look_of_odd_letters(t):
    assert c.clean(c.clean(t)) == c.clean(t)
    assert c.skeleton(c.clean(t)) == c.skeleton(t)
    assert c.skeleton(c.skeleton(t)) == c.skeleton(t)


def test_groups_have_every_spelling(spark):
    spelling = lambda s: "".join(chr(0xE0100 + a) + chr(0xE0100 + b) + "otimo produto, recomendo" for a, b in zip(s[::2], s[1::2]))
    pairs = [(spelling([27, 194, 65, 213, 64, 53]), spelling([139, 10, 49, 51, 44, 128])), ("preҫo", "preço"), ("5 µm", "5 µm​")]
    rows = spark.createDataFrame([(str(i), t) for i, p in enumerate(pairs) for t in p], "k string, t string")
    assert rows.select(F.xxhash64("t")).distinct().count() == 5  # the first two spellings share their 64-bit hash
    groups = c.groups_of_equal_look(rows, "k", "t").collect()
    assert sorted((r.n_rows, r.n_forms, len(r.look)) for r in groups) == [(2, 2, 32)] * 3
