from collections import Counter

import pytest

from tessaria.llm import pii

NAMES = [(a, b) for a in ("Rafaela", "Tiago", "Sônia", "Ivo") for b in ("Brisqueta", "Herdeirão", "Quirino", "Varjota")]
BASE = (
    [f"Contato {a.lower()}.{b.lower()}@correio.example obrigado" for a, b in NAMES]
    + [f"Meu nome é {a} {b}." for a, b in NAMES]
    + [f"Liguem no (3{i % 9}) 9{i:04d}-{i:04d} hoje" for i in range(30)]
    + [f"meu cpf {i % 9}23.456.7{i % 9}9-1{i % 9} aqui" for i in range(30)]
    + [f"Protocolo 45413{i:05d}. Pedido 816334{i:05d} sem retorno" for i in range(40)]
    + ["A vendedora Ivo resolveu tudo muito bem na loja de sempre e o produto chegou"] * 60
)


@pytest.fixture(scope="module")
def terms(spark):
    return pii.learn(spark.createDataFrame([(t,) for t in [*BASE, None, ""]], "t string"))


def kinds(terms, text):
    t = pii.Terms((r.term, r.role) for r in terms.collect())
    return sorted({k for *_, k in pii.find(text, t)})


@pytest.mark.parametrize(
    "text, want",
    [
        ("escrevam p/ TIAGO_X+loja@mail.ninho.example por favor", ["email"]),
        ("x@y sem ponto e @bazar_du", []),
        ("a.b(arroba)caixapostal.test", ["email"]),
        ("lidiane_v arroba caixa ponto test", ["email"]),
        ("ana ｍaria @ correio．example", ["email"]),
        ("liguem no +55 36 9 9872 2452.", ["phone"]),
        ("Liguem no 36949021502", ["phone"]),
        ("protocolo 4541300121", []),
        ("Pedido 07339183111 sem retorno", []),
        ("cpf 35134710024", ["id_number"]),
        ("RG 02.607.894-1", ["id_number"]),
        ("meu c​pf 111.222.333-44", ["id_number"]),
        ("EAN 7891545087112 e dia 14/03/2018", []),
        ("CEP 00684-278", []),
        ("Moro na R. Barão de Irupê 1920 casa 5", ["address"]),
        ("Av. Prof. Elza Drumelo nº 1605, Jardim", ["address"]),
        ("Rodovia da Fonte Nova, km 67, sítio 16", ["address"]),
        ("Quadra 26 lote 28", ["address"]),
        ("Deixaram na rua, na chuva. Comprei 5 unidades", []),
        ("a rua errada e 30 dias de espera", []),
        ("Rafaela T. Varjota assinou", ["name"]),
        ("sônia DOS herdeirao", ["name"]),
        ("Ivo resolveu", []),
        ("Loja Rafaela Varjota vende", []),
        ("Rua Rafaela Varjota, 764", ["address"]),
        ("[NAME] [telefone removido] <EMAIL>", []),
        ("", []),
    ],
)
def test_kinds(terms, text, want):
    assert kinds(terms, text) == want


def test_masking_keeps_the_rest(spark, terms):
    text = "Ｏlá​, liguem no (31) 99876-5432!\nTiago Brisqueta ❤️ " + "palavra " * 20_000
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (1, text)], "pii_x int, text string")
    want = text.replace("(31) 99876-5432", "[PHONE]").replace("Tiago Brisqueta", "[NAME]")
    for most in (pii.MAX_BROADCAST_TERMS, 0):  # broadcast terms, and each text joined with its own
        rows = sorted(((r.pii_x, r.pii.text, r.pii["kinds"]) for r in pii.sanitised(df, "text", terms, most).collect()), key=repr)
        assert rows == sorted([(1, want, ["phone", "name"]), (2, None, []), (3, "", []), (1, want, ["phone", "name"])], key=repr)


def test_counts_merge_and_ties(spark):
    parts = Counter()
    for t in BASE:
        pii.observe(t, parts)
    df = spark.createDataFrame([(t,) for t in BASE], "t string")
    assert {(r.what, r.a, r.b): r.n for r in pii.corpus_counts(df).collect()} == dict(parts)


def test_empty_corpus(spark):
    empty = spark.createDataFrame([], "t string")
    t = pii.learn(empty)
    assert {r.role for r in t.collect()} == {"phone", "id_number"}  # what is known before any text
    assert pii.sanitised(empty.withColumn("clash", empty.t), "t", t).count() == 0


def test_names_of_people_who_introduce_themselves_need_no_email(spark):
    terms = pii.learn(spark.createDataFrame([("Meu nome é Rafaela Brisqueta.",)] * 200 + [("a loja de sempre entregou tudo no prazo",)] * 200, "t string"))
    assert kinds(terms, "rafaela brisqueta reclamou") == ["name"] and kinds(terms, "Rafaela reclamou") == []


def test_a_shape_is_revealed_by_the_words_in_front_of_it(spark):
    """No form is certain: an unknown one is learned from announcing words, a typical one gives way to contrary evidence."""
    told = [(f"meu celular 3{i % 9} 9{i:04d} 1{i:03d}",) for i in range(40)]
    terms = pii.learn(spark.createDataFrame([*told, ("nada",)], "t string"))
    assert kinds(terms, "chamem 31 98888 1234 hoje") == ["phone"]
    goods = [(f"etiqueta 12.345.6{i:02d}-1 do produto",) for i in range(60)]
    terms = pii.learn(spark.createDataFrame(goods, "t string"))
    assert kinds(terms, "etiqueta 98.765.432-1 aqui") == [] and kinds(terms, "rg 98.765.432-1") == ["id_number"]
