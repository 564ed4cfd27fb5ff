import pytest

from tessaria.llm import prose

PROSE = "Quando a equipe ligou para os compradores, a diferença quase sumiu, e ninguém soube dizer por quê. "


@pytest.mark.parametrize(
    "text, kind",
    [
        (PROSE, "prose"),
        (PROSE.upper(), "prose"),
        ("ok", "prose"),
        ("It is not clear yet whether it explains\nall of it or only a share of what we saw\nin the weeks before the change.", "prose"),
        (PROSE + "\n- lamp\n- rug\n- watch\n" + PROSE, "prose"),
        ("Agente: o painel ficou parado; o resto ficou igual.\nCliente: por que ninguém soube dizer isso antes?\nAgente: não vale trocar nada; esperamos mais uma semana.", "prose"),
        ("1. boneca\n2. tapete\n3. teclado P\n4. prazo de entrega", "list"),
        ("• mochila;\n• bicicleta;\n• falta de embalagem;\n• Veloz Ipê;", "list"),
        ("UF;n;data\nSC;886;20/10\nGO;752;14/09\nAM;;17/05", "table"),
        ("| UF | cidade |\n| AM | vila clara |\n| SC | serra |\n| MS | santa |", "table"),
        ("cidade\tn\nporto\t3\nvila\t4\nserra\t5", "table"),
        ("ver mais\n" * 20, "junk"),
        ("itens por pedido jogo de lençol " * 30, "junk"),
        ("Home | Menu | Ajuda | Sair | Login | Topo | FAQ | Conta | App | RSS | Mapa | Home | Menu", "junk"),
        ("xbtrhgnnz bpq dbxfjzndttcgh jvt txdgpqzhp cxfmwfqwjdjng", "junk"),
        ("22287 20861077362 657941983 22592 786731728547 777", "junk"),
        ("[\\{ &#{!<^]] <!|}[$% $$*[-+ ]!<$\\}^=} -[ ]$]-[~@++", "junk"),
    ],
)
def test_kinds(spark, text, kind):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = prose.judged(df).first()
    assert r.kind == kind, r
    assert bool(r.reasons) == (kind != "prose")


def test_null_empty_long_and_clashing(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, " \n ", "z"), (4, PROSE * 5000, "w"), (4, PROSE * 5000, "w")], "doc_id long, text string, n_words string")
    rows = prose.judged(df).collect()
    assert [r.kind for r in rows] == ["prose"] * 3 + ["junk"] * 2 and rows[0].n_words == 0 and rows[3].n_words > 50_000
    assert prose.judged(df.limit(0)).count() == 0
