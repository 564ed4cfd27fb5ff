"""Names of segment values. A label map belongs to one table; values it does not know keep their code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Codes and names of the states.
STATES = {
    "AC": "Acre", "AL": "Alagoas", "AM": "Amazonas", "AP": "Amapa", "BA": "Bahia", "CE": "Ceara", "DF": "Distrito Federal", "ES": "Espirito Santo", "GO": "Goias", "MA": "Maranhao", "MG": "Minas Gerais", "MS": "Mato Grosso do Sul",
    "MT": "Mato Grosso", "PA": "Para", "PB": "Paraiba", "PE": "Pernambuco", "PI": "Piaui", "PR": "Parana", "RJ": "Rio de Janeiro", "RN": "Rio Grande do Norte", "RO": "Rondonia", "RR": "Roraima", "RS": "Rio Grande do Sul",
    "SC": "Santa Catarina", "SE": "Sergipe", "SP": "Sao Paulo", "TO": "Tocantins",
}


def label(code: Column, names: dict[str, str] | None = None) -> Column:
    """The name of a code by a map of the table (that of the states by default)."""
    pairs = [F.lit(x) for kv in (STATES if names is None else names).items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), code), code) if pairs else code
