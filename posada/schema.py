"""Schemas of the tables. Every column may be null; ``ord`` gives a table's order wherever order matters."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I = T.StringType(), T.IntegerType()
_KINDS = {"string": _S, "int": _I, "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "array<int>": T.ArrayType(_I)}


def _struct(text: str) -> T.StructType:
    """A struct from 'name kind, name kind'; Spark's own parser would need a session."""
    return T.StructType([T.StructField(n, _KINDS[k]) for n, k in (x.split() for x in text.split(", "))])

LISTING = T.StructType(
    [T.StructField(n, _S) for n in ("url", "title", "price", "location", "description", "source", "date", "location_city", "location_region")]
    + [T.StructField(n, _I) for n in ("rooms", "beds", "m2", "bathrooms", "stars", "ausencias")]
)

BOOKING = _struct(
    "fuente string, nombre string, precio_noche int, precios_vistos array<int>, rating double, reviews int, url string, match double, error string, sin_resultado boolean, precio_sospechoso int"
)
GOOGLE = _struct("fuente string, rating double, reviews int, precio_tipico int, rango array<int>, url string, error string")
ESTIMATE = _struct("adr_real int, ocupacion double, revpar_real int, revpar_ine int, ingreso_anual_real long, ingreso_anual_ine long, precision string")
ENRICHED = (
    _struct("n_registro string, nombre string, direccion string, municipio string, provincia string, categoria int, habitaciones int")
    .add("booking", BOOKING)
    .add("google_travel", GOOGLE)
    .add("estimacion", ESTIMATE)
    .add("fecha_consulta", _S)
)
GAZETTEER = _struct("key string, region string, ord int")

# The names under which a licence's fields come, in the order in which they are tried.
LICENCE_ALIASES = {
    "n_registro": ("n_reg", "n_registro", "id", "registro", "codigo"),
    "nombre": ("nombre", "name", "denominacion", "establecimiento"),
    "municipio": ("municipio", "localidad", "poblacion", "ciudad"),
    "provincia": ("provincia", "prov"),
    "direccion": ("direccion", "dir", "domicilio", "calle", "address"),
    "estrellas": ("categoria_estrellas", "estrellas"),
    "categoria": ("categoria", "cat"),
    "habitaciones": ("habitaciones", "hab", "rooms"),
    "plazas": ("plazas", "plazas_totales", "capacidad"),
    "tipo": ("tipo",),
}
