"""Integrity checks: each gives the rows that break a rule, as data.

``tablas`` is a dict from table name to DataFrame; a check skips tables that are not in it.
Groups are counted, never gathered, so one bad key with a huge number of rows is one result row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from turnero.functions.texto import activa
from turnero.functions.tiempo import hms, seg
from turnero.functions.valores import ESTADOS
from turnero.sources.esquemas import FORANEAS, OBLIGATORIAS
from turnero.sources.tablas import claves_distintas

CLAVE = ["audiologo_id", "fecha", "hora_inicio"]


def _union(partes: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, partes)


def _id(df: DataFrame) -> Column:
    """Row id as text, or the row's professional for tables that carry no id."""
    return F.col("id" if "id" in df.columns else "audiologo_id").cast("string").alias("id")


def chk_dominios(tablas: dict[str, DataFrame]) -> DataFrame:
    """Weekdays outside 0..6 and unknown states; null passes."""
    reglas = [
        ("horarios_disponibles", "dia_semana", ~F.col("dia_semana").between(0, 6)),
        ("citas", "estado", ~F.col("estado").isin(ESTADOS)),
    ]
    return _union([
        tablas[tabla].filter(falla).select(
            F.lit(tabla).alias("tabla"), F.lit(regla).alias("regla"), _id(tablas[tabla])
        )
        for tabla, regla, falla in reglas if tabla in tablas
    ])


def chk_no_nulos(tablas: dict[str, DataFrame]) -> DataFrame:
    """Nulls in required columns, one scan per table."""
    def de(tabla: str, df: DataFrame) -> DataFrame:
        columnas = [c for c in OBLIGATORIAS[tabla] if c in df.columns]
        nulas = F.array_compact(
            F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in columnas])
        )
        return df.select(
            F.lit(tabla).alias("tabla"), F.explode(nulas).alias("columna"), _id(df)
        )

    return _union([de(t, tablas[t]) for t in OBLIGATORIAS if t in tablas])


def chk_huerfanos(tablas: dict[str, DataFrame]) -> DataFrame:
    """Foreign-key values without a parent, with the number of rows that carry each."""
    def de(tabla: str, columna: str, padre: str) -> DataFrame:
        ids = tablas[padre].select(F.col("id").alias("valor"))
        return (
            tablas[tabla].filter(F.col(columna).isNotNull())
            .groupBy(F.col(columna).alias("valor")).agg(F.count(F.lit(1)).alias("n"))
            .join(ids, "valor", "left_anti")
            .select(
                F.lit(tabla).alias("tabla"), F.lit(columna).alias("fk"),
                F.col("valor").cast("string").alias("valor"), "n",
            )
        )

    return _union([
        de(t, c, p) for t, c, p, _ in FORANEAS if t in tablas and p in tablas
    ])


def chk_pk(tablas: dict[str, DataFrame]) -> DataFrame:
    """Primary keys that occur more than once."""
    return _union([
        df.groupBy(F.col("id").cast("string").alias("id"))
        .agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
        .select(F.lit(tabla).alias("tabla"), "id", "n")
        for tabla, df in tablas.items() if "id" in df.columns
    ])


def dobles_reservas(citas: DataFrame) -> DataFrame:
    """Slots that more than one active appointment holds."""
    return (
        citas.filter(activa() & F.col("audiologo_id").isNotNull())
        .select("audiologo_id", "fecha", seg("hora_inicio").alias("ini"))
        .groupBy("audiologo_id", "fecha", "ini").agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > 1)
        .select("audiologo_id", "fecha", hms("ini").alias("hora_inicio"), "n")
    )


def borrar_restringido(
    nombre_padre: str, ids: DataFrame, tablas: dict[str, DataFrame]
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Deletes parents by ``id``.

    A parent with children on a restricting edge is refused and stays with everything it has; the
    others go together with their rows on cascading edges.  Returns the tables that change and the
    refused ids with the child table that holds them.
    """
    ids = ids.select("id").distinct()
    aristas = [f for f in FORANEAS if f[2] == nombre_padre and f[0] in tablas]
    pedidos = ids.join(tablas[nombre_padre].select("id"), "id", "left_semi")
    rechazos = [
        pedidos.join(tablas[hija].select(F.col(fk).alias("id")).distinct(), "id", "left_semi")
        .select("id", F.lit(hija).alias("tabla"))
        for hija, fk, _, regla in aristas if regla == "restrict"
    ]
    rechazados = _union(rechazos) if rechazos else pedidos.filter("false").withColumn(
        "tabla", F.lit("")
    )
    se_van = claves_distintas(
        pedidos.join(rechazados.select("id").distinct(), "id", "left_anti"), ["id"]
    )
    cambiadas = {nombre_padre: tablas[nombre_padre].join(se_van, "id", "left_anti")}
    for hija, fk, _, regla in aristas:
        if regla == "cascade":
            cambiadas[hija] = tablas[hija].join(
                se_van.select(F.col("id").alias(fk)), fk, "left_anti"
            )
    return cambiadas, rechazados


def borrar_audiologos(
    ids: DataFrame, tablas: dict[str, DataFrame]
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Deletes professionals with their schedules, exceptions and blocks, unless they have
    appointments."""
    return borrar_restringido("audiologos", ids, tablas)
