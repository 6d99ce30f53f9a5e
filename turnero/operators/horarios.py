"""Bulk maintenance of weekly schedules and dated exceptions.

A replacement is "drop the rows of these keys, add these rows".  The keys are a table of their own,
so an empty list of rows still clears its key.  Templates are short lists written in the call; they
become an array literal that is exploded per professional, with no join.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from turnero.functions.texto import duracion_o_defecto, presente
from turnero.functions.tiempo import hhmmss
from turnero.functions.valores import DURACION_POR_DEFECTO
from turnero.operators.catalogo import por_nombre
from turnero.sources.tablas import anexar, claves_distintas

SEMANA = ["audiologo_id", "dia_semana", "hora_inicio", "hora_fin", "duracion_cita_min"]
FECHA = ["audiologo_id", "fecha", "hora_inicio", "hora_fin", "duracion_cita_min"]


def limpiar_bloques(bloques: DataFrame) -> DataFrame:
    """Drops blocks without start or end and defaults slot lengths that are no number or zero."""
    return (
        bloques.filter(presente("hora_inicio") & presente("hora_fin"))
        .withColumn("hora_inicio", hhmmss("hora_inicio")).withColumn("hora_fin", hhmmss("hora_fin"))
        .withColumn("duracion_cita_min", duracion_o_defecto("duracion_cita_min"))
    )


def _sin_claves(tabla: DataFrame, claves: DataFrame, columnas: list[str]) -> DataFrame:
    return tabla.join(claves_distintas(claves, columnas), columnas, "left_anti")


def _plantilla(filas: Iterable[tuple]) -> Column:
    """Template rows (weekday, start, end[, slot minutes]) as an array of structs."""
    def fila(dia, inicio, fin, minutos=DURACION_POR_DEFECTO):
        return F.struct(
            F.lit(dia).cast("int").alias("dia_semana"), hhmmss(F.lit(inicio)).alias("hora_inicio"),
            hhmmss(F.lit(fin)).alias("hora_fin"),
            F.lit(minutos).cast("int").alias("duracion_cita_min"),
        )

    return F.array(*[fila(*f) for f in filas])


def lunes_a(ultimo: int, inicio: str, fin: str, primero: int = 1) -> list[tuple]:
    """The same block on every weekday from ``primero`` to ``ultimo``."""
    return [(dia, inicio, fin) for dia in range(primero, ultimo + 1)]


def expandir_plantilla(audiologos: DataFrame, plantilla: Iterable[tuple]) -> DataFrame:
    """Weekly rows of every professional out of one template."""
    return audiologos.select(
        F.col("id").alias("audiologo_id"), F.inline(_plantilla(plantilla))
    )


def reemplazar_horario(
    horarios_disponibles: DataFrame, claves: DataFrame, nuevos: DataFrame, lote: str = ""
) -> DataFrame:
    """Replaces the weekly schedule of the professionals in ``claves``."""
    return anexar(
        _sin_claves(horarios_disponibles, claves, ["audiologo_id"]),
        limpiar_bloques(nuevos).select(*SEMANA), "horarios_disponibles", lote,
    )


def reemplazar_dia(
    horarios_fecha: DataFrame, claves: DataFrame, nuevos: DataFrame, lote: str = ""
) -> DataFrame:
    """Replaces the exception of each (professional, date); without rows the exception is gone."""
    return anexar(
        quitar_excepcion(horarios_fecha, claves), limpiar_bloques(nuevos).select(*FECHA),
        "horarios_fecha", lote,
    )


def quitar_excepcion(horarios_fecha: DataFrame, claves: DataFrame) -> DataFrame:
    """Removes exceptions, so those days follow the weekly schedule again."""
    return _sin_claves(horarios_fecha, claves, ["audiologo_id", "fecha"])


def copiar_dias(
    horarios_disponibles: DataFrame, origen: int, destinos: Iterable[int],
    claves: DataFrame, lote: str = "",
) -> DataFrame:
    """Makes the target weekdays of the given professionals equal to their source weekday."""
    destinos = [d for d in destinos if d != origen]
    if not destinos:
        return horarios_disponibles
    quienes = claves.select("audiologo_id").distinct()
    quedan = horarios_disponibles.join(
        quienes.withColumn("dia_semana", F.explode(F.array(*[F.lit(d) for d in destinos]))),
        ["audiologo_id", "dia_semana"], "left_anti",
    )
    copias = (
        horarios_disponibles.filter(F.col("dia_semana") == origen)
        .join(claves_distintas(claves, ["audiologo_id"]), "audiologo_id", "left_semi")
        .drop("dia_semana")
        .withColumn("dia_semana", F.explode(F.array(*[F.lit(d) for d in destinos])))
        .select(*SEMANA)
    )
    return anexar(quedan, copias, "horarios_disponibles", lote)


def aplicar_plantilla(
    horarios_disponibles: DataFrame, audiologos: DataFrame, plantilla: Iterable[tuple],
    lote: str = "",
) -> DataFrame:
    """Gives the professionals exactly the template, whatever they had."""
    return reemplazar_horario(
        horarios_disponibles, audiologos.select(F.col("id").alias("audiologo_id")),
        expandir_plantilla(audiologos, plantilla), lote,
    )


def restablecer_horario(
    horarios_disponibles: DataFrame, horarios_fecha: DataFrame, audiologos: DataFrame,
    nombres: list[str], plantilla: Iterable[tuple], lote: str = "",
) -> tuple[DataFrame, DataFrame]:
    """Drops exceptions and weekly rows of the named professionals and applies a template."""
    elegidos = audiologos.filter(F.col("nombre").isin(nombres))
    claves = elegidos.select(F.col("id").alias("audiologo_id"))
    return (
        aplicar_plantilla(horarios_disponibles, elegidos, plantilla, lote),
        _sin_claves(horarios_fecha, claves, ["audiologo_id"]),
    )


def cargar_roster(
    horarios_fecha: DataFrame, horarios_disponibles: DataFrame, audiologos: DataFrame,
    roster: DataFrame, lote: str = "",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Loads a dated roster (``nombre, fecha, hora_inicio, hora_fin``).

    Returns exceptions, weekly rows without those of the professionals on the roster, and the
    roster rows whose name matches nobody.  A name shared by several professionals counts for each.
    """
    cruzadas, sin_cruce = por_nombre(roster, audiologos)
    filas = cruzadas.select(
        "audiologo_id", F.col("fecha").cast("date").alias("fecha"),
        hhmmss("hora_inicio").alias("hora_inicio"), hhmmss("hora_fin").alias("hora_fin"),
        F.lit(DURACION_POR_DEFECTO).alias("duracion_cita_min"),
    )
    return (
        anexar(horarios_fecha, filas, "horarios_fecha", lote),
        _sin_claves(horarios_disponibles, filas, ["audiologo_id"]),
        sin_cruce,
    )
