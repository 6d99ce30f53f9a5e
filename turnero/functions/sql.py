"""Table functions for SQL sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnero.operators.disponibilidad import disponibilidad_rango

# Parameter and column types follow the registered views.
FUNCION = """
create or replace temporary function {nombre}(p_audiologo {tipo}, p_fecha date)
returns table (hora_inicio string, hora_fin string)
return select l.hora_inicio, l.hora_fin from {vista} l where l.audiologo_id = p_audiologo and l.fecha = p_fecha"""


def registrar_funciones(
    spark: SparkSession, audiologos: DataFrame, desde: str, hasta: str, horarios_disponibles: DataFrame,
    horarios_fecha: DataFrame, citas: DataFrame, bloqueos: DataFrame, sufijo: str = "",
) -> None:
    """Makes ``disponibilidad(professional, date)`` and ``disponibilidad_sin_bloqueos`` callable in SQL.

    Both give the free slots of a day in the period, without rows outside it.  Each selects from a temporary
    view of all free slots, so ``from pares p, lateral disponibilidad(p.audiologo_id, p.fecha)`` becomes a join by
    professional and date, with filters on either side pushed into the view.
    """
    tipo = horarios_disponibles.schema["audiologo_id"].dataType.simpleString()
    for nombre, restar in (("disponibilidad", True), ("disponibilidad_sin_bloqueos", False)):
        vista = f"libres_{nombre}{sufijo}"
        disponibilidad_rango(
            audiologos, desde, hasta, horarios_disponibles, horarios_fecha, citas, bloqueos, restar_bloqueos=restar,
        ).createOrReplaceTempView(vista)
        spark.sql(FUNCION.format(nombre=nombre + sufijo, tipo=tipo, vista=vista))
