"""Free slots kept as a stored table and changed only where something was booked.

The table is versioned (``turnero.sources.versionadas``), by month.  After a batch, only the days of the
professionals it touched are computed anew, from the rows of those days, and only the months of those
days are written again; all in one commit.  Readers see the slots before the batch or after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from turnero.operators.disponibilidad import DIA, disponibilidad
from turnero.sources import versionadas
from turnero.sources.tablas import claves_distintas, con_mes, materializar

LIBRES = "libres"


def _esquema(audiologo: T.DataType) -> T.StructType:
    return T.StructType([
        T.StructField("audiologo_id", audiologo), T.StructField("fecha", T.DateType()),
        T.StructField("hora_inicio", T.StringType()), T.StructField("hora_fin", T.StringType()),
    ])


def abrir_libres(libres: DataFrame, carpeta: str) -> int:
    """Stores free slots as the table's content; the version."""
    return versionadas.reemplazar(libres.select(*DIA, "hora_inicio", "hora_fin"), carpeta, LIBRES)


def leer_libres(
    spark: SparkSession, carpeta: str, audiologo: T.DataType, desde: str | None = None, hasta: str | None = None,
) -> DataFrame:
    return versionadas.leer(spark, carpeta, LIBRES, _esquema(audiologo), desde, hasta)


def actualizar_libres(
    spark: SparkSession, carpeta: str, tocados: DataFrame, horarios_disponibles: DataFrame,
    horarios_fecha: DataFrame, citas: DataFrame, bloqueos: DataFrame, desde: str, hasta: str,
) -> DataFrame:
    """The table after the days ``tocados`` (professional, date) changed; days outside the period are left.

    The tables are as after the change.  Months without a touched day are neither read nor written.
    """
    dias = materializar(
        tocados.filter(F.col("audiologo_id").isNotNull() & F.col("fecha").between(F.lit(desde).cast("date"), F.lit(hasta).cast("date")))
        .select(*DIA).distinct(), "tocados")
    tipo = dias.schema["audiologo_id"].dataType
    meses = sorted(f["mes"] for f in con_mes(dias).select("mes").distinct().collect())
    if not meses:
        return leer_libres(spark, carpeta, tipo)
    viejos = versionadas.leer(spark, carpeta, LIBRES, _esquema(tipo), solo=meses).drop("mes")
    nuevos = disponibilidad(dias, horarios_disponibles, horarios_fecha, citas, bloqueos)
    versionadas.reemplazar(
        viejos.join(claves_distintas(dias, DIA), DIA, "left_anti").select(*viejos.columns)
        .unionByName(nuevos.select(*viejos.columns)), carpeta, LIBRES, solo=meses)
    return leer_libres(spark, carpeta, tipo)
