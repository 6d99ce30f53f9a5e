"""Small tables for tests, built from Python rows with the declared schemas."""

import datetime as dt

from turnero.operators.reservas import Estado
from turnero.sources.esquemas import ESQUEMAS


def tabla(spark, nombre, filas, columnas):
    """Rows of a domain table; columns not listed are absent."""
    esquema = ESQUEMAS[nombre]
    tipo = type(esquema)([esquema[c] for c in columnas.split()])
    return spark.createDataFrame([tuple(_fecha(v) for v in f) for f in filas], tipo)


def _fecha(v):
    es_fecha = isinstance(v, str) and len(v) == 10 and v[4] == v[7] == "-"
    return dt.date.fromisoformat(v) if es_fecha else v


def semanal(spark, filas):
    return tabla(spark, "horarios_disponibles", filas,
                 "audiologo_id dia_semana hora_inicio hora_fin duracion_cita_min")


def fechado(spark, filas):
    return tabla(spark, "horarios_fecha", filas,
                 "id audiologo_id fecha hora_inicio hora_fin duracion_cita_min")


def bloqueos(spark, filas):
    return tabla(spark, "bloqueos", filas, "audiologo_id fecha hora_inicio hora_fin motivo")


def citas(spark, filas):
    return tabla(spark, "citas", filas,
                 "id paciente_id audiologo_id sede_id fecha hora_inicio hora_fin estado "
                 "motivo_consulta notas")


def audiologos(spark, filas):
    return tabla(spark, "audiologos", filas, "id nombre sede_id activo")


def sedes(spark, filas):
    return tabla(spark, "sedes", filas, "id nombre ciudad activa")


def pacientes(spark, filas):
    return tabla(spark, "pacientes", filas, "id nombre telefono email eps")


def estado(spark, c=(), p=(), a=(("a1", "Ana", "s1", True),), s=(("s1", "Norte", "Cali", True),),
           hf=(), hd=()):
    return Estado(
        citas(spark, c), pacientes(spark, p), audiologos(spark, a), sedes(spark, s),
        fechado(spark, hf), semanal(spark, hd),
    )


def filas(df, *columnas):
    """Sorted rows as tuples, nulls first."""
    orden = lambda f: [(v is not None, str(v)) for v in f]
    return sorted((tuple(r) for r in df.select(*columnas).collect()), key=orden)
