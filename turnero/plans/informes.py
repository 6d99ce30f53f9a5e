"""Reports: appointment detail, agendas, counts per site, calendars and verification lists.

How it scales.  Agendas and schedules come out as sorted flat rows, ordered by a range-partitioned
sort that splits a crowded date over many tasks, rather than as one array per date.  Counts are
taken per key before names are joined to them.
"""

from __future__ import annotations

from calendar import monthrange

from pyspark.sql import Column, DataFrame, functions as F

from turnero.functions.texto import (
    acciones, activa, detalle_cita, etiqueta_estado, nombre_paciente,
)
from turnero.functions.tiempo import (
    dow, fmt_fecha_grupo, fmt_hora, hhmm, nombre_dia, orden_dia, serie_dias,
)
from turnero.operators.catalogo import sedes_activas
from turnero.operators.numeracion import numerar
from turnero.sources.tablas import claves_distintas, entre_fechas


def _uno() -> Column:
    return F.count(F.lit(1))


# ---- Appointment detail ----


def citas_detalle(
    citas: DataFrame, pacientes: DataFrame, audiologos: DataFrame, sedes: DataFrame
) -> DataFrame:
    """Appointments with patient, professional and site; one with a missing parent is dropped."""
    p = pacientes.select(
        F.col("id").alias("paciente_id"), F.col("nombre").alias("paciente_nombre"),
        F.col("telefono").alias("paciente_telefono"), F.col("email").alias("paciente_email"),
        F.col("eps").alias("paciente_eps"),
    )
    a = audiologos.select(F.col("id").alias("audiologo_id"), F.col("nombre").alias("audiologo"))
    s = sedes.select(F.col("id").alias("sede_id"), F.col("nombre").alias("sede"), "ciudad")
    return (
        citas.join(a, "audiologo_id").join(s, "sede_id").join(p, "paciente_id")
        .select(
            "id", "fecha", "hora_inicio", "hora_fin", "estado", "motivo_consulta", "notas",
            "paciente_nombre", "paciente_telefono", "paciente_email", "paciente_eps",
            "audiologo", "sede", "ciudad", "creado_en",
        )
    )


def citas_con_embebidos(
    citas: DataFrame, pacientes: DataFrame, audiologos: DataFrame, sedes: DataFrame
) -> DataFrame:
    """Appointments with their parents as structs, null where a parent is missing."""
    def padre(df: DataFrame, clave: str, nombre: str, campos: list[str]) -> DataFrame:
        return df.select(F.col("id").alias(clave), F.struct(*campos).alias(nombre))

    return (
        citas
        .join(padre(audiologos, "audiologo_id", "audiologos", ["nombre", "sede_id"]), "audiologo_id", "left")
        .join(padre(sedes, "sede_id", "sedes", ["nombre"]), "sede_id", "left")
        .join(padre(pacientes, "paciente_id", "pacientes", ["nombre", "telefono"]), "paciente_id", "left")
        .select(*citas.columns, "pacientes", "audiologos", "sedes")
    )


def filtrar_citas(
    citas: DataFrame, desde: str, hasta: str, sede=None, audiologo=None, estado=None
) -> DataFrame:
    """Appointments of a date range and of whichever site, professional and state are given."""
    df = entre_fechas(citas, desde, hasta)
    for columna, valor in (("sede_id", sede), ("audiologo_id", audiologo), ("estado", estado)):
        if valor is not None:
            df = df.filter(F.col(columna) == valor)
    return df


def rango_por_defecto(hoy: str) -> tuple[Column, Column]:
    """The range shown first: today and the seven days after it."""
    d = F.lit(hoy).cast("date")
    return d, F.date_add(d, 7)


def agenda_por_dia(citas: DataFrame) -> DataFrame:
    """Appointments by date and start (then id), each with the label of its day."""
    return citas.select(
        "fecha", fmt_fecha_grupo("fecha").alias("etiqueta_dia"), "hora_inicio", "id"
    ).orderBy("fecha", "hora_inicio", "id")


def agenda(
    citas: DataFrame, pacientes: DataFrame, audiologos: DataFrame, sedes: DataFrame,
    desde: str, hasta: str, sede=None, audiologo=None, estado=None,
) -> DataFrame:
    """The day list of the panel as rows: labels, detail line and allowed actions."""
    df = citas_con_embebidos(
        filtrar_citas(citas, desde, hasta, sede, audiologo, estado), pacientes, audiologos, sedes
    )
    return df.select(
        "fecha", fmt_fecha_grupo("fecha").alias("etiqueta_dia"), "hora_inicio",
        fmt_hora("hora_inicio").alias("hora"), "id",
        nombre_paciente(F.col("pacientes.nombre")).alias("paciente"),
        F.col("pacientes.telefono").alias("telefono"),
        detalle_cita(
            F.col("audiologos.nombre"), F.col("sedes.nombre"), F.col("motivo_consulta")
        ).alias("detalle"),
        etiqueta_estado("estado").alias("etiqueta_estado"), acciones("estado").alias("acciones"),
    ).orderBy("fecha", "hora_inicio", "id")


def agenda_numerada(citas: DataFrame) -> DataFrame:
    """Appointments with their place in the list of their day, from 1, by start and id.

    No day is gathered in one task, see ``numerar``; ``etiqueta_dia`` is on the first row of each day.
    """
    filas = citas.select("fecha", "hora_inicio", "id")
    numeradas = numerar(filas, ["fecha"], [F.col("hora_inicio").asc_nulls_first(), F.col("id")], "posicion")
    return numeradas.withColumn(
        "etiqueta_dia", F.when(F.col("posicion") == 1, fmt_fecha_grupo("fecha")))


def por_nombre_en_espanol(df: DataFrame, nombre: str = "nombre", desempate: str = "id") -> DataFrame:
    """Adds ``puesto``: the place by name in Spanish order, where accents and capitals come second and ñ
    follows n; equal names go by ``desempate``."""
    return numerar(df, [], [F.collate(F.col(nombre), "es").asc_nulls_first(), F.col(desempate)], "puesto")


# ---- Counts ----


def totales(sedes: DataFrame, audiologos: DataFrame) -> DataFrame:
    """Number of sites and of professionals, in one row."""
    cuenta = sedes.select(F.lit(1).alias("s"), F.lit(0).alias("a")).unionAll(
        audiologos.select(F.lit(0).alias("s"), F.lit(1).alias("a"))
    )
    return cuenta.agg(
        F.coalesce(F.sum("s"), F.lit(0)).cast("bigint").alias("total_sedes"),
        F.coalesce(F.sum("a"), F.lit(0)).cast("bigint").alias("total_audiologos"),
    )


def audiologos_por_sede_conteo(sedes: DataFrame, audiologos: DataFrame) -> DataFrame:
    """Professionals per site name and city, sites without any included."""
    por_sede = audiologos.groupBy("sede_id").agg(F.count("id").alias("n"))
    return (
        sedes.join(por_sede, sedes.id == por_sede.sede_id, "left")
        .groupBy(F.col("nombre").alias("sede"), "ciudad")
        .agg(F.sum(F.coalesce("n", F.lit(0))).cast("bigint").alias("num_audiologos"))
        .orderBy("ciudad", "sede")
    )


def conteo_por_sede(citas: DataFrame, hoy: str) -> DataFrame:
    """Appointments of the day that are not cancelled, per site; empty sites have no row."""
    return (
        entre_fechas(citas, hoy, hoy).filter(activa())
        .groupBy("sede_id").agg(_uno().alias("n"))
    )


def badges_sede(sedes: DataFrame, citas: DataFrame, hoy: str) -> DataFrame:
    """Active sites by name with the day's count, null where there is nothing to show."""
    conteo = conteo_por_sede(citas, hoy).withColumnRenamed("sede_id", "id")
    return (
        sedes_activas(sedes).select("id", "nombre").join(conteo, "id", "left")
        .orderBy("nombre", "id")
    )


def conteo_horarios(horarios_disponibles: DataFrame) -> DataFrame:
    return horarios_disponibles.agg(_uno().alias("total_horarios"))


def conteo_bloqueos_motivo(
    bloqueos: DataFrame, motivo: str, desde: str | None = None, hasta: str | None = None,
    nombre: str = "total_bloqueos",
) -> DataFrame:
    """Blocks of a reason, within a date range when one is given; zero when there are none."""
    df = bloqueos.filter(F.col("motivo") == motivo)
    if desde is not None:
        df = entre_fechas(df, desde, hasta)
    return df.agg(_uno().alias(nombre))


def bloqueos_restantes(bloqueos: DataFrame, motivo: str) -> DataFrame:
    """Blocks of a reason that are left."""
    return conteo_bloqueos_motivo(bloqueos, motivo, nombre="bloqueos_restantes")


def dias_bloqueados(
    bloqueos: DataFrame, audiologos: DataFrame, sedes: DataFrame, motivo: str
) -> DataFrame:
    """Blocks of a reason per site and professional name; repeated rows count."""
    por_audiologo = (
        bloqueos.filter(F.col("motivo") == motivo).groupBy("audiologo_id")
        .agg(_uno().alias("n"))
    )
    return (
        _con_profesional(por_audiologo, audiologos, sedes)
        .groupBy("sede", "audiologo").agg(F.sum("n").alias("dias_bloqueados"))
        .orderBy("sede", "audiologo")
    )


# ---- Weekly schedule and calendar ----


def semana_por_audiologo(audiologos: DataFrame, horarios_disponibles: DataFrame) -> DataFrame:
    """Weekly blocks of every professional, Monday first, with a row for each empty weekday.

    Empty weekdays are the (professional, weekday) pairs without a block; they are added to the
    blocks, so no block row moves for their sake.
    """
    quienes = audiologos.select(F.col("id").alias("audiologo_id"))
    bloques = horarios_disponibles.join(quienes, "audiologo_id", "left_semi").select(
        "audiologo_id", "dia_semana", hhmm("hora_inicio").alias("hora_inicio"),
        hhmm("hora_fin").alias("hora_fin"), "duracion_cita_min",
    )
    con_bloque = horarios_disponibles.select("audiologo_id", "dia_semana").distinct()
    vacios = (
        quienes.withColumn("dia_semana", F.explode(serie_dias(0, 6)))
        .join(con_bloque, ["audiologo_id", "dia_semana"], "left_anti")
    )
    return bloques.unionByName(vacios, allowMissingColumns=True).withColumn(
        "orden_dia", orden_dia("dia_semana")
    )


def semana(audiologos: DataFrame, horarios_disponibles: DataFrame) -> DataFrame:
    """Weekly editor as rows: weekday label, block, and a flag on days without schedule."""
    return (
        semana_por_audiologo(audiologos, horarios_disponibles)
        .withColumn("dia", nombre_dia("dia_semana"))
        .withColumn("sin_horario", F.col("hora_inicio").isNull())
        .orderBy("audiologo_id", "orden_dia", "hora_inicio")
    )


def _mes(anio: int, mes: int) -> tuple[Column, Column]:
    primero = F.make_date(F.lit(anio), F.lit(mes), F.lit(1))
    return primero, F.last_day(primero)


def fechas_con_excepcion(horarios_fecha: DataFrame, anio: int, mes: int) -> DataFrame:
    """Dates of a month that have an exception, per professional."""
    dias = monthrange(anio, mes)[1]
    return (
        entre_fechas(horarios_fecha, f"{anio:04d}-{mes:02d}-01", f"{anio:04d}-{mes:02d}-{dias:02d}")
        .select("audiologo_id", "fecha").distinct()
    )


def calendario(
    audiologos: DataFrame, horarios_fecha: DataFrame, anio: int, mes: int, hoy: str
) -> DataFrame:
    """Month grid of every professional, Sunday first.

    One row per cell: the blank cells before day 1 have no date.  ``fila`` and ``columna`` place
    the cell in a grid of seven columns.
    """
    primero, ultimo = _mes(anio, mes)
    blancos = dow(primero)
    celdas = F.sequence(F.lit(0), blancos + F.dayofmonth(ultimo) - 1)
    excepciones = fechas_con_excepcion(horarios_fecha, anio, mes).withColumn(
        "_tiene", F.lit(True)
    )
    return (
        audiologos.select(F.col("id").alias("audiologo_id"), F.explode(celdas).alias("celda"))
        .withColumn(
            "fecha", F.when(F.col("celda") >= blancos, F.date_add(primero, F.col("celda") - blancos))
        )
        .join(excepciones, ["audiologo_id", "fecha"], "left")
        .select(
            "audiologo_id", "celda",
            F.call_function("div", F.col("celda"), F.lit(7)).cast("int").alias("fila"),
            (F.col("celda") % 7).alias("columna"), F.dayofmonth("fecha").alias("dia"), "fecha",
            F.coalesce("_tiene", F.lit(False)).alias("tiene_excepcion"),
            F.coalesce(F.col("fecha") == F.lit(hoy).cast("date"), F.lit(False)).alias("es_hoy"),
        )
    )


def bloques_del_dia(horarios_fecha: DataFrame, claves: DataFrame) -> DataFrame:
    """Exception blocks of the given (professional, date) keys, by start."""
    return (
        horarios_fecha
        .join(claves_distintas(claves, ["audiologo_id", "fecha"]), ["audiologo_id", "fecha"], "left_semi")
        .select(
            "audiologo_id", "fecha", hhmm("hora_inicio").alias("hora_inicio"),
            hhmm("hora_fin").alias("hora_fin"), "duracion_cita_min",
        )
        .orderBy("audiologo_id", "fecha", "hora_inicio")
    )


# ---- Verification lists ----


def _con_profesional(
    df: DataFrame, audiologos: DataFrame, sedes: DataFrame | None = None
) -> DataFrame:
    """Adds the professional's name, and the site's when asked for; both are inner joins."""
    a = audiologos.select(
        F.col("id").alias("audiologo_id"), F.col("nombre").alias("audiologo"),
        F.col("sede_id").alias("_sede_id"),
    )
    if sedes is not None:
        s = sedes.select(F.col("id").alias("_sede_id"), F.col("nombre").alias("sede"))
        a = a.join(s, "_sede_id")
    return df.join(a.drop("_sede_id"), "audiologo_id")


def ver_horarios(horarios_disponibles: DataFrame, audiologos: DataFrame) -> DataFrame:
    """Weekly rows with the professional's name."""
    return _con_profesional(horarios_disponibles, audiologos).select(
        "audiologo", "dia_semana", "hora_inicio", "hora_fin"
    ).orderBy("audiologo", "dia_semana")


def ver_horarios_sede(
    horarios_disponibles: DataFrame, audiologos: DataFrame, sedes: DataFrame
) -> DataFrame:
    """Weekly rows with site and professional."""
    return _con_profesional(horarios_disponibles, audiologos, sedes).select(
        "sede", "audiologo", "dia_semana", "hora_inicio", "hora_fin"
    ).orderBy("sede", "audiologo", "dia_semana", "hora_inicio")


def ver_horarios_nombres(
    horarios_disponibles: DataFrame, audiologos: DataFrame, nombres: list[str]
) -> DataFrame:
    """Weekly rows of the named professionals."""
    elegidos = audiologos.filter(F.col("nombre").isin(nombres))
    return ver_horarios(horarios_disponibles, elegidos).orderBy(
        "audiologo", "dia_semana", "hora_inicio"
    )


def ver_roster(horarios_fecha: DataFrame, audiologos: DataFrame) -> DataFrame:
    """Dated rows with the professional's name."""
    return _con_profesional(horarios_fecha, audiologos).select(
        "audiologo", "fecha", "hora_inicio", "hora_fin"
    ).orderBy("fecha", "audiologo")


def ver_bloqueos_motivo(bloqueos: DataFrame, audiologos: DataFrame, motivo: str) -> DataFrame:
    """Blocks of a reason with the professional's name."""
    return _con_profesional(bloqueos.filter(F.col("motivo") == motivo), audiologos).select(
        "audiologo", "fecha", "hora_inicio", "hora_fin", "motivo"
    ).orderBy("fecha", "hora_inicio")


def ver_bloqueos_sede(
    bloqueos: DataFrame, audiologos: DataFrame, sedes: DataFrame
) -> DataFrame:
    """Blocks with site and professional."""
    return _con_profesional(bloqueos, audiologos, sedes).select(
        "sede", "audiologo", "fecha", "motivo"
    ).orderBy("fecha", "sede", "audiologo")


def ver_sedes_ilike(sedes: DataFrame, patrones: list[str]) -> DataFrame:
    """Sites whose name matches any pattern, case ignored."""
    coincide = F.lit(False)
    for patron in patrones:
        coincide = coincide | F.col("nombre").ilike(patron)
    return sedes.filter(coincide).select("nombre", "ciudad", "activa")
