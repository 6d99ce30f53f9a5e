"""Free appointment slots of any number of professionals and dates at once.

The schedule in force on a day (dated ranges if there are any, else the weekly ones) is cut into
slots, and slots that start on an active appointment or inside a block are removed.

How it scales.  Ranges, not slots, are shuffled by ``(audiologo_id, fecha)``; whole days are
dropped before any slot exists, and the block check keeps that partitioning.  Slots move once, for
the appointment check.  Every other side of a join is first reduced to distinct keys, and equal
ranges to one row with a count, so a professional or day that holds a large share of the input
shrinks on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from turnero.functions.texto import activa
from turnero.functions.tiempo import dow, envolver, hms, seg, serie_fechas
from turnero.sources.tablas import en_fechas_de, entre_fechas, reducir_a

DIA = ["audiologo_id", "fecha"]
RANGO = ["ini", "fin", "dur"]


# ---- Sides of the joins, reduced before they are shuffled ----


def horas_ocupadas(citas: DataFrame) -> DataFrame:
    """Distinct starts taken by active appointments, per professional and date."""
    return (
        citas.filter(activa() & F.col("audiologo_id").isNotNull())
        .select(*DIA, seg("hora_inicio").alias("ini")).distinct()
    )


def dias_cerrados(bloqueos: DataFrame) -> DataFrame:
    """Professional days with a whole-day block, that is one without a start."""
    return bloqueos.filter(
        F.col("hora_inicio").isNull() & F.col("audiologo_id").isNotNull()
    ).select(*DIA).distinct()


def horas_bloqueadas(bloqueos: DataFrame) -> DataFrame:
    """Blocked intervals; of those with one start only the longest matters.

    A block without an end compares as unknown and blocks nothing.
    """
    return (
        bloqueos.filter(F.col("audiologo_id").isNotNull())
        .select(*DIA, seg("hora_inicio").alias("b_ini"), seg("hora_fin").alias("b_fin"))
        .filter(F.col("b_ini") < F.col("b_fin"))
        .groupBy(*DIA, "b_ini").agg(F.max("b_fin").alias("b_fin"))
    )


def unir_intervalos(bloqueadas: DataFrame) -> DataFrame:
    """Blocked intervals (see ``horas_bloqueadas``) as disjoint ones: overlapping and touching ones are one.

    An interval opens an island when it starts after all that start before it have ended, which a running
    maximum of ends tells.  A day has one row per start, so at most 86,400, whatever the number of blocks.
    """
    antes = Window.partitionBy(*DIA).orderBy("b_ini").rowsBetween(Window.unboundedPreceding, -1)
    hasta = Window.partitionBy(*DIA).orderBy("b_ini").rowsBetween(Window.unboundedPreceding, 0)
    nueva = F.coalesce(F.col("b_ini") > F.col("_tope"), F.lit(True))
    return (
        bloqueadas.withColumn("_tope", F.max("b_fin").over(antes))
        .withColumn("_isla", F.sum(nueva.cast("int")).over(hasta))
        .groupBy(*DIA, "_isla").agg(F.min("b_ini").alias("b_ini"), F.max("b_fin").alias("b_fin")).drop("_isla")
    )


def dias_con_fecha(horarios_fecha: DataFrame) -> DataFrame:
    """Professional days that have any dated row."""
    return horarios_fecha.filter(F.col("audiologo_id").isNotNull()).select(*DIA).distinct()


def contar_iguales(df: DataFrame, clave: list[str]) -> DataFrame:
    """Schedule rows as ranges in seconds, equal ones merged into one row with a count."""
    return (
        df.filter(F.col("audiologo_id").isNotNull())
        .select(
            *clave, seg("hora_inicio").alias("ini"), seg("hora_fin").alias("fin"),
            F.col("duracion_cita_min").alias("dur"),
        )
        .groupBy(*clave, *RANGO).agg(F.count(F.lit(1)).alias("veces"))
    )


def rangos_por_semana(horarios_disponibles: DataFrame) -> DataFrame:
    return contar_iguales(horarios_disponibles, ["audiologo_id", "dia_semana"])


# ---- Schedule in force ----


def rangos_semanales(pares: DataFrame, semana: DataFrame) -> DataFrame:
    """Weekly ranges (see ``rangos_por_semana``) of the given (professional, date) pairs."""
    return (
        pares.withColumn("dia_semana", dow("fecha")).join(semana, ["audiologo_id", "dia_semana"])
        .select(*DIA, *RANGO, "veces", F.lit(False).alias("es_override"))
    )


def rangos_semanales_entre(
    audiologos: DataFrame, horarios_disponibles: DataFrame, desde: str, hasta: str
) -> DataFrame:
    """Weekly ranges on every date of a period.

    Each weekly row produces its own dates, one per week, so no table of pairs is built or joined.
    """
    d, h = F.lit(desde).cast("date"), F.lit(hasta).cast("date")
    primera = F.date_add(d, F.pmod(F.col("dia_semana") - dow(d), F.lit(7)))
    fechas = F.when(primera <= h, F.sequence(primera, h, F.expr("interval 7 days")))
    semana = rangos_por_semana(horarios_disponibles)
    quienes = audiologos.select(F.col("id").alias("audiologo_id"))
    return semana.join(quienes, "audiologo_id", "left_semi").select(
        "audiologo_id", F.explode(fechas).alias("fecha"), *RANGO, "veces",
        F.lit(False).alias("es_override"),
    )


def rangos_de_fecha(horarios_fecha: DataFrame, fin_override: str = "propio") -> DataFrame:
    """Dated ranges with the time their slots must not pass.

    ``propio``: the end of the range itself.  ``primero``: the end of the day's first range (least
    ``creado_en`` and ``id`` when the table has them, then start, end and length), which is what a
    single arbitrary range of the day amounts to.  Both agree on days with one range.
    """
    if fin_override == "propio":
        rangos = contar_iguales(horarios_fecha, DIA).withColumn("corte", F.col("fin"))
    elif fin_override == "primero":
        orden = [c for c in ("creado_en", "id") if c in horarios_fecha.columns]
        fin = seg("hora_fin")
        primero = (
            horarios_fecha.filter(F.col("audiologo_id").isNotNull()).groupBy(*DIA)
            .agg(
                F.min_by(
                    fin, F.struct(*orden, seg("hora_inicio"), fin, "duracion_cita_min")
                ).alias("corte")
            )
        )
        rangos = contar_iguales(horarios_fecha, DIA).join(primero, DIA)
    else:
        raise ValueError(f"fin_override: {fin_override}")
    return rangos.select(*DIA, *RANGO, "veces", F.lit(True).alias("es_override"), "corte")


def prioridad_override(rangos: DataFrame, dias: DataFrame) -> DataFrame:
    """Drops weekly ranges of the ``dias`` that have any dated row, even one without slots."""
    r, d = rangos.alias("r"), dias.alias("d")
    mismo = (F.col("r.audiologo_id") == F.col("d.audiologo_id")) & (
        F.col("r.fecha") == F.col("d.fecha")
    )
    return r.join(d, mismo & ~F.col("r.es_override"), "left_anti")


def _unir(semanales: DataFrame, de_fecha: DataFrame, dias: DataFrame) -> DataFrame:
    todos = semanales.withColumn("corte", F.lit(None).cast("int")).unionByName(de_fecha)
    return prioridad_override(todos, dias)


def rangos_efectivos(
    pares: DataFrame, horarios_disponibles: DataFrame, horarios_fecha: DataFrame,
    fin_override: str = "propio",
) -> DataFrame:
    """Ranges in force on the given pairs, in seconds, with a count of equal rows."""
    horarios_fecha = en_fechas_de(horarios_fecha, pares)
    pares = pares.select(*DIA).distinct()
    semana = reducir_a(horarios_disponibles, pares, ["audiologo_id"], rangos_por_semana)
    de_fecha = reducir_a(
        horarios_fecha, pares, DIA, lambda h: rangos_de_fecha(h, fin_override)
    )
    dias = reducir_a(horarios_fecha, pares, DIA, dias_con_fecha)
    return _unir(rangos_semanales(pares, semana), de_fecha, dias)


def repetir(df: DataFrame) -> DataFrame:
    """Writes each row out as often as it was counted: equal ranges give equal slots."""
    return df.withColumn("_vez", F.explode(F.sequence(F.lit(1), F.col("veces")))).drop(
        "_vez", "veces"
    )


def horario_efectivo(
    pares: DataFrame, horarios_disponibles: DataFrame, horarios_fecha: DataFrame
) -> DataFrame:
    """Schedule in force on each pair: its dated rows if it has any, else its weekly rows."""
    return repetir(rangos_efectivos(pares, horarios_disponibles, horarios_fecha)).select(
        *DIA, hms("ini").alias("hora_inicio"), hms("fin").alias("hora_fin"),
        F.col("dur").alias("duracion_cita_min"), "es_override",
    )


# ---- Slots ----


def numero_de_slots() -> Column:
    """Slots of a range: its length over the slot length, halves rounded up.

    The last slot may therefore pass the end of the range.  Null for a length of zero or null.
    """
    largo = (F.col("fin") - F.col("ini")) / F.lit(60.0)
    return F.when(F.col("dur") != 0, F.round(largo / F.col("dur")).cast("int"))


def generar_slots(rangos: DataFrame) -> DataFrame:
    """Cuts ranges (``ini``, ``fin``, ``dur``, ``corte``) into slots.

    Replaces the range columns by ``slot_ini`` and ``slot_fin`` in seconds.  A non-null ``corte``
    drops slots that end after it.  Both times wrap at midnight before they are compared.
    """
    n = numero_de_slots()
    paso = F.col("dur") * 60
    return (
        rangos.filter(n >= 1).withColumn("_k", F.explode(F.sequence(F.lit(0), n - 1)))
        .withColumn("slot_ini", envolver(F.col("ini") + F.col("_k") * paso))
        .withColumn("slot_fin", envolver(F.col("ini") + (F.col("_k") + 1) * paso))
        .filter(F.col("corte").isNull() | (F.col("slot_fin") <= F.col("corte")))
        .drop("_k", "corte", *RANGO)
    )


def rangos_invalidos(rangos: DataFrame) -> DataFrame:
    """Ranges whose slot length cannot cut them; reported as data instead of failing the job."""
    return rangos.filter(F.col("dur") <= 0)


def quitar_ocupados(slots: DataFrame, ocupadas: DataFrame) -> DataFrame:
    """Drops slots whose start equals the start of an active appointment (not those it overlaps)."""
    s, o = slots.alias("s"), ocupadas.alias("o")
    return s.join(
        o,
        (F.col("s.audiologo_id") == F.col("o.audiologo_id"))
        & (F.col("s.fecha") == F.col("o.fecha")) & (F.col("s.slot_ini") == F.col("o.ini")),
        "left_anti",
    )


def quitar_bloqueados(slots: DataFrame, bloqueadas: DataFrame) -> DataFrame:
    """Drops slots that start inside a block, its end excluded."""
    s, b = slots.alias("s"), bloqueadas.alias("b")
    return s.join(
        b,
        (F.col("s.audiologo_id") == F.col("b.audiologo_id"))
        & (F.col("s.fecha") == F.col("b.fecha"))
        & (F.col("s.slot_ini") >= F.col("b.b_ini")) & (F.col("s.slot_ini") < F.col("b.b_fin")),
        "left_anti",
    )


def quitar_dias_cerrados(rangos: DataFrame, cerrados: DataFrame) -> DataFrame:
    """Drops everything on professional days with a whole-day block."""
    return rangos.join(cerrados, DIA, "left_anti")


def _libres(
    rangos: DataFrame, ocupadas: DataFrame, bloqueos: DataFrame, restar_bloqueos: bool
) -> DataFrame:
    if restar_bloqueos:
        rangos = quitar_dias_cerrados(rangos, dias_cerrados(bloqueos))
    slots = generar_slots(rangos)
    if restar_bloqueos:
        slots = quitar_bloqueados(slots, unir_intervalos(horas_bloqueadas(bloqueos)))
    slots = quitar_ocupados(slots, ocupadas)
    return repetir(slots).select(
        *DIA, hms("slot_ini").alias("hora_inicio"), hms("slot_fin").alias("hora_fin")
    )


def disponibilidad(
    pares: DataFrame, horarios_disponibles: DataFrame, horarios_fecha: DataFrame,
    citas: DataFrame, bloqueos: DataFrame, fin_override: str = "propio",
    restar_bloqueos: bool = True,
) -> DataFrame:
    """Free slots of a set of (professional, date) pairs.

    Whether the professional or site is active, or the date past, is not looked at.  Overlapping
    ranges give a slot each.  ``fin_override`` is explained at ``rangos_de_fecha``; its default
    checks each slot against its own range.  ``restar_bloqueos=False`` ignores blocks.
    """
    return _libres(
        rangos_efectivos(pares, horarios_disponibles, horarios_fecha, fin_override),
        reducir_a(en_fechas_de(citas, pares), pares, DIA, horas_ocupadas),
        en_fechas_de(bloqueos, pares), restar_bloqueos,
    )


def disponibilidad_rango(
    audiologos: DataFrame, desde: str, hasta: str, horarios_disponibles: DataFrame,
    horarios_fecha: DataFrame, citas: DataFrame, bloqueos: DataFrame,
    fin_override: str = "propio", restar_bloqueos: bool = True,
) -> DataFrame:
    """Free slots of the professionals on every date of a period, both ends included."""
    quienes = audiologos.select(F.col("id").alias("audiologo_id"))
    fechados = entre_fechas(horarios_fecha, desde, hasta)
    rangos = _unir(
        rangos_semanales_entre(audiologos, horarios_disponibles, desde, hasta),
        rangos_de_fecha(fechados, fin_override).join(quienes, "audiologo_id", "left_semi"),
        dias_con_fecha(fechados),
    )
    return _libres(
        rangos, horas_ocupadas(entre_fechas(citas, desde, hasta)),
        entre_fechas(bloqueos, desde, hasta), restar_bloqueos,
    )


def pares_de(audiologos: DataFrame, desde: str, hasta: str) -> DataFrame:
    """Every (professional, date) pair of a period; dates are generated, not joined."""
    return audiologos.select(
        F.col("id").alias("audiologo_id"), F.explode(serie_fechas(desde, hasta)).alias("fecha")
    )
