"""Registered queries: availability and its steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnero.functions.tiempo import hms, serie_dias
from turnero.operators import disponibilidad as d
from turnero.plans.registro import DESDE, HASTA, HORAS, consulta, hm
from turnero.sources.derivadas import PLANTILLAS
from turnero.sources.tablas import valores

PARES = f"""
, dias as (
  select cast(d as date) fecha
  from generate_series(date '{DESDE}', date '{HASTA}', interval 1 day) t(d)),
pares as (select a.id audiologo_id, d.fecha from audiologos a cross join dias d)"""

SEMANALES = PARES + """
, semanales as (
  select p.audiologo_id, p.fecha, h.ini, h.fin, h.dur, false es_override
  from pares p join horarios_disponibles h
    on h.audiologo_id = p.audiologo_id and h.dia_semana = extract(dow from p.fecha))"""

EFECTIVO = SEMANALES + """
, efectivo as (
  select p.audiologo_id, p.fecha, h.ini, h.fin, h.dur, true es_override
  from pares p join horarios_fecha h on h.audiologo_id = p.audiologo_id and h.fecha = p.fecha
  union all
  select * from semanales s where not exists (
    select 1 from horarios_fecha f where f.audiologo_id = s.audiologo_id and f.fecha = s.fecha))"""

SLOTS = """
, cortados as (
  select r.*, unnest(range(0, cast(round(cast(fin - ini as double) / dur) as bigint))) k
  from {rangos} r),
slots as (
  select audiologo_id, fecha, ini + k * dur s, ini + (k + 1) * dur e
  from cortados where {corte})"""

PROPIO = "not es_override or ini + (k + 1) * dur <= fin"

OCUPADO = """exists (select 1 from citas c where c.audiologo_id = s.audiologo_id
  and c.fecha = s.fecha and c.ini = s.s and c.estado <> 'cancelada')"""
BLOQUEADO = """exists (select 1 from bloqueos b where b.audiologo_id = s.audiologo_id
  and b.fecha = s.fecha and b.ini is not null and s.s >= b.ini and s.s < b.fin)"""
CERRADO = """exists (select 1 from bloqueos b where b.audiologo_id = s.audiologo_id
  and b.fecha = s.fecha and b.ini is null)"""

SALIDA = f"select audiologo_id, fecha, {hm('s', 'hora_inicio')}, {hm('e', 'hora_fin')} from slots s"


def _slots(corte: str = PROPIO, rangos: str = "efectivo") -> str:
    return SLOTS.format(corte=corte, rangos=rangos)


LIBRES = f"{SALIDA} where not {OCUPADO} and not {BLOQUEADO} and not {CERRADO}"


def _argumentos(t):
    return t.horarios_disponibles, t.horarios_fecha, t.citas, t.bloqueos


@consulta("disponibilidad", EFECTIVO + _slots() + LIBRES)
def disponibilidad(t):
    return d.disponibilidad(d.pares_de(t.audiologos, DESDE, HASTA), *_argumentos(t))


@consulta("disponibilidad_rango", EFECTIVO + _slots() + LIBRES)
def disponibilidad_rango(t):
    return d.disponibilidad_rango(t.audiologos, DESDE, HASTA, *_argumentos(t))


@consulta("disponibilidad_sin_bloqueos", EFECTIVO + _slots() + f"{SALIDA} where not {OCUPADO}")
def disponibilidad_sin_bloqueos(t):
    return d.disponibilidad_rango(
        t.audiologos, DESDE, HASTA, *_argumentos(t), restar_bloqueos=False
    )


PRIMERO = """
, con_corte as (
  select e.*, first_value(fin) over (
    partition by audiologo_id, fecha order by ini, fin, dur) corte from efectivo e)"""


@consulta(
    "disponibilidad_fin_primero",
    EFECTIVO + PRIMERO
    + _slots("not es_override or ini + (k + 1) * dur <= corte", "con_corte") + LIBRES,
)
def disponibilidad_fin_primero(t):
    return d.disponibilidad_rango(
        t.audiologos, DESDE, HASTA, *_argumentos(t), fin_override="primero"
    )


@consulta(
    "horario_efectivo",
    EFECTIVO + f"select audiologo_id, fecha, {HORAS}, dur duracion_cita_min, es_override from efectivo",
)
def horario_efectivo(t):
    return d.horario_efectivo(
        d.pares_de(t.audiologos, DESDE, HASTA), t.horarios_disponibles, t.horarios_fecha
    )


def _en_segundos(t):
    """Ranges in force in the period."""
    return d.rangos_efectivos(
        d.pares_de(t.audiologos, DESDE, HASTA), t.horarios_disponibles, t.horarios_fecha
    )


def _salida(slots):
    return d.repetir(slots).select(
        "audiologo_id", "fecha", hms("slot_ini").alias("hora_inicio"),
        hms("slot_fin").alias("hora_fin"),
    )


@consulta("generar_slots", EFECTIVO + _slots() + SALIDA)
def generar_slots(t):
    return _salida(d.generar_slots(_en_segundos(t)))


@consulta(
    "slots_lateral",
    f""", cortados as (
      select audiologo_id, dia_semana, ini, dur,
        unnest(range(0, cast(round(cast(fin - ini as double) / dur) as bigint))) k
      from horarios_disponibles)
    select audiologo_id, dia_semana, {hm('ini + k * dur', 'hora_inicio')},
      {hm('ini + (k + 1) * dur', 'hora_fin')} from cortados""",
)
def slots_lateral(t):
    rangos = d.rangos_por_semana(t.horarios_disponibles)
    return d.repetir(d.generar_slots(rangos.withColumn("corte", F.lit(None).cast("int")))).select(
        "audiologo_id", "dia_semana", hms("slot_ini").alias("hora_inicio"),
        hms("slot_fin").alias("hora_fin"),
    )


@consulta("anti_citas", EFECTIVO + _slots() + f"{SALIDA} where not {OCUPADO}")
def anti_citas(t):
    return _salida(d.quitar_ocupados(d.generar_slots(_en_segundos(t)), d.horas_ocupadas(t.citas)))


@consulta("anti_bloqueo_rango", EFECTIVO + _slots() + f"{SALIDA} where not {BLOQUEADO}")
def anti_bloqueo_rango(t):
    return _salida(
        d.quitar_bloqueados(d.generar_slots(_en_segundos(t)), d.horas_bloqueadas(t.bloqueos))
    )


@consulta("anti_dia_completo", PARES + f"select * from pares s where not {CERRADO}")
def anti_dia_completo(t):
    return d.quitar_dias_cerrados(
        d.pares_de(t.audiologos, DESDE, HASTA), d.dias_cerrados(t.bloqueos)
    )


@consulta(
    "prioridad_override",
    EFECTIVO + f"select audiologo_id, fecha, {HORAS}, dur from efectivo where not es_override",
)
def prioridad_override(t):
    semanales = d.rangos_semanales_entre(t.audiologos, t.horarios_disponibles, DESDE, HASTA)
    return d.repetir(d.prioridad_override(semanales, d.dias_con_fecha(t.horarios_fecha))).select(
        "audiologo_id", "fecha", hms("ini").alias("hora_inicio"), hms("fin").alias("hora_fin"),
        "dur",
    )


@consulta("series_date", PARES + "select audiologo_id, fecha from pares")
def series_date(t):
    return d.pares_de(t.audiologos, DESDE, HASTA)


@consulta(
    "series_int",
    "select a.id audiologo_id, cast(d as int) dia_semana from audiologos a cross join range(1, 6) r(d)",
)
def series_int(t):
    return t.audiologos.select(
        F.col("id").alias("audiologo_id"), F.explode(serie_dias(1, 5)).alias("dia_semana")
    )


@consulta(
    "values_source",
    f"select audiologo_id, dia_semana, {HORAS}, dur duracion_cita_min from horarios_disponibles",
)
def values_source(t):
    """Weekly rows out of a VALUES relation of the templates, joined with the professionals of each kind."""
    plantilla = valores(t.spark, PLANTILLAS, ["tipo", "dia_semana", "ini", "fin", "duracion_cita_min"])
    gente = t.origen("supplier").select(F.col("s_suppkey").alias("audiologo_id"), (F.col("s_suppkey") % 4).alias("tipo"))
    return gente.join(plantilla, "tipo").select(
        "audiologo_id", "dia_semana", hms(F.col("ini") * 60).alias("hora_inicio"),
        hms(F.col("fin") * 60).alias("hora_fin"), "duracion_cita_min")
