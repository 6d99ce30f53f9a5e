"""Registered queries: places in lists, Spanish order, merged blocks, midnight, functions in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from turnero.functions.sql import registrar_funciones
from turnero.operators import disponibilidad as d
from turnero.plans import informes as i
from turnero.plans.consultas_disponibilidad import EFECTIVO, LIBRES, PROPIO, SLOTS
from turnero.plans.consultas_informes import fecha_larga
from turnero.plans.registro import DESDE, HASTA, consulta, hm

POSICION = "row_number() over (partition by fecha order by ini, id)"


@consulta("agenda_numerada", f"""select fecha, {hm('ini', 'hora_inicio')}, id, {POSICION} posicion,
  case when {POSICION} = 1 then {fecha_larga('fecha')} end etiqueta_dia from citas""")
def agenda_numerada(t):
    return i.agenda_numerada(t.citas)


# Given names in Spanish order.
NOMBRES = ["Andrés", "Ángela", "Elena", "Élida", "Inés", "Íñigo", "Nadia", "Núñez", "Ñusta", "oscar", "Óscar", "zoe", "Zulma"]
NOMBRES_SQL = ", ".join(f"'{n}'" for n in NOMBRES)


@consulta("audiologos_en_espanol", f"""
  , con_nombre as (select s_suppkey id, s_suppkey * 5 % {len(NOMBRES)} n from supplier)
  select id, list_extract([{NOMBRES_SQL}], n::int + 1) nombre, row_number() over (order by n, id) puesto from con_nombre""")
def audiologos_en_espanol(t):
    nombres = F.array(*[F.lit(n) for n in NOMBRES])
    gente = t.origen("supplier").select(
        F.col("s_suppkey").alias("id"), F.get(nombres, (F.col("s_suppkey") * 5 % len(NOMBRES)).cast("int")).alias("nombre"))
    return i.por_nombre_en_espanol(gente)


# ---- Blocks as disjoint intervals, and days that end at 24:00 ----

# Blocks without end go to midnight for some events; others stay without end and block nothing.
HASTA_MEDIANOCHE = """
, nocturnos as (
  select audiologo_id, fecha, ini, case when fin is null and id % 3 = 0 then 1440 else fin end fin from bloqueos
  union all select audiologo_id, fecha, 1320, 1440 from bloqueos where id % 4 = 1)"""


def _nocturnos(t) -> DataFrame:
    sin_fin = F.col("hora_inicio").isNotNull() & F.col("hora_fin").isNull() & (F.col("id") % 3 == 0)
    b = t.bloqueos.select(
        "audiologo_id", "fecha", "hora_inicio", F.when(sin_fin, "24:00").otherwise(F.col("hora_fin")).alias("hora_fin"))
    noche = t.bloqueos.filter("id % 4 = 1").select(
        "audiologo_id", "fecha", F.lit("22:00:00").alias("hora_inicio"), F.lit("24:00:00").alias("hora_fin"))
    return b.unionByName(noche)


@consulta("bloqueos_unidos", HASTA_MEDIANOCHE + """
, validos as (select * from nocturnos where ini < fin),
abren as (
  select *, ini > coalesce(max(fin) over (partition by audiologo_id, fecha order by ini, fin
    rows between unbounded preceding and 1 preceding), -1) nueva from validos),
islas as (
  select *, count(*) filter (nueva) over (partition by audiologo_id, fecha order by ini, fin) isla from abren)
select audiologo_id, fecha, (min(ini) * 60)::int b_ini, (max(fin) * 60)::int b_fin
from islas group by audiologo_id, fecha, isla""")
def bloqueos_unidos(t):
    return d.unir_intervalos(d.horas_bloqueadas(_nocturnos(t)))


TARDE = HASTA_MEDIANOCHE + """
, hasta_tarde as (
  select audiologo_id, dia_semana, ini, case when fin = 1020 then 1440 else fin end fin, dur from horarios_disponibles
  union all select audiologo_id, dia_semana, 1440, 1440, dur from horarios_disponibles where ini = 780)"""


@consulta(
    "disponibilidad_medianoche",
    TARDE + (EFECTIVO + SLOTS.format(corte=PROPIO, rangos="efectivo") + LIBRES)
    .replace("horarios_disponibles", "hasta_tarde").replace("from bloqueos", "from nocturnos"),
)
def disponibilidad_medianoche(t):
    semana = t.horarios_disponibles
    tarde = semana.withColumn(
        "hora_fin", F.when(F.col("hora_fin") == "17:00:00", "24:00:00").otherwise(F.col("hora_fin"))
    ).unionByName(semana.filter("hora_inicio = '13:00:00'").withColumns(
        {"hora_inicio": F.lit("24:00"), "hora_fin": F.lit("24:00:00")}))
    return d.disponibilidad_rango(t.audiologos, DESDE, HASTA, tarde, t.horarios_fecha, t.citas, _nocturnos(t))


# ---- SQL ----


@consulta("disponibilidad_lateral", EFECTIVO + SLOTS.format(corte=PROPIO, rangos="efectivo") + LIBRES)
def disponibilidad_lateral(t):
    """The table function, called for every professional and date by a lateral join."""
    sufijo = f"_{uuid.uuid4().hex}"
    registrar_funciones(
        t.spark, t.audiologos, DESDE, HASTA, t.horarios_disponibles, t.horarios_fecha, t.citas, t.bloqueos, sufijo)
    d.pares_de(t.audiologos, DESDE, HASTA).createOrReplaceTempView(f"pares{sufijo}")
    return t.spark.sql(
        f"select p.audiologo_id, p.fecha, s.hora_inicio, s.hora_fin"
        f" from pares{sufijo} p, lateral disponibilidad{sufijo}(p.audiologo_id, p.fecha) s")
