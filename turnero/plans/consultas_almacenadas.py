"""Registered queries that write stored tables, change them, read them back and ask again."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from turnero.operators import disponibilidad as d, panel, reservas as r
from turnero.operators.vistas import abrir_libres, actualizar_libres
from turnero.plans.consultas_disponibilidad import EFECTIVO, LIBRES, SLOTS, PROPIO
from turnero.plans.consultas_reservas import CAMPOS, CITA, DECIDIDAS, PANEL
from turnero.plans.registro import DESDE, HASTA, consulta, hm
from turnero.sources import versionadas as v
from turnero.sources.tablas import anexar, carpeta_de_trabajo
from turnero.streaming.reservas_stream import estado_en, procesar_lote

# Dated schedules spread over three months, so that a change touches some of them.
REPARTIDAS = """
, repartidas as (
  select audiologo_id, fecha + cast(31 * (audiologo_id % 3) as int) fecha, ini, fin, dur from horarios_fecha)"""
DOS_MESES, TRES_MESES = "2024-02-29", "2024-04-10"

REEMPLAZADAS = REPARTIDAS + f"""
, reemplazadas as (
  select * from repartidas where fecha > date '{DOS_MESES}'
  union all select * from repartidas where fecha < date '2024-02-01' and audiologo_id % 2 = 1)"""


def _repartidas(t) -> DataFrame:
    desplaza = (31 * (F.col("audiologo_id") % 3)).cast("int")
    return t.horarios_fecha.withColumn("fecha", F.date_add("fecha", desplaza))


def _con_reemplazo(t) -> DataFrame:
    """January keeps some professionals, February is emptied, later months stay: one commit; read back."""
    carpeta = carpeta_de_trabajo(t.spark, "almacen")
    tabla = _repartidas(t)
    v.agregar_filas(tabla, carpeta, "horarios_fecha")
    guardada = v.leer(t.spark, carpeta, "horarios_fecha", tabla.schema, DESDE, "2024-01-31")
    quedan = guardada.filter((F.col("audiologo_id") % 2 == 1) & (F.col("mes") == "2024-01")).drop("mes")
    v.reemplazar(quedan, carpeta, "horarios_fecha", DESDE, DOS_MESES)
    return v.leer(t.spark, carpeta, "horarios_fecha", tabla.schema)


@consulta("reemplazo_confirmado", REEMPLAZADAS + f"""
  select audiologo_id, fecha, {hm('ini', 'hora_inicio')}, {hm('fin', 'hora_fin')}, dur duracion_cita_min from reemplazadas""")
def reemplazo_confirmado(t):
    return _con_reemplazo(t).drop("mes")


@consulta(
    "disponibilidad_tras_reemplazo",
    REEMPLAZADAS + (EFECTIVO + SLOTS.format(corte=PROPIO, rangos="efectivo") + LIBRES)
    .replace("horarios_fecha", "reemplazadas").replace(HASTA, TRES_MESES),
)
def disponibilidad_tras_reemplazo(t):
    return d.disponibilidad_rango(
        t.audiologos, DESDE, TRES_MESES, t.horarios_disponibles, _con_reemplazo(t), t.citas, t.bloqueos)


@consulta("fundir_ediciones", PANEL.replace(
    "from con_paciente),\nagenda", "from con_paciente where cita_id is not null),\nagenda") + f"select {CAMPOS} from editadas")
def fundir_ediciones(t):
    """Only the appointments that edits change go to the stored table, merged by month."""
    carpeta = carpeta_de_trabajo(t.spark, "almacen")
    citas = r.ids_texto(t.citas)
    v.agregar_filas(citas, carpeta, "citas")
    guardadas = v.leer(t.spark, carpeta, "citas", citas.schema)
    completas, _ = panel.separar_validas(t.ediciones)
    con_paciente, _ = panel.pacientes_del_panel(t.pacientes, completas)
    cambios = con_paciente.filter(F.col("cita_id").isNotNull()).select(
        F.col("cita_id").cast("string").alias("id"), F.struct("recibida_en", "solicitud_id").alias("orden"),
        "paciente_id", "audiologo_id", "sede_id", "fecha", "hora_inicio", F.col("motivo").alias("motivo_consulta"), "notas",
    )
    revisadas = panel.revisar_ediciones(guardadas, panel.normalizar_ediciones(cambios))
    v.fundir(panel.citas_editadas(guardadas, revisadas.filter(F.col("motivo_rechazo").isNull())),
             carpeta, "citas", citas.schema)
    return v.leer(t.spark, carpeta, "citas", citas.schema).select(*CITA)


@consulta("anexar_guardada", """
  select cast(id as varchar) id, nombre, ciudad, activa from sedes
  union all select sha256('sede|' || s_suppkey), 'Sede ' || s_suppkey, 'Cali', true from supplier""")
def anexar_guardada(t):
    """New rows take the table's defaults, are stored, and come back with the others."""
    carpeta = carpeta_de_trabajo(t.spark, "almacen")
    sedes = t.sedes.withColumn("id", F.col("id").cast("string"))
    v.agregar_filas(sedes, carpeta, "sedes")
    nuevas = t.origen("supplier").select(
        r.id_estable("sede", "s_suppkey").alias("id"),
        F.concat(F.lit("Sede "), F.col("s_suppkey").cast("string")).alias("nombre"), F.lit("Cali").alias("ciudad"))
    guardada = v.leer(t.spark, carpeta, "sedes", sedes.schema).drop("mes")
    v.reemplazar(anexar(guardada, nuevas, "sedes"), carpeta, "sedes")
    return v.leer(t.spark, carpeta, "sedes", sedes.schema).drop("mes")


# ---- Requests that come again, merges of batches, free slots kept up to date ----


def _por_lotes(t) -> str:
    """All requests in four batches, the third delivered again with the fourth; its folder."""
    carpeta = carpeta_de_trabajo(t.spark, "reservas")
    total = t.solicitudes.agg(F.max("recibida_en").alias("b"), F.min("recibida_en").alias("a"))
    a, b = total.select("a").scalar().cast("timestamp"), total.select("b").scalar().cast("timestamp")
    cuarto = F.least(F.floor(
        4 * (F.unix_micros(F.col("recibida_en").cast("timestamp")) - F.unix_micros(a)) / (F.unix_micros(b) - F.unix_micros(a) + 1)), F.lit(3))
    con_lote = t.solicitudes.withColumn("_lote", cuarto)
    for lote in range(4):
        parte = con_lote.filter(F.col("_lote").isin([lote, 2] if lote == 3 else [lote])).drop("_lote")
        procesar_lote(parte, lote, t.estado(), carpeta, juntar=2)
    return carpeta


@consulta("reservas_repetidas", DECIDIDAS + f"""
  select id, estado from (select cast(id as varchar) id, estado from citas)
  union all select sha256('cita|' || solicitud_id), 'pendiente' from ok""")
def reservas_repetidas(t):
    """Batches that repeat requests and are merged on the way book what one batch books."""
    return estado_en(t.spark, t.estado(), _por_lotes(t)).citas.select("id", "estado")


@consulta(
    "libres_al_dia",
    DECIDIDAS + """, todas as (
      select audiologo_id, fecha, ini, estado from citas
      union all select audiologo_id, fecha, ini, 'pendiente' from ok)"""
    + (EFECTIVO + SLOTS.format(corte=PROPIO, rangos="efectivo") + LIBRES).replace("from citas c", "from todas c"),
)
def libres_al_dia(t):
    """A stored table of free slots, changed only on the days a committed batch booked."""
    carpeta = carpeta_de_trabajo(t.spark, "libres")
    horarios = (t.horarios_disponibles, t.horarios_fecha)
    abrir_libres(d.disponibilidad_rango(t.audiologos, DESDE, HASTA, *horarios, t.citas, t.bloqueos), carpeta)
    res = r.reservar(t.solicitudes, t.estado())
    tocados = res.aceptadas.select("audiologo_id", "fecha")
    return actualizar_libres(t.spark, carpeta, tocados, *horarios, res.citas, t.bloqueos, DESDE, HASTA).drop("mes")
