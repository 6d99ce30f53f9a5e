"""Registered queries: reports, counts, calendars, verification lists and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnero.functions import texto, tiempo
from turnero.functions.valores import DIAS, ETIQUETAS_ESTADO, MESES
from turnero.plans import informes as i
from turnero.plans.registro import HORAS, HOY, consulta, hm

MOTIVO = "motivo 1"
NOMBRES = ["Supplier#000000001", "Supplier#000000003", "Supplier#000000006"]
NOMBRES_SQL = ", ".join(f"'{n}'" for n in NOMBRES)


def _lista(valores, indice: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in valores) + f"][{indice}]"


def fecha_larga(f: str) -> str:
    return (
        f"lower({_lista(DIAS, f'extract(dow from {f}) + 1')}) || ', ' || day({f}) || ' de ' || "
        f"lower({_lista(MESES, f'month({f})')})"
    )


def hora_corta(m: str) -> str:
    return (
        f"(case when ({m}) // 60 % 12 = 0 then 12 else ({m}) // 60 % 12 end) || ':' || "
        f"printf('%02d', ({m}) % 60) || case when ({m}) // 60 >= 12 then ' pm' else ' am' end"
    )


ETIQUETA = "case estado " + " ".join(
    f"when '{e}' then '{v}'" for e, v in ETIQUETAS_ESTADO.items()
) + " end"
ACCIONES = """case estado when 'pendiente' then 'confirmar,editar,cancelar'
  when 'confirmada' then 'editar,cancelar' else '' end"""


@consulta(
    "citas_detalle",
    f"""select c.id, c.fecha, {hm('c.ini', 'hora_inicio')}, {hm('c.ini + c.dur', 'hora_fin')}, c.estado,
      c.motivo_consulta, c.notas, p.nombre paciente_nombre, p.telefono paciente_telefono,
      p.email paciente_email, p.eps paciente_eps, a.nombre audiologo, s.nombre sede, s.ciudad, c.creado_en
    from citas c join pacientes p on p.id = c.paciente_id join audiologos a on a.id = c.audiologo_id
    join sedes s on s.id = c.sede_id""",
)
def citas_detalle(t):
    return i.citas_detalle(t.citas, t.pacientes, t.audiologos, t.sedes)


# Appointments that point to a patient or site that does not exist show the left joins.
ROTAS = """, rotas as (
  select * replace (case when id % 10 = 0 then paciente_id + 1000000000 else paciente_id end as paciente_id,
    case when id % 11 = 0 then null else sede_id end as sede_id) from citas)"""


def _rotas(t):
    k = F.col("id")
    return t.citas.withColumn(
        "paciente_id", F.when(k % 10 == 0, F.col("paciente_id") + 1000000000).otherwise(F.col("paciente_id"))
    ).withColumn("sede_id", F.when(k % 11 != 0, F.col("sede_id")))


@consulta(
    "citas_embebidas",
    ROTAS + """select c.id, c.fecha, p.id is not null tiene_paciente, p.nombre paciente_nombre,
      p.telefono paciente_telefono, a.nombre audiologo_nombre, a.sede_id audiologo_sede_id, s.nombre sede_nombre
    from rotas c left join pacientes p on p.id = c.paciente_id
    left join audiologos a on a.id = c.audiologo_id left join sedes s on s.id = c.sede_id""",
)
def citas_embebidas(t):
    return i.citas_con_embebidos(_rotas(t), t.pacientes, t.audiologos, t.sedes).select(
        "id", "fecha", F.col("pacientes").isNotNull().alias("tiene_paciente"),
        F.col("pacientes.nombre").alias("paciente_nombre"),
        F.col("pacientes.telefono").alias("paciente_telefono"),
        F.col("audiologos.nombre").alias("audiologo_nombre"),
        F.col("audiologos.sede_id").alias("audiologo_sede_id"),
        F.col("sedes.nombre").alias("sede_nombre"),
    )


@consulta(
    "agenda_filter",
    f"""select id, fecha, {hm('ini', 'hora_inicio')}, estado, sede_id from citas
    where fecha between date '{HOY}' and date '{HOY}' + 7 and estado = 'confirmada' and sede_id = 3""",
)
def agenda_filter(t):
    return i.filtrar_citas(t.citas, HOY, "2024-01-22", sede=3, estado="confirmada").select(
        "id", "fecha", "hora_inicio", "estado", "sede_id"
    )


@consulta(
    "rango_por_defecto",
    f"select id, fecha from citas where fecha between date '{HOY}' and date '{HOY}' + 7",
)
def rango_por_defecto(t):
    return t.citas.filter(F.col("fecha").between(*i.rango_por_defecto(HOY))).select("id", "fecha")


@consulta(
    "agenda",
    f"""select c.fecha, {fecha_larga('c.fecha')} etiqueta_dia, {hm('c.ini', 'hora_inicio')},
      {hora_corta('c.ini')} hora, c.id, coalesce(p.nombre, 'Paciente') paciente, p.telefono,
      a.nombre || ' · ' || s.nombre || coalesce(' · ' || c.motivo_consulta, '') detalle,
      {ETIQUETA} etiqueta_estado, {ACCIONES} acciones
    from citas c left join pacientes p on p.id = c.paciente_id
    left join audiologos a on a.id = c.audiologo_id left join sedes s on s.id = c.sede_id
    where c.fecha between date '2024-01-01' and date '2024-01-30'""",
)
def agenda(t):
    return i.agenda(
        t.citas, t.pacientes, t.audiologos, t.sedes, "2024-01-01", "2024-01-30"
    ).withColumn("acciones", F.array_join("acciones", ","))


@consulta(
    "agenda_por_dia",
    f"select fecha, {hm('ini', 'hora_inicio')}, id, {fecha_larga('fecha')} etiqueta_dia from citas",
)
def agenda_por_dia(t):
    return i.agenda_por_dia(t.citas)


TOTALES = """select (select count(*) from sedes) total_sedes,
  (select count(*) from audiologos) total_audiologos"""


@consulta("totales", TOTALES)
@consulta("scalar_subquery", TOTALES)
def totales(t):
    return i.totales(t.sedes, t.audiologos)


POR_SEDE = """select s.nombre sede, s.ciudad, count(a.id) num_audiologos
  from sedes s left join audiologos a on a.sede_id = s.id group by s.nombre, s.ciudad"""


@consulta("audiologos_por_sede_conteo", POR_SEDE)
@consulta("left_join_conteo", POR_SEDE)
def audiologos_por_sede_conteo(t):
    return i.audiologos_por_sede_conteo(t.sedes, t.audiologos)


HOY_POR_SEDE = f"""select sede_id, count(*) n from citas
  where fecha = date '{HOY}' and estado <> 'cancelada' group by sede_id"""


@consulta("conteo_hoy_por_sede", HOY_POR_SEDE)
def conteo_hoy_por_sede(t):
    return i.conteo_por_sede(t.citas, HOY)


@consulta(
    "badges_sede",
    f"""select s.id, s.nombre, n from sedes s left join ({HOY_POR_SEDE}) c on c.sede_id = s.id
    where s.activa""",
)
def badges_sede(t):
    return i.badges_sede(t.sedes, t.citas, HOY)


@consulta("conteo_horarios", "select count(*) total_horarios from horarios_disponibles")
def conteo_horarios(t):
    return i.conteo_horarios(t.horarios_disponibles)


@consulta(
    "conteo_bloqueos_motivo",
    f"""select count(*) total_bloqueos from bloqueos
    where motivo = '{MOTIVO}' and fecha between date '2024-01-05' and date '2024-01-25'""",
)
def conteo_bloqueos_motivo(t):
    return i.conteo_bloqueos_motivo(t.bloqueos, MOTIVO, "2024-01-05", "2024-01-25")


@consulta(
    "bloqueos_restantes", f"select count(*) bloqueos_restantes from bloqueos where motivo = '{MOTIVO}'"
)
def bloqueos_restantes(t):
    return i.bloqueos_restantes(t.bloqueos, MOTIVO)


@consulta(
    "dias_bloqueados",
    f"""select s.nombre sede, a.nombre audiologo, count(b.id) dias_bloqueados
    from bloqueos b join audiologos a on a.id = b.audiologo_id join sedes s on s.id = a.sede_id
    where b.motivo = '{MOTIVO}' group by s.nombre, a.nombre""",
)
def dias_bloqueados(t):
    return i.dias_bloqueados(t.bloqueos, t.audiologos, t.sedes, MOTIVO)


# ---- Weekly schedule and calendar ----

SEMANA = """, casillas as (
  select a.id audiologo_id, cast(d as int) dia_semana from audiologos a cross join range(0, 7) r(d)),
semana as (
  select k.audiologo_id, k.dia_semana, substr({ini}, 1, 5) hora_inicio,
    substr({fin}, 1, 5) hora_fin, h.dur duracion_cita_min, (k.dia_semana + 6) % 7 orden_dia
  from casillas k left join horarios_disponibles h using (audiologo_id, dia_semana))""".format(
    ini=hm("h.ini"), fin=hm("h.fin")
)


@consulta("semana_por_audiologo", SEMANA + "select * from semana")
def semana_por_audiologo(t):
    return i.semana_por_audiologo(t.audiologos, t.horarios_disponibles)


@consulta(
    "semana",
    SEMANA + f"""select *, {_lista(DIAS, 'dia_semana + 1')} dia, hora_inicio is null sin_horario
    from semana""",
)
def semana(t):
    return i.semana(t.audiologos, t.horarios_disponibles)


@consulta(
    "fechas_con_excepcion",
    """select distinct audiologo_id, fecha from horarios_fecha
    where fecha between date '2024-01-01' and date '2024-01-31'""",
)
def fechas_con_excepcion(t):
    return i.fechas_con_excepcion(t.horarios_fecha, 2024, 1)


@consulta(
    "calendario_mes",
    f"""select a.id audiologo_id, cast(k as int) celda, cast(k // 7 as int) fila, cast(k % 7 as int) columna,
      cast(day(fecha) as int) dia, fecha, exists (select 1 from horarios_fecha h
        where h.audiologo_id = a.id and h.fecha = c.fecha) tiene_excepcion,
      coalesce(fecha = date '{HOY}', false) es_hoy
    from audiologos a cross join (
      select k, case when k >= 1 then date '2024-01-01' + cast(k - 1 as int) end fecha
      from range(0, 32) r(k)) c""",
)
def calendario_mes(t):
    return i.calendario(t.audiologos, t.horarios_fecha, 2024, 1, HOY)


@consulta(
    "bloques_del_dia",
    f"""select audiologo_id, fecha, substr({hm('ini')}, 1, 5) hora_inicio, substr({hm('fin')}, 1, 5) hora_fin,
      dur duracion_cita_min from horarios_fecha f
    where exists (select 1 from bloqueos b where b.audiologo_id = f.audiologo_id and b.fecha = f.fecha)""",
)
def bloques_del_dia(t):
    return i.bloques_del_dia(t.horarios_fecha, t.bloqueos)


# ---- Verification lists ----

DE_AUDIOLOGO = "join audiologos a on a.id = x.audiologo_id"
DE_SEDE = DE_AUDIOLOGO + " join sedes s on s.id = a.sede_id"
HORARIOS_SEDE = f"""select s.nombre sede, a.nombre audiologo, dia_semana, {HORAS}
  from horarios_disponibles x {DE_SEDE}"""


@consulta(
    "ver_horarios",
    f"select a.nombre audiologo, dia_semana, {HORAS} from horarios_disponibles x {DE_AUDIOLOGO}",
)
def ver_horarios(t):
    return i.ver_horarios(t.horarios_disponibles, t.audiologos)


@consulta("ver_horarios_sede", HORARIOS_SEDE)
@consulta("join_verificacion", HORARIOS_SEDE)
def ver_horarios_sede(t):
    return i.ver_horarios_sede(t.horarios_disponibles, t.audiologos, t.sedes)


@consulta(
    "ver_horarios_nombres",
    f"""select a.nombre audiologo, dia_semana, {HORAS} from horarios_disponibles x {DE_AUDIOLOGO}
    where a.nombre in ({NOMBRES_SQL})""",
)
def ver_horarios_nombres(t):
    return i.ver_horarios_nombres(t.horarios_disponibles, t.audiologos, NOMBRES)


@consulta(
    "ver_roster", f"select a.nombre audiologo, fecha, {HORAS} from horarios_fecha x {DE_AUDIOLOGO}"
)
def ver_roster(t):
    return i.ver_roster(t.horarios_fecha, t.audiologos)


@consulta(
    "ver_bloqueos_motivo",
    f"""select a.nombre audiologo, fecha, {HORAS}, motivo from bloqueos x {DE_AUDIOLOGO}
    where motivo = '{MOTIVO}'""",
)
def ver_bloqueos_motivo(t):
    return i.ver_bloqueos_motivo(t.bloqueos, t.audiologos, MOTIVO)


@consulta(
    "ver_bloqueos_sede",
    f"select s.nombre sede, a.nombre audiologo, fecha, motivo from bloqueos x {DE_SEDE}",
)
def ver_bloqueos_sede(t):
    return i.ver_bloqueos_sede(t.bloqueos, t.audiologos, t.sedes)


ILIKE = """select nombre, ciudad, activa from sedes
  where nombre ilike '%nation_1%' or nombre ilike '%TION_4'"""


@consulta("ver_sedes_ilike", ILIKE)
@consulta("filter_ilike", ILIKE)
def ver_sedes_ilike(t):
    return i.ver_sedes_ilike(t.sedes, ["%nation_1%", "%TION_4"])


# ---- Labels ----


@consulta("fmt_hora", f"select id, {hora_corta('(ini * 7) % 1440')} hora from citas")
def fmt_hora(t):
    disperso = tiempo.hms(tiempo.seg("hora_inicio") * 7)
    return t.citas.select("id", tiempo.fmt_hora(disperso).alias("hora"))


@consulta("fmt_fecha_grupo", f"select id, {fecha_larga('fecha')} etiqueta from citas")
def fmt_fecha_grupo(t):
    return t.citas.select("id", tiempo.fmt_fecha_grupo("fecha").alias("etiqueta"))


@consulta("etiqueta_estado", f"select id, {ETIQUETA} etiqueta from citas")
def etiqueta_estado(t):
    return t.citas.select("id", texto.etiqueta_estado("estado").alias("etiqueta"))


@consulta(
    "detalle_cita",
    """select c.id, a.nombre || ' · ' || s.nombre
      || coalesce(' · ' || nullif(case when c.id % 3 = 0 then '' else motivo_consulta end, ''), '') detalle
    from citas c join audiologos a on a.id = c.audiologo_id join sedes s on s.id = c.sede_id""",
)
def detalle_cita(t):
    detalle = i.citas_detalle(t.citas, t.pacientes, t.audiologos, t.sedes)
    motivo = F.when(F.col("id") % 3 == 0, "").otherwise(F.col("motivo_consulta"))
    return detalle.select("id", texto.detalle_cita("audiologo", "sede", motivo).alias("detalle"))


@consulta(
    "etiquetas_fecha",
    f"""select id, {_lista(MESES, 'month(creado_en)')} mes,
      {_lista(DIAS, 'extract(dow from creado_en) + 1')} dia,
      cast(extract(dow from creado_en) as int) dow, last_day(cast(creado_en as date)) ultimo_dia,
      cast(date_trunc('month', creado_en) + interval 13 month as date) mes_siguiente,
      make_date(year(creado_en), month(creado_en), 1) primer_dia
    from citas""",
)
def etiquetas_fecha(t):
    f = F.to_date("creado_en")
    return t.citas.select(
        "id", tiempo.nombre_mes(F.month(f)).alias("mes"),
        tiempo.nombre_dia(tiempo.dow(f)).alias("dia"), tiempo.dow(f).alias("dow"),
        tiempo.ultimo_dia(f).alias("ultimo_dia"),
        tiempo.sumar_meses(F.trunc(f, "month"), 13).alias("mes_siguiente"),
        tiempo.fecha_de(F.year(f), F.month(f) - 1, F.lit(1)).alias("primer_dia"),
    )


@consulta(
    "horas_texto",
    f"""select id, substr({hm('ini')}, 1, 5) hhmm, {hm('ini', 'hhmmss')}, cast(dur as double) minutos,
      nullif(case when id % 2 = 0 then '' else 'x' end, '') texto from citas""",
)
def horas_texto(t):
    corta = tiempo.hhmm("hora_inicio")
    return t.citas.select(
        "id", corta.alias("hhmm"), tiempo.hhmmss(corta).alias("hhmmss"),
        tiempo.minutos_entre("hora_inicio", "hora_fin").alias("minutos"),
        texto.vacio_a_nulo(F.when(F.col("id") % 2 == 0, "").otherwise("x")).alias("texto"),
    )
