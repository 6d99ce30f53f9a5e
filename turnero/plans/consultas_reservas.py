"""Registered queries: bookings, staff forms and changes of appointments."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from turnero.functions.tiempo import sumar_minutos
from turnero.operators import panel, reservas as r
from turnero.plans.registro import DESDE, consulta, hm
from turnero.sources.derivadas import solicitudes_de
from turnero.sources.tablas import carpeta_de_trabajo
from turnero.streaming.reservas_stream import decisiones, estado_en, reservas_stream

VALIDAS = """
, revisadas as (
  select s.*, case when nombre is null then 'falta_nombre' when telefono is null then 'falta_telefono'
    when fecha is null then 'falta_fecha' when ini is null then 'falta_hora'
    when audiologo_id is not null and audiologo_id not in (select id from audiologos) then 'audiologo_desconocido'
    when sede_id is not null and sede_id not in (select id from sedes) then 'sede_desconocida'
    end invalida
  from solicitudes s)"""

DECIDIDAS = VALIDAS + """
, turno as (
  select solicitud_id, row_number() over (
    partition by audiologo_id, fecha, ini order by recibida_en, solicitud_id) rn
  from revisadas where invalida is null),
decididas as (
  select v.*, coalesce(invalida, case when rn = 1 and not exists (
      select 1 from citas c where c.estado <> 'cancelada' and c.audiologo_id = v.audiologo_id
        and c.fecha = v.fecha and c.ini = v.ini) then null else 'horario_tomado' end) motivo_rechazo
  from revisadas v left join turno using (solicitud_id)),
ok as (select * from decididas where motivo_rechazo is null)"""

DURACION = """
, primera_fecha as (
  select audiologo_id, fecha, dur from (select *, row_number() over (
    partition by audiologo_id, fecha order by ini, fin, dur) rn from horarios_fecha) where rn = 1),
primera_semana as (
  select audiologo_id, dia_semana, dur from (select *, row_number() over (
    partition by audiologo_id, dia_semana order by ini, fin, dur) rn from horarios_disponibles)
  where rn = 1),
con_duracion as (
  select s.*, coalesce(f.dur, w.dur, 30) duracion
  from {base} s
  left join primera_fecha f on f.audiologo_id = s.audiologo_id and f.fecha = s.fecha
  left join primera_semana w on w.audiologo_id = s.audiologo_id
    and w.dia_semana = extract(dow from s.fecha))"""

PACIENTES = """
, canon as (select telefono, min(id) id from pacientes group by telefono),
novedades as (
  select o.telefono, coalesce(cast(any_value(c.id) as varchar), sha256('paciente|' || o.telefono)) paciente_id,
    any_value(c.id) id_previo, last(nombre order by recibida_en, solicitud_id) nombre,
    last(email order by recibida_en, solicitud_id) filter (where email is not null) email,
    last(eps order by recibida_en, solicitud_id) filter (where eps is not null) eps
  from ok o left join canon c on c.telefono = o.telefono group by o.telefono),
pacientes_despues as (
  select cast(p.id as varchar) id, coalesce(n.nombre, p.nombre) nombre, p.telefono,
    coalesce(n.email, p.email) email, coalesce(n.eps, p.eps) eps
  from pacientes p left join novedades n on n.id_previo = p.id
  union all
  select paciente_id, nombre, telefono, email, eps from novedades where id_previo is null)"""

CITAS_TXT = f"""select cast(id as varchar) id, cast(paciente_id as varchar) paciente_id, audiologo_id,
  sede_id, fecha, {hm('ini', 'hora_inicio')}, {hm('ini + dur', 'hora_fin')}, estado, motivo_consulta, notas
  from citas"""

NUEVAS = f"""select sha256('cita|' || solicitud_id), n.paciente_id, audiologo_id, sede_id, fecha,
  {hm('ini')}, {hm('ini + duracion')}, 'pendiente', motivo, null
  from con_duracion d join novedades n using (telefono)"""

CITA = [
    "id", "paciente_id", "audiologo_id", "sede_id", "fecha", "hora_inicio", "hora_fin",
    "estado", "motivo_consulta", "notas",
]


@consulta("validar_solicitudes", VALIDAS + "select solicitud_id, invalida motivo_rechazo from revisadas")
def validar_solicitudes(t):
    return r.validar_solicitudes(t.solicitudes, t.audiologos, t.sedes).select(
        "solicitud_id", "motivo_rechazo"
    )


@consulta(
    "lookup_paciente",
    """, canon as (select telefono, min(id) id from pacientes group by telefono)
    select solicitud_id, s.telefono, cast(c.id as varchar) paciente_id
    from solicitudes s left join canon c on c.telefono = s.telefono""",
)
def lookup_paciente(t):
    return r.lookup_paciente(t.pacientes, t.solicitudes).select(
        "solicitud_id", "telefono", "paciente_id"
    )


@consulta(
    "resolver_duracion",
    DURACION.format(base="solicitudes") + "select solicitud_id, duracion from con_duracion",
)
def resolver_duracion(t):
    return r.resolver_duracion(
        t.solicitudes, t.horarios_fecha, t.horarios_disponibles
    ).select("solicitud_id", "duracion")


@consulta("hora_fin", f"select id, {hm('ini + 1000', 'hora_fin')} from citas")
def hora_fin(t):
    return t.citas.select("id", sumar_minutos("hora_inicio", 1000).alias("hora_fin"))


@consulta(
    "reservar_lote",
    DECIDIDAS + DURACION.format(base="ok") + PACIENTES
    + f"""select d.solicitud_id, d.motivo_rechazo, n.paciente_id,
      case when d.motivo_rechazo is null then sha256('cita|' || d.solicitud_id) end cita_id,
      c.duracion, {hm('c.ini + c.duracion', 'hora_fin')}
      from decididas d left join con_duracion c using (solicitud_id)
      left join novedades n on n.telefono = c.telefono""",
)
def reservar_lote(t):
    res = r.reservar(t.solicitudes, t.estado())
    return (
        res.aceptadas.select("solicitud_id", "paciente_id", "cita_id", "duracion", "hora_fin")
        .unionByName(res.rechazadas.select("solicitud_id", "motivo_rechazo"), allowMissingColumns=True)
    )


@consulta(
    "reservar_citas",
    DECIDIDAS + DURACION.format(base="ok") + PACIENTES + f"{CITAS_TXT} union all {NUEVAS}",
)
def reservar_citas(t):
    return r.reservar(t.solicitudes, t.estado()).citas.select(*CITA)


@consulta("upsert_pacientes", DECIDIDAS + PACIENTES + "select * from pacientes_despues")
def upsert_pacientes(t):
    return r.reservar(t.solicitudes, t.estado()).pacientes


# ---- Changes of state ----

# The oracle goes through the changes one at a time: ``agenda`` is the table of appointments under way, by key,
# with a row for the turn and one for each decision.
LLENO = """exists (select 1 from recurring.agenda h where h.k <> {k} and h.estado <> 'cancelada'
  and h.audiologo_id = {s}.audiologo_id and h.fecha = {s}.fecha and h.ini = {s}.ini)"""

CAMBIOS = f"""
, cam as (select *, row_number() over (order by orden, id, estado) t from cambios),
agenda(k, id, audiologo_id, fecha, ini, estado, t) using key (k) as (
  select 'c' || id, id, audiologo_id, fecha, ini, estado, null::bigint from citas
  where id in (select id from cam) or (audiologo_id, fecha, ini) in (
    select (audiologo_id, fecha, ini) from citas where id in (select id from cam))
  union all select 'turno', null, null, null, null, null, 1
  union (
    with o as (select cam.* from recurring.agenda p join cam on cam.t = p.t where p.k = 'turno'),
    x as (
      select o.t, o.id, o.estado nuevo, a.audiologo_id, a.fecha, a.ini,
        case when o.estado = 'otro' then 'estado_invalido' when a.k is null then 'cita_desconocida'
          when a.estado = 'cancelada' and o.estado <> 'cancelada' and {LLENO.format(k="a.k", s="a")}
          then 'horario_tomado' end motivo
      from o left join recurring.agenda a on a.k = 'c' || o.id)
    select 'turno', null, null, null, null, null, t + 1 from o
    union all select 'd' || t, id, null, null, null, motivo, t from x
    union all select 'c' || id, id, audiologo_id, fecha, ini, nuevo, null from x where motivo is null)),
dichos as (select t, id, estado motivo from agenda where k[1] = 'd'),
cambiados as (
  select c.id, c.estado nuevo, coalesce(motivo, case when c.t < max(c.t) filter (motivo is null)
    over (partition by c.id) then 'reemplazado' end) motivo_rechazo
  from cam c join dichos d on d.t = c.t),
vigentes as (select c.id, coalesce(a.estado, c.estado) estado from citas c left join agenda a on a.k = 'c' || c.id)"""


@consulta(
    "cambiar_estado",
    CAMBIOS + "select id, estado from vigentes",
)
def cambiar_estado(t):
    return r.cambiar_estado(t.citas, t.cambios)[0].select("id", "estado")


@consulta(
    "cambiar_estado_rechazados",
    CAMBIOS + "select * from cambiados where motivo_rechazo is not null",
)
def cambiar_estado_rechazados(t):
    return r.cambiar_estado(t.citas, t.cambios)[1]


@consulta(
    "marcar_actualizado",
    CAMBIOS + f"""select c.id, case when b.id is null then c.creado_en
      else timestamp '{DESDE} 12:00:00' end actualizado_en
    from citas c left join cambiados b on b.id = c.id and b.motivo_rechazo is null""",
)
def marcar_actualizado(t):
    citas = t.citas.withColumn("actualizado_en", F.col("creado_en"))
    ahora = F.lit(f"{DESDE} 12:00:00").cast(citas.schema["actualizado_en"].dataType)
    return r.cambiar_estado(citas, t.cambios, ahora)[0].select("id", "actualizado_en")


@consulta(
    "acciones",
    """select id, estado, case estado when 'pendiente' then 'confirmar,editar,cancelar'
      when 'confirmada' then 'editar,cancelar' else '' end acciones from citas""",
)
def acciones(t):
    return r.con_acciones(t.citas).select(
        "id", "estado", F.array_join("acciones", ",").alias("acciones")
    )


# ---- Staff forms ----

PANEL = """
, completas as (
  select * from ediciones where nombre <> '' and telefono <> '' and sede_id is not null
    and audiologo_id is not null),
conocidos as (select telefono, count(*) n, min(id) id from pacientes group by telefono),
con_paciente as (
  select f.*, n, case when n is null then sha256('paciente|' || f.telefono)
    when n = 1 then cast(k.id as varchar)
    else sha256('paciente-panel|' || solicitud_id) end paciente_id
  from completas f left join conocidos k on k.telefono = f.telefono),
formas as (select *, row_number() over (order by recibida_en, solicitud_id) t from con_paciente),
agenda(k, audiologo_id, fecha, ini, estado, t) using key (k) as (
  select 'c' || id, audiologo_id, fecha, ini, estado, null::bigint from citas
  where id in (select cita_id from formas) or (audiologo_id, fecha, ini) in (
    select (audiologo_id, fecha, ini) from formas)
  union all select 'turno', null, null, null, null, 1
  union (
    with o as (select f.* from recurring.agenda p join formas f on f.t = p.t where p.k = 'turno'),
    x as (
      select o.*, coalesce('c' || cita_id, 'n' || solicitud_id) clave, coalesce(a.estado, 'pendiente') estado,
        case when cita_id is not null and a.k is null then 'cita_desconocida'
          when (a.k is null or a.estado <> 'cancelada'
              and not (a.audiologo_id = o.audiologo_id and a.fecha = o.fecha and a.ini = o.ini))
            and """ + LLENO.format(k="coalesce('c' || cita_id, 'n' || solicitud_id)", s="o") + """
          then 'horario_tomado' end rechazo
      from o left join recurring.agenda a on a.k = 'c' || o.cita_id)
    select 'turno', null, null, null, null, t + 1 from o
    union all select 'd' || t, null, null, null, rechazo, t from x
    union all select clave, audiologo_id, fecha, ini, estado, t from x where rechazo is null)),
dichos as (
  select f.solicitud_id, coalesce(d.estado, case when cita_id is not null
    and f.t < max(f.t) filter (d.estado is null) over (partition by cita_id) then 'reemplazado' end) motivo_rechazo
  from formas f join agenda d on d.k = 'd' || f.t),
editadas as (
  select cast(c.id as varchar) id, coalesce(e.paciente_id, cast(c.paciente_id as varchar)) paciente_id,
    coalesce(e.audiologo_id, c.audiologo_id) audiologo_id,
    case when e.cita_id is null then c.sede_id else e.sede_id end sede_id,
    coalesce(e.fecha, c.fecha) fecha, coalesce(e.ini, c.ini) ini,
    case when e.cita_id is null then c.ini + c.dur else e.ini + 30 end fin, c.estado,
    case when e.cita_id is null then motivo_consulta else nullif(e.motivo, '') end motivo_consulta,
    case when e.cita_id is null then c.notas else nullif(e.notas, '') end notas
  from citas c left join agenda a on a.k = 'c' || c.id left join formas e on e.t = a.t),
altas_ok as (select f.* from formas f join agenda a on a.k = 'n' || f.solicitud_id)"""

CAMPOS = f"""id, paciente_id, audiologo_id, sede_id, fecha, {hm('ini', 'hora_inicio')},
  {hm('fin', 'hora_fin')}, estado, motivo_consulta, notas"""


@consulta(
    "guardar_cita_panel",
    PANEL + f"""select {CAMPOS} from editadas union all
    select sha256('cita|' || solicitud_id), paciente_id, audiologo_id, sede_id, fecha, {hm('ini')},
      {hm('ini + 30')}, 'pendiente', nullif(motivo, ''), nullif(notas, '') from altas_ok""",
)
def guardar_cita_panel(t):
    return panel.guardar_panel(t.ediciones, t.estado()).citas.select(*CITA)


@consulta(
    "guardar_panel_rechazadas",
    PANEL + """select solicitud_id, 'formulario_incompleto' motivo_rechazo from ediciones
      where solicitud_id not in (select solicitud_id from completas)
    union all select * from dichos where motivo_rechazo is not null""",
)
def guardar_panel_rechazadas(t):
    return panel.guardar_panel(t.ediciones, t.estado()).rechazadas


@consulta(
    "guardar_panel_pacientes",
    PANEL + """select cast(id as varchar) id, nombre, telefono, email, eps from pacientes union all
    select paciente_id, first(nombre order by recibida_en, solicitud_id), telefono, null, null
    from con_paciente where n is null or n > 1 group by paciente_id, telefono""",
)
def guardar_panel_pacientes(t):
    return panel.guardar_panel(t.ediciones, t.estado()).pacientes


@consulta(
    "editar_cita",
    PANEL.replace("from con_paciente),\nagenda", "from con_paciente where cita_id is not null),\nagenda")
    + f"select {CAMPOS} from editadas",
)
def editar_cita(t):
    completas, _ = panel.separar_validas(t.ediciones)
    con_paciente, _ = panel.pacientes_del_panel(t.pacientes, completas)
    cambios = con_paciente.filter(F.col("cita_id").isNotNull()).select(
        F.col("cita_id").cast("string").alias("id"),
        F.struct("recibida_en", "solicitud_id").alias("orden"), "paciente_id", "audiologo_id",
        "sede_id", "fecha", "hora_inicio", F.col("motivo").alias("motivo_consulta"), "notas",
    )
    return panel.editar(r.ids_texto(t.citas), cambios)[0].select(*CITA)


@consulta(
    "form_valida",
    """select solicitud_id, coalesce(nombre <> '' and telefono <> '' and sede_id is not null
      and audiologo_id is not null, false) valida from ediciones""",
)
def form_valida(t):
    return t.ediciones.select("solicitud_id", panel.form_valida().alias("valida"))


# ---- Stream ----


def _por_flujo(t) -> tuple[str, DataFrame]:
    """Takes all requests in as a stream; its folder and the streaming source."""
    eventos = t.origen("events")
    llegan = (
        t.spark.readStream.schema(eventos.schema)
        .option("pathGlobFilter", "events*.parquet").parquet(t.carpeta)
    )
    profesionales = F.lit(t.origen("supplier").count())
    carpeta = carpeta_de_trabajo(t.spark, "reservas")
    fuente = t.con_sede(solicitudes_de(llegan, profesionales), "left")
    reservas_stream(fuente, t.estado(), carpeta, f"{carpeta}/checkpoint").awaitTermination()
    return carpeta, fuente


@consulta("reservas_stream", DECIDIDAS + "select solicitud_id, motivo_rechazo from decididas")
def consulta_stream(t) -> DataFrame:
    carpeta, fuente = _por_flujo(t)
    return decisiones(t.spark, carpeta, fuente.schema).select("solicitud_id", "motivo_rechazo")


@consulta(
    "reservas_stream_citas",
    DECIDIDAS + DURACION.format(base="ok") + PACIENTES + f"{CITAS_TXT} union all {NUEVAS}",
)
def consulta_stream_citas(t) -> DataFrame:
    carpeta, _ = _por_flujo(t)
    return estado_en(t.spark, t.estado(), carpeta).citas.select(*CITA)


@consulta("reservas_stream_pacientes", DECIDIDAS + PACIENTES + "select * from pacientes_despues")
def consulta_stream_pacientes(t) -> DataFrame:
    carpeta, _ = _por_flujo(t)
    return estado_en(t.spark, t.estado(), carpeta).pacientes
