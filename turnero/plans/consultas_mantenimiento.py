"""Registered queries: catalogue reads and bulk changes of schedules, blocks and catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnero.functions.texto import activa
from turnero.operators import catalogo as c, horarios as h
from turnero.plans.registro import HORAS, consulta, hm
from turnero.sources.tablas import entre_fechas

SEMANA = f"audiologo_id, dia_semana, {HORAS}, dur duracion_cita_min"
FECHA = f"audiologo_id, fecha, {HORAS}, dur duracion_cita_min"
BLOQUEO = f"audiologo_id, fecha, {HORAS}, motivo"

# A week with a lunch break: Monday to Thursday until 18:15, Friday until 17:15.
ESTANDAR = [
    *h.lunes_a(4, "08:15", "12:15"), *h.lunes_a(4, "13:15", "18:15"),
    (5, "08:15", "12:15"), (5, "13:15", "17:15"),
]
ESTANDAR_SQL = """, estandar as (
  select cast(d as int) dia_semana, ini, fin, 30 dur
  from range(1, 6) r(d) cross join (values (495, 735), (795, 1095)) b(ini, tope)
  cross join lateral (select case when d = 5 and tope = 1095 then 1035 else tope end fin) f)"""

SEDES_NOMBRADAS = ["NATION_3", "NATION_8", "NATION_15"]
EN_SEDES = """(select a.id from audiologos a join sedes s on s.id = a.sede_id
  where s.nombre in ('NATION_3', 'NATION_8', 'NATION_15'))"""
FUERA_SEDES = EN_SEDES.replace("nombre in", "nombre not in")

NOMBRES = ["Supplier#000000002", "Supplier#000000005", "Supplier#000000007", "Nadie"]
CON_NOMBRE = """(select id from audiologos where nombre in
  ('Supplier#000000002', 'Supplier#000000005', 'Supplier#000000007', 'Nadie'))"""


@consulta("catalog_sedes", "select * from sedes where activa")
def catalog_sedes(t):
    return c.sedes_activas(t.sedes)


@consulta("catalog_audiologos", "select * from audiologos where activo")
def catalog_audiologos(t):
    return c.audiologos_activos(t.audiologos)


@consulta("audiologos_por_sede", "select * from audiologos where sede_id = 3")
def audiologos_por_sede(t):
    return c.audiologos_de_sede(t.audiologos, 3)


@consulta("filter_estado_ne", "select id, estado from citas where estado <> 'cancelada'")
def filter_estado_ne(t):
    return t.citas.filter(activa()).select("id", "estado")


@consulta("filter_in", f"select id, nombre from audiologos where id in {EN_SEDES}")
def filter_in(t):
    return c.audiologos_en(t.audiologos, t.sedes, SEDES_NOMBRADAS).select("id", "nombre")


@consulta("filter_not_in", f"select id, nombre from audiologos where id in {FUERA_SEDES}")
def filter_not_in(t):
    return c.audiologos_fuera_de(t.audiologos, t.sedes, SEDES_NOMBRADAS).select("id", "nombre")


@consulta(
    "filter_between",
    f"select id, {BLOQUEO} from bloqueos where fecha between date '2024-01-08' and date '2024-01-20'",
)
def filter_between(t):
    return entre_fechas(t.bloqueos, "2024-01-08", "2024-01-20")


@consulta(
    "join_padre",
    """select a.id, a.nombre, a.sede_id, a.activo, s.nombre sede, s.ciudad
    from audiologos a join sedes s on s.id = a.sede_id""",
)
def join_padre(t):
    return c.con_nombre_de_sede(t.audiologos, t.sedes)


@consulta(
    "join_values_por_nombre",
    f"""select nombre, fecha, {HORAS}, a.id audiologo_id
    from roster join audiologos a using (nombre)""",
)
def join_values_por_nombre(t):
    return c.por_nombre(t.roster, t.audiologos)[0]


@consulta(
    "nombres_sin_cruce",
    f"select nombre, fecha, {HORAS} from roster where nombre not in (select nombre from audiologos)",
)
def nombres_sin_cruce(t):
    return c.por_nombre(t.roster, t.audiologos)[1]


@consulta("semi_in_subquery", f"select {SEMANA} from horarios_disponibles where audiologo_id in {EN_SEDES}")
def semi_in_subquery(t):
    quienes = c.audiologos_en(t.audiologos, t.sedes, SEDES_NOMBRADAS)
    return t.horarios_disponibles.join(
        quienes.select(F.col("id").alias("audiologo_id")), "audiologo_id", "left_semi"
    )


# ---- Schedules ----


@consulta(
    "cross_series",
    ESTANDAR_SQL + f"select a.id audiologo_id, dia_semana, {HORAS}, dur duracion_cita_min"
    " from audiologos a cross join estandar",
)
def cross_series(t):
    return h.expandir_plantilla(t.audiologos, ESTANDAR)


@consulta(
    "expandir_plantilla",
    ESTANDAR_SQL + f"""select a.id audiologo_id, dia_semana, {HORAS}, dur duracion_cita_min
    from audiologos a cross join estandar where a.id in {FUERA_SEDES}""",
)
def expandir_plantilla(t):
    quienes = c.audiologos_fuera_de(t.audiologos, t.sedes, SEDES_NOMBRADAS)
    return h.expandir_plantilla(quienes, ESTANDAR)


BLOQUES = """, editados as (
  select audiologo_id, dia_semana, ini, case when (audiologo_id + dia_semana) % 9 = 0 then null else fin end fin,
    case audiologo_id % 5 when 0 then '0' when 1 then null when 2 then 'abc' when 3 then '' else '45' end dur_txt
  from horarios_disponibles),
limpios as (
  select audiologo_id, dia_semana, ini, fin, case when dur_txt = '45' then 45 else 30 end dur
  from editados where fin is not null)"""


def _editados(t):
    """Weekly blocks as typed in a form: some without end, slot lengths as text."""
    k = F.col("audiologo_id")
    texto = F.when(k % 5 == 0, "0").when(k % 5 == 2, "abc").when(k % 5 == 3, "").when(k % 5 == 4, "45")
    return (
        t.horarios_disponibles.withColumn("duracion_cita_min", texto)
        .withColumn("hora_fin", F.when((k + F.col("dia_semana")) % 9 == 0, "").otherwise(F.col("hora_fin")))
    )


@consulta("bloques_validos", BLOQUES + f"select {SEMANA} from limpios")
def bloques_validos(t):
    return h.limpiar_bloques(_editados(t))


@consulta(
    "reemplazar_horario",
    BLOQUES + f"""select {SEMANA} from horarios_disponibles where audiologo_id not in {EN_SEDES}
    union all select {SEMANA} from limpios where audiologo_id in {EN_SEDES} and dia_semana <> 2""",
)
def reemplazar_horario(t):
    claves = c.audiologos_en(t.audiologos, t.sedes, SEDES_NOMBRADAS).select(
        F.col("id").alias("audiologo_id")
    )
    nuevos = _editados(t).filter("dia_semana <> 2").join(claves, "audiologo_id", "left_semi")
    return h.reemplazar_horario(t.horarios_disponibles, claves, nuevos)


# Days whose exception is rewritten: every (professional, date) of the roster.
DIAS_ROSTER = """, dias_roster as (
  select distinct a.id audiologo_id, fecha from roster join audiologos a using (nombre))"""
SIN_DIAS_ROSTER = f"""select {FECHA} from horarios_fecha f where not exists (
  select 1 from dias_roster r where r.audiologo_id = f.audiologo_id and r.fecha = f.fecha)"""


def _dias_roster(t):
    return c.por_nombre(t.roster, t.audiologos)[0]


@consulta(
    "reemplazar_dia",
    DIAS_ROSTER + SIN_DIAS_ROSTER + f"""
    union all select audiologo_id, fecha, {HORAS}, 30 from (
      select a.id audiologo_id, fecha, ini, fin from roster join audiologos a using (nombre)
      where ini = 450)""",
)
def reemplazar_dia(t):
    claves = _dias_roster(t)
    nuevos = claves.filter(F.col("hora_inicio") == "07:30:00").withColumn(
        "duracion_cita_min", F.lit("")
    )
    return h.reemplazar_dia(t.horarios_fecha, claves, nuevos)


@consulta("quitar_excepcion", DIAS_ROSTER + SIN_DIAS_ROSTER)
def quitar_excepcion(t):
    return h.quitar_excepcion(t.horarios_fecha, _dias_roster(t))


@consulta(
    "copiar_dias",
    f"""select {SEMANA} from horarios_disponibles
      where not (audiologo_id in (select id from audiologos where activo) and dia_semana between 2 and 5)
    union all select audiologo_id, cast(d as int), {hm('ini')}, {hm('fin')}, dur
      from horarios_disponibles cross join range(2, 6) r(d)
      where dia_semana = 1 and audiologo_id in (select id from audiologos where activo)""",
)
def copiar_dias(t):
    claves = c.audiologos_activos(t.audiologos).select(F.col("id").alias("audiologo_id"))
    return h.copiar_dias(t.horarios_disponibles, 1, range(1, 6), claves)


@consulta(
    "aplicar_plantilla",
    ESTANDAR_SQL + f"""select {SEMANA} from horarios_disponibles where audiologo_id not in {FUERA_SEDES}
    union all select a.id, dia_semana, {HORAS}, dur from audiologos a cross join estandar
      where a.id in {FUERA_SEDES}""",
)
def aplicar_plantilla(t):
    quienes = c.audiologos_fuera_de(t.audiologos, t.sedes, SEDES_NOMBRADAS)
    return h.aplicar_plantilla(t.horarios_disponibles, quienes, ESTANDAR)


@consulta(
    "restablecer_horario",
    ESTANDAR_SQL + f"""select {SEMANA} from horarios_disponibles where audiologo_id not in {CON_NOMBRE}
    union all select a.id, dia_semana, {HORAS}, dur from audiologos a cross join estandar
      where a.id in {CON_NOMBRE}""",
)
def restablecer_horario(t):
    return h.restablecer_horario(
        t.horarios_disponibles, t.horarios_fecha, t.audiologos, NOMBRES, ESTANDAR
    )[0]


@consulta(
    "restablecer_horario_fechas",
    f"select {FECHA} from horarios_fecha where audiologo_id not in {CON_NOMBRE}",
)
def restablecer_horario_fechas(t):
    return h.restablecer_horario(
        t.horarios_disponibles, t.horarios_fecha, t.audiologos, NOMBRES, ESTANDAR
    )[1]


@consulta(
    "cargar_roster",
    f"""select {FECHA} from horarios_fecha union all
    select a.id, fecha, {HORAS}, 30 from roster join audiologos a using (nombre)""",
)
def cargar_roster(t):
    return h.cargar_roster(t.horarios_fecha, t.horarios_disponibles, t.audiologos, t.roster)[0]


@consulta(
    "cargar_roster_semanal",
    f"""select {SEMANA} from horarios_disponibles where audiologo_id not in (
      select a.id from audiologos a where a.nombre in (select nombre from roster))""",
)
def cargar_roster_semanal(t):
    return h.cargar_roster(t.horarios_fecha, t.horarios_disponibles, t.audiologos, t.roster)[1]


# ---- Blocks ----

CIERRE = f"""select a.id, cast(d as date), null, null, 'cierre' from audiologos a
  cross join generate_series(date '2024-01-10', date '2024-01-20', interval 1 day) g(d)
  where a.id in {EN_SEDES}"""


def _bloqueos(df):
    return df.select("audiologo_id", "fecha", "hora_inicio", "hora_fin", "motivo")


@consulta("cerrar_sedes", f"select {BLOQUEO} from bloqueos union all {CIERRE}")
def cerrar_sedes(t):
    return _bloqueos(c.cerrar_sedes(
        t.bloqueos, t.audiologos, t.sedes, SEDES_NOMBRADAS, "2024-01-10", "2024-01-20", "cierre",
    ))


@consulta(
    "cerrar_sedes_limpiando",
    f"""select {BLOQUEO} from bloqueos where not (audiologo_id in {EN_SEDES}
      and fecha between date '2024-01-10' and date '2024-01-20') union all {CIERRE}""",
)
def cerrar_sedes_limpiando(t):
    return _bloqueos(c.cerrar_sedes(
        t.bloqueos, t.audiologos, t.sedes, SEDES_NOMBRADAS, "2024-01-10", "2024-01-20", "cierre",
        limpiar=True,
    ))


@consulta(
    "bloquear_espacios",
    f"""select {BLOQUEO} from bloqueos union all
    select a.id, fecha, {HORAS}, 'espacio' from roster join audiologos a using (nombre)""",
)
def bloquear_espacios(t):
    return _bloqueos(c.bloquear_espacios(t.bloqueos, t.audiologos, t.roster, "espacio")[0])


@consulta("borrar_bloqueos", f"select {BLOQUEO} from bloqueos where motivo <> 'motivo 1'")
def borrar_bloqueos(t):
    return _bloqueos(c.borrar_bloqueos(t.bloqueos, "motivo 1"))


@consulta(
    "borrar_bloqueos_sede",
    f"""select {BLOQUEO} from bloqueos where not (motivo = 'motivo 1' and audiologo_id in {EN_SEDES}
      and fecha between date '2024-01-10' and date '2024-01-20')""",
)
def borrar_bloqueos_sede(t):
    quienes = c.audiologos_en(t.audiologos, t.sedes, SEDES_NOMBRADAS).select(
        F.col("id").alias("audiologo_id")
    )
    return _bloqueos(
        c.borrar_bloqueos(t.bloqueos, "motivo 1", "2024-01-10", "2024-01-20", quienes)
    )


# ---- Catalogue ----


@consulta(
    "reactivar_sedes",
    """select id, nombre, ciudad, case when nombre ilike '%nation_7' or nombre ilike 'NATION_1%'
      then true else activa end activa from sedes""",
)
def reactivar_sedes(t):
    return c.reactivar_sedes(t.sedes, ["%nation_7", "NATION_1%"])


@consulta(
    "renombrar",
    """select id, case nombre when 'Supplier#000000002' then 'Ana' when 'Supplier#000000005' then 'Eva'
      else nombre end nombre, sede_id, activo from audiologos""",
)
def renombrar(t):
    return c.renombrar(t.audiologos, {"Supplier#000000002": "Ana", "Supplier#000000005": "Eva"})


@consulta("agregar_columna", "select *, cast(null as varchar) documento from pacientes")
def agregar_columna(t):
    con_documento = c.agregar_columna(t.pacientes, "documento", "string")
    return c.agregar_columna(con_documento, "eps", "string")


@consulta(
    "cargar_catalogo",
    """select cast(a.id as varchar) is not null tiene_id, nombre, sede, activo from (
      select a.id, a.nombre, s.nombre sede, a.activo from audiologos a join sedes s on s.id = a.sede_id
      union all
      select 0, p.p_name, r.nombre, true from part p join (
        select 'Sede ' || r_name nombre from region) r
        on r.nombre = 'Sede ' || (select r_name from region where r_regionkey = p.p_partkey % 6)) a""",
)
def cargar_catalogo(t):
    """New sites named after regions, new professionals named after parts; a sixth has no site."""
    regiones = t.origen("region")
    nuevas = regiones.select(
        F.concat(F.lit("Sede "), F.col("r_name")).alias("nombre"), F.col("r_name").alias("ciudad")
    )
    profesionales = t.origen("part").withColumn("r_regionkey", (F.col("p_partkey") % 6).cast("int"))
    profesionales = profesionales.join(regiones, "r_regionkey", "left").select(
        F.col("p_name").alias("nombre"),
        F.coalesce(F.concat(F.lit("Sede "), F.col("r_name")), F.lit("Sede ninguna")).alias("sede"),
        F.col("p_type").alias("especialidad"),
    )
    sedes, audiologos = c.cargar_catalogo(
        t.sedes, t.audiologos, nuevas, profesionales, lote="carga"
    )
    nombres = sedes.select(F.col("id").alias("sede_id"), F.col("nombre").alias("sede"))
    return audiologos.join(nombres, "sede_id").select(
        F.col("id").isNotNull().alias("tiene_id"), "nombre", "sede", "activo"
    )
