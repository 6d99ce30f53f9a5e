"""Domain tables derived from the TPC-H-like parquet tables.

``PRELUDIO`` states each rule as a SQL view of the given tables and ``Derivadas`` builds the same
columns with DataFrame expressions.  Each rule is part of what the table *is* (which events stand
for an exception, a block or a booking request); no query cuts the tables down further.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from turnero.functions.tiempo import hms
from turnero.sources.esquemas import esquema

# Weekly template of each kind of professional
# (kind, weekday, start minute, end minute, slot minutes).
PLANTILLAS = [
    (0, 1, 480, 1020, 30), (0, 2, 480, 1020, 30), (0, 3, 480, 1020, 30),
    (0, 4, 480, 1020, 30), (0, 5, 480, 1020, 30),
    (1, 1, 450, 720, 30), (1, 1, 780, 1020, 30), (1, 2, 450, 720, 30),
    (1, 2, 780, 1020, 30), (1, 3, 450, 720, 30), (1, 3, 780, 1020, 30),
    (1, 4, 450, 720, 30), (1, 4, 780, 1020, 30), (1, 5, 450, 720, 30),
    (1, 5, 780, 990, 30),
    (2, 1, 450, 1020, 30), (2, 2, 450, 1020, 30), (2, 3, 450, 1020, 30),
    (2, 4, 450, 1020, 30), (2, 5, 450, 990, 30),
    (3, 1, 480, 735, 30), (3, 3, 480, 735, 30), (3, 6, 540, 700, 45),
]

ORIGENES = {
    "region": esquema("r_regionkey int, r_name string"),
    "nation": esquema("n_nationkey int, n_name string, n_regionkey int"),
    "customer": esquema(
        "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    ),
    "supplier": esquema("s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double"),
    "part": esquema(
        "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int,"
        " p_retailprice double"
    ),
    "orders": esquema(
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
        " o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "events": esquema(
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double,"
        " props string"
    ),
}


def hm_sql(m: str) -> str:
    """SQL text that renders minutes since midnight as ``HH:mm:00``, wrapping at midnight."""
    return f"printf('%02d:%02d:00', (({m}) % 1440) // 60, ({m}) % 60)"


PRELUDIO = f"""
with recursive ns as (select count(*) n from supplier),
sedes as (
  select n_nationkey id, n_name nombre, r_name ciudad, n_nationkey % 8 <> 7 activa
  from nation join region on r_regionkey = n_regionkey),
audiologos as (
  select s_suppkey id, s_name nombre, s_nationkey sede_id, s_acctbal > 0 activo from supplier),
pacientes as (
  select c_custkey id, c_name nombre,
    '573' || lpad(cast(case when c_custkey % 20 = 19 then c_custkey - 1 else c_custkey end as varchar), 9, '0') telefono,
    case when c_custkey % 2 = 0 then null else 'c' || c_custkey || '@example.com' end email,
    case when c_custkey % 3 = 0 then null else c_mktsegment end eps
  from customer),
citas as (
  select o_orderkey id, o_custkey paciente_id, (o_orderkey * 31 + o_custkey) % ns.n audiologo_id,
    a.sede_id, date '2024-01-01' + cast((o_custkey * 13 + o_orderkey) % 30 as int) fecha,
    450 + 30 * (date_diff('day', date '1995-01-01', cast(o_orderdate as date)) % 20) ini,
    case when o_orderkey % 5 = 0 then 60 else 30 end dur,
    case substr(o_orderpriority, 1, 1) when '1' then 'confirmada' when '2' then 'pendiente'
      when '3' then 'completada' when '4' then 'cancelada' else 'no_asistio' end estado,
    case when o_orderstatus = 'P' then null else 'motivo ' || o_orderstatus end motivo_consulta,
    case when o_orderkey % 7 = 0 then 'nota ' || o_orderkey end notas,
    o_orderdate creado_en
  from orders cross join ns join audiologos a on a.id = (o_orderkey * 31 + o_custkey) % ns.n),
plantilla(m, dow, ini, fin, dur) as (values {", ".join(str(p) for p in PLANTILLAS)}),
horarios_disponibles as (
  select s_suppkey audiologo_id, dow dia_semana, ini, fin, dur
  from supplier join plantilla on s_suppkey % 4 = m),
horarios_fecha as (
  select user_id % ns.n audiologo_id, cast(ts as date) fecha,
    case when event_id % 2 = 0 then 450 else 780 end ini,
    case when event_id % 2 = 0 then 780 else 1020 end fin, 30 dur
  from events cross join ns where event_type = 'signup'),
bloqueos as (
  select event_id id, user_id % ns.n audiologo_id, cast(ts as date) fecha,
    case when event_id % 2 = 0 then null else 450 + 60 * (event_id % 8) end ini,
    case when event_id % 2 = 0 or event_id % 11 = 0 then null else 540 + 60 * (event_id % 8) end fin,
    'motivo ' || (event_id % 3) motivo
  from events cross join ns where event_type = 'error'),
solicitudes as (
  select event_id solicitud_id, ts recibida_en, user_id % ns.n audiologo_id, a.sede_id,
    cast(ts as date) + 1 fecha, 450 + 30 * (event_id % 20) ini,
    case when event_id % 37 = 0 then null else 'User ' || user_id || '/' || (event_id % 4) end nombre,
    '573' || lpad(cast(user_id * 20 + 9 * (user_id % 3) as varchar), 9, '0') telefono,
    'consulta ' || (event_id % 2) motivo,
    case when event_id % 3 = 0 then null else 'u' || user_id || '.' || (event_id % 5) || '@example.com' end email,
    case when event_id % 4 = 0 then 'EPS ' || (event_id % 6) end eps
  from events cross join ns left join audiologos a on a.id = user_id % ns.n
  where event_type = 'purchase'),
roster as (
  select 'Supplier#' || lpad(cast(user_id % ((ns.n + 8) // 2) * 2 as varchar), 9, '0') nombre,
    cast(ts as date) fecha, case when event_id % 2 = 0 then 450 else 780 end ini,
    case when event_id % 2 = 0 then 780 else 1020 end fin
  from events cross join ns where event_type = 'view'),
cambios as (
  select (event_id * 7 + user_id) % (no.n + 50) id,
    case event_id % 6 when 0 then 'pendiente' when 1 then 'confirmada' when 2 then 'cancelada'
      when 3 then 'completada' when 4 then 'no_asistio' else 'otro' end estado, event_id orden
  from events cross join (select count(*) n from orders) no where event_type = 'click'),
ediciones as (
  select event_id solicitud_id, ts recibida_en,
    case when event_id % 2 = 0 then (event_id * 11 + user_id) % (no.n + 50) end cita_id,
    (user_id * 7 + event_id) % ns.n audiologo_id, a.sede_id, cast(ts as date) + 2 fecha,
    450 + 30 * (event_id % 20) ini,
    case when event_id % 29 = 0 then '' else 'User ' || user_id || '/' || (event_id % 4) end nombre,
    '573' || lpad(cast(user_id * 20 + 18 - event_id % 3 as varchar), 9, '0') telefono,
    case when event_id % 4 = 0 then '' else 'control ' || (event_id % 4) end motivo,
    case when event_id % 5 = 0 then '' else 'nota ' || (event_id % 5) end notas
  from events cross join ns cross join (select count(*) n from orders) no
  left join audiologos a on a.id = (user_id * 7 + event_id) % ns.n
  where event_type = 'view')
"""


def _txt(c) -> Column:
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def _telefono(c: Column) -> Column:
    return F.concat(F.lit("573"), F.lpad(c.cast("string"), 9, "0"))


def _min(c: Column) -> Column:
    """Minutes since midnight as ``HH:mm:ss``."""
    return hms(c * 60)


def solicitudes_de(eventos: DataFrame, n: Column) -> DataFrame:
    """Booking requests out of purchase events; a row-wise rule, so streams can use it too."""
    e, u = F.col("event_id"), F.col("user_id")
    return eventos.filter(F.col("event_type") == "purchase").select(
        e.alias("solicitud_id"), F.col("ts").alias("recibida_en"), (u % n).alias("audiologo_id"),
        F.date_add(F.to_date("ts"), 1).alias("fecha"),
        _min(450 + 30 * (e % 20)).alias("hora_inicio"),
        F.when(e % 37 != 0, F.concat(F.lit("User "), _txt(u), F.lit("/"), _txt(e % 4))).alias("nombre"),
        _telefono(u * 20 + 9 * (u % 3)).alias("telefono"),
        F.concat(F.lit("consulta "), _txt(e % 2)).alias("motivo"),
        F.when(
            e % 3 != 0, F.concat(F.lit("u"), _txt(u), F.lit("."), _txt(e % 5), F.lit("@example.com"))
        ).alias("email"),
        F.when(e % 4 == 0, F.concat(F.lit("EPS "), _txt(e % 6))).alias("eps"),
    )


class Derivadas:
    """Lazy domain tables over one folder of the given parquet tables."""

    def __init__(self, spark: SparkSession, carpeta: str):
        self.spark = spark
        self.carpeta = carpeta

    def origen(self, nombre: str) -> DataFrame:
        """A given table with its declared schema, so no job runs to infer it."""
        return self.spark.read.schema(ORIGENES[nombre]).parquet(f"{self.carpeta}/{nombre}.parquet")

    @cached_property
    def n(self) -> Column:
        """Number of professionals, as a scalar subquery of the plan."""
        return self.origen("supplier").agg(F.count(F.lit(1)).alias("n")).scalar()

    @cached_property
    def sedes(self) -> DataFrame:
        paises, regiones = self.origen("nation"), self.origen("region")
        return paises.join(regiones, paises.n_regionkey == regiones.r_regionkey).select(
            F.col("n_nationkey").alias("id"), F.col("n_name").alias("nombre"),
            F.col("r_name").alias("ciudad"), (F.col("n_nationkey") % 8 != 7).alias("activa"),
        )

    @cached_property
    def audiologos(self) -> DataFrame:
        return self.origen("supplier").select(
            F.col("s_suppkey").alias("id"), F.col("s_name").alias("nombre"),
            F.col("s_nationkey").alias("sede_id"), (F.col("s_acctbal") > 0).alias("activo"),
        )

    @cached_property
    def pacientes(self) -> DataFrame:
        k = F.col("c_custkey")
        return self.origen("customer").select(
            k.alias("id"), F.col("c_name").alias("nombre"),
            _telefono(F.when(k % 20 == 19, k - 1).otherwise(k)).alias("telefono"),
            F.when(k % 2 != 0, F.concat(F.lit("c"), _txt(k), F.lit("@example.com"))).alias("email"),
            F.when(k % 3 != 0, F.col("c_mktsegment")).alias("eps"),
        )

    @cached_property
    def citas(self) -> DataFrame:
        k, c = F.col("o_orderkey"), F.col("o_custkey")
        prioridad = F.substring("o_orderpriority", 1, 1)
        dias = F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date"))
        ini = 450 + 30 * (dias % 20)
        dur = F.when(k % 5 == 0, 60).otherwise(30)
        citas = self.origen("orders").select(
            k.alias("id"), c.alias("paciente_id"), ((k * 31 + c) % self.n).alias("audiologo_id"),
            F.date_add(F.lit("2024-01-01").cast("date"), ((c * 13 + k) % 30).cast("int")).alias("fecha"),
            _min(ini).alias("hora_inicio"), _min(ini + dur).alias("hora_fin"),
            F.when(prioridad == "1", "confirmada").when(prioridad == "2", "pendiente")
            .when(prioridad == "3", "completada").when(prioridad == "4", "cancelada")
            .otherwise("no_asistio").alias("estado"),
            F.when(F.col("o_orderstatus") == "P", None)
            .otherwise(F.concat(F.lit("motivo "), F.col("o_orderstatus"))).alias("motivo_consulta"),
            F.when(k % 7 == 0, F.concat(F.lit("nota "), _txt(k))).alias("notas"),
            F.col("o_orderdate").alias("creado_en"),
        )
        return self.con_sede(citas, "inner")

    def con_sede(self, df: DataFrame, tipo: str) -> DataFrame:
        """Adds the professional's own site as ``sede_id``."""
        sede = self.audiologos.select(F.col("id").alias("audiologo_id"), "sede_id")
        return df.join(sede, "audiologo_id", tipo)

    @cached_property
    def horarios_disponibles(self) -> DataFrame:
        por_tipo = [[p[1:] for p in PLANTILLAS if p[0] == tipo] for tipo in range(4)]
        filas = F.array(*[
            F.array(*[
                F.struct(*[F.lit(v).alias(n) for n, v in zip(("dia", "ini", "fin", "dur"), fila)])
                for fila in filas
            ])
            for filas in por_tipo
        ])
        return (
            self.origen("supplier")
            .select(
                F.col("s_suppkey").alias("audiologo_id"),
                F.explode(F.get(filas, (F.col("s_suppkey") % 4).cast("int"))).alias("p"),
            )
            .select(
                "audiologo_id", F.col("p.dia").alias("dia_semana"),
                _min(F.col("p.ini")).alias("hora_inicio"), _min(F.col("p.fin")).alias("hora_fin"),
                F.col("p.dur").alias("duracion_cita_min"),
            )
        )

    @cached_property
    def horarios_fecha(self) -> DataFrame:
        e = F.col("event_id")
        manana = e % 2 == 0
        return (
            self.origen("events").filter(F.col("event_type") == "signup")
            .select(
                (F.col("user_id") % self.n).alias("audiologo_id"), F.to_date("ts").alias("fecha"),
                _min(F.when(manana, 450).otherwise(780)).alias("hora_inicio"),
                _min(F.when(manana, 780).otherwise(1020)).alias("hora_fin"),
                F.lit(30).alias("duracion_cita_min"),
            )
        )

    @cached_property
    def bloqueos(self) -> DataFrame:
        e = F.col("event_id")
        return self.origen("events").filter(F.col("event_type") == "error").select(
            e.alias("id"), (F.col("user_id") % self.n).alias("audiologo_id"),
            F.to_date("ts").alias("fecha"),
            F.when(e % 2 != 0, _min(450 + 60 * (e % 8))).alias("hora_inicio"),
            F.when((e % 2 != 0) & (e % 11 != 0), _min(540 + 60 * (e % 8))).alias("hora_fin"),
            F.concat(F.lit("motivo "), _txt(e % 3)).alias("motivo"),
        )

    @cached_property
    def solicitudes(self) -> DataFrame:
        return self.con_sede(solicitudes_de(self.origen("events"), self.n), "left")

    @cached_property
    def roster(self) -> DataFrame:
        """Dated shifts of every second professional, by name; a few names belong to nobody."""
        manana = F.col("event_id") % 2 == 0
        return self.origen("events").filter(F.col("event_type") == "view").select(
            F.concat(
                F.lit("Supplier#"), F.lpad(_txt(F.col("user_id") % F.call_function("div", self.n + 8, F.lit(2)) * 2), 9, "0")
            ).alias("nombre"),
            F.to_date("ts").alias("fecha"),
            _min(F.when(manana, 450).otherwise(780)).alias("hora_inicio"),
            _min(F.when(manana, 780).otherwise(1020)).alias("hora_fin"),
        )

    @cached_property
    def n_citas(self) -> Column:
        return self.origen("orders").agg(F.count(F.lit(1)).alias("n")).scalar()

    @cached_property
    def cambios(self) -> DataFrame:
        """State changes; some name no appointment or no known state."""
        e = F.col("event_id")
        estados = ["pendiente", "confirmada", "cancelada", "completada", "no_asistio", "otro"]
        return self.origen("events").filter(F.col("event_type") == "click").select(
            ((e * 7 + F.col("user_id")) % (self.n_citas + 50)).alias("id"),
            F.get(F.array(*[F.lit(x) for x in estados]), (e % 6).cast("int")).alias("estado"),
            e.alias("orden"),
        )

    @cached_property
    def ediciones(self) -> DataFrame:
        """Staff forms: new appointments and edits, some incomplete."""
        e, u = F.col("event_id"), F.col("user_id")
        formas = self.origen("events").filter(F.col("event_type") == "view").select(
            e.alias("solicitud_id"), F.col("ts").alias("recibida_en"),
            F.when(e % 2 == 0, (e * 11 + u) % (self.n_citas + 50)).alias("cita_id"),
            ((u * 7 + e) % self.n).alias("audiologo_id"),
            F.date_add(F.to_date("ts"), 2).alias("fecha"),
            F.substring(_min(450 + 30 * (e % 20)), 1, 5).alias("hora_inicio"),
            F.when(e % 29 == 0, "").otherwise(
                F.concat(F.lit("User "), _txt(u), F.lit("/"), _txt(e % 4))
            ).alias("nombre"),
            _telefono(u * 20 + 18 - e % 3).alias("telefono"),
            F.when(e % 4 == 0, "").otherwise(
                F.concat(F.lit("control "), _txt(e % 4))
            ).alias("motivo"),
            F.when(e % 5 == 0, "").otherwise(
                F.concat(F.lit("nota "), _txt(e % 5))
            ).alias("notas"),
        )
        return self.con_sede(formas, "left")

    def estado(self):
        """The tables a booking works on."""
        from turnero.operators.reservas import Estado

        return Estado(
            self.citas, self.pacientes, self.audiologos, self.sedes, self.horarios_fecha,
            self.horarios_disponibles,
        )
