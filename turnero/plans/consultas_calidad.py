"""Registered queries: integrity checks.

The derived tables satisfy most rules, so each check reads a copy of whole tables in which rows
break the rule.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from turnero.operators import calidad as q
from turnero.plans.registro import consulta, hm


@consulta(
    "chk_dominios",
    """select 'horarios_disponibles' tabla, 'dia_semana' regla, cast(audiologo_id as varchar) id
      from horarios_disponibles where dia_semana + case when audiologo_id % 11 = 0 then 3 else 0 end > 6
    union all
    select 'citas', 'estado', cast(id as varchar) from citas where id % 13 = 0 and estado <> 'cancelada'""",
)
def chk_dominios(t):
    hd = t.horarios_disponibles.withColumn(
        "dia_semana", F.col("dia_semana") + F.when(F.col("audiologo_id") % 11 == 0, 3).otherwise(0)
    )
    estado = F.when(
        F.col("id") % 13 == 0, F.when(F.col("estado") == "cancelada", None).otherwise("perdida")
    ).otherwise(F.col("estado"))
    return q.chk_dominios(
        {"horarios_disponibles": hd, "citas": t.citas.withColumn("estado", estado)}
    )


@consulta(
    "chk_no_nulos",
    """select 'pacientes' tabla, 'nombre' columna, cast(id as varchar) id from pacientes where id % 9 = 0
    union all
    select 'pacientes', 'telefono', cast(id as varchar) from pacientes where id % 6 = 0
    union all
    select 'citas', 'fecha', cast(id as varchar) from citas where id % 17 = 0""",
)
def chk_no_nulos(t):
    k = F.col("id")
    pacientes = t.pacientes.withColumn("nombre", F.when(k % 9 != 0, F.col("nombre"))).withColumn(
        "telefono", F.when(k % 6 != 0, F.col("telefono"))
    )
    citas = t.citas.withColumn("fecha", F.when(k % 17 != 0, F.col("fecha")))
    return q.chk_no_nulos({
        "sedes": t.sedes, "audiologos": t.audiologos, "pacientes": pacientes, "citas": citas,
        "bloqueos": t.bloqueos, "horarios_disponibles": t.horarios_disponibles,
        "horarios_fecha": t.horarios_fecha,
    })


def _tablas(t):
    return {
        "sedes": t.sedes, "audiologos": t.audiologos, "pacientes": t.pacientes, "citas": t.citas,
        "bloqueos": t.bloqueos, "horarios_disponibles": t.horarios_disponibles,
        "horarios_fecha": t.horarios_fecha,
    }


@consulta(
    "chk_huerfanos",
    """
    select 'horarios_disponibles' tabla, 'audiologo_id' fk, cast(audiologo_id + 5 as varchar) valor, count(*) n
      from horarios_disponibles where audiologo_id + 5 not in (select id from audiologos) group by 3
    union all
    select 'horarios_fecha', 'audiologo_id', cast(audiologo_id + 5 as varchar), count(*)
      from horarios_fecha where audiologo_id + 5 not in (select id from audiologos) group by 3
    union all
    select 'bloqueos', 'audiologo_id', cast(audiologo_id + 5 as varchar), count(*)
      from bloqueos where audiologo_id + 5 not in (select id from audiologos) group by 3
    union all
    select 'citas', 'audiologo_id', cast(audiologo_id + 5 as varchar), count(*)
      from citas where audiologo_id + 5 not in (select id from audiologos) group by 3""",
)
def chk_huerfanos(t):
    """Orphans among whole tables whose rows ask for the professional five ids further on."""
    hijas = ("horarios_disponibles", "horarios_fecha", "bloqueos", "citas")
    tablas = _tablas(t)
    return q.chk_huerfanos({**tablas, **{
        n: tablas[n].withColumn("audiologo_id", F.col("audiologo_id") + 5) for n in hijas}})


@consulta(
    "chk_pk",
    """select 'pacientes' tabla, cast(id - id % 2 as varchar) id, count(*) n from pacientes
      group by id - id % 2 having count(*) > 1
    union all
    select 'citas', cast(id // 3 as varchar), count(*) from citas group by id // 3 having count(*) > 1""",
)
def chk_pk(t):
    k = F.col("id")
    return q.chk_pk({
        "sedes": t.sedes, "audiologos": t.audiologos,
        "pacientes": t.pacientes.withColumn("id", k - k % 2),
        "citas": t.citas.withColumn("id", F.call_function("div", k, F.lit(3))),
        "horarios_fecha": t.horarios_fecha,
    })


@consulta(
    "dobles_reservas",
    f"""select audiologo_id, fecha, {hm('ini', 'hora_inicio')}, count(*) n from citas
    where estado <> 'cancelada' group by audiologo_id, fecha, ini having count(*) > 1""",
)
def dobles_reservas(t):
    return q.dobles_reservas(t.citas)


# Professionals that are asked to go: all of them.  Those with appointments keep them and are
# refused; every third professional's appointments are given to nobody, so that some can go.
PEDIDOS = """, quedan as (select case when audiologo_id % 3 <> 0 then audiologo_id end audiologo_id from citas),
pedidos as (select id from audiologos),
rechazados as (select id from pedidos where id in (select audiologo_id from quedan)),
se_van as (select id from pedidos where id not in (select id from rechazados))"""


def _borrado(t):
    tablas = {**_tablas(t), "citas": t.citas.withColumn(
        "audiologo_id", F.when(F.col("audiologo_id") % 3 != 0, F.col("audiologo_id")))}
    return q.borrar_audiologos(t.audiologos.select("id"), tablas)


@consulta(
    "borrar_audiologos",
    PEDIDOS + """select 'audiologos' tabla, count(*) filas from audiologos
      where id not in (select id from se_van)
    union all select 'horarios_disponibles', count(*) from horarios_disponibles
      where audiologo_id not in (select id from se_van)
    union all select 'horarios_fecha', count(*) from horarios_fecha
      where audiologo_id not in (select id from se_van)
    union all select 'bloqueos', count(*) from bloqueos
      where audiologo_id not in (select id from se_van)""",
)
def borrar_audiologos(t):
    cambiadas, _ = _borrado(t)
    partes = [
        df.agg(F.count(F.lit(1)).alias("filas")).select(F.lit(nombre).alias("tabla"), "filas")
        for nombre, df in cambiadas.items()
    ]
    total = partes[0]
    for parte in partes[1:]:
        total = total.unionByName(parte)
    return total


@consulta("borrar_restringido", PEDIDOS + "select id, 'citas' tabla from rechazados")
def borrar_restringido(t):
    return _borrado(t)[1]
