"""Stored tables, defaults and generated ids, and what the plans must and must not contain."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  (registers the queries)
from turnero.plans.registro import CONSULTAS
from tests.tablas_prueba import bloqueos, citas, fechado, filas
from turnero.operators import disponibilidad as d, horarios as h, reservas as r
from turnero.plans import informes as i
from turnero.sources import tablas as t
from turnero.sources.derivadas import Derivadas

CARPETA = "/root/testdata/sf0.001"


def cita(i, fecha):
    return (i, "p", "a1", "s1", fecha, "08:00:00", "08:30:00", "pendiente", None, None)


def test_guardar_y_leer(spark, tmp_path):
    c = str(tmp_path)
    t.append_table(citas(spark, [cita("1", "2026-08-03"), cita("2", "2026-09-03")]), c, "citas")
    t.append_table(citas(spark, [cita("3", "2026-09-04")]), c, "citas")
    assert t.read_table(spark, c, "citas").count() == 3
    t.replace_months(citas(spark, [cita("4", "2026-09-05")]), c, "citas")
    assert filas(t.read_table(spark, c, "citas"), "id") == [("1",), ("4",)]


def test_publicar_versiones(spark, tmp_path):
    c = str(tmp_path)
    b = bloqueos(spark, [("a", "2026-08-03", None, None, "m")])
    t.publish_table(b, c, "bloqueos", 1)
    actual = t.read_published(spark, c, "bloqueos")
    t.publish_table(actual.unionByName(actual), c, "bloqueos", 2)
    assert t.read_published(spark, c, "bloqueos").count() == 2
    # A version that was written but not recorded is not read.
    t._escritor(b.limit(0), "bloqueos").parquet(f"{c}/bloqueos/v3")
    assert t.read_published(spark, c, "bloqueos").count() == 2


def test_defectos_solo_si_falta_la_columna(spark):
    ahora = F.lit("2026-08-03 10:00:00").cast("timestamp")
    h = fechado(spark, [("1", "a", "2026-08-03", "08:00:00", "09:00:00", None)])
    assert t.con_valores_por_defecto(h, "horarios_fecha", ahora).first()["duracion_cita_min"] is None
    sin = t.con_valores_por_defecto(h.drop("duracion_cita_min"), "horarios_fecha", ahora).first()
    assert sin["duracion_cita_min"] == 30 and sin["creado_en"] == dt.datetime(2026, 8, 3, 10)


def test_ids_distintos_y_repetibles(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), (None, 1)], "x string, y int")
    uno, dos = filas(t.con_id(df, "l", False), "id"), filas(t.con_id(df.repartition(3), "l", False), "id")
    assert uno == dos and len(set(uno)) == 3


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def sin_difusion(spark):
    """Plans as they are when no side is small enough to be broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_sin_bucles_ni_productos_ni_python(spark, sin_difusion):
    for nombre, consulta in CONSULTAS.items():
        if nombre == "reservas_stream":
            continue
        p = plan(consulta(spark, CARPETA))
        for malo in ("NestedLoop", "Cartesian", "EvalPython", "MapInPandas"):
            assert malo not in p, (nombre, malo)


def test_disponibilidad_no_vuelve_a_repartir(spark, sin_difusion):
    """Day checks and the block check share one exchange of the ranges; slots move once."""
    x = Derivadas(spark, CARPETA)
    p = plan(d.disponibilidad_rango(
        x.audiologos, "2024-01-01", "2024-01-30", x.horarios_disponibles, x.horarios_fecha, x.citas, x.bloqueos
    ))
    tronco = p.split("SortMergeJoin")[:3]
    assert "slot_ini" in tronco[1] and tronco[1].count("Exchange") == 1
    assert tronco[2].count("Exchange") == 0


def test_claves_repetidas_dejan_dividir_el_otro_lado(spark, sin_difusion):
    """Both sides of the join are exchanges, which is what AQE needs to split a crowded key."""
    df = fechado(spark, [("1", "a", "2026-08-03", "08:00:00", "09:00:00", 30)])
    p = plan(h.quitar_excepcion(df.repartition(4), df.select("audiologo_id", "fecha")))
    lineas = [x.strip(" :+-*()0123456789") for x in p.split("\n")]
    ordenes = [k for k, x in enumerate(lineas) if x.startswith("Sort [")]
    assert len(ordenes) == 2 and all(lineas[k + 1].startswith("Exchange hash") for k in ordenes)


def test_filtros_llegan_al_archivo(spark, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    c = str(tmp_path)
    t.append_table(citas(spark, [cita("1", "2026-08-03"), cita("2", "2026-09-03")]), c, "citas")
    df = i.filtrar_citas(t.read_table(spark, c, "citas"), "2026-08-01", "2026-08-10", sede="s1").select("id")
    p = plan(df)
    assert "GreaterThanOrEqual(fecha,2026-08-01)" in p and "EqualTo(sede_id,s1)" in p
    assert "ReadSchema: struct<id:string,sede_id:string,fecha:date>" in p
    guardada = spark.read.parquet(f"{c}/citas")
    podado = plan(t.entre_fechas(guardada, "2026-08-01", "2026-08-31").select("id"))
    assert re.search(r"PartitionFilters: \[[^]]*mes#\d+ >= ", podado)


def test_un_lote_solo_lee_sus_meses(spark, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    c = str(tmp_path)
    meses = [f"2026-{m:02d}-03" for m in range(1, 13)]
    t.append_table(citas(spark, [cita(m, m) for m in meses]), c, "citas")
    lote = citas(spark, [cita("x", "2026-08-03"), cita("y", "2026-09-03")])
    df = t.en_fechas_de(spark.read.parquet(f"{c}/citas"), lote).select("id")
    assert filas(df, "id") == [("2026-08-03",), ("2026-09-03",)]
    assert re.search(r"PartitionFilters: \[[^]]*mes#\d+ >= ", plan(df)) and "subquery" in plan(df)
    claves = lote.select("audiologo_id", "fecha", F.lit(8 * 3600).alias("ini"))
    for _ in (1,):
        tomadas = r.claves_tomadas(spark.read.parquet(f"{c}/citas"), claves)
        assert tomadas.count() == 2


def test_ganadoras_se_limitan_antes_del_reparto(spark):
    df = spark.range(10).select((F.col("id") % 2).alias("k"), "id")
    p = plan(r.primeras(df.repartition(4), ["k"], ["id"]))
    assert p.count("WindowGroupLimit") == 2
