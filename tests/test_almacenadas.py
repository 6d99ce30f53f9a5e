"""Write, read back, ask again: stored tables keep their meaning after rows are added or moved."""

import dataclasses

from pyspark.sql import functions as F

from tests.tablas_prueba import audiologos, bloqueos, citas, estado, filas, sedes
from tests.test_reservas import pedir, solicitudes
from turnero.functions.tiempo import seg
from turnero.operators import catalogo as c, disponibilidad as d, panel as p, reservas as r
from turnero.sources import tablas as t

LUNES = "2026-08-03"
SEMANA = [("a1", 1, "08:00:00", "09:30:00", 30)]


def guardado(spark, carpeta, filas_citas=()):
    e = estado(spark, hd=SEMANA)
    t.append_table(citas(spark, list(filas_citas)), carpeta, "citas")
    return dataclasses.replace(e, citas=spark.read.parquet(f"{carpeta}/citas"))


def libres(e, tabla, bloques):
    return filas(d.disponibilidad_rango(
        e.audiologos, LUNES, LUNES, e.horarios_disponibles, e.horarios_fecha, tabla, bloques), "hora_inicio")


def cita(i, fecha, hora="08:00:00"):
    return (i, "p1", "a1", "s1", fecha, hora, "08:30:00", "pendiente", None, None)


def test_reserva_ocupa_y_no_se_repite(spark, tmp_path):
    e = guardado(spark, str(tmp_path), [cita("c0", "2026-07-06")])
    una = r.reservar(solicitudes(spark, [pedir(1, "08:30:00")]), e)
    assert libres(e, una.citas, bloqueos(spark, [])) == [("08:00:00",), ("09:00:00",)]
    otra = r.reservar(solicitudes(spark, [pedir(2, "8:30")]), dataclasses.replace(e, citas=una.citas))
    assert otra.aceptadas.count() == 0
    assert filas(una.citas, "mes") == [("2026-07",), ("2026-08",)]


def test_cierre_vale_sobre_tabla_guardada(spark, tmp_path):
    carpeta = str(tmp_path)
    e = guardado(spark, carpeta, [cita("c0", "2026-07-06")])
    t.append_table(bloqueos(spark, [("a1", "2026-07-06", None, None, "m")]), carpeta, "bloqueos")
    b = spark.read.parquet(f"{carpeta}/bloqueos")
    cerrado = c.cerrar_sedes(b, e.audiologos, e.sedes, ["Norte"], LUNES, LUNES, "cierre")
    assert libres(e, e.citas, b) != [] and libres(e, e.citas, cerrado) == []


def test_edicion_cambia_de_mes(spark, tmp_path):
    e = guardado(spark, str(tmp_path), [cita("c0", "2026-07-06")])
    nueva = spark.createDataFrame(
        [("c0", 1, "p1", "a1", "s1", "08:00:00", None, None)],
        "id string, orden int, paciente_id string, audiologo_id string, sede_id string, hora_inicio string,"
        " motivo_consulta string, notas string").withColumn("fecha", F.lit(LUNES).cast("date"))
    despues, _ = p.editar(e.citas, nueva)
    assert filas(despues, "mes") == [("2026-08",)]
    assert libres(e, despues, bloqueos(spark, [])) == [("08:30:00",), ("09:00:00",)]


def test_mes_que_queda_vacio(spark, tmp_path):
    carpeta = str(tmp_path)
    t.append_table(citas(spark, [cita("1", "2026-08-03"), cita("2", "2026-09-03")]), carpeta, "citas")
    t.replace_months(citas(spark, []), carpeta, "citas", ["2026-09"])
    assert filas(t.read_table(spark, carpeta, "citas"), "id") == [("1",)]


def test_filas_sin_mes_se_conservan(spark, tmp_path):
    e = guardado(spark, str(tmp_path), [cita("c0", LUNES)])
    sin = e.citas.withColumn("mes", F.lit(None).cast("string"))
    assert t.entre_fechas(sin, LUNES, LUNES).count() == 1


def test_valores_por_defecto_al_anexar(spark):
    nuevas = spark.createDataFrame([("Sur", "Cali", False)], "nombre string, ciudad string, activa boolean")
    gente = spark.createDataFrame([], "nombre string, sede string, especialidad string")
    s, _ = c.cargar_catalogo(sedes(spark, []), audiologos(spark, []), nuevas, gente)
    assert s.first()["activa"] is False
    s, _ = c.cargar_catalogo(sedes(spark, []), audiologos(spark, []), nuevas.drop("activa"), gente)
    assert s.first()["activa"] is True


def test_horas_que_no_existen(spark):
    horas = ["99:99", "25:00", "08:61:00", "8:30", "08:30", "23:59:59", "x", None]
    df = spark.createDataFrame([(h,) for h in horas], "h string").select(seg("h").alias("s"))
    assert [f["s"] for f in df.collect()] == [None, None, None, 30600, 30600, 86399, None, None]
