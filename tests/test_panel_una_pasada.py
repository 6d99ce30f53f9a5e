"""A batch of staff forms goes through the appointments and through its own texts as seldom as it can."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.tablas_prueba import citas, estado, filas
from turnero.functions.tiempo import seg
from turnero.operators import en_orden, numeracion, panel, reservas

DIA = dt.date(2026, 8, 3)
FORMA = ("solicitud_id string, recibida_en long, cita_id string, audiologo_id string, sede_id string, fecha date,"
         " hora_inicio string, nombre string, telefono string, motivo string, notas string")


def cita(i, hora, quien="a1", edo="pendiente"):
    return (i, "p1", quien, "s1", "2026-08-03", hora, "23:00:00", edo, "viejo", "antes")


def forma(t, cual, hora, quien="a1"):
    return (f"r{t}", t, cual, quien, "s1", DIA, hora, "N", "1", f"m{t}", f"n{t}")


def test_citas_se_recorren_una_vez(spark, tmp_path):
    """Edited and unchanged appointments come from one pass over the table."""
    citas(spark, [cita("c0", "08:00:00"), cita("c1", "09:00:00"), cita(None, "10:00:00")]).write.parquet(f"{tmp_path}/c")
    tabla = spark.read.parquet(f"{tmp_path}/c")
    aplican = spark.createDataFrame(
        [("c0", "p2", "a1", "s1", DIA, "11:00:00", "11:30:00", None, "x")],
        "id string, paciente_id string, audiologo_id string, sede_id string, fecha date, hora_inicio string,"
        " hora_fin string, motivo_consulta string, notas string")
    despues = panel.con_ediciones(tabla, aplican)
    assert filas(despues, "id", "paciente_id", "hora_inicio", "motivo_consulta", "notas") == [
        (None, "p1", "10:00:00", "viejo", "antes"), ("c0", "p2", "11:00:00", None, "x"),
        ("c1", "p1", "09:00:00", "viejo", "antes")]
    assert despues._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1


def test_textos_se_escriben_una_vez(spark, monkeypatch):
    """The steps that decide carry no texts, and read the stored appointments once."""
    escritos = []
    for modulo in (panel, en_orden, numeracion, reservas):
        original = modulo.materializar
        monkeypatch.setattr(modulo, "materializar", lambda df, nombre, _o=original: (
            escritos.append((nombre, df.columns)) or _o(df, nombre)))
    e = estado(spark, c=[cita("c0", "08:00:00"), cita("c1", "09:00:00")])
    res = panel.guardar_panel(spark.createDataFrame([
        forma(1, "c0", "10:00"), forma(2, None, "08:00"), forma(3, None, "9:00"), forma(4, "c9", "12:00"),
        forma(5, None, None), forma(6, None, "13:00", "a9")], FORMA), e)
    assert filas(res.citas, "hora_inicio", "hora_fin", "motivo_consulta", "notas") == [
        ("08:00:00", "08:30:00", "m2", "n2"), ("09:00:00", "23:00:00", "viejo", "antes"), ("10:00:00", "10:30:00", "m1", "n1")]
    assert filas(res.rechazadas, "solicitud_id", "motivo_rechazo") == [
        ("r3", "horario_tomado"), ("r4", "cita_desconocida"), ("r5", "falta_hora"), ("r6", "audiologo_desconocido")]
    assert [nombre for nombre, columnas in escritos if "notas" in columnas] == ["formularios"]
    assert [nombre for nombre, columnas in escritos if "a" in columnas and "h" in columnas] == ["actuales", "inicio"]


def test_ocupan_los_de_fuera(spark):
    """A slot is held from outside when more active appointments hold it than those of the batch."""
    e = estado(spark, c=[
        cita("c0", "08:00:00"), cita("c1", "08:00:00"), cita("c2", "09:00:00"), cita("c3", "09:00:00", edo="cancelada"),
        cita(None, "10:00:00"), cita("c4", "11:00:00"), cita("c5", "11:00:00")])
    res = panel.guardar_panel(spark.createDataFrame([
        forma(1, "c0", "14:00"), forma(2, None, "08:00"),  # c1 stays at 8
        forma(3, "c2", "15:00"), forma(4, None, "09:00"),  # c3 is cancelled
        forma(5, None, "10:00"),  # held by one without id
        forma(6, "c4", "16:00"), forma(7, "c5", "17:00"), forma(8, None, "11:00"),
    ], FORMA), e)
    assert filas(res.rechazadas, "solicitud_id", "motivo_rechazo") == [
        ("r2", "horario_tomado"), ("r5", "horario_tomado")]


def test_turnos_crecen(spark):
    df = spark.range(500).select((F.col("id") * 37 % 101).alias("orden"), F.col("id").cast("string").alias("id"))
    f = numeracion.por_turno(df, [F.col("orden"), F.col("id")]).collect()
    assert [(x["orden"], x["id"]) for x in sorted(f, key=lambda x: x["t"])] == sorted((x["orden"], x["id"]) for x in f)
    assert len({x["t"] for x in f}) == 500


@pytest.mark.parametrize("texto, segundos", [
    ("08:30:15", 30615), ("23:59", 86340), ("8:30", 30600), ("24:00", 86400), ("24:00:00", 86400), ("24:01", None),
    ("24:00:01", None), ("25:00:00", None), ("29:00", None), ("08:60:00", None), ("08:00:60", None), ("08:00:00.9", 28800),
    ("08:00:", None), ("0800", None), (" 8:00", None), ("+8:00", None), ("-1:00:00", None), ("08:00 ", None), ("08-00-00", None),
    ("٠٨:00", None), ("0:0:00", None), ("", None), (None, None),
])
def test_hora_por_posicion(spark, texto, segundos):
    """Reading by position accepts what the pattern accepts."""
    assert spark.createDataFrame([(texto,)], "h string").select(seg("h").alias("s")).first()["s"] == segundos
