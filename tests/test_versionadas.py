"""Versioned tables: one commit for many months, broken writes, two writers, layout."""

import glob

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tests.tablas_prueba import bloqueos, filas
from turnero.sources import versionadas as v
from turnero.sources.esquemas import ESQUEMAS

ESQUEMA = ESQUEMAS["bloqueos"]
A, B, C = "2026-07-03", "2026-08-03", "2026-09-03"


def bl(spark, *fechas, motivo="m"):
    return bloqueos(spark, [(f"a{i}", f, "08:00:00", None, motivo) for i, f in enumerate(fechas)]).withColumn(
        "id", F.concat("audiologo_id", F.lit("-"), F.col("fecha").cast("string"))).withColumn(
        "creado_en", F.lit(None).cast("timestamp"))


def ver(spark, carpeta, **op):
    return filas(v.leer(spark, carpeta, "bloqueos", ESQUEMA, **op), "fecha", "motivo")


def test_reemplazo_en_una_confirmacion(spark, tmp_path, monkeypatch):
    carpeta = str(tmp_path)
    assert ver(spark, carpeta) == []
    assert v.agregar_filas(bl(spark, A, B, C, None), carpeta, "bloqueos") == 1
    antes = ver(spark, carpeta)
    assert len(antes) == 4
    nuevo = bl(spark, A, motivo="otro")
    # Broken off before its commit row: nothing is seen of it.
    with monkeypatch.context() as m:
        m.setattr(v, "confirmar", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            v.reemplazar(nuevo, carpeta, "bloqueos", A, B)
    assert ver(spark, carpeta) == antes
    # July is replaced, August is emptied without being named, September and the row without date stay.
    abierta = v.leer(spark, carpeta, "bloqueos", ESQUEMA)
    assert v.reemplazar(nuevo, carpeta, "bloqueos", A, B) == 2
    assert [(str(f), m) for f, m in ver(spark, carpeta)] == [("None", "m"), (A, "otro"), (C, "m")]
    assert filas(abierta, "fecha", "motivo") == antes == ver(spark, carpeta, version=1)
    assert [str(f) for f, _ in ver(spark, carpeta, desde=B, hasta=C)] == ["None", C]
    with pytest.raises(ValueError):
        v.reemplazar(bl(spark, C), carpeta, "bloqueos", A, B)
    assert v.reemplazar(bl(spark), carpeta, "bloqueos") == 3
    assert ver(spark, carpeta) == []


def test_fundir_solo_meses_tocados(spark, tmp_path):
    carpeta = str(tmp_path)
    v.agregar_filas(bl(spark, A, B, C), carpeta, "bloqueos")
    _, antes = v.confirmada(spark, carpeta, "bloqueos")
    # a0 moves from July to August; a9 is new.
    cambio = bl(spark, A).withColumn("fecha", F.lit(B).cast("date")).withColumn("motivo", F.lit("movido"))
    v.fundir(cambio.unionByName(bl(spark, B).withColumn("id", F.lit("nuevo"))), carpeta, "bloqueos", ESQUEMA)
    assert [(str(f), m) for f, m in ver(spark, carpeta)] == [(B, "m"), (B, "m"), (B, "movido"), (C, "m")]
    _, despues = v.confirmada(spark, carpeta, "bloqueos")
    assert despues["2026-09"] == antes["2026-09"] and "2026-07" not in despues


def test_dos_escritores(spark, tmp_path):
    """Both start from version 1: one wins, the other is told, and no reader sees a mixture."""
    carpeta = str(tmp_path)
    v.agregar_filas(bl(spark, A), carpeta, "bloqueos")
    _, meses = v.confirmada(spark, carpeta, "bloqueos")
    assert v.confirmar(spark, carpeta, "bloqueos", 1, "m", meses | {"x": ["m"]}) == 2
    with pytest.raises(v.VersionPerdida):
        v.confirmar(spark, carpeta, "bloqueos", 1, "z", meses | {"x": ["z"]})
    assert v.confirmada(spark, carpeta, "bloqueos") == (2, meses | {"x": ["m"]})


def test_archivos_siguen_a_los_bytes(spark, tmp_path):
    """Twelve months and eight tasks: few files, and one professional is in few row groups."""
    df = spark.range(0, 24_000, 1, 8).select(
        F.col("id").cast("string").alias("id"), F.format_string("a%03d", F.col("id") % 500).alias("audiologo_id"),
        F.expr("date '2026-01-01' + cast(id * 7 % 365 as int)").alias("fecha"), F.lit("08:00:00").alias("hora_inicio"),
        F.lit("09:00:00").alias("hora_fin"), F.lit("m").alias("motivo"), F.lit(None).cast("timestamp").alias("creado_en"))
    v.agregar_filas(df, str(tmp_path), "bloqueos")
    assert len(glob.glob(f"{tmp_path}/bloqueos/*/*/*.parquet")) == 12
    v.reemplazar(df, str(tmp_path), "bloqueos", bytes_archivo=50_000)
    parte = v.confirmada(spark, str(tmp_path), "bloqueos")[1]["2026-01"][0]
    archivos = glob.glob(f"{tmp_path}/bloqueos/parte={parte}/*/*.parquet")
    total = 24_000 * 60
    assert 12 < len(archivos) <= total / 50_000 + 24
    grupos = [pq.ParquetFile(a).metadata.row_group(0).column(1).statistics for a in archivos]
    con = sum(g.min <= "a250" <= g.max for g in grupos)
    assert con < len(archivos) / 1.5
    leida = v.leer(spark, str(tmp_path), "bloqueos", ESQUEMA).filter("audiologo_id = 'a250'")
    assert leida.count() == 48
    assert "EqualTo(audiologo_id,a250)" in leida._jdf.queryExecution().executedPlan().toString()
