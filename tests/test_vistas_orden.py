"""Free slots kept up to date, places in lists, merged blocks, midnight, functions in SQL."""

import random

from pyspark.sql import Window, functions as F

from tests.tablas_prueba import bloqueos, citas, estado, filas, semanal
from tests.test_reservas import pedir, solicitudes
from turnero.functions.sql import registrar_funciones
from turnero.operators import disponibilidad as d, reservas as r, vistas as vs
from turnero.operators.numeracion import numerar
from turnero.plans import informes as i
from turnero.sources import versionadas as v

DESDE, HASTA = "2026-08-03", "2026-10-05"
LUNES = ["2026-08-03", "2026-08-31", "2026-09-07", "2026-10-05"]


def test_libres_al_dia_tras_cada_lote(spark, tmp_path):
    """After each batch the stored table equals one from scratch, and untouched months keep their parts."""
    carpeta = str(tmp_path)
    e = estado(spark, hd=[("a1", 1, "08:00:00", "10:00:00", 30), ("a2", 1, "08:00:00", "09:00:00", 30)],
               a=[("a1", "Ana", "s1", True), ("a2", "Eva", "s1", True)])
    cerrado = bloqueos(spark, [("a2", LUNES[2], None, None, "m")])

    def de_cero(tabla):
        return d.disponibilidad_rango(
            e.audiologos, DESDE, HASTA, e.horarios_disponibles, e.horarios_fecha, tabla, cerrado)

    vs.abrir_libres(de_cero(e.citas), carpeta)
    lotes = [[pedir(1, fecha=LUNES[0]), pedir(2, fecha=LUNES[1], quien="a2")], [pedir(3, fecha=LUNES[0])],
             [pedir(4, hora="08:30:00", fecha=LUNES[0]), pedir(5, fecha=LUNES[3]), pedir(6, quien=None, fecha=LUNES[2])]]
    meses = [{"2026-08"}, set(), {"2026-08", "2026-10"}]
    for lote, tocan in zip(lotes, meses):
        res = r.reservar(solicitudes(spark, lote), e)
        antes = v.confirmada(spark, carpeta, vs.LIBRES)
        al_dia = vs.actualizar_libres(
            spark, carpeta, res.aceptadas.select("audiologo_id", "fecha"), e.horarios_disponibles,
            e.horarios_fecha, res.citas, cerrado, DESDE, HASTA)
        e.citas = res.citas
        assert filas(al_dia.drop("mes"), *al_dia.columns[:4]) == filas(de_cero(e.citas), *al_dia.columns[:4])
        despues = v.confirmada(spark, carpeta, vs.LIBRES)
        assert {m for m in antes[1] if antes[1][m] != despues[1][m]} == tocan
        assert despues[0] == antes[0] + (1 if tocan else 0)
    leidos = vs.leer_libres(spark, carpeta, al_dia.schema["audiologo_id"].dataType, "2026-09-01", "2026-09-30")
    assert all("mes=2026-09" in f for f in leidos.inputFiles())


def test_numerar(spark):
    """Equal to row_number, crowded and null groups included, and no window over a whole group."""
    azar = random.Random(4)
    datos = [(azar.choice([None, "a", "a", "a", "b", "c"]), azar.choice([None, 1, 2, 3]), k) for k in range(600)]
    df = spark.createDataFrame(datos, "g string, o int, id int")
    res = numerar(df, ["g"], [F.col("o").desc_nulls_first(), F.col("id")], partes=7)
    w = Window.partitionBy("g").orderBy(F.col("o").desc_nulls_first(), "id")
    esperado = df.withColumn("numero", F.row_number().over(w).cast("long"))
    assert filas(res, "g", "o", "id", "numero") == filas(esperado, "g", "o", "id", "numero")
    plan = res._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number() windowspecdefinition(_parte" in plan and "row_number() windowspecdefinition(g" not in plan
    assert numerar(df.limit(0), ["g"], [F.col("id")]).count() == 0
    assert sorted(f["n"] for f in numerar(df, [], [F.col("id")], "n", partes=5).collect()) == list(range(1, 601))


def test_agenda_numerada(spark):
    c = citas(spark, [(f"c{k}", None, "a1", None, f, h, h, "pendiente", None, None) for k, (f, h) in enumerate([
        ("2026-08-04", "09:00:00"), ("2026-08-03", "10:00:00"), ("2026-08-03", "08:00:00"), ("2026-08-03", "08:00:00")])])
    assert [x[:3] for x in filas(i.agenda_numerada(c), "fecha", "posicion", "id", "etiqueta_dia") if x[3]] == [
        (x[0], 1, x[2]) for x in filas(i.agenda_numerada(c).filter("posicion = 1"), "fecha", "posicion", "id")]
    assert filas(i.agenda_numerada(c).filter("fecha = '2026-08-03'"), "id", "posicion") == [("c1", 3), ("c2", 1), ("c3", 2)]


def test_orden_espanol(spark):
    gente = spark.createDataFrame(
        [(1, "Zoe"), (2, "Ñusta"), (3, "núñez"), (4, "Nunez"), (5, "Álvaro"), (6, "alba"), (7, None), (8, "Oscar")], "id int, nombre string")
    orden = [f["id"] for f in i.por_nombre_en_espanol(gente).orderBy("puesto").collect()]
    assert orden == [7, 6, 5, 4, 3, 2, 8, 1]


def test_intervalos(spark):
    """Overlapping, nested, touching, equal and open-ended blocks, and one to midnight."""
    b = bloqueos(spark, [
        ("a1", DESDE, "08:00:00", "10:00:00", "m"), ("a1", DESDE, "08:30:00", "09:00:00", "m"),
        ("a1", DESDE, "10:00:00", "11:00:00", "m"), ("a1", DESDE, "12:00:00", None, "m"),
        ("a1", DESDE, "13:00:00", "14:00:00", "m"), ("a1", DESDE, "13:00:00", "14:00:00", "m"),
        ("a1", DESDE, "23:00:00", "24:00:00", "m"), ("a2", DESDE, "10:30:00", "10:45:00", "m"),
        (None, DESDE, "08:00:00", "09:00:00", "m"), ("a2", DESDE, "10:00:00", "09:00:00", "m"),
    ])
    unidos = d.unir_intervalos(d.horas_bloqueadas(b)).withColumns({c: F.col(c) / 3600 for c in ("b_ini", "b_fin")})
    assert filas(unidos, "audiologo_id", "b_ini", "b_fin") == [
        ("a1", 13.0, 14.0), ("a1", 23.0, 24.0), ("a1", 8.0, 11.0), ("a2", 10.5, 10.75)]


def test_bloqueo_hasta_medianoche(spark):
    hd = semanal(spark, [("a1", 1, "22:00:00", "24:00:00", 60)])
    e = estado(spark)
    libres = d.disponibilidad_rango(
        e.audiologos, DESDE, DESDE, hd, e.horarios_fecha, e.citas, bloqueos(spark, [("a1", DESDE, "23:00:00", "24:00:00", "m")]))
    assert filas(libres, "hora_inicio", "hora_fin") == [("22:00:00", "23:00:00")]


def test_funcion_sql(spark):
    e = estado(spark, hd=[("a1", 1, "08:00:00", "09:00:00", 30)])
    registrar_funciones(spark, e.audiologos, DESDE, HASTA, e.horarios_disponibles, e.horarios_fecha, e.citas,
                        bloqueos(spark, [("a1", LUNES[1], None, None, "m")]), "_t")
    d.pares_de(e.audiologos, DESDE, HASTA).createOrReplaceTempView("pares_t")
    for nombre, dias in (("disponibilidad", 9), ("disponibilidad_sin_bloqueos", 10)):
        df = spark.sql(f"select p.fecha, s.* from pares_t p, lateral {nombre}_t(p.audiologo_id, p.fecha) s")
        assert df.count() == 2 * dias
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert filas(spark.sql(f"select * from disponibilidad_t('a1', date '{DESDE}')"), "hora_inicio") == [
        ("08:00:00",), ("08:30:00",)]
