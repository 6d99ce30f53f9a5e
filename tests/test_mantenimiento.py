"""Known counts of the schedule and closure operations, on a catalogue with made-up names."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.tablas_prueba import audiologos, bloqueos, fechado, filas, sedes, semanal
from turnero.operators import calidad, catalogo as c, disponibilidad as d, horarios as h
from turnero.plans import informes as i

# Professionals per site; sites 8 and 10 are the ones the operations single out.
POR_SEDE = [1, 1, 1, 1, 1, 3, 1, 3, 1, 4]
ESTANDAR = [
    *h.lunes_a(4, "07:30", "12:00"), *h.lunes_a(4, "13:00", "17:00"),
    (5, "07:30", "12:00"), (5, "13:00", "16:30"),
]
NOMBRADAS = ["Sede 8", "Sede 10"]
LUNES, VIERNES = "2026-08-03", "2026-08-07"


@pytest.fixture(scope="module")
def catalogo(spark):
    s = sedes(spark, [(f"s{k}", f"Sede {k}", "Cali" if k < 3 else "Bogotá", True) for k in range(1, 11)])
    a = audiologos(spark, [
        (f"a{k}-{j}", f"Prof {k}-{j}", f"s{k}", True)
        for k, n in enumerate(POR_SEDE, 1) for j in range(1, n + 1)
    ])
    return s, a


def slots(spark, hd, a, fecha):
    vacias = fechado(spark, []), i_citas(spark), bloqueos(spark, [])
    return d.disponibilidad_rango(a, fecha, fecha, hd, *vacias).count()


def i_citas(spark):
    from tests.tablas_prueba import citas

    return citas(spark, [])


def test_cargar_catalogo(spark):
    nuevas = spark.createDataFrame([(f"Sede {k}", "Cali") for k in range(1, 11)], "nombre string, ciudad string")
    gente = spark.createDataFrame(
        [(f"P{k}-{j}", f"Sede {k}", "x") for k, n in enumerate(POR_SEDE, 1) for j in range(n)] + [("Q", "Otra", "x")],
        "nombre string, sede string, especialidad string",
    )
    s, a = c.cargar_catalogo(sedes(spark, []), audiologos(spark, []), nuevas, gente, "carga")
    assert filas(i.totales(s, a), "total_sedes", "total_audiologos") == [(10, 17)]
    conteo = {x[0]: x[1] for x in filas(i.audiologos_por_sede_conteo(s, a), "sede", "num_audiologos")}
    assert [conteo[f"Sede {k}"] for k in range(1, 11)] == POR_SEDE
    assert calidad.chk_pk({"sedes": s, "audiologos": a}).count() == 0
    assert a.select("id").collect() == a.select("id").collect()


def test_sede_sin_profesionales_cuenta_cero(spark):
    s = sedes(spark, [("s1", "A", "X", True), ("s2", "A", "X", True), ("s3", "B", "X", True)])
    a = audiologos(spark, [("1", "n", "s1", True), ("2", "n", "s2", True), ("3", "n", None, True)])
    assert filas(i.audiologos_por_sede_conteo(s, a), "sede", "num_audiologos") == [("A", 2), ("B", 0)]


def test_plantillas(spark, catalogo):
    s, a = catalogo
    vacia = semanal(spark, [])
    inicial = h.aplicar_plantilla(vacia, a, h.lunes_a(5, "08:00", "17:00"))
    assert inicial.count() == 85 and slots(spark, inicial, a, LUNES) == 17 * 18
    general = h.aplicar_plantilla(inicial, a, [*h.lunes_a(4, "07:30", "17:00"), (5, "07:30", "16:30")])
    assert filas(i.conteo_horarios(general), "total_horarios") == [(85,)]
    assert slots(spark, general, a, LUNES) == 17 * 19 and slots(spark, general, a, VIERNES) == 17 * 18
    otros = c.audiologos_fuera_de(a, s, NOMBRADAS)
    almuerzo = h.aplicar_plantilla(general, otros, ESTANDAR)
    assert otros.count() == 10 and almuerzo.count() == 100 + 7 * 5
    assert slots(spark, almuerzo, otros, LUNES) == 10 * 17
    assert slots(spark, almuerzo, otros, VIERNES) == 10 * 16


def test_cierre_y_reapertura(spark, catalogo):
    s, a = catalogo
    previo = bloqueos(spark, [("a8-1", "2026-08-05", "08:00:00", "09:00:00", "otro"),
                              ("a1-1", "2026-08-05", None, None, "otro"), ("a8-1", "2026-09-01", None, None, None)])
    args = (a, s, NOMBRADAS, "2026-08-01", "2026-08-31", "cierre")
    b = c.cerrar_sedes(previo, *args, limpiar=True)
    assert filas(i.conteo_bloqueos_motivo(b, "cierre", "2026-08-01", "2026-08-31"), "total_bloqueos") == [(217,)]
    assert {x[0] for x in filas(i.dias_bloqueados(b, a, s, "cierre"), "dias_bloqueados")} == {31}
    assert b.count() == 217 + 2
    assert c.cerrar_sedes(b, *args, limpiar=True).count() == b.count()
    assert c.cerrar_sedes(b, *args).count() == b.count() + 217
    abierto = c.borrar_bloqueos(b, "cierre")
    assert filas(i.bloqueos_restantes(abierto, "cierre"), "bloqueos_restantes") == [(0,)]
    assert abierto.count() == 2
    nombres = ["Prof 8-1", "Prof 8-2", "Prof 8-3"]
    hf = fechado(spark, [("h", "a8-1", LUNES, "08:00:00", "09:00:00", 30), ("g", "a1-1", LUNES, "08:00:00", "09:00:00", 30)])
    hd, hf = h.restablecer_horario(semanal(spark, [("a8-2", 1, "08:00:00", "09:00:00", 30)]), hf, a, nombres, ESTANDAR)
    assert hd.count() == 30 and filas(hf, "id") == [("g",)]


# Shifts rotate by rule over the weekdays of a month: morning, afternoon, free.
PERSONAS = ["Vera", "Carla", "Alba"]
LABORABLES = [k for k in range(1, 32) if dt.date(2026, 8, k).isoweekday() <= 5]


def turno(p, k):
    return (LABORABLES.index(k) + p) % 3


def test_roster(spark):
    a = audiologos(spark, [(n[0], n, "s8", True) for n in PERSONAS] + [("Z", "Zoe", "s8", True)])
    lista, slots_de = [], dict.fromkeys("VCA", 0)
    for p, nombre in enumerate(PERSONAS):
        for k in LABORABLES:
            viernes = dt.date(2026, 8, k).isoweekday() == 5
            if turno(p, k) == 0:      # 07:30-13:00, eleven half hours
                lista.append((nombre, f"2026-08-{k:02d}", "07:30", "13:00"))
                slots_de[nombre[0]] += 11
            elif turno(p, k) == 1:    # until 17:00, eight; on Fridays until 16:30, seven
                lista.append((nombre, f"2026-08-{k:02d}", "13:00", "16:30" if viernes else "17:00"))
                slots_de[nombre[0]] += 7 if viernes else 8
    roster = spark.createDataFrame(
        lista + [("Nadie", "2026-08-03", "07:30", "13:00")],
        "nombre string, fecha string, hora_inicio string, hora_fin string",
    )
    previo = semanal(spark, [("V", 1, "08:00:00", "17:00:00", 30), ("Z", 1, "08:00:00", "17:00:00", 30)])
    hf, hd, sin = h.cargar_roster(fechado(spark, []), previo, a, roster, "agosto")
    assert hf.count() == len(lista) and filas(hd, "audiologo_id") == [("Z",)] and filas(sin, "nombre") == [("Nadie",)]
    libres = d.disponibilidad_rango(a, "2026-08-01", "2026-08-31", semanal(spark, []), hf, i_citas(spark), bloqueos(spark, []))
    assert dict(filas(libres.groupBy("audiologo_id").count(), "audiologo_id", "count")) == slots_de
    assert calidad.chk_pk({"horarios_fecha": hf}).count() == 0


def test_reemplazos(spark):
    hd = semanal(spark, [("a", 1, "08:00:00", "09:00:00", 30), ("b", 1, "08:00:00", "09:00:00", 30),
                         ("b", 2, "08:00:00", "09:00:00", 30)])
    claves = spark.createDataFrame([("a",), ("b",)], "audiologo_id string")
    nuevos = spark.createDataFrame(
        [("a", 3, "10:00", "11:00", "45"), ("a", 3, "10:00", "", "45"), ("a", 4, "10:00", "11:00", "x"),
         ("a", 5, "10:00", "11:00", "-15"), ("a", 6, None, "11:00", "30")],
        "audiologo_id string, dia_semana int, hora_inicio string, hora_fin string, duracion_cita_min string",
    )
    una = h.reemplazar_horario(hd, claves, nuevos)
    esperado = [("a", 3, "10:00:00", 45), ("a", 4, "10:00:00", 30), ("a", 5, "10:00:00", -15)]
    columnas = ("audiologo_id", "dia_semana", "hora_inicio", "duracion_cita_min")
    assert filas(una, *columnas) == esperado
    assert filas(h.reemplazar_horario(una, claves, nuevos), *columnas) == esperado


def test_reemplazar_y_quitar_dia(spark):
    hf = fechado(spark, [("h1", "a", LUNES, "08:00:00", "09:00:00", 30), ("h2", "a", VIERNES, "08:00:00", "09:00:00", 30)])
    claves = spark.createDataFrame([("a", dt.date(2026, 8, 3))], "audiologo_id string, fecha date")
    ninguno = spark.createDataFrame(
        [], "audiologo_id string, fecha date, hora_inicio string, hora_fin string, duracion_cita_min string")
    assert filas(h.reemplazar_dia(hf, claves, ninguno), "id") == [("h2",)]
    dos = spark.createDataFrame([("a", dt.date(2026, 8, 3), "10:00", "11:00", "")] * 2, ninguno.schema)
    con_dos = h.reemplazar_dia(hf, claves, dos, "l1")
    assert con_dos.count() == 3 and con_dos.select("id").distinct().count() == 3


def test_copiar_dias(spark):
    hd = semanal(spark, [("a", 1, "08:00:00", "09:00:00", 30), ("a", 2, "10:00:00", "11:00:00", 30),
                         ("a", 6, "10:00:00", "11:00:00", 30), ("b", 2, "10:00:00", "11:00:00", 30)])
    claves = spark.createDataFrame([("a",)], "audiologo_id string")
    r = h.copiar_dias(hd, 1, range(1, 6), claves)
    assert filas(r, "audiologo_id", "dia_semana", "hora_inicio") == [
        ("a", k, "08:00:00") for k in range(1, 6)] + [("a", 6, "10:00:00"), ("b", 2, "10:00:00")]
    assert filas(h.copiar_dias(hd, 3, [2], claves), "audiologo_id", "dia_semana") == [("a", 1), ("a", 6), ("b", 2)]
    assert h.copiar_dias(hd, 1, [1], claves).count() == 4


def test_bloquear_espacios_y_borrar(spark):
    a = audiologos(spark, [("1", "Ana", None, True), ("2", "Ana", None, True), ("3", "Eva", None, True)])
    lista = spark.createDataFrame(
        [("Ana", "2026-08-03", "07:30", "13:00"), ("Otra", "2026-08-03", "07:30", "13:00")],
        "nombre string, fecha string, hora_inicio string, hora_fin string")
    b, sin = c.bloquear_espacios(bloqueos(spark, []), a, lista, "espacio")
    assert filas(b, "audiologo_id", "hora_inicio") == [("1", "07:30:00"), ("2", "07:30:00")]
    assert filas(sin, "nombre") == [("Otra",)]
    uno = spark.createDataFrame([("1",)], "audiologo_id string")
    assert filas(c.borrar_bloqueos(b, "espacio", "2026-08-03", "2026-08-03", uno), "audiologo_id") == [("2",)]
    assert c.borrar_bloqueos(b, "espacio", "2026-08-04").count() == 2
    nulo = bloqueos(spark, [("1", LUNES, None, None, None)])
    assert c.borrar_bloqueos(nulo, "espacio").count() == 1


def test_sedes_y_nombres(spark):
    s = sedes(spark, [("1", "Sede Peñón", "X", False), ("2", "sede OESTE", "X", False), ("3", "Penon", "X", False), ("4", None, "X", False)])
    r = c.reactivar_sedes(s, ["%peñó%", "%oeste%"])
    assert filas(r, "id", "activa") == [("1", True), ("2", True), ("3", False), ("4", False)]
    a = audiologos(spark, [("1", "P1", None, True), ("2", "P1", None, True), ("3", None, None, True)])
    assert filas(c.renombrar(a, {"P1": "Ana"}), "id", "nombre") == [("1", "Ana"), ("2", "Ana"), ("3", None)]
    assert c.agregar_columna(a, "nombre", "string").columns == a.columns
    assert c.agregar_columna(a, "eps", "string").filter(F.col("eps").isNull()).count() == 3
