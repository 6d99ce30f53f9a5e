"""Labels, reports with missing parents, calendars and integrity checks."""

import datetime as dt

from pyspark.sql import functions as F

from tests.tablas_prueba import audiologos, bloqueos, citas, fechado, filas, pacientes, sedes, semanal
from turnero.functions import texto, tiempo
from turnero.operators import calidad as q
from turnero.plans import informes as i

LUNES = "2026-08-03"


def uno(spark, columna):
    return spark.range(1).select(columna).first()[0]


def test_horas(spark):
    casos = {"00:05:00": "12:05 am", "08:30:00": "8:30 am", "12:00:00": "12:00 pm", "13:45:00": "1:45 pm", "23:59:00": "11:59 pm"}
    df = spark.createDataFrame([(k,) for k in casos], "h string")
    assert dict(df.select("h", tiempo.fmt_hora("h")).collect()) == casos
    assert uno(spark, tiempo.sumar_minutos(F.lit("23:50:00"), 30)) == "00:20:00"
    assert uno(spark, tiempo.sumar_minutos(F.lit("00:10:00"), -30)) == "23:40:00"
    assert uno(spark, tiempo.hhmmss(F.lit("08:30"))) == "08:30:00"
    assert uno(spark, tiempo.hhmm(F.lit("08:30:00"))) == "08:30"
    assert uno(spark, tiempo.minutos_entre(F.lit("08:00:00"), F.lit("12:15:00"))) == 255.0
    assert uno(spark, tiempo.seg(F.lit("zz"))) is None
    assert uno(spark, tiempo.seg(F.lit("24:00:00"))) == 86400


def test_fechas(spark):
    f = F.lit(LUNES).cast("date")
    assert uno(spark, tiempo.fmt_fecha_grupo(f)) == "lunes, 3 de agosto"
    assert uno(spark, tiempo.dow(F.lit("2026-08-02").cast("date"))) == 0
    assert uno(spark, tiempo.fecha_de(F.lit(2026), F.lit(7), F.lit(3))) == dt.date(2026, 8, 3)
    assert uno(spark, tiempo.ultimo_dia(F.lit("2024-02-10").cast("date"))) == dt.date(2024, 2, 29)
    assert uno(spark, tiempo.sumar_meses(F.lit("2026-12-01").cast("date"), 1)) == dt.date(2027, 1, 1)
    assert uno(spark, tiempo.sumar_meses(F.lit("2026-01-01").cast("date"), -1)) == dt.date(2025, 12, 1)
    assert uno(spark, tiempo.nombre_dia_corto(F.lit(3))) == "Mié"
    assert uno(spark, tiempo.nombre_mes(F.lit(13))) is None
    assert uno(spark, F.size(tiempo.serie_fechas("2026-08-02", "2026-08-01"))) == 0
    assert uno(spark, F.size(tiempo.serie_fechas("2026-08-01", "2026-08-31"))) == 31


def test_textos(spark):
    assert uno(spark, texto.etiqueta_estado(F.lit("no_asistio"))) == "No asistió"
    assert uno(spark, texto.etiqueta_estado(F.lit("otro"))) is None
    assert uno(spark, texto.detalle_cita(F.lit("Ana"), F.lit("Norte"), F.lit(""))) == "Ana · Norte"
    assert uno(spark, texto.detalle_cita(F.lit("Ana"), F.lit(None), F.lit("m"))) == "Ana · m"
    assert uno(spark, texto.nombre_paciente(F.lit(""))) == "Paciente"
    assert uno(spark, texto.vacio_a_nulo(F.lit(""))) is None
    assert [uno(spark, texto.duracion_o_defecto(F.lit(v))) for v in ("", "x", "0", "-5", "45")] == [30, 30, 30, -5, 45]
    assert uno(spark, texto.acciones(F.lit("completada"))) == []


def tablas(spark):
    return (
        citas(spark, [
            ("c1", "p1", "a1", "s1", LUNES, "09:00:00", "09:30:00", "pendiente", "m", None),
            ("c2", "px", "a1", None, LUNES, "08:00:00", "08:30:00", "cancelada", None, None),
            ("c3", None, None, "s1", "2026-08-04", "08:00:00", "08:30:00", "confirmada", None, None),
        ]).withColumn("creado_en", F.lit(None).cast("timestamp")),
        pacientes(spark, [("p1", "Pat", "57", None, None)]),
        audiologos(spark, [("a1", "Ana", "s1", True)]), sedes(spark, [("s1", "Norte", "X", True), ("s2", "Sur", "X", False)]),
    )


def test_detalle_y_agenda(spark):
    t = tablas(spark)
    assert filas(i.citas_detalle(*t), "id") == [("c1",)]
    assert filas(i.citas_con_embebidos(*t).select("id", "pacientes.nombre", F.col("sedes").isNull()), "*") == [
        ("c1", "Pat", False), ("c2", None, True), ("c3", None, False)]
    r = i.agenda(*t, LUNES, "2026-08-10").select("id", "hora", "paciente", "detalle", "etiqueta_estado", "acciones").collect()
    assert [tuple(x) for x in r] == [
        ("c2", "8:00 am", "Paciente", "Ana", "Cancelada", []),
        ("c1", "9:00 am", "Pat", "Ana · Norte · m", "Pendiente", ["confirmar", "editar", "cancelar"]),
        ("c3", "8:00 am", "Paciente", "Norte", "Confirmada", ["editar", "cancelar"]),
    ]
    assert filas(i.filtrar_citas(t[0], LUNES, "2026-08-10", sede="s1", estado="pendiente"), "id") == [("c1",)]
    por_dia = i.agenda_por_dia(t[0]).select("etiqueta_dia", "id").collect()
    assert [tuple(x) for x in por_dia] == [
        ("lunes, 3 de agosto", "c2"), ("lunes, 3 de agosto", "c1"), ("martes, 4 de agosto", "c3")]
    assert filas(i.badges_sede(t[3], t[0], LUNES), "id", "n") == [("s1", 1)]


def test_semana_y_calendario(spark):
    a = audiologos(spark, [("a1", "Ana", "s1", True)])
    hd = semanal(spark, [("a1", 1, "13:00:00", "17:00:00", 30), ("a1", 1, "08:00:00", "12:00:00", 30), ("a1", 0, "08:00:00", "09:00:00", 30)])
    r = i.semana(a, hd).select("dia", "hora_inicio", "sin_horario").collect()
    assert [tuple(x) for x in r] == [("Lunes", "08:00", False), ("Lunes", "13:00", False)] + [
        (d, None, True) for d in ("Martes", "Miércoles", "Jueves", "Viernes", "Sábado")] + [("Domingo", "08:00", False)]
    hf = fechado(spark, [("h", "a1", LUNES, "08:00:00", "09:00:00", 30)] * 2)
    cal = i.calendario(a, hf, 2026, 8, "2026-08-05")
    assert cal.count() == 6 + 31   # 1 August 2026 is a Saturday
    assert filas(cal.filter("tiene_excepcion"), "dia", "fila", "columna") == [(3, 1, 1)]
    assert filas(cal.filter("es_hoy"), "dia") == [(5,)]


def test_integridad(spark):
    c, p, a, s = tablas(spark)
    hd = semanal(spark, [("a1", 7, "08:00:00", None, 30), ("a9", None, "08:00:00", "09:00:00", 30)])
    todas = {"citas": c, "pacientes": p, "audiologos": a, "sedes": s, "horarios_disponibles": hd}
    assert filas(q.chk_dominios(todas), "tabla", "id") == [("horarios_disponibles", "a1")]
    assert filas(q.chk_no_nulos(todas), "columna", "id") == [("dia_semana", "a9"), ("hora_fin", "a1")]
    assert filas(q.chk_huerfanos(todas), "tabla", "fk", "valor", "n") == [
        ("citas", "paciente_id", "px", 1), ("horarios_disponibles", "audiologo_id", "a9", 1)]
    assert filas(q.chk_pk({"citas": c.union(c)}), "id", "n") == [("c1", 2), ("c2", 2), ("c3", 2)]


def test_borrado(spark):
    c, p, a, s = tablas(spark)
    a = a.union(audiologos(spark, [("a2", "Eva", "s1", True)]))
    hd = semanal(spark, [("a1", 1, "08:00:00", "09:00:00", 30), ("a2", 1, "08:00:00", "09:00:00", 30)])
    b = bloqueos(spark, [("a2", LUNES, None, None, "m")])
    ids = spark.createDataFrame([("a1",), ("a2",), ("zz",)], "id string")
    cambiadas, no = q.borrar_audiologos(ids, {"citas": c, "audiologos": a, "sedes": s, "horarios_disponibles": hd, "bloqueos": b})
    assert filas(no, "id", "tabla") == [("a1", "citas")]
    assert filas(cambiadas["audiologos"], "id") == [("a1",)]
    assert filas(cambiadas["horarios_disponibles"], "audiologo_id") == [("a1",)]
    assert cambiadas["bloqueos"].count() == 0
    _, no = q.borrar_restringido("sedes", s.select("id"), {"citas": c, "audiologos": a, "sedes": s})
    assert filas(no.distinct(), "id", "tabla") == [("s1", "audiologos"), ("s1", "citas")]
