"""Booking batches against a row-by-row loop, and the rules of state changes and edits."""

import datetime as dt
import hashlib
import random

import pytest
from pyspark.sql import functions as F, types as T

from tests.tablas_prueba import estado, filas
from turnero.operators import calidad, panel, reservas as r

LUNES = "2026-08-03"
SOLICITUD = T.StructType.fromJson({"type": "struct", "fields": [
    {"name": n, "type": t, "nullable": True, "metadata": {}} for n, t in [
        ("solicitud_id", "string"), ("recibida_en", "long"), ("sede_id", "string"),
        ("audiologo_id", "string"), ("fecha", "date"), ("hora_inicio", "string"),
        ("nombre", "string"), ("telefono", "string"), ("motivo", "string"), ("email", "string"),
        ("eps", "string"),
    ]
]})


def solicitudes(spark, lista):
    return spark.createDataFrame([
        (*f[:4], dt.date.fromisoformat(f[4]) if f[4] else None, *f[5:]) for f in lista
    ], SOLICITUD)


def pedir(i, hora="08:00:00", quien="a1", nombre="N", tel="1", fecha=LUNES, email=None, eps=None,
          sede="s1", motivo=None):
    return (f"r{i}", i, sede, quien, fecha, hora, nombre, tel, motivo, email, eps)


def sha(*partes):
    return hashlib.sha256("|".join(partes).encode()).hexdigest()


def una_por_una(lista, citas, pacientes):
    """Applies requests in order; returns states of the tables and the refusals."""
    tomadas = {(c[2], c[4], c[5]) for c in citas if c[7] != "cancelada" and c[2]}
    pacientes = {p[0]: list(p) for p in pacientes}
    nuevas, rechazos = [], {}
    for f in sorted(lista, key=lambda f: (f[1], f[0])):
        rid, _, sede, quien, fecha, hora, nombre, tel, motivo, email, eps = f
        if not nombre or not tel:
            rechazos[rid] = "falta_nombre" if not nombre else "falta_telefono"
            continue
        if quien and (quien, fecha, hora) in tomadas:
            rechazos[rid] = "horario_tomado"
            continue
        if quien:
            tomadas.add((quien, fecha, hora))
        mismos = sorted(k for k, p in pacientes.items() if p[2] == tel)
        if mismos:
            p = pacientes[mismos[0]]
            p[1], p[3], p[4] = nombre, email or p[3], eps or p[4]
        else:
            pid = sha("paciente", tel)
            pacientes[pid] = [pid, nombre, tel, email, eps]
        pid = mismos[0] if mismos else pid
        nuevas.append((sha("cita", rid), pid, quien, fecha, hora))
    return sorted(map(tuple, pacientes.values())), sorted(nuevas, key=str), rechazos


def lote_al_azar(semilla, n=120):
    """Requests of which a third want one slot and a third come from one phone."""
    z = random.Random(semilla)
    hora = lambda: "08:00:00" if z.random() < 1 / 3 else f"{z.randint(8, 16):02d}:{z.choice(['00', '30'])}:00"
    tel = lambda: "7" if z.random() < 1 / 3 else str(z.randint(0, 12))
    lista = [
        pedir(i, hora(), z.choice(["a1", "a1", "a2", None]), z.choice(["Ana", "Eva", "Luz", None]), tel(),
              z.choice([LUNES, "2026-08-04"]), z.choice([None, f"m{i}@x"]), z.choice([None, f"e{i}"]))
        for i in range(n)
    ]
    z.shuffle(lista)
    base = {}
    for i in range(15):
        fila = (f"c{i:02d}", "p0", "a1", "s1", LUNES, hora(), "09:00:00", z.choice(["pendiente", "cancelada"]), None, None)
        base.setdefault((fila[5], fila[7] == "cancelada"), fila)
    pac = [(f"p{i}", f"P{i}", str(i % 5), None, "E") for i in range(7)]
    return lista, list(base.values()), pac


A = (("a1", "Ana", "s1", True), ("a2", "Eva", "s1", True))


@pytest.mark.parametrize("semilla", range(3))
def test_lote_igual_a_una_por_una(spark, semilla):
    lista, base, pac = lote_al_azar(semilla)
    pacientes, nuevas, rechazos = una_por_una(lista, base, pac)
    res = r.reservar(solicitudes(spark, lista), estado(spark, base, pac, A))
    assert {x[0]: x[1] for x in filas(res.rechazadas, "solicitud_id", "motivo_rechazo")} == rechazos
    salida = filas(
        res.citas.filter(F.length("id") == 64), "id", "paciente_id", "audiologo_id",
        F.col("fecha").cast("string"), "hora_inicio",
    )
    assert sorted(salida, key=str) == nuevas
    assert sorted(filas(res.pacientes, "id", "nombre", "telefono", "email", "eps")) == pacientes
    assert calidad.dobles_reservas(res.citas).count() == 0
    assert res.citas.count() == len(base) + len(nuevas)


def test_invalidas_no_ocupan(spark):
    e = estado(spark)
    malas = [
        pedir(0, nombre=None), pedir(1, tel=None), pedir(2, fecha=None), pedir(3, hora="zz"),
        pedir(4, quien="nadie"), pedir(5, sede="ninguna"),
    ]
    res = r.reservar(solicitudes(spark, [*malas, pedir(9)]), e)
    assert [x[1] for x in filas(res.rechazadas, "solicitud_id", "motivo_rechazo")] == [
        "falta_nombre", "falta_telefono", "falta_fecha", "falta_hora",
        "audiologo_desconocido", "sede_desconocida",
    ]
    assert filas(res.aceptadas, "solicitud_id") == [("r9",)]


def test_sin_profesional_no_choca(spark):
    res = r.reservar(solicitudes(spark, [pedir(i, quien=None) for i in range(3)]), estado(spark))
    assert res.aceptadas.count() == 3


def test_rechazo_no_toca_pacientes(spark):
    ocupada = [("c1", "p1", "a1", "s1", LUNES, "08:00:00", "08:30:00", "confirmada", None, None)]
    res = r.reservar(
        solicitudes(spark, [pedir(1, nombre="Otro", tel="1"), pedir(2, nombre="Nuevo", tel="2")]),
        estado(spark, ocupada, [("p1", "P", "1", None, None)]),
    )
    assert filas(res.pacientes, "id", "nombre") == [("p1", "P")]


def test_forma_corta_sin_opcionales(spark):
    corta = solicitudes(spark, [pedir(1)]).drop("motivo", "email", "eps")
    assert r.reservar(corta, estado(spark)).aceptadas.count() == 1


@pytest.mark.parametrize("hf, hd, esperada", [
    ([], [], 30),
    ([], [("a1", 1, "08:00:00", "09:00:00", 45)], 45),
    ([("h", "a1", LUNES, "08:00:00", "09:00:00", 20)], [("a1", 1, "08:00:00", "09:00:00", 45)], 20),
    # The first row has no length: the weekly level decides, not the second row.
    ([("h", "a1", LUNES, "08:00:00", "09:00:00", None), ("h2", "a1", LUNES, "10:00:00", "11:00:00", 20)],
     [("a1", 1, "08:00:00", "09:00:00", 45)], 45),
])
def test_duracion(spark, hf, hd, esperada):
    res = r.reservar(solicitudes(spark, [pedir(1, hora="23:50:00")]), estado(spark, hf=hf, hd=hd))
    fin = (23 * 60 + 50 + esperada) % 1440
    assert filas(res.aceptadas, "duracion", "hora_fin") == [(esperada, f"{fin // 60:02d}:{fin % 60:02d}:00")]


# ---- State changes ----


def cita(i, hora="08:00:00", e="pendiente", quien="a1"):
    return (i, "p1", quien, "s1", LUNES, hora, "08:30:00", e, None, None)


def cambios(spark, lista):
    return spark.createDataFrame(lista, "id string, estado string, orden int")


def test_cambio_invalido_no_tapa_al_valido(spark):
    e = estado(spark, [cita("c1")])
    despues, no = r.cambiar_estado(e.citas, cambios(spark, [("c1", "confirmada", 1), ("c1", "otro", 2)]))
    assert filas(despues, "id", "estado") == [("c1", "confirmada")]
    assert filas(no, "id", "motivo_rechazo") == [("c1", "estado_invalido")]


def test_revivir_sobre_hora_tomada(spark):
    e = estado(spark, [cita("c1", e="cancelada"), cita("c2"), cita("c3", e="cancelada")])
    despues, no = r.cambiar_estado(e.citas, cambios(spark, [("c1", "pendiente", 1)]))
    assert filas(despues, "id", "estado") == [("c1", "cancelada"), ("c2", "pendiente"), ("c3", "cancelada")]
    assert filas(no, "id", "motivo_rechazo") == [("c1", "horario_tomado")]
    # One by one: c3 asks while c2 still holds the slot, c1 after it was cancelled.
    lote = [("c3", "confirmada", 1), ("c2", "cancelada", 2), ("c1", "pendiente", 3)]
    despues, no = r.cambiar_estado(e.citas, cambios(spark, lote))
    assert filas(despues, "id", "estado") == [("c1", "pendiente"), ("c2", "cancelada"), ("c3", "cancelada")]
    assert filas(no, "id") == [("c3",)]


def test_cambios_invalidos_y_ultimo_gana(spark):
    e = estado(spark, [cita("c1"), cita("c2", "09:00:00")])
    lote = [("c1", "confirmada", 1), ("c1", "completada", 2), ("c2", "perdida", 1), ("cx", "cancelada", 1)]
    despues, no = r.cambiar_estado(e.citas, cambios(spark, lote))
    assert filas(despues, "id", "estado") == [("c1", "completada"), ("c2", "pendiente")]
    assert filas(no, "id", "motivo_rechazo") == [
        ("c1", "reemplazado"), ("c2", "estado_invalido"), ("cx", "cita_desconocida")]


# ---- Staff forms ----


def forma(i, cita_id=None, hora="08:00", quien="a1", nombre="N", tel="1", sede="s1"):
    return (f"f{i}", i, cita_id, sede, quien, nombre, tel, dt.date(2026, 8, 3), hora, "", "nota")


FORMA = ("solicitud_id string, recibida_en int, cita_id string, sede_id string, audiologo_id string,"
         " nombre string, telefono string, fecha date, hora_inicio string, motivo string, notas string")


def guardar(spark, formas, e):
    return panel.guardar_panel(spark.createDataFrame(formas, FORMA), e)


def test_panel_pacientes(spark):
    e = estado(spark, [cita("c1", "08:00:00")], [("p1", "P", "1", None, None), ("d1", "D", "9", None, None), ("d2", "D", "9", None, None)])
    res = guardar(spark, [
        forma(1, hora="08:00", nombre="X", tel="1"),   # slot taken, patient known: nothing changes
        forma(2, hora="08:00", nombre="Y", tel="2"),   # slot taken, patient new: patient stays
        forma(3, hora="09:00", nombre="Z", tel="2"),   # same new patient
        forma(4, hora="10:00", nombre="V", tel="9"),   # phone of two patients: another one
        forma(5, hora="11:00", nombre="W", tel="9"),
        forma(6, hora="12:00", nombre="", tel="5"),    # incomplete: no patient
    ], e)
    assert filas(res.rechazadas, "solicitud_id", "motivo_rechazo") == [
        ("f1", "horario_tomado"), ("f2", "horario_tomado"), ("f6", "formulario_incompleto"),
    ]
    assert [x[1:] for x in filas(res.pacientes, "telefono", "nombre", "telefono")] == [
        ("P", "1"), ("Y", "2"), ("D", "9"), ("D", "9"), ("V", "9"), ("W", "9"),
    ]
    nueva = filas(res.citas.filter("hora_inicio = '09:00:00'"), "hora_fin", "motivo_consulta", "notas", "estado")
    assert nueva == [("09:30:00", None, "nota", "pendiente")]


def test_panel_ediciones(spark):
    e = estado(spark, [cita("c1", "08:00:00", "confirmada"), cita("c2", "09:00:00"), cita("c3", "08:00:00", "cancelada")],
               [("p1", "P", "1", None, None)])
    res = guardar(spark, [
        forma(1, "c1", "08:00"),     # stays where it is
        forma(2, "c2", "08:00"),     # slot of another active appointment
        forma(3, "c3", "08:00"),     # cancelled ones hold no slot
        forma(4, "cx", "10:00"),
        forma(5, None, "09:00"),     # c2 did not move away
    ], e)
    assert filas(res.citas, "id", "hora_inicio", "estado") == [
        ("c1", "08:00:00", "confirmada"), ("c2", "09:00:00", "pendiente"), ("c3", "08:00:00", "cancelada"),
    ]
    assert filas(res.rechazadas, "solicitud_id", "motivo_rechazo") == [
        ("f2", "horario_tomado"), ("f4", "cita_desconocida"), ("f5", "horario_tomado"),
    ]


def test_panel_dos_van_a_la_misma_hora(spark):
    e = estado(spark, [cita("c1", "08:00:00"), cita("c2", "09:00:00")], [("p1", "P", "1", None, None)])
    res = guardar(spark, [forma(2, "c1", "10:00"), forma(1, "c2", "10:00"), forma(3, None, "09:00")], e)
    assert filas(res.citas, "hora_inicio", F.length("id") < 5) == [
        ("08:00:00", True), ("09:00:00", False), ("10:00:00", True),
    ]
    assert filas(res.rechazadas, "solicitud_id") == [("f2",)]
    assert calidad.dobles_reservas(res.citas).count() == 0
