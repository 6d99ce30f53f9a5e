"""Changes decided in bulk equal a plain loop over them, one by one."""

import datetime as dt
import random

import pytest

from tests.tablas_prueba import citas as tabla_citas, filas
from turnero.operators import en_orden as eo, panel, reservas as r

DIA = dt.date(2026, 8, 3)
OPS = ("t long, id string, mueve boolean, hueco struct<audiologo_id:string,fecha:date,ini:int>, activa boolean")


def bucle(citas, ops):
    """{turn: applies} and the appointments after all."""
    agenda = {c[0]: [c[3] != "cancelada", (c[1], c[2]) if c[1] else None] for c in citas}
    dicho = {}
    for t, i, mueve, hueco, activa in sorted(ops):
        esta, tenia = agenda.get(i, [False, None])
        pide, queda = hueco if mueve else tenia, esta if activa is None else activa
        libre = not (queda and pide) or (esta and tenia == pide) or not any(
            x != i and a and h == pide for x, (a, h) in agenda.items())
        if libre:
            agenda[i] = [queda, pide]
        dicho[t] = libre
    return dicho


def decidir(spark, citas, ops):
    tabla = spark.createDataFrame(
        [(i, a, DIA, f"{h:02d}:00:00", e) for i, a, h, e in citas],
        "id string, audiologo_id string, fecha date, hora_inicio string, estado string")
    df = spark.createDataFrame(
        [(t, i, m, (h[0], DIA, h[1] * 3600) if h else None, a) for t, i, m, h, a in ops], OPS)
    res = eo.decidir_en_orden(tabla, df).collect()
    assert len(res) == len(ops)
    return {f["t"]: f["aplica"] for f in res}


@pytest.mark.parametrize("semilla", [1, 2])
def test_al_azar(spark, semilla):
    azar = random.Random(semilla)
    horas = azar.choice([2, 4])

    def hueco():
        quien = azar.choice(["a1", "a1", "a2", None])
        return (quien, azar.randint(8, 7 + horas)) if quien else None

    citas = [(f"c{i}", azar.choice(["a1", "a2", None]), azar.randint(8, 7 + horas),
              azar.choice(["pendiente", "cancelada"])) for i in range(8)]
    ops = []
    for t in range(90):
        i, que = f"c{azar.randrange(8)}", azar.random()
        ops.append((t, i, False, None, azar.random() < 0.5) if que < 0.4 else
                   (t, i, True, hueco(), None) if que < 0.8 else (t, f"n{t}", True, hueco(), True))
    assert decidir(spark, citas, ops) == bucle(citas, ops)


def test_cadena_de_mudanzas(spark):
    """Each takes the slot the next one left just before, and one comes too early."""
    n = 6
    citas = [(f"c{i}", "a1", 8 + i, "pendiente") for i in range(n)]
    ops = [(n - i, f"c{i}", True, ("a1", 9 + i), None) for i in range(n)] + [(0, "c0", True, ("a1", 9), None)]
    dicho = decidir(spark, citas, ops)
    assert dicho == bucle(citas, ops) == {0: False, **{t: True for t in range(1, n + 1)}}


def test_hueco_muy_pedido(spark, monkeypatch):
    """All who ask for one slot are decided in two rounds, also when it changes hands in between."""
    rondas = []
    original = eo._decidir
    monkeypatch.setattr(eo, "_decidir", lambda *a: rondas.append(1) or original(*a))
    ops = [(t, f"n{t}", True, ("a1", 8), True) for t in range(400)] + [(400, "c0", False, None, False),
                                                                        (401, "x", True, ("a1", 8), True)]
    citas = [("c0", "a1", 8, "pendiente")]
    assert decidir(spark, citas, ops) == bucle(citas, ops)
    assert len(rondas) <= 2


def test_cambios_y_ediciones_cuadran(spark):
    """Every change is applied, refused or replaced, and edits before a refused one hold."""
    c = tabla_citas(spark, [
        (f"c{i}", "p1", "a1", "s1", "2026-08-03", f"{8 + i:02d}:00:00", f"{8 + i:02d}:30:00", "pendiente", None, None)
        for i in range(3)])
    cambios = spark.createDataFrame([
        ("c0", "cancelada", 1), ("c0", "pendiente", 2), ("c0", "pendiente", 2), ("c1", None, 3), (None, "cancelada", 4),
        ("c1", "cancelada", 5), ("c9", "cancelada", 6)], "id string, estado string, orden int")
    rev = r.revisar_cambios_estado(c, cambios)
    assert filas(rev, "id", "nuevo", "motivo_rechazo") == [
        (None, "cancelada", "cita_desconocida"), ("c0", "cancelada", "reemplazado"), ("c0", "pendiente", None),
        ("c0", "pendiente", "reemplazado"), ("c1", None, "estado_invalido"), ("c1", "cancelada", None),
        ("c9", "cancelada", "cita_desconocida")]
    ediciones = spark.createDataFrame([
        ("c0", 1, "p1", "a1", "s1", DIA, "12:00:00", "m1", None), ("c0", 2, "p1", "a1", "s1", DIA, "09:00:00", "m2", None),
        ("c1", 3, "p1", "a1", "s1", DIA, "08:00:00", "m3", None), ("c1", 4, "p1", "a1", "s1", DIA, "08:00:00", "m4", None),
    ], "id string, orden int, paciente_id string, audiologo_id string, sede_id string, fecha date, hora_inicio string,"
       " motivo_consulta string, notas string")
    despues, no = panel.editar(c, ediciones)
    assert filas(despues, "id", "hora_inicio", "motivo_consulta") == [
        ("c0", "12:00:00", "m1"), ("c1", "08:00:00", "m4"), ("c2", "10:00:00", None)]
    assert filas(no, "id", "motivo_consulta", "motivo_rechazo") == [
        ("c0", "m2", "horario_tomado"), ("c1", "m3", "reemplazado")]


def test_lotes_vacios(spark):
    c = tabla_citas(spark, [])
    cambios = spark.createDataFrame([], "id string, estado string, orden int")
    assert [df.count() for df in r.cambiar_estado(c, cambios)] == [0, 0]
