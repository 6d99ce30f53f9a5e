"""Availability semantics on small tables; 2026-08-03 is a Monday."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tests.tablas_prueba import audiologos, bloqueos, citas, fechado, filas, semanal
from turnero.operators import disponibilidad as d

LUNES = "2026-08-03"


def libres(spark, hd=(), hf=(), c=(), b=(), desde=LUNES, hasta=LUNES, quien=("a1",), **opciones):
    """Starts and ends of the free slots, checked to be the same in both call forms."""
    a = audiologos(spark, [(q, q, "s1", True) for q in quien])
    tablas = (
        semanal(spark, hd), fechado(spark, hf),
        citas(spark, [(str(i), "p", *f[:1], "s1", *f[1:3], f[2], f[3], None, None) for i, f in enumerate(c)]),
        bloqueos(spark, [(*f, "m") for f in b]),
    )
    por_rango = d.disponibilidad_rango(a, desde, hasta, *tablas, **opciones)
    por_pares = d.disponibilidad(d.pares_de(a, desde, hasta), *tablas, **opciones)
    columnas = ("audiologo_id", "fecha", "hora_inicio", "hora_fin")
    r = filas(por_rango, *columnas)
    assert r == filas(por_pares, *columnas)
    return [(x[2][:5], x[3][:5]) for x in r]


def inicios(*args, **kw):
    return [x[0] for x in libres(*args, **kw)]


def test_semana_y_dia_equivocado(spark):
    assert inicios(spark, hd=[("a1", 1, "08:00:00", "09:30:00", 30)]) == ["08:00", "08:30", "09:00"]
    assert inicios(spark, hd=[("a1", 2, "08:00:00", "09:30:00", 30)]) == []


def test_redondeo_pasa_del_fin_solo_en_la_semana(spark):
    rango = ("08:00:00", "12:15:00", 30)
    semana = libres(spark, hd=[("a1", 1, *rango)])
    assert len(semana) == 9 and semana[-1] == ("12:00", "12:30")
    fecha = libres(spark, hf=[("h", "a1", LUNES, *rango)])
    assert len(fecha) == 8 and fecha[-1] == ("11:30", "12:00")


@pytest.mark.parametrize("fin, n", [("08:10:00", 0), ("08:15:00", 1), ("07:00:00", 0), ("08:00:00", 0)])
def test_rango_corto_vacio_o_invertido(spark, fin, n):
    assert len(libres(spark, hd=[("a1", 1, "08:00:00", fin, 30)])) == n


def test_duracion_nula_o_cero_no_da_slots_y_se_informa(spark):
    hd = [("a1", 1, "08:00:00", "09:00:00", None), ("a1", 1, "10:00:00", "11:00:00", 0)]
    assert libres(spark, hd=hd) == []
    rangos = d.rangos_por_semana(semanal(spark, hd))
    assert filas(d.rangos_invalidos(rangos), "dur") == [(0,)]


def test_varios_rangos_de_fecha(spark):
    hf = [("h1", "a1", LUNES, "08:00:00", "09:00:00", 30), ("h2", "a1", LUNES, "13:00:00", "14:00:00", 30)]
    assert inicios(spark, hf=hf) == ["08:00", "08:30", "13:00", "13:30"]
    assert inicios(spark, hf=hf, fin_override="primero") == ["08:00", "08:30"]
    # The first range is the one with the least id, whatever its time.
    al_reves = [("h2", *hf[0][1:]), ("h1", *hf[1][1:])]
    assert len(inicios(spark, hf=al_reves, fin_override="primero")) == 4


def test_override_reemplaza_aunque_no_de_slots(spark):
    hd = [("a1", 1, "08:00:00", "09:00:00", 30)]
    assert inicios(spark, hd=hd, hf=[("h", "a1", LUNES, "10:00:00", "10:00:00", 30)]) == []
    assert len(inicios(spark, hd=hd, hf=[("h", "a1", "2026-08-04", "10:00:00", "11:00:00", 30)])) == 2


def test_bloqueos(spark):
    hd = [("a1", 1, "08:00:00", "10:00:00", 30)]
    dia = lambda ini, fin: [("a1", LUNES, ini, fin)]
    assert inicios(spark, hd=hd, b=dia(None, None)) == []
    assert inicios(spark, hd=hd, b=dia(None, "09:00:00")) == []
    assert inicios(spark, hd=hd, b=dia(None, None), restar_bloqueos=False) != []
    # Only the start of a slot is tested and the end of a block is open.
    assert inicios(spark, hd=hd, b=dia("08:15:00", "09:00:00")) == ["08:00", "09:00", "09:30"]
    assert len(inicios(spark, hd=hd, b=dia("08:00:00", None))) == 4
    dos = [("a1", LUNES, "08:00:00", "08:20:00"), ("a1", LUNES, "08:00:00", "09:10:00")]
    assert inicios(spark, hd=hd, b=dos) == ["09:30"]


def test_ocupacion_por_inicio_igual(spark):
    hd = [("a1", 1, "08:00:00", "10:00:00", 30)]
    for estado, quedan in [("pendiente", 3), ("completada", 3), ("no_asistio", 3), ("cancelada", 4)]:
        assert len(inicios(spark, hd=hd, c=[("a1", LUNES, "08:00:00", estado)])) == quedan
    assert len(inicios(spark, hd=hd, c=[("a1", LUNES, "08:10:00", "pendiente")])) == 4
    assert len(inicios(spark, hd=hd, c=[(None, LUNES, "08:00:00", "pendiente")])) == 4


def test_rangos_repetidos_dan_slots_repetidos(spark):
    hd = [("a1", 1, "08:00:00", "09:00:00", 30)] * 2 + [("a1", 1, "08:30:00", "09:30:00", 30)]
    assert inicios(spark, hd=hd) == ["08:00"] * 2 + ["08:30"] * 3 + ["09:00"]


def test_medianoche(spark):
    # Ends wrap before they are compared, so the last slot of a dated range survives.
    hf = [("h", "a1", LUNES, "23:00:00", "23:50:00", 30)]
    assert libres(spark, hf=hf) == [("23:00", "23:30"), ("23:30", "00:00")]
    hd = [("a1", 1, "23:00:00", "24:00:00", 30)]
    assert libres(spark, hd=hd) == [("23:00", "23:30"), ("23:30", "00:00")]


def test_horario_efectivo(spark):
    a = audiologos(spark, [("a1", "a1", "s1", True)])
    hd = semanal(spark, [("a1", 1, "08:00:00", "09:00:00", 30), ("a1", 2, "08:00:00", "09:00:00", 30)])
    hf = fechado(spark, [("h", "a1", LUNES, "10:00:00", "11:00:00", 20)])
    r = d.horario_efectivo(d.pares_de(a, LUNES, "2026-08-05"), hd, hf)
    assert filas(r, "fecha", "hora_inicio", "duracion_cita_min", "es_override") == [
        (dt.date(2026, 8, 3), "10:00:00", 20, True), (dt.date(2026, 8, 4), "08:00:00", 30, False),
    ]


def _a_mano(quien, dias, hd, hf, c, b):
    """The rules, one professional and day at a time."""
    salida = []
    hms = lambda s: f"{s % 86400 // 3600:02d}:{s % 3600 // 60:02d}:{s % 60:02d}"
    seg = lambda t: int(t[:2]) * 3600 + int(t[3:5]) * 60 + int(t[6:8])
    for q in quien:
        for dia in dias:
            if any(x[0] == q and x[1] == dia and x[2] is None for x in b):
                continue
            propios = [x for x in hf if x[1] == q and x[2] == dia]
            rangos = [x[3:] for x in propios] or [
                x[2:] for x in hd if x[0] == q and x[1] == dt.date.fromisoformat(dia).isoweekday() % 7
            ]
            for ini, fin, dur in rangos:
                if not dur:
                    continue
                n = int((seg(fin) - seg(ini)) / 60 / dur + 0.5)
                for k in range(n):
                    s, e = seg(ini) + k * dur * 60, (seg(ini) + (k + 1) * dur * 60) % 86400
                    if propios and e > seg(fin):
                        continue
                    if any(x[0] == q and x[1] == dia and x[2] == hms(s) and x[3] != "cancelada" for x in c):
                        continue
                    if any(
                        x[0] == q and x[1] == dia and x[2] and x[3] and seg(x[2]) <= s < seg(x[3]) for x in b
                    ):
                        continue
                    salida.append((q, dia, hms(s), hms(e)))
    return sorted(salida)


@pytest.mark.parametrize("semilla", range(3))
def test_contra_fuerza_bruta_con_sesgo(spark, semilla):
    """Random tables in which one professional and day holds a third of every table."""
    r = random.Random(semilla)
    quien = [f"a{i}" for i in range(6)]
    dias = [f"2026-08-{i:02d}" for i in range(1, 11)]
    q = lambda: "a0" if r.random() < 1 / 3 else r.choice(quien)
    dia = lambda: dias[2] if r.random() < 1 / 3 else r.choice(dias)
    t = lambda: f"{r.randint(7, 18):02d}:{r.choice([0, 15, 30, 45]):02d}:00"
    hd = [(q(), r.randint(0, 6), t(), t(), r.choice([None, 0, 20, 30, 45])) for _ in range(60)]
    hf = [(f"h{i}", q(), dia(), t(), t(), r.choice([None, 20, 30, 45])) for i in range(30)]
    c = [(q(), dia(), t(), r.choice(["pendiente", "cancelada"])) for _ in range(200)]
    b = [(q(), dia(), r.choice([None, t(), t(), t()]), r.choice([None, t(), t()])) for _ in range(25)]
    hf, b = [(*x[:3], *sorted(x[3:5]), x[5]) for x in hf], [x for x in b if not (x[0] == "a0" and x[2] is None)]
    a = audiologos(spark, [(x, x, "s1", True) for x in quien])
    tablas = (
        semanal(spark, hd), fechado(spark, hf),
        citas(spark, [(str(i), "p", f[0], "s1", f[1], f[2], f[2], f[3], None, None) for i, f in enumerate(c)]),
        bloqueos(spark, [(*f, "m") for f in b]),
    )
    df = d.disponibilidad_rango(a, dias[0], dias[-1], *tablas)
    r1 = filas(df, "audiologo_id", F.col("fecha").cast("string"), "hora_inicio", "hora_fin")
    assert r1 == _a_mano(quien, dias, hd, hf, c, b)
    assert len(r1) > 100
