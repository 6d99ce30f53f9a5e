"""Streaming intake equals one batch, also when a batch is run again."""

import pytest

from tests.tablas_prueba import estado, filas
from tests.test_reservas import A, SOLICITUD, lote_al_azar, solicitudes
from turnero.operators.reservas import reservar
from turnero.streaming import reservas_stream as reservas_stream_mod
from turnero.streaming.reservas_stream import (
    compactar as reservas_stream_mod_compactar, confirmado, decisiones, estado_en, lotes, procesar_lote, reservas_stream,
)

PACIENTE = ("id", "nombre", "telefono", "email", "eps")
CITA = ("id", "paciente_id", "audiologo_id", "fecha", "hora_inicio", "hora_fin", "estado")


def _comparar(spark, carpeta, base, lista):
    de_una = reservar(solicitudes(spark, lista), base)
    final = estado_en(spark, base, carpeta)
    assert filas(final.pacientes, *PACIENTE) == filas(de_una.pacientes, *PACIENTE)
    assert filas(final.citas, *CITA) == filas(de_una.citas, *CITA)
    dec = decisiones(spark, carpeta, SOLICITUD)
    assert dec.count() == len(lista)
    assert filas(dec.filter("motivo_rechazo is not null"), "solicitud_id", "motivo_rechazo") == filas(
        de_una.rechazadas, "solicitud_id", "motivo_rechazo"
    )


def test_flujo_igual_a_lote(spark, tmp_path):
    lista, citas, pac = lote_al_azar(5, 60)
    lista.sort(key=lambda f: f[1])
    base = estado(spark, citas, pac, A)
    entrada, carpeta = str(tmp_path / "entrada"), str(tmp_path / "tablas")

    def llega(parte):
        solicitudes(spark, parte).coalesce(1).write.mode("append").parquet(entrada)

    def corre():
        fuente = spark.readStream.schema(SOLICITUD).parquet(entrada)
        reservas_stream(fuente, base, carpeta, str(tmp_path / "chk")).awaitTermination()

    for desde in (0, 25, 40):
        llega(lista[desde:{0: 25, 25: 40, 40: 60}[desde]])
        corre()
    _comparar(spark, carpeta, base, lista)


def test_repetir_un_lote_no_cambia_nada(spark, tmp_path):
    lista, citas, pac = lote_al_azar(6, 40)
    lista.sort(key=lambda f: f[1])
    base, carpeta = estado(spark, citas, pac, A), str(tmp_path)
    for lote, parte in enumerate((lista[:20], lista[20:])):
        procesar_lote(solicitudes(spark, parte), lote, base, carpeta)
        procesar_lote(solicitudes(spark, parte), lote, base, carpeta)
    _comparar(spark, carpeta, base, lista)


def test_otro_checkpoint_sigue_donde_quedo(spark, tmp_path):
    """A new checkpoint starts at batch 0 again and erases nothing."""
    lista, citas, pac = lote_al_azar(7, 40)
    lista.sort(key=lambda f: f[1])
    base, carpeta = estado(spark, citas, pac, A), str(tmp_path / "tablas")
    for k, parte in enumerate((lista[:20], lista[20:])):
        entrada = str(tmp_path / f"entrada{k}")
        solicitudes(spark, parte).coalesce(1).write.parquet(entrada)
        fuente = spark.readStream.schema(SOLICITUD).parquet(entrada)
        reservas_stream(fuente, base, carpeta, str(tmp_path / f"chk{k}")).awaitTermination()
    assert {f["lote"] for f in lotes(spark, carpeta).collect()} == {0}
    _comparar(spark, carpeta, base, lista)


def test_lote_a_medias_no_cuenta(spark, tmp_path, monkeypatch):
    """A batch that breaks off before its commit row leaves nothing behind for readers."""
    lista, citas, pac = lote_al_azar(8, 30)
    lista.sort(key=lambda f: f[1])
    base, carpeta = estado(spark, citas, pac, A), str(tmp_path)
    assert decisiones(spark, carpeta, SOLICITUD).isEmpty()
    procesar_lote(solicitudes(spark, lista[:15]), 0, base, carpeta)
    with monkeypatch.context() as m:
        m.setattr(reservas_stream_mod, "citas_de", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            procesar_lote(solicitudes(spark, lista[15:]), 1, base, carpeta)
    assert decisiones(spark, carpeta, SOLICITUD).count() == 15
    procesar_lote(solicitudes(spark, lista[15:]), 1, base, carpeta)
    _comparar(spark, carpeta, base, lista)


def test_entregadas_dos_veces(spark, tmp_path):
    """Requests that come again, in their batch and in later ones, are decided once."""
    lista, citas, pac = lote_al_azar(9, 30)
    lista.sort(key=lambda f: f[1])
    base, carpeta = estado(spark, citas, pac, A), str(tmp_path)
    tarde = [(f[0], f[1] + 1000, *f[2:]) for f in lista[:12]]
    procesar_lote(solicitudes(spark, lista[:15] + tarde[:5]), 0, base, carpeta)
    procesar_lote(solicitudes(spark, lista[10:] + tarde), 1, base, carpeta)
    _comparar(spark, carpeta, base, lista)
    res = reservar(solicitudes(spark, lista + tarde + lista), base)
    assert filas(res.citas, *CITA) == filas(reservar(solicitudes(spark, lista), base).citas, *CITA)
    assert res.aceptadas.count() + res.rechazadas.count() == len(lista)


def test_compactacion(spark, tmp_path):
    """With merges on the way the tables come out the same, and a repeated batch is still skipped."""
    lista, citas, pac = lote_al_azar(10, 40)
    lista.sort(key=lambda f: f[1])
    base, carpeta = estado(spark, citas, pac, A), str(tmp_path)
    for lote in range(4):
        parte = solicitudes(spark, lista[lote * 10:lote * 10 + 10])
        procesar_lote(parte, lote, base, carpeta, juntar=2)
    procesar_lote(parte, 3, base, carpeta, juntar=2)
    assert [n for _, n in confirmado(spark, carpeta).vivos] == [2] and lotes(spark, carpeta).count() == 4
    _comparar(spark, carpeta, base, lista)


def test_cincuenta_lotes(spark, tmp_path):
    """What a batch has to read grows with the logarithm of the batches before it."""
    carpeta, vivos = str(tmp_path), []
    esquema = spark.range(1).schema
    for lote in range(50):
        c = reservas_stream_mod.confirmado(spark, carpeta)
        vivos.append(len(c.vivos))
        reservas_stream_mod._guardar(spark.range(lote, lote + 1).coalesce(1), carpeta, "decisiones", f"i{lote}")
        nuevo = reservas_stream_mod.Confirmado(c.version + 1, [*c.vivos, (f"i{lote}", 0)], {"q": lote})
        reservas_stream_mod._confirmar(spark, carpeta, nuevo, "q", lote, f"i{lote}")
        reservas_stream_mod_compactar(spark, carpeta, {"decisiones": esquema}, 4)
    # With 4 to a level, 50 is 302 in base 4.
    c = confirmado(spark, carpeta)
    assert [n for _, n in c.vivos] == [2, 2, 2, 0, 0] and max(vivos) <= 9 and c.avance == {"q": 49}
    todas = reservas_stream_mod._parte(spark, carpeta, "decisiones", esquema)
    assert sorted(f["id"] for f in todas.collect()) == list(range(50)) and len(todas.inputFiles()) <= 9
    assert lotes(spark, carpeta).count() == 50


def _falla_a_medias(spark, carpeta, partes, juntar):
    """Merges the first parts and fails before the commit row."""
    if len(confirmado(spark, carpeta).vivos) == 2:
        with pytest.MonkeyPatch.context() as m:
            m.setattr(reservas_stream_mod, "_confirmar", lambda *a: 1 / 0)
            reservas_stream_mod_compactar(spark, carpeta, partes, juntar)


def test_compactar_a_medias_no_cuenta(spark, tmp_path, monkeypatch):
    """A merge that breaks off leaves the batches in place."""
    lista, citas, pac = lote_al_azar(11, 20)
    lista.sort(key=lambda f: f[1])
    base, carpeta = estado(spark, citas, pac, A), str(tmp_path)
    procesar_lote(solicitudes(spark, lista[:10]), 0, base, carpeta, juntar=2)
    with monkeypatch.context() as m:
        m.setattr(reservas_stream_mod, "compactar", lambda *a: _falla_a_medias(*a))
        with pytest.raises(ZeroDivisionError):
            procesar_lote(solicitudes(spark, lista[10:]), 1, base, carpeta, juntar=2)
    assert len(confirmado(spark, carpeta).vivos) == 2
    _comparar(spark, carpeta, base, lista)
