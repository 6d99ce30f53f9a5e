"""Byte network for languages: held-out accuracy, gradients, whole texts and hard rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnero.llm import idioma as op11

CARPETA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{CARPETA}/documents.parquet").select("doc_id", "text", "lang")


@pytest.fixture(scope="module")
def red(docs):
    return op11.aprender(docs)


def test_acierto_en_apartados(docs, red):
    lenguas = {f["doc_id"]: f["lang"] for f in docs.collect()}
    filas = op11.predecir(docs, red).collect()
    assert len(filas) == len(lenguas)
    for f in filas:
        assert f["held_out"] == (zlib.crc32(str(f["doc_id"]).encode()) % 3 == 1)
        assert 0 <= f["score"] <= 1 and f["lang_pred"] in set(red.lenguas) | {op11.SIN_LENGUA}
    apartados = [f for f in filas if f["held_out"]]
    assert np.mean([lenguas[f["doc_id"]] == f["lang_pred"] for f in apartados]) > 0.98


def test_solo_aprende_de_los_no_apartados(spark, docs, red):
    """Other labels on held-out rows change nothing; neither does the order of the rows."""
    otros = docs.withColumn("lang", F.when(op11.apartado("doc_id"), "zz").otherwise(F.col("lang")))
    otra = op11.aprender(otros.repartition(7).orderBy(F.desc("doc_id")))
    assert otra.lenguas == red.lenguas
    assert all(np.array_equal(red.p[k], otra.p[k]) for k in red.p)


def test_gradientes():
    azar = np.random.default_rng(3)
    red = op11.Red(["a", "b", "c"])
    red.p = {k: x.astype(np.float64) for k, x in red.p.items()}
    v = azar.integers(0, 256, (5, op11.LARGO)).astype(np.uint8)
    y = np.array([0, 1, 2, 1, 0])

    def perdida():
        return -np.log(red.probabilidades(v)[np.arange(5), y]).mean()

    g = red.gradientes(v, y)
    for k in red.p:
        plano, gk = red.p[k].reshape(-1), g[k].reshape(-1)
        for i in np.argsort(-np.abs(gk))[:4]:
            antes = plano[i]
            plano[i] = antes + 1e-6
            mas = perdida()
            plano[i] = antes - 1e-6
            menos = perdida()
            plano[i] = antes
            assert abs((mas - menos) / 2e-6 - gk[i]) < 1e-4


def test_ventanas_cubren_el_texto(red):
    """A text is the weighted mean of its windows, which leave out no byte, and blocks do not matter."""
    texto = ("the and of " * 40 + "der und ein " * 37).encode()
    inicios = range(0, len(texto) - op11.ANCHO + 1, op11.PASO)
    trozos = [texto[i:i + op11.LARGO] for i in inicios]
    assert trozos[-1] and inicios[-1] + op11.LARGO >= len(texto)
    pesos = np.array([sum(chr(b).isalpha() for b in t) for t in trozos])
    p = red.probabilidades(op11.rellenar(trozos)) * pesos[:, None]
    assert np.allclose(op11.puntuar(red, [texto])[0], p.sum(axis=0) / pesos.sum(), atol=1e-6)
    muchos = [texto * 50, b"x", texto]
    assert np.allclose(op11.puntuar(red, muchos)[2], op11.puntuar(red, [texto])[0], atol=1e-6)


def test_casos_limite(spark, red):
    filas = [(None, None, None), (None, "the of and", "en"), (1, "", "en"), (2, "123 .,- \n", "en"),
             (2, "123 .,- \n", "en"), (3, "x" * 300_000, None), (2**62 + 1, "ñ", "es"), (4, "😀", "en")]
    df = spark.createDataFrame(filas, "doc_id long, text string, lang string")
    for c in ("bytes", "held_out", "lengua", "azar", "n", "v"):
        df = df.withColumn(c, F.lit("x"))
    res = op11.predecir(df, red)
    assert res.columns == ["doc_id", "held_out", "lang_pred", "score"]
    salida = sorted(((f["doc_id"] or 0, f["lang_pred"] == "und", f["score"] == 0) for f in res.collect()))
    assert salida == sorted([(0, True, True), (0, False, False), (1, True, True), (2, True, True),
                             (2, True, True), (3, False, False), (2**62 + 1, False, False), (4, True, True)])
    solas = op11.detectar_lengua(df.withColumn("lang", F.lit(None).cast("string")))
    assert {(f["lang_pred"], f["score"]) for f in solas.collect()} == {("und", 0.0)}
    assert op11.detectar_lengua(df).count() == len(filas)
    assert op11.detectar_lengua(df.limit(0)).count() == 0
