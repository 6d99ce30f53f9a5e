"""Quality classifier by importance resampling.

Two generative models of hashed n-grams are fitted: one on target text (labelled good and not toxic),
one on all raw text.  Words are runs of letters and digits, or of other visible characters, in lower case; n-grams
are words and, with ``ngramas`` 2 as in the registered query and the pipeline, pairs of neighbouring words.
The log ratio of an n-gram compares the times it was seen in target text with the times the raw model expects there,
both raised by ``SUAVIZADO``, so a rare one tells little.  A document's log weight is taken from windows of
``VENTANA`` words: the sum of the ``PEORES`` least log ratios of words of a window and of the ``PEORES_PARES`` least
of pairs that end in it, averaged over the windows by their words.
The plain sum over all words grows with the length of a text, and its many ratios near 0 hide a few telling
ones; the least ones show a few bad words, and windows keep a long text from being judged by its length.
Documents are drawn without replacement in proportion to their weights: Gumbel noise is added to the log weight
and the ``k`` largest sums stay.

``k`` is ``n * (share of target labels + HOLGURA)``: what the labels say is good and clean, and a little more, since
a good document lost costs more than a bad one kept.  The noise is a hash of seed and document id, so a
rerun draws the same documents.

How it scales.  Each task adds up its n-grams in two tables of ``CUBOS`` numbers for words and as many for pairs;
only those move.  The raw model counts every n-gram of every document.  The target model takes at most ``MAX_OBJETIVO``
labelled documents, those with the smallest id hashes, so that their ids may be broadcast.  Log ratios
are fixed-point integers: sums are exact, whatever the order.  The k-th largest sum is found
by counting in ever narrower ranges, never by sorting everything into one place.

Defined results.  A text without words (null, empty, blank) has log weight 0.  Null ids
get one noise value.  Documents tied with the last one drawn all stay.  Repeated rows are drawn alike.
Without good labels every document has log weight 0 and nothing is rejected.
"""

from __future__ import annotations

import itertools
import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from turnero.sources.tablas import materializar

PALABRA = re.compile(r"\w+|[^\w\s]+")
ESPACIO = re.compile(r"\s")
CUBOS = 65_536
SUAVIZADO = 1.0
VENTANA = 512  # words
PEORES = 8
PEORES_PARES = 2
NINGUNO = np.iinfo(np.int64).max  # stands for no pair
SEMILLA = 20_24
HOLGURA = 0.05
MAX_OBJETIVO = 20_000
ESCALA = 1 << 20
MEZCLA = np.uint64(0x9E3779B97F4A7C15)  # the top 16 bits of a product are a pair's bucket, out of CUBOS
BLOQUE = 1 << 18  # characters cut to words at a time
RECUERDOS = 200_000  # words a worker remembers
RANGOS = 4096


class _Cubos(dict):
    """Buckets of words; remembers the first words it meets, so that frequent ones are hashed once."""

    def __missing__(self, palabra: str) -> int:
        cubo = zlib.crc32(palabra.encode("utf-8", "surrogatepass")) % CUBOS
        if len(self) < RECUERDOS:
            self[palabra] = cubo
        return cubo


_CUBOS = _Cubos()


def cubos(texto: str | None):
    """Bucket numbers of a text's words, some ``BLOQUE`` characters at a time, cut at white space."""
    texto, desde = (texto or "").lower(), 0
    while desde < len(texto):
        espacio = ESPACIO.search(texto, desde + BLOQUE)
        hasta = espacio.start() if espacio else len(texto)
        palabras = PALABRA.findall(texto, desde, hasta)
        yield np.fromiter(map(_CUBOS.__getitem__, palabras), np.int64, len(palabras))
        desde = hasta


def rasgos(texto: str | None, ngramas: int):
    """Buckets of a text's words, and of the pairs that end with them, some ``BLOQUE`` characters at a time.

    A pair has buckets from ``CUBOS`` on.  The first word of a text ends none, so the first part has one pair less;
    later parts begin with the pair that spans the cut.
    """
    ultima = np.zeros(0, np.int64)
    for h in cubos(texto):
        pares = np.zeros(0, np.int64)
        if ngramas > 1:
            seguidas = np.concatenate([ultima, h]).astype(np.uint64)
            juntas = (seguidas[:-1] << np.uint64(16)) | seguidas[1:]
            pares = CUBOS + ((juntas * MEZCLA) >> np.uint64(48)).astype(np.int64)
            ultima = h[-1:] if len(h) else ultima
        yield h, pares


def _contador(ngramas: int):
    def contar(lotes):
        """Adds up the n-grams of a partition: all of them, and those of target documents."""
        n = ngramas * CUBOS
        crudo, objetivo = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for lote in lotes:
            for texto, bueno in zip(lote["texto"], lote["bueno"]):
                for h in itertools.chain.from_iterable(rasgos(texto.as_py(), ngramas)):
                    c = np.bincount(h, minlength=n) if len(h) > 4 * n else None
                    for tabla in (crudo, objetivo) if bueno.as_py() else (crudo,):
                        if c is None:
                            np.add.at(tabla, h, 1)
                        else:
                            tabla += c
        hay = np.flatnonzero(crudo)
        yield pa.RecordBatch.from_arrays(
            [pa.array(hay), pa.array(crudo[hay]), pa.array(objetivo[hay])],
            names=["cubo", "crudo", "objetivo"],
        )

    return contar


def ajustar(
    docs: DataFrame, etiquetas: DataFrame, doc: str, texto: str, bueno: Column,
    max_objetivo: int = MAX_OBJETIVO, ngramas: int = 1,
) -> np.ndarray:
    """Log ratio of target to raw model per bucket, as fixed-point integers; words first, then pairs."""
    ejemplos = (
        etiquetas.filter(bueno & F.col(doc).isNotNull()).select(F.col(doc).alias("_id")).distinct()
        .orderBy(F.xxhash64(F.lit(SEMILLA), "_id"), "_id").limit(max_objetivo)
        .withColumn("bueno", F.lit(True))
    )
    filas = (
        docs.select(F.col(doc).alias("_doc"), F.col(texto).cast("string").alias("texto"))
        # At most max_objetivo ids.
        .join(F.broadcast(ejemplos), F.col("_doc") == F.col("_id"), "left")
        .select("texto", F.coalesce("bueno", F.lit(False)).alias("bueno"))
        .mapInArrow(_contador(ngramas), "cubo long, crudo long, objetivo long")
        .groupBy("cubo").agg(F.sum("crudo").alias("crudo"), F.sum("objetivo").alias("objetivo"))
        .collect()  # one row per bucket
    )
    crudo, objetivo = np.zeros((ngramas, CUBOS)), np.zeros((ngramas, CUBOS))
    for f in filas:
        crudo.flat[f["cubo"]], objetivo.flat[f["cubo"]] = f["crudo"], f["objetivo"]
    if not objetivo.any():
        return np.zeros(ngramas * CUBOS, np.int64)
    # Words and pairs are models of their own.
    esperado = crudo * (objetivo.sum(1, keepdims=True) / np.maximum(1, crudo.sum(1, keepdims=True)))
    return np.rint(np.log((objetivo + SUAVIZADO) / (esperado + SUAVIZADO)) * ESCALA).astype(np.int64).ravel()


def _menores(r: np.ndarray, cuantas: int) -> int:
    return int((np.partition(r, cuantas - 1)[:cuantas] if len(r) > cuantas else r).sum())


def peso(razones: np.ndarray, texto: str | None) -> int:
    """Fixed-point log weight of a text; ``razones`` holds pairs when it has more than ``CUBOS`` numbers."""
    suma = palabras = 0
    ngramas = len(razones) // CUBOS
    # What is left of words, and of the pairs that end with them; the pair of the first word is none.
    resto, resto_pares = np.zeros(0, np.int64), np.full(1, NINGUNO)
    for rasgo in itertools.chain(rasgos(texto, ngramas), [None]):
        r, p = resto, resto_pares
        if rasgo is not None:
            r, p = np.concatenate([r, razones[rasgo[0]]]), np.concatenate([p, razones[rasgo[1]]])
        enteras = len(r) if rasgo is None else len(r) // VENTANA * VENTANA
        for i in range(0, enteras, VENTANA):
            hasta = min(i + VENTANA, enteras)
            v, w = r[i:hasta], p[i:hasta]
            w = w[1:] if len(w) and w[0] == NINGUNO else w
            suma += len(v) * (_menores(v, PEORES) + _menores(w, PEORES_PARES))
        palabras += enteras
        resto, resto_pares = r[enteras:], p[enteras:]
    return suma // max(1, palabras)


def log_peso(razones: np.ndarray, texto: Column) -> Column:
    @F.arrow_udf("long")
    def pesar(textos: pa.Array) -> pa.Array:
        return pa.array([peso(razones, t.as_py()) for t in textos], pa.int64())

    # Deterministic, but marked otherwise: a filter on it would compute it a second time.
    return pesar.asNondeterministic()(texto.cast("string"))


def llave(log_peso: Column, doc: Column, semilla: int = SEMILLA) -> Column:
    """Log weight plus Gumbel noise, in millionths."""
    u = (F.xxhash64(F.lit(semilla), doc) / F.lit(2.0**64) + F.lit(0.5)).cast("double")
    u = F.greatest(F.lit(1e-18), F.least(u, F.lit(1 - 1e-15)))
    return F.rint((log_peso / F.lit(float(ESCALA)) - F.log(-F.log(u))) * 1e6).cast("long")


def k_esima(llaves: DataFrame, k: int) -> int | None:
    """The k-th largest value of column ``llave``; None for an empty table."""
    f = llaves.agg(F.min("llave").alias("a"), F.max("llave").alias("b"), F.count("llave").alias("n")).first()
    if not f["n"] or k <= 0:
        return None if not f["n"] else f["b"] + 1
    if k >= f["n"]:
        return f["a"]
    a, b, falta = f["a"], f["b"], k
    while a < b:
        ancho = (b - a) // RANGOS + 1
        rango = F.expr(f"(llave - {a}L) div {ancho}L")
        cuentas = (
            llaves.filter(F.col("llave").between(a, b)).groupBy(rango.alias("r"))
            .agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("r")).collect()  # RANGOS rows at most
        )
        for c in cuentas:
            if falta <= c["n"]:
                a, b = a + c["r"] * ancho, min(b, a + (c["r"] + 1) * ancho - 1)
                break
            falta -= c["n"]
    return a


def remuestrear(
    docs: DataFrame, etiquetas: DataFrame, doc: str = "doc_id", texto: str = "text",
    calidad: str = "quality", toxico: str | None = "toxic", holgura: float = HOLGURA,
    semilla: int = SEMILLA, max_objetivo: int = MAX_OBJETIVO, ngramas: int = 1,
) -> DataFrame:
    """The rows that are drawn, with all their columns and ``log_weight``.

    Target text is labelled good and, when ``toxico`` names a column, not toxic.  ``ngramas`` is the longest n-gram
    that is looked at: 1, words alone, or 2, words and pairs.
    """
    if ngramas not in (1, 2):
        raise ValueError("n-grams are words (1) or words and pairs (2)")
    buena = F.coalesce(F.col(calidad) == 1, F.lit(False))
    objetivo = buena if toxico is None else buena & F.coalesce(F.col(toxico) == 0, F.lit(True))
    razones = ajustar(docs, etiquetas, doc, texto, objetivo, max_objetivo, ngramas)
    parte = etiquetas.filter(F.col(calidad).isNotNull()).agg(F.avg(objetivo.cast("double"))).first()[0]
    # The row travels as one struct, so none of its columns can clash with those of this operator.
    columnas = [c for c in docs.columns if c != "log_weight"]
    pesados = docs.select(
        F.struct(*[docs[c] for c in columnas]).alias("fila"), F.col(doc).alias("doc"),
        log_peso(razones, F.col(texto)).alias("peso"),
    ).withColumn("llave", llave(F.col("peso"), F.col("doc"), semilla))
    llaves = materializar(pesados.select("llave"), "llaves")
    k = llaves.count()
    if parte is not None and razones.any():
        k = math.ceil(k * min(1.0, parte + holgura))
    corte = k_esima(llaves, k)
    return (
        pesados.filter(F.col("llave") >= (0 if corte is None else corte))
        .select("fila.*", (F.col("peso") / F.lit(float(ESCALA))).alias("log_weight"))
    )
