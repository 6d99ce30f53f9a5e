"""Language of a text, by a convolutional network over its bytes.

Method.  A text is cut into windows of fixed length in UTF-8 bytes, which overlap by the widest filter
less one, so no byte sequence falls between two.  A window's bytes are embedded; filters of several
widths run over it; each filter's largest response is kept (max pooling), and a softmax layer gives one
probability a language.  A text's probabilities are the mean over all its windows, weighted by
the letters in them.  Embedding, filters and softmax layer are trained together in numpy.

How it scales.  Training sees a bounded sample: at most ``POR_LENGUA`` labelled documents of each of the
``LENGUAS`` most frequent languages, taken by a hash of the id, and at most ``VENTANAS_DOC`` windows of
each, cut where the documents are.  Only these windows reach the driver (``LENGUAS * POR_LENGUA *
VENTANAS_DOC * LARGO`` bytes at most).  Prediction reads every text whole, in batches, without a shuffle;
a batch of windows has a fixed size, so a long text takes time and not memory.

Defined results.  A null text, or one without a letter, is ``und`` with score 0; so is every text when
there is nothing to learn from.  A null language is not learned.  A null id counts as the empty text for
the hash, is not held out, and comes back as null.  Repeated rows give a row each.  Equal probabilities go
to the language that is first by code point.  Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

LARGO = 128
ANCHOS = (2, 3, 4, 5)
FILTROS = 12
DIMENSION = 8
# Bounds of the training sample.
LENGUAS = 256
POR_LENGUA = 600
VENTANAS_DOC = 4
EPOCAS = 4
TANDA = 64
# Windows looked at together.
BLOQUE = 256
SEMILLA = 11
SIN_LENGUA = "und"

ANCHO = max(ANCHOS)
PASO = LARGO - ANCHO + 1


def apartado(c: str) -> Column:
    """True for documents that are held out: crc32 of the id as text leaves 1 when divided by 3."""
    return F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")) % 3 == 1


# ---- Network ----


class Red:
    """Byte embedding, filters of several widths side by side, max pooling, softmax."""

    def __init__(self, lenguas: list[str]):
        azar = np.random.default_rng(SEMILLA)
        n = FILTROS * len(ANCHOS)
        self.lenguas = lenguas
        # A narrow filter has zeros where wider ones go on, so one product serves all widths.
        self.mascara = np.zeros((ANCHO, DIMENSION, n), np.float32)
        for i, ancho in enumerate(ANCHOS):
            self.mascara[:ancho, :, i * FILTROS:(i + 1) * FILTROS] = 1
        self.mascara = self.mascara.reshape(ANCHO * DIMENSION, n)
        self.p = {
            "e": azar.normal(0, 0.5, (256, DIMENSION)),
            "w": azar.normal(0, 1 / np.sqrt(ANCHO * DIMENSION), self.mascara.shape) * self.mascara,
            "b": np.zeros(n),
            "v": azar.normal(0, 1 / np.sqrt(n), (n, len(lenguas))),
            "c": np.zeros(len(lenguas)),
        }
        self.p = {k: x.astype(np.float32) for k, x in self.p.items()}

    def _maximos(self, ventanas: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows spread out by filter position, the largest response of each filter, and its place."""
        x = self.p["e"][ventanas]
        n = len(ventanas)
        tramos = np.lib.stride_tricks.sliding_window_view(x.reshape(n, -1), ANCHO * DIMENSION, axis=1)
        tramos = tramos[:, ::DIMENSION]
        # One small product a window: a product over all windows wakes every core's BLAS thread for nothing.
        z = np.matmul(tramos, self.p["w"])
        return tramos, z, z.max(axis=1) + self.p["b"]

    def probabilidades(self, ventanas: np.ndarray) -> np.ndarray:
        _, _, m = self._maximos(ventanas)
        y = np.maximum(m, 0) @ self.p["v"] + self.p["c"]
        y = np.exp(y - y.max(axis=1, keepdims=True))
        return y / y.sum(axis=1, keepdims=True)

    def gradientes(self, ventanas: np.ndarray, clases: np.ndarray) -> dict[str, np.ndarray]:
        n = len(ventanas)
        tramos, z, m = self._maximos(ventanas)
        lugar = z.argmax(axis=1)
        h = np.maximum(m, 0)
        y = h @ self.p["v"] + self.p["c"]
        y = np.exp(y - y.max(axis=1, keepdims=True))
        y /= y.sum(axis=1, keepdims=True)
        y[np.arange(n), clases] -= 1
        y /= n
        dh = (y @ self.p["v"].T) * (m > 0)
        filas = np.arange(n)[:, None]
        elegidos = tramos[filas, lugar]
        dx = dh[:, :, None] * self.p["w"].T[None]
        de = np.zeros_like(self.p["e"])
        for k in range(ANCHO):
            np.add.at(de, ventanas[filas, lugar + k], dx[:, :, k * DIMENSION:(k + 1) * DIMENSION])
        return {
            "e": de, "w": np.einsum("nfk,nf->kf", elegidos, dh) * self.mascara, "b": dh.sum(axis=0),
            "v": h.T @ y, "c": y.sum(axis=0),
        }


def entrenar(ventanas: np.ndarray, clases: np.ndarray, lenguas: list[str]) -> Red:
    """Adam over shuffled batches; the same windows give the same network."""
    red, azar, paso = Red(lenguas), np.random.default_rng(SEMILLA), 0
    m1 = {k: np.zeros_like(x) for k, x in red.p.items()}
    m2 = {k: np.zeros_like(x) for k, x in red.p.items()}
    for epoca in range(EPOCAS):
        orden = azar.permutation(len(ventanas))
        for i in range(0, len(orden), TANDA):
            tanda, paso = orden[i:i + TANDA], paso + 1
            for k, g in red.gradientes(ventanas[tanda], clases[tanda]).items():
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.99 * m2[k] + 0.01 * g * g
                tasa = 0.01 / (1 + epoca)
                red.p[k] -= (tasa * (m1[k] / (1 - 0.9**paso))
                             / (np.sqrt(m2[k] / (1 - 0.99**paso)) + 1e-7)).astype(np.float32)
    return red


def rellenar(trozos: list[bytes]) -> np.ndarray:
    """Byte strings of at most ``LARGO`` as rows, zeros behind the short ones."""
    return np.frombuffer(b"".join(t.ljust(LARGO, b"\0") for t in trozos), np.uint8).reshape(-1, LARGO)


# ---- Training sample ----


def muestra(docs: DataFrame, id_: str, texto: str, lengua: str) -> DataFrame:
    """Windows (``lengua``, ``bytes``) of the documents to learn from, within the bounds above."""
    usables = docs.filter(~apartado(id_) & F.col(lengua).isNotNull() & F.col(texto).isNotNull())
    cuentas = (
        usables.groupBy(F.col(lengua).cast("string").alias("lengua")).count()
        .orderBy(F.desc("count"), "lengua").limit(LENGUAS).collect()
    )
    if not cuentas:
        return usables.select(F.lit("").alias("lengua"), F.col(texto).cast("binary").alias("bytes")).limit(0)
    # A hash below twice the wanted share leaves about twice as many rows as wanted, whatever the size.
    parte = F.create_map(*[
        F.lit(x) for f in cuentas for x in (f["lengua"], min(1.0, 2 * POR_LENGUA / f["count"]))])
    azar = F.xxhash64(F.coalesce(F.col(id_).cast("string"), F.lit("")), F.lit(SEMILLA))
    filas = usables.select(
        F.col(lengua).cast("string").alias("lengua"), F.col(texto).cast("binary").alias("bytes"),
        azar.alias("azar"),
    ).filter(F.pmod("azar", F.lit(1 << 20)) < parte[F.col("lengua")] * (1 << 20))
    libre = F.greatest(F.length("bytes") - LARGO, F.lit(0)) + 1
    cortes = F.array_distinct(F.array(*[
        F.pmod(F.xxhash64("azar", F.lit(j)), libre).cast("int") for j in range(VENTANAS_DOC)]))
    ventanas = filas.select(
        "lengua", "azar", F.transform(cortes, lambda i: F.substring("bytes", i + 1, F.lit(LARGO))).alias("v"))
    w = Window.partitionBy("lengua").orderBy("azar", "v")
    return (
        ventanas.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= POR_LENGUA)
        .select("lengua", F.explode("v").alias("bytes"))
    )


def aprender(docs: DataFrame, id_: str = "doc_id", texto: str = "text", lengua: str = "lang") -> Red | None:
    """The network trained on the sample of ``docs``; None when there is none."""
    filas = sorted(
        (f["lengua"], bytes(f["bytes"])) for f in muestra(docs, id_, texto, lengua).collect())
    if not filas:
        return None
    lenguas = sorted({x for x, _ in filas})
    clases = np.array([lenguas.index(x) for x, _ in filas])
    return entrenar(rellenar([v for _, v in filas]), clases, lenguas)


# ---- Prediction ----


def _letras() -> np.ndarray:
    """Weight of a byte: 1 for ASCII letters and bytes of longer characters."""
    pesos = np.zeros(256, np.float32)
    pesos[65:91] = pesos[97:123] = pesos[128:] = 1
    return pesos


def puntuar(red: Red, textos: list[bytes]) -> np.ndarray:
    """Probabilities of each text, averaged over all its windows."""
    suma = np.zeros((len(textos), len(red.lenguas)))
    pesos = _letras()

    def sumar(trozos: list[bytes], de: list[int]) -> None:
        ventanas = rellenar(trozos)
        peso = pesos[ventanas].sum(axis=1)
        np.add.at(suma, de, red.probabilidades(ventanas) * peso[:, None])

    trozos, de = [], []
    for i, t in enumerate(textos):
        for desde in range(0, max(1, len(t) - ANCHO + 1), PASO):
            trozos.append(t[desde:desde + LARGO])
            de.append(i)
            if len(trozos) == BLOQUE:
                sumar(trozos, de)
                trozos, de = [], []
    if trozos:
        sumar(trozos, de)
    return suma / np.maximum(suma.sum(axis=1, keepdims=True), 1e-30)


def predecir(docs: DataFrame, red: Red | None, id_: str = "doc_id", texto: str = "text") -> DataFrame:
    """Per row of ``docs``: the id, ``held_out``, ``lang_pred`` and ``score``."""
    filas = docs.select(
        F.col(id_).alias("doc_id"), apartado(id_).alias("held_out"),
        F.when(F.col(texto).rlike(r"\p{L}"), F.col(texto).cast("binary")).alias("bytes"),
    )
    tipo = filas.schema["doc_id"].dataType.simpleString()
    if red is None:
        return filas.select("doc_id", "held_out", F.lit(SIN_LENGUA).alias("lang_pred"), F.lit(0.0).alias("score"))

    def por_tandas(tandas: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in tandas:
            textos = t.column("bytes").to_pylist()
            con_letra = [i for i, b in enumerate(textos) if b is not None]
            lenguas, puntos = [SIN_LENGUA] * len(textos), np.zeros(len(textos))
            if con_letra:
                p = puntuar(red, [textos[i] for i in con_letra])
                puntos[con_letra] = np.clip(p.max(axis=1), 0, 1)
                for i, k in zip(con_letra, p.argmax(axis=1)):
                    lenguas[i] = red.lenguas[k]
            yield pa.RecordBatch.from_arrays(
                [t.column("doc_id"), t.column("held_out"), pa.array(lenguas), pa.array(puntos)],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    return filas.mapInArrow(
        por_tandas, f"doc_id {tipo}, held_out boolean, lang_pred string, score double")


def detectar_lengua(
    docs: DataFrame, id_: str = "doc_id", texto: str = "text", lengua: str = "lang",
) -> DataFrame:
    """Learns from the documents not held out and predicts the language of every document."""
    return predecir(docs, aprender(docs, id_, texto, lengua), id_, texto)
