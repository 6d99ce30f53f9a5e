"""SimHash near-duplicates.

A document's fingerprint has 64 bits: bit i is 1 when more than half of its 4-word shingles'
XXH64 values have it.  Documents link when fingerprints differ in at most ``distancia`` bits.

Search.  Each fingerprint is cut into 32 segments of 2 bits and mapped to the vector of their bit
counts, 0 to 2.  The Manhattan distance of two such vectors is never more than the number of
differing bits.  The 32 coordinates form three grids; when at most 5 bits differ, at most one does in the
segments of some grid, and the Manhattan distance there is at most 1.  So a range join of radius 1 in each
grid, an equality join on the cell and the cells one step above, brings every linked pair together.  A cell
is refined by the bits behind its counts, since a step up by one differing bit leaves one or two patterns:
unrelated fingerprints then meet with probability 12 / 2^22 a grid, not with that of equal counts.  The bits
are then compared exactly.
Fingerprints are joined once each, however many documents share one, so a group of copies counts as
one point.  Links become components by alternating large-star and small-star steps.

Defined results.  Null or wordless text: fingerprint zero, linked like any other.  Repeated rows
keep a row each.  Null ids take part; a component's id is the smallest id that is not null, and
null when it has none.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from turnero.sources.tablas import materializar

TEJAS = 4          # words of a shingle
SEMILLA = 42
DISTANCIA = 4      # the three grids of radius 1 are complete up to 5
BLOQUE = 65_536    # shingles hashed at a time

# Coordinates of the three grids: 2-bit fields 0-10, 11-21 and 22-31.
REJILLAS = [range(0, 11), range(11, 22), range(22, 32)]


def huella(texto: str | None) -> int:
    """Fingerprint as a signed 64-bit number."""
    # bytes.lower and bytes.split act on ASCII alone: A-Z, and 0x20, 0x09-0x0D.
    palabras = (texto or "").encode("utf-8", "surrogatepass").lower().split()
    if not palabras:
        return 0
    n = max(1, len(palabras) - TEJAS + 1)
    cuenta = np.zeros(64, np.int64)
    resumen = xxhash.xxh64_digest
    for i in range(0, n, BLOQUE):
        tramo = palabras[i:i + BLOQUE + TEJAS - 1]
        tejas = zip(*(tramo[k:] for k in range(TEJAS))) if n > 1 or len(tramo) == TEJAS else [tramo]
        valores = b"".join([resumen(b" ".join(t), SEMILLA) for t in tejas])
        bits = np.unpackbits(np.frombuffer(valores, np.uint8).reshape(-1, 8), axis=1)
        cuenta += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * cuenta > n).tobytes(), "big", signed=True)


def con_huella(docs: DataFrame, texto: str = "text", nombre: str = "_huella") -> DataFrame:
    @F.arrow_udf("long")
    def huellas(textos: pa.Array) -> pa.Array:
        return pa.array([huella(t.as_py()) for t in textos], pa.int64())

    return docs.withColumn(nombre, huellas(F.col(texto).cast("string")))


def _long(v: int) -> Column:
    """64-bit pattern as a long literal."""
    return F.lit(v - 2**64 if v >= 2**63 else v).cast("long")


def vector(h: Column) -> Column:
    """Bit counts of the 32 segments, packed in fields of 2 bits."""
    # Clearing the odd bit of each pair keeps the subtraction free of borrows across fields.
    alto = F.shiftrightunsigned(h, 1).bitwiseAND(_long(0x5555555555555555))
    bajo = h.bitwiseAND(_long(0x5555555555555555))
    ambos = alto.bitwiseAND(bajo)
    return F.shiftleft(ambos, 1).bitwiseOR(alto.bitwiseXOR(bajo))


def enlaces(huellas: DataFrame, distancia: int = DISTANCIA) -> DataFrame:
    """Pairs (``a`` < ``b``) of the distinct fingerprints in column ``h`` at most ``distancia`` apart."""
    if distancia > 5:
        raise ValueError("three grids of radius 1 find distances up to 5")
    v = huellas.withColumn("v", vector(F.col("h")))
    bases, sondas = [], []
    for g, campos in enumerate(REJILLAS):
        mascara = _long(sum(3 << (2 * j) for j in campos))
        celda, bits = F.col("v").bitwiseAND(mascara), F.col("h").bitwiseAND(mascara)

        def punto(celda: Column, bits: Column, paso: bool | None = None) -> Column:
            campos = [F.lit(g).alias("rejilla"), celda.alias("celda"), bits.alias("bits")]
            return F.struct(*campos, *([] if paso is None else [F.lit(paso).alias("paso")]))

        bases.append(punto(celda, bits))
        sondas.append(punto(celda, bits, False))
        for j in campos:
            # A count below 2 has a cell one step above: 0 to 1 sets either bit, 1 to 2 the one that is not set.
            campo = F.shiftrightunsigned(F.col("v"), 2 * j).bitwiseAND(F.lit(3).cast("long"))
            sube = F.when(campo == 0, 1).otherwise(3).cast("long")
            arriba = celda.bitwiseXOR(F.shiftleft(sube, 2 * j))
            sondas.append(F.when(campo < 2, punto(arriba, bits.bitwiseOR(F.shiftleft(sube, 2 * j)), True)))
            sondas.append(F.when(campo == 0, punto(arriba, bits.bitwiseOR(_long(2 << (2 * j))), True)))
    base = v.select(F.col("h").alias("b"), F.inline(F.array(*bases)))
    sonda = v.select(
        F.col("h").alias("a"), F.inline(F.filter(F.array(*sondas), lambda s: s.isNotNull()))
    )
    cerca = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distancia
    return (
        sonda.join(base, ["rejilla", "celda", "bits"])
        .filter(cerca & (F.col("paso") | (F.col("a") < F.col("b"))))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )


def componentes(pares: DataFrame) -> DataFrame:
    """``nodo`` and ``raiz``, the least node of its component, of every node that has a link.

    Each round is written to the shared folder; rounds end when the edges stay the same.
    """
    def marca(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()

    e = materializar(pares.select(F.col("b").alias("x"), F.col("a").alias("y")), "aristas")
    antes = None
    while (ahora := marca(e)) != antes:
        antes = ahora
        ambas = e.unionByName(e.select(F.col("y").alias("x"), F.col("x").alias("y")))
        minimo = ambas.groupBy("x").agg(F.min("y").alias("m"))
        minimo = minimo.withColumn("m", F.least("x", "m"))
        grande = materializar(
            ambas.join(minimo, "x").filter(F.col("y") > F.col("x"))
            .select(F.col("y").alias("x"), F.col("m").alias("y")).distinct(), "estrella",
        )
        minimo = grande.groupBy("x").agg(F.min("y").alias("m"))
        e = materializar(
            grande.join(minimo, "x").filter(F.col("y") != F.col("m"))
            .select(F.col("y").alias("x"), F.col("m").alias("y"))
            .unionByName(minimo.select("x", F.col("m").alias("y"))).distinct(), "aristas",
        )
    hojas = e.select(F.col("x").alias("nodo"), F.col("y").alias("raiz"))
    raices = e.select(F.col("y").alias("nodo"), F.col("y").alias("raiz")).distinct()
    return hojas.unionByName(raices)


def grupos(huellas: DataFrame, doc: str = "doc_id", distancia: int = DISTANCIA) -> DataFrame:
    """``h``, ``component_id`` and ``lider`` (the fingerprint whose document that is) per fingerprint."""
    clases = materializar(
        huellas.groupBy(F.col("_huella").alias("h")).agg(F.min(doc).alias("primero")), "clases"
    )
    comp = componentes(enlaces(clases.select("h"), distancia))
    con_raiz = clases.join(comp, F.col("h") == F.col("nodo"), "left").withColumn(
        "raiz", F.coalesce("raiz", "h")
    )
    orden = F.struct(F.col("primero").isNull(), "primero", "h")
    lideres = con_raiz.groupBy("raiz").agg(F.min(orden).alias("_m")).select(
        "raiz", F.col("_m.primero").alias("component_id"), F.col("_m.h").alias("lider")
    )
    return con_raiz.join(lideres, "raiz").select("h", "component_id", "lider")


def casi_duplicados(
    docs: DataFrame, doc: str = "doc_id", texto: str = "text", distancia: int = DISTANCIA
) -> DataFrame:
    """One row per document: id, ``fingerprint`` in 16 hex digits, ``component_id``."""
    filas = docs.select(F.col(doc).alias("doc"), F.col(texto).alias("texto"))
    h = materializar(con_huella(filas, "texto").select("doc", "_huella"), "huellas")
    return h.join(grupos(h, "doc", distancia), F.col("_huella") == F.col("h")).select(
        F.col("doc").alias(doc), F.lower(F.lpad(F.hex("_huella"), 16, "0")).alias("fingerprint"), "component_id"
    )


def uno_por_grupo(
    docs: DataFrame, doc: str = "doc_id", texto: str = "text", distancia: int = DISTANCIA
) -> DataFrame:
    """The rows that stay when each component keeps one document, the one with the smallest id.

    Rows that repeat id and fingerprint of the one that stays count as its copies.
    """
    # The row travels as one struct, so none of its columns can clash with those of this operator.
    con = con_huella(
        docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("fila"),
                    F.col(doc).alias("doc"), F.col(texto).alias("texto")), "texto",
    ).drop("texto")
    h = materializar(con.select("doc", "_huella"), "huellas")
    g = grupos(h, "doc", distancia).filter(F.col("h") == F.col("lider")).select("h", "component_id")
    quedan = con.join(
        g, (F.col("_huella") == F.col("h")) & F.col("doc").eqNullSafe(F.col("component_id"))
    )
    return quedan.dropDuplicates(["doc", "_huella"]).select("fila.*")
