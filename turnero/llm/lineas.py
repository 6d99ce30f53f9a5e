"""Line dedup: repeated passages of several lines, found by content-defined chunks and least passages.

A document's lines are hashed, and a rolling hash over the last ``VENTANA`` line hashes (cyclic
polynomial: rotate and exclusive-or) ends a chunk after each line where its value modulo
``DIVISOR`` is 0.  Boundaries depend on the lines next to them alone, so a passage keeps its inner chunks
wherever it stands.  Chunks of two or more lines that occur again anywhere go, except the first one.

Chunks alone miss short passages and the edges of long ones.  So a document also has its least passages: from
each line with words forward, and from each line with words back, the fewest lines that hold more than
``PASAJE`` words.  Both depend on their own lines alone, and those inside a run of lines of more than
``PASAJE`` words cover it: a line of the run starts one that ends inside, or else lies in the one that ends
with the run.  So every run of more than ``PASAJE`` words that stands somewhere before goes whole, be it
one line or many, wherever else its parts occur.

Chunks and least passages that occur again are joined to runs that match one earlier place, and the runs
are compared byte by byte with that place before they are removed.

How it scales.  A document has fewer than three hashes a line.  The first place of a hash is a minimum,
combined before it moves.  Other places move as numbers and meet it in a join between two exchanges, which
AQE splits for a crowded hash; runs meet the documents they are compared with in the same way.  Only text that
takes part in a comparison moves: documents with a first place once, documents with a repeat once.  All others are
told by a filter of ``BITS_POR_CLAVE`` bits a key, sent to every task, and stay where they are read.  It has at most
``MAX_PAGINAS`` pages of 4 KB; when it is full, more documents than needed move, and none is missed.

Defined results.  Null text counts as empty and comes back empty.  Places go by document id (null
last), text hash and line.  Rows that repeat id and text are one document and come back that often.
A line goes only when the same line stays at an earlier place.  A passage begins and ends with a line that has
words: blank lines at its edges may stay.  Chunks without any visible character are kept.  A run whose
bytes are not those of the earlier place stays, equal hashes or not.  ``removed_chunks`` counts the runs of
lines taken out.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from turnero.sources.tablas import claves_distintas, materializar

VENTANA = 2
DIVISOR = 2
PASAJE = 50  # words
BITS_POR_CLAVE = 16
BITS_POR_PAGINA = 32_768  # of Spark's bitmaps
MAX_PAGINAS = 4096
PALABRA = r"[^\x20\x09-\x0D]+"


def con(valor: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it."""
    return F.transform(F.array(valor), f)[0]


def _rota(h: Column, n: int) -> Column:
    return F.shiftleft(h, n).bitwiseOR(F.shiftrightunsigned(h, 64 - n)) if n else h


def partir(texto: Column) -> Column:
    return F.split(F.coalesce(texto, F.lit("")), "\n", -1)


def cortes(h: Column, ventana: int, divisor: int) -> Column:
    """Chunks of an array of line hashes as an array of (``k``, ``n``): first line, from 0, and lines."""
    n = F.size(h)

    def corta(i: Column) -> Column:
        rueda = h[i]
        for k in range(1, ventana):
            rueda = rueda.bitwiseXOR(_rota(F.coalesce(F.get(h, i - k), F.lit(0)), k))
        return (F.pmod(rueda, F.lit(divisor)) == 0) | (i == n - 1)

    def trozo(e: Column, fin: Column, j: Column) -> Column:
        k = F.when(j == 0, 0).otherwise(F.get(e, j - 1) + 1)
        return F.struct(k.alias("k"), (fin - k + 1).alias("n"))

    finales = F.filter(F.sequence(F.lit(0), n - 1), corta)
    return con(finales, lambda e: F.transform(e, lambda fin, j: trozo(e, fin, j)))


def minimos(w: Column, pasaje: int) -> Column:
    """Least passages of an array of word counts, as an array of (``k``, ``n``).

    ``de`` has the line of every word, so the line some words further on is found at once.  One that ends at a
    line is left out when it also is the least one from its own first line.
    """
    def tramo(a: Column, b: Column) -> Column:
        return F.struct(a.alias("k"), (b - a + 1).alias("n"))

    def con_inicios(de: Column, s: Column) -> Column:
        total = F.size(de)

        def atras(j: Column) -> Column:
            """First line of the least passage that ends with word ``j - 1``."""
            return F.get(de, j - 1 - pasaje)

        def fin(i: Column) -> Column:
            return F.coalesce(F.get(s, i + 1), total)

        adelante = F.transform(F.filter(s, lambda j: j + pasaje < total),
                               lambda j: tramo(F.get(de, j), F.get(de, j + pasaje)))
        solo_atras = F.filter(
            F.transform(s, lambda j, i: F.when((j > pasaje) & (atras(j) == atras(fin(i))),
                                               tramo(atras(fin(i)), F.get(de, j)))),
            lambda t: t.isNotNull())
        return F.concat(adelante, solo_atras)

    def con_lineas(de: Column) -> Column:
        # First word of each line that has words.
        inicios = F.filter(F.sequence(F.lit(0), F.size(de) - 1),
                           lambda j: (j == 0) | (F.get(de, j) != F.get(de, j - 1)))
        return F.when(F.size(de) > pasaje, con(inicios, lambda s: con_inicios(de, s)))

    de = F.flatten(F.transform(w, lambda n, i: F.array_repeat(i, n)))
    return F.coalesce(con(de, con_lineas), F.array().cast("array<struct<k:int,n:int>>"))


def unidades(
    texto: Column, ventana: int = VENTANA, divisor: int = DIVISOR, pasaje: int = PASAJE,
) -> Column:
    """What may repeat in a text: array of (``k``, ``n``, ``h``), first line, lines and hash of the lines."""
    def de_lineas(h: Column, w: Column) -> Column:
        trozos = F.filter(cortes(h, ventana, divisor), lambda t: (t["n"] > 1) & F.exists(
            F.slice(w, t["k"] + 1, t["n"]), lambda x: x > 0))
        return F.transform(F.concat(trozos, minimos(w, pasaje)), lambda t: F.struct(
            t["k"].alias("k"), t["n"].alias("n"), F.xxhash64(F.slice(h, t["k"] + 1, t["n"])).alias("h")))

    return con(partir(texto), lambda lineas: con(
        F.transform(lineas, lambda x: F.xxhash64(x)), lambda h: con(
            F.transform(lineas, lambda x: F.size(F.regexp_extract_all(x, F.lit(PALABRA), F.lit(0)))),
            lambda w: de_lineas(h, w))))


def quiza_en(df: DataFrame, claves: DataFrame, clave: str, cuantas: int) -> DataFrame:
    """Adds ``_quiza``: false when ``clave`` is surely not in ``claves``, which has at most ``cuantas`` keys."""
    paginas = max(1, min(MAX_PAGINAS, -(-cuantas * BITS_POR_CLAVE // BITS_POR_PAGINA)))
    bit = F.pmod(F.xxhash64(clave), F.lit(paginas * BITS_POR_PAGINA))
    filtro = (
        claves.select(bit.alias("_bit")).groupBy(F.expr(f"_bit div {BITS_POR_PAGINA}").alias("_pagina"))
        .agg(F.bitmap_construct_agg(F.col("_bit") % BITS_POR_PAGINA).alias("_mapa"))
    )
    octeto = F.expr(f"conv(hex(substring(_mapa, cast(_bit % {BITS_POR_PAGINA} div 8 as int) + 1, 1)), 16, 10)")
    puesto = F.expr("_bit % 8").cast("int")
    return (
        df.withColumn("_bit", bit)
        # At most MAX_PAGINAS pages.
        .join(F.broadcast(filtro), F.expr(f"_bit div {BITS_POR_PAGINA}") == F.col("_pagina"), "left")
        .withColumn("_quiza", F.coalesce(F.getbit(octeto.cast("int"), puesto) == 1, F.lit(False)))
        .drop("_bit", "_pagina", "_mapa")
    )


def dedup_lineas(
    docs: DataFrame, doc: str = "doc_id", texto: str = "text", ventana: int = VENTANA,
    divisor: int = DIVISOR, pasaje: int = PASAJE,
) -> DataFrame:
    """One row per input row: id, ``text`` without repeated lines, ``removed_chunks``, ``removed_lines``."""
    base = docs.select(F.col(doc).alias("doc"), F.coalesce(F.col(texto), F.lit("")).alias("texto"))
    # One key for a document; a struct may hold a null and still be compared.
    base = base.select(
        F.struct(F.col("doc").isNull().alias("nulo"), "doc", F.xxhash64("texto").alias("th")).alias("d"),
        "texto")
    filas = base.select("d", F.inline(unidades(F.col("texto"), ventana, divisor, pasaje)))
    lugar = F.struct("d", "k")
    # First place of every hash that occurs in two.  Repeated rows are one document: they are one place.
    primeros = materializar(
        filas.groupBy("h").agg(F.min(lugar).alias("primero"), F.max(lugar).alias("otro"))
        .filter(F.col("primero") != F.col("otro"))
        .select(F.col("h").alias("_h"), F.col("primero.d").alias("d0"), F.col("primero.k").alias("k0")),
        "primeros",
    )
    # Repeats that match one earlier document at one distance overlap to runs; a table read back has no
    # partitioning, so both sides move and AQE can split a crowded hash.
    junto = Window.partitionBy("d", "d0", "salto").orderBy("k", "n")
    antes = junto.rowsBetween(Window.unboundedPreceding, -1)
    corridas = materializar(
        filas.join(primeros, F.col("h") == F.col("_h"))
        .filter((F.col("d") != F.col("d0")) | (F.col("k") != F.col("k0")))
        .select("d", "d0", "k", "n", (F.col("k0") - F.col("k")).alias("salto"))
        .withColumn("nueva", F.coalesce(F.max(F.col("k") + F.col("n")).over(antes) < F.col("k"), F.lit(True)))
        .withColumn("corrida", F.sum(F.col("nueva").cast("int")).over(junto))
        .groupBy("d", "d0", "salto", "corrida")
        .agg(F.min("k").alias("k"), F.max(F.col("k") + F.col("n")).alias("fin"))
        .select("d", "d0", "salto", "k", (F.col("fin") - F.col("k")).alias("n")), "corridas",
    )
    cuantas = corridas.count()
    # Documents to compare with, once each.
    fuentes = materializar(
        quiza_en(base, corridas.select(F.col("d0").alias("d")), "d", cuantas).filter("_quiza").drop("_quiza").join(claves_distintas(corridas.select(F.col("d0").alias("d")), ["d"]), "d", "left_semi")
        .dropDuplicates(["d"]).select(F.col("d").alias("_d0"), F.col("texto").alias("fuente")), "fuentes",
    )

    def lineas_de(lineas: Column, k: Column, n: Column) -> Column:
        return F.array_join(F.slice(lineas, k + 1, n), "\n")

    dudosos = (
        corridas.join(fuentes, F.col("d0") == F.col("_d0"))
        .select("d", "k", "n", lineas_de(
            partir(F.col("fuente")), F.col("k") + F.col("salto"), F.col("n")).alias("texto"))
        .groupBy(F.col("d").alias("_d")).agg(F.collect_list(F.struct("k", "n", "texto")).alias("_dudosos"))
    )

    def limpiar(lineas: Column) -> Column:
        iguales = F.filter("_dudosos", lambda c: lineas_de(lineas, c["k"], c["n"]) == c["texto"])
        fuera = F.array_distinct(F.flatten(F.transform(
            iguales, lambda c: F.sequence(c["k"], c["k"] + c["n"] - 1))))
        return con(fuera, lambda f: F.struct(
            F.array_join(F.transform(
                F.array_except(F.sequence(F.lit(0), F.size(lineas) - 1), f), lambda i: F.get(lineas, i)
            ), "\n").alias("texto"),
            F.size(F.array_except(f, F.transform(f, lambda i: i + 1))).cast("long").alias("trozos"),
            F.size(f).cast("long").alias("lineas"),
        ))

    marcados = quiza_en(base, corridas.select("d"), "d", cuantas)
    intactos = marcados.filter(~F.col("_quiza")).select(
        F.col("d.doc").alias(doc), F.col("texto").alias("text"), F.lit(0).cast("long").alias("removed_chunks"),
        F.lit(0).cast("long").alias("removed_lines"))
    return intactos.unionByName(
        marcados.filter("_quiza").join(dudosos, F.col("d") == F.col("_d"), "left")
        .select("d", "texto",
                F.when(F.col("_dudosos").isNotNull(), con(partir(F.col("texto")), limpiar)).alias("_q"))
        .select(
            F.col("d.doc").alias(doc), F.coalesce("_q.texto", "texto").alias("text"),
            F.coalesce("_q.trozos", F.lit(0)).cast("long").alias("removed_chunks"),
            F.coalesce("_q.lineas", F.lit(0)).cast("long").alias("removed_lines"),
        )
    )
