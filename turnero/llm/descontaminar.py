"""Benchmark decontamination by spaced seeds.

Benchmark items and documents are cut into tokens: runs of letters and digits, lower case.  A mask keeps
some positions of a window of ``TRAMO`` tokens and ignores the others, so a substituted word at an
ignored place leaves the hash of the kept ones equal.  Hashes of all windows of all documents are joined
with those of the benchmark; each hit lines the item up with the document, and the tokens
of the alignment are compared: a document is contaminated by an item when, in some ``VENTANA`` aligned
tokens in a row (the whole item if it is shorter), at least ``PARECIDO`` of them are equal.

An item shorter than a window cannot be seeded; it must stand in the document whole, token by token, and is
found by the hash of all its tokens.

How it scales.  Window hashes meet the benchmark's by an equi join; how, is left to Spark's size statistics, and
nothing is hinted.  Of the windows only hits move on, each alignment once; texts move once, to meet their hits.
The token array of a document is built once however many hits it has, and its hits are no more than its
windows times the items that share one.

Defined results.  Null texts and texts without a token are never contaminated, and an item without a token is
in no document.  Of a longer item at least ``TRAMO`` aligned tokens must lie in the document.  Items with equal
tokens are reported under the least id.  Rows that repeat id and text are one document.  A null document id is reported as
null.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from turnero.sources.tablas import materializar

TRAMO = 8
# Kept positions of the masks.  Wherever the substitutions stand that VENTANA and PARECIDO tolerate, some
# window of the aligned tokens keeps clear of them under one of these masks, so no overlap is missed.
MASCARAS = [(0, 1, 2, 3, 4), (0, 1, 2, 5, 6), (0, 1, 3, 6, 7), (2, 3, 4, 6, 7)]
VENTANA = 13
PARECIDO = 0.8


def con(valor: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it."""
    return F.transform(F.array(valor), f)[0]


def fichas(texto: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(texto.cast("string"), F.lit(""))),
                                F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def semillas(texto: Column) -> Column:
    """Per window an array with one hash for each mask; empty for a text shorter than a window."""
    def ventana(h: Column, i: Column) -> Column:
        return F.array(*[F.xxhash64(F.lit(m), *[F.get(h, i + p) for p in mascara])
                         for m, mascara in enumerate(MASCARAS)])

    def ventanas(h: Column) -> Column:
        n = F.size(h)
        lugares = F.when(n >= TRAMO, F.sequence(F.lit(0), F.greatest(F.lit(0), n - TRAMO)))
        return F.coalesce(F.transform(lugares, lambda i: ventana(h, i)),
                          F.array().cast("array<array<bigint>>"))

    return con(F.transform(fichas(texto), lambda t: F.xxhash64(t)), ventanas)


def ventanas_de(df: DataFrame, *claves: str) -> DataFrame:
    """One row per window and mask: ``claves``, ``lugar``, ``s``."""
    por_lugar = df.select(*claves, F.posexplode(semillas(F.col("texto"))).alias("lugar", "ss"))
    return por_lugar.select(*claves, "lugar", F.explode("ss").alias("s"))


def aciertos(docs: DataFrame, pruebas: DataFrame) -> DataFrame:
    """Alignments (``doc``, ``th``, ``item``, ``desfase``) that some window, or a whole short item, supports."""
    s = materializar(
        ventanas_de(pruebas, "item").select("item", F.col("lugar").alias("en"), F.col("s").alias("sp"))
        .distinct(), "semillas",
    )
    largos = (
        ventanas_de(docs, "doc", "th").join(s, F.col("s") == F.col("sp"))
        .select("doc", "th", "item", (F.col("lugar") - F.col("en")).alias("desfase")).distinct()
    )
    cortos = pruebas.filter(F.size("fichas").between(1, TRAMO - 1))
    # At most TRAMO - 1 sizes.
    tamanos = sorted(f["n"] for f in cortos.select(F.size("fichas").alias("n")).distinct().collect())
    if not tamanos:
        return largos
    enteros = cortos.select("item", F.xxhash64(F.transform("fichas", lambda t: F.xxhash64(t))).alias("sp"))
    return largos.unionByName(
        tramos_enteros(docs, tamanos).join(enteros, F.col("s") == F.col("sp"))
        .select("doc", "th", "item", F.col("lugar").alias("desfase")).distinct()
    )


def tramos_enteros(docs: DataFrame, tamanos: list[int]) -> DataFrame:
    """One row per run of each of the sizes: ``doc``, ``th``, ``lugar`` and the hash ``s`` of its tokens."""
    def de_largo(h: Column, k: int) -> Column:
        lugares = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(h) - k))
        tramos = F.transform(lugares, lambda i: F.struct(
            i.alias("lugar"), F.xxhash64(F.slice(h, i + 1, k)).alias("s")))
        return F.when(F.size(h) >= k, tramos).otherwise(F.array().cast("array<struct<lugar:int,s:bigint>>"))

    def todos(h: Column) -> Column:
        return F.flatten(F.array(*[de_largo(h, k) for k in tamanos]))

    hashes = F.transform(fichas(F.col("texto")), lambda t: F.xxhash64(t))
    return docs.select("doc", "th", F.explode(con(hashes, todos)).alias("v")).select("doc", "th", "v.*")


def coincidencia(doc: Column, item: Column, desfase: Column) -> Column:
    """Most equal tokens in any window of the alignment, out of ``min(VENTANA, size of item)``."""
    n = F.size(item)
    ancho = F.least(F.lit(VENTANA), n)
    iguales = F.transform(item, lambda t, j: F.coalesce(F.get(doc, desfase + j) == t, F.lit(False))
                          .cast("int"))
    return con(iguales, lambda m: F.array_max(F.transform(
        F.sequence(F.lit(0), n - ancho),
        lambda i: F.aggregate(F.slice(m, i + 1, ancho), F.lit(0), lambda a, x: a + x),
    )))


def _hallados(
    docs: DataFrame, pruebas: DataFrame, doc: str, texto: str, item: str, texto_item: str,
) -> DataFrame:
    """Alignments that hold: ``doc``, ``th`` (hash of the text) and ``p``, the item with its equal tokens."""
    base = docs.select(F.col(doc).alias("doc"), F.col(texto).alias("texto"))
    base = base.withColumn("th", F.xxhash64("texto"))
    items = materializar(
        pruebas.select(F.col(item).alias("item"), F.col(texto_item).alias("texto"))
        .withColumn("fichas", fichas(F.col("texto"))).groupBy("fichas")
        .agg(F.min("item").alias("item"), F.min("texto").alias("texto")), "items",
    )
    por_doc = (
        aciertos(base, items).join(items.select("item", "fichas"), "item")
        .groupBy("doc", "th").agg(F.collect_list(F.struct("item", "desfase", "fichas")).alias("aciertos"))
        .select(F.col("doc").alias("_doc"), F.col("th").alias("_th"), "aciertos")
    )

    def revisar(d: Column) -> Column:
        puntos = F.transform(F.col("aciertos"), lambda a: F.struct(
            a["item"].alias("item"), coincidencia(d, a["fichas"], a["desfase"]).alias("iguales"),
            F.least(F.lit(VENTANA), F.size(a["fichas"])).alias("ancho")))
        return F.filter(puntos, lambda p: p["iguales"] >= F.when(p["ancho"] < TRAMO, p["ancho"]).otherwise(
            F.ceil(p["ancho"] * F.lit(PARECIDO))))

    return (
        base.join(por_doc, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("th") == F.col("_th")))
        .select("doc", "th", F.explode(con(fichas(F.col("texto")), revisar)).alias("p"))
    )


def contaminados(
    docs: DataFrame, pruebas: DataFrame, doc: str = "doc_id", texto: str = "text",
    item: str = "item_id", texto_item: str = "text",
) -> DataFrame:
    """One row per document and item that overlap: both ids, ``matched`` and ``window`` tokens."""
    return (
        _hallados(docs, pruebas, doc, texto, item, texto_item)
        .groupBy(F.col("doc").alias(doc), F.col("p.item").alias(item))
        .agg(F.max("p.iguales").cast("long").alias("matched"),
             F.max("p.ancho").cast("long").alias("window"))
    )


def descontaminar(
    docs: DataFrame, pruebas: DataFrame, doc: str = "doc_id", texto: str = "text",
    item: str = "item_id", texto_item: str = "text",
) -> DataFrame:
    """The rows of documents that overlap no item.  Rows with a null id are judged by their text too."""
    malos = materializar(
        _hallados(docs, pruebas, doc, texto, item, texto_item)
        .select(F.col("doc").alias("_doc"), F.col("th").alias("_th")).distinct(), "contaminados",
    )
    con_llave = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("todo"),
        F.col(doc).alias("doc"), F.xxhash64(F.col(texto)).alias("th"),
    )
    return con_llave.join(
        malos, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("th") == F.col("_th")), "left_anti").select("todo.*")
