"""Mixing sources to target weights along a curriculum that changes over time.

Training time runs from 0 to 1.  Each source has a weight schedule, linear between knots; its integral
gives the source's cumulative token demand.  Documents of a source stand in a fixed order (by the MD5 of
seed and id), pass after pass, until the demand ends; a copy of a document stands at the token count
before it, and inverting the demand at that count gives its training position.  Sorting by position,
by range, gives the training order.

Totals.  Sources by code point, null last, weigh ``PESOS``, repeating, and share ``PRESUPUESTO`` of all
sizes.  A target stops at ``MAX_PASES`` times its source's size; what is over is shared again by weight
among the others until nobody is above.  The last copy taken is cut where the target is reached.

How it scales.  The order within a source has buckets, the first digits of the MD5.  Sizes add up
per bucket, buckets per source, and only then rows within a bucket: a source with a third of all
rows is spread over all of its buckets.  The number of buckets follows the number of rows, and the
order doesn't depend on it.  One row per source meets in a single place: sources are configured by hand.

Defined results.  Null text has size 0.  Documents of size 0 take nothing and have no position.  Repeated
rows are separate copies.  A null source is a source.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from turnero.sources.tablas import materializar

PESOS = (3, 1, 2)
PRESUPUESTO = (3, 2)  # numerator and denominator: 150 %
MAX_PASES = 2
SEMILLA = "mezcla"
FILAS_POR_CUBO = 50_000
# Relative weight of a source at times 0, 0.5 and 1, by its place among the sources, repeating.
# Each schedule has integral 1, so a target is met whatever the schedule.
CURRICULOS = ((1.5, 1.0, 0.5), (0.5, 1.0, 1.5), (0.8, 1.2, 0.8))
NUDOS = (0.0, 0.5, 1.0)


def tamano(texto: Column) -> Column:
    """Words of a text."""
    c = F.coalesce(texto.cast("string"), F.lit(""))
    return F.size(F.regexp_extract_all(c, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).cast("long")


def metas(fuentes: DataFrame) -> DataFrame:
    """Adds ``lugar``, ``peso`` and ``target`` to one row per source with its ``source_size``.

    With sources by size per weight, the first j are at their limit for some j; the share of the
    others is then one number, and the right j is the first at which nobody else is above.
    """
    num, den = PRESUPUESTO
    orden = Window.orderBy(F.col("fuente").isNull(), "fuente")
    lugar = F.row_number().over(orden) - 1
    peso = F.element_at(F.array(*[F.lit(p) for p in PESOS]), F.pmod("lugar", F.lit(len(PESOS))) + 1)
    f = fuentes.withColumn("lugar", lugar).withColumn("peso", peso.cast("long"))
    # a/b < c/d is compared as a*d < c*b in the order: exact for whole numbers up to 2**53.
    por_limite = Window.orderBy(F.col("source_size") / F.col("peso"), "lugar")
    antes = por_limite.rowsBetween(Window.unboundedPreceding, -1)
    todo = Window.partitionBy(F.lit(1))
    f = f.withColumns({
        "total": F.sum("source_size").over(todo), "pesos": F.sum("peso").over(todo),
        "limitados": F.coalesce(F.sum("source_size").over(antes), F.lit(0)),
        "pesos_limitados": F.coalesce(F.sum("peso").over(antes), F.lit(0)),
    })
    # Budget left times den, and weight left, if those before this one are at their limit.
    f = f.withColumns({
        "resto": F.col("total") * num - F.col("limitados") * (MAX_PASES * den),
        "pesan": F.col("pesos") - F.col("pesos_limitados"),
    })
    cabe = F.col("resto") * F.col("peso") <= F.col("source_size") * F.col("pesan") * (MAX_PASES * den)
    # Rows from the first that fits on share what is left there; those before are at their limit.
    primera = F.min(F.when(cabe, F.struct(F.col("source_size") / F.col("peso"), "lugar", "resto", "pesan"))
                    ).over(todo)
    f = f.withColumn("cabe", cabe).withColumn("primera", primera)
    libre = F.max(F.col("cabe")).over(
        por_limite.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    parte = (F.col("primera.resto") * F.col("peso")).cast("double") / (F.col("primera.pesan") * den)
    return f.withColumn("libre", libre).withColumn(
        "target", F.when(F.col("libre"), parte).otherwise((F.col("source_size") * MAX_PASES).cast("double"))
    ).select("fuente", "source_size", "lugar", "peso", "target")


def con_orden(tallas: DataFrame) -> DataFrame:
    """Adds ``antes``: tokens of the same source before each row, in the source's order."""
    n = tallas.count()
    cifras = 1
    while 16**cifras * FILAS_POR_CUBO < n:
        cifras += 1
    filas = tallas.withColumn(
        "llave", F.md5(F.concat_ws("|", F.lit(SEMILLA), F.coalesce(F.col("doc").cast("string"), F.lit(""))))
    ).withColumn("cubo", F.substring("llave", 1, cifras))
    por_cubo = filas.groupBy("fuente", "cubo").agg(F.sum("size").alias("suma"))
    hasta = Window.partitionBy("fuente").orderBy("cubo").rowsBetween(Window.unboundedPreceding, -1)
    base = por_cubo.select(
        F.col("fuente").alias("_f"), F.col("cubo").alias("_c"),
        F.coalesce(F.sum("suma").over(hasta), F.lit(0)).alias("base"),
    )
    dentro = Window.partitionBy("fuente", "cubo").orderBy("llave", "doc", "th").rowsBetween(
        Window.unboundedPreceding, -1)
    filas = filas.withColumn("previo", F.coalesce(F.sum("size").over(dentro), F.lit(0)))
    return filas.join(
        base, F.col("fuente").eqNullSafe(F.col("_f")) & (F.col("cubo") == F.col("_c"))
    ).withColumn("antes", F.col("base") + F.col("previo")).drop("_f", "_c", "base", "previo", "cubo")


def posicion(demanda: Column, meta: Column, lugar: Column) -> Column:
    """Time at which a source's cumulative demand reaches ``demanda`` of ``meta``."""
    x = F.when(meta > 0, F.least(F.lit(1.0), demanda / meta))
    salida = None
    for j, curva in enumerate(CURRICULOS):
        tiempo, acumulado, tramos = None, 0.0, []
        for (t0, t1), (w0, w1) in zip(zip(NUDOS, NUDOS[1:]), zip(curva, curva[1:])):
            area, d = (t1 - t0) * (w0 + w1) / 2, (w1 - w0) / (t1 - t0)
            y = x - F.lit(acumulado)
            t = F.lit(t0) + (
                y / F.lit(w0) if d == 0
                else (F.sqrt(F.greatest(F.lit(0.0), F.lit(w0 * w0) + F.lit(2 * d) * y)) - F.lit(w0)) / F.lit(d)
            )
            acumulado += area
            tramos.append((acumulado, t))
        for limite, t in reversed(tramos):
            tiempo = t if tiempo is None else F.when(x <= F.lit(limite), t).otherwise(tiempo)
        es = F.pmod(lugar, F.lit(len(CURRICULOS))) == j
        salida = F.when(es, tiempo) if salida is None else salida.when(es, tiempo)
    return F.round(salida, 6)


def _copias(docs: DataFrame, doc: str, texto: str, fuente: str) -> DataFrame:
    """``copias`` with the text hash, which tells apart rows that share an id."""
    tallas = materializar(
        docs.select(F.col(doc).alias("doc"), F.col(fuente).cast("string").alias("fuente"),
                    F.xxhash64(F.col(texto).cast("string")).alias("th"),
                    tamano(F.col(texto)).alias("size")), "tallas",
    )
    # At most one row for each source.
    f = metas(tallas.groupBy("fuente").agg(F.sum("size").alias("source_size")))
    f = f.withColumnRenamed("fuente", "_fuente")
    filas = con_orden(tallas).join(f, F.col("fuente").eqNullSafe(F.col("_fuente")))
    tope = F.round("target").cast("long")

    def copia(pase: int) -> Column:
        inicio = F.col("antes") + F.col("source_size") * pase
        palabras = F.greatest(F.lit(0), F.least(F.col("size"), tope - inicio))
        return F.struct(posicion(inicio, F.col("target"), F.col("lugar")).alias("position"),
                        palabras.alias("words"))

    tomadas = F.filter(F.array(*[copia(p) for p in range(MAX_PASES)]), lambda c: c["words"] > 0)
    return filas.withColumn("copies", tomadas).select(
        "doc", "th", "fuente", "size", "source_size", "target", "copies",
        F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c["words"]).alias("taken"),
    )


def copias(
    docs: DataFrame, doc: str = "doc_id", texto: str = "text", fuente: str = "source"
) -> DataFrame:
    """Sizes, targets and what is taken: one row per document, with its ``copies``.

    ``copies`` is an array of (``position``, ``words``), one element for each time it is taken.
    """
    c = _copias(docs, doc, texto, fuente)
    return c.select(F.col("doc").alias(doc), F.col("fuente").alias(fuente),
                    *[x for x in c.columns if x not in ("doc", "th", "fuente")])


def en_orden(
    docs: DataFrame, doc: str = "doc_id", texto: str = "text", fuente: str = "source"
) -> DataFrame:
    """The documents of the mix in training order, repeated as often as taken, with ``position``.

    A document is one place in the order, so a copy of which the target takes at least half is
    given whole and one of which it takes less is left out.  ``position`` replaces a column of that name.
    """
    enteras = F.filter("copies", lambda x: x["words"] * 2 >= F.col("size"))
    turnos = _copias(docs, doc, texto, fuente).select(
        F.col("doc").alias("_doc"), F.col("fuente").alias("_fuente"), F.col("th").alias("_th"),
        F.explode(F.transform(enteras, lambda x: x["position"])).alias("position"),
    )
    filas = docs.select(
        F.struct(*[docs[x] for x in docs.columns if x != "position"]).alias("fila"),
        F.col(doc).alias("doc"), F.col(fuente).cast("string").alias("fuente"),
        F.xxhash64(F.col(texto).cast("string")).alias("th"),
    ).dropDuplicates(["doc", "fuente", "th"])  # each of the rows has copies of its own in turnos
    return (
        filas.join(turnos, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("th") == F.col("_th"))
                   & F.col("fuente").eqNullSafe(F.col("_fuente")))
        .orderBy("position", "doc", "th").select("fila.*", "position")
    )
