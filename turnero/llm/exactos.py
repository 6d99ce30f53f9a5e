"""Exact duplicates by progressive refinement.

Documents are grouped by length, then by the hash of a prefix, then by the hash of the full text;
each step only looks at what the steps before could not tell apart.  Text equality ignores how much and which of
the characters 0x20 and 0x09-0x0D stand between words.

How it scales.  Groups are counts and minima, combined before they move, so a group that holds a
third of all rows arrives as one row per task.  Rows go back to their group by a join between two
exchanges, which AQE splits when a key is crowded.  No text moves.

Defined results.  Null text counts as empty.  Of equal texts the smallest id stays; null ids come
after all others.  Of rows that repeat id and text, one stays.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from turnero.sources.tablas import materializar

PREFIJO = 64  # characters


def normalizado(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def texto_sha256(c: Column) -> Column:
    return F.sha2(normalizado(c), 256)


def repetidos(filas: DataFrame, claves: list[str]) -> DataFrame:
    """Values of ``claves`` that more than one row has."""
    return (
        filas.groupBy(*claves).agg(F.sum("copias").alias("_n")).filter(F.col("_n") > 1)
        .select(*[F.col(c).alias(f"_{c}") for c in claves])
    )


def semi(filas: DataFrame, claves: DataFrame, columnas: list[str]) -> DataFrame:
    """Rows whose ``columnas`` occur in ``claves``, where they have a leading underscore."""
    igual = [F.col(c) == F.col(f"_{c}") for c in columnas]
    return filas.join(claves, igual, "left_semi")


def deduplicar_exactos(docs: DataFrame, doc: str = "doc_id", texto: str = "text") -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    The scan takes length, prefix hash and full hash, so texts are read once and never move; the
    full hash of a row goes on to the grouping only if length and prefix hash are shared.
    """
    norma = normalizado(F.col(texto))
    filas = materializar(
        docs.select(
            F.col(doc).alias("doc"), F.octet_length(norma).alias("largo"),
            F.xxhash64(F.substring(norma, 1, PREFIJO)).alias("inicio"),
            F.unhex(F.sha2(norma, 256)).alias("completo"),
        ).groupBy("doc", "largo", "inicio", "completo").agg(F.count(F.lit(1)).alias("copias")),
        "filas",
    )
    mismo_largo = semi(filas, repetidos(filas, ["largo"]), ["largo"])
    mismo_inicio = semi(
        mismo_largo, repetidos(mismo_largo, ["largo", "inicio"]), ["largo", "inicio"]
    )
    # Joined on the hash alone, the groups move once more: between two exchanges AQE can split the
    # rows of a crowded group.
    grupos = (
        mismo_inicio.groupBy("largo", "inicio", F.col("completo").alias("_completo"))
        .agg(F.min(F.struct(F.col("doc").isNull(), "doc")).alias("_m"),
             F.sum("copias").alias("_total"))
        .filter(F.col("_total") > 1)
        .select("_completo", F.col("_m.doc").alias("_queda"), "_total")
    )
    en_grupo = F.col("_total").isNotNull()
    return (
        filas.join(grupos, F.col("completo") == F.col("_completo"), "left")
        .select(
            F.col("doc").alias(doc),
            F.when(en_grupo, F.col("_queda")).otherwise(F.col("doc")).alias("keep_id"),
            F.coalesce("_total", F.lit(1)).cast("long").alias("group_size"),
            F.lower(F.hex("completo")).alias("text_sha256"),
            F.explode(F.sequence(F.lit(1), F.col("copias").cast("int"))).alias("_vez"),
        )
        .select(
            doc, "keep_id", "group_size",
            (F.col(doc).eqNullSafe(F.col("keep_id")) & (F.col("_vez") == 1)).alias("kept"),
            "text_sha256",
        )
    )
