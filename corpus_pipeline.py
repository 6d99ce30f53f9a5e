"""From raw documents to training sequences in five stages.

Each stage takes the documents its predecessor kept, as read back from Parquet, and the folder of the
other tables.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnero.llm.descontaminar import descontaminar
from turnero.llm.fichas import por_fragmentos
from turnero.llm.mezcla import en_orden
from turnero.llm.remuestreo import remuestrear
from turnero.llm.simhash import uno_por_grupo
from turnero.sources.tablas import materializar

COLUMNAS = ["doc_id", "text", "lang", "source", "n_chars"]


def calidad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Importance resampling towards text labelled good."""
    etiquetas = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return remuestrear(docs, etiquetas, ngramas=2).select(*COLUMNAS)


def casi_iguales(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component."""
    return uno_por_grupo(docs).select(*COLUMNAS)


def sin_pruebas(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return descontaminar(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNAS)


def mezclar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the order of the curriculum, repeated as often as the mix takes them."""
    return en_orden(docs).select(*COLUMNAS)


def fichas(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fixed-length token sequences with their slots in the training order."""
    return por_fragmentos(docs)


STAGES = [
    ("quality", calidad),
    ("near_dedup", casi_iguales),
    ("decontamination", sin_pruebas),
    ("mixing", mezclar),
    ("tokens", fichas),
]

# Classifier, SimHash and tokenizer are beyond SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for nombre, etapa in STAGES[:-1]:
        docs = materializar(etapa(spark, docs, sf_dir), f"etapa-{nombre}")
    return STAGES[-1][1](spark, docs, sf_dir)
