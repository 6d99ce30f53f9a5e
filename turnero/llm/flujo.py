"""Digests of ordered groups that need not fit in memory."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

FILAS = 10_000


def huella_en_orden(
    df: DataFrame, clave: list[str], orden: list[str], texto: str, separador: str,
    primeros: list[str] = [], sumas: list[str] = [],
) -> DataFrame:
    """Per group: SHA-256 of its texts in order, joined by ``separador``, as ``sha256``.

    ``primeros`` are taken from the group's first row and ``sumas`` are added up.  Rows arrive sorted, and
    only the digest of the group under way is held, so a group of any size takes no memory; by its
    definition the digest of one group is computed by one task.  A null key is a group; texts are not null.
    """
    filas = df.select(*dict.fromkeys([*clave, *orden, *primeros, *sumas, texto]))
    salida = T.StructType([
        *[filas.schema[c] for c in (*clave, *primeros)], *[T.StructField(c, T.LongType()) for c in sumas],
        T.StructField("sha256", T.StringType()),
    ])
    sep = separador.encode()

    def plegar(tandas: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hechas, llave, fijos, cuentas, suma = [], None, (), [], None
        esquema = None
        for t in tandas:
            if esquema is None:
                esquema = pa.schema([
                    *[t.schema.field(c) for c in (*clave, *primeros)],
                    *[pa.field(c, pa.int64()) for c in sumas], pa.field("sha256", pa.string()),
                ])
            llaves = list(zip(*[t.column(c).to_pylist() for c in clave]))
            textos = t.column(texto).to_pylist()
            fijas = [t.column(c).to_pylist() for c in primeros]
            sumandos = [t.column(c).to_pylist() for c in sumas]
            for i, k in enumerate(llaves):
                if suma is not None and k == llave:
                    suma.update(sep)
                else:
                    if suma is not None:
                        hechas.append((*llave, *fijos, *cuentas, suma.hexdigest()))
                    llave, suma = k, hashlib.sha256()
                    fijos, cuentas = [c[i] for c in fijas], [0] * len(sumas)
                suma.update(textos[i].encode())
                for j, c in enumerate(sumandos):
                    cuentas[j] += c[i]
            if len(hechas) >= FILAS:
                yield _tanda(hechas, esquema)
                hechas = []
        if suma is not None:
            hechas.append((*llave, *fijos, *cuentas, suma.hexdigest()))
            yield _tanda(hechas, esquema)

    return (
        filas.repartition(*clave).sortWithinPartitions(*clave, *orden).mapInArrow(plegar, salida)
    )


def _tanda(filas: list[tuple], esquema: pa.Schema) -> pa.RecordBatch:
    columnas = zip(*filas)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columnas, esquema)], schema=esquema)
