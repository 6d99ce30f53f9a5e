"""Token ids in training order.

Texts become token ids of a byte-level BPE vocabulary, each ended by ``FIN``, cut into sequences of
``LARGO`` ids (the last one padded).  Sequences are numbered without gaps in the order of the table.  A
keyed Feistel permutation of these numbers, with cycle-walking to stay inside their range, gives
every sequence its slot in the training order.  Slots go by range into shards of fixed-stride records,
so a reader finds slot s at byte (s mod shard rows) * stride of its shard and can resume anywhere.
The registered query and the pipeline write the shards and return what they read back.

How it scales.  Texts are tokenized once, where they are read, and the ids are written to the shared folder
with running counts; one total per task makes the counts global.  Each sequence moves once, to its
shard; shards have a fixed size, and a task writes ``FRAGMENTOS_POR_TAREA`` of them.  The query and the pipeline
write all shards in ``TANDAS`` turns, each a range of slots: every turn reads the ids again, but only the
sequences of one turn are in shuffle files at a time.  The numbers follow the files and splits of the input: equal files
read with equal settings give equal slots.

Defined results.  Null and empty texts are one sequence with the end mark alone.  Repeated rows each get
their own sequences.  A null document id is written as the least 64-bit number.  An empty table
gives an empty result.  Strings that look like control tokens are ordinary text.
"""

from __future__ import annotations

import base64
import math
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from turnero.sources.tablas import carpeta_de_trabajo, materializar

VOCABULARIO = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# The split pattern that belongs to the vocabulary, and a free id as end of text.
PATRON = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
FIN = 50256
LARGO = 512
FILAS_POR_FRAGMENTO = 4096
CLAVE = 20_24
RONDAS = 6
FRAGMENTOS_POR_TAREA = 16  # consecutive shards that one task writes, about 70 MB
TANDAS = 4  # turns in which all shards are written
REGISTROS = 1024  # records read at a time
# Schemes of Spark's file systems with what Arrow calls them.
ESQUEMAS = {"file": "file", "hdfs": "hdfs", "viewfs": "viewfs", "s3": "s3", "s3a": "s3", "gs": "gs",
            "abfs": "abfs", "abfss": "abfss"}
CABEZA = np.dtype([("doc", "<i8"), ("orden", "<u4"), ("n", "<u4")])
SIN_ID = -(2**63)

_POR_PROCESO: dict = {}


def codificador(vocabulario: bytes):
    """Function from text to its token ids as little-endian 16-bit bytes, end mark included."""
    llave = hash(vocabulario)
    if llave not in _POR_PROCESO:
        import tiktoken

        rangos = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulario.splitlines())}
        if max(rangos.values()) >= FIN:
            raise ValueError("the vocabulary has no room for the end mark")
        _POR_PROCESO[llave] = tiktoken.Encoding(
            "vocabulario", pat_str=PATRON, mergeable_ranks=rangos, special_tokens={}).encode_ordinary
    codificar = _POR_PROCESO[llave]
    return lambda texto: np.frombuffer(array("H", [*codificar(texto or ""), FIN]), np.uint16).astype("<u2").tobytes()


def leer_vocabulario(spark: SparkSession, ruta: str) -> bytes:
    """The vocabulary file, about a megabyte, read by the driver and sent with the tasks."""
    if "://" in ruta:
        return bytes(spark.read.format("binaryFile").load(ruta).first()["content"])
    with open(ruta, "rb") as f:
        return f.read()


# ---- Permutation ----


def _mezclar(x: np.ndarray, ronda: int, clave: int) -> np.ndarray:
    x = x + np.uint64((clave * 0x9E3779B97F4A7C15 + ronda * 0xD1B54A32D192ED03) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permutar(numeros: np.ndarray, n: int, clave: int = CLAVE, inversa: bool = False) -> np.ndarray:
    """Keyed permutation of 0..n-1, or its inverse.

    A balanced Feistel network permutes the next even power of two; a value outside 0..n-1 is
    permuted again until it falls inside, which takes fewer than four steps on average.
    """
    mitad = np.uint64(max(1, math.ceil(max(1, n - 1).bit_length() / 2)))
    mascara = (np.uint64(1) << mitad) - np.uint64(1)
    salida = np.asarray(numeros, np.uint64).copy()
    faltan = np.arange(len(salida))
    while len(faltan):
        x = salida[faltan]
        a, b = x >> mitad, x & mascara
        for r in reversed(range(RONDAS)) if inversa else range(RONDAS):
            if inversa:
                a, b = b ^ (_mezclar(a, r, clave) & mascara), a
            else:
                a, b = b, a ^ (_mezclar(b, r, clave) & mascara)
        salida[faltan] = (a << mitad) | b
        faltan = faltan[salida[faltan] >= n]
    return salida.astype(np.int64)


# ---- Sequences ----


def con_fichas(docs: DataFrame, doc: str, texto: str, vocabulario: str, largo: int) -> DataFrame:
    """``ids`` of every row, the task that made them and the sequences the task made before.

    Written once: from here on the numbers are fixed, whatever is computed again.
    """
    datos = leer_vocabulario(docs.sparkSession, vocabulario)

    def codificar(lotes):
        ids, tarea, antes = codificador(datos), TaskContext.get().partitionId(), 0
        for lote in lotes:
            salida = [ids(t.as_py()) for t in lote["texto"]]
            cuantas = np.array([-(-len(i) // (2 * largo)) for i in salida], np.int64)
            yield pa.RecordBatch.from_arrays([
                lote["doc"], pa.array(np.full(len(salida), tarea)),
                pa.array(antes + np.cumsum(cuantas) - cuantas), pa.array(cuantas),
                pa.array(salida, pa.binary()),
            ], names=["doc", "tarea", "antes", "cuantas", "ids"])
            antes += int(cuantas.sum())

    filas = docs.select(F.col(doc).cast("long").alias("doc"), F.col(texto).cast("string").alias("texto"))
    return materializar(
        filas.mapInArrow(codificar, "doc long, tarea long, antes long, cuantas long, ids binary"),
        "fichas", compression="zstd",
    )


def secuencias(
    docs: DataFrame, doc: str = "doc_id", texto: str = "text", vocabulario: str = VOCABULARIO,
    largo: int = LARGO, clave: int = CLAVE, filas_por_fragmento: int = FILAS_POR_FRAGMENTO,
) -> DataFrame:
    """One row per sequence, in shards sorted by slot.

    Columns: ``slot``, ``shard``, ``offset`` (bytes into the shard), document id, ``seq_no``,
    ``n_tokens`` (without padding) and ``tokens`` (``largo`` little-endian 16-bit ids).
    """
    return en_puestos(*numeradas(docs, doc, texto, vocabulario, largo), doc, largo, clave, filas_por_fragmento)


def numeradas(
    docs: DataFrame, doc: str, texto: str, vocabulario: str, largo: int,
) -> tuple[DataFrame, dict[int, int], int]:
    """Token ids of all rows, the number of the first sequence of each task, and the number of sequences."""
    filas = con_fichas(docs, doc, texto, vocabulario, largo)
    # One row for each task.
    por_tarea = filas.groupBy("tarea").agg(F.sum("cuantas").alias("n")).orderBy("tarea").collect()
    bases, n = {}, 0
    for f in por_tarea:
        bases[f["tarea"]] = n
        n += f["n"]
    return filas, bases, n


def en_puestos(
    filas: DataFrame, bases: dict[int, int], n: int, doc: str, largo: int, clave: int, filas_por_fragmento: int,
    desde: int = 0, hasta: int | None = None,
) -> DataFrame:
    """The sequences of slots from ``desde`` to before ``hasta``, a whole number of tasks' shards, see ``secuencias``."""
    paso = CABEZA.itemsize + 2 * largo
    hasta = n if hasta is None else min(n, hasta)

    def cortar(lotes):
        for lote in lotes:
            docs_, tareas, antes, ids = (lote[c] for c in ("doc", "tarea", "antes", "ids"))
            cuantas = -(-pc.binary_length(ids).to_numpy(zero_copy_only=False).astype(np.int64) // (2 * largo))
            inicios = np.array([bases[t] + a for t, a in zip(tareas.to_pylist(), antes.to_pylist())], np.int64)
            fila = np.repeat(np.arange(len(ids)), cuantas)
            orden = np.arange(len(fila)) - np.repeat(np.cumsum(cuantas) - cuantas, cuantas)
            puestos = permutar(inicios[fila] + orden, n, clave)
            van = np.flatnonzero((puestos >= desde) & (puestos < hasta))
            fila, orden = fila[van], orden[van]
            bytes_ = [memoryview(x.as_buffer()) for x in ids]
            trozos = [bytes(bytes_[f][o:o + 2 * largo]) for f, o in zip(fila.tolist(), (orden * 2 * largo).tolist())]
            yield pa.RecordBatch.from_arrays([
                pa.array(puestos[van]), docs_.take(pa.array(fila)),
                pa.array(orden), pa.array([len(t) // 2 for t in trozos], pa.int64()),
                pa.array([t.ljust(2 * largo, b"\0") for t in trozos], pa.binary()),
            ], names=["slot", "doc", "seq_no", "n_tokens", "tokens"])

    fragmento, por_tarea = F.expr(f"slot div {filas_por_fragmento}L"), filas_por_fragmento * FRAGMENTOS_POR_TAREA
    return (
        filas.select("doc", "tarea", "antes", "ids")
        .mapInArrow(cortar, "slot long, doc long, seq_no long, n_tokens long, tokens binary")
        .withColumn("shard", fragmento)
        # Slots are 0..n-1, so the ranges are known without a sample: some shards in a row are one partition.
        .repartitionById(max(1, -(-(hasta - desde) // por_tarea)), F.expr(f"cast((slot - {desde}L) div {por_tarea}L as int)"))
        .sortWithinPartitions("slot")
        .select("slot", "shard", ((F.col("slot") % filas_por_fragmento) * paso).alias("offset"),
                F.col("doc").alias(doc), "seq_no", "n_tokens", "tokens")
    )


# ---- Files ----


def uri(spark: SparkSession, ruta: str) -> tuple[str, str]:
    """``ruta`` as Spark resolves it (a bare path is on the default file system), and the same for Arrow."""
    camino = spark._jvm.org.apache.hadoop.fs.Path(ruta)
    if (dado := camino.toUri().getScheme()) and dado not in ESQUEMAS:
        raise ValueError(f"no way to write records to {ruta}")
    completa = camino.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(camino).toString()
    esquema, resto = completa.split(":", 1)
    if esquema not in ESQUEMAS:
        raise ValueError(f"no way to write records to {completa}")
    if esquema == "file":
        resto = "//" + resto if not resto.startswith("//") else resto
    return completa, f"{ESQUEMAS[esquema]}:{resto}".rstrip("/")


def escribir_fragmentos(sec: DataFrame, ruta: str, doc: str = "doc_id") -> DataFrame:
    """Writes the shards as files of fixed-stride records and returns the list of them.

    ``ruta`` is a folder that every executor can write, with a scheme or on the default file system.  A shard is
    written under a temporary name and then renamed; a retried task writes the same bytes again and replaces
    what the earlier attempt left.  A record is document id (int64),
    place in the document (uint32), token count (uint32) and the ids (uint16 each).
    """
    _, destino = uri(sec.sparkSession, ruta)

    def escribir(lotes):
        sistema, carpeta = pafs.FileSystem.from_uri(destino)
        sistema.create_dir(carpeta, recursive=True)
        intento = TaskContext.get().taskAttemptId()
        abierto = None
        for lote in lotes:
            for f in lote.to_pylist():
                if abierto is None or abierto[0] != f["shard"]:
                    if abierto:
                        yield _cerrar(sistema, carpeta, intento, *abierto)
                    archivo = sistema.open_output_stream(f"{carpeta}/_{f['shard']:06d}.{intento}")
                    abierto = [f["shard"], archivo, f["slot"], 0, 0]
                cabeza = np.array([(SIN_ID if f["doc"] is None else f["doc"], f["seq_no"], f["n_tokens"])],
                                  CABEZA).tobytes()
                abierto[1].write(cabeza + f["tokens"])
                abierto[3] += 1
                abierto[4] += len(cabeza) + len(f["tokens"])
        if abierto:
            yield _cerrar(sistema, carpeta, intento, *abierto)

    return materializar(
        sec.select("slot", "shard", F.col(doc).alias("doc"), "seq_no", "n_tokens", "tokens")
        .mapInArrow(escribir, "shard long, first_slot long, rows long, bytes long"), "fragmentos",
    )


def _cerrar(sistema, carpeta, intento, fragmento, archivo, primero, filas, octetos):
    archivo.close()
    final = f"{carpeta}/{fragmento:06d}.bin"
    if sistema.get_file_info(final).type != pafs.FileType.NotFound:
        sistema.delete_file(final)  # not every file system renames onto a file
    sistema.move(f"{carpeta}/_{fragmento:06d}.{intento}", final)
    return pa.RecordBatch.from_pylist(
        [{"shard": fragmento, "first_slot": primero, "rows": filas, "bytes": octetos}])


def leer_fragmentos(
    spark: SparkSession, ruta: str, largo: int = LARGO, filas_por_fragmento: int = FILAS_POR_FRAGMENTO,
    desde: int = 0,
) -> DataFrame:
    """Records of written shards from slot ``desde`` on: slot, document id, place, token count and ids.

    Earlier shards are not opened, and the shard of ``desde`` is read from that record's byte on.
    """
    tipo = np.dtype([*CABEZA.descr, ("ids", "<u2", (largo,))])
    esquema = pa.schema([("slot", pa.int64()), ("doc_id", pa.int64()), ("seq_no", pa.int64()),
                         ("n_tokens", pa.int64()), ("tokens", pa.binary())])
    de_spark, raiz = uri(spark, ruta)

    def registros(fragmento):
        sistema, archivo = pafs.FileSystem.from_uri(f"{raiz}/{fragmento:06d}.bin")
        slot = max(desde, fragmento * filas_por_fragmento)
        with sistema.open_input_file(archivo) as f:
            f.seek((slot - fragmento * filas_por_fragmento) * tipo.itemsize)
            while datos := f.read(REGISTROS * tipo.itemsize):
                r = np.frombuffer(datos, tipo)
                yield pa.RecordBatch.from_arrays([
                    pa.array(slot + np.arange(len(r))),
                    pa.array(r["doc"].astype(np.int64), mask=r["doc"] == SIN_ID),
                    pa.array(r["orden"].astype(np.int64)), pa.array(r["n"].astype(np.int64)),
                    pa.array([x.tobytes() for x in r["ids"]], pa.binary()),
                ], schema=esquema)
                slot += len(r)

    def partir(lotes):
        for lote in lotes:
            for fragmento in lote["shard"].to_pylist():
                yield from registros(fragmento)

    return (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(de_spark)
        .select(F.regexp_extract("path", r"(\d+)\.bin$", 1).cast("long").alias("shard"))
        .filter(F.col("shard") >= desde // filas_por_fragmento)
        .mapInArrow(partir, "slot long, doc_id long, seq_no long, n_tokens long, tokens binary")
    )


def por_fragmentos(docs: DataFrame) -> DataFrame:
    """``secuencias`` written as shards to a working folder, as read back from them."""
    ruta = carpeta_de_trabajo(docs.sparkSession, "secuencias")
    filas, bases, n = numeradas(docs, "doc_id", "text", VOCABULARIO, LARGO)
    por_tarea = FILAS_POR_FRAGMENTO * FRAGMENTOS_POR_TAREA
    tanda = max(1, -(-n // (por_tarea * TANDAS))) * por_tarea
    for desde in range(0, n, tanda):
        escribir_fragmentos(en_puestos(
            filas, bases, n, "doc_id", LARGO, CLAVE, FILAS_POR_FRAGMENTO, desde, desde + tanda), ruta)
    if not n:
        leidos = docs.sparkSession.createDataFrame(
            [], "slot long, doc_id long, seq_no long, n_tokens long, tokens binary")
    else:
        leidos = leer_fragmentos(docs.sparkSession, ruta, LARGO, FILAS_POR_FRAGMENTO)
    fila = F.col("slot") % FILAS_POR_FRAGMENTO
    return leidos.select(
        "slot", F.expr(f"slot div {FILAS_POR_FRAGMENTO}L").alias("shard"),
        (fila * (CABEZA.itemsize + 2 * LARGO)).alias("offset"), "doc_id", "seq_no", "n_tokens", "tokens")
