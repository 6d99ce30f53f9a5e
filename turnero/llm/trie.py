"""Prefix trie of conversations, from sorted sequences and range minima over their common prefixes.

Method.  A turn is the digest of its role and text, and a conversation the sequence of its digests.  Equal
sequences become one with a count.  The distinct ones are sorted, so that the members of any prefix are an
interval of ranks.  Over the lengths of the common prefixes of neighbours (LCP) stands a sparse table of
minima of every power-of-two stretch, and each candidate prefix searches by halving steps, on its
own, how far to the left and to the right all LCPs are at least its depth.  A candidate whose interval
starts at its own rank is a node.  Counts, least members and sums over subtrees are differences of running
sums, or minima, over intervals; no stack is kept.

How it scales.  Equal sequences are merged before they are sorted: ids in stretches of ``TRECHO`` first, then
in order, so a conversation that makes up a third of all is one row to the sort.  The sorted ranks are dealt
out by range and looked at in blocks.  Only prefixes of a block's first or last sequence can have members
in other blocks; they are merged by key, and the tree they form, at most two paths a block, is summed up in one
task.  All others are finished in their block.  Of texts, only digests and lengths move after the first step.
One conversation must fit in a task as digests, 24 bytes a turn.

Defined results.  A null role or text counts as empty; rows without conversation id belong to no
conversation; null turns come first, equal turns go by (role, text).  Repeated rows are turns of their own.
No conversations give no nodes, not even a root.  Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from turnero.llm.flujo import huella_en_orden
from turnero.operators.numeracion import numerar
from turnero.sources.tablas import materializar

# Conversation ids whose members are joined before they move as one row.
TRECHO = 4096
# Turns of one block; an Arrow batch is cut where it holds more.
TURNOS_BLOQUE = 1_000_000
BYTES_ID = 16

NODO = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
PARTE = (
    "borde boolean, bloque binary, clave binary, padre binary, conv_id long, parent_conv_id long, depth long,"
    " n long, hijos long, hojas long, ahorro long, peso long, fin string"
)


# ---- Sequences ----


def secuencias(
    conversaciones: DataFrame, conv: str = "conv_id", turno: str = "turn", rol: str = "role", texto: str = "text",
) -> DataFrame:
    """Per conversation its turns in order, each as digest (hex) of role and text and bytes of its text."""
    def lleno(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(""))

    turnos = conversaciones.filter(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv_id"), F.col(turno).alias("turno"),
        lleno(rol).alias("rol"), lleno(texto).alias("texto"),
    )
    orden = [F.col("turno").asc_nulls_first(), F.col("rol"), F.col("texto")]
    fichas = numerar(turnos, ["conv_id"], orden, "lugar").select(
        "conv_id", "lugar",
        F.md5(F.concat(F.length("rol").cast("string"), F.lit(":"), "rol", "texto")).alias("id"),
        F.octet_length("texto").cast("long").alias("peso"),
    )
    return fichas.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("lugar", "id", "peso"))).alias("t")
    ).select("conv_id", F.transform("t", lambda x: F.struct(x["id"].alias("id"), x["peso"].alias("peso"))).alias("turnos"))


def reconstruir(seqs: DataFrame, cabezas: Column, largo: Column, maximo: int) -> DataFrame:
    """Gives each conversation the first ``largo`` turns of conversation ``cabezas`` in place of its own.

    ``largo`` is at most ``maximo``, so only that many turns of a conversation are sent to others.
    """
    propias = seqs.select("conv_id", "turnos", cabezas.alias("cabeza"), largo.cast("int").alias("h"))
    de = seqs.select(F.col("conv_id").alias("cabeza"), F.slice("turnos", 1, maximo).alias("inicio"))
    inicio = F.coalesce(F.slice("inicio", F.lit(1), F.col("h")), F.slice("turnos", 1, 0))
    resto = F.slice("turnos", F.col("h") + 1, F.greatest(F.size("turnos"), F.lit(1)))
    return propias.join(de, "cabeza", "left").select("conv_id", F.concat(inicio, resto).alias("turnos"))


def distintas(seqs: DataFrame) -> DataFrame:
    """Each distinct sequence once: ``seq``, ``pesos``, members ``n``, least member, digest of all member ids."""
    filas = seqs.select(
        "conv_id", F.unhex(F.array_join(F.col("turnos.id"), "")).alias("seq"),
        F.col("turnos.peso").alias("pesos"),
    ).withColumn("h", F.md5("seq"))
    trechos = filas.groupBy("h", F.floor(F.col("conv_id") / TRECHO).alias("trecho")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"),
        F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("menor"),
        F.first("seq").alias("seq"), F.first("pesos").alias("pesos"),
    )
    return huella_en_orden(trechos, ["h"], ["trecho"], "ids", ",", ["menor", "seq", "pesos"], ["n"]).select(
        "seq", "pesos", "n", "menor", F.col("sha256").alias("fin"))


# ---- One block of sorted sequences ----


class Minimos:
    """Sparse table: ``niveles[k][i]`` is the least of the 2**k values from i on."""

    def __init__(self, valores: np.ndarray):
        self.niveles = [valores]
        while 2 * (ancho := 1 << (len(self.niveles) - 1)) <= len(valores):
            v = self.niveles[-1]
            self.niveles.append(np.minimum(v[:-ancho], v[ancho:]))

    def entre(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Least value from a to b, both included."""
        k = np.frexp(b - a + 1)[1] - 1
        res = np.empty(len(a), self.niveles[0].dtype)
        for j, v in enumerate(self.niveles):
            s = k == j
            res[s] = np.minimum(v[a[s]], v[b[s] - (1 << j) + 1])
        return res

    def hasta(self, desde: np.ndarray, minimo: np.ndarray, lado: int) -> np.ndarray:
        """Farthest rank that is reached from ``desde`` over values of at least ``minimo``.

        The value at rank i stands between i - 1 and i; ``lado`` is 1 to the right and -1 to the left.
        """
        lugar = desde.copy()
        for k in reversed(range(len(self.niveles))):
            v, ancho = self.niveles[k], 1 << k
            inicio = lugar + 1 if lado > 0 else lugar - ancho + 1
            dentro = (inicio >= 1) & (inicio < len(v))
            sigue = dentro & (v[np.where(dentro, inicio, 0)] >= minimo)
            lugar[sigue] += lado * ancho
        return lugar


def comunes(ids: np.ndarray, largos: np.ndarray, inicio: np.ndarray) -> np.ndarray:
    """LCP of each sequence with the one before it; -1 for the first, which has none."""
    lcp = np.zeros(len(largos), np.int64)
    pares, d = np.arange(1, len(largos)), 0
    while len(pares):
        pares = pares[np.minimum(largos[pares], largos[pares - 1]) > d]
        pares = pares[(ids[inicio[pares] + d] == ids[inicio[pares - 1] + d]).all(axis=1)]
        d += 1
        lcp[pares] = d
    lcp[0] = -1
    return lcp


def _cadena(ids: np.ndarray) -> list[bytes]:
    """Key of every prefix of a sequence: each hashes the one before it and the next digest."""
    claves = [b""]
    for x in ids:
        claves.append(hashlib.md5(claves[-1] + x.tobytes()).digest())
    return claves


def nodos_de_bloque(
    seqs: list[bytes], pesos: list[list[int]], n: np.ndarray, menor: np.ndarray, fines: list[str],
) -> dict[str, list]:
    """Nodes of a block of distinct sorted sequences, as columns of ``PARTE``.

    Prefixes of the first or last sequence (``borde``) come with the sums over what is finished inside
    the block; all others are final, but for the parent's conversation when the parent is such a prefix.
    """
    m = len(seqs)
    largos = np.array([len(s) // BYTES_ID for s in seqs])
    inicio = np.concatenate([[0], np.cumsum(largos)])
    ids = np.frombuffer(b"".join(seqs), ">u8").reshape(-1, 2)
    peso = np.array([p for ps in pesos for p in ps], np.int64)

    lcp = Minimos(comunes(ids, largos, inicio))
    fila = np.repeat(np.arange(m), largos)
    prof = np.arange(len(fila)) - inicio[fila] + 1
    izq, der = lcp.hasta(fila, prof, -1), lcp.hasta(fila, prof, 1)

    # Candidates in order of (rank, depth); the nodes among them are in preorder.
    cand = np.flatnonzero(izq == fila)
    r, d, fin = fila[cand], prof[cand], der[cand]
    numero = np.full(len(fila), -1)
    numero[cand] = np.arange(len(cand))
    # The candidate one turn shorter, taken at the left end of its interval, is the parent.
    padre = np.where(d > 1, numero[inicio[izq[cand - 1]] + d - 2], -1)

    suma_n = np.concatenate([[0], np.cumsum(n)])
    miembros = suma_n[fin + 1] - suma_n[r]
    minimos = Minimos(menor)
    conv = minimos.entre(r, fin)
    hijos = np.bincount(padre[padre >= 0], minlength=len(cand))
    hasta = np.searchsorted(r, fin, "right")

    borde = (r == 0) | (fin == m - 1)
    dentro = ~borde
    valor = (miembros - 1) * peso[cand]

    def bajo(v: np.ndarray) -> np.ndarray:
        """Sum over each subtree of what is finished here."""
        s = np.concatenate([[0], np.cumsum(np.where(dentro, v, 0))])
        return s[hasta] - s[np.arange(len(cand))]

    hojas, ahorro = bajo(hijos == 0), bajo(valor)
    hijos_dentro = np.bincount(padre[dentro & (padre >= 0)], minlength=len(cand))

    claves = {(0, k): c for k, c in enumerate(_cadena(ids[:inicio[1]]))}
    ultima = _cadena(ids[inicio[m - 1]:])
    bloque = hashlib.md5(seqs[0]).digest()

    def clave(i: int) -> bytes:
        return claves[0, d[i]] if r[i] == 0 else ultima[d[i]]

    raiz_hijos = int((dentro & (d == 1)).sum())
    s_hojas, s_ahorro = int(((hijos == 0) & dentro).sum()), int(valor[dentro].sum())
    filas = [(
        True, bloque, b"", None, int(menor.min()), None, 0, int(n.sum()), raiz_hijos, s_hojas, s_ahorro, 0,
        fines[0] if largos[0] == 0 else None,
    )]
    for i in range(len(cand)):
        p, b = int(padre[i]), bool(borde[i])
        de_borde = p < 0 or bool(borde[p])
        clave_padre = (clave(p) if p >= 0 else b"") if de_borde else None
        filas.append((
            b, bloque, clave(i) if b else None, clave_padre, int(conv[i]),
            None if de_borde else int(conv[p]), int(d[i]), int(miembros[i]),
            int(hijos_dentro[i] if b else hijos[i]), int(hojas[i]), int(ahorro[i]), int(peso[cand[i]]),
            fines[r[i]] if d[i] == largos[r[i]] else None,
        ))
    nombres = [c.split()[0] for c in PARTE.split(", ")]
    return dict(zip(nombres, map(list, zip(*filas))))


def _por_bloques(tandas: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tipos = {"boolean": pa.bool_(), "binary": pa.binary(), "long": pa.int64(), "string": pa.string()}
    esquema = pa.schema([(c.split()[0], tipos[c.split()[1]]) for c in PARTE.split(", ")])
    for t in tandas:
        seqs, pesos, fines = (t.column(c).to_pylist() for c in ("seq", "pesos", "fin"))
        n, menor = (t.column(c).to_numpy(zero_copy_only=False) for c in ("n", "menor"))
        if not seqs:
            continue
        corte = np.cumsum([len(p) for p in pesos]) // TURNOS_BLOQUE
        limites = [0, *(np.flatnonzero(np.diff(corte)) + 1), len(seqs)]
        for a, b in zip(limites, limites[1:]):
            columnas = nodos_de_bloque(seqs[a:b], pesos[a:b], n[a:b], menor[a:b], fines[a:b])
            yield pa.RecordBatch.from_pydict(columnas, schema=esquema)


# ---- Prefixes that cross blocks ----


def _sumar_arbol(tandas: Iterator) -> Iterator:
    """Sums up the tree of the prefixes at block ends, from the deepest upwards."""
    import pandas as pd

    tandas = list(tandas)
    if not tandas or not sum(len(t) for t in tandas):
        return
    t = pd.concat(tandas, ignore_index=True)
    lugar = {bytes(k): i for i, k in enumerate(t["clave"])}
    padre = np.array([-1 if p is None else lugar[bytes(p)] for p in t["padre"]])
    prof = t["depth"].to_numpy()
    hijos = t["hijos"].to_numpy() + np.bincount(padre[padre >= 0], minlength=len(t))
    hojas = (hijos == 0).astype(np.int64)
    ahorro = (t["n"].to_numpy() - 1) * t["peso"].to_numpy()
    orden = np.argsort(-prof, kind="stable")
    cambios = np.flatnonzero(np.diff(prof[orden])) + 1
    for grupo in np.split(orden, cambios):
        grupo = grupo[padre[grupo] >= 0]
        np.add.at(hojas, padre[grupo], hojas[grupo])
        np.add.at(ahorro, padre[grupo], ahorro[grupo])
    conv = t["conv_id"].to_numpy()
    yield pd.DataFrame({
        "clave": t["clave"], "conv_id": conv, "depth": prof,
        "parent_conv_id": pd.array(np.where(padre >= 0, conv[padre], 0), "Int64").copy(),
        "raiz": padre < 0, "n_convs": t["n"], "n_children": hijos,
        "n_leaves": hojas + t["hojas"].to_numpy(), "saved_tokens": ahorro + t["ahorro"].to_numpy(),
        "fin": t["fin"],
    })


def trie(seqs: DataFrame) -> DataFrame:
    """Nodes of the trie of ``seqs`` (``conv_id``, ``turnos`` as ``secuencias`` gives them), as ``NODO``."""
    unicas = materializar(distintas(seqs), "secuencias")
    partes = materializar(
        unicas.repartitionByRange("seq").sortWithinPartitions("seq").mapInArrow(_por_bloques, PARTE), "trie")
    bordes = partes.filter("borde")
    unidos = bordes.groupBy("clave").agg(
        F.first("padre").alias("padre"), F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"),
        *[F.sum(c).alias(c) for c in ("n", "hijos", "hojas", "ahorro")],
        F.first("peso").alias("peso"), F.max("fin").alias("fin"),
    )
    arbol = materializar(
        unidos.coalesce(1).mapInPandas(
            _sumar_arbol, "clave binary, conv_id long, depth long, parent_conv_id long, raiz boolean, n_convs long,"
            " n_children long, n_leaves long, saved_tokens long, fin string"), "arbol")
    de_bordes = arbol.withColumn("parent_conv_id", F.when(~F.col("raiz"), F.col("parent_conv_id")))
    dentro = partes.filter(~F.col("borde")).select(
        "bloque", "padre", "conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"),
        F.col("hijos").alias("n_children"), F.col("hojas").alias("n_leaves"),
        F.col("ahorro").alias("saved_tokens"), "fin",
    )
    # By block as well, so that the many children of the root are not one key.
    padres = bordes.select("bloque", "clave").join(
        arbol.select("clave", F.col("conv_id").alias("de_padre")), "clave"
    ).withColumnRenamed("clave", "padre")
    de_borde = F.col("padre").isNotNull()
    colgados = dentro.filter(de_borde).join(padres, ["bloque", "padre"]).withColumn("parent_conv_id", F.col("de_padre"))
    columnas = [c.split()[0] for c in NODO.split(", ")][:-1]
    todos = (
        dentro.filter(~de_borde).select(*columnas, "fin")
        .unionByName(colgados.select(*columnas, "fin")).unionByName(de_bordes.select(*columnas, "fin"))
    )
    return todos.select(*columnas, F.coalesce("fin", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
