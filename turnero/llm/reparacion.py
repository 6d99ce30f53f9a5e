"""Repair of conversation structure by alignment with the alternating role grammar.

Method.  A repaired conversation reads, by role initials, nothing, or an optional system turn and then user
and assistant in turn, at least once each.  Turns are aligned with the target strings of that grammar as
in Wagner and Fischer's table: keep (0), rerole to user or assistant (2), delete (3; blank and repeated turns must
go), insert an empty user or assistant turn (2); a truncated turn that stays adds 1.  Since targets of all
lengths end alike, one table filled from the end holds the alignment with every feasible length, a column each.  A
plain left-to-right repair gives the incumbent cost, and Ukkonen's band leaves out cells from which that
cost cannot be met.  Of all lengths with the least cost, the audits (edit initials) are traced back and the
least by ASCII is taken.

How it scales.  Turns are numbered without gathering a conversation (``numerar``) and repeats are found by
digest, each on its own key.  A conversation is cut into blocks of ``BLOQUE`` turns, which are aligned on
their own for every state the grammar can be in before and after them; a short conversation is one block.
Of a block, only costs and the order of its audits go to the step that picks one state for each cut, so that a
conversation with a large share of all turns is a few dozen numbers per block there.  The choice is the same
as over the whole conversation: every audit of a block has one letter that is no insertion per turn, with
insertions before it, so none is the beginning of another and the blocks decide ties from left to right.
Texts meet their edits by (conversation, place).

Defined results.  A null role or text is one space.  A role counts by its first character; s can only be kept,
and an empty role matches nothing.  Turns go by turn number, nulls first, then (role, text); equal rows are
repeats.  A null conversation id is a conversation.  Other columns are not looked at.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from turnero.operators.numeracion import numerar
from turnero.sources.tablas import materializar

BLOQUE = 128
REROL, BORRA, INSERTA, TRUNCA = 2, 3, 2, 1
# States of the grammar: nothing yet, after s, after u, after a.
ESTADOS = "0SUA"
NUNCA = 1 << 40
BLANCO = r"[^\x20\x09-\x0D]"


# ---- Alignment of one block ----
#
# A block is a string with a character per turn: u, a, s or o for the role, in upper case when the turn is
# truncated, and x for a turn that must be deleted.


def _voraz(bloque: str) -> int:
    """Cost of a left-to-right repair from any state to any: the incumbent."""
    costos = []
    for papel in "ua":
        costo = 0
        for c in bloque:
            if c == "x":
                costo += BORRA
                continue
            costo += (c.lower() != papel) * REROL + (TRUNCA if c.isupper() else 0)
            papel = "a" if papel == "u" else "u"
        costos.append(costo)
    # Two more edits before the last turn, insertions or an insertion and a rerole, give any other state.
    return max(costos) + INSERTA + max(INSERTA, REROL)


@lru_cache(maxsize=4)
def _tabla(bloque: str, sale: str) -> np.ndarray:
    """``t[i, r]``: least cost of aligning the turns from i on with the last r roles before state ``sale``.

    Insertions stand before a turn, so with no turn left no role may be.  Cells outside the band keep
    ``NUNCA``: r roles for n - i turns cost at least the insertions or deletions by which they differ.
    """
    n, tope = len(bloque), _voraz(bloque)
    ancho = n + tope // INSERTA + 2
    t = np.full((n + 1, ancho), NUNCA)
    t[n, 0] = 0
    roles = np.arange(ancho)
    # Role at distance r from the end: odd ones are the last role's.
    ultimo = "u" if sale == "U" else "a"
    es_u = (roles % 2 == 1) == (ultimo == "u")
    extra = INSERTA * roles
    for i in range(n - 1, -1, -1):
        c, quedan = bloque[i], n - i
        lo, hi = max(0, quedan - tope // BORRA), min(ancho - 1, quedan + tope // INSERTA)
        fila = t[i + 1, lo:hi + 1] + BORRA
        if c != "x":
            bajo = c.lower()
            igual = es_u[lo:hi + 1] if bajo == "u" else ~es_u[lo:hi + 1] if bajo == "a" else False
            paso = np.where(igual, 0, REROL) + (TRUNCA if c.isupper() else 0)
            antes = np.full(hi + 1 - lo, NUNCA)
            antes[max(0, 1 - lo):] = t[i + 1, max(lo, 1) - 1:hi]
            fila = np.minimum(fila, antes + paso)
        # Insertions before turn i: the running minimum along the row.
        t[i, lo:hi + 1] = np.minimum(np.minimum.accumulate(fila - extra[lo:hi + 1]) + extra[lo:hi + 1], NUNCA)
    return t


def _seguir(bloque: str, t: np.ndarray, sale: str, desde: int, r: int) -> tuple[str, list[str]]:
    """Least audit of the best alignment of ``bloque[desde:]`` with the last r roles, and its steps.

    A step per turn: the roles inserted before it, then D, K, U or A (rerole to user or assistant).
    """
    ultimo = "u" if sale == "U" else "a"
    otro = "a" if ultimo == "u" else "u"
    audita, pasos, nuevos = [], [], ""
    i, n = desde, len(bloque)
    while i < n:
        c, aqui, papel = bloque[i], t[i, r], ultimo if r % 2 else otro
        if t[i + 1, r] + BORRA == aqui:
            audita.append("D")
            pasos.append(nuevos + "D")
            i, nuevos = i + 1, ""
            continue
        if r and t[i, r - 1] + INSERTA == aqui:
            audita.append("I")
            nuevos += papel
            r -= 1
            continue
        queda = c.lower() == papel
        audita.append("K" if queda else "R")
        pasos.append(nuevos + ("K" if queda else papel.upper()))
        i, r, nuevos = i + 1, r - 1, ""
    return "".join(audita), pasos


@lru_cache(maxsize=1 << 13)
def alinear(bloque: str, entra: str, sale: str) -> tuple[int, str, tuple[str, ...]] | None:
    """Cost, least audit and steps of the best repair of a block between two states; None if there is none."""
    n = len(bloque)
    if sale in "0S":
        if entra == sale:
            return BORRA * n, "D" * n, ("D",) * n
        if (entra, sale) != ("0", "S"):
            return None
        opciones = [
            (BORRA * (n - 1) + (c == "S") * TRUNCA, "D" * i + "K" + "D" * (n - 1 - i))
            for i, c in enumerate(bloque) if c in "sS"
        ]
        return (lambda o: (*o, tuple(o[1])))(min(opciones)) if opciones else None
    t = _tabla(bloque, sale)
    # Feasible lengths: the role after the state we come from decides whether they are odd or even.
    par = (entra == "U") == (sale == "U")
    menos = 0 if entra == sale else 1
    largos = [r for r in range(menos, t.shape[1]) if (r % 2 == 0) == par]
    # Where the system turn stands, if there is one: all before it go.
    inicios = [(0, 0, "", ())]
    if entra == "0":
        inicios += [
            (i + 1, BORRA * i + (c == "S") * TRUNCA, "D" * i + "K", ("D",) * i + ("K",))
            for i, c in enumerate(bloque) if c in "sS"
        ]
    costos = [(costo + int(t[i, r]), k, r) for k, (i, costo, _, _) in enumerate(inicios)
              for r in largos if t[i, r] < NUNCA]
    if not costos:
        return None
    menor = min(costos)[0]
    mejor = None
    for c, k, r in costos:
        if c == menor:
            i, _, audita, pasos = inicios[k]
            cola, mas = _seguir(bloque, t, sale, i, r)
            if mejor is None or audita + cola < mejor[1]:
                mejor = (menor, audita + cola, (*pasos, *mas))
    return mejor


def resumen(bloque: str, primero: bool) -> list[int]:
    """Costs between all states, then the places of their audits among those from the same state.

    The first block of a conversation can only come from the first state.
    """
    costos, puestos = [], []
    for e in ESTADOS:
        de = [None if primero and e != "0" else alinear(bloque, e, s) for s in ESTADOS]
        orden = sorted(x[1] for x in de if x)
        costos += [x[0] if x else -1 for x in de]
        puestos += [orden.index(x[1]) if x else -1 for x in de]
    return costos + puestos


# What the end adds: from after s both roles are missing, from after u the assistant.
FINAL = {"0": (0, ""), "S": (2 * INSERTA, "ua"), "U": (INSERTA, "a"), "A": (0, "")}


def elegir(resumenes: list) -> tuple[int, str]:
    """Least cost of a conversation and its state at every cut, from the summaries of its blocks."""
    resto = [{s: FINAL[s][0] for s in ESTADOS}]
    for m in reversed(resumenes):
        despues = resto[-1]
        resto.append({
            e: min((m[4 * i + j] + despues[s] for j, s in enumerate(ESTADOS) if m[4 * i + j] >= 0),
                   default=NUNCA)
            for i, e in enumerate(ESTADOS)
        })
    resto.reverse()
    estado = camino = "0"
    for m, aqui, despues in zip(resumenes, resto, resto[1:]):
        i = ESTADOS.index(estado)
        estado = min(
            (m[16 + 4 * i + j], s) for j, s in enumerate(ESTADOS)
            if m[4 * i + j] >= 0 and m[4 * i + j] + despues[s] == aqui[estado]
        )[1]
        camino += estado
    return resto[0]["0"], camino


# ---- Conversations ----


def clave_de(conv: str) -> Column:
    """The conversation id as a text that is never null."""
    return F.coalesce(F.concat(F.lit("v"), F.col(conv).cast("string")), F.lit("n"))


def ilegales(faltas: DataFrame) -> DataFrame:
    """Per conversation the neighbours whose role initials are not su, ua or au, as ``illegal``."""
    a = faltas.select("clave", (F.col("lugar") + 1).alias("lugar"), F.col("papel").alias("antes"))
    par = F.concat("antes", "papel")
    return (
        faltas.select("clave", "lugar", "papel").join(a, ["clave", "lugar"])
        .filter(~par.isin("su", "ua", "au")).groupBy("clave").agg(F.count(F.lit(1)).alias("illegal"))
    )


def anotar(
    turnos: DataFrame, conv: str = "conv_id", turno: str = "turn", rol: str = "role", texto: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """Turns under fixed names with their place in the conversation and their first fault; their texts.

    ``clave`` stands for the conversation, null or not.  ``falta`` is blank, duplicate (role and text seen
    earlier), truncated (the last character that is no space is none of ``.!?``), or null.
    """
    filas = turnos.select(
        F.col(conv).alias("conv_id"), F.col(turno).alias("turno"),
        F.coalesce(F.col(rol).cast("string"), F.lit(" ")).alias("rol"),
        F.coalesce(F.col(texto).cast("string"), F.lit(" ")).alias("texto"),
    )
    orden = [F.col("turno").asc_nulls_first(), F.col("rol"), F.col("texto")]
    numeradas = numerar(filas, ["conv_id"], orden, "lugar").withColumns({
        "clave": clave_de("conv_id"),
        "_h": F.md5(F.concat(F.length("rol").cast("string"), F.lit(":"), "rol", "texto")),
    })
    numeradas = materializar(numeradas, "turnos")
    primeros = numeradas.groupBy("clave", "_h").agg(F.min("lugar").alias("lugar")).select(
        "clave", "lugar", F.lit(True).alias("_primero"))
    falta = (
        F.when(~F.col("texto").rlike(BLANCO), "blank").when(F.col("_primero").isNull(), "duplicate")
        .when(~F.col("texto").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated")
    )
    papel = F.substring("rol", 1, 1)
    letra = F.when(papel.isin("u", "a", "s"), papel).otherwise("o")
    estrechas = (
        numeradas.select("conv_id", "clave", "turno", "lugar", "texto", papel.alias("papel"), letra.alias("letra"))
        .join(primeros, ["clave", "lugar"], "left").withColumn("falta", falta)
        .select("conv_id", "clave", "turno", "lugar", "papel", "falta",
                F.when(F.col("falta").isin("blank", "duplicate"), "x")
                .when(F.col("falta") == "truncated", F.upper("letra")).otherwise(F.col("letra")).alias("signo"))
    )
    return materializar(estrechas, "faltas"), numeradas.select("clave", "lugar", "rol", "texto")


def bloques(faltas: DataFrame) -> DataFrame:
    """Signs of the turns in strings of ``BLOQUE``: one row per conversation and block."""
    numero = F.floor((F.col("lugar") - 1) / BLOQUE).cast("long")
    return faltas.groupBy("clave", numero.alias("bloque")).agg(
        F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("lugar", "signo"))), lambda x: x["signo"]), "").alias("signos"))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _resumen_udf(signos: pd.Series, bloque: pd.Series) -> pd.Series:
    return pd.Series([resumen(b, k == 0) for b, k in zip(signos, bloque)])


@F.pandas_udf(T.StructType([T.StructField("cost", T.LongType()), T.StructField("camino", T.StringType())]))
def _elegir_udf(resumenes: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([elegir([list(m) for m in ms]) for ms in resumenes], columns=["cost", "camino"])


@F.pandas_udf(T.StructType([
    T.StructField("audit", T.StringType()), T.StructField("pasos", T.ArrayType(T.StringType()))]))
def _pasos_udf(signos: pd.Series, entra: pd.Series, sale: pd.Series, ultimo: pd.Series) -> pd.DataFrame:
    filas = []
    for b, e, s, fin in zip(signos, entra, sale, ultimo):
        _, audita, pasos = alinear(b, e, s)
        cola = FINAL[s][1] if fin else ""
        filas.append((audita + "I" * len(cola), [*pasos, cola] if cola else list(pasos)))
    return pd.DataFrame(filas, columns=["audit", "pasos"])


def reparar(faltas: DataFrame, textos: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Audits (``clave``, ``cost``, ``audit``) and the repaired turns (``clave``, ``lugar``, ``turnos``).

    The arguments are what ``anotar`` gives.  ``turnos`` holds, at the place of a turn, the turns (role, text)
    inserted before it and itself if it stays; insertions at the end follow at one place more.
    """
    partes = materializar(bloques(faltas).withColumn("m", _resumen_udf("signos", "bloque")), "bloques")
    caminos = partes.groupBy("clave").agg(F.array_sort(F.collect_list(F.struct("bloque", "m"))).alias("ms")).select(
        "clave", _elegir_udf(F.col("ms.m")).alias("e")
    ).select("clave", "e.cost", F.posexplode(F.split(F.col("e.camino"), "")).alias("bloque", "sale"), "e.camino")
    # The path starts with the state before the first block.
    pares = caminos.filter(F.col("bloque") < F.length("camino") - 1).select(
        "clave", "cost", F.col("bloque").cast("long").alias("bloque"), F.col("sale").alias("entra"),
        F.substring("camino", F.col("bloque") + 2, F.lit(1)).alias("sale"),
        (F.col("bloque") == F.length("camino") - 2).alias("ultimo"),
    )
    hechos = materializar(
        partes.select("clave", "bloque", "signos").join(pares, ["clave", "bloque"])
        .withColumn("p", _pasos_udf("signos", "entra", "sale", "ultimo"))
        .select("clave", "bloque", "cost", "p.audit", "p.pasos"), "pasos",
    )
    audits = hechos.groupBy("clave").agg(
        F.first("cost").alias("cost"),
        F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("bloque", "audit"))), lambda x: x["audit"]), "").alias("audit"),
    )
    pasos = hechos.select("clave", "bloque", F.posexplode("pasos").alias("k", "paso")).select(
        "clave", (F.col("bloque") * BLOQUE + F.col("k") + 1).alias("lugar"), "paso")
    nombre = F.create_map(F.lit("u"), F.lit("user"), F.lit("a"), F.lit("assistant"))
    nuevos = F.transform(
        F.filter(F.split(F.regexp_extract("paso", "^[ua]*", 0), ""), lambda x: x != ""),
        lambda x: F.struct(nombre[x].alias("role"), F.lit("").alias("text")),
    )
    edicion = F.regexp_extract("paso", "[A-Z]$", 0)
    propio = F.when(edicion == "K", F.col("rol")).when(edicion == "U", "user").when(edicion == "A", "assistant")
    turnos = F.when(
        propio.isNull(), nuevos
    ).otherwise(F.concat(nuevos, F.array(F.struct(propio.alias("role"), F.col("texto").alias("text")))))
    reparados = pasos.join(textos, ["clave", "lugar"], "left").select("clave", "lugar", turnos.alias("turnos"))
    return audits, reparados.filter(F.size("turnos") > 0)
