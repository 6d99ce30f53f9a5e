"""Personal data by patterns and a skip-chain conditional random field.

Four patterns give the base spans.  Around them a conditional random field labels the other candidate
tokens of the document (runs between white space that hold a digit or ``@``).  Its factors: features of a
token and its neighbours; the labels of candidates next to each other; and, as skip edges, the labels
of far apart tokens that are the same or have the same digits.  Tokens under a base span are observed.
Loopy message passing spreads what is observed, so that a number found in one place is found again where
a pattern misses it.  It goes on until no message of a document changes; the round limit, which only loops
without a fixed point reach, grows with the document's candidates.  A token whose label is sure enough becomes an added span; base spans all stay.

Training is piecewise: the token factors by multinomial logistic regression, the edge factors by label
counts, both on the base spans of all documents that hold a digit or ``@``.  Tasks count, and the counts add up.

How it scales.  Documents are independent: one pass to count and one to label, no shuffle of rows.  Same tokens are linked to the next
occurrence; where some are observed, the others are linked to the last of them before and the first after
instead, so that what is observed is one step from every occurrence and is not outvoted by their number.
A candidate has at most four skip edges on average, however often a token repeats.  Messages of all documents of a batch are computed together; documents that are done drop out.

Defined results.  Null and empty texts have no spans.  Rows are labelled one by one, whatever their
id, and repeated rows alike.  Positions are code points, end exclusive.  An empty table gives an
empty result and trains nothing.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

CLASES = ("email", "ip", "card", "phone")
SEGURO = 0.9
RONDAS = 50  # rounds at least, and per candidate of a document, before message passing gives up
LOTE = 256  # documents whose messages are computed together

# The base patterns.  An e-mail address is found from its @ on both sides.  An address
# in digits can only start where a run of digits does, so a long run is looked at once.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMINIO = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
TARJETA = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
TELEFONO = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

FICHA = re.compile(r"[^\x20\x09-\x0D]+")
CANDIDATA = re.compile(r"[0-9@]")
NO_CIFRA = re.compile(r"[^0-9]+")
BORDES = ".,;:!?\"'()[]{}<>"


def luhn(cifras: str) -> bool:
    suma = 0
    for i, c in enumerate(reversed(cifras)):
        d = int(c) * (1 + i % 2)
        suma += d - 9 if d > 9 else d
    return suma % 10 == 0


def correos(texto: str):
    """Leftmost non-overlapping addresses: the longest local part before each @ and its domain.

    The local part can't hold an @, so looking at each @ in turn tries the same starts as a scan.
    """
    libre, arroba = 0, texto.find("@")
    while arroba >= 0:
        antes = texto[libre:arroba]
        inicio = libre + len(antes.rstrip(LOCAL))
        m = DOMINIO.match(texto, arroba + 1) if inicio < arroba else None
        if m:
            yield inicio, m.end()
        libre = m.end() if m else arroba + 1
        arroba = texto.find("@", libre)


def base(texto: str) -> list[tuple[int, int, int]]:
    """Base spans as (start, class, end), sorted."""
    salida = []
    if "@" in texto:
        salida += [(a, 0, b) for a, b in correos(texto)]
    if CANDIDATA.search(texto):
        for m in IP.finditer(texto):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:3] or 0) <= 255 for p in m[0].split(".")):
                salida.append((m.start(), 1, m.end()))
        for m in TARJETA.finditer(texto):
            cifras = NO_CIFRA.sub("", m[0])
            if 14 <= len(cifras) <= 19 and luhn(cifras):
                salida.append((m.start(), 2, m.end()))
        if "+" in texto:
            for m in TELEFONO.finditer(texto):
                if 10 <= len(NO_CIFRA.sub("", m[0])) <= 15:
                    salida.append((m.start(), 3, m.end()))
    return sorted(salida)


# ---- Tokens and factors ----


class Fichas:
    """Candidate tokens of one document with observed labels (0: none, else class + 1) and edges."""

    def __init__(self, texto: str, spans: list[tuple[int, int, int]]):
        self.sitios, self.rasgos, self.vecinas, self.saltos = [], [], [], []
        etiquetas, lugares, previa = [], {}, None
        k = 0
        for numero, m in enumerate(FICHA.finditer(texto)):
            palabra = m[0]
            if not CANDIDATA.search(palabra):
                continue
            while k < len(spans) and spans[k][2] <= m.start():
                k += 1
            hasta = k
            while hasta < len(spans) and spans[hasta][0] < m.end():
                hasta += 1
            cubre = [s[1] for s in spans[k:hasta] if s[2] > m.start()]
            i = len(self.sitios)
            limpia = palabra.strip(BORDES)
            inicio = m.start() + palabra.find(limpia) if limpia else m.start()
            self.sitios.append((inicio, inicio + len(limpia)))
            etiquetas.append(1 + min(cubre) if cubre else 0)
            junto = previa is not None and previa == numero - 1
            self.rasgos.append(rasgos(limpia, junto))
            if junto:
                self.vecinas.append((i - 1, i))
            cifras = NO_CIFRA.sub("", limpia)
            for llave in {limpia.lower() if len(limpia) >= 5 else "", "#" + cifras if len(cifras) >= 7 else ""}:
                if llave:
                    if llave in lugares:
                        self.saltos.append((lugares[llave][-1], i))
                    lugares.setdefault(llave, []).append(i)
            previa = numero
        self.etiquetas = np.array(etiquetas, np.int64)
        self.enlaces = [par for v in lugares.values() for par in self._enlazar(v)]

    def _enlazar(self, lugares: list[int]):
        """Skip edges of one token's occurrences for message passing.

        Where some are observed, each other one is linked to the nearest of them on both sides and to nothing
        else, so what is observed counts the same however many follow.  Else each is linked to the next.
        """
        if not self.etiquetas[lugares].any():
            yield from zip(lugares, lugares[1:])
            return
        for orden in (lugares, lugares[::-1]):
            vista = None
            for i in orden:
                if self.etiquetas[i]:
                    vista = i
                elif vista is not None:
                    yield min(vista, i), max(vista, i)


N_RASGOS = 20


def rasgos(p: str, junto: bool) -> list[float]:
    """Features of a token: what its characters are like, not whether a pattern fits it."""
    cifras = sum(c.isdigit() for c in p)
    letras = sum(c.isalpha() for c in p)
    puntos, guiones = p.count("."), p.count("-")
    return [
        1.0, "@" in p, "@" in p and puntos > 0, p.startswith("+"), p.startswith("("), letras > 0,
        letras == 0, cifras == 0, 1 <= cifras <= 2, 3 <= cifras <= 4, 5 <= cifras <= 9,
        10 <= cifras <= 13, cifras >= 14, puntos == 3, puntos in (1, 2), guiones > 0, "/" in p,
        "%" in p or "_" in p, junto, len(p) > 24,
    ]


def contar(textos) -> dict[tuple[str, int, int], int]:
    """What training needs of some texts: how often each (features, label) and each pair of labels occurs.

    Keys are ("ficha", feature bits, label), ("vecina", label, label) and ("salto", label, label).
    """
    c: dict[tuple[str, int, int], int] = {}
    for t in textos:
        f = Fichas(t or "", base(t or ""))
        y = f.etiquetas.tolist()
        claves = [("ficha", sum(1 << k for k, r in enumerate(x) if r), e) for x, e in zip(f.rasgos, y)]
        claves += [(tipo, y[a], y[b]) for tipo, pares in (("vecina", f.vecinas), ("salto", f.saltos))
                   for a, b in pares]
        for k in claves:
            c[k] = c.get(k, 0) + 1
    return c


def regresion(x: np.ndarray, y: np.ndarray, veces: np.ndarray, clases: int, pasos: int = 400) -> np.ndarray:
    """Weights of a multinomial logistic regression, by gradient descent with an L2 penalty."""
    w, meta, veces = np.zeros((x.shape[1], clases)), np.eye(clases)[y], (veces / veces.sum())[:, None]
    for _ in range(pasos):
        z = x @ w
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        w -= x.T @ ((p - meta) * veces) + 1e-3 * w
    return w


def factor(pares: list[tuple[int, int, int]], previo: np.ndarray) -> np.ndarray:
    """Log ratio of how often two labels meet on an edge to how often they would by chance."""
    c = previo.copy()
    for a, b, n in pares:
        c[a, b] += n
        c[b, a] += n
    c /= c.sum()
    return np.clip(np.log(c / np.outer(c.sum(1), c.sum(0))), -4, 4)


def entrenar(conteos: dict[tuple[str, int, int], int]) -> dict[str, np.ndarray] | None:
    """Factors from the counts; None when there are none."""
    fichas = sorted((k[1], k[2], n) for k, n in conteos.items() if k[0] == "ficha")
    if not fichas:
        return None
    clases = len(CLASES) + 1
    bits, y, n = (np.array(v) for v in zip(*fichas))
    x = ((bits[:, None] >> np.arange(N_RASGOS)) & 1).astype(float)

    def pares(tipo):
        return [(a, b, n) for (t, a, b), n in sorted(conteos.items()) if t == tipo]

    return {
        "ficha": regresion(x, y, n.astype(float), clases),
        "vecina": factor(pares("vecina"), np.full((clases, clases), 1.0)),
        # Before any count, the same thing is far more likely to have one label than two.
        "salto": factor(pares("salto"), 10.0 * np.eye(clases) + 0.1),
    }


def propagar(
    unarios: np.ndarray, aristas: np.ndarray, tablas: np.ndarray, grupo: np.ndarray | None = None
) -> np.ndarray:
    """Marginals by loopy sum-product.  ``tablas`` has one log table for each edge (first, second).

    ``grupo`` has the document of every node; no edge joins two.  Without it all are one document.
    """
    n, c = unarios.shape
    grupo = np.zeros(n, np.int64) if grupo is None else grupo
    m = np.zeros((2, len(aristas), c))  # to the second node, to the first
    tope = RONDAS * (1 + np.bincount(grupo, minlength=1))
    de_arista = grupo[aristas[:, 0]]
    activas, ronda = np.arange(len(aristas)), 0
    while len(activas):
        ida, vuelta = aristas[activas, 0], aristas[activas, 1]
        nodos, lugar = np.unique(np.concatenate([ida, vuelta]), return_inverse=True)
        ida, vuelta = lugar[:len(ida)], lugar[len(ida):]
        t, g, mm = tablas[activas], de_arista[activas], m[:, activas]
        quietos = np.zeros(len(activas), bool)
        while not quietos.any():
            creencia = unarios[nodos]
            np.add.at(creencia, vuelta, mm[0])
            np.add.at(creencia, ida, mm[1])
            a = creencia[ida] - mm[1]
            b = creencia[vuelta] - mm[0]
            nuevo = np.stack([
                np.logaddexp.reduce(a[:, :, None] + t, axis=1),
                np.logaddexp.reduce(b[:, None, :] + t, axis=2),
            ])
            nuevo -= nuevo.max(axis=2, keepdims=True)
            cambio = np.zeros(len(tope))
            np.maximum.at(cambio, g, np.abs(nuevo - mm).max(axis=(0, 2)))
            mm = 0.5 * mm + 0.5 * nuevo
            ronda += 1
            quietos = ((cambio < 1e-4) | (ronda >= tope))[g]
        m[:, activas] = mm
        activas = activas[~quietos]
    creencia = unarios.copy()
    np.add.at(creencia, aristas[:, 1], m[0])
    np.add.at(creencia, aristas[:, 0], m[1])
    p = np.exp(creencia - creencia.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def etiquetar(textos: list[str | None], modelo: dict[str, np.ndarray] | None) -> list[list[tuple]]:
    """Spans of each text as (start, class, end, is base), sorted."""
    salida, docs, n = [], [], 0
    for k, t in enumerate(textos):
        spans = base(t or "")
        salida.append([(a, c, b, True) for a, c, b in spans])
        if modelo is not None and t and CANDIDATA.search(t):
            f = Fichas(t, spans)
            docs.append((k, f, n))
            n += len(f.sitios)
    if not n:
        return salida
    y = np.concatenate([f.etiquetas for _, f, _ in docs])
    unarios = np.concatenate([np.array(f.rasgos, float).reshape(-1, N_RASGOS) for _, f, _ in docs]) @ modelo["ficha"]
    vistos = np.flatnonzero(y)
    unarios[vistos] = -50.0
    unarios[vistos, y[vistos]] = 0.0
    aristas, tablas = [], []
    for tipo in ("vecina", "salto"):
        pares = [(a + n0, b + n0) for _, f, n0 in docs
                 for a, b in (f.vecinas if tipo == "vecina" else f.enlaces)]
        aristas += pares
        tablas.append(np.broadcast_to(modelo[tipo], (len(pares), *modelo[tipo].shape)))
    grupo = np.repeat(np.arange(len(docs)), [len(f.sitios) for _, f, _ in docs])
    p = propagar(unarios, np.array(aristas, np.int64).reshape(-1, 2), np.concatenate(tablas), grupo)
    mejor = p.argmax(1)
    nuevas = (y == 0) & (mejor > 0) & (p.max(1) >= SEGURO)
    for k, f, n0 in docs:
        anterior = None
        juntos = set(f.vecinas)
        for i in np.flatnonzero(nuevas[n0:n0 + len(f.sitios)]):
            a, b = f.sitios[i]
            clase = int(mejor[n0 + i]) - 1
            if a == b:
                continue
            if anterior is not None and anterior[0] == clase and (anterior[1], i) in juntos:
                salida[k][-1] = (salida[k][-1][0], clase, b, False)
            else:
                salida[k].append((a, clase, b, False))
            anterior = clase, i
        salida[k].sort()
    return salida


# ---- Over a table ----


TIPO_SPANS = pa.list_(pa.struct([
    ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))


def ajustar(docs: DataFrame, texto: str):
    """Factors from all documents.  Tasks count; only counts of distinct cases reach the driver."""
    filas = docs.select(F.col(texto).cast("string").alias("texto")).filter(F.col("texto").rlike("[0-9@]"))

    def en_tarea(lotes):
        c: dict[tuple[str, int, int], int] = {}
        for lote in lotes:
            for k, n in contar(t.as_py() for t in lote["texto"]).items():
                c[k] = c.get(k, 0) + n
        yield pa.RecordBatch.from_pylist(
            [{"tipo": t, "a": a, "b": b, "n": n} for (t, a, b), n in c.items()],
            schema=pa.schema([("tipo", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())]))

    conteos = (
        filas.mapInArrow(en_tarea, "tipo string, a long, b long, n long")
        .groupBy("tipo", "a", "b").agg(F.sum("n").alias("n")).collect()
    )
    return entrenar({(f["tipo"], f["a"], f["b"]): f["n"] for f in conteos})


def detectar_pii(docs: DataFrame, doc: str = "doc_id", texto: str = "text") -> DataFrame:
    """One row per document: id and ``spans``, an array of (``kind``, ``start``, ``end``, ``base``)."""
    modelo = ajustar(docs, texto)

    @F.arrow_udf("array<struct<kind:string,start:bigint,end:bigint,base:boolean>>")
    def buscar(textos: pa.Array) -> pa.Array:
        salida = []
        for i in range(0, len(textos), LOTE):
            salida += [
                [{"kind": CLASES[c], "start": a, "end": b, "base": es} for a, c, b, es in spans]
                for spans in etiquetar(textos.slice(i, LOTE).to_pylist(), modelo)
            ]
        return pa.array(salida, TIPO_SPANS)

    return docs.select(
        F.col(doc), buscar(F.col(texto).cast("string")).alias("spans")
    )
