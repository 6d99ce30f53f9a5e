"""Prefix trie against brute force, over block borders, and hard rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnero.llm import consultas, trie as op13

COLUMNAS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def a_fuerza(convs):
    """Nodes of {conv: ((role, text), ...)}."""
    miembros = defaultdict(list)
    for c, turnos in convs.items():
        for d in range(len(turnos) + 1):
            miembros[turnos[:d]].append(c)
    hijos = defaultdict(list)
    for p in miembros:
        if p:
            hijos[p[:-1]].append(p)
    bajo = {}
    for p in sorted(miembros, key=len, reverse=True):
        propio = (len(miembros[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
        bajo[p] = (sum(bajo[h][0] for h in hijos[p]) + (not hijos[p]), propio + sum(bajo[h][1] for h in hijos[p]))
    res = []
    for p, cs in miembros.items():
        fin = ",".join(str(c) for c in sorted(c for c in cs if convs[c] == p))
        res.append((min(cs), len(p), min(miembros[p[:-1]]) if p else None, len(cs), len(hijos[p]), *bajo[p],
                    hashlib.sha256(fin.encode()).hexdigest()))
    return sorted(res, key=str)


def tabla(spark, convs):
    filas = [(c, t, r, x) for c, turnos in convs.items() for t, (r, x) in enumerate(turnos)]
    return spark.createDataFrame(filas, "conv_id long, turn long, role string, text string")


def salida(df):
    assert df.columns == COLUMNAS
    return sorted((tuple(f) for f in df.collect()), key=str)


def al_azar(n, semilla, hondo=6, letras="ab"):
    azar = random.Random(semilla)
    return {c * 3 - 5: tuple((azar.choice("ua"), azar.choice(letras) * azar.randint(0, 2))
                             for _ in range(azar.randint(1, hondo))) for c in range(n)}


@pytest.mark.parametrize("tanda, turnos", [(1, 10**6), (3, 10**6), (7, 9), (10_000, 10**6)])
def test_igual_a_fuerza_bruta(spark, monkeypatch, tanda, turnos):
    """Blocks of any size give the same trie."""
    convs = al_azar(150, tanda)
    convs |= {1000 + i: (("u", "ñandú"), ("a", "ok")) for i in range(40)}
    monkeypatch.setattr(op13, "TURNOS_BLOQUE", turnos)
    monkeypatch.setattr(op13, "TRECHO", 8)
    antes = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", tanda)
    try:
        assert salida(op13.trie(op13.secuencias(tabla(spark, convs)))) == a_fuerza(convs)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", antes)


def test_minimos():
    azar = np.random.default_rng(1)
    for n in (1, 2, 5, 16, 33):
        v = azar.integers(0, 6, n)
        m = op13.Minimos(v)
        for a in range(n):
            for b in range(a, n):
                assert m.entre(np.array([a]), np.array([b]))[0] == v[a:b + 1].min()
            for minimo in range(7):
                der, izq = a, a
                while der + 1 < n and v[der + 1] >= minimo:
                    der += 1
                while izq >= 1 and v[izq] >= minimo:
                    izq -= 1
                assert m.hasta(np.array([a]), np.array([minimo]), 1)[0] == der
                assert m.hasta(np.array([a]), np.array([minimo]), -1)[0] == izq


def test_casos_limite(spark):
    filas = [
        (5, None, None, None), (5, None, None, None), (5, 0, "user", "a"), (6, 0, "", ""), (6, 1, "", ""),
        (None, 0, "user", "a"), (7, 0, "user", "x" * 300_000), (-8, 2, "user", "a"), (-8, 2, "assistant", "b"),
        (9, 0, "us", "era"), (10, 0, "user", "a"),
    ]
    df = spark.createDataFrame(filas, "conv_id long, turn long, role string, text string")
    for c in ("turno", "rol", "texto", "id", "peso", "lugar", "h", "seq"):
        df = df.withColumn(c, F.lit("x"))
    convs = {
        5: (("", ""), ("", ""), ("user", "a")), 6: (("", ""), ("", "")), 7: (("user", "x" * 300_000),),
        -8: (("assistant", "b"), ("user", "a")), 9: (("us", "era"),), 10: (("user", "a"),),
    }
    assert salida(op13.trie(op13.secuencias(df))) == a_fuerza(convs)
    assert salida(op13.trie(op13.secuencias(df.limit(0)))) == []


def test_consulta(spark, tmp_path):
    """Rebuilt conversations, some without a turn and some whose head is absent."""
    convs = al_azar(90, 4, 12, "abc")
    tabla(spark, convs).write.parquet(str(tmp_path / "conversations.parquet"))
    reconstruidas = {}
    for c, turnos in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        cabeza = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        reconstruidas[c] = convs.get(cabeza, ())[:h] + turnos[h:]
    assert any(not t for t in reconstruidas.values())
    assert salida(consultas.prefix_trie(spark, str(tmp_path))) == a_fuerza(reconstruidas)
