"""Structure repair: alignment against a search over all edits, cuts into blocks, hard rows."""

import functools
import hashlib
import random
import sys
import zlib

from pyspark.sql import functions as F

from turnero.llm import consultas, reparacion as op12


sys.setrecursionlimit(10_000)


def a_fuerza(signos):
    """Least (cost, audit) over every edit script, state by state, on one sign per turn."""
    espera = {"0": "u", "S": "u", "U": "a", "A": "u"}
    tras = {"u": "U", "a": "A"}

    @functools.lru_cache(None)
    def mejor(i, e, insertados):
        res = []
        if i == len(signos):
            if e in "0A":
                res.append((0, ""))
        else:
            c = signos[i]
            res.append((3 + mejor(i + 1, e, 0)[0], "D" + mejor(i + 1, e, 0)[1]))
            if c != "x":
                t = int(c.isupper())
                for letra, costo, sigue in [("K", 0, tras[espera[e]])] if c.lower() == espera[e] else [
                        ("R", 2, tras[espera[e]])]:
                    x = mejor(i + 1, sigue, 0)
                    res.append((costo + t + x[0], letra + x[1]))
                if c.lower() == "s" and e == "0":
                    x = mejor(i + 1, "S", 0)
                    res.append((t + x[0], "K" + x[1]))
        if insertados < 3:
            x = mejor(i, tras[espera[e]], insertados + 1)
            res.append((2 + x[0], "I" + x[1]))
        return min(res, default=(10**9, ""))

    return mejor(0, "0", 0)


def por_bloques(signos, largo):
    partes = [signos[i:i + largo] for i in range(0, len(signos), largo)]
    costo, camino = op12.elegir([op12.resumen(b, k == 0) for k, b in enumerate(partes)])
    audita = "".join(op12.alinear(b, e, s)[1] for b, e, s in zip(partes, camino, camino[1:]))
    return costo, audita + "I" * len(op12.FINAL[camino[-1]][1])


def test_igual_a_todas_las_ediciones():
    azar = random.Random(12)
    for _ in range(1500):
        letras = azar.choice(["uasoUASOx", "ua", "uaUA", "sx", "uuua", "xxu", "sSuo"])
        signos = "".join(azar.choice(letras) for _ in range(azar.randint(1, 11)))
        esperado = a_fuerza(signos)
        for largo in (1, 2, 3, 5, 128):
            assert por_bloques(signos, largo) == esperado, (signos, largo)


def test_largas():
    azar = random.Random(13)
    for n in (120, 300, 399):
        signos = "".join(azar.choice("uauauauasoUAx") for _ in range(n))
        assert por_bloques(signos, op12.BLOQUE) == a_fuerza(signos)


def correr(spark, filas, extra=()):
    df = spark.createDataFrame(filas, "conv_id long, turn long, role string, text string")
    for c in extra:
        df = df.withColumn(c, F.lit("x"))
    faltas, textos = op12.anotar(df)
    audits, turnos = op12.reparar(faltas, textos)
    hechos = {}
    for f in sorted(turnos.collect(), key=lambda f: f["lugar"]):
        hechos.setdefault(f["clave"], []).extend((t["role"], t["text"]) for t in f["turnos"])
    return ({f["clave"]: (f["cost"], f["audit"]) for f in audits.collect()}, hechos,
            {(f["clave"], f["lugar"]): f["falta"] for f in faltas.collect()})


def test_casos_limite(spark):
    filas = [
        (1, 0, "user", "Hola."), (1, 1, "assistant", "Sí."), (1, 2, "user", "Hola."),  # repeated and last
        (None, None, None, None), (None, 1, "user", "¿Va?"),
        (2, None, "assistant", "B."), (2, 0, "user", "A."),  # null turn first
        (3, 0, "", "Sin papel."), (3, 1, "tool", "x" * 200_000),
        (4, 0, "system", "S."),
        (5, 1, "user", "Igual!"), (5, 1, "user", "Igual!"), (5, 1, "assistant", "Otro?"),  # ties
        (-6, 0, "user", " \n\t"),
    ]
    audits, turnos, faltas = correr(spark, filas, ("lugar", "clave", "falta", "signo", "_h", "numero"))
    assert audits == {
        "v1": (3, "KKD"), "n": (5, "DKI"), "v2": (4, "IKKI"), "v3": (5, "RR"), "v4": (3, "D"),
        "v5": a_fuerza("aux"), "v-6": (3, "D"),
    }
    assert turnos["v1"] == [("user", "Hola."), ("assistant", "Sí.")]
    assert turnos["n"] == [("user", "¿Va?"), ("assistant", "")]
    assert turnos["v2"] == [("user", ""), ("assistant", "B."), ("user", "A."), ("assistant", "")]
    assert [t[0] for t in turnos["v3"]] == ["user", "assistant"] and turnos["v3"][1][1] == "x" * 200_000
    assert "v4" not in turnos and "v-6" not in turnos
    assert faltas[("n", 1)] == "blank" and faltas[("v-6", 1)] == "blank" and faltas[("v3", 2)] == "truncated"
    # Equal turns go by (role, text): assistant first, then the user twice, once as a repeat.
    assert [faltas[("v5", k)] for k in (1, 2, 3)] == [None, None, "duplicate"]
    vacio = correr(spark, [])
    assert vacio == ({}, {}, {})


def test_consulta_con_una_conversacion_larga(spark, tmp_path):
    """A conversation of many blocks, one that is dropped whole and null rows, against a plain loop."""
    azar = random.Random(5)
    filas = [(7, t, azar.choice(["user", "assistant", "system"]), f"t{azar.randint(0, 300)}" + azar.choice([".", ""]))
             for t in range(500)]
    filas += [(c, t, "user", "Hola.") for c in range(60) for t in range(1)] + [(None, 3, None, "a"), (61, None, "user", None)]
    spark.createDataFrame(filas, "conv_id long, turn long, role string, text string").write.parquet(
        str(tmp_path / "conversations.parquet"))
    salida = {f["conv_id"]: f for f in consultas.structure_repair(spark, str(tmp_path)).collect()}
    assert set(salida) == {f[0] for f in filas}
    for conv in salida:
        filas_conv = sorted([f for f in filas if f[0] == conv], key=lambda f: (f[1] is not None, f[1] or 0))
        rows = []
        for c, t, r, x in filas_conv:
            k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
            r, x = " " if r is None else r, " " if x is None else x
            if k == 0:
                continue
            x = "" if k == 1 else x.translate({ord(s): None for s in ".!?"}) if k == 2 else x
            rows += [(t, "user" if k == 4 else r, x)] * (2 if k == 3 else 1)
        rows.sort(key=lambda f: (f[0] is not None, f[0] or 0, f[1], f[2]))
        signos, vistos, cuenta = "", set(), {"blank": 0, "duplicate": 0, "truncated": 0}
        for t, r, x in rows:
            falta = ("blank" if not x.strip(" \t\n\x0b\x0c\r") else "duplicate" if (r, x) in vistos
                     else "truncated" if x.rstrip(" \t\n\x0b\x0c\r")[-1] not in ".!?" else None)
            vistos.add((r, x))
            if falta:
                cuenta[falta] += 1
            s = r[0] if r[:1] in ("u", "a", "s") else "o"
            signos += "x" if falta in ("blank", "duplicate") else s.upper() if falta else s
        costo, audita = a_fuerza(signos) if signos else (0, "")
        f = salida[conv]
        assert (f["cost"], f["audit"]) == (costo, audita)
        assert (f["blank"], f["duplicate"], f["truncated"]) == tuple(cuenta.values())
        reparada, i = [], 0
        for letra in audita:
            papel = "assistant" if reparada and reparada[-1].startswith("u") else "user"
            if letra == "I":
                reparada.append(f"{papel}:")
                continue
            if letra != "D":
                reparada.append(f"{rows[i][1] if letra == 'K' else papel}:{rows[i][2]}")
            i += 1
        assert f["repaired_sha256"] == hashlib.sha256("\n".join(reparada).encode()).hexdigest()
        turnos = [t for t, _, _ in rows if t is not None]
        assert f["gaps"] == (max(turnos) - min(turnos) + 1 - len(set(turnos)) if turnos else 0)
        iniciales = [r[:1] for _, r, _ in rows]
        assert f["illegal"] == sum(a + b not in ("su", "ua", "au") for a, b in zip(iniciales, iniciales[1:]))
