"""Every registered query agrees with its SQL on whole tables."""

import pytest

import __spark_entry__ as entrada
from turnero.plans.registro import CONSULTAS, ORACULO
from tests.comparar import conexion, diferencias

CARPETA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return conexion(CARPETA)


@pytest.mark.parametrize("nombre", sorted(CONSULTAS))
def test_consulta(spark, con, nombre):
    df = CONSULTAS[nombre](spark, CARPETA)
    assert diferencias(df, con, ORACULO[nombre]) == ""


def test_entrada(spark):
    assert entrada.entry(spark).count() == 1970
