import pytest
from pyspark.sql import functions as F

from textloom.functions.text import word_tokens
from textloom.operators.lexical import bm25

CASES = {
    "Olá, mundo!": "olá mundo",
    "A UFX fica em Pelotas.": "a ufx fica em pelotas",
    "Matrícula 2024.2": "matrícula",
    "A escola, fundada em 1969, fica em Pelotas/RS!": "a escola fundada em 1969 fica em",
    "O prof. Silva chegou. Depois saiu.": "o silva chegou depois saiu",
    "O Prof. Silva e a Dra. Souza": "o silva e a souza",
    "fim. outra coisa. Nova": "outra coisa nova",
    "J. Silva ficou.": "silva ficou",
    'Ele disse: "vamos agora" (já).': "ele disse vamos agora já",
    "He said 'go' and they don't know it's Bob's dogs'": "he said go and they do know it bob dogs",
    "I cannot wait, gonna go; gimme 5%": "i can not wait gon na go gim me 5",
    "pós-graduação -- curso... vale": "curso vale",
    "valor 1,5 e 10:30, certo": "valor e certo",
    "a@b.org #tag $5 [x] {y} <z>": "a tag 5 x y z",
    "”Aspas“ «guia»": "aspas guia",
    " \t\n": "",
    "fim.": "fim",
    "(fim.)": "fim",
    "Fim.\n\nNovo parágrafo": "fim novo parágrafo",
}


def test_words_of_all_cases(spark):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(CASES)], "k int, t string")
    got = {r["k"]: " ".join(r["w"]) for r in rows.select("k", word_tokens(F.col("t")).alias("w")).collect()}
    assert got == dict(enumerate(CASES.values()))
    none = spark.createDataFrame([(None,)], "t string").select(word_tokens(F.col("t"))).first()[0]
    assert none == []


def test_bm25_takes_the_tokenizer(spark):
    docs = spark.createDataFrame([(1, "Curso de Computação."), (2, "computação/curso"), (3, "Nada aqui, hoje."), (4, "outro texto")], "doc_id long, text string")
    asked = spark.createDataFrame([(9, "computação?")], "query_id long, text string")
    assert [r["doc_id"] for r in bm25(asked, docs, 3, word_tokens).collect()] == [1]


@pytest.mark.parametrize("text", ["." * 5000, "a." * 5000, "'" * 3000, "A. " * 3000])
def test_odd_texts_end(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(F.size(word_tokens(F.col("t"))))
    assert row.first()[0] >= 0
