import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import cache, ingest, lexical, nested, reliability, search
from textloom.plans.answering import Config, answered
from textloom.sources import io
from textloom.streaming import events as streams


def test_knn_order(spark):
    docs = [(0, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [0.995, 0.0995, 0.0]), (3, [-1.0, 0.0, 0.0])]
    corpus = spark.createDataFrame(docs, "id long, embedding array<double>")
    asked = spark.createDataFrame([(9, [1.0, 0.0, 0.0])], "query_id long, embedding array<double>")
    found = search.knn(asked, corpus, 3).orderBy("rank").collect()
    assert [r["id"] for r in found] == [0, 2, 1]
    assert search.knn(asked, corpus.where("id > 99"), 3).count() == 0


def test_knn_blocks_agree(spark, monkeypatch):
    random = np.random.default_rng(1)
    rows = [(k, random.normal(size=8).tolist()) for k in range(60)]
    corpus = spark.createDataFrame(rows, "id long, embedding array<double>")
    asked = corpus.select(F.col("id").alias("query_id"), "embedding").where("id % 5 = 0")
    whole = search.knn(asked, corpus, 4, "l1").select("query_id", "id", "rank").collect()
    monkeypatch.setattr(search, "QUERY_BLOCK", 5)
    monkeypatch.setattr(search, "CORPUS_BLOCK", 7)
    assert sorted(search.knn(asked, corpus, 4, "l1").select("query_id", "id", "rank").collect()) == sorted(whole)


def test_ann_recall(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    corpus = vectors.select(F.col("vec_id").alias("id"), "embedding")
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    index, centres = search.ann_index(corpus, 16)
    assert index.count() == corpus.count()
    near = {(r["query_id"], r["id"]) for r in search.ann(asked, index, centres, 5, 10).collect()}
    exact = {(r["query_id"], r["id"]) for r in search.knn(asked, corpus, 5).collect()}
    assert len(near & exact) / len(exact) >= 0.9


def test_upsert_and_cap(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d"), (None, "e")], "k long, v string")
    assert {(r["k"], r["v"]) for r in ingest.upserted(old, new, "k").collect()} == {(1, "a"), (2, "c"), (3, "d")}


def test_longest_per_key_takes_the_first_of_equals(spark):
    rows = spark.createDataFrame([("a", "xx", 2), ("a", "yy", 1), ("b", "z", 3)], "k string, t string, n int")
    kept = ingest.longest_per_key(rows, F.col("k"), "t", "n").collect()
    assert {(r["k"], r["t"]) for r in kept} == {("a", "yy"), ("b", "z")}


def test_canonical_pages(spark, tmp_path):
    (tmp_path / "p.json").write_text(
        '[{"id": "1", "tipo": "curso", "titulo": "T", "embedding_text": " e ", "metadata": {"url": "u"}},'
        ' {"url": "v", "title": "Nome | Site", "text": "corpo", "tipo": "sobre"}, {"url": "w", "title": "x", "text": " "}]'
    )
    docs = {r["title"]: r for r in ingest.canonical(io.crawled_pages(spark, str(tmp_path))).collect()}
    assert set(docs) == {"T", "Nome"}
    assert docs["T"]["content"] == "e" and docs["T"]["metadata"]["source"] == "u"
    assert docs["Nome"]["doc_id"] is None


def test_projects_need_few_own_ones(spark):
    names = spark.createDataFrame([(1, "ANA"), (2, "BIA")], "asker long, name string")
    rows = [(f"p{k}", "Ana", ["Bia — aluna"], f"0{k}/01/2024") for k in range(1, 4)] + [("q", None, ["Ana — x"], None)]
    projects = spark.createDataFrame(rows, "project string, coordinator string, team array<string>, start string")
    found = nested.projects_of(names, projects, 4).collect()
    assert {(r["asker"], r["step"]) for r in found} == {(1, 1), (2, 2)}
    assert [r["project"] for r in sorted(found, key=lambda r: r["nth"]) if r["asker"] == 1] == ["p3", "p2", "p1"]


def test_outages_and_availability(spark):
    rows = [("a", k, e) for k, e in enumerate(["success", "failure", "failure", "success", "info", "failure"])]
    log = spark.createDataFrame(rows, "component string, n int, event string").withColumn("ts", F.timestamp_seconds(F.col("n") * 10))
    islands = reliability.outages(log, "n").orderBy("outage").collect()
    assert [(r["failed_at"].second, r["recovered_at"] and r["recovered_at"].second) for r in islands] == [(10, 30), (50, None)]
    shares = reliability.availability(reliability.outages(log, "n"), F.timestamp_seconds(F.lit(60)))
    assert shares.first()["availability"] == pytest.approx(1 - 30 / 50)
    assert reliability.mean_time_between_failures(log).first()["mtbf_s"] == pytest.approx(20)


def test_cache_takes_the_earliest(spark):
    entries = spark.createDataFrame([(1, "Qual o prazo?", 5), (2, "qual  o prazo", 3)], "entry_id long, query string, s long")
    entries = cache.keyed(entries).withColumn("created_at", F.timestamp_seconds("s"))
    asked = cache.keyed(spark.createDataFrame([(7, "QUAL O PRAZO")], "query_id long, query string"))
    assert cache.exact_hits(asked, entries).collect() == [(7, 2)]
    fuzzy = cache.fuzzy_hits(cache.keyed(spark.createDataFrame([(8, "qual o prazoo")], "query_id long, query string")), entries, 0.5)
    assert fuzzy.first()["entry_id"] == 2


def test_streams_equal_tables(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    source = str(tmp_path / "in")
    last = events.selectExpr("max(ts) + interval 3 days AS ts").select(F.lit(-1).cast("long").alias("event_id"), "ts", F.lit(0).cast("long").alias("user_id"), F.lit("end").alias("event_type"), F.lit(0.0).alias("value"), F.lit("{}").alias("props"))
    events.repartition(1).write.parquet(source)
    last.write.mode("append").parquet(source)
    stream = streams.windowed(spark.readStream.schema(events.schema).parquet(source), "1 hour", "event_type", "1 day")
    got = streams.run_to_end(spark, stream, str(tmp_path / "out"), str(tmp_path / "state"))
    want = streams.windowed(events, "1 hour", "event_type")
    key = lambda df: {(r["window_start"], r["event_type"], r["n"]) for r in df.collect()}
    assert key(got.where("event_type <> 'end'")) == key(want)


def test_outage_stream(spark, tmp_path):
    rows = [("a", k, e) for k, e in enumerate(["failure", "success", "failure", "failure", "success"])]
    log = spark.createDataFrame(rows, "component string, order_id int, event string").withColumn("ts", F.timestamp_seconds("order_id"))
    log.write.parquet(str(tmp_path / "in"))
    stream = streams.outages(spark.readStream.schema(log.schema).parquet(str(tmp_path / "in")))
    got = streams.run_to_end(spark, stream, str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted((r["failed_at"].second, r["recovered_at"].second) for r in got.collect()) == [(0, 1), (2, 4)]


def test_cascade_prefers_guard_then_cache(spark):
    asked = spark.createDataFrame([(1, "x@y.org é meu e-mail"), (2, "qual o prazo"), (3, "regras da biblioteca central hoje")], "query_id long, text string")
    docs = spark.createDataFrame([(1, "regras da biblioteca", "Biblioteca", "s")], "doc_id long, text string, title string, source string")
    titles = spark.createDataFrame([(1, "NADA")], "id long, name string")
    cached = spark.createDataFrame([(1, "Qual o prazo?", "amanhã", 1)], "entry_id long, query string, response string, s long")
    cached = cached.withColumn("created_at", F.timestamp_seconds("s"))
    got = {r["query_id"]: (r["strategy"], r["answer"]) for r in answered(asked, docs, titles, cached, Config(hybrid=True, rerank=True)).collect()}
    assert got[1] == ("blocked", "pii") and got[2] == ("cache", "amanhã") and got[3][0] == "retrieval"


def test_bm25_without_matches(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a a z"), (2, "q")], "query_id long, text string")
    assert [(r["query_id"], r["doc_id"]) for r in lexical.bm25(asked, docs, 5).collect()] == [(1, 1)]


def test_collections_and_logs(spark, tmp_path):
    where = str(tmp_path / "c")
    rows = spark.createDataFrame([("x", "a"), ("y", "b")], "content string, collection string")
    io.append_to_collection(rows, where)
    io.replace_collections(rows.where("collection = 'a'").withColumn("content", F.lit("new")), where)
    assert {(r["collection"], r["content"]) for r in spark.read.parquet(where).collect()} == {("a", "new"), ("b", "y")}
    log = str(tmp_path / "log")
    io.append_events(spark.createDataFrame([("llm", "failure", "")], "component string, event string, reason string"), log)
    assert io.events(spark, log).first()["reason"] is None


def test_trigram_pairs_against_brute_force(spark):
    import random

    from textloom.functions.text import trigrams
    from textloom.operators import lexical

    pick = random.Random(4)
    names = sorted({"".join(pick.choices("abc ", k=pick.randrange(1, 12))) for _ in range(120)})
    df = spark.createDataFrame([(k, n) for k, n in enumerate([*names, None])], "id long, name string")
    sets = {r["id"]: set(r["g"]) for r in df.where("name IS NOT NULL").select("id", trigrams(F.col("name")).alias("g")).collect()}
    for least in (0.3, 0.5, 0.92):
        want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]) - 1e-12 and sets[a] & sets[b]}
        got = lexical.trigram_pairs(df, df, trigrams, least, ascending=True).collect()
        assert len(got) == len(want) and {(r["left_id"], r["right_id"]) for r in got} == want


def test_structured_answers_of_all_kinds(spark):
    from textloom.operators.structured import COURSE, structured_answers

    matrix = [{"semestre": "1º Semestre", "nome": "Cálculo", "Cr.": "4"}, {"semestre": "2º Semestre", "nome": "Redes", "Cr.": "2"}, {"nome": "Livre", "Cr.": "4"}]
    row = (1, "Engenharia Civil", "graduação", "http://c/1", matrix, [("Ana", "IFM", None, "http://a"), (None, None, None, None)], [("Redes", ["Ana", "Bia"], "T1", "30", None)])
    courses = spark.createDataFrame([row, (2, "Letras", None, None, None, None, None)], f"id long, title string, {COURSE}")
    texts = ["matriz curricular do curso de engenharia civil", "disciplinas do 2º semestre do curso de engenharia civil", "disciplinas de 4 créditos do curso de engenharia civil",
             "professores do curso de engenharia civil?", "turmas ofertadas do curso de engenharia civil", "onde fica a reitoria?", None, "professores do curso de letras"]
    asked = spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")
    got = {r["query_id"]: r for r in structured_answers(asked, courses).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4, 7]
    head = "Curso: Engenharia Civil (graduação)\nURL: http://c/1\n"
    assert got[0]["context"] == head + "=== MATRIZ CURRICULAR COMPLETA ===\n\n1º Semestre:\n- Cálculo | Créditos: 4\n\n2º Semestre:\n- Redes | Créditos: 2\n\nSem semestre:\n- Livre | Créditos: 4"
    assert got[1]["context"] == head + "=== DISCIPLINAS DO 2º SEMESTRE ===\n- Redes | Créditos: 2"
    assert got[2]["context"] == head + "=== DISCIPLINAS COM 4 CRÉDITOS ===\n\n1º Semestre:\n- Cálculo | Créditos: 4\n\nSem semestre:\n- Livre | Créditos: 4"
    assert got[3]["context"] == head + "=== CORPO DOCENTE ===\n  - Ana (IFM) | Perfil: http://a"
    assert got[4]["context"] == head + "=== TURMAS OFERTADAS ===\n  - Redes | Prof: Ana, Bia | Turma T1 | Vagas: 30"
    assert got[7]["context"].endswith("=== CORPO DOCENTE ===\n") and got[7]["sources"] is None


def test_odd_markup_nulls_and_empties(spark):
    import numpy as np

    from textloom.functions import pages
    from textloom.functions.text import capped_json, replaced_section
    from textloom.operators import cache, evaluate, search

    html = """<TITLE lang="pt">\n A </TITLE> <a class='x>y' HREF='/b.html#z'>1</a><A href=c.pdf?x=1>2</A><a href="http://o.org/q/b">3</a><abbr href="no">"""
    df = spark.createDataFrame([("http://h.org/a/", html), ("http://h.org/", None)], "url string, html string")
    assert [r[0] for r in df.select(F.trim(pages.page_title(F.col("html")), F.lit("\n "))).collect()] == ["A", None]
    assert df.select(pages.page_links(F.col("html"))).first()[0] == ["/b.html#z", "c.pdf?x=1", "http://o.org/q/b"]
    assert {r[0] for r in pages.listed_links(df, "b").collect()} == {"http://h.org/b.html", "http://o.org/q/b"}
    assert pages.listed_links(df, "c.pdf").count() == 0
    texts = spark.createDataFrame([("a b", None), (None, None), ("a b", "b a")], "x string, y string")
    assert [r[0]["f1"] for r in texts.select(evaluate.rouge_l(F.col("x"), F.col("y"))).collect()] == [0.0, 0.0, 0.5]
    empty = spark.createDataFrame([], "id long, embedding array<double>")
    index, centres = search.ann_index(empty, 4)
    assert index.count() == 0 and len(centres) == 0
    some = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0])], "id long, embedding array<double>")
    index, centres = search.ann_index(some, 2)
    assert {r["id"]: r["cell"] is None for r in index.collect()} == {1: False, 2: True, 3: False}
    found = search.ann(some.where("id = 1").withColumnRenamed("id", "query_id"), index, centres, 2, 2).collect()
    assert [r["id"] for r in sorted(found, key=lambda r: r["rank"])] == [1, 3]
    assert search.ann(some.withColumnRenamed("id", "query_id"), empty.withColumn("cell", F.lit(1)), np.empty((0, 0)), 2, 2).count() == 0
    parts = spark.createDataFrame([("A\n\nDocentes:\nold\n\nnão\n\nFim", "x $0 \\ y"), ("Docentes: old", "n"), ("none", "n")], "t string, b string")
    assert [r[0] for r in parts.select(replaced_section(F.col("t"), "Docentes:", F.col("b"))).collect()] == ["A\n\nDocentes:\nx $0 \\ y\n\nFim", "Docentes:\nn", "none"]
    cut = parts.select(capped_json(F.struct("t", "b"), 20)).first()[0]
    assert cut.endswith("\n... (truncado)") and cut.startswith("{\n")
    ranks = spark.range(1, 130).select("id", evaluate.truncated_rank(1 / F.col("id")).alias("r")).where("id <> r").collect()
    assert [r["id"] for r in ranks] == [k for k in range(1, 130) if int(1 / (1 / k)) != k]
    answers = spark.createDataFrame([("retrieval", "a"), ("retrieval", None), ("title", "a")], "strategy string, route string")
    assert cache.storable(answers).count() == 1


def test_whole_records_of_pages(spark):
    import json

    from textloom.operators.records import all_records

    card = lambda **f: "<div class='ficha-dados'>" + "".join(f"<p class='ficha-label'>{k}:</p><p class='ficha-campo'>{v}</p>" for k, v in f.items()) + "</div>"
    course = (
        "<h1>Engenharia</h1>" + card(Grau="graduação", Unidade="CENG", Extra="x")
        + "<div id='informacoes'><div class='accordion'><h3>Objetivos</h3><div class='accordion-content'>Formar gente</div></div></div>"
        "<div id='curriculo'><h3 class='cor-fundo'>1º Semestre</h3><div data-content='1'><table><tr><th>Código</th><th>Disciplina / Pré-requisitos</th><th>Caráter</th></tr>"
        "<tr><td>11</td><td><a href='/disciplinas/cod/11'>Cálculo</a></td><td>OB</td></tr></table></div>"
        "<h3 class='cor-fundo'></h3><table><tr><th>Código</th><th>Disciplina / Pré-requisitos</th></tr><tr><td>12</td><td>Redes</td></tr></table></div>"
        "<table id='professores'><tr><td class='h-card'><a class='u-url' href='/servidores/id/1'><span class='p-name'>Ana</span> <span class='p-org'>IFM</span></a></td></tr></table>"
        "<div id='turmas'><table><tr><th>Disciplina</th><th>Turma</th><th>Vagas</th><th>Matric.</th></tr><tr><td><a href='/disciplinas/cod/11'>Cálculo</a>"
        "<span class='tabela-detalhe-info'>Professor Regente: Bia</span><table><tr><td>seg</td></tr></table></td><td>T1</td><td>40</td><td>38</td></tr></table></div>"
    )
    person = card(Nome="Ana", Cargo="Docente") + (
        "<div id='lattes'><a href='http://lattes.cnpq.br/1'>ver</a><h3>Resumo</h3><p>Estuda redes.</p><h3>Formação</h3><p>Doutora</p></div>"
        "<div id='projetos'><a href='/projetos/id/7#x'>Rios</a><a href='/outro'>não</a></div>"
    )
    unit = "<h1>Centro</h1>" + card(Sigla="CE") + "<div id='telefones'>Fones (53) 3921-1401 e 53 99999-1234</div><div id='quadro'><ul><li>Ana</li><li>Bia</li></ul></div><div id='estrutura'>Dois setores</div>"
    old = card(Nome="Velho", Situação="Concluído")
    new = card(Nome="Novo", Status="Ativo") + "<div id='equipe'><table><tr><th>Nome</th><th>Papel</th></tr><tr><td>Ana</td><td>chefe</td></tr></table></div><div id='financeiro'>R$ 5</div>"
    subject = card(Disciplina="Redes") + "<div id='informacoes'><div class='accordion'><h4>Ementa</h4><div></div><div>Camadas</div></div></div><div id='equivalencias'><ul><li>12</li></ul></div>"
    rows = [("http://h/c", course, "curso"), ("http://h/s", person, "servidor"), ("http://h/u", unit, "unidade"), ("http://h/o", old, "projeto"),
            ("http://h/n", new, "projeto"), ("http://h/d", subject, "disciplina"), ("http://h/g", "<h2>A</h2><p>b</p>", "gestao"), (None, None, "sobre"), ("http://h/x", "y", "unknown"), ("http://h/z", None, None)]
    found = all_records(spark.createDataFrame(rows, "url string, html string, k string"), F.col("k"), F.lit("2025-01-01").cast("date")).collect()
    assert sorted(r["tipo"] for r in found) == ["curso", "disciplina", "gestao", "projeto", "servidor", "sobre", "unidade"]
    r = {x["tipo"]: x for x in found}
    data = {k: json.loads(x["dados_completos"]) for k, x in r.items()}
    c = data["curso"]
    assert c["matriz_curricular"] == [{"semestre": "1º Semestre", "Código": "11", "Disciplina / Pré-requisitos": "Cálculo", "Disciplina / Pré-requisitos_url": "http://h/disciplinas/cod/11", "Caráter": "OB"},
                                      {"semestre": "2º Semestre", "Código": "12", "Disciplina / Pré-requisitos": "Redes"}]
    assert c["professores"] == [{"nome": "Ana", "unidade": "IFM", "url": "http://h/servidores/id/1", "lattes": ""}]
    assert c["turmas_ofertadas"] == [{"disciplina": "Cálculo", "disciplina_url": "http://h/disciplinas/cod/11", "professores": ["Bia"], "turma": "T1", "vagas": "40", "matriculados": "38"}]
    assert (c["objetivos"], c["nivel"], c["Extra"], "Grau" in c, r["curso"]["metadata"]["unidade"]) == ("Formar gente", "graduação", "x", False, "CENG")
    assert "\n  - Ana (IFM)\n" in r["curso"]["embedding_text"] and r["curso"]["embedding_text"].endswith("\n  - Cálculo [1º Semestre] (OB)\n  - Redes [2º Semestre] ()")
    s = data["servidor"]
    assert (s["curriculo"], s["lattes_url"]) == ("Resumo: Estuda redes.\nFormação: Doutora", "http://lattes.cnpq.br/1")
    assert s["projetos_vigentes"] == [{"titulo": "Rios", "url": "http://h/projetos/id/7"}]
    assert r["servidor"]["embedding_text"] == "Professor/Servidor: Ana\nCargo: Docente\n\nResumo:\nEstuda redes."
    u = data["unidade"]
    assert (u["telefones"], u["servidores"], r["unidade"]["embedding_text"]) == (["(53) 3921-1401", "53 99999-1234"], ["Ana", "Bia"], "Centro CE Dois setores")
    assert (r["projeto"]["titulo"], data["projeto"]["equipe"], data["projeto"]["financeiro"]) == ("Novo", ["Ana — chefe"], {"info": "R$ 5"})
    assert (data["disciplina"]["ementa"], data["disciplina"]["equivalencias"], r["disciplina"]["embedding_text"]) == ("Camadas", ["12"], "Camadas")
    assert data["gestao"]["secoes"] == {"A": "b"} and r["sobre"]["id"] is None
