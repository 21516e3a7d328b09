"""Typed records (courses, subjects, projects, people, units, texts) from pages' labels, sections and tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import details, fixed, pages
from ..functions.text import contains_any, first_known, is_current, known, label_value, snippet
from .lexical import searchable_terms

# The labels that a record's fields can have on a page, in order of preference.
FIELDS: dict[str, dict[str, tuple[str, ...]]] = {
    "curso": {
        "nome": ("Nome do Curso /Conceitos (*)", "Nome do Curso", "Nome"),
        "nivel": ("Nível / Grau", "Nível", "Grau"),
        "modalidade": ("Modalidade",),
        "turno": ("Turno",),
        "codigo": ("Código",),
        "codigo_emec": ("Código e-MEC",),
        "unidade": ("Unidade",),
        "coordenador": ("Coordenador",),
        "objetivos": ("Objetivos",),
        "formas_ingresso": ("Formas de Ingresso",),
        "contextualizacao": ("Contextualização",),
        "perfil_egresso": ("Perfil do Egresso",),
    },
    "disciplina": {
        "nome": ("Nome da Atividade", "Nome", "Disciplina"),
        "codigo": ("CÓDIGO", "Código", "Código da Disciplina", "codigo"),
        "tipo_atividade": ("Tipo de Atividade",),
        "periodicidade": ("Periodicidade",),
        "creditos": ("CRÉDITOS", "Créditos"),
        "carga_horaria": ("Carga Horária",),
        "ch_teorica": ("CARGA HORÁRIA TEÓRICA", "Carga Horária Teórica"),
        "ch_obrigatoria": ("CARGA HORÁRIA OBRIGATÓRIA", "Carga Horária Obrigatória"),
        "freq_aprovacao": ("FREQUÊNCIA APROVAÇÃO", "Frequência Aprovação"),
        "unidade_responsavel": ("Unidade responsável", "Unidade Responsável", "Unidade"),
        "objetivos": ("Objetivos", "Objetivo"),
        "ementa": ("Ementa",),
        "conteudo_programatico": ("Conteúdo Programático",),
        "bibliografia": ("Bibliografia",),
    },
    "projeto": {
        "nome": ("Nome do Projeto", "Título", "Nome"),
        "resumo": ("Resumo",),
        "data_inicio": ("Data inicial", "Data de Início", "Data Início", "Início"),
        "data_fim": ("Data final", "Data de Término", "Data Fim", "Término", "Fim"),
        "situacao": ("Situação", "Status"),
        "coordenador": ("Coordenador Atual", "Coordenador"),
        "area": ("Área CNPq", "Área"),
        "unidade": ("Unidade de Origem", "Unidade"),
    },
    "servidor": {
        "nome": ("Nome do Servidor", "Nome"),
        "matricula": ("Matrícula",),
        "cargo": ("Cargo", "Função"),
        "lotacao": ("Lotação", "Unidade de Lotação", "Unidade"),
        "regime": ("Regime de Trabalho", "Regime"),
        "contato": ("Contato",),
        "email": ("E-mail",),
        "titulacao": ("Titulação", "Título"),
        "areas": ("Áreas de atuação", "Área de Atuação"),
    },
    "unidade": {
        "nome": ("Nome da Unidade", "Unidade", "Nome"),
        "sigla": ("Sigla",),
        "diretor": ("Diretor", "Diretor Geral"),
        "email": ("E-mail",),
        "endereco": ("Endereço",),
    },
    "gestao": {"nome": ("Nome",)},
    "sobre": {"nome": ("Nome",)},
}

# What of a record's fields goes to its metadata beside address and name.
METADATA = {
    "curso": ("nivel", "modalidade", "unidade"),
    "disciplina": ("codigo", "unidade_responsavel"),
    "projeto": ("data_inicio", "data_fim", "situacao", "coordenador"),
    "servidor": ("matricula", "cargo", "lotacao"),
    "unidade": ("sigla", "diretor"),
    "gestao": (),
    "sobre": (),
}

# The section of a unit's page that can stand for a part of its own.
UNIT_SECTIONS = {"estrutura": "Estrutura", "graduacao": "Graduação", "pos_graduacao": "Pós-Graduação", "orcamento": "Orçamento"}


def _optional(label: str, value: Column) -> Column:
    return F.concat(F.lit(label), known(value))


def _lines(label: str, lines: Column) -> Column:
    """The label and a line for each element; null without any."""
    return F.concat(F.lit(label), F.nullif(F.array_join(lines, "\n"), F.lit("")))


def _or_missing(items: Column) -> Column:
    return F.when(F.coalesce(F.size(items), F.lit(0)) > 0, items).otherwise(F.array(F.lit(MISSING)))


def _teacher(t: Column) -> Column:
    unit = F.concat(F.lit(" ("), known(t["unidade"]), F.lit(")"))
    return F.concat(F.lit("  - "), t["nome"], F.coalesce(unit, F.lit("")), F.coalesce(F.concat(F.lit(" | Lattes: "), known(t["lattes"])), F.lit("")))


def _subject(row: Column) -> Column:
    """A curriculum row's line; null for a row that names no subject."""
    value = lambda key: F.try_element_at(row, F.lit(key))
    rest = [F.coalesce(value(k), F.lit("")) for k in ("semestre", "Caráter")]
    return F.concat(F.lit("  - "), known(value("Disciplina / Pré-requisitos")), F.lit(" ["), rest[0], F.lit("] ("), rest[1], F.lit(")"))


# Fixed values (in this function): the labels of the parts of what is embedded, and the start of a line that ends a summary.
def embedding_text(kind: str, d: dict[str, Column], p: Callable[[str], Column]) -> Column:
    """What of a record is embedded, by its fields d and its page's parts p; missing parts are left out."""
    if kind == "curso":
        return F.concat_ws(
            "\n",
            F.concat(F.lit("Curso de "), d["nivel"], F.lit(" em "), d["nome"]),
            F.concat(F.lit("Modalidade: "), d["modalidade"], F.lit(" | Turno: "), d["turno"]),
            F.concat(F.lit("Unidade responsável: "), d["unidade"]),
            F.concat(F.lit("Coordenador: "), d["coordenador"]),
            _optional("\nSobre o curso:\n", d["contextualizacao"]),
            _optional("\nObjetivos:\n", d["objetivos"]),
            _optional("\nPerfil do egresso:\n", d["perfil_egresso"]),
            _lines("\nProfessores e docentes do curso:\n", F.transform(p("teachers"), _teacher)),
            _lines("\nMatriz curricular (disciplinas):\n", F.transform(p("matrix"), _subject)),
        )
    if kind == "disciplina":
        return first_known(d["objetivos"], d["ementa"], d["nome"])
    if kind == "projeto":
        return first_known(d["resumo"], d["nome"])
    if kind == "servidor":
        summary = F.trim(F.regexp_extract(p("record"), r"(?s)Resumo[:\s]+(.+?)(?=\n[A-ZÁÉÍÓÚÃÕÂÊÔÇ][a-záéíóúãõâêôç]|$)", 1))
        return F.concat_ws(
            "\n",
            F.concat(F.lit("Professor/Servidor: "), d["nome"]),
            _optional("Cargo: ", d["cargo"]),
            _optional("Lotação/Unidade: ", d["lotacao"]),
            _optional("Titulação: ", d["titulacao"]),
            _optional("\nÁreas de atuação:\n", d["areas"]),
            _optional("\nResumo:\n", F.coalesce(known(summary), p("record"))),
        )
    if kind == "unidade":
        return first_known(F.concat_ws(" ", known(d["nome"]), known(d["sigla"]), known(_unit_text("estrutura", p))))
    return p("text")


def _unit_text(name: str, p: Callable[[str], Column]) -> Column:
    return first_known(F.try_element_at(p("texts"), F.lit(name)), F.try_element_at(p("every"), F.lit(UNIT_SECTIONS[name])))


def nested_parts(kind: str, d: dict[str, Column], p: Callable[[str], Column]) -> dict[str, Column]:
    """What a record holds beside its fields of plain text."""
    items = lambda name: F.try_element_at(p("lists"), F.lit(name))
    text = lambda name: F.try_element_at(p("texts"), F.lit(name))
    if kind == "curso":
        return {"matriz_curricular": p("matrix"), "professores": p("teachers"), "turmas_ofertadas": p("classes"), "formas_ingresso": F.array(d["formas_ingresso"])}
    if kind == "disciplina":
        labelled = label_value(p("every"), "Equivalências", "Equivalencia", "Disciplinas Equivalentes", loose=p("loose"))
        same = F.when(known(labelled).isNotNull(), F.array(labelled)).otherwise(F.coalesce(items("equivalencias"), F.array(first_known(text("equivalencias")))))
        return {"equivalencias": same, "turmas_ofertadas": p("offered")}
    if kind == "projeto":
        money = F.when(F.size(p("finance")) > 0, p("finance")).otherwise(F.create_map(F.lit("info"), F.lit(MISSING)))
        return {"equipe": _or_missing(items("equipe")), "financeiro": money}
    if kind == "servidor":
        lone = {"curriculo": p("record"), "lattes_url": p("record_url"), "pgd": text("pgd")}
        return {k: first_known(v) for k, v in lone.items()} | {"projetos_vigentes": p("projects")}
    if kind == "unidade":
        return {k: _unit_text(k, p) for k in UNIT_SECTIONS} | {k: _or_missing(items(k)) for k in ("servidores", "telefones")}
    return {"texto": p("text"), "secoes": p("sections")}


def _joined_json(first: Column, second: Column) -> Column:
    """One JSON object of two with different keys; the first may be empty."""
    return F.when(first == "{}", second).otherwise(F.concat(F.regexp_replace(first, r"\}$", ","), F.substr(second, F.lit(2))))


def all_records(rows: DataFrame, kinds: Column, as_of: Column | None = None) -> DataFrame:
    """id, tipo, titulo, embedding_text, metadata, dados_completos (JSON) of pages (url, html) of any kinds.

    Every page is parsed once, whatever kinds there are; pages of unknown kinds are left out. The id is a digest of
    the address, so it stays the same from one crawl to the next. A field without a label of its own is looked up
    among the sections' headings, and the name in the page's first heading and title. Projects that no longer run at
    as_of are left out. Labels and folding sections that no field names are kept in the JSON, beside the fields and the nested parts.
    """
    typed = rows.select("url", "html", kinds.alias("kind")).where(F.col("kind").isin(*FIELDS))
    read = typed.select("url", "kind", pages.page_title(F.col("html")).alias("title"), details.page_parts("html", F.coalesce("url", F.lit(""))).alias("p"))
    # Columns, not one struct: Catalyst would put a struct's expressions in each place that takes a field of it.
    read = read.select("url", "kind", "title", "p.*")
    p = F.col
    label = lambda *keys: label_value(p("every"), *keys, loose=p("loose"))

    def of_kind(kind: str) -> Column:
        d = {name: first_known(label(*keys)) for name, keys in FIELDS[kind].items()}
        d["nome"] = first_known(label(*FIELDS[kind]["nome"]), p("heading"), F.col("title"))
        nested = nested_parts(kind, d, p)
        taken = F.array(*[F.lit(x) for x in {*[k for keys in FIELDS[kind].values() for k in keys], *FIELDS[kind], *nested}])
        whole = F.struct(*[c.alias(n) for n, c in d.items() if n not in nested], *[c.alias(n) for n, c in nested.items()])
        return F.struct(
            d["nome"].alias("titulo"),
            embedding_text(kind, d, p).alias("embedding_text"),
            F.create_map(*[c for n in ("nome", *METADATA[kind]) for c in (F.lit(n), d[n])], F.lit("url"), F.col("url")).alias("metadata"),
            _joined_json(F.to_json(F.map_filter(p("labels"), lambda k, _: ~F.array_contains(taken, k))), F.to_json(whole)).alias("dados_completos"),
        )

    if as_of is not None:
        end, status = (first_known(label(*FIELDS["projeto"][n])) for n in ("data_fim", "situacao"))
        read = read.where((F.col("kind") != "projeto") | is_current(end, known(status), as_of))
    record = F.coalesce(*[F.when(F.col("kind") == kind, of_kind(kind)) for kind in FIELDS])
    found = read.select("url", "kind", record.alias("r"))
    columns = ("titulo", "embedding_text", "metadata", "dados_completos")
    return found.select(F.sha2("url", 256).alias("id"), F.col("kind").alias("tipo"), *[F.col(f"r.{c}") for c in columns])


def records(rows: DataFrame, kind: str, as_of: Column | None = None) -> DataFrame:
    """The records of pages of one kind, as `all_records` has them."""
    return all_records(rows, F.lit(kind), as_of)


def people_in_area(people: DataFrame, projects: DataFrame, terms: list[str], most: int = 50, most_projects: int = 5) -> DataFrame:
    """part (person, project), name, url, excerpt: people and projects with any of the terms, one row a name.

    people, projects: name, url, content. The first by name and address are taken.
    """
    used = searchable_terms(terms)
    by_name = Window.partitionBy("name").orderBy("url", "content")

    def found(rows: DataFrame, where: Column, limit: int) -> DataFrame:
        hits = rows.where(where).where(known(F.col("name")).isNotNull()).distinct().orderBy("name", "url", "content").limit(limit)
        return hits.withColumn("_nth", F.row_number().over(by_name)).where("_nth = 1").drop("_nth")

    text = F.col("content")
    who = found(people, contains_any(text, used), most).select(F.lit("person").alias("part"), "name", "url", snippet(text, terms).alias("excerpt"))
    what = found(projects, contains_any(text, used) | contains_any(F.col("name"), used), most_projects)
    return who.unionByName(what.select(F.lit("project").alias("part"), "name", "url", F.left(text, F.lit(300)).alias("excerpt")))


#: The marker of what a record doesn't say.
MISSING = fixed.MISSING
