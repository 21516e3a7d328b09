"""What a page holds beside labels: curricula, teachers, classes, lists, sections of people's records. A page is parsed once."""

from __future__ import annotations

import re
from urllib.parse import urldefrag, urljoin

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixed
from .pages import Node, cleaned, headed_sections, labels, list_items, parsed, table_rows

# The parts of a page by their element's id, and what leads to subjects, projects and people's records.
PARTS = {
    "equivalencias": r"equiv", "turmas": r"turma", "equipe": r"equipe|membro|participante", "financeiro": r"financ|orcamento|orçamento|budget",
    "pgd": r"\bpgd\b", "projetos": r"projeto", "estrutura": r"estrutura|organograma", "graduacao": r"(?<!pos.)(?<!pós.)gradua[cç][aã]o",
    "pos_graduacao": r"p[oó]s.grad", "orcamento": r"orçamento|orcamento|budget", "servidores": r"servidor|membro|equipe|quadro",
    "telefones": r"telefone|contato|fone",
}
SUBJECT, PROJECT, RECORD = r"/disciplinas/", r"/projetos/id/", r"(?i)lattes\.cnpq"
PHONE = r"\(?\d{2}\)?\s*\d{4,5}[-.\s]?\d{4}"
ROLES = r"Professor responsável pela turma:|Professor Regente:"
BOILERPLATE = "Informações extraídas do Currículo Lattes"

_TEXT = T.StringType()
_MAP, _TEXTS = T.MapType(_TEXT, _TEXT), T.ArrayType(_TEXT)


def _structs(*names: str, **others: T.DataType) -> T.ArrayType:
    """The type of an array of structs of these texts and other fields, in the order of their names."""
    return T.ArrayType(T.StructType([T.StructField(n, others.get(n, _TEXT)) for n in names]))


#: The type of what `page_parts` returns.
PARTS_TYPE = T.StructType(
    [
        T.StructField(name, kind)
        for name, kind in {
            "text": _TEXT,
            "heading": _TEXT,
            "labels": _MAP,
            "sections": _MAP,
            "every": _MAP,
            "loose": _MAP,
            "matrix": T.ArrayType(_MAP),
            "teachers": _structs("nome", "unidade", "url", "lattes"),
            "classes": _structs("disciplina", "disciplina_url", "professores", "turma", "vagas", "matriculados", professores=_TEXTS),
            "offered": T.ArrayType(_MAP),
            "lists": T.MapType(_TEXT, _TEXTS),
            "texts": _MAP,
            "finance": _MAP,
            "record_url": _TEXT,
            "record": _TEXT,
            "projects": _structs("titulo", "url"),
        }.items()
    ]
)


def _by_id(node: Node, pattern: str) -> Node | None:
    return next((n for n in node.walk() if re.search(pattern, n.attributes.get("id", ""), re.IGNORECASE)), None)


def _of_class(node: Node, *names: str) -> list[Node]:
    return [n for n in node.walk() if set(names) & set(n.attributes.get("class", "").split())]


def _link(node: Node, pattern: str) -> Node | None:
    return next((a for a in node.all("a") if re.search(pattern, a.attributes.get("href", ""))), None)


def _cells(row: Node, *tags: str) -> list[Node]:
    """A row's own cells, without those of tables inside it."""
    return [c for c in row.children if isinstance(c, Node) and c.tag in tags]


def _subject_row(cells: list[Node], heads: list[str], term: str, base: str) -> dict[str, str]:
    row = {"semestre": term}
    for head, cell in zip(heads, cells, strict=False):
        link = _link(cell, SUBJECT)
        row[head] = (link or cell).text()
        if link:
            row[f"{head}_url"] = urljoin(base, link.attributes["href"])
    return row


def curriculum(root: Node, base: str) -> list[dict[str, str]]:
    """The rows of the curriculum's tables, each with the semester whose heading stands before its table; of a page
    without that part the rows of tables whose headers speak of subjects, credits or hours."""
    found, term, terms = [], fixed.MISSING, 0
    part = _by_id(root, "^curriculo$")
    for node in part.walk() if part else ():
        if node.tag == "h3":
            terms += 1
            name = node.text()
            term = f"{terms}º Semestre" if name == fixed.MISSING else name
        elif node.tag == "table" and terms:
            heads = [h.text() for h in node.all("th")]
            rows = [_subject_row(_cells(line, "td"), heads, term, base) for line in node.all("tr")]
            found += [r for r in rows if any(v != fixed.MISSING for k, v in r.items() if k != "semestre")]
    if found:
        return found
    about = re.compile("disciplina|crédito|horas", re.IGNORECASE)
    return [r for t in root.all("table") if about.search(" ".join(h.text() for h in t.all("th"))) for r in table_rows(Node.around(t))]


def teachers(root: Node, base: str) -> list[dict[str, str]]:
    """Name, unit and page of each card among the teachers; their records' addresses come from elsewhere."""
    part, found = _by_id(root, "^professores$"), []
    for card in _of_class(part, "h-card") if part else ():
        names, units = _of_class(card, "p-name", "tabela-detalhe-titulo"), _of_class(card, "p-org", "tabela-detalhe-info")
        to = next((a.attributes["href"] for a in _of_class(card, "u-url") if a.attributes.get("href")), None)
        if names and names[0].text() != fixed.MISSING:
            unit = units[0].text() if units else fixed.MISSING
            found.append({"nome": names[0].text(), "unidade": unit, "url": urljoin(base, to) if to else "", "lattes": ""})
    return found


def classes(root: Node, base: str) -> list[dict]:
    """Offered classes: rows that begin with a link to a subject and end with class, places and enrolments."""
    part, found = _by_id(root, "^turmas$"), []
    for row in part.all("tr") if part else ():
        cells = _cells(row, "td")
        link = _link(cells[0], SUBJECT) if len(cells) > 1 else None
        if link is None:
            continue
        people = [re.sub(ROLES, "", s.text()).strip() for s in _of_class(cells[0], "tabela-detalhe-info") if s.texts()]
        last = [c.text() for c in cells[-3:]] + [fixed.MISSING] * 3
        found.append(
            {"disciplina": link.text(), "disciplina_url": urljoin(base, link.attributes["href"]), "professores": people}
            | dict(zip(("turma", "vagas", "matriculados"), last, strict=False))
        )
    return found


def card_labels(root: Node) -> dict[str, str]:
    """Labels and values of a data card: each label's next sibling that is a field."""
    found: dict[str, str] = {}
    for card in _of_class(root, "ficha-dados"):
        for node in card.walk():
            label = None
            for child in node.children:
                kinds = child.attributes.get("class", "").split() if isinstance(child, Node) else ()
                if "ficha-label" in kinds:
                    label = child.text().rstrip(":").strip()
                elif "ficha-campo" in kinds and label:
                    found.setdefault(label, child.text())
                    label = None
    return found


def accordions(root: Node) -> dict[str, str]:
    """Heading to body of the folding sections among a page's information."""
    found, part = {}, _by_id(root, "^informacoes$")
    for fold in part.walk() if part else ():
        if not re.search("accordion", fold.attributes.get("class", ""), re.IGNORECASE):
            continue
        heads = fold.all("h2", "h3", "h4")
        bodies = [n for n in fold.walk() if n is not fold and re.search(r"(?i)accordion.content|conteudo|body", n.attributes.get("class", ""))]
        bodies = bodies or _cells(fold, "div")[1:2]
        if heads and bodies:
            found.setdefault(heads[0].text(), bodies[0].text())
    return found


def record_of(part: Node) -> str:
    """A person's record: a line for each heading and what stands up to the next."""
    read = {k: cleaned(v.replace(BOILERPLATE, "")) for k, v in headed_sections(part).items()}
    return cleaned("\n".join(f"{k}: {v}" for k, v in read.items() if v != fixed.MISSING))


def _items(part: Node) -> list[str]:
    """A part's list items, else its tables' rows as lines."""
    lines = [" — ".join(v for v in row.values() if v != fixed.MISSING) for row in table_rows(part)]
    return list_items(part) or [x for x in lines if x]


def _loosely(label: str) -> str:
    """As `functions.text.loosely_keyed` has a map's keys."""
    return re.sub(r"\s+", " ", re.sub(r"\(.*?\)", "", label.lower())).strip()


def parts_of(html: str | None, base: str | None) -> dict:
    root, base = parsed(html), base or ""
    at = {name: _by_id(root, pattern) for name, pattern in PARTS.items()}
    lists = {name: _items(at[name]) for name in ("equivalencias", "equipe", "servidores") if at[name]}
    if at["servidores"] and not list_items(at["servidores"]):
        lists["servidores"] = [next(iter(row.values())) for row in table_rows(at["servidores"])]
    if at["telefones"]:
        lists["telefones"] = list_items(at["telefones"]) or re.findall(PHONE, at["telefones"].text())
    record = _by_id(root, "^lattes$")
    linked = record and _link(record, RECORD)
    projects = [a for a in at["projetos"].all("a") if re.search(PROJECT, a.attributes.get("href", ""))] if at["projetos"] else []
    heading = root.all("h1")
    money = at["financeiro"]
    labelled, sections = accordions(root) | labels(root) | card_labels(root), headed_sections(root)
    every = sections | labelled
    return {
        "text": root.text(), "heading": heading[0].text() if heading else None,
        "labels": labelled, "sections": sections,
        "every": every, "loose": {_loosely(k): v for k, v in reversed(every.items())},
        "matrix": curriculum(root, base), "teachers": teachers(root, base), "classes": classes(root, base),
        "offered": table_rows(at["turmas"]) if at["turmas"] else [],
        "lists": {k: v for k, v in lists.items() if v},
        "texts": {k: at[k].text() for k in ("pgd", "estrutura", "graduacao", "pos_graduacao", "orcamento", "equivalencias") if at[k]},
        "finance": (labels(money) | card_labels(money) or {"info": money.text()}) if money else {},
        "record_url": linked.attributes["href"] if linked else None, "record": record_of(record) if record else None,
        "projects": [{"titulo": a.text(), "url": urldefrag(urljoin(base, a.attributes["href"])).url} for a in projects],
    }


@F.pandas_udf(PARTS_TYPE)
def page_parts(html: pd.Series, url: pd.Series) -> pd.DataFrame:
    """All parts of a page, by one pass of the parser."""
    return pd.DataFrame([parts_of(h, u) for h, u in zip(html, url, strict=True)], columns=PARTS_TYPE.names)
