"""Word lists, tables, patterns and constants that must stay as they are for right results.

Patterns are written for Java's engine: case-insensitive over all of Unicode.
"""

# The marker for missing information.
MISSING = "Não há informações disponíveis"

# Search and chunking constants.
CHUNK_SIZE = 500
CHUNK_OVERLAP = 50
RELEVANCE_THRESHOLD = 0.20
TOP_K_RETRIEVE = 10
TOP_K_FINAL = 4
GATE_K = 4
PER_COLLECTION_K = 2
MAX_CHARS_PER_DOC = 1500
RRF_CONSTANT = 60
SOURCE_CUTOFF = 0.85
ROUTE_CONFIDENCE = 0.6
TITLE_THRESHOLD = 0.35
TITLE_TOP_K = 3
COURSE_THRESHOLD = 0.3
COURSE_TIE_BAND = 0.05
COURSE_TOP_K = 5
CACHE_TTL_SECONDS = 3600
CACHE_MOST_ENTRIES = 512
CACHE_SIMILARITY = 0.82
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25
GUARD_LEAST, GUARD_MOST, OUTPUT_MOST = 3, 1000, 8000
STRICT_GUARD_LEAST = 5
PREFIX_CHARS = 150
SNIPPET_BEFORE, SNIPPET_AFTER, SNIPPET_DEFAULT = 100, 300, 250

# Record types and their collections; any other type goes to the general one.
COLLECTIONS = {
    "curso": "cursos",
    "disciplina": "disciplinas",
    "projeto": "projetos",
    "servidor": "servidores",
    "unidade": "unidades",
    "gestao": "gestao",
    "sobre": "sobre",
}
GENERAL_COLLECTION = "portal_geral"

# Abbreviations of courses, replaced one after another.
COURSE_ABBREVIATIONS = {
    "cc": "Ciência da Computação",
    "ec": "Engenharia de Computação",
    "ee": "Engenharia Elétrica",
    "ea": "Engenharia Agrícola",
    "med": "Medicina",
    "enf": "Enfermagem",
    "agro": "Agronomia",
    "vet": "Medicina Veterinária",
    "dir": "Direito",
    "ped": "Pedagogia",
    "bio": "Ciências Biológicas",
    "quim": "Química",
    "fis": "Física",
    "mat": "Matemática",
    "adm": "Administração",
    "econ": "Ciências Econômicas",
}

# Ordinals of semesters.
ORDINALS = (
    "primeiro", "segundo", "terceiro", "quarto", "quinto", "sexto", "sétimo", "oitavo", "nono", "décimo",
)

# Section headers of records.
SECTION_HEADERS = (
    "Tipo:",
    "Nome do Projeto:",
    "Nome da Atividade:",
    "Nome do Servidor:",
    "Nome da Unidade:",
    "Nome do Curso:",
    "Resumo:",
    "Objetivo Geral:",
    "Objetivos:",
    "Justificativa:",
    "Metodologia:",
    "Ementa:",
    "Conteúdo Programático:",
    "Equipe:",
    "Membros da Equipe:",
    "Coordenador:",
    "Coordenador Atual:",
    "Docentes:",
    "Servidores:",
    "Currículo Lattes:",
    "Formação acadêmica:",
    "Áreas de atuação:",
    "Titulação:",
    "Cargo:",
    "Unidade:",
    "Departamento:",
    "Carga Horária:",
    "Créditos:",
    "Ênfase:",
    "Área CNPq:",
    "Linha de Extensão:",
    "Eixo Temático:",
    "Data inicial - Data final:",
)

# Prompt injection, in order.
INJECTION_PATTERNS = (
    r"ignore\s+(all\s+)?previous\s+instructions",
    r"esquece?\s+(tudo|as\s+instruções)",
    r"novo\s+prompt[:\s]",
    r"system\s*:",
    r"<\s*/?(?:system|user|assistant)\s*>",
    r"\\n\\n###",
    r"\[INST\]",
    r"<\|im_start\|>",
    r"jailbreak",
    r"dan\s+mode",
)

# Personal data, in order; the first that is found names the kind.
PII_PATTERNS = (
    ("CPF", r"\b\d{3}[.\-]?\d{3}[.\-]?\d{3}[.\-]?\d{2}\b"),
    ("CNPJ", r"\b\d{2}[.\-]?\d{3}[.\-]?\d{3}[/\\]?\d{4}[.\-]?\d{2}\b"),
    ("telefone", r"\b(?:\+55\s?)?(?:\(?\d{2}\)?[\s\-]?)?\d{4,5}[\s\-]?\d{4}\b"),
    ("e-mail", r"\b[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}\b"),
    ("RG", r"\b\d{1,2}[.\-]?\d{3}[.\-]?\d{3}[\-]?[0-9xX]\b"),
)

# The second, stricter guard.
STRICT_INJECTION_PATTERNS = (
    r"ignore (all |todas |as )?(previous |anteriores |suas )?instructions",
    r"esqueça (suas |todas |as )?instruções",
    r"você agora é",
    r"act as",
    r"pretend (you are|to be)",
    r"\[system\]",
    r"<system>",
)
STRICT_PII_PATTERNS = (
    ("CPF", r"\d{3}\.?\d{3}\.?\d{3}-?\d{2}"),
    ("e-mail", r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"),
    ("telefone", r"\(\d{2}\)\s?\d{4,5}-?\d{4}"),
)

# Routing rules, in order; the first that is found names the collection.
ROUTES = (
    (
        r"\b(?:professor[a]?|prof\.?|docente|servidor[a]?|pesquisador[a]?)\b.{0,80}"
        r"\b(?:atua|trabalha|pesquisa|estuda|área|especialidade|lattes|titulação|cargo|lotação)\b",
        "servidores",
    ),
    (r"\b(?:atua|trabalha)\b.{0,60}\b(?:professor[a]?|prof\.?|docente|pesquisador[a]?)\b", "servidores"),
    (r"\bqual(?:is)?\b.{0,50}\b(?:professor[a]?|prof\.?|docente|pesquisador[a]?)\b", "servidores"),
    (r"\bquem\b.{0,30}\b(?:pesquisa|atua|trabalha|estuda)\b", "servidores"),
    (r"\b(?:projeto[s]?|extensão|TCC|dissertação|tese)\b", "projetos"),
    (r"\b(?:unidade[s]?|centro[s]?|instituto[s]?|faculdade[s]?|câmpus|endereço)\b", "unidades"),
)

# Words that make a question one about a course's structure.
STRUCTURE_WORDS = (
    r"\b(?:disciplinas?|matérias?|grade\s+curricular|matriz\s+curricular"
    r"|professores?|docentes?|corpo\s+docente|turmas?\s+ofertadas?)\b"
)
TEACHER_WORDS = r"\b(?:professores?|docentes?|corpo\s+docente)\b"
CLASS_WORDS = r"\bturmas?\b"
CREDITS = r"(\d+)\s*cr[eé]ditos?"

# Where a course's name stands in a question and where it ends.
COURSE_END = (
    r"(?:\?|$|\s+(?:que\b|com\b|para\b|onde\b|quando\b|como\b|possui[a-z]*\b|possuem\b|tem\b|têm\b"
    r"|no\s+\d|do\s+\d|\d+[°º]\s*sem))"
)
COURSE_AFTER = r"\bcurso\s+de\s+(.+?)"
COURSE_OF = (
    r"(?:disciplinas?|matérias?|grade|matriz|professores?|docentes?|turmas?)[^?]*?\b(?:da|do|de|na|no)\s+(.+?)"
)
SEMESTER_PREFIX = r"^\d+[°º]\s*sem(?:estre)?\.\s*d[ae]\s*"
ORDINAL_PREFIX = r"^(?:primeiro|segundo|terceiro|quarto|quinto|sexto|sétimo|oitavo)\s+semestre\s+d[ae]\s*"

# Questions about who works in an area.
_TEACHER = r"(?:professor(?:es|a(?:s)?)?|prof\.?|docente(?:s)?|pesquisador(?:es|a(?:s)?)?|servidor(?:es|a(?:s)?)?)"
_WORKS = (
    r"(?:atuam?|trabalham?|pesquisam?|estudam?|lecionam?|ministram?|coordenam?|desenvolvem?"
    r"|têm?\s+expertise|tem\s+expertise)"
)
_IN = r"(?:(?:com|em|sobre|na\s+área\s+de|em\s+área\s+de|de)\s+)?"
AREA_PATTERNS = (
    rf"\b(?:qual(?:is)?)\b.{{0,60}}\b{_TEACHER}\b.{{0,50}}\b{_WORKS}\b\s*{_IN}(.+)",
    rf"\bquem\b\s+{_WORKS}\b\s*{_IN}(.+)",
    rf"\b(?:{_TEACHER}|pesquisadores?)\b.{{0,20}}\bque\s+{_WORKS}\b\s*{_IN}(.+)",
    rf"\b(?:{_TEACHER}|pesquisadores?)\b\s+{_WORKS}\b\s*{_IN}(.+)",
    rf"\b{_TEACHER}\b.{{0,30}}\b(?:têm?|com)\b\s+(?:expertise|especialidade|área)\b\s*(?:em|de|na)?\s+(.+)",
)

# Hints of a record's type in a question (the first that is contained), and how entities are named.
TYPE_HINTS = {
    "professor": "servidor",
    "prof": "servidor",
    "docente": "servidor",
    "servidor": "servidor",
    "curso": "curso",
    "graduação": "curso",
    "bacharelado": "curso",
    "licenciatura": "curso",
    "pós-graduação": "curso",
    "tecnólogo": "curso",
    "grade curricular": "curso",
    "matriz curricular": "curso",
    "semestre do curso": "curso",
    "disciplinas do curso": "curso",
    "unidade": "unidade",
    "centro": "unidade",
    "instituto": "unidade",
    "faculdade": "unidade",
}
ENTITY_PATTERNS = (
    r"(?:o que (?:é|faz|estuda|pesquisa)|quem é|fale sobre|me fale sobre|informações sobre|área d[aeo]|"
    r"trabalha com|atua com|lotad[ao] em|cargo d[ao]|titulação d[ao]|currículo d[ao]|lattes d[ao]|"
    r"coordenador[a]? d[ao]|sobre o curso|o que é o curso|o que trata|ementa d[ae])\s+(.+)",
    r"(?:professor[a]?|prof\.?|servidor[a]?|docente)\s+(.+?)(?:\?|$)",
    r"(?:disciplinas?|matérias?|grade|matriz|professores?|docentes?|turmas?)[^?]*\bcurso\s+de\s+(.+?)(?:\?|$)",
    r"(?:disciplinas?|matérias?|grade|matriz|professores?|docentes?|turmas?)\s+(?:\w+\s+)*(?:d[ao]|n[ao]|no)\s+(.+?)(?:\?|$)",
    r"(?:curso de|graduação em|pós-graduação em|bacharelado em|licenciatura em|tecnólogo em)\s+(.+?)(?:\?|$)",
    r"(?:disciplina|matéria)\s+(.+?)(?:\?|$)",
)
GENERIC_WORDS = ("qual", "quais", "como", "quando", "onde", "por que", "porque", "liste")

# Words of the sentiment rule.
POSITIVE_WORDS = ("bom", "ótimo", "excelente", "adorei", "perfeito")
NEGATIVE_WORDS = ("ruim", "péssimo", "horrível", "odiei", "terrível")

# Parts of a page that are no content.
NOISE_TAGS = ("script", "style", "noscript", "iframe", "nav", "header", "footer", "aside", "form", "button")

# Links to files with these extensions are not followed.
SKIPPED_EXTENSIONS = (
    ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".zip", ".rar", ".png", ".jpg", ".jpeg", ".gif", ".svg", ".mp4", ".mp3", ".ico",
)

# How a text mentions a semester.
SEMESTER_SYMBOL = r"(\d{1,2})[°ºo]\s*sem(?:estre)?\.?"
SEMESTER_WORD = rf"({'|'.join(ORDINALS)})\s+sem(?:estre)?\.?"
SEMESTER_AFTER = r"semestre\s+(\d{1,2})"

# Vector index: links of a node, and the beam of a search.
HNSW_LINKS = 16
HNSW_BEAM = 40

# What marks a link to the next page: words and whole texts of the link, parts of its class.
NEXT_WORDS = ("próxima", "próximo", "next")
NEXT_MARKS = ("»", ">")
NEXT_CLASSES = ("next", "proxima", "pagination-next")

# Searching by keywords: least results of each keyword, beside the one more that each is asked for.
LEAST_PER_KEYWORD = 2

# Abbreviations whose full stop ends no sentence, beside single letters.
ABBREVIATIONS = ("Sr", "Sra", "Srta", "Dr", "Dra", "Prof", "Profa", "Eng", "Av", "Art", "Exmo", "Ltda", "pág", "ex", "etc", "Mr", "Mrs", "Ms", "vs")

# Labels of a course's structure in a context.
COURSE_NAME, COURSE_URL = "Curso: ", ")\nURL: "
NO_SEMESTER = "Sem semestre"
WHOLE_MATRIX = "=== MATRIZ CURRICULAR COMPLETA ===\n"
SUBJECTS, OF_SEMESTER, WITH_CREDITS, CREDITS_LABEL, HEADING_END = "=== DISCIPLINAS", " do ", " com ", " créditos", " ===\n"
TEACHERS, CLASSES = "=== CORPO DOCENTE ===\n", "=== TURMAS OFERTADAS ===\n"
TEACHER_RECORD, TEACHER_PAGE = " | Lattes: ", " | Perfil: "
CLASS_TEACHERS, CLASS_NAME, CLASS_PLACES, CLASS_ENROLLED = " | Prof: ", " | Turma ", " | Vagas: ", " | Matrículas: "

# Labels of contexts and prompts.
TITLE_LABEL, SOURCE_AFTER_TITLE, SOURCE_LABEL = "[Título: ", " | Fonte: ", "[Fonte: "
WHOLE_DOCUMENT = "\n\n[Dados completos do documento]\n"
INSTRUCTION, CONTEXT_LABEL, QUESTION_LABEL = "Responda apenas com base no contexto.", "Contexto:", "Pergunta: "
NOTHING_FOUND = "Não encontrei essa informação."
