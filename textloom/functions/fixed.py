"""Fixed values that results depend on, as plain text."""

# Words that the BM25 tokeniser drops.
INDEX_STOPWORDS = "的 了 是 在 和 有 就 不 也 人 都 一 个 上 我 中 到 大 为 这 与 他 它 要 会 可以 没有 对 对于".split()

# Words that keyword extraction drops.
KEYWORD_STOPWORDS = (
    "的 了 和 是 在 我 有 就 不 人 都 一 一个 上 也 很 到 说 要 去 你 会 着 没有 看 好 自己 这 "
    "the a an is are was were be been being have has had do does did will would should can could may might must to of "
    "in for on with at by from as into through during before after above below"
).split()

# Words that the mixed-script tokeniser drops.
MIXED_STOPWORDS = (
    "the a an and or but in on at to for of with by is are was were be been have has had do does did will would could should "
    "may might must can this that these those i you he she it we they me him her us them my your his its our their "
    "的 了 在 是 我 有 和 就 不 人 都 一 一个 上 也 很 到 说 要 去 你 会 着 没有 看 好 自己 这"
).split()

# Pieces of paths that are never indexed.
EXCLUDED_PATH_PIECES = (
    "/site-packages/ /dist-packages/ /.venv/ /venv/ /.tox/ /python-sdk/ /Python.framework/ /node_modules/ /.next/ /.nuxt/ /dist/ /build/ "
    "/.git/ /__pycache__/ /.pytest_cache/ /.mypy_cache/ /.ruff_cache/ /.cache/ /bge-m3-model/ /chroma/ /chroma-doc-knowledge /archives/ "
    ".bak. /Trash/ /.Trash/ /.DS_Store /.idea/ /.vscode/"
).split()
EXCLUDED_PATH_PATTERN = r"/lib/python3\.[0-9]+/|/python3\.[0-9]+/"

# Names of Python files of low value, in any case.
LOW_VALUE_PATTERNS = (
    r"^test_.+\.py$",
    r".+_test\.py$",
    r".+_test_\d+\.py$",
    r"^bulletproof_.+\.py$",
    r"^standalone_.+\.py$",
    r"^reliable_.+\.py$",
    r"^autonomous_.+\.py$",
    r"^ultra_stable_.+\.py$",
    r"^check_.+\.py$",
    r"^monitor_test_.+\.py$",
    r"^read_headers\.py$",
    r"^inspect_.+\.py$",
    r"^end_to_end_.+\.py$",
    r"^complete_.+_test_.+\.py$",
    r"^downstream_.+\.py$",
)

# Databases and tables that are never indexed.
EXCLUDED_DATABASES = r"^_(archive|trash|staging)"
EXCLUDED_TABLES = r"(?i)(_backup(_[0-9]+)?(_[0-9]+)?$|_backup_|_bak$|_bak_|_bk$|_old$|_old_|_staging$|_tmp$|_temp$)"

# What sanitising replaces by ***, in this order; moderate takes phone and email only.
SANITISE = {
    "phone": r"\b1[3-9][0-9]{9}\b",
    "id_card": r"\b[0-9]{17}[0-9Xx]\b",
    "bank_card": r"\b[0-9]{15,19}\b",
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
}

# Categories of files by what their path holds; the first that matches counts.
CATEGORIES = {
    "news": ["资讯", "news", "report", "日报", "周报"],
    "merchant": ["商户", "customer", "profile", "画像", "客户"],
    "config": ["config", "setting", "配置", "conf"],
    "report": ["汇报", "report", "总结", "review"],
    "mapping": ["mapping", "table", "schema", "结构", "映射"],
    "sql_debug": ["sql", "debug", "query", "调试"],
}
OTHER_CATEGORY = "其他"

CODE_EXTENSIONS = [".py", ".sh", ".yaml", ".yml", ".sql"]

#: The separators that the cascade tries, in this order.
CASCADE_SEPARATORS = ["\n\n", "\n", ". ", "。", "! ", "！", "? ", "？"]
