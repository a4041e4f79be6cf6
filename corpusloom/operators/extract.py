"""Definitions, imports, routes, symbols and environment variables.

Declarations come from one linear scan of a file with strings and comments masked and brackets matched
(``functions.scanner``); imports, variables and routes from line patterns. Everything runs inside the file's row, so
extraction needs no shuffle and no join, and what leaves the row are small structs, never its line array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.functions import paths, scanner
from corpusloom.functions.rows import explode_rows, posexplode_rows
from corpusloom.functions.text import strip
from corpusloom.functions.vectors import bind
from corpusloom.operators import lines as line_ops

DECLARATION_ITEM = "struct<" + scanner.DECLARATION.replace(" ", ":").replace(",:", ",") + ",header:string,body:string>"


def _indent(line: Column) -> Column:
    return F.length(line) - F.length(F.ltrim(line, F.lit(" \t")))


def labelled_lines(lines: Column, labels: Column) -> Column:
    """``array<struct<n, x, label>>`` of a file's lines.

    The labels are bound before the lambda: a column referenced once, inside a lambda only, would be inlined there by the
    optimizer and computed again for every line.
    """
    return bind(
        F.split(labels, ""),
        lambda letters: F.transform(
            lines, lambda x, i: F.struct((i + 1).cast("int").alias("n"), x.alias("x"), F.get(letters, i).alias("label"))
        ),
    )


def normalize_expr(c: Column) -> Column:
    """Source text of an expression with simple double-quoted strings respelled in single quotes."""
    return F.regexp_replace(strip(c), "\"([^\"'\\\\]*)\"", "'$1'")


def with_declarations(files: DataFrame) -> DataFrame:
    """Add ``labels``, the ``decls`` array and the ``handlers`` array (needs ``lines``, ``content``, ``language``).

    For JS and TS, what lies inside a function, class, interface or type is no declaration of its own, except methods,
    which are kept directly inside a class.
    """
    found = line_ops.classify_lines(files).withColumn("_scan", scanner.scanned(F.col("lines"), F.col("language")))
    return found.withColumn("decls", F.col("_scan.decls")).withColumn("handlers", F.col("_scan.handlers")).drop("_scan")


def enclosing(decls: Column, line: Column) -> Column:
    """Innermost declaration whose block holds a line (null outside of all); declarations are in line order."""
    return F.try_element_at(F.filter(decls, lambda d: (d["n"] <= line) & (line <= d["end"])), F.lit(-1))


def declaration_items(lines: Column, decls: Column) -> Column:
    """The ``decls`` with their ``header`` and ``body`` text, cut from the file's own line array."""

    def item(d: Column, rows: Column) -> Column:
        header = F.array_join(F.slice(rows, d["n"], d["sig_end"] - d["n"] + 1), "\n")
        body = F.array_join(F.slice(rows, d["sig_end"] + 1, F.greatest(F.lit(0), d["end"] - d["sig_end"])), "\n")
        return d.withField("header", header).withField("body", body)

    return bind(lines, lambda rows: F.transform(decls, lambda d: item(d, rows)))


def declaration_rows(files: DataFrame) -> DataFrame:
    """One row per declaration with its header, body text, decorators and enclosing declaration.

    ``files`` come from :func:`with_declarations`.
    """
    return explode_rows(files, declaration_items(F.col("lines"), F.col("decls")), "d", "repo", "path", "language").select(
        "repo", "path", "language", *declaration_columns("d")
    )


def declaration_columns(d: str) -> list[Column]:
    """The columns of :func:`declaration_rows` from one of :func:`declaration_items`."""
    field = lambda name: F.col(f"{d}.{name}")
    outer = F.struct(field("outer_kind").alias("kind"), field("outer_name").alias("name"), field("outer_ind").alias("ind"))
    return [
        field("n").alias("start_line"), field("end").alias("end_line"), field("ind").alias("indent"), field("kind").alias("kind"),
        field("name").alias("name"), field("header").alias("header"), field("body").alias("body"),
        F.transform(field("decorators"), normalize_expr).alias("decorators"), outer.alias("outer"),
        field("params").alias("params"), field("returns").alias("returns"),
    ]


# A comma that separates parameters: the next bracket after it does not close.
_COMMA = r",(?![^\[\](){}]*[\])}])"


def _split_args(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, _COMMA), strip), lambda p: p != "")


def python_parameters(header: Column) -> Column:
    """Positional parameter names, as written (without defaults and annotations)."""
    return F.transform(_positional(header), lambda p: F.regexp_extract(p, r"^(\w+)", 1))


def _all_params(header: Column) -> Column:
    return _split_args(F.regexp_extract(header, r"(?s)^\s*(?:async\s+)?def\s+\w+\s*\((.*)\)\s*(?:->[^:]*)?:", 1))


def _positional(header: Column) -> Column:
    def cut(params: Column) -> Column:
        star = F.array_position(F.transform(params, lambda p: p.startswith("*")), True)
        head = F.when(star > 0, F.slice(params, 1, (star - 1).cast("int"))).otherwise(params)
        # Names before a bare slash are positional-only and not listed.
        return bind(
            head,
            lambda h: F.when(
                F.array_contains(h, "/"), F.slice(h, (F.array_position(h, "/") + 1).cast("int"), F.size(h))
            ).otherwise(h),
        )

    return bind(_all_params(header), cut)


def _without_default(p: Column) -> Column:
    return normalize_expr(F.regexp_replace(p, r"(?s)\s*=.*$", ""))


def python_signature(kind: Column, name: Column, header: Column) -> Column:
    stars = F.filter(_all_params(header), lambda p: p.rlike(r"^\*{1,2}\w"))
    varargs = F.transform(stars, lambda p: F.regexp_extract(p, r"^(\*{1,2}\w+)", 1))
    params = F.array_join(
        F.concat(F.transform(_positional(header), lambda p: F.regexp_replace(_without_default(p), r"\s*:\s*", ": ")), varargs), ", "
    )
    bases = F.regexp_extract(header, r"(?s)^\s*class\s+\w+\s*\((.*)\)\s*:", 1)
    positional_bases = F.filter(_split_args(bases), lambda x: ~x.rlike(r"^\w+\s*="))
    returns = return_type(header)
    return F.when(
        kind == "class",
        F.concat(
            F.lit("class "), name,
            F.when(F.size(positional_bases) > 0, F.concat(F.lit("("), F.array_join(positional_bases, ", "), F.lit(")"))).otherwise(
                F.lit("")
            ),
        ),
    ).otherwise(
        F.concat(kind, F.lit(" "), name, F.lit("("), params, F.lit(")"), F.coalesce(F.concat(F.lit(" -> "), returns), F.lit("")))
    )


def return_type(header: Column) -> Column:
    return F.nullif(normalize_expr(F.regexp_extract(header, r"(?s)\)\s*->\s*(.+?)\s*:\s*$", 1)), F.lit(""))


def clean_docstring(raw: Column) -> Column:
    """A docstring without the margin its later lines share and without blank edges."""
    rows = F.split(raw, "\n")
    later = F.slice(rows, 2, F.size(rows))
    margin = F.array_min(F.transform(F.filter(later, lambda x: strip(x) != ""), _indent))
    joined = F.array_join(
        F.concat(
            F.array(F.ltrim(F.get(rows, 0))),
            F.when(
                F.size(rows) > 1, F.transform(later, lambda x: F.substr(x, F.coalesce(margin, F.lit(0)) + 1))
            ).otherwise(F.array().cast("array<string>")),
        ),
        "\n",
    )
    return F.regexp_replace(F.regexp_replace(joined, r"^(?:[ \t]*\n)+", ""), r"\s+$", "")


def docstring(body: Column) -> Column:
    """The string that opens a Python body, or null."""
    lead = r"(?s)^(?:[ \t]*(?:#[^\n]*)?\n)*[ \t]*[rRuU]{0,2}"
    triple = F.regexp_extract(body, lead + r"(\"\"\"|''')(.*?)\1", 2)
    has_triple = body.rlike(lead + r"(\"\"\"|''').*?\1")
    single = F.regexp_extract(body, lead + r"(?:\"((?:[^\"\\\n]|\\.)*)\"|'((?:[^'\\\n]|\\.)*)')[ \t]*(?:\n|$)", 1)
    has_single = body.rlike(lead + r"(?:\"(?!\"\")(?:[^\"\\\n]|\\.)*\"|'(?!'')(?:[^'\\\n]|\\.)*')[ \t]*(?:\n|$)")
    return F.when(has_triple, clean_docstring(triple)).when(has_single, clean_docstring(single))


def entities(files: DataFrame) -> DataFrame:
    """The entities table with the source text of each entity: top-level classes with their methods, top-level functions,
    interfaces, type aliases and module variables. JS and TS entities carry no docstring or parameters."""
    rows = declaration_rows(files)
    header, body, name, kind = F.col("header"), F.col("body"), F.col("name"), F.col("kind")
    empty = F.array().cast("array<string>")
    code = F.when(F.col("end_line") > F.col("start_line"), F.concat_ws("\n", header, F.nullif(body, F.lit("")))).otherwise(header)
    python = rows.filter(F.col("language") == "Python").withColumn(
        "type",
        F.when((kind == "class") & (F.col("indent") == 0), F.lit("class"))
        .when((kind != "class") & (F.col("indent") == 0), F.lit("function"))
        .when((kind != "class") & (F.col("outer.kind") == "class") & (F.col("outer.ind") == 0), F.lit("method")),
    ).filter(F.col("type").isNotNull()).select(
        "repo", "path", "name", "type", "start_line", "end_line", python_signature(kind, name, F.col("params")).alias("signature"),
        docstring(body).alias("docstring"), F.when(F.col("type") == "method", F.col("outer.name")).alias("parent"), "decorators",
        F.when(kind == "class", empty).otherwise(python_parameters(F.col("params"))).alias("parameters"),
        F.when(kind != "class", return_type(F.col("params"))).alias("return_type"), paths.visibility(name).alias("visibility"), "language",
        code.alias("code"),
    )
    params, returns = F.col("params"), F.col("returns")
    tail = F.coalesce(F.concat(F.lit(": "), returns), F.lit(""))
    signature = (
        F.when(kind == "function", F.concat(F.lit("function "), name, params, tail))
        .when(kind == "arrow", F.concat(F.lit("const "), name, F.lit(" = "), params, F.lit(" => ..."), tail))
        .when(kind == "method", F.concat(name, params, tail))
        .when(kind == "type_alias", F.concat(F.lit("type "), name, F.lit(" = ...")))
        .otherwise(F.concat(kind, F.lit(" "), name))
    )
    script = rows.filter(F.col("language") != "Python").select(
        "repo", "path", "name", F.when(kind == "arrow", F.lit("function")).otherwise(kind).alias("type"), "start_line", "end_line",
        signature.alias("signature"), F.lit(None).cast("string").alias("docstring"),
        F.when(kind == "method", F.col("outer.name")).alias("parent"), empty.alias("decorators"), empty.alias("parameters"),
        returns.alias("return_type"), F.lit(None).cast("string").alias("visibility"), "language", code.alias("code"),
    )
    return python.unionByName(script).unionByName(python_variables(files))


VAR_ASSIGN, VAR_ANNOTATED = r"^([A-Za-z_]\w*)\s*=(?!=)", r"^([A-Za-z_]\w*)\s*:\s*([^=]+?)\s*(?:=.*)?$"
_BLOCK_WORD = r"^(?:else|try|finally|class|def|if|for|while|with|return|elif|except|async|lambda|match|case)\b"


def _variable_marks(lines: Column, labels: Column) -> Column:
    """Numbered module-level assignment lines: names longer than one character or in capitals, and annotated names."""
    numbered = labelled_lines(lines, labels)

    def wanted(r: Column) -> Column:
        name = F.regexp_extract(r["x"], VAR_ASSIGN, 1)
        assigned = r["x"].rlike(VAR_ASSIGN) & ((F.length(name) > 1) | (F.upper(name) == name))
        return (r["label"] == "c") & (assigned | (~r["x"].rlike(VAR_ASSIGN) & r["x"].rlike(VAR_ANNOTATED) & ~r["x"].rlike(_BLOCK_WORD)))

    return F.filter(numbered, wanted)


def has_entities(files: DataFrame) -> Column:
    """Whether a file yields any entity, told from its own row (so the fallback chunk needs no anti-join)."""
    python = F.exists("decls", lambda d: d["ind"] == 0) | (F.size(_variable_marks(F.col("lines"), F.col("labels"))) > 0)
    return F.when(F.col("language") == "Python", python).otherwise(F.size("decls") > 0)


def python_variables(files: DataFrame) -> DataFrame:
    """Module-level assignments as entities."""
    assign, annotated = VAR_ASSIGN, VAR_ANNOTATED
    x = F.col("v.x")
    is_assign = x.rlike(assign)
    name = F.when(is_assign, F.regexp_extract(x, assign, 1)).otherwise(F.regexp_extract(x, annotated, 1))
    kind = F.when(~is_assign, normalize_expr(F.regexp_extract(x, annotated, 2)))

    def count(chars: str) -> Column:
        return F.length(x) - F.length(F.translate(x, chars, ""))

    closes = F.filter(
        F.transform("lines", lambda y, i: F.when((i + 1 > F.col("v.n")) & y.rlike(r"^[\])}]"), (i + 1).cast("int"))),
        lambda i: i.isNotNull(),
    )
    end = F.when(count("([{") > count(")]}"), F.coalesce(F.get(closes, 0), F.col("v.n"))).otherwise(F.col("v.n"))
    empty = F.array().cast("array<string>")
    none = F.lit(None).cast("string")
    return (
        explode_rows(
            files.filter(F.col("language") == "Python"), _variable_marks(F.col("lines"), F.col("labels")), "v",
            "repo", "path", "language", "lines",
        ).select(
            "repo", "path", name.alias("name"), F.lit("variable").alias("type"), F.col("v.n").alias("start_line"),
            end.alias("end_line"),
            F.when(is_assign, F.concat(name, F.lit(" = ..."))).otherwise(F.concat(name, F.lit(": "), kind)).alias("signature"),
            none.alias("docstring"), none.alias("parent"), empty.alias("decorators"), empty.alias("parameters"),
            kind.alias("return_type"), F.lit("public").alias("visibility"), "language",
            F.array_join(F.slice("lines", F.col("v.n"), end - F.col("v.n") + 1), "\n").alias("code"),
        )
    )


PY_FROM = r"(?s)^from\s+(\.*)([\w.]*)\s+import\s+(?:\(([^)]*)\)|([^\n(]+))"
JS_IMPORT = r"(?s)^\s*import\s+(?:type\s+)?(?:([^'\";]+?)\s+from\s+)?['\"]([^'\"\n]+)['\"]"


IMPORT_LINE = r"^(?:import|from)\s|^\s+import\s"
#: A first line that does not hold the whole statement: an open bracket, a continued line, or no module name yet.
OPEN_IMPORT = r"[({][^)}]*$|\\\s*$|^\s*import\s+(?:type\s+)?[^'\"(]*$"


_IMPORT = "array<struct<module:string,imported_names:array<string>,alias:string,is_relative:boolean>>"


def import_statements(lines: Column, labels: Column) -> Column:
    """``array<struct<n, x>>``: import lines of code, read up to the next import where the first line leaves them open."""
    numbered = labelled_lines(lines, labels)
    marks = F.filter(numbered, lambda r: (r["label"] == "c") & r["x"].rlike(IMPORT_LINE))

    def statement(rows: Column, m: Column, r: Column, i: Column) -> Column:
        after = F.coalesce(F.get(m, i + 1)["n"], F.size(rows) + 1)
        more = r["x"].rlike(OPEN_IMPORT)
        return F.struct(r["n"].alias("n"), F.when(more, F.array_join(F.slice(rows, r["n"], after - r["n"]), "\n")).otherwise(r["x"]).alias("x"))

    return bind(lines, lambda rows: bind(marks, lambda m: F.transform(m, lambda r, i: statement(rows, m, r, i))))


def imported(x: Column, language: Column) -> Column:
    """The imports of one statement; a plain Python import of several modules gives several."""
    none, text = F.lit(None).cast("string"), lambda c: F.nullif(c, F.lit(""))

    def row(module: Column, names: Column, alias: Column, relative: Column) -> Column:
        return F.struct(module.alias("module"), names.alias("imported_names"), alias.alias("alias"), relative.alias("is_relative"))

    def words(list_: Column) -> Column:
        return F.filter(F.transform(F.split(list_, ","), strip), lambda p: p != "")

    listed = words(F.regexp_replace(F.regexp_extract(x, r"^import\s+([^\n#;]+)", 1), r"\\", ""))
    module = lambda p: F.regexp_extract(p, r"^([\w.]+)", 1)
    plain = F.transform(listed, lambda p: row(module(p), F.array(module(p)), text(F.regexp_extract(p, r"\sas\s+(\w+)", 1)), F.lit(False)))
    body = F.regexp_replace(F.concat(F.regexp_extract(x, PY_FROM, 3), F.regexp_extract(x, PY_FROM, 4)), r"#[^\n]*|\\", "")
    chosen = bind(words(body), lambda parts: F.array(row(
        F.regexp_extract(x, PY_FROM, 2), F.transform(parts, lambda p: F.regexp_extract(p, r"^(\*|\w+)", 1)),
        F.when(F.size(parts) == 1, text(F.regexp_extract(F.get(parts, 0), r"\sas\s+(\w+)", 1))), F.regexp_extract(x, PY_FROM, 1) != "")))
    clause = words(F.translate(F.regexp_extract(x, JS_IMPORT, 1), "{}", ""))
    script = F.array(row(
        F.regexp_extract(x, JS_IMPORT, 2), F.transform(clause, lambda p: F.substring_index(p, " ", 1)), none,
        F.regexp_extract(x, JS_IMPORT, 2).startswith(".")))
    python = language == "Python"
    return (
        F.when(python & x.rlike(r"^import\s"), plain.cast(_IMPORT)).when(python & x.rlike(PY_FROM), chosen.cast(_IMPORT))
        .when(~python & x.rlike(JS_IMPORT), script.cast(_IMPORT))
    )


def imports(files: DataFrame) -> DataFrame:
    """The imports table (needs ``labels``). A plain Python import of several modules gives a row each."""
    lines = explode_rows(files, import_statements(F.col("lines"), F.col("labels")), "r", "repo", "path", "language")
    rows = explode_rows(lines, imported(F.col("r.x"), F.col("language")), "i", "repo", "path", "language", F.col("r.n").alias("line_number"))
    return rows.select("repo", "path", "i.module", "i.imported_names", "i.alias", "i.is_relative", "line_number", "language")


def page_links(pages: DataFrame) -> DataFrame:
    """Links of web pages in the imports schema: one row per ``href`` in page order."""
    links = F.regexp_extract_all("html", F.lit(r"<a\s[^>]*href=\"([^\"]+)\""), F.lit(1))
    return posexplode_rows(pages, links, "pos", "module", "page_id", F.col("url").alias("path"))


# Route decorators and calls.
PY_ROUTE = r"(?i)@(?:router|app)\.(get|post|put|delete|patch|options|head)\(\s*[\"']([^\"']+)[\"']"
JS_ROUTE = r"(?i)(?:router|app)\.(get|post|put|delete|patch)\(\s*[\"']([^\"']+)[\"']"
HANDLER = r"def\s+([A-Za-z0-9_]+)\s*\("
#: Lines read first for a route's handler; only where these hold none is the rest of the file read.
NEAR_LINES = 6


def routes(files: DataFrame) -> DataFrame:
    """HTTP routes: decorator routes with the next function below them, and script routes."""
    python = F.col("language") == "Python"
    pattern = lambda x: F.when(python, x.rlike(PY_ROUTE)).otherwise(x.rlike(JS_ROUTE))
    numbered = F.transform("lines", lambda x, i: F.struct((i + 1).cast("int").alias("n"), x.alias("x")))
    marks = F.filter(numbered, lambda r: pattern(r["x"]))

    def handler(lines: Column, n: Column) -> Column:
        below = lambda count: F.nullif(F.regexp_extract(F.array_join(F.slice(lines, n + 1, count), "\n"), HANDLER, 1), F.lit(""))
        return F.coalesce(below(F.lit(NEAR_LINES)), below(F.size(lines)), F.lit("handler"))

    named = bind(F.col("lines"), lambda lines: F.transform(marks, lambda r: F.struct(
        r["n"].alias("n"), r["x"].alias("x"), F.when(python, handler(lines, r["n"])).otherwise(F.lit("route_handler")).alias("handler"))))
    x = F.col("r.x")
    return explode_rows(files, named, "r", "repo", "path", "language").select(
        "repo", F.upper(F.when(python, F.regexp_extract(x, PY_ROUTE, 1)).otherwise(F.regexp_extract(x, JS_ROUTE, 1))).alias("method"),
        F.when(python, F.regexp_extract(x, PY_ROUTE, 2)).otherwise(F.regexp_extract(x, JS_ROUTE, 2)).alias("route"),
        F.col("r.handler").alias("handler_name"), F.col("path").alias("file_path"), F.col("r.n").alias("line_number"),
    )


def symbols(entity_rows: DataFrame, max_files: int | None = None) -> DataFrame:
    """Functions, classes and ``Class.method`` of the Python files, or the first ``max_files`` by path, of each repository."""
    python = entity_rows.filter((F.col("language") == "Python") & F.col("type").isin("function", "class", "method"))
    if max_files is not None:
        order = Window.partitionBy("repo").orderBy("path")
        chosen = python.select("repo", "path").distinct().withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= max_files)
        python = python.join(chosen.drop("_n"), ["repo", "path"], "left_semi")
    name = F.when(F.col("type") == "method", F.concat("parent", F.lit("."), "name")).otherwise(F.col("name"))
    signature = F.when(F.col("type") == "class", F.concat(F.lit("class "), "name")).otherwise(
        F.concat(F.lit("def "), "name", F.lit("("), F.array_join("parameters", ", "), F.lit(")"))
    )
    return python.select(
        "repo", name.alias("name"), F.col("type").alias("symbol_type"), F.col("path").alias("file_path"), "start_line", "end_line",
        signature.alias("signature"), "docstring",
    )


# How environment variables are read, and in which files.
ENV_VAR = r"(?:os\.environ(?:\.get\(|\[)|os\.getenv\(|process\.env\.)[\"']([A-Z0-9_]{3,})[\"']|process\.env\.([A-Z0-9_]{3,})"
ENV_EXTENSIONS = (".py", ".js", ".ts", ".json", ".example")


def env_vars(files: DataFrame, limit: int | None = None) -> DataFrame:
    """Environment variables referenced in a repository, distinct, ranked by name; the first ``limit`` where given."""
    found = F.concat(
        F.regexp_extract_all("content", F.lit(ENV_VAR), F.lit(1)), F.regexp_extract_all("content", F.lit(ENV_VAR), F.lit(2))
    )
    wanted = files.filter(paths.suffix(F.col("path")).isin(*ENV_EXTENSIONS) & ~paths.in_ignored_dir(F.col("path"), "docs"))
    names = (
        explode_rows(wanted, F.array_distinct(found), "name", "repo")
        .filter((F.col("name") != "") & ~F.col("name").startswith("_"))
        .distinct()
    )
    order = Window.partitionBy("repo").orderBy("name")
    ranked = names.withColumn("rank", F.row_number().over(order))
    return ranked if limit is None else ranked.filter(F.col("rank") <= limit)


# Manifests and documents picked up at the root of a repository.
MANIFESTS = (
    "package.json", "requirements.txt", "pyproject.toml", "setup.py", "Pipfile", "Cargo.toml", "go.mod", "pom.xml",
    "build.gradle", "Dockerfile", "docker-compose.yml",
)
DOC_FILES = ("README.md", "README", "CONTRIBUTING.md", "LICENSE", "docs/architecture.md")


def manifests(files: DataFrame, limit: int | None = None) -> DataFrame:
    """Manifest and document files of each repository, cut to ``limit`` characters where given."""
    kind = F.when(F.col("path").isin(*MANIFESTS), F.lit("manifest")).when(F.col("path").isin(*DOC_FILES), F.lit("document"))
    return files.filter(F.col("path").isin(*MANIFESTS, *DOC_FILES)).select(
        "repo", "path", kind.alias("kind"), (F.col("content") if limit is None else F.left("content", F.lit(limit))).alias("content")
    )


def test_frameworks(files: DataFrame) -> DataFrame:
    """Test tools per repository: pytest by file layout, the others by the package manifest."""
    manifest = F.col("path") == "package.json"
    flags = files.groupBy("repo").agg(
        F.bool_or((F.col("path") == "pytest.ini") | F.col("path").startswith("tests/")).alias("pytest"),
        *[F.bool_or(manifest & F.col("content").contains(t)).alias(t) for t in ("jest", "vitest", "playwright")],
    )
    names = ("jest", "playwright", "pytest", "vitest")
    return flags.select("repo", F.array_compact(F.array(*[F.when(F.col(t), F.lit(t)) for t in names])).alias("test_frameworks"))
