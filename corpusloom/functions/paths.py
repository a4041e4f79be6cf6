"""Path, language, URL and key columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Directory names pruned by each scan profile.
SCAN_IGNORED_DIRS = (
    ".git", "node_modules", "__pycache__", ".venv", "venv", "env", ".next", "dist", "build", "coverage", ".idea",
    ".vscode", ".pytest_cache", ".mypy_cache", ".ruff_cache", ".turbo", ".svn", ".hg", "target", "bin", "obj",
    ".gradle", ".cargo", ".cache", ".yarn",
)
DOCS_IGNORED_DIRS = (
    ".git", "node_modules", "venv", ".venv", "__pycache__", ".pytest_cache", ".next", "dist", "build", "chroma_db",
    ".idea", ".vscode",
)

# Extensions of media, archives, binaries, fonts and source maps.
IGNORED_EXTENSIONS = (
    ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".svg", ".ico", ".webp", ".tiff", ".mp4", ".mov", ".avi", ".mkv", ".mp3",
    ".wav", ".ogg", ".flac", ".zip", ".tar", ".gz", ".tgz", ".bz2", ".xz", ".7z", ".rar", ".pdf", ".doc", ".docx",
    ".xls", ".xlsx", ".ppt", ".pptx", ".exe", ".dll", ".so", ".dylib", ".class", ".pyc", ".pyo", ".pyd", ".wasm",
    ".bin", ".iso", ".dmg", ".woff", ".woff2", ".ttf", ".eot", ".otf", ".map",
)

# Language per extension and per special file name.
LANGUAGE_BY_EXTENSION = {
    ".py": "Python", ".pyw": "Python", ".ts": "TypeScript", ".tsx": "TypeScript", ".js": "JavaScript",
    ".jsx": "JavaScript", ".mjs": "JavaScript", ".cjs": "JavaScript", ".html": "HTML", ".htm": "HTML", ".css": "CSS",
    ".scss": "CSS", ".sass": "CSS", ".less": "CSS", ".java": "Java", ".c": "C", ".h": "C", ".cpp": "C++",
    ".cc": "C++", ".cxx": "C++", ".hpp": "C++", ".hxx": "C++", ".cs": "C#", ".go": "Go", ".rs": "Rust",
    ".php": "PHP", ".rb": "Ruby", ".swift": "Swift", ".kt": "Kotlin", ".kts": "Kotlin", ".scala": "Scala",
    ".sh": "Shell", ".bash": "Shell", ".zsh": "Shell", ".sql": "SQL", ".r": "R", ".dart": "Dart", ".lua": "Lua",
    ".json": "JSON", ".yaml": "YAML", ".yml": "YAML", ".toml": "TOML", ".xml": "XML", ".md": "Markdown",
    ".markdown": "Markdown",
}
LANGUAGE_BY_FILENAME = {
    "dockerfile": "Dockerfile", "makefile": "Makefile", "gemfile": "Ruby", "rakefile": "Ruby",
    "cmakelists.txt": "CMake",
}
PARSEABLE_EXTENSIONS = {
    ".py": "Python", ".pyw": "Python", ".js": "JavaScript", ".jsx": "JavaScript", ".mjs": "JavaScript",
    ".cjs": "JavaScript", ".ts": "TypeScript", ".tsx": "TypeScript",
}

# Markers of library and runtime code in a stack-frame path.
VENDOR_MARKERS = (
    "/lib/python", "/site-packages/", "/node_modules/", "/dist-packages/", "<frozen ", "<string>", "<module>",
    "internal/", "/usr/lib/",
)

NO_EXTENSION = "(no extension)"


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_dir(path: Column) -> Column:
    """Directory part of a path, empty at the root."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def extension_key(path: Column) -> Column:
    return F.coalesce(F.nullif(suffix(path), F.lit("")), F.lit(NO_EXTENSION))


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r"^.+(\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    """File name without its last suffix."""
    name = base_name(path)
    return F.when(suffix(path) == "", name).otherwise(F.regexp_extract(name, r"^(.+)\.[^.]+$", 1))


def _lookup(mapping: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def detect_language(path: Column) -> Column:
    """Special file names, then ``dockerfile.*``, then the extension; null where unknown."""
    name = F.lower(base_name(path))
    return F.coalesce(
        _lookup(LANGUAGE_BY_FILENAME, name),
        F.when(name.startswith("dockerfile."), F.lit("Dockerfile")),
        _lookup(LANGUAGE_BY_EXTENSION, suffix(path)),
    )


def parseable_language(path: Column) -> Column:
    """Python, JavaScript or TypeScript by extension; null for files that are not analysed as code."""
    return _lookup(PARSEABLE_EXTENSIONS, suffix(path))


def in_ignored_dir(path: Column, profile: str = "scan") -> Column:
    """Whether a directory segment of the path is pruned.

    ``scan`` ignores case; ``security`` keeps case and also prunes every dot-directory; ``docs`` has its own list.
    """
    segments = F.split(parent_dir(path), "/")
    if profile == "scan":
        return F.exists(segments, lambda s: F.lower(s).isin(*SCAN_IGNORED_DIRS))
    if profile == "security":
        return F.exists(segments, lambda s: s.isin(*SCAN_IGNORED_DIRS) | s.startswith("."))
    if profile == "docs":
        return F.exists(segments, lambda s: s.isin(*DOCS_IGNORED_DIRS))
    raise ValueError(f"unknown profile {profile!r}")


def is_ignored_dir_name(name: str, profile: str = "scan") -> bool:
    """:func:`in_ignored_dir` for one segment, where directories are listed."""
    if profile == "scan":
        return name.lower() in SCAN_IGNORED_DIRS
    if profile == "security":
        return name in SCAN_IGNORED_DIRS or name.startswith(".")
    if profile == "docs":
        return name in DOCS_IGNORED_DIRS
    raise ValueError(f"unknown profile {profile!r}")


def is_ignored_file_name(name: str) -> bool:
    """:func:`is_ignored_file` for a file's name."""
    name = name.lower()
    dot = name.rfind(".")
    return name.endswith((".min.js", ".min.css")) or (0 < dot < len(name) - 1 and name[dot:] in IGNORED_EXTENSIONS)


def is_ignored_file(path: Column) -> Column:
    name = F.lower(base_name(path))
    return name.endswith(".min.js") | name.endswith(".min.css") | suffix(path).isin(*IGNORED_EXTENSIONS)


def ancestors(path: Column) -> Column:
    """Every ancestor directory of a path, outermost first (empty for a file at the root)."""
    parts = F.split(path, "/")
    return F.when(
        F.size(parts) > 1,
        F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/")),
    ).otherwise(F.array().cast("array<string>"))


def collection_key(url: Column) -> Column:
    """Storage key of a repository URL: ``repo_`` and 24 hex digits of its normalised SHA-256."""
    from corpusloom.functions.text import strip

    clean = F.rtrim(F.lower(strip(url)), F.lit("/"))
    return F.concat(F.lit("repo_"), F.left(F.sha2(F.encode(clean, "UTF-8"), 256), F.lit(24)))


# What owners, names and hosts may look like.
OWNER_PATTERN = r"^[a-zA-Z0-9](?:[a-zA-Z0-9]|-(?=[a-zA-Z0-9])){0,38}$"
NAME_PATTERN = r"^[a-zA-Z0-9_.-]{1,100}$"
DEFAULT_HOSTS = ("github.com", "www.github.com")


def validate_url(url: Column, hosts: tuple[str, ...] = DEFAULT_HOSTS) -> Column:
    """Struct ``(valid, reason, owner, name, canonical, clone_url)``; ``reason`` names the first rule that failed."""
    from corpusloom.functions.text import strip

    clean = strip(url)
    scheme = F.lower(F.regexp_extract(clean, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    authority = F.regexp_extract(clean, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    userinfo = F.regexp_extract(authority, r"^(.*)@", 1)
    host_port = F.regexp_replace(authority, r"^.*@", "")
    port = F.regexp_extract(host_port, r":(\d+)$", 1)
    host = F.lower(F.regexp_replace(host_port, r":\d*$", ""))
    path = F.regexp_extract(clean, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    owner = F.try_element_at(parts, F.lit(1))
    name = F.regexp_replace(F.try_element_at(parts, F.lit(2)), r"\.git$", "")
    reason = (
        F.when(url.isNull() | (url == ""), F.lit("empty"))
        .when(scheme != "https", F.lit("scheme"))
        .when(F.regexp_replace(userinfo, ":", "") != "", F.lit("credentials"))
        .when((port != "") & (port.try_cast("int") != 443) & (port.try_cast("int") != 0), F.lit("port"))
        .when(~host.isin(*hosts), F.lit("host"))
        .when(F.size(parts) != 2, F.lit("path"))
        .when(~owner.rlike(OWNER_PATTERN), F.lit("owner"))
        .when(~name.rlike(NAME_PATTERN) | name.isin(".", ".."), F.lit("name"))
    )
    ok = reason.isNull()
    canonical = F.concat(F.lit(f"https://{hosts[0]}/"), owner, F.lit("/"), name)
    return F.struct(
        ok.alias("valid"),
        reason.alias("reason"),
        F.when(ok, owner).alias("owner"),
        F.when(ok, name).alias("name"),
        F.when(ok, canonical).alias("canonical"),
        F.when(ok, F.concat(canonical, F.lit(".git"))).alias("clone_url"),
    )


def visibility(name: Column) -> Column:
    return (
        F.when(name.startswith("__") & ~name.endswith("__"), F.lit("private"))
        .when(name.startswith("_"), F.lit("protected"))
        .otherwise(F.lit("public"))
    )


def is_public_function(name: Column) -> Column:
    return ~name.startswith("_") | (name.startswith("__") & name.endswith("__"))


def is_public_class(name: Column) -> Column:
    return ~name.startswith("_")


def is_application_path(path: Column) -> Column:
    """False where the path carries a marker of library or runtime code."""
    lowered = F.replace(F.lower(path), F.lit("\\"), F.lit("/"))
    vendor = F.lit(False)
    for marker in VENDOR_MARKERS:
        vendor = vendor | lowered.contains(marker)
    return F.when(F.coalesce(path, F.lit("")) == "", F.lit(True)).otherwise(~vendor)


def clean_path(path: Column) -> Column:
    """Blanks and quotes stripped, backslashes turned; null where a ``..`` segment tries to leave the repository."""
    from corpusloom.functions.text import strip

    cleaned = F.replace(F.btrim(strip(path), F.lit("'\"")), F.lit("\\"), F.lit("/"))
    escapes = F.array_contains(F.split(cleaned, "/"), "..")
    return F.when(~escapes & (cleaned != ""), cleaned)


def path_suffixes(path: Column) -> Column:
    """Every trailing sub-path, longest first, of a cleaned path."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", ".", ".."))
    return F.when(
        F.size(parts) > 0,
        F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/")),
    ).otherwise(F.array().cast("array<string>"))


# Top folders that start the repository-relative part of a reported path.
COVERAGE_ROOTS = ("app", "src", "backend", "tests", "lib")


def coverage_path(path: Column, root: str | None = None) -> Column:
    """Repository-relative form of a path in a coverage report."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    parts = F.split(p, "/")
    first = F.try_element_at(
        F.filter(F.transform(parts, lambda s, i: F.when(s.isin(*COVERAGE_ROOTS), i + 1)), lambda i: i.isNotNull()),
        F.lit(1),
    )
    column = F.when(p.startswith("/workspace/"), F.regexp_replace(p, "^/workspace/", "")).when(
        p.startswith("workspace/"), F.regexp_replace(p, "^workspace/", "")
    )
    if root:
        column = column.when(p.startswith(root), F.ltrim(F.substr(p, F.lit(len(root) + 1)), F.lit("/")))
    return column.when(
        first.isNotNull(), F.array_join(F.slice(parts, first, F.size(parts)), "/")
    ).otherwise(F.ltrim(p, F.lit("/")))
