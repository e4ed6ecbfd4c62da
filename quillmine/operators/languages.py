"""Languages of files: by extension, name, MIME type and first line."""

from __future__ import annotations

import mimetypes
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dialect import glob_pattern
from .filters import basename, extension, is_binary, is_hidden


@dataclass(frozen=True)
class Language:
    name: str
    extensions: tuple[str, ...] = ()
    patterns: tuple[str, ...] = ()
    mime_types: tuple[str, ...] = ()
    shebangs: tuple[str, ...] = ()


#: Extensions; file names; MIME types; interpreters of each language.
LANGUAGES = (
    Language("Go", (".go", ".mod", ".sum"), ("go.mod", "go.sum", "go.work", "go.work.sum"), ("text/x-go",), ("go run",)),
    Language("JavaScript", (".js", ".mjs", ".jsx", ".es6", ".es"), (".eslintrc.js", ".babelrc.js"), ("application/javascript", "text/javascript"), ("node", "nodejs")),
    Language("TypeScript", (".ts", ".tsx", ".d.ts"), ("tsconfig.json", ".tslintrc"), ("application/typescript",)),
    Language("Python", (".py", ".pyw", ".pyi", ".pyx", ".pyd"), ("Pipfile", "pyproject.toml", "setup.py", "requirements.txt"), ("text/x-python", "application/x-python"), ("python", "python2", "python3")),
    Language("Java", (".java", ".class", ".jar", ".gradle"), ("build.gradle", "pom.xml", "gradle.properties"), ("text/x-java-source",)),
    Language("C", (".c", ".h"), (), ("text/x-c", "text/x-csrc")),
    Language("C++", (".cpp", ".cxx", ".cc", ".c++", ".hpp", ".hxx", ".hh", ".h++"), (), ("text/x-c++", "text/x-c++src")),
    Language("Rust", (".rs", ".rlib"), ("Cargo.toml", "Cargo.lock"), ("text/rust",)),
    Language("C#", (".cs", ".csx", ".csproj", ".sln"), (), ("text/x-csharp",)),
    Language("Ruby", (".rb", ".rbw", ".rake", ".gemspec"), ("Rakefile", "Gemfile", "Gemfile.lock"), ("text/x-ruby",), ("ruby",)),
    Language("PHP", (".php", ".php3", ".php4", ".php5", ".phtml"), (), ("text/x-php", "application/x-php"), ("php",)),
    Language("Shell", (".sh", ".bash", ".zsh", ".fish", ".csh", ".tcsh", ".ksh"), (), ("text/x-shellscript", "application/x-sh"), ("sh", "bash", "zsh", "fish", "csh", "tcsh", "ksh")),
    Language("HTML", (".html", ".htm", ".xhtml"), (), ("text/html", "application/xhtml+xml")),
    Language("CSS", (".css", ".scss", ".sass", ".less"), (), ("text/css",)),
    Language("JSON", (".json", ".jsonc", ".json5"), (".eslintrc", ".babelrc", "tsconfig.json", "package.json"), ("application/json", "text/json")),
    Language("YAML", (".yaml", ".yml"), (".github/workflows/*.yml", ".github/workflows/*.yaml"), ("text/yaml", "application/x-yaml")),
    Language("XML", (".xml", ".xsl", ".xslt", ".xsd"), ("pom.xml", "web.xml"), ("text/xml", "application/xml")),
    Language("Markdown", (".md", ".markdown", ".mdown", ".mkd"), ("README.md", "CHANGELOG.md"), ("text/markdown", "text/x-markdown")),
    Language("SQL", (".sql",), (), ("text/x-sql",)),
    Language("Docker", (".dockerfile",), ("Dockerfile", "Dockerfile.*", ".dockerignore"), ("text/x-dockerfile",)),
    Language("Makefile", (".mk", ".mak"), ("Makefile", "makefile", "GNUmakefile", "*.mk"), ("text/x-makefile",)),
)
#: How sure each way of detection is.
CONFIDENCE = {"extension": 0.8, "pattern": 0.7, "mime": 0.6, "shebang": 0.9}
#: Names that an index gives files by extension.
INDEX_NAMES = {
    ".go": "Go", ".py": "Python", ".js": "JavaScript", ".ts": "TypeScript", ".java": "Java", ".cpp": "C++", ".cc": "C++", ".cxx": "C++", ".c": "C",
    ".h": "C/C++ Header", ".hpp": "C/C++ Header", ".rs": "Rust", ".rb": "Ruby", ".php": "PHP", ".cs": "C#",
}
#: Languages whose symbols are extracted, by extension.
PARSER_NAMES = {".go": "go", ".py": "python", ".pyi": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".ts": "typescript", ".tsx": "typescript", ".rs": "rust"}


@dataclass
class FileTypes:
    """A set of languages that can be added to, and what to include by them."""

    languages: list[Language] = field(default_factory=lambda: list(LANGUAGES))

    def add(self, language: Language) -> None:
        self.languages.append(language)

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(x.name, list(x.extensions), list(x.patterns), list(x.mime_types), list(x.shebangs)) for x in self.languages]
        return spark.createDataFrame(rows, "name string, extensions array<string>, patterns array<string>, mime_types array<string>, shebangs array<string>")

    def _by(self, pairs: list[tuple[Column, str]], how: str) -> Column:
        """The first language whose condition holds."""
        none = F.lit(None).cast("struct<language:string,confidence:double,how:string>")
        return reduce(lambda rest, p: F.when(p[0], F.struct(F.lit(p[1]).alias("language"), F.lit(CONFIDENCE[how]).alias("confidence"), F.lit(how).alias("how"))).otherwise(rest), reversed(pairs), none)

    def detect(self, path: Column, first_line: Column | None = None) -> Column:
        """struct<language, confidence, how>: by extension, else file name, else
        MIME type, else interpreter; null if nothing tells."""
        name, ext = basename(path), F.lower(extension(path))
        by_ext = {}
        for x in self.languages:
            for e in x.extensions:
                by_ext.setdefault(e, x.name)
        grouped: dict[str, list[str]] = {}
        for e, n in by_ext.items():
            grouped.setdefault(n, []).append(e)
        ways = [self._by([(ext.isin(es), n) for n, es in grouped.items()], "extension")]
        patterns = [(p, x.name) for x in self.languages for p in x.patterns]
        ways.append(self._by([((path if "/" in p else name).rlike(glob_pattern(p).replace("^", "(?:^|/)", 1) if "/" in p else glob_pattern(p)), n) for p, n in patterns], "pattern"))
        mimes = {m: x.name for x in reversed(self.languages) for m in x.mime_types}
        known = {e: mimes[m] for e, m in sorted(mimetypes.types_map.items()) if m in mimes}
        ways.append(self._by([(ext == e, n) for e, n in known.items()], "mime"))
        if first_line is not None:
            program = F.regexp_extract(first_line, r"^#!\s*(\S+)(?:\s+(\S+))?", 1)
            second = F.regexp_extract(first_line, r"^#!\s*(\S+)(?:\s+(\S+))?", 2)
            run = F.when(basename(program) == "env", second).otherwise(basename(program))
            ways.append(self._by([(run == s, x.name) for x in self.languages for s in x.shebangs], "shebang"))
        return F.coalesce(*ways)


def index_language(path: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(v) for kv in INDEX_NAMES.items() for v in kv)), extension(path)), F.lit("Unknown"))


def parser_language(path: Column) -> Column:
    """Null where symbols are not extracted."""
    return F.element_at(F.create_map(*(F.lit(v) for kv in PARSER_NAMES.items() for v in kv)), F.lower(extension(path)))


def include_files(files: DataFrame, types: FileTypes, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), first_line: str | None = None) -> DataFrame:
    """Files by detected language; with an include list unknown ones go."""
    found = types.detect(F.col("path"), F.col(first_line) if first_line else None)["language"]
    keep = F.lit(True)
    if include:
        keep &= F.coalesce(found.isin(*include), F.lit(False))
    if exclude:
        keep &= ~F.coalesce(found.isin(*exclude), F.lit(False))
    return files.where(keep)


@dataclass(frozen=True)
class FileFilter:
    """What a walk takes: languages, extensions, sizes, hidden and binary files."""

    languages: tuple[str, ...] = ()
    not_languages: tuple[str, ...] = ()
    extensions: tuple[str, ...] = ()
    not_extensions: tuple[str, ...] = ()
    min_bytes: int = 0
    max_bytes: int | None = None
    hidden: bool = False
    binary: bool = False
    types: FileTypes = field(default_factory=FileTypes)

    def apply(self, files: DataFrame) -> DataFrame:
        """Of files(path, content) those that fit in all respects."""
        size, ext = F.octet_length("content"), F.lower(extension(F.col("path")))
        keep = size >= self.min_bytes
        if self.max_bytes is not None:
            keep &= size <= self.max_bytes
        if self.extensions:
            keep &= ext.isin(*self.extensions)
        if self.not_extensions:
            keep &= ~ext.isin(*self.not_extensions)
        if not self.hidden:
            keep &= ~is_hidden(F.col("path"))
        if not self.binary:
            keep &= ~is_binary(F.col("content"), "nul")
        return include_files(files.where(keep), self.types, self.languages, self.not_languages)


#: Filters by name.
FILTERS = {
    "all": FileFilter(hidden=True, binary=True),
    "code": FileFilter(languages=("Go", "JavaScript", "TypeScript", "Python", "Java", "C", "C++", "Rust", "C#", "Ruby", "PHP", "Shell"), max_bytes=10 << 20),
    "web": FileFilter(languages=("HTML", "CSS", "JavaScript", "TypeScript")),
    "text": FileFilter(languages=("Markdown", "JSON", "YAML", "XML")),
}
