"""Ignore rules: patterns to rows, last match wins.

Rules become regular expressions over whole relative paths, with the directory
semantics written into the expression, so a path meets a rule in one ``rlike``:
a rule hits what it names and everything below it; rules with a slash inside
hold from the rule file's directory on, others at any depth; rules that end in
a slash name directories only.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dialect import quote

#: The names of rule files, in rising order of precedence.
RULE_FILES = (".gitignore", ".ignore", ".rgignore")
#: Rules commonly wanted for a kind of project.
PRESETS = {
    "go": (
        "*.exe", "*.exe~", "*.dll", "*.so", "*.dylib", "*.test", "*.out", "coverage.*", "*.coverprofile", "profile.cov", "vendor/", "go.work", "go.work.sum",
    ),
    "node": (
        "node_modules/", "npm-debug.log*", "yarn-debug.log*", "yarn-error.log*", ".npm", ".eslintcache", ".nyc_output", "coverage/", ".coverage", "*.tgz", "*.tar.gz",
        ".cache/",
    ),
    "python": (
        "__pycache__/", "*.py[cod]", "*$py.class", "*.so", ".Python", "build/", "develop-eggs/", "dist/", "downloads/", "eggs/", ".eggs/", "lib/", "lib64/", "parts/",
        "sdist/", "var/", "wheels/", "pip-wheel-metadata/", "share/python-wheels/", "*.egg-info/", ".installed.cfg", "*.egg", "MANIFEST", ".env", ".venv", "env/",
        "venv/", "ENV/", "env.bak/", "venv.bak/",
    ),
    "java": (
        "*.class", "*.log", "*.ctxt", ".mtj.tmp/", "*.jar", "*.war", "*.nar", "*.ear", "*.zip", "*.tar.gz", "*.rar", "hs_err_pid*", "target/", ".mvn/", "mvnw",
        "mvnw.cmd", ".gradle/", "build/", "gradle-app.setting", "!gradle-wrapper.jar", ".gradletasknamecache",
    ),
    "rust": (
        "target/", "**/*.rs.bk", "*.pdb", "Cargo.lock",
    ),
    "common": (
        ".DS_Store", "Thumbs.db", "*.tmp", "*.temp", "*.log", ".idea/", ".vscode/", "*.swp", "*.swo", "*~", ".env", ".env.local", ".env.*.local",
    ),
}


class RuleError(ValueError):
    """The line holds no rule."""


@dataclass(frozen=True)
class Rule:
    pattern: str
    negate: bool
    dir_only: bool
    anchored: bool
    regex: str
    source: str = ""
    line: int = 0
    base_dir: str = ""


def _component(glob: str) -> str:
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**", i):
            out.append(".*")
            i += 1
        elif c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            inner = glob[i + 1 : end]
            out.append("[" + ("^" + inner[1:] if inner[0] == "!" else inner).replace("\\", "\\\\") + "]")
            i = end
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out.append(quote(glob[i]))
        else:
            out.append(quote(c))
        i += 1
    return "".join(out)


def parse_rule(text: str, source: str = "", line: int = 0, base_dir: str = "") -> Rule:
    if not text.strip() or text.lstrip().startswith("#"):
        raise RuleError(f"no rule in {text!r}")
    body = text.rstrip() if not text.endswith("\\ ") else text
    negate = body.startswith("!")
    body = body[negate:]
    dir_only = body.endswith("/")
    body = body[:-1] if dir_only else body
    anywhere = body.startswith("**/")
    anchored = not anywhere and "/" in body
    body = body[3:] if anywhere else body.removeprefix("/")
    start = "^" if anchored else "^(?:.*/)?"
    if base_dir:
        start = f"^{quote(base_dir.rstrip('/'))}/" + ("" if anchored else "(?:.*/)?")
    # a whole path ends in / here if it is a directory
    regex = f"{start}{_component(body)}{'/' if dir_only else '(?:/|$)'}"
    return Rule(text, negate, dir_only, anchored, regex, source, line, base_dir)


def parse_rules(text: str, source: str = "", base_dir: str = "") -> list[Rule]:
    """The rules of a file; comments and blank lines hold none."""
    out = []
    for n, line in enumerate(text.splitlines(), 1):
        if line.strip() and not line.lstrip().startswith("#"):
            out.append(parse_rule(line, source, n, base_dir))
    return out


def preset(name: str) -> list[Rule]:
    if name not in PRESETS:
        raise KeyError(f"unknown preset {name!r}")
    return [parse_rule(p, f"preset:{name}") for p in PRESETS[name]]


def load_rules(root: str, global_file: str | None = None, parents: bool = True, nested: bool = True, names: tuple[str, ...] = RULE_FILES) -> list[Rule]:
    """Rules that hold below root, weakest first: global, parents from the top
    down, root, nested directories."""
    at = Path(root).resolve()
    out: list[Rule] = []
    places = [Path(global_file)] if global_file else []
    for p in places:
        if p.is_file():
            out += parse_rules(p.read_text(errors="replace"), str(p))
    for folder in [*(reversed(at.parents) if parents else ()), at]:
        for name in names:
            if (f := folder / name).is_file():
                out += parse_rules(f.read_text(errors="replace"), str(f))
    if nested:
        for name in names:
            for f in sorted(at.rglob(name)):
                if f.parent != at and f.is_file():
                    out += parse_rules(f.read_text(errors="replace"), str(f), f.parent.relative_to(at).as_posix())
    return out


def rules_frame(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    rows = [(n, r.source, r.pattern, r.regex, r.negate, r.dir_only, r.anchored, r.base_dir) for n, r in enumerate(rules)]
    return spark.createDataFrame(rows, "ord int, source string, pattern string, regex string, negate boolean, dir_only boolean, anchored boolean, base_dir string")


def rule_stats(rules: DataFrame) -> DataFrame:
    return rules.agg(
        F.count(F.lit(1)).alias("rules"), F.count_if("negate").alias("negated"), F.count_if("dir_only").alias("dir_only"), F.count_if("anchored").alias("anchored"), F.count_distinct("source").alias("sources")
    )


def is_ignored(path: Column, is_dir: Column, rules: list) -> Column:
    """The verdict of the last rule that hits; rules are few, so they become one
    expression that Catalyst evaluates inside the scan, without a join."""
    whole = F.when(is_dir, F.concat(path, F.lit("/"))).otherwise(path)
    out = F.lit(False)
    for r in rules:
        out = F.when(whole.rlike(r.regex), F.lit(not r.negate)).otherwise(out)
    return out


#: Rules up to which they are one expression.
FEW_RULES = 256


def mark_ignored(paths: DataFrame, rules: DataFrame, path: str = "path", is_dir: str | None = None, max_rules: int = 100_000) -> DataFrame:
    """paths with ignored, rules as data: for rule sets that are made by queries. Few
    of them become the expression of is_ignored(); more are broadcast, and meet each
    path once, however often it is there."""
    held = rules.select("ord", "regex", "negate").orderBy("ord").limit(max_rules + 1).collect()  # max_rules bounds them
    if len(held) > max_rules:
        raise ValueError(f"over {max_rules} rules are not for a broadcast")
    flag = F.col(is_dir) if is_dir else F.lit(False)
    if len(held) <= FEW_RULES:
        return paths.withColumn("ignored", is_ignored(F.col(path), flag, held))
    whole = F.when(flag, F.concat(F.col(path), F.lit("/"))).otherwise(F.col(path))
    known = rules.sparkSession.createDataFrame(held, "ord int, regex string, negate boolean")
    hit = paths.select(whole.alias("whole")).distinct().join(F.broadcast(known), F.expr("whole rlike regex"))
    verdict = hit.groupBy("whole").agg(F.max_by(~F.col("negate"), "ord").alias("verdict"))
    found = paths.alias("p").join(verdict.alias("v"), whole == F.col("v.whole"), "left")
    return found.select("p.*", F.coalesce("v.verdict", F.lit(False)).alias("ignored"))


def matches_rule(rule: Rule, path: str, is_dir: bool) -> bool:
    """One path and one rule, on the driver."""
    return re.match(rule.regex, path + "/" * is_dir) is not None
