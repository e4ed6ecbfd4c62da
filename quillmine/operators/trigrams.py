"""Look-ups by parts of names and of lines over lists of trigrams.

The posting rows (gram, key) say which file, or name, has which three lowered
characters of a line in a row. A text of three characters and more, and most regular
expressions, can only be where all their trigrams are; who has as many of them as
there are is a candidate, and only candidates are searched. Rows of a common gram are
as many as files that have it, spread over all buckets by the file's path; a search
counts them where they are. What has no trigram of its own is searched by a scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grep import GrepOptions, grep

#: Letters of ASCII that others fold to when case is ignored.
_FOLDED = frozenset("ks")
#: Trigrams of a pattern that are looked up at most; more of them only thin out what a
#: search then verifies anyway.
LOOKED_UP = 16


def grams_of(text: Column) -> Column:
    """The distinct trigrams of a text's lines, lowered; linear in the text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(?=([^\n]{3}))"), F.lit(1)))


def gram_rows(texts: DataFrame, key: str = "path", text: str = "content", *more: str) -> DataFrame:
    """gram, key and more columns: a row for each distinct trigram of each text; nothing
    is shuffled."""
    return texts.select(F.explode(grams_of(F.col(text).cast("string"))).alias("gram"), key, *more)


def required_texts(pattern: str) -> list[str]:
    """Literal texts that every match holds, as far as a look at the top level shows:
    groups, classes and whatever may be absent hold none, and alternatives none at all."""
    out, run, i = [], "", 0

    def close() -> None:
        nonlocal run
        if run:
            out.append(run)
        run = ""

    while i < len(pattern):
        c, literal = pattern[i], None
        if c == "|":
            return []
        if c == "\\":
            if pattern[i + 1 : i + 2] == "Q":  # quoted up to \E
                end = pattern.find("\\E", i)
                end = len(pattern) if end < 0 else end
                run += pattern[i + 2 : end]
                i = end + 2
                continue
            literal = pattern[i + 1] if i + 1 < len(pattern) and not pattern[i + 1].isalnum() else None
            i += 2
            if literal is None:
                if pattern[i - 1 : i] in ("x", "p", "P") and pattern[i : i + 1] == "{":
                    i = pattern.find("}", i) + 1 or len(pattern)
                elif pattern[i - 1 : i] in ("p", "P"):
                    i += 1
                elif pattern[i - 1 : i] == "x":
                    i += 2
                elif pattern[i - 1 : i].isdigit():
                    while pattern[i : i + 1].isdigit():
                        i += 1
        elif c in "[(":
            if pattern[i : i + 2] == "(?" and pattern[i + 2 : i + 3] not in (":", "P", "<"):
                return []  # flags change what comes after
            i = _behind(pattern, i)
        elif c in ".^$":
            i += 1
        elif c in "*+?{":  # of nothing: not for us to read
            return []
        else:
            literal, i = c, i + 1
        times = pattern[i : i + 1]
        if times in ("*", "?", "{", "+") and times:
            if literal is not None and times == "+":
                run += literal
            close()
            i = pattern.find("}", i) + 1 or len(pattern) if times == "{" else i + 1
            if pattern[i : i + 1] in ("?", "+") and pattern[i : i + 1]:
                i += 1
        elif literal is None:
            close()
        else:
            run += literal
    close()
    return out


def _behind(pattern: str, i: int) -> int:
    """The place after a group or class; the end, if it does not close."""
    depth, in_class = 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 2
            continue
        if in_class:
            if c == "[" and pattern[i + 1 : i + 2] == ":":
                i = pattern.find(":]", i) + 1 or len(pattern)
            elif c == "]":
                in_class = False
        elif c == "[":
            in_class = True
            i += 1 if pattern[i + 1 : i + 2] == "^" else 0
            i += 1 if pattern[i + 1 : i + 2] == "]" else 0
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        i += 1
        if not in_class and depth <= 0:
            return i
    return len(pattern)


def required_grams(o: GrepOptions) -> list[str]:
    """Trigrams that every file with a match has; none where that is not known."""
    if o.invert:
        return []
    grams: dict[str, None] = {}
    for text in [o.pattern] if o.literal else required_texts(o.pattern):
        for line in text.split("\n"):
            for i in range(len(line) - 2):
                gram = line[i : i + 3]
                # lowering keeps other characters apart or not as it likes
                if gram.isascii() and not (o.ignore_case and not _FOLDED.isdisjoint(gram.lower())):
                    grams.setdefault(gram.lower())
    return list(grams)


def candidates(rows: DataFrame, grams: list[str], key: str = "path") -> DataFrame:
    """key: who has all the trigrams."""
    some = grams[:: max(1, len(grams) // LOOKED_UP)][:LOOKED_UP]
    held = rows.where(F.col("gram").isin(some)).groupBy(key).agg(F.count_distinct("gram").alias("n"))
    return held.where(F.col("n") == len(some)).select(key)


def indexed_grep(files: DataFrame, rows: DataFrame, o: GrepOptions) -> DataFrame:
    """grep() over the files that can have a match; rows: gram_rows() of the files."""
    grams = required_grams(o)
    return grep(files.join(candidates(rows, grams), "path", "left_semi") if grams else files, o)


def indexed_names(symbols: DataFrame, rows: DataFrame, text: str) -> DataFrame:
    """Symbols whose name holds a text, in any case; rows: gram_rows() of the names."""
    hit = F.contains(F.lower("name"), F.lit(text.lower()))
    grams = required_grams(GrepOptions(text, literal=True)) if text.isascii() else []
    return (symbols.join(candidates(rows, grams, "name"), "name", "left_semi") if grams else symbols).where(hit)

