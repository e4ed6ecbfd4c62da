"""References and calls, as joins on tokens instead of scans per symbol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from .lines import bound, explode_lines, prefix_sums
from .sweep import enclosing

TOKEN = r"[A-Za-z0-9_$]+"
#: Words before a name that declare it, so that no call is meant.
DECLARING = ("func", "def", "function", "fn", "class", "new", "struct", "interface", "type")
#: Words that stand before a parenthesis without being called.
NOT_CALLED = ("if", "for", "while", "switch", "return", "catch", "func", "function", "def", "match", "select", "case", "elif", "print")


def token_occurrences(files: DataFrame) -> DataFrame:
    """path, line, col, token, call of every identifier-like token; a boundary-checked
    occurrence of a name is exactly such a token. call: a parenthesis comes next."""
    lines = explode_lines(files.select("path", "content"))
    found, between = F.regexp_extract_all("line", F.lit(TOKEN), F.lit(0)), F.split("line", TOKEN, -1)

    def placed(held: Column) -> Column:
        """Each token between what stands before it and what after."""
        t, b = held["found"], held["between"]
        before, after = F.slice(b, 1, F.size(t)), F.slice(b, 2, F.size(t))
        at = prefix_sums(F.zip_with(t, before, lambda x, y: (F.octet_length(x) + F.octet_length(y)).cast("long")))
        col = F.zip_with(at, before, lambda n, y: (n + F.octet_length(y) + 1).cast("int"))
        return F.arrays_zip(col.alias("col"), t.alias("token"), F.transform(after, lambda x: x.rlike(r"^\s*\(")).alias("call"))

    at = bound(F.struct(found.alias("found"), between.alias("between")), placed)
    return lines.select("path", "line_no", F.explode(at).alias("t")).select("path", F.col("line_no").alias("line"), "t.col", "t.token", "t.call")


def token_counts(files: DataFrame) -> DataFrame:
    """token, n, files: how often each token stands in files(path, content), and in how
    many of them. Places are not asked for, so lines are not either. Where each path is
    one row, all is summed up by token before anything is shuffled: a row puts out its
    tokens and, behind them, each of them once. Else a file's rows meet first."""
    found = F.regexp_extract_all("content", F.lit(TOKEN), F.lit(0))
    if files.groupBy("path").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").isEmpty():
        held = files.select(found.alias("ts")).select(F.size("ts").alias("size"), F.posexplode(F.concat("ts", F.array_distinct("ts"))).alias("pos", "token"))
        return held.groupBy("token").agg(F.count_if(F.col("pos") < F.col("size")).alias("n"), F.count_if(F.col("pos") >= F.col("size")).alias("files"))
    by_file = files.select("path", F.explode(found).alias("token")).groupBy("token", "path").agg(F.count(F.lit(1)).alias("n"))
    return by_file.groupBy("token").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("files"))


def code_lines(files: DataFrame) -> DataFrame:
    """file_path, line, context: the lines that hold a token, without the space around."""
    lines = explode_lines(files.select("path", "content")).where(F.col("line").rlike(TOKEN))
    return lines.select(F.col("path").alias("file_path"), F.col("line_no").alias("line"), F.trim("line").alias("context"))


#: Symbols of one name that meet some of its places at once, such blocks for each part of the places, and tasks at most.
BLOCK, PART, TASKS = 1000, 8, 4000


def by_name(places: DataFrame, named: DataFrame, key: str, block: int | None = BLOCK) -> DataFrame:
    """The inner join of places and named on a name. Spark takes frames that are made of
    small tables for small, so the join is never a broadcast. A name with more rows of
    named than a block is dealt out: each of its blocks meets each part of its places
    apart from the others, in so many tasks as the rows that come out ask for, where Spark
    would go by the bytes that come in. As each symbol is a place too, its places are taken
    to be as many at least. The names that are broadcast for that are less than rows by
    block. named is read twice. None: no name has several rows."""
    if block is None:
        return places.join(named.hint("merge"), key)
    counts = named.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > block)
    many = [(r[key], -(-r["rows"] // block), -(-r["rows"] // (PART * block))) for r in counts.collect()]
    if not many:
        return places.join(named.hint("merge"), key)
    spark = places.sparkSession
    dealt = F.broadcast(spark.createDataFrame(many, f"{key} string, blocks int, parts int"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(TASKS, sum(blocks * parts for _, blocks, parts in many) // 2))

    def numbered(rows: DataFrame, own: str, name: str, other: str, each: str) -> DataFrame:
        """rows with the number of their own block or part, once for each number of the others."""
        at = F.coalesce(F.pmod(F.xxhash64(*rows.columns), F.col(own)).cast("int"), F.lit(0)).alias(name)
        all_of = F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1)).alias(each)
        return rows.join(dealt, key, "left").select(*rows.columns, at, all_of).repartition(tasks, key, "block", "part")

    left, right = numbered(places, "parts", "part", "blocks", "block"), numbered(named, "blocks", "block", "parts", "part")
    return left.join(right.hint("merge"), [key, "block", "part"]).drop("block", "part")


def resolved(symbols: DataFrame, tokens: DataFrame, same_file_only: bool = False, block: int | None = BLOCK) -> DataFrame:
    """symbol_id, name, file_path, line, col, kind, and the context if the tokens have one:
    an equi-join of tokens and symbol names. A definition's own name is a definition; a
    name before a parenthesis is a call; all else is a reference."""
    s = symbols.select(F.col("id").alias("symbol_id"), F.col("name").alias("token"), F.col("file_path").alias("own_path"), F.col("start_line").alias("own_line"))
    met = tokens.join(s.withColumn("path", F.col("own_path")).hint("merge"), ["token", "path"]) if same_file_only else by_name(tokens, s, "token", block)
    own = (F.col("path") == F.col("own_path")) & (F.col("line") == F.col("own_line"))
    kind = F.when(own, "definition").when(F.col("call"), "call").otherwise("reference")
    return met.select("symbol_id", F.col("token").alias("name"), F.col("path").alias("file_path"), "line", "col", kind.alias("kind"), *(c for c in ("context",) if c in tokens.columns))


def placed(symbols: DataFrame, tokens: DataFrame, lines: DataFrame) -> DataFrame:
    """The tokens that name a symbol, with their lines: each place once, however many
    symbols have the name. A line meets its places last of all tokens."""
    names = symbols.select(F.col("name").alias("token")).distinct()
    at = lines.select(F.col("file_path").alias("path"), "line", "context")
    return tokens.join(names.hint("merge"), "token", "left_semi").join(at.hint("merge"), ["path", "line"])


def references(symbols: DataFrame, files: DataFrame, same_file_only: bool = False, context: bool = True) -> DataFrame:
    """refs: the places where symbols are named, with their lines; without context the
    lines are not read a second time."""
    tokens = token_occurrences(files)
    if not context:
        return resolved(symbols, tokens, same_file_only)
    if same_file_only:  # lines come last: a name of one file has few symbols there
        lines = code_lines(files).hint("merge")
        refs = resolved(symbols, tokens, True).join(lines, ["file_path", "line"])
    else:
        refs = resolved(symbols, placed(symbols, tokens, code_lines(files)))
    return refs.select("symbol_id", "name", "file_path", "line", "col", "kind", "context")


def reference_counts(symbols: DataFrame, files: DataFrame, same_file_only: bool = False) -> DataFrame:
    """symbol_id, file_path, line, n: how often a line names a symbol. Tokens are counted
    before they meet the symbols, so the references are not shuffled."""
    lines = explode_lines(files.select("path", "content"))
    tokens = lines.select("path", F.col("line_no").alias("line"), F.explode(F.regexp_extract_all("line", F.lit(TOKEN), F.lit(0))).alias("token"))
    counted = tokens.groupBy("token", "path", "line").agg(F.count(F.lit(1)).alias("times"))
    s = symbols.groupBy(F.col("id").alias("symbol_id"), F.col("name").alias("token"), F.col("file_path").alias("own_path")).agg(F.count(F.lit(1)).alias("same"))
    if same_file_only:
        met = counted.join(s.withColumnRenamed("own_path", "path").hint("merge"), ["token", "path"])
    else:
        met = by_name(counted, s.drop("own_path"), "token")
    return met.select("symbol_id", F.col("path").alias("file_path"), "line", (F.col("times") * F.col("same")).alias("n"))


def first_named(symbols: DataFrame) -> DataFrame:
    """Of the symbols of a name the one with the smallest id: distinct_places() before any place is met."""
    rest = ("id", "file_path", "start_line")
    return symbols.groupBy("name").agg(F.min_by(F.struct(*rest), "id").alias("one")).select("name", "one.*")


def one_per_line(refs: DataFrame) -> DataFrame:
    """Several references to a symbol on a line collapse into the last."""
    last = F.max_by(F.struct("col", "kind", "context"), "col").alias("last")
    return refs.groupBy("symbol_id", "name", "file_path", "line").agg(last).select("symbol_id", "name", "file_path", "line", "last.col", "last.kind", "last.context")


def distinct_places(refs: DataFrame) -> DataFrame:
    """One reference a place; of several symbols there the one with the smallest id."""
    place = ["file_path", "line", "col"]
    rest = [c for c in refs.columns if c not in place]
    one = refs.groupBy(*place).agg(F.min_by(F.struct(*rest), "symbol_id").alias("one"))
    return one.select(*place, "one.*").select(refs.columns)


def valid_references(refs: DataFrame, default_path: str | None = None) -> DataFrame:
    """References with an id, a line and a column; missing paths and kinds get a default."""
    fine = (F.coalesce(F.col("symbol_id"), F.lit("")) != "") & (F.col("line") >= 1) & (F.col("col") >= 0)
    return refs.where(fine).withColumns(
        {"file_path": F.coalesce(F.nullif("file_path", F.lit("")), F.lit(default_path)), "kind": F.coalesce(F.nullif("kind", F.lit("")), F.lit("reference"))}
    )


def calls(files: DataFrame) -> DataFrame:
    """path, line, callee: names before a parenthesis that no declaring word precedes."""
    lines = explode_lines(files.select("path", "content"))
    pattern = rf"(?:\b({'|'.join(DECLARING)})\s+)?\b([A-Za-z_]\w*)\s*\("
    at = lines.select("path", F.col("line_no").alias("line"), F.arrays_zip(F.regexp_extract_all("line", F.lit(pattern), F.lit(1)).alias("word"), F.regexp_extract_all("line", F.lit(pattern), F.lit(2)).alias("callee")).alias("c"))
    at = at.withColumn("c", F.explode("c"))
    return at.where((F.col("c.word") == "") & ~F.col("c.callee").isin(*NOT_CALLED)).select("path", "line", F.col("c.callee").alias("callee"))


def calls_within(callables: DataFrame, files: DataFrame) -> DataFrame:
    """path, line, callee, src_id: each call and the innermost of the callables around it."""
    spans = callables.select(F.col("file_path").alias("file"), F.col("start_line").alias("start"), F.col("end_line").alias("end"), "id")
    found = calls(files).distinct().select(F.col("path").alias("file"), F.col("line").alias("start"), F.col("line").alias("end"), F.struct("line", "callee").alias("key"))
    inside = enclosing(spans, found, same=True).where("around is not null")
    return inside.select(F.col("file").alias("path"), "key.line", "key.callee", F.col("around").alias("src_id"))


def call_edges(symbols: DataFrame, files: DataFrame, kinds: tuple[str, ...] = ("function", "method")) -> DataFrame:
    """edges(src_id, dst_id, relation, file_path, line): caller and callee of each
    call; the caller is the innermost function around the line."""
    callables = symbols.where(F.col("kind").isin(*kinds))
    targets = callables.select(F.col("id").alias("dst_id"), F.col("name").alias("callee"))
    edges = by_name(calls_within(callables, files), targets, "callee")
    return edges.select("src_id", "dst_id", F.lit("calls").alias("relation"), F.col("path").alias("file_path"), "line")


def call_pairs(symbols: DataFrame, files: DataFrame, kinds: tuple[str, ...] = ("function", "method")) -> DataFrame:
    """caller, callee: the names of call_edges(), each pair once. A callee's name is looked
    up, so its definitions are not multiplied by its calls."""
    callables = symbols.where(F.col("kind").isin(*kinds))
    inside = calls_within(callables, files).select("src_id", "callee").distinct()
    known = inside.join(callables.select(F.col("name").alias("callee")).distinct().hint("merge"), "callee", "left_semi")
    return known.join(callables.select(F.col("id").alias("src_id"), F.col("name").alias("caller")).hint("merge"), "src_id").select("caller", "callee").distinct()


def call_graph(symbols: DataFrame, refs: DataFrame, name: str) -> DataFrame:
    """The definitions of a function and the places that call it: one hop."""
    wanted = symbols.where((F.lower("name") == name.lower()) & F.col("kind").isin("function", "method"))
    defined = wanted.select(F.col("id").alias("symbol_id"), "file_path", F.col("start_line").alias("line"), F.lit("definition").alias("role"))
    refs = refs.where((F.lower("name") == name.lower()) & (F.col("kind") == "call"))
    called = refs.join(wanted.select(F.col("id").alias("symbol_id")).hint("merge"), "symbol_id", "left_semi").select("symbol_id", "file_path", "line", F.lit("call").alias("role"))
    return defined.unionByName(called).dropDuplicates(["file_path", "line", "role"])


#: Edges that a task holds, and hops after which what was found is cut off from how it was found.
EDGES, HOPS = 200_000, 16


def reachable(edges: DataFrame, start: DataFrame, max_hops: int | None = None, safety: int = 10_000) -> DataFrame:
    """id, hops: everything the ids of start(id) reach over edges(src_id, dst_id),
    or what they reach in max_hops where the caller asks for so many. Breadth first:
    only ids that are new go on, so cycles end and no path is walked twice. Paths
    of over `safety` hops are an error, as the result would not be whole. The edges are
    dealt out by src_id and sorted once: a hop that finds little shuffles that, not the edges."""
    links = cut(edges.select("src_id", "dst_id").distinct())
    tasks = max(2, -(-links.count() // EDGES))  # Spark would deal out a single part anew at each hop
    links = links.repartition(tasks, "src_id").sortWithinPartitions("src_id").persist()
    front = start.select("id").distinct().withColumn("hops", F.lit(0))
    found, hop = front, 0
    try:
        while max_hops is None or hop < max_hops:
            hop += 1
            step = front.join(links.hint("merge"), F.col("id") == F.col("src_id")).select(F.col("dst_id").alias("id")).distinct()
            front = cut(step.join(found.select("id").hint("merge"), "id", "left_anti").withColumn("hops", F.lit(hop)))
            if front.isEmpty():
                break
            if hop > safety:
                raise RuntimeError(f"more than {safety} hops")
            found = found.unionByName(front)
            found = found if hop % HOPS else cut(found)
        return cut(found)
    finally:
        links.unpersist()
