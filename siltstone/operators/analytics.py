"""Code health, summaries and comprehension over symbols and calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions.text import base_name, decorator_names, dir_name
from siltstone.operators.graph import CALLABLES
from siltstone.operators.search import top_per

# Thresholds of the reports.
TOP_N = 10
DUPLICATE_SPAN = 4
HOMONYMS = 3
SHORT_NAME = 3
GOD_METHODS, GOD_LOC, LARGE_METHODS, UTILITY_METHODS, LONG_LOC = 15, 300, 12, 5, 60
ENTRY_FILES = ("main.py", "__main__.py", "app.py", "index.ts", "index.js", "main.go", "main.rs")
SINGLETON_METHODS = ("get_instance", "getinstance", "instance", "shared")
INTERFACE_LIKE = r"\b(Protocol|ABC|ABCMeta|Interface)\b"
DEAD_SHOWN = 50
INERT_DECORATORS = ("staticmethod", "classmethod")
# Class name ending, pattern, confidence, what one of its methods must start with.
PATTERNS = (
    ("(Repository|Repo|Store|Dao)$", "Repository", 0.6, "(?i)^(find|get|list|all|load|fetch|query|save|insert|create|update|upsert|delete|remove|exists|count|by_)"),
    ("Factory$", "Factory", 0.6, "(?i)^(create|make|build|new|from_|of|produce)"),
    ("Builder$", "Builder", 0.6, "(?i)^(build|with_|set_|add|append)"),
    ("Strategy$", "Strategy", 0.55, None),
    ("Adapter$", "Adapter", 0.55, None),
    ("(Observer|Listener)$", "Observer", 0.5, None),
    ("(Facade)$", "Facade", 0.5, None),
    ("(Service)$", "Service", 0.5, None),
)


def loc() -> Column:
    return F.col("end_line") - F.col("start_line") + 1


def is_callable() -> Column:
    return F.col("type").isin(*CALLABLES)


def duplicate_groups(symbols: DataFrame, by: list[str], top: int = TOP_N) -> DataFrame:
    """Callables of at least five lines with equal code, per group the count and
    the sorted distinct names and paths; the largest groups first, `top` of each
    value of `by` (of all if empty)."""
    some = symbols.where(is_callable() & (F.col("end_line") - F.col("start_line") >= DUPLICATE_SPAN) & F.col("hash").isNotNull())
    order = [F.desc("copies"), F.col("hash")]
    g = some.groupBy(*by, "hash").agg(F.count("*").alias("copies")).where("copies > 1")
    g = top_per(g, by, order, top) if by else g.orderBy(*order).limit(top)
    named = some.select(*by, "hash", "name", "path").distinct().join(g, [*by, "hash"])
    return named.groupBy(*by, "hash").agg(
        F.max("copies").alias("copies"), F.array_sort(F.collect_set("name")).alias("names"), F.array_sort(F.collect_set("path")).alias("paths"))


def dead_code(symbols: DataFrame, callers: DataFrame, identifiers: DataFrame) -> DataFrame:
    """Callables nobody calls: no callers, no entry or implicit name, no
    decorator that implies an outside call, and a name that occurs no more
    often than it is defined. `identifiers`: repository_id, name, occurrences."""
    defined = symbols.groupBy("repository_id", "name").agg(F.count("*").alias("defined"))
    live = F.exists(F.coalesce(decorator_names(F.col("decorators")), F.array().cast("array<string>")), lambda d: ~d.isin(*INERT_DECORATORS))
    name = F.col("name")
    special = name.isin("main", "constructor") | F.startswith(name, F.lit("test")) | (F.startswith(name, F.lit("__")) & F.endswith(name, F.lit("__")))
    return (
        symbols.where(is_callable() & ~special & ~live).join(callers.where("callers = 0"), "id", "left_semi")
        .join(defined, ["repository_id", "name"]).join(identifiers, ["repository_id", "name"], "left")
        .where(F.coalesce("occurrences", F.lit(0)) <= F.col("defined"))
        .select("repository_id", "id", "name", "path", "start_line")
    )


def shared_utilities(symbols: DataFrame, callers: DataFrame, top: int = TOP_N) -> DataFrame:
    """Per repository the most called names: at least two callers, three
    letters, and at most three symbols of the name."""
    c = symbols.where(is_callable()).join(callers, "id").where((F.col("callers") > 1) & (F.length("name") >= SHORT_NAME))
    few = symbols.groupBy("repository_id", "name").agg(F.count("*").alias("homonyms")).where(F.col("homonyms") <= HOMONYMS)
    named = c.groupBy("repository_id", "name").agg(F.max("callers").alias("callers")).join(few, ["repository_id", "name"], "left_semi")
    return top_per(named, ["repository_id"], [F.desc("callers"), F.col("name")], top)


def class_methods(symbols: DataFrame) -> DataFrame:
    """Classes, structs and interfaces with the number of their methods and, for
    each pattern that asks for one, whether a method's name fits it. Only counts
    and flags are aggregated, so a class of any size stays one small row."""
    asks = [(what, method) for _, what, _, method in PATTERNS if method]
    m = symbols.where("type = 'method' and parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(
        F.count("*").alias("methods"), F.bool_or(F.lower("name").isin(*SINGLETON_METHODS)).alias("singleton"), *[F.bool_or(F.rlike("name", F.lit(method))).alias(f"fits_{what}") for what, method in asks]
    )
    return symbols.where(F.col("type").isin("class", "struct", "interface")).join(m, "id", "left").select(
        "id", "repository_id", "name", "path", "start_line", "signature", loc().alias("loc"), F.coalesce("methods", F.lit(0)).alias("methods"),
        F.coalesce("singleton", F.lit(False)).alias("singleton"),
        *[F.coalesce(f"fits_{what}", F.lit(False)).alias(f"fits_{what}") for what, _ in asks],
    )


def design_pattern(name: Column) -> tuple[Column, Column]:
    """(label, confidence) of the first rule that a row of `class_methods`
    meets, else nulls."""
    label = conf = None
    for ending, what, sure, method in PATTERNS:
        test = F.rlike(name, F.lit(ending))
        if method:
            test = test & F.col(f"fits_{what}")
        label = F.when(test, what) if label is None else label.when(test, what)
        conf = F.when(test, sure) if conf is None else conf.when(test, sure)
    return label, conf


def size_smells(classes: DataFrame, god_methods: int = GOD_METHODS, god_loc: int = GOD_LOC, large_methods: int = LARGE_METHODS) -> DataFrame:
    """Adds ``god`` and ``large`` to rows of `class_methods`; a class that is an
    interface by its signature is not large."""
    god = (F.col("methods") >= god_methods) | (F.col("loc") >= god_loc)
    like = F.rlike(F.coalesce("signature", F.lit("")), F.lit(INTERFACE_LIKE))
    return classes.withColumn("god", god).withColumn("large", ~god & (F.col("methods") >= large_methods) & ~like)


def utility_classes(classes: DataFrame, least: int = UTILITY_METHODS) -> DataFrame:
    """Rows of `class_methods` that are named as utilities and have many methods."""
    return classes.where(F.rlike("name", F.lit("(Utils?|Helpers?|Common|Misc)$")) & (F.col("methods") >= least))


def entry_names(symbols: DataFrame, pattern: str = "^main$") -> DataFrame:
    """Callables whose name is that of an entry point."""
    return symbols.where(is_callable() & F.rlike("name", F.lit(pattern)))


def findings(symbols: DataFrame, duplicates: DataFrame, dead: DataFrame, cycles: DataFrame, hot: DataFrame) -> DataFrame:
    """Union of the findings: repository_id, category, title, target, confidence.
    `cycles` has an array of paths, `hot` the shared names."""
    classes = size_smells(class_methods(symbols))
    label, sure = design_pattern(F.col("name"))
    row = lambda df, category, title, target, confidence: df.select(
        "repository_id", F.lit(category).alias("category"), title.alias("title"), target.alias("target"), confidence.alias("confidence")
    )
    place = F.concat("path", F.lit(":"), F.col("start_line").cast("string"), F.lit(" "), "name")
    shown = top_per(dead.withColumn("place", place), ["repository_id"], [F.col("place"), F.col("id")], DEAD_SHOWN)
    parts = [
        row(duplicates, "duplicate_logic", F.lit("Duplicate implementation"), F.array_join(F.slice("paths", 1, 3), ", "), F.lit(0.85)),
        row(shown, "dead_code", F.lit("Dead-code candidate"), F.col("place"), F.lit(0.5)),
        row(cycles, "circular_dependency", F.lit("Circular dependency"), F.get("cycle", F.lit(0)), F.lit(0.9)),
        row(hot, "hotspot", F.lit("Shared utility (hotspot)"), F.col("name"), F.lit(0.7)),
        row(classes.withColumn("label", label).withColumn("sure", sure).where("label is not null"), "design_pattern",
            F.concat("label", F.lit(" pattern: "), "name"), F.col("name"), F.col("sure")),
        row(classes.where("singleton"), "design_pattern", F.concat(F.lit("Singleton pattern: "), "name"), F.col("name"), F.lit(0.6)),
        row(classes.where("god"), "god_object", F.concat(F.lit("God object: "), "name"), F.col("name"), F.lit(0.7)),
        row(classes.where("large"), "large_class", F.concat(F.lit("Large class: "), "name"), F.col("name"), F.lit(0.55)),
        row(utility_classes(classes), "utility_abuse", F.concat(F.lit("Utility class abuse: "), "name"), F.col("name"), F.lit(0.5)),
        row(symbols.where(is_callable() & (loc() >= LONG_LOC)), "long_function", F.lit("Long function"), F.col("name"), F.lit(0.55)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def enrichment_findings(symbols: DataFrame, enriched: DataFrame, least: int = 2) -> DataFrame:
    """Findings from model enrichment (symbol_id, business_domain array,
    architecture_layer): domains of at least `least` symbols and every layer,
    `Unknown` and empty ones left out; columns as in `findings`."""
    e = enriched.join(symbols.select(F.col("id").alias("symbol_id"), "repository_id"), "symbol_id")
    domain = e.select("repository_id", F.explode("business_domain").alias("target")).where("target <> 'Unknown'")
    domain = domain.groupBy("repository_id", "target").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    layer = e.where("architecture_layer not in ('', 'Unknown')").groupBy("repository_id", F.col("architecture_layer").alias("target")).agg(F.count("*").alias("n"))
    shape = lambda df, category, lead: df.select(
        "repository_id", F.lit(category).alias("category"), F.concat(F.lit(lead), "target").alias("title"), "target", F.lit(0.6).alias("confidence"))
    return shape(domain, "business_domain", "Domain: ").unionByName(shape(layer, "architecture_layer", "Layer: "))


def file_layers(symbols: DataFrame, enriched: DataFrame) -> DataFrame:
    """``repository_id, path, role``: the commonest known layer of a file's
    symbols (the first by name on ties), else the name of its directory."""
    e = enriched.where("architecture_layer not in ('', 'Unknown')").select(F.col("symbol_id").alias("id"), F.col("architecture_layer").alias("layer"))
    n = symbols.join(e, "id").groupBy("repository_id", "path", "layer").agg(F.count("*").alias("n"))
    best = n.groupBy("repository_id", "path").agg(F.min(F.struct((-F.col("n")).alias("k"), "layer")).alias("x")).select("repository_id", "path", "x.layer")
    files = symbols.select("repository_id", "path").distinct()
    return files.join(best, ["repository_id", "path"], "left").select(
        "repository_id", "path", F.coalesce("layer", base_name(dir_name(F.col("path"), "root"))).alias("role"))


def report(files: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """`files` (one row per repository) with the number of rows of each part."""
    out = files
    for name, df in parts.items():
        out = out.join(df.groupBy("repository_id").agg(F.count("*").alias(name)), "repository_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def findings_diff(now: DataFrame, before: DataFrame, key: list[str]) -> DataFrame:
    """Findings by key that are new or resolved between two snapshots."""
    a, b = now.select(*key).distinct(), before.select(*key).distinct()
    return a.join(b, key, "left_anti").withColumn("change", F.lit("new")).unionByName(
        b.join(a, key, "left_anti").withColumn("change", F.lit("resolved"))
    )


def histogram(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Per group "n value, n value ...", most frequent first, then by value."""
    n = df.groupBy(*by, value).agg(F.count("*").alias("n"))
    return n.groupBy(*by).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), F.col(value).alias("v"), F.col("n")))),
                                 lambda x: F.concat_ws(" ", x["n"].cast("string"), x["v"])), ", ").alias(name)
    )


def module_summary(symbols: DataFrame) -> DataFrame:
    """Per file: number of symbols, kinds and the first six names."""
    by = ["repository_id", "path"]
    return symbols.groupBy(*by).agg(
        F.count("*").alias("n_symbols"), F.slice(F.array_sort(F.collect_set("name")), 1, 6).alias("key_names")
    ).join(histogram(symbols, by, "type", "kinds"), by)


def hierarchical_rollup(symbols: DataFrame) -> DataFrame:
    """Symbols, files and lines by repository, package and module: one row for
    each level (package and module null above it)."""
    s = symbols.select("repository_id", dir_name(F.col("path")).alias("package"), F.col("path").alias("module"), loc().alias("loc"))
    return s.rollup("repository_id", "package", "module").agg(
        F.count("*").alias("n_symbols"), F.countDistinct("module").alias("n_modules"), F.sum("loc").alias("loc"), F.grouping_id().alias("level")
    ).where("repository_id is not null")


def collaborators(calls: DataFrame, symbols: DataFrame, most: int = 8) -> DataFrame:
    """Per file the other files of the repository it calls or is called by, the
    first eight. Files meet at names, at distinct (file, name) pairs; a name
    that more than `HOMONYMS` symbols share links no files."""
    where = symbols.select("repository_id", F.col("id").alias("caller"), "path")
    few = symbols.groupBy("repository_id", "name").agg(F.count("*").alias("n")).where(F.col("n") <= HOMONYMS).drop("n")
    uses = calls.join(where, ["repository_id", "caller"]).select("repository_id", "path", F.col("callee_name").alias("name")).distinct()
    defs = symbols.join(few, ["repository_id", "name"], "left_semi").select("repository_id", F.col("path").alias("other"), "name").distinct()
    pair = uses.join(defs, ["repository_id", "name"]).where("path <> other").select("repository_id", "path", "other").distinct()
    both = pair.unionByName(pair.select("repository_id", F.col("other").alias("path"), F.col("path").alias("other"))).distinct()
    first = top_per(both, ["repository_id", "path"], [F.col("other")], most)
    return first.groupBy("repository_id", "path").agg(F.array_sort(F.collect_list("other")).alias("collaborators"))


def file_understanding(symbols: DataFrame) -> DataFrame:
    """Per file: role (its directory), public top-level names, the first twelve
    top-level units by line, and a fingerprint of the code hashes in any order."""
    by = ["repository_id", "path"]
    top = F.col("parent_id").isNull() & F.col("type").isin("function", "class", "struct", "interface", "trait", "enum")
    unit = F.struct("start_line", "id", F.concat_ws(" ", "type", "name").alias("unit"))
    return symbols.groupBy(*by).agg(
        F.transform(F.slice(F.array_sort(F.collect_list(F.when(top, unit))), 1, 12), lambda x: x["unit"]).alias("units"),
        F.array_sort(F.collect_set(F.when(top & (F.col("visibility") == "public"), F.col("name")))).alias("key_exports"),
        F.md5(F.array_join(F.array_sort(F.collect_list("hash")), ",")).alias("fingerprint"),
        F.count("*").alias("n_symbols"),
    ).withColumn("role", base_name(dir_name(F.col("path"), "root")))


def entry_points(symbols: DataFrame, most: int = 12) -> DataFrame:
    """Per repository: functions named main and files with an entry name."""
    main = symbols.where(is_callable() & (F.col("name") == "main")).select(
        "repository_id", F.concat(F.col("path"), F.lit(":"), F.col("start_line").cast("string"), F.lit(" main")).alias("entry")
    )
    named = symbols.where(base_name(F.col("path")).isin(*ENTRY_FILES)).select("repository_id", F.col("path").alias("entry"))
    return top_per(main.unionByName(named).distinct(), ["repository_id"], [F.col("entry")], most)


def context_budget(df: DataFrame, by: list[str], order: list, text: str, budget: int) -> DataFrame:
    """The longest prefix of each group's rows whose texts stay in the budget."""
    run = F.sum(F.length(text)).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn("used", run).where(F.col("used") <= budget)
