"""Reports: compositions of operators, each for a whole set of roots, files or changes at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import names, paths, scores
from ..operators import aggregates as A
from ..operators import maintenance as M
from ..operators import relations as R
from ..operators import traverse as T
from ..operators.lineage import cut
from ..schema import CALLABLE_KINDS, DECLARATIVE_LANGUAGES, NO_CALLS_BY_NAME, Graph


def name_evidence(graph: Graph, roots: DataFrame, sources: DataFrame) -> DataFrame:
    """(root, named_tests): how many test files of ``sources`` (file_path, content) name a root (id, root), NAMED_TESTS at most.

    A name says nothing of one definition among several; only roots whose name has a single one are looked for.
    """
    of = roots.join(graph.nodes.select("id", "project_id", "symbol"), "id").join(A.definition_counts(graph).where("definitions = 1"), ["project_id", "symbol"], "left_semi").select("root", "symbol")
    found = tests_by_name(sources, of.select("symbol").distinct(), NAMED_TESTS).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    return of.join(found, "symbol").groupBy("root").agg(F.max("n").alias("named_tests"))


#: Fixed value: test files by name of one symbol.
NAMED_TESTS = 50


def impact(graph: Graph, roots: DataFrame, max_depth: int = 3, sources: DataFrame | None = None) -> DataFrame:
    """One row per root: what a change of it may break, by distance and confidence, the tests among it, and the packages of
    its direct callers.

    A root without tests in its radius is untested. With ``sources`` (file_path, content), test files that name such a root are counted in
    ``named_tests``, and it is untested only without them too.
    """
    radius = T.blast_radius(graph, roots, max_depth).join(graph.nodes.select("id", "kind", "file_path"), "id")
    sums = radius.groupBy("root").agg(
        F.count(F.lit(1)).alias("affected"),
        F.sum((F.col("depth") == 1).cast("long")).alias("direct"),
        F.sum((F.col("depth") > 1).cast("long")).alias("indirect"),
        F.sum(F.col("confirmed").cast("long")).alias("confirmed"),
        F.sum((F.col("kind") == "test").cast("long")).alias("tests"),
        F.countDistinct(F.when((F.col("depth") == 1) & (F.col("file_path") != ""), paths.folder(F.col("file_path")))).alias("packages"),
    )
    out = roots.select("root").distinct().join(sums, "root", "left").fillna(0)
    if sources is None:
        return out.withColumn("untested", F.col("tests") == 0)
    out = cut(out)
    bare = roots.join(out.where("tests = 0").select("root"), "root", "left_semi")
    named = out.join(name_evidence(graph, bare, sources), "root", "left").fillna(0, ["named_tests"])
    return named.withColumn("untested", (F.col("tests") == 0) & (F.col("named_tests") == 0))


def ambiguity(graph: Graph, roots: DataFrame) -> DataFrame:
    """(root, definitions): how many definitions share a root's name."""
    return roots.join(graph.nodes.select("id", "project_id", "symbol"), "id").join(A.definition_counts(graph), ["project_id", "symbol"], "left").groupBy("root").agg(F.max("definitions").alias("definitions"))


def subjects(graph: Graph, roots: DataFrame) -> DataFrame:
    """(root, unresolved, is_test): whether a definition of the root has no call graph (neither exact calls of its file nor calls by
    name of its language), and whether all of its definitions are tests or stand in test files."""
    coverage = graph.nodes.limit(0) if graph.coverage is None else graph.coverage
    covered = coverage.select("project_id", "file_path").distinct().withColumn("covered", F.lit(True))
    of = roots.select("root", "id").join(graph.nodes.select("id", "project_id", "file_path", "kind", "language"), "id").join(covered, ["project_id", "file_path"], "left")
    unresolved = F.col("covered").isNull() & F.col("language").isin(*NO_CALLS_BY_NAME)
    return of.groupBy("root").agg(F.bool_or(unresolved).alias("unresolved"), F.bool_and(paths.is_test_node(F.col("kind"), F.col("file_path"))).alias("is_test"))


def risk_factors() -> dict[str, Column]:
    """Severity of each factor of a row of :func:`risk`. Where there is no call graph, callers and tests are unknown, not absent."""
    s = scores.SEVERITY
    known = lambda severity: F.when(F.col("unresolved"), 0.0).otherwise(severity)
    return {
        "untested": known(F.when(F.col("untested"), s["untested"]).otherwise(0.0)),
        "fan_in": known(F.when(F.col("direct") >= 10, s["fan_in_10"]).when(F.col("direct") >= 5, s["fan_in_5"]).otherwise(0.0)),
        "packages": known(F.when(F.col("packages") >= 3, s["packages_3"]).otherwise(0.0)),
        "ambiguous": F.when(F.col("definitions") > 1, s["ambiguous"]).otherwise(0.0),
        "unresolved": F.when(F.col("unresolved"), s["unresolved"]).otherwise(0.0),
    }


def risk(graph: Graph, roots: DataFrame, max_depth: int = 3, sources: DataFrame | None = None) -> DataFrame:
    """Impact with a score: the probabilistic OR of its factors, and a level, which is unknown without a call graph."""
    of = impact(graph, roots, max_depth, sources).join(ambiguity(graph, roots), "root", "left").join(subjects(graph, roots), "root", "left").fillna(False, ["unresolved", "is_test"])
    score = scores.round_half_up(scores.any_of(list(risk_factors().values())), 3)
    return of.withColumn("score", score).withColumn("level", F.when(F.col("unresolved"), "unknown").otherwise(scores.risk_level(F.col("score"))))


def call_graph_label(graph: Graph, nodes: DataFrame) -> DataFrame:
    """(id, call_graph) of callables: resolved if their file is covered, else unresolved or name by language; declarative languages have none."""
    covered = graph.coverage.select("project_id", "file_path").distinct().withColumn("covered", F.lit(True))
    label = F.when(F.col("language").isin(*DECLARATIVE_LANGUAGES), "none").when(F.col("covered"), "resolved").when(F.col("language").isin(*NO_CALLS_BY_NAME), "unresolved").otherwise("name")
    return nodes.where(F.col("kind").isin(*CALLABLE_KINDS)).join(covered, ["project_id", "file_path"], "left").select("id", label.alias("call_graph"))


def review(graph: Graph, hunks: DataFrame, max_depth: int = 3, busy: int = 8, sources: DataFrame | None = None) -> DataFrame:
    """One row per changed symbol with its risk, and whether many callers hang on it; with ``sources`` tests by name count too.

    All changed symbols are roots of one walk, not of a walk each.
    """
    changed = cut(R.changed_symbols(graph, hunks).select("id", F.col("id").alias("root")))
    return risk(graph, changed, max_depth, sources).withColumn("busy", F.col("direct") >= busy)


def review_summary(reviewed: DataFrame) -> DataFrame:
    """The whole change: worst severity per factor, then the OR of those, and a verdict on how its symbols are tested.

    Tests are no subjects of that verdict; a symbol without tests and without a call graph is unknown, not uncovered.
    """
    tested = F.col("tests") + (F.col("named_tests") if "named_tests" in reviewed.columns else F.lit(0)) > 0
    subject = ~F.col("is_test")
    row = reviewed.agg(
        F.count(F.lit(1)).alias("symbols"),
        *(F.max(c).alias(k) for k, c in risk_factors().items()),
        F.sum((subject & tested).cast("long")).alias("covered"),
        F.sum((subject & ~tested & ~F.col("unresolved")).cast("long")).alias("uncovered"),
        F.sum((subject & ~tested & F.col("unresolved")).cast("long")).alias("unknown"),
    ).fillna(0)
    score = scores.round_half_up(scores.any_of([F.col(c) for c in risk_factors()]), 3)
    none = (F.col("covered") == 0) & (F.col("uncovered") == 0)
    verdict = F.when(none, "unknown").when(F.col("covered") == 0, "uncovered").when((F.col("uncovered") == 0) & (F.col("unknown") == 0), "covered").otherwise("partial")
    level = F.when(F.col("unresolved") > 0, "unknown").otherwise(scores.risk_level(F.col("score")))
    return row.withColumn("score", score).withColumn("level", level).withColumn("coverage", verdict)


#: Order of levels; unknown never trips a gate.
LEVELS = {"low": 1, "medium": 2, "high": 3}


def gate(summary: DataFrame, max_level: str = "medium", require_coverage: bool = False) -> DataFrame:
    """Whether a change would fail: a level above ``max_level``, or uncovered symbols where coverage is required."""
    level = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv]), F.col("level")), F.lit(0))
    too_risky = level > LEVELS[max_level]
    bare = F.lit(require_coverage) & F.col("coverage").isin("uncovered", "partial") & (F.col("uncovered") > 0)
    return summary.select("level", "coverage", too_risky.alias("fails_level"), bare.alias("fails_coverage"), (too_risky | bare).alias("would_fail"))


def affected_tests(graph: Graph, hunks: DataFrame, max_depth: int = 3) -> DataFrame:
    """(test_file, reason): tests to run for a change: changed themselves, covering a changed symbol, or importing a changed file."""
    files = hunks.select("file_path").distinct()
    own = files.where(paths.is_test_file(F.col("file_path"))).select(F.col("file_path").alias("test_file"), F.lit("changed").alias("reason"))
    changed = cut(R.changed_symbols(graph, hunks).select("id", F.col("id").alias("root")))
    cover = T.blast_radius(graph, changed, max_depth).join(graph.nodes.where("kind = 'test'").select("id", "file_path"), "id").select(F.col("file_path").alias("test_file"), F.lit("covers").alias("reason"))
    imports = T.importing_tests(graph, files, packages=False).select("test_file", F.lit("imports").alias("reason"))
    return own.unionByName(cover).unionByName(imports).distinct()


def related_files(graph: Graph, files: DataFrame) -> DataFrame:
    """(file, related, reason, confidence): files that call into a file (0.9), that it calls (0.7), and tests among its callers (1.0), best per reason."""
    of = graph.nodes.join(files.select("file_path"), "file_path", "left_semi").select("id", F.col("file_path").alias("root"))
    other = F.col("file_path") != F.col("root")
    up = R.callers(graph, of).where(other)
    rows = up.select("root", "file_path", F.lit("caller").alias("reason"), F.lit(0.9).alias("confidence"))
    rows = rows.unionByName(R.callees(graph, of).where(other).select("root", "file_path", F.lit("callee").alias("reason"), F.lit(0.7).alias("confidence")))
    rows = rows.unionByName(up.where(paths.is_test_node(F.col("kind"), F.col("file_path"))).select("root", "file_path", F.lit("test").alias("reason"), F.lit(1.0).alias("confidence")))
    return rows.groupBy(F.col("root").alias("file"), F.col("file_path").alias("related"), "reason").agg(F.max("confidence").alias("confidence"))


def dependency_confidence() -> Column:
    """Ladder of evidence: an exact edge, an unqualified name, a name."""
    return F.when(F.col("provenance") == "precise", "confirmed").when(F.col("weight") >= 1.0, "likely").otherwise("candidate")


def file_dependencies(graph: Graph) -> DataFrame:
    """(target_file, source_file, edge_type): how many edges lead into a file from another, and how sure the best is."""
    rank = F.when(F.col("provenance") == "precise", 3).when(F.col("weight") >= 1.0, 2).otherwise(1)
    grouped = R.inbound_file_dependencies(graph).withColumn("rank", rank).groupBy("target_file", "source_file", "edge_type").agg(F.count(F.lit(1)).alias("n"), F.max("rank").alias("rank"))
    return grouped.select("target_file", "source_file", "edge_type", "n", F.when(F.col("rank") == 3, "confirmed").when(F.col("rank") == 2, "likely").otherwise("candidate").alias("confidence"))


def file_impact(graph: Graph) -> DataFrame:
    """Per file: files that depend on it, and a verdict on deleting it: unsafe on confirmed evidence only, else unknown."""
    deps = file_dependencies(graph).groupBy(F.col("target_file").alias("file_path")).agg(F.countDistinct("source_file").alias("dependents"), F.max((F.col("confidence") == "confirmed").cast("int")).alias("sure"))
    out = graph.nodes.select("file_path").distinct().join(deps, "file_path", "left")
    return out.select("file_path", F.coalesce("dependents", F.lit(0)).alias("dependents"), F.when(F.col("sure") == 1, "unsafe").otherwise("unknown").alias("delete_verdict"))


#: Weights of the reading order, folders of auxiliary programs, files that open a module, scores of entry points.
IMPORTANCE, ENTRYPOINT, PRIMARY_MAIN = 0.6, 0.55, 1.0
AUXILIARY_FOLDERS = ("bench", "benchmarks", "benchmark", "examples", "example", "scripts", "tools", "hack", "testdata")
MODULE_FILES = ("index.ts", "index.tsx", "index.js", "index.jsx", "index.mjs", "__main__.py")
ENTRY_SCORES = {"auxiliary_main": 0.5, "main": 1.0, "wired_handler": 0.9, "module_file": 0.8, "exported_root": 0.65, "exported": 0.35}


def entrypoint_reason() -> Column:
    """Which of ENTRY_SCORES a callable (with in_degree and wired) is, null for none; the first that fits."""
    file, symbol = F.col("file_path"), F.col("symbol")
    parts = F.split(F.lower(paths.folder(file)), "/")
    script = F.lower("language").isin("javascript", "typescript", "tsx", "jsx")
    auxiliary = script | ((paths.folder(file) != "") & (F.split(paths.folder(file), "/")[0] != "cmd") & F.arrays_overlap(parts, F.array(*map(F.lit, AUXILIARY_FOLDERS))))
    is_main = (F.col("kind") == "function") & (symbol == "main")
    base = F.lower(paths.base_name(file))
    command = file.contains("/cmd/") | file.startswith("cmd/") | (base == "main.go")
    owner = F.split("fqn", r"\.")
    hidden = (F.col("kind") == "method") & (F.col("language") == "go") & (F.size(owner) >= 3) & ~names.is_exported(F.try_element_at(owner, F.lit(-2)))
    return (
        F.when(is_main & auxiliary, "auxiliary_main")
        .when(is_main, "main")
        .when((F.col("kind") == "function") & command & F.col("wired"), "wired_handler")
        .when(base.isin(*MODULE_FILES), "module_file")
        .when(command | F.coalesce(hidden, F.lit(False)), None)
        .when(names.is_exported(symbol) & (F.col("in_degree") == 0), "exported_root")
        .when(names.is_exported(symbol), "exported")
    )


def read_order(graph: Graph, query: str = "", limit: int = 20) -> DataFrame:
    """Callables to read first: effective in-degree over the largest, and how much of an entry point they are; tests are left out.

    Ranks follow score, effective and raw in-degree, then durable keys.
    """
    ranked = A.ranked_hotspots(graph).select("id", "in_degree", "effective")
    most = ranked.agg(F.max("effective")).scalar()
    source = graph.nodes.where(~paths.is_test_node(F.col("kind"), F.col("file_path"))).select(F.col("id").alias("source_id"))
    wired = graph.edges.where("edge_type = 'references'").join(source, "source_id", "left_semi").select(F.col("target_id").alias("id")).distinct().withColumn("referenced", F.lit(True))
    callables = graph.nodes.where(F.col("kind").isin("function", "method") & ~paths.is_test_node(F.col("kind"), F.col("file_path")))
    if wanted := query.strip().lower():
        callables = callables.where(F.lower("symbol").contains(wanted) | F.lower("fqn").contains(wanted) | F.lower("file_path").contains(wanted))
    rows = callables.join(ranked, "id", "left").join(wired, "id", "left").join(A.definition_counts(graph), ["project_id", "symbol"], "left")
    rows = rows.fillna(0, ["in_degree"]).fillna(0.0, ["effective"])
    rows = rows.withColumn("wired", F.coalesce("referenced", F.lit(False)) & (F.coalesce("definitions", F.lit(0)) <= 1) & (F.col("in_degree") == 0))
    rows = rows.withColumn("reason", entrypoint_reason())
    table = F.create_map(*[F.lit(x) for kv in ENTRY_SCORES.items() for x in kv])
    entry = F.coalesce(F.try_element_at(table, F.col("reason")), F.lit(0.0))
    importance = F.coalesce(F.col("effective") / F.nullif(most, F.lit(0.0)), F.lit(0.0))
    lead = F.when(F.col("reason") == "main", PRIMARY_MAIN).otherwise(0.0)
    rows = rows.withColumn("score", scores.round_half_up(IMPORTANCE * importance + ENTRYPOINT * entry + lead, 3)).where("score > 0")
    order = [F.desc("score"), F.desc("effective"), F.desc("in_degree"), "file_path", "start_line", "fqn", "kind", "symbol", "id"]
    return rows.orderBy(*order).limit(limit).select("id", "symbol", "file_path", "score", "in_degree", "effective", "reason")


def staleness(before: DataFrame, after: DataFrame) -> DataFrame:
    """How many files changed, are new and are deleted."""
    count = lambda c: F.coalesce(F.sum((F.col("change") == c).cast("long")), F.lit(0)).alias(c)
    return M.file_delta(before, after).agg(count("changed"), count("new"), count("deleted"))


def dangling_annotations(graph: Graph) -> DataFrame:
    """Notes on nodes whose target no node answers to."""
    known = graph.nodes.select("project_id", F.explode(F.array("fqn", "symbol")).alias("target")).distinct()
    return graph.annotations.where("kind = 'node'").join(known, ["project_id", "target"], "left_anti")


def inconsistencies(graph: Graph) -> DataFrame:
    """(class, n): dangling notes, calls by name in covered files, coverage of files without nodes."""
    counts = [("dangling_annotation", dangling_annotations(graph)), ("name_calls_on_covered_file", R.name_calls_on_covered_files(graph)), ("coverage_without_nodes", R.coverage_without_nodes(graph))]
    out = None
    for name, df in counts:
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("class"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def architecture(graph: Graph) -> DataFrame:
    """Per subsystem: its rollup and its most called node."""
    hub = A.ranked_hotspots(graph).withColumn("subsystem", paths.subsystem(F.col("file_path")))
    first = hub.withColumn("rn", F.row_number().over(W.partitionBy("subsystem").orderBy(*A.rank_order()))).where("rn = 1").select("subsystem", F.col("symbol").alias("hub"))
    return A.subsystem_rollup(graph).join(first, "subsystem", "left")


def context(graph: Graph, roots: DataFrame, cap: int = 25) -> DataFrame:
    """(root, relation, position, total, id): callers, callees and hierarchy of each root, each list cut at ``cap`` beside its true total."""
    parts = [R.callers(graph, roots).select("root", F.lit("caller").alias("relation"), "id", "in_degree"), R.callees(graph, roots).select("root", F.lit("callee").alias("relation"), "id", "in_degree"), R.hierarchy(graph, roots).select("root", F.col("direction").alias("relation"), "id", F.lit(0).cast("long").alias("in_degree")).distinct()]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).join(graph.nodes.select("id", "file_path", "start_line"), "id")
    group = W.partitionBy("root", "relation")
    ranked = rows.withColumn("total", F.count(F.lit(1)).over(group)).withColumn("position", F.row_number().over(group.orderBy(F.desc("in_degree"), "file_path", "start_line", "id")))
    return ranked.where(F.col("position") <= cap).select("root", "relation", "position", "total", "id")


def within_budget(rows: DataFrame, group: str, order: list, text: str, budget: int) -> DataFrame:
    """The longest prefix of each group whose texts stay within a token budget."""
    used = F.sum(scores.tokens(F.coalesce(F.col(text), F.lit("")))).over(W.partitionBy(group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("tokens_used", used).where(F.col("tokens_used") <= budget)


def fit_budget(rows: DataFrame, group: str, key: str, position: str, size: str, plan: list[tuple[str, int]], budget: int) -> DataFrame:
    """``rows`` of lists (``key``) of each ``group`` that stay within ``budget`` tokens, four bytes (``size``) to one.

    ``plan`` names lists, the least important first, each with how many entries stay at least: the first list is cut from its end
    down to that, then the next one, until all fits, and no entry goes that need not. Lists that the plan does not name are never cut.
    An entry goes if what is left before it goes, in that order, is still too much.
    """
    order = F.lit(None).cast("int")
    floor = F.lit(0)
    for k, (name, least) in enumerate(plan):
        order, floor = F.when(F.col(key) == name, k).otherwise(order), F.when(F.col(key) == name, least).otherwise(floor)
    ranked = rows.withColumn("__rank", F.row_number().over(W.partitionBy(group, key).orderBy(position))).withColumn("__step", F.when(F.col("__rank") > floor, order))
    own = W.partitionBy(group)
    going = own.orderBy(F.col("__step").asc_nulls_last(), F.desc("__rank"), key)
    gone_before = F.coalesce(F.sum(size).over(going.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    left = F.ceil((F.sum(size).over(own) - gone_before) / scores.BYTES_PER_TOKEN)
    return ranked.withColumn("__left", left).where(F.col("__step").isNull() | (F.col("__left") <= budget)).drop("__rank", "__step", "__left")


def budget_summary(rows: DataFrame, kept: DataFrame, group: str, key: str, size: str) -> DataFrame:
    """(group, key, total, kept, dropped, tokens): what became of each list; tokens are those of all the group's kept rows."""
    total = rows.groupBy(group, key).agg(F.count(F.lit(1)).alias("total"))
    stay = kept.groupBy(group, key).agg(F.count(F.lit(1)).alias("kept"))
    used = kept.groupBy(group).agg(F.ceil(F.sum(size) / scores.BYTES_PER_TOKEN).alias("tokens"))
    out = total.join(stay, [group, key], "left").join(used, group, "left").fillna(0, ["kept", "tokens"])
    return out.select(group, key, "total", "kept", (F.col("total") - F.col("kept")).alias("dropped"), "tokens")


def confirmed_impact(graph: Graph, roots: DataFrame, max_depth: int = 3) -> DataFrame:
    """One row per root with only confirmed nodes of its radius, and how many distinct candidates (by full name, file and line) were
    left out. ``untested`` still says whether any test was found before."""
    radius = T.blast_radius(graph, roots, max_depth).join(graph.nodes.select("id", "kind", "fqn", "file_path", "start_line"), "id")
    sure = F.col("confirmed")
    sums = radius.groupBy("root").agg(
        F.sum(sure.cast("long")).alias("affected"),
        F.sum((sure & (F.col("depth") == 1)).cast("long")).alias("direct"),
        F.sum((sure & (F.col("kind") == "test")).cast("long")).alias("tests"),
        F.sum((F.col("kind") == "test").cast("long")).alias("any_tests"),
        F.countDistinct(F.when(~sure, F.struct("fqn", "file_path", "start_line"))).alias("filtered"),
    )
    out = roots.select("root").distinct().join(sums, "root", "left").fillna(0)
    return out.select("root", "affected", "direct", "tests", "filtered", (F.col("any_tests") == 0).alias("untested"))


def tests_by_name(sources: DataFrame, symbols: DataFrame, limit: int = 50) -> DataFrame:
    """(symbol, test_file, total): test files of ``sources`` (file_path, content) in which the bare name of a symbol (symbol) stands
    as a word, the first ``limit`` by path with their true number. Evidence by name alone, for what no call graph sees.

    Words of test files meet the names in one equi-join, however many symbols are asked for.
    """
    bare = symbols.select("symbol", names.bare(F.col("symbol")).alias("word")).where("word <> ''").distinct()
    words = F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"[A-Za-z0-9_]+"), 0))).alias("word")
    found = sources.where(paths.is_test_file(F.col("file_path"))).select("file_path", words).join(bare, "word").select("symbol", F.col("file_path").alias("test_file")).distinct()
    rank = F.row_number().over(W.partitionBy("symbol").orderBy("test_file"))
    ranked = found.withColumn("rn", rank).withColumn("total", F.count(F.lit(1)).over(W.partitionBy("symbol")))
    return ranked.where(F.col("rn") <= limit).drop("rn")


def file_context(graph: Graph, files: DataFrame) -> DataFrame:
    """One row per file (file_path): how many symbols it defines and tests, who depends on it, the verdict on deleting it, the weakest
    call graph of its callables, and the related files with the best of their reasons."""
    wanted = files.select("file_path").distinct()
    own = graph.nodes.where("kind <> 'file'").join(wanted, "file_path", "left_semi")
    outline = own.groupBy("file_path").agg(F.count(F.lit(1)).alias("symbols"), F.sum((F.col("kind") == "test").cast("long")).alias("tests"))
    labels = call_graph_label(graph, own).join(own.select("id", "file_path"), "id").select("file_path", "call_graph")
    related = related_files(graph, wanted).groupBy(F.col("file").alias("file_path"), "related").agg(F.max("confidence").alias("c")).groupBy("file_path").agg(F.count(F.lit(1)).alias("related"), F.max("c").alias("best_related"))
    out = wanted.join(outline, "file_path", "left").join(file_impact(graph), "file_path", "left").join(A.weakest_call_graph(labels, "file_path"), "file_path", "left").join(related, "file_path", "left")
    return out.fillna(0, ["symbols", "tests", "dependents", "related"]).fillna("none", ["call_graph"])
