"""Reports that start from a question, a key or a rename, and the annotated tree of folders."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import paths
from ..operators import aggregates as A
from ..operators import relations as R
from ..operators import search as S
from ..operators import traverse as T
from ..operators.lineage import cut, release
from ..schema import Graph
from ..ship import ship
from . import reports as P


def annotation_list(graph: Graph) -> DataFrame:
    """All notes, each with whether its target still resolves: a node by full or bare name, a path by both its ends."""
    known = graph.nodes.select("project_id", F.explode(F.array("fqn", "symbol")).alias("end")).where("end is not null").distinct()
    ends = graph.annotations.select("id", "project_id", F.explode(F.when(F.col("kind") == "path", F.split("target", " -> ")).otherwise(F.array("target"))).alias("end"))
    missing = ends.join(known, ["project_id", "end"], "left_anti").select("id").distinct().withColumn("dangling", F.lit(True))
    return graph.annotations.join(missing, "id", "left").withColumn("dangling", F.coalesce("dangling", F.lit(False)))


def folder_role(folder: Column) -> Column:
    """What a folder is for, by its name (fixed values)."""
    last = F.regexp_extract(folder, "([^/]*)$", 1)
    return (
        F.when(folder == "", "root")
        .when(last.isin(*paths.TEST_FOLDERS), "tests")
        .when(last.isin("docs", "doc"), "documentation")
        .when(folder.rlike("^cmd(/|$)"), "entrypoints")
        .when(folder.rlike("^internal(/|$)"), "internal")
        .when(last.isin("web", "ui", "frontend"), "frontend")
        .otherwise("source")
    )


def atlas(graph: Graph, symbols: int = 3) -> DataFrame:
    """Every folder with its role, files, symbols and flows, and the leading symbols below it.

    Leading symbols of files go up to all ancestors and are cut there again, so what a folder gathers is ``symbols`` a file at most.
    """
    lead = A.key_symbols(graph, symbols).select(F.explode(paths.ancestors(F.col("file_path"))).alias("folder"), "symbol", "score", "id")
    ranked = lead.withColumn("rn", F.row_number().over(W.partitionBy("folder").orderBy(F.desc("score"), "symbol", "id"))).where(F.col("rn") <= symbols)
    top = ranked.groupBy("folder").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "symbol"))), lambda x: x["symbol"]), ",").alias("leading"))
    out = A.folder_rollup(graph).join(A.folder_flows(graph), "folder", "left").join(top, "folder", "left")
    return out.fillna(0, ["internal", "outgoing", "incoming"]).withColumn("role", folder_role(F.col("folder")))


def refactor_sites(graph: Graph, roots: DataFrame) -> DataFrame:
    """(root, file_path, reason, sites, confirmed): where a rename must be carried through, by file."""
    use = graph.edges.where(F.col("edge_type").isin("calls", "references", "imports", "extends", "implements", "overrides")).join(roots.select(F.col("id").alias("target_id"), "root"), "target_id")
    own = roots.join(graph.nodes.select("id", "file_path"), "id").select("root", "file_path", F.lit("definition").alias("reason"), F.lit(1).cast("long").alias("sites"), F.lit(True).alias("confirmed"))
    placed = use.join(graph.nodes.select(F.col("id").alias("source_id"), "file_path"), "source_id")
    sites = placed.groupBy("root", "file_path", F.col("edge_type").alias("reason")).agg(F.count(F.lit(1)).alias("sites"), F.bool_and(F.col("provenance") == "precise").alias("confirmed"))
    return own.unionByName(sites)


def key_users(graph: Graph, uses: DataFrame) -> DataFrame:
    """(key, id): the innermost symbol around each use (key, file_path, line) of a configuration key."""
    return R.enclosing(graph, uses).select("key", "id").distinct()


def key_impact(graph: Graph, uses: DataFrame, max_depth: int = 3) -> DataFrame:
    """What the rotation of each key reaches: the symbols that read it, and all that depends on those, at the least distance.

    One walk a key starts from all its users at once; a node is as confirmed as any of its nearest ways.
    """
    users = cut(key_users(graph, uses))
    first = users.select("key", "id", F.lit(0).alias("depth"), F.lit(True).alias("confirmed"))
    reached = T.blast_radius(graph, users.select(F.col("key").alias("root"), "id"), max_depth)
    return first.unionByName(reached.select(F.col("root").alias("key"), "id", "depth", "confirmed"))


def required_keys(graph: Graph, roots: DataFrame, uses: DataFrame, max_depth: int = 3) -> DataFrame:
    """(root, key): keys that something a root calls, or itself, reads."""
    users = key_users(graph, uses).withColumnRenamed("key", "mark")
    return T.reached_marks(graph, roots, users, max_depth).withColumnRenamed("mark", "key")


def explore(graph: Graph, query: str, seeds: int = 5, cap: int = 10) -> DataFrame:
    """(seed, relation, position, total, id): the neighbourhoods of the best hits of a question, code before declarative kinds."""
    hits = S.cascade(graph.nodes, query, 6 * seeds).join(graph.nodes.select("id", "kind"), "id")
    code = F.col("kind").isin("section", "key", "table", "view", "query", "selector").cast("int")
    first = hits.orderBy(code, "position").limit(seeds).select("id", F.col("id").alias("root"))
    return P.context(graph, first, cap).withColumnRenamed("root", "seed")


#: Registrations by pattern (fixed values): kind of feature, framework, expression with the name as group 1.
FEATURES = (
    ("http_route", "express", r"\b(?:app|router)\.(?:get|post|put|patch|delete)\(\s*['\"]([^'\"]+)['\"]"),
    ("http_route", "flask", r"@\w+\.route\(\s*['\"]([^'\"]+)['\"]"),
    ("http_route", "net/http", r"\bHandle(?:Func)?\(\s*\"([^\"]+)\""),
    ("cli_command", "cobra", r"\bUse:\s*\"([\w-]+)"),
    ("cli_command", "click", r"@\w+\.command\(\s*['\"]?([\w-]+)"),
    ("program", "package", r"^func (main)\(\)"),
)


def features(texts: DataFrame) -> DataFrame:
    """(file_path, line, kind, framework, name) of registrations in ``texts`` (file_path, content)."""
    any_rule = "(?m)" + "|".join(f"(?:{rule})" for _, _, rule in FEATURES)
    lines = texts.where(F.col("content").rlike(any_rule)).select("file_path", F.posexplode(F.split("content", "\n")).alias("pos", "text"))
    found = F.array(*(F.struct(F.lit(kind).alias("kind"), F.lit(framework).alias("framework"), F.regexp_extract("text", rule, 1).alias("name")) for kind, framework, rule in FEATURES))
    return lines.select("file_path", (F.col("pos") + 1).alias("line"), F.inline(F.filter(found, lambda x: x["name"] != "")))


def feature_footprints(graph: Graph, found: DataFrame, max_depth: int = 4) -> DataFrame:
    """(kind, name, symbols, files): how much each feature's handler, the symbol around its registration, leads to."""
    handlers = R.enclosing(graph, found).select("kind", "name", "id")
    reach = T.footprint(graph, handlers.select("id", F.col("id").alias("root")).distinct(), max_depth).join(graph.nodes.select("id", "file_path"), "id")
    sums = reach.groupBy("root").agg(F.count(F.lit(1)).alias("symbols"), F.countDistinct("file_path").alias("files"))
    return handlers.withColumnRenamed("id", "root").join(sums, "root").select("kind", "name", "symbols", "files")


#: Rows of call trees that a task hands over at once.
BATCH_ROWS = 10_000
_TREE = "root {id}, path string, depth int, id long, leaf string"


def call_tree(root: int, calls: dict[int, list[int]], max_depth: int, max_nodes: int) -> list[tuple[str, int, int, str | None]]:
    """(path, depth, id, leaf) of one call tree in call order; a path has three digits and a dot for each call.

    A node shows its calls where it first comes in that order above the last depth; later it is a 'repeat', below itself a 'cycle', and with
    calls at the last depth it ends as 'depth'. With more than ``max_nodes`` nodes, the calls of a node all come in before those of
    the first of them, and what does not come in any more cuts its caller as 'max_nodes'.
    """
    shown: dict[int, str] = {}
    leaf: dict[str, str] = {}
    children: dict[str, list[tuple[str, int]]] = {}
    # What is still to be shown, the next one last; a node is left, by its path, once all below it is shown.
    stack: list[tuple[str, int, tuple[int, ...]]] = [("", root, ())]
    while stack:
        at, node, above = stack.pop()
        own = calls.get(node, [])
        if node in above:
            leaf[at] = "cycle"
        elif node in shown:
            leaf[at] = "repeat"
        elif own and len(above) >= max_depth:
            leaf[at] = "depth"
        elif own:
            shown[node] = at
            children[at] = [(f"{at}{k:03}.", c) for k, c in enumerate(own, 1)]
            stack.extend((p, c, (*above, node)) for p, c in reversed(children[at]))
    budget, out, todo = max_nodes - 1, [], [("", root)]
    while todo:
        at, node = todo.pop()
        kept = children.get(at, [])[: max(budget, 0)]
        why = "max_nodes" if len(kept) < len(children.get(at, [])) else leaf.get(at)
        budget -= len(kept)
        out.append((at, at.count("."), node, why))
        todo.extend(reversed(kept))
    here = {at for at, *_ in out}
    # A repeat of what was cut away is a cut itself.
    return [(at, depth, node, "max_nodes" if why == "repeat" and shown[node] not in here else why) for at, depth, node, why in out]


def flow_tree(graph: Graph, roots: DataFrame, max_depth: int = 3, breadth: int = 20, max_nodes: int = 10_000) -> DataFrame:
    """(root, path, depth, id, leaf): the call tree of each root (id, root) as flat rows that sort by ``path``, callees by file, line and id.

    Each node shows its first ``breadth`` callees, so a tree expands ``breadth`` ** (``max_depth`` - 1) nodes at most, each of them once. The calls that a
    tree can show are found level by level for all roots; one task then puts a root's calls, whose number is bounded by that, in order.
    """
    order = graph.nodes.select(F.col("id").alias("target_id"), "file_path", "start_line")
    frontier = cut(roots.select("root", "id").distinct())
    visited, parts = frontier, [frontier.select("root", F.lit(None).cast("long").alias("source_id"), F.col("id").alias("target_id"), F.lit(0).alias("k"))]
    nodes = T.placed(graph)
    for _ in range(max_depth + 1):  # one more, to know whether the last ones have calls
        calls = T.followable_calls(graph, frontier, nodes).join(order, "target_id")
        k = F.row_number().over(W.partitionBy("source_id").orderBy("file_path", "start_line", "target_id"))
        calls = calls.withColumn("k", k).where(F.col("k") <= breadth)
        level = cut(frontier.join(calls, F.col("id") == F.col("source_id")).select("root", "source_id", "target_id", "k"))
        parts.append(level)
        frontier = cut(level.select("root", F.col("target_id").alias("id")).distinct().join(visited, ["root", "id"], "left_anti"))
        visited = visited.unionByName(frontier)
        if frontier.isEmpty():
            break
    release(nodes)
    rows = reduce(DataFrame.unionByName, parts)

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a root come one after another, by k."""
        each = ((root, source, target) for batch in batches for root, source, target in zip(*(batch.column(c).to_pylist() for c in ("root", "source_id", "target_id")), strict=True))
        out: list[tuple] = []
        for root, own in groupby(each, key=itemgetter(0)):
            start, calls = [], {}
            for _, source, target in own:
                if source is None:
                    start.append(target)
                else:
                    calls.setdefault(source, []).append(target)
            out += [(root, *row) for node in sorted(start) for row in call_tree(node, calls, max_depth, max_nodes)]
            if len(out) >= BATCH_ROWS:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    root_type = to_arrow_type(roots.schema["root"].dataType)

    def _batch(found: list[tuple]) -> pa.RecordBatch:
        types = (root_type, pa.string(), pa.int32(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names=["root", "path", "depth", "id", "leaf"])

    kind = roots.schema["root"].dataType.simpleString()
    spark = graph.nodes.sparkSession
    ship(spark)
    # The rows are few bytes and much work, so their number of tasks is set: by size they would be put into one.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    dealt = rows.repartition(tasks, "root").sortWithinPartitions("root", "k")
    return dealt.mapInArrow(trees, _TREE.format(id=kind))


def processes(graph: Graph, entries: DataFrame, max_depth: int = 4, steps: int = 40) -> DataFrame:
    """(root, position, id, depth, path): for each entry point (id, root) the steps of its call tree in call order, each node where it
    comes first; at most ``steps`` nodes of a tree."""
    tree = flow_tree(graph, entries, max_depth, max_nodes=steps).where("leaf is null or leaf <> 'cycle'")
    first = tree.groupBy("root", "id").agg(F.min(F.struct("path", "depth")).alias("f")).select("root", "id", "f.*")
    return first.select("root", F.row_number().over(W.partitionBy("root").orderBy("path")).alias("position"), "id", "depth", "path")


#: Entry points a search builds trees for, and the steps it shows of each.
MOST_CANDIDATES, SHOWN_STEPS = 12, 8


def ranked_processes(graph: Graph, entries: DataFrame, seeds: DataFrame, limit: int = 3, max_depth: int = 4, steps: int = 40) -> DataFrame:
    """(rank, root, matched, position, id, depth, is_seed): the processes of ``entries`` (id, root, place) that hold most ``seeds`` (id, rank), and the way to them.

    Seeds are walked back from along calls and references, as far as a process is deep; of the entry points this reaches the nearest ones,
    then the first ones by place, get a call tree. Those with a seed among their steps are ordered by how many they hold, then by their best seed. Of their
    steps those that lead to a seed are shown in call order; of too many the entry and the seeds stay first.
    """
    near = T.distances(graph, seeds.select("id").distinct(), max_depth, ("calls", "references"))
    few = cut(entries.join(near, "id").orderBy("distance", "place", "root").limit(MOST_CANDIDATES).select("id", "root", "place", "distance"))
    flow = cut(processes(graph, few.select("id", "root"), max_depth, steps))
    best = seeds.groupBy("id").agg(F.min("rank").alias("seed_rank"))
    marked = cut(flow.join(best, "id", "left").withColumn("is_seed", F.col("seed_rank").isNotNull()))
    held = marked.where("is_seed").groupBy("root").agg(F.count(F.lit(1)).alias("matched"), F.min("seed_rank").alias("best"))
    chosen = held.join(few, "root").orderBy(F.desc("matched"), "best", "distance", "place", "root").limit(limit)
    chosen = cut(chosen.select("root", "matched", F.row_number().over(W.orderBy(F.desc("matched"), "best", "distance", "place", "root")).alias("rank")))
    # Paths of a step and all above it: its own without its last calls.
    calls = F.expr("length(path) div 4")
    above = F.transform(F.sequence(F.lit(0), calls), lambda n: F.expr("path").substr(F.lit(1), n * 4))
    on_path = marked.where("is_seed").select("root", F.explode(above).alias("path")).distinct()
    kept = marked.join(on_path, ["root", "path"]).join(chosen, "root")
    first = F.when(F.col("path") == "", 0).when(F.col("is_seed"), 1).otherwise(2)
    shown = kept.withColumn("n", F.row_number().over(W.partitionBy("root").orderBy(first, "path"))).where(F.col("n") <= SHOWN_STEPS)
    position = F.row_number().over(W.partitionBy("root").orderBy("path"))
    return shown.select("rank", "root", "matched", position.alias("position"), "id", "depth", "is_seed")
