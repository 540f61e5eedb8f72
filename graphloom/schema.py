"""Tables, enumerated domains and the bundle of DataFrames that operators take."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

# Fixed values.
NODE_KINDS = ("file", "function", "method", "type", "class", "variable", "test", "module", "selector", "table", "view", "query", "key", "section")
EDGE_TYPES = ("calls", "imports", "implements", "extends", "references", "depends_on", "tests", "overrides", "defines", "styles", "reads", "writes", "documents")
NAME, PRECISE = "name", "precise"
CALLABLE_KINDS = ("function", "method", "test")
#: Edges that a change travels backwards along.
IMPACT_TYPES = ("calls", "extends", "implements", "overrides")
DECLARATIVE_LANGUAGES = ("sql", "yaml", "markdown", "html", "css", "scss", "sass", "less")
#: Languages whose calls by name are too few to say that a caller is absent.
NO_CALLS_BY_NAME = ("typescript", "javascript", "python", "vue")
#: Edges a free walk follows unless told otherwise: all but a file's own definitions.
WALK_TYPES = tuple(t for t in EDGE_TYPES if t != "defines")

NODES = "id long, project_id long, file_path string, symbol string, fqn string, kind string, language string, start_line int, end_line int, signature string, docstring string, source_hash string"
EDGES = "source_id long, target_id long, edge_type string, weight double, provenance string"
FILES = "project_id long, file_path string, file_hash string, size_bytes long"
COVERAGE = "project_id long, file_path string, resolver string"
ANNOTATIONS = "id long, project_id long, kind string, target string, source string, external_id string, note string"


@dataclass(frozen=True)
class Graph:
    """One immutable snapshot. Edges form a multigraph; nothing is deduplicated unless an operator says so."""

    nodes: DataFrame
    edges: DataFrame
    files: DataFrame | None = None
    coverage: DataFrame | None = None
    annotations: DataFrame | None = None

    def project(self, project_id: int) -> Graph:
        """The part of one project; edges never cross projects."""
        keep = self.nodes.where(self.nodes.project_id == project_id)
        ids = keep.select("id")
        edges = self.edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
        own = {k: t.where(t.project_id == project_id) for k in ("files", "coverage", "annotations") if (t := getattr(self, k)) is not None}
        return replace(self, nodes=keep, edges=edges.select(*self.edges.columns), **own)
