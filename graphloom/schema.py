"""Tables of the knowledge graph and the vocabularies of their string columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NODES = "id string, node_type string, title string, file_path string, symbol_hash long, summary string, content_hash string, scope string, created_at long, updated_at long"
EDGES = "source_id string, target_id string, relation_type string, weight double, decay_rate double, created_at long"
TAGS, ALIASES = "node_id string, tag string", "alias string, node_id string"
PENDING = "source_id string, raw_target string, relation_type string, created_at long"
DOCS = "node_id string, title string, content string, tags string"
ANCHORS = "symbol_hash long, crate_name string, module_path string, symbol_name string, file_path string, start_line int, end_line int, doc_comment string"

MAIN = "main"
HUBS = ("readme", "roadmap", "backlog", "changelog")
NODE_TYPES = ("goal", "plan", "adr", "symbol", "concept", "analysis", "reference", "changelog", "edge_case", "alternative")
RELATES, ANCHORED, DOC_LINK, AUTO_FILE, AUTO_TAG = "relates_to", "anchors", "doc_links", "auto_filename", "auto_tag"
AUTO_WEIGHTS = {AUTO_FILE: 0.4, AUTO_TAG: 0.25}
#: Other spellings of node types.
TYPE_ALIASES = {"analyses": "analysis", **dict.fromkeys(("release_notes", "change_log"), "changelog"), **dict.fromkeys(("task", "todo", "tasks", "todos", "roadmap", "backlog", "tasklist", "task_list"), "plan")}
#: Factors of the ranked score, and what is added when context is packed.
TYPE_BOOST = {"symbol": 0.95, "concept": 1.05, "analysis": 1.08, "adr": 1.1, "edge_case": 1.1, "plan": 1.12, "changelog": 1.12, "goal": 1.15}
PACK_BONUS = {"alternative": 1.1, "reference": 1.2, "concept": 1.4, "analysis": 1.65, "edge_case": 1.8, "plan": 1.9, "changelog": 1.95, "goal": 2.0, "adr": 2.5}


def choose(key: Column, values: dict[str, float] | dict[str, str], other: object) -> Column:
    """The value that a small mapping has for a key, else `other`."""
    out = F
    for k, v in values.items():
        out = out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(other)) if values else F.lit(other)


def node_type(name: Column) -> Column:
    """The node type of a name; null for unknown ones, which are never taken for another."""
    return F.when(name.isin(*NODE_TYPES), name).otherwise(choose(name, TYPE_ALIASES, None))


def is_auto(relation: Column) -> Column:
    return F.startswith(relation, F.lit("auto_"))


class GraphError(Exception):
    """What the library raises; kinds differ by class."""


class QueryError(GraphError):
    """A search without a usable token."""


class AmbiguousTarget(GraphError):
    """A name that several nodes answer to."""


class NotFound(GraphError):
    """A name that no node answers to."""


class BundleError(GraphError):
    """A bundle of a later version, or with edges that lead nowhere."""


class ScopeError(GraphError):
    """A manifest or a change of scopes that is not valid."""
