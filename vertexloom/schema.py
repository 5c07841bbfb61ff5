"""Core columns, vocabularies and defaults of a property graph."""

from __future__ import annotations

NODE_COLUMNS = {
    "id": "string", "label": "string", "norm_label": "string", "file_type": "string", "source_file": "string", "source_location": "string",
    "repo": "string", "community": "int", "community_name": "string", "external": "boolean", "rationale": "string", "attributes": "string", "ord": "bigint",
}
EDGE_COLUMNS = {
    "src": "string", "dst": "string", "relation": "string", "confidence": "string", "confidence_score": "double", "weight": "double",
    "context": "string", "source_file": "string", "source_location": "string", "deferred": "boolean", "type_only": "boolean", "ord": "bigint",
}
HYPEREDGE_COLUMNS = {"id": "string", "label": "string", "relation": "string", "nodes": "array<string>", "confidence": "string"}

CONFIDENCE_RANK = {"EXTRACTED": 3, "INFERRED": 2, "AMBIGUOUS": 1}
CONFIDENCE_SCORE = {"EXTRACTED": 1.0, "INFERRED": 0.55, "AMBIGUOUS": 0.2}
FILE_TYPES = ("code", "concept", "document", "image", "paper", "rationale")
FILE_TYPE_ALIASES = {"doc": "document", "docs": "document", "markdown": "document", "text": "document", "source": "code", "script": "code", "figure": "image", "diagram": "image", "pdf": "paper", "article": "paper"}
RELATION_ALIASES = {"call": "calls", "import": "imports", "reference": "references", "use": "uses", "contain": "contains", "extend": "extends", "implement": "implements"}
IMPORT_RELATIONS = ("imports", "imports_from", "re_exports")
STRUCTURAL_RELATIONS = ("contains", "imports", "imports_from", "method")
GENERIC_RELATIONS = ("mentions", "references", "uses")
MEMBER_RELATIONS = ("contains", "method")
SUPERTYPE_RELATIONS = ("extends", "implements", "inherits")
AFFECTED_RELATIONS = (
    "references", "calls", "uses", "indirect_call", "imports", "defines", "imports_from", "requires", "dynamic_import", "extends",
    "re_exports", "inherits", "embeds", "implements", "mixes_in",
)


def ddl(columns: dict[str, str]) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in columns.items())
