"""The provenance data model: kinds, relations, prefixes and the size of a run's graph."""

from __future__ import annotations

# Fixed values of the document format.
PREFIXES = {
    "prov": "http://www.w3.org/ns/prov#",
    "openml": "https://openml.org/def/",
    "ml": "https://ml-schema.org/",
    "e": "urn:entity:",
    "a": "urn:activity:",
    "ag": "urn:agent:",
    "checksum": "urn:checksum:",
    "fold": "urn:fold:",
}
REQUIRED_PREFIXES = ("prov", "e", "a", "ag")
KINDS = ("entity", "activity", "agent")

#: Fixed values of the document format: relation -> (subject key, object key, kind of the subject, kind of the object, letter of its ids)
RELATIONS = {
    "used": ("prov:activity", "prov:entity", "activity", "entity", "u"),
    "wasGeneratedBy": ("prov:entity", "prov:activity", "entity", "activity", "g"),
    "wasAssociatedWith": ("prov:activity", "prov:agent", "activity", "agent", "a"),
    "wasInformedBy": ("prov:informed", "prov:informant", "activity", "activity", "i"),
    "wasAttributedTo": ("prov:entity", "prov:agent", "entity", "agent", "t"),
    "wasDerivedFrom": ("prov:generatedEntity", "prov:usedEntity", "entity", "entity", "d"),
}

NODES = "doc_id string, kind string, node_id string, ptype string, attrs map<string,string>"
EDGES = "doc_id string, rel string, edge_id string, src string, dst string, role string"


def expected_counts(folds: int = 5) -> dict[str, int]:
    """Nodes and edges of one run's graph."""
    entities, activities = 6 + 4 * folds, 2 + 3 * folds
    return {"nodes": entities + activities + 1, "edges": 8 + 24 * folds, "entities": entities, "activities": activities, "agents": 1}
