"""Schemas and the relation vocabulary."""

from __future__ import annotations

SCOPE = "map<string,string>"
RELATION = f"struct<type:string,target:string,evidence:string,scope:{SCOPE}>"
NODE_COLUMNS = ("path", "id", "node_type", "title", "status", "valid_from", "valid_until", "scope", "relations", "body")
NODES = f"path string, id string, node_type string, title string, status string, valid_from string, valid_until string, scope {SCOPE}, relations array<{RELATION}>, body string"
SCAN = f"{NODES}, error string"

#: Forward relation types and what they are called from the other end.
INVERSE = {"supersedes": "superseded_by", "depends_on": "required_by", "supported_by": "supports", "caused_by": "caused", "contradicts": "contradicts", "relates_to": "relates_to"}
#: Never declared in a note, always derived.
DERIVED_ONLY = ("superseded_by", "required_by", "supports", "caused")
#: Statuses of notes that no longer count.
INACTIVE = ("deprecated", "superseded", "archived", "retired", "obsolete")
#: Types that the guarded write accepts.
PERMITTED_TYPES = ("Concept", "Decision", "Incident", "Runbook", "Evidence", "Proposal", "Review", "Source", "Note", "Architecture", "Infrastructure", "Service", "Application")
