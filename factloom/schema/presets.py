"""Presets: named sets of entity and relationship types.

Fixed values: names and order of the types and their property lists, which results and ties depend on.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from factloom.model import GraphError


@dataclass
class EntityType:
    name: str
    properties: list[str]
    extraction_hint: str = ""
    examples: list[str] = field(default_factory=list)


@dataclass
class Preset:
    name: str
    description: str
    entity_types: list[EntityType]
    relationship_types: list[str]


_HINTS = {
    "Person": ("somebody who is mentioned by name", ["Maya leads the data group", "Tomas wrote the parser", "Ines approved the plan"]),
    "Company": ("a firm, agency or other organisation", ["Northwind supplies the sensors", "Our auditor is Brandt", "Kestrel bought the licence"]),
    "Team": ("a named group of people who work together", ["The ingest crew is on call", "Support moved to the third floor", "The design guild meets weekly"]),
    "Project": ("a piece of work with a name and an end", ["Lighthouse ships in May", "The rewrite is on hold", "Project Heron needs a budget"]),
    "Decision": ("something that was settled, and why", ["We keep the monorepo", "Releases go out on Mondays", "The board turned the offer down"]),
    "Meeting": ("a gathering at a given time", ["The kickoff was on Tuesday", "Retro of sprint nine", "Call with the vendor at noon"]),
    "Repository": ("a place where source code is kept", ["billing-api is written in Kotlin", "The docs repo was archived", "infra holds the manifests"]),
    "Bug": ("a defect that somebody reported", ["Login fails on Safari", "Totals are off by a cent", "The queue stalls at midnight"]),
    "Pattern": ("a way of doing things that recurs", ["Retries use a backoff", "Writes go through an outbox", "Config is read once at start"]),
    "Topic": ("a subject that is talked about", ["Costs came up again", "Hiring in the north", "What to do about latency"]),
    "Fact": ("a statement that a later one may replace", ["The limit is 500 requests", "Maya is head of data since June", "The office has 40 desks"]),
    "File": ("one file of a code base", ["main.go starts the server", "schema.sql defines the tables", "ci.yml runs the tests"]),
    "Function": ("a function, method or endpoint", ["parse_row drops blanks", "GET /orders is paged", "retry() sleeps twice"]),
    "Dependency": ("a library or service that code needs", ["numpy is pinned", "The mailer is hosted elsewhere", "zlib comes with the base image"]),
    "Action": ("a task that is given to somebody", ["Tomas sends the minutes", "Renew the certificate by Friday", "Ines calls the bank"]),
}


def _types(**properties: str) -> list[EntityType]:
    return [EntityType(n, ["name", *p.split()], _HINTS[n][0], list(_HINTS[n][1])) for n, p in properties.items()]


PRESETS = {
    "dev-team": Preset(
        "dev-team", "People, work and knowledge of a software team and those who run it.",
        _types(Person="role email team", Company="industry relationship", Team="focus lead", Project="status deadline priority", Decision="rationale decided_by date", Meeting="date attendees outcome", Repository="language owner status", Bug="severity status assignee", Pattern="context applicability", Topic="context", Fact="content source confidence timestamp"),
        ["WORKS_AT", "REPORTS_TO", "COLLABORATES_WITH", "DECIDED", "ADVOCATED_FOR", "ATTENDED", "OWNS", "CONTRIBUTES_TO", "DEPENDS_ON", "CAUSED_BY", "RELATES_TO", "FIXES", "SUPERSEDED_BY"],
    ),
    "coding-agent": Preset(
        "coding-agent", "Code, defects and technical choices as a coding agent meets them.",
        _types(Person="role github expertise", Repository="language owner status", File="path language purpose", Function="file signature purpose", Bug="severity status root_cause", Decision="rationale alternatives date", Pattern="context applicability", Dependency="version purpose status", Fact="content source confidence timestamp"),
        ["OWNS", "CONTRIBUTES_TO", "DEPENDS_ON", "CAUSED_BY", "SIMILAR_TO", "DECIDED", "CALLS", "IMPORTS", "FIXES", "SUPERSEDED_BY"],
    ),
    "executive-assistant": Preset(
        "executive-assistant", "People, organisations, meetings and tasks around an executive.",
        _types(Person="role email company", Company="industry relationship", Team="focus lead", Project="status deadline priority", Decision="rationale decided_by date", Meeting="date attendees outcome", Topic="context", Action="assignee deadline status", Fact="content source confidence timestamp"),
        ["WORKS_AT", "REPORTS_TO", "COLLABORATES_WITH", "DECIDED", "ADVOCATED_FOR", "ATTENDED", "RELATES_TO", "ASSIGNED_TO", "BLOCKED_BY", "SUPERSEDED_BY"],
    ),
}


def preset(name: str) -> Preset:
    if name not in PRESETS:
        raise GraphError(f'Unknown preset: "{name}". Valid presets: {", ".join(PRESETS)}')
    p = PRESETS[name]
    return Preset(p.name, p.description, [EntityType(t.name, list(t.properties), t.extraction_hint, list(t.examples)) for t in p.entity_types], list(p.relationship_types))


def from_json(text: str) -> Preset:
    """A preset of one's own, from its JSON text."""
    import json

    o = json.loads(text)
    kinds = [EntityType(t["name"], list(t.get("properties", [])), t.get("extraction_hint", ""), list(t.get("examples", []))) for t in o["entity_types"]]
    return Preset(o["name"], o.get("description", ""), kinds, list(o["relationship_types"]))
