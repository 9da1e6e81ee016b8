"""A small Turtle codec for class hierarchies: labels, wording, and parents (SRC22).

Several parents are written as one union, as they mean either.  Only what this
module writes is read back; an ontology is driver-side and small.
"""

from __future__ import annotations

import json
import re

PREFIXES = {"owl": "http://www.w3.org/2002/07/owl#", "rdfs": "http://www.w3.org/2000/01/rdf-schema#", "s": "urn:skerry:wording#", "c": "urn:skerry:class#"}
FIELDS = ("definition", "inclusion", "exclusion")


def _slugs(names: list[str]) -> dict[str, str]:
    out: dict[str, str] = {}
    for name in names:
        slug = re.sub(r"[^A-Za-z0-9]+", "_", name).strip("_") or "class"
        while slug in out.values():
            slug += "_"
        out[name] = slug
    return out


def write(concepts: list[dict], relations: list[tuple[str, str]]) -> str:
    """``concepts`` with name and wording; ``relations`` as (child, parent) names."""
    slug = _slugs([c["name"] for c in concepts])
    above: dict[str, list[str]] = {}
    for child, parent in relations:
        above.setdefault(child, []).append(parent)
    lines = [f"@prefix {p}: <{iri}> ." for p, iri in PREFIXES.items()] + [""]
    for c in concepts:
        parts = [f"c:{slug[c['name']]} a owl:Class", f"rdfs:label {json.dumps(c['name'], ensure_ascii=False)}"]
        parts += [f"s:{f} {json.dumps(c[f], ensure_ascii=False)}" for f in FIELDS if c.get(f)]
        parents = sorted(set(above.get(c["name"], [])))
        if len(parents) == 1:
            parts.append(f"rdfs:subClassOf c:{slug[parents[0]]}")
        elif parents:
            parts.append(f"rdfs:subClassOf [ a owl:Class ; owl:unionOf ( {' '.join(f'c:{slug[p]}' for p in parents)} ) ]")
        lines.append(" ;\n    ".join(parts) + " .")
    return "\n".join(lines) + "\n"


def read(text: str) -> tuple[list[dict], list[tuple[str, str]]]:
    """Concepts and relations of what ``write`` gives."""
    found, parents = {}, {}
    string = r'"(?:[^"\\]|\\.)*"'
    for block in re.finditer(rf"^c:(\w+) a owl:Class((?:{string}|[^\"])*?) \.$", text, re.M | re.S):
        slug, body = block[1], block[2]
        values = {k: json.loads(v) for k, v in re.findall(rf"(?:rdfs|s):(label|definition|inclusion|exclusion) ({string})", body)}
        if "label" not in values:
            raise ValueError(f"class {slug} has no label")
        found[slug] = {"name": values["label"], **{f: values.get(f) for f in FIELDS}}
        rest = re.sub(string, "", body)
        parents[slug] = re.findall(r"c:(\w+)", rest.partition("rdfs:subClassOf")[2])
    return list(found.values()), [(found[child]["name"], found[p]["name"]) for child, above in parents.items() for p in above]
