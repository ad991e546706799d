"""Renderers of known JSON and XML records: one ``#`` section a record, and details by its id.

A ``Renderer`` has a test, a list of (key, section text, detail) and a pattern that finds keys in
chunks; rendering joins the sections, annotating looks keys up in a chunk's text and then in
its section path.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from .extract import walk

Record = tuple[str, str, dict]


@dataclass(frozen=True)
class Renderer:
    test: Callable[[object], bool]
    records: Callable[[object], Iterator[Record]]
    pattern: re.Pattern
    key: Callable[[re.Match], str] = lambda m: m[0].upper()

    def can_render(self, path: str | None, obj: object) -> bool:
        return self.test(obj)

    def render(self, obj: object) -> str:
        return "\n\n".join(text for _, text, _ in self.records(obj))

    def annotate(self, chunks: list[tuple[str, list[str]]], obj: object) -> list[tuple[dict, str] | None]:
        """(detail, rendered record) of each (content, section), None where no record is named."""
        known = {k: (detail, text) for k, text, detail in self.records(obj) if k}
        return [self.find(content, section or [], known) for content, section in chunks]

    def find(self, content: str, section: list[str], known: dict):
        m = self.pattern.search(content)
        tries = [self.key(m)] if m else [self.key(x) for s in section if (x := self.pattern.match(s.strip()))][:1]
        return next((known[k] for k in tries if k in known), None)


def some(v, kind) -> list:
    """Members of a list that have a kind; other values give none, a single one gives itself."""
    if isinstance(v, kind):
        return [v]
    return [x for x in v if isinstance(x, kind)] if isinstance(v, list) else []


def part(title: str, body: list[str] | str) -> list[str]:
    body = [body] if isinstance(body, str) else list(body)
    return ["", f"## {title}", "", *body] if any(body) else []


def bold(*pairs) -> list[str]:
    return [f"**{k}:** {v}" for k, v in pairs if v]


def page(title: str, *parts: list[str]) -> str:
    return "\n".join([f"# {title}", "", *(x for p in parts for x in p)])


def unique(xs) -> list:
    return list(dict.fromkeys(xs))


# NVD


def _english(items) -> str:
    items = some(items, dict)
    return next((i for i in items if i.get("lang") == "en"), items[0] if items else {}).get("value", "").strip()


def _cvss(metrics: dict) -> tuple[float | None, str | None]:
    for version in ("40", "31", "30", "2"):
        for e in metrics.get(f"cvssMetricV{version}", ()):
            d = e.get("cvssData", {})
            if d.get("baseScore") is not None:
                return float(d["baseScore"]), (d.get("baseSeverity") or e.get("baseSeverity") or e.get("severity") or "").upper() or None
    return None, None


def _cpe(m: dict) -> str:
    name = m.get("criteria", "")
    f = name.split(":")
    known = len(f) > 5
    base = f"{f[3]}/{f[4]}".replace("_", " ") if known else name
    signs = (("versionStartIncluding", ">="), ("versionStartExcluding", ">"), ("versionEndIncluding", "<="), ("versionEndExcluding", "<"))
    bounds = ", ".join(f"{s} {m[k]}" for k, s in signs if m.get(k))
    return f"{base} ({bounds})" if bounds else f"{base} {f[5]}" if known and f[5] not in ("*", "") else base


def _cve_list(obj) -> list[dict]:
    if isinstance(obj, list):
        return [c for o in obj for c in _cve_list(o)]
    if not isinstance(obj, dict):
        return []
    if (entries := obj.get("vulnerabilities")) is not None:
        return [e["cve"] for e in entries if "cve" in e]
    return [obj] if str(obj.get("id", ""))[:4].upper() == "CVE-" else [obj["cve"]] if "cve" in obj else []


def _cves(obj) -> Iterator[Record]:
    for c in _cve_list(obj):
        score, severity = _cvss(c.get("metrics", {}))
        day = lambda k: (c.get(k) or "")[:10]  # noqa: E731, B023
        shown = None if score is None else f"{score} ({severity})" if severity else str(score)
        weak = ", ".join(unique(w for x in c.get("weaknesses", ()) if (w := _english(x.get("description", [])))))
        hit = unique(_cpe(m) for g in c.get("configurations", ()) for n in g.get("nodes", ()) for m in n.get("cpeMatch", ()) if m.get("vulnerable"))
        links = [r["url"] for r in c.get("references", ()) if r.get("url")][:10]
        text = page(
            c.get("id", "UNKNOWN"),
            bold(("Status", c.get("vulnStatus")), ("Published", day("published")), ("Last Modified", day("lastModified")), ("CVSS Score", shown), ("CWE", weak)),
            part("Description", _english(c.get("descriptions", []))), part("Affected", [f"- {h}" for h in hit]), part("References", [f"- {u}" for u in links]),
        )
        detail = {"cve_id": c.get("id"), "published": day("published") or None, "cvss_score": score, "severity": severity, "vuln_status": c.get("vulnStatus") or None}
        yield (c.get("id") or "").upper(), text, {k: v for k, v in detail.items() if v is not None}


CVE = Renderer(lambda o: bool(_cve_list(o)), _cves, re.compile(r"CVE-\d{4}-\d{4,}", re.I))


# ATT&CK


def _mitre(o: dict, what: str) -> str | None:
    return next((r.get(what) for r in o.get("external_references", ()) if r.get("source_name") == "mitre-attack"), None)


def _live(o: dict) -> bool:
    return not (o.get("revoked") or o.get("x_mitre_deprecated"))


def _attack(obj) -> Iterator[Record]:
    objects = some(obj.get("objects", []), dict)
    ids = {o["id"]: o for o in objects if "id" in o}
    links = [o for o in objects if o.get("type") == "relationship"]
    parents = {r.get("source_ref"): r.get("target_ref") for r in links if r.get("relationship_type") == "subtechnique-of"}
    cures: dict[str, list[dict]] = {}
    for r in links:
        m = ids.get(r.get("source_ref"), {})
        if r.get("relationship_type") == "mitigates" and m.get("type") == "course-of-action" and _live(m):
            cures.setdefault(r.get("target_ref"), []).append(m)
    for t in objects:
        if t.get("type") != "attack-pattern" or not _live(t):
            continue
        ident, name, sub = _mitre(t, "external_id"), t.get("name", ""), t.get("x_mitre_is_subtechnique", False)
        tactics, platforms = [p["phase_name"] for p in t.get("kill_chain_phases", ())], t.get("x_mitre_platforms", [])
        above = ids.get(parents.get(t.get("id"))) if sub else None
        parent = _mitre(above, "external_id") if above else None
        lines = []
        for m in cures.get(t.get("id"), ()):
            d = (m.get("description") or "").strip().split(". ")[0].rstrip(".")
            lines.append(f"- **{m.get('name', '')}** — {d}." if d else f"- {m.get('name', '')}")
        url = _mitre(t, "url")
        text = page(
            f"{ident or t.get('id', 'UNKNOWN')} {name}", bold(("Tactics", ", ".join(tactics)), ("Platforms", ", ".join(platforms)), ("Sub-technique of", parent)),
            part("Description", (t.get("description") or "").strip()), part("Mitigations", lines), part("References", f"- {url}" if url else ""),
        )
        detail = {"attack_id": ident, "name": name, "tactics": tactics, "platforms": platforms, "is_subtechnique": sub, "stix_id": t.get("id")}
        yield ident or "", text, detail | ({"parent_id": parent} if parent else {})


def _is_attack(o) -> bool:
    return isinstance(o, dict) and any(x.get("type") == "attack-pattern" and _live(x) and _mitre(x, "external_id") for x in some(o.get("objects"), dict))


ATTACK = Renderer(_is_attack, _attack, re.compile(r"\bT[0-9]{4}(\.[0-9]{3})?\b"), lambda m: m[0])


# CWE, from the dictionary form of its XML


def _inner(w: dict, box: str, item: str) -> list[dict]:
    """Repeated children in a container; a single child isn't a list in the dictionary form and isn't listed."""
    c = (some(w.get(box), dict) or [{}])[0].get(item, [])
    return some(c, dict) if isinstance(c, list) else []


def _leaf(v) -> str:
    v = v[0] if isinstance(v, list) and v else v
    return (v.get("_text") or "").strip() if isinstance(v, dict) else (v or "").strip() if isinstance(v, str) else ""


def _cwes(obj) -> Iterator[Record]:
    for box in some(obj.get("Weaknesses"), dict)[:1]:
        for w in some(box.get("Weakness", []), dict):
            platforms = [n for x in _inner(w, "Applicable_Platforms", "Language") if (n := x.get("Name") or x.get("Class"))]
            related = [f"CWE-{x['CWE_ID']}" + (f" ({x['Nature']})" if x.get("Nature") else "") for x in _inner(w, "Related_Weaknesses", "Related_Weakness") if x.get("CWE_ID")]
            scopes = unique(s for x in _inner(w, "Common_Consequences", "Consequence") if (s := _leaf(x.get("Scope"))))
            more = _leaf(w.get("Extended_Description"))
            text = page(
                f"CWE-{w.get('ID', '')} {w.get('Name', '')}", bold(("Platforms", ", ".join(platforms)), ("Related", ", ".join(related[:5]))),
                part("Description", _leaf(w.get("Description"))), ["", more] if more else [], part("Consequences", [f"- {s}" for s in scopes]),
            )
            yield w.get("ID", ""), text, {"cwe_id": f"CWE-{w.get('ID', '')}", "name": w.get("Name", ""), "platforms": platforms}


CWE = Renderer(lambda o: isinstance(o, dict) and o.get("_tag") == "Weakness_Catalog" and "Weaknesses" in o, _cwes, re.compile(r"\bCWE-(\d+)\b", re.I), lambda m: m[1])


# OSCAL controls; a sub-control is shown under its parent and again as a control


def _prose(parts: list[dict], depth: int = 0) -> Iterator[str]:
    for p in parts:
        if (p.get("prose") or "").strip():
            yield "  " * depth + p["prose"].strip()
        yield from _prose(p.get("parts", []), depth + 1)


def _controls(node: dict) -> Iterator[dict]:
    for c in node.get("controls", ()):
        yield c
        yield from _controls(c)


def _nist(obj) -> Iterator[Record]:
    for g in obj.get("catalog", obj).get("groups", ()):
        direct = {(c.get("id") or "").upper() for c in g.get("controls", ())}
        for c in _controls(g):
            body = list(_prose(c.get("parts", [])))
            lines = ["## Statement", "", *body] if body else []
            for s in c.get("controls", ()):
                inner = list(_prose(s.get("parts", [])))
                lines += ["", f"## {s.get('id', '').upper()} {s.get('title', '')}", *([""] + inner if inner else [])]
            ident = c.get("id", "UNKNOWN").upper()
            yield (c.get("id") or "").upper(), page(f"{ident} {c.get('title', '')}", lines), {"control_id": ident, "title": c.get("title", ""), "group": g.get("title", "") if ident in direct else ""}


def _is_nist(o) -> bool:
    catalog = o.get("catalog", o) if isinstance(o, dict) else None
    groups = some(catalog.get("groups"), dict) if isinstance(catalog, dict) else []
    return any(re.match(r"[a-z]{2}-\d+", c.get("id", "")) for g in groups[:3] for c in g.get("controls", ())[:3])


NIST = Renderer(_is_nist, _nist, re.compile(r"\b[a-z]{2}-\d+(?:\.\d+)?\b", re.I))


# clinical trials

CONDITIONS, INTERVENTIONS, CRITERIA = 5, 10, 2000


def _study_list(obj) -> list[dict]:
    if isinstance(obj, dict):
        return some(obj["studies"], dict) if "studies" in obj else [obj] if "protocolSection" in obj else []
    return [s for s in some(obj, dict) if "protocolSection" in s] if isinstance(obj, list) else []


def _trial_id(study: dict):
    node = study
    for k in ("protocolSection", "identificationModule", "nctId"):
        node = (node or {}).get(k)
    return node


def _trials(obj) -> Iterator[Record]:
    for s in _study_list(obj):
        mod = lambda n: s.get("protocolSection", {}).get(f"{n}Module", {})  # noqa: E731, B023
        ident, elig, desc = mod("identification"), mod("eligibility"), mod("description")
        nct, phases, conditions = ident.get("nctId", "UNKNOWN"), mod("design").get("phases", []), mod("conditions").get("conditions", [])
        title = ident.get("briefTitle", ident.get("officialTitle", ""))
        given = [f"- {i['type']}: {i['name']}" if i.get("type") else f"- {i['name']}" for i in mod("armsInterventions").get("interventions", ()) if i.get("name")]
        ages = " to ".join(filter(None, (elig.get("minimumAge", ""), elig.get("maximumAge", ""))))
        who = f" ({elig.get('sex', '')}, {ages})" if elig.get("sex") or ages else ""
        text = page(
            f"{nct} {title}", bold(("Status", mod("status").get("overallStatus")), ("Phase", ", ".join(phases)), ("Conditions", ", ".join(conditions[:CONDITIONS]))),
            part("Summary", (desc.get("briefSummary") or "").strip()), part("Detailed Description", (desc.get("detailedDescription") or "").strip()),
            part("Interventions", given[:INTERVENTIONS]), part(f"Eligibility{who}", (elig.get("eligibilityCriteria") or "").strip()[:CRITERIA]),
        )
        yield (ident.get("nctId") or "").upper(), text, {"nct_id": nct, "title": ident.get("briefTitle", ""), "status": mod("status").get("overallStatus", ""), "phases": phases, "conditions": conditions}


TRIALS = Renderer(lambda o: any(_trial_id(s) for s in _study_list(o)[:3]), _trials, re.compile(r"\bNCT\d{8}\b", re.I))


# drug labels

SECTION_CHARS = 3000
LABEL_SECTIONS = (
    "indications_and_usage dosage_and_administration dosage_forms_and_strengths contraindications warnings_and_cautions warnings adverse_reactions "
    "drug_interactions use_in_specific_populations description clinical_pharmacology mechanism_of_action clinical_studies how_supplied "
    "storage_and_handling patient_counseling_information"
).split()


def _section_title(key: str) -> str:
    if key == "warnings_and_cautions":
        return "Warnings and Precautions"
    return " ".join(w if w in ("and", "in", "of") else w.capitalize() for w in key.split("_"))


def _label_list(obj) -> list[dict]:
    if isinstance(obj, dict):
        return some(obj["results"], dict) if "results" in obj else [obj] if {"openfda", "indications_and_usage"} & obj.keys() else []
    return some(obj, dict) if isinstance(obj, list) else []


def _labels(obj) -> Iterator[Record]:
    for x in _label_list(obj):
        fda = x.get("openfda", {})
        first = lambda k: (fda.get(k) or [""])[0]  # noqa: E731, B023
        number = fda.get("application_number") or []
        ident = (number[0] if isinstance(number, list) else str(number)) if number else x.get("set_id") or x.get("id") or "UNKNOWN"
        brand, generic = first("brand_name"), first("generic_name")
        body: list[str] = []
        for k in LABEL_SECTIONS:
            v = x.get(k)
            joined = " ".join(map(str, v)).strip() if isinstance(v, list) else str(v).strip() if v else ""
            body += part(_section_title(k), joined[:SECTION_CHARS])
        text = page(
            brand or generic or ident,
            bold(("Application", ident if ident != "UNKNOWN" else ""), ("Generic", generic if generic != brand else ""), ("Manufacturer", first("manufacturer_name")), ("Route", ", ".join(fda.get("route", []))), ("Type", first("product_type"))),
            body,
        )
        detail = {"application_id": ident, "brand_name": brand, "generic_name": generic, "manufacturer": first("manufacturer_name")}
        detail = {k: v for k, v in detail.items() if v}
        yield (brand or generic or ident).upper(), text, detail
        if ident != "UNKNOWN" and ident.upper() != (brand or generic or ident).upper():
            yield ident.upper(), "", detail | {"_alias": (brand or generic or ident).upper()}


class _Labels(Renderer):
    """Labels are also found by name: any known name in the text, or at the start of a section's title."""

    def render(self, obj: object) -> str:
        return "\n\n".join(t for _, t, d in self.records(obj) if "_alias" not in d)

    def annotate(self, chunks, obj):
        known: dict = {}
        for k, text, d in self.records(obj):
            known[k] = known[d["_alias"]] if "_alias" in d else (d, text)
        return [self.find(c, s or [], known) for c, s in chunks]

    def find(self, content, section, known):
        m = self.pattern.search(content)
        if m:
            return known.get(m[0].upper())
        up = content.upper()
        titles = [s.strip().upper() for s in section]
        return next((known[k] for k in known if k in up), None) or next((known[k] for t in titles for k in known if t.startswith(k)), None)


LABELS = _Labels(lambda o: any({"openfda", "indications_and_usage"} & x.keys() for x in _label_list(o)[:3]), _labels, re.compile(r"\b(?:NDA|BLA|ANDA)\d{6}\b", re.I))


# FHIR

RESOURCES = frozenset("ServiceRequest Procedure Patient Observation MedicationStatement MedicationRequest Immunization ImagingStudy Encounter DiagnosticReport Condition AllergyIntolerance".split())
NOTES, NOTE_CHARS, ROWS = 3, 500, 20


def _resource_list(obj) -> list[dict]:
    if isinstance(obj, list):
        return [r for r in some(obj, dict) if r.get("resourceType")]
    kind = obj.get("resourceType", "") if isinstance(obj, dict) else ""
    if kind == "Bundle":
        return [e["resource"] for e in some(obj.get("entry", []), dict) if isinstance(e.get("resource"), dict)]
    return [obj] if kind in RESOURCES else []


def _coded(c) -> str:
    c = c or {}
    return c.get("text") or next((d for x in c.get("coding", ()) if (d := x.get("display") or x.get("code"))), "")


def _named(r) -> str:
    return (r or {}).get("display") or (r or {}).get("reference") or ""


def _measure(q: dict) -> str:
    return f"{q.get('value')} {q.get('unit') or q.get('code', '')}".strip() if q and q.get("value") is not None else ""


def _resource(r: dict) -> str:
    kind, ident = r.get("resourceType", "Resource"), r.get("id", "UNKNOWN")
    if kind == "Patient":
        n = (r.get("name") or [{}])[0]
        name = " ".join([*n.get("given", ()), n.get("family", "")]).strip()
        ids = [f"{i['value']} ({i['system']})" if i.get("system") else i["value"] for i in r.get("identifier", ()) if i.get("value")]
        return page(f"Patient/{ident} {name}", bold(("Gender", r.get("gender")), ("DOB", r.get("birthDate")), ("Identifiers", ", ".join(ids[:3]))))
    state = r.get("status") or r.get("clinicalStatus", {})
    when = next((r[k] for k in "recordedDate effectiveDateTime occurrenceDateTime authoredOn date issued onsetDateTime".split() if r.get(k)), "")
    group = r.get("category") or ""
    group = group[0] if isinstance(group, list) else group
    meta = bold(("Status", _coded(state) if isinstance(state, dict) else str(state)), ("Subject", _named(r.get("subject") or r.get("patient"))), ("Date", when[:10]), ("Category", _coded(group) if isinstance(group, dict) else str(group)))
    body: list[str] = []
    if kind == "Observation":
        for v in filter(None, (_measure(r.get("valueQuantity")), r.get("valueString"))):
            body += ["", f"**Value:** {v}"]
        if parts := r.get("component", [])[:ROWS]:
            body += ["", "## Components", "", *(f"- {_coded(p.get('code'))}: {v}" for p in parts if _coded(p.get("code")) and (v := _measure(p.get("valueQuantity", {}))))]
    elif kind == "DiagnosticReport":
        body += part("Results", [f"- {_named(x)}" for x in r.get("result", [])[:ROWS]])
    notes = [n["text"] for n in r.get("note", ()) if n.get("text")]
    code = _coded(r.get("code") or r.get("medicationCodeableConcept"))
    return page(f"{kind}/{ident} {code or ident}", meta, body, part("Notes", [n[:NOTE_CHARS] for n in notes[:NOTES]]))


def _fhir(obj) -> Iterator[Record]:
    for r in _resource_list(obj):
        kind, ident = r.get("resourceType", ""), r.get("id", "")
        detail = {"resource_type": kind, "resource_id": ident, "code": _coded(r.get("code") or r.get("medicationCodeableConcept")), "subject": _named(r.get("subject") or r.get("patient"))}
        yield f"{kind}/{ident}" if ident else "", _resource(r), detail


def _is_fhir(o) -> bool:
    return isinstance(o, dict) and (bool(o.get("entry")) and isinstance(o["entry"], list) if o.get("resourceType") == "Bundle" else o.get("resourceType") in RESOURCES)


FHIR = Renderer(_is_fhir, _fhir, re.compile(r"\b[A-Za-z]{2,}/[A-Za-z0-9\-.]+\b"), lambda m: m[0])


class _Stored(Renderer):
    """Records of document stores: every chunk gets the store's own description."""

    def annotate(self, chunks, obj):
        meta = obj.get("_source_meta", {}) if isinstance(obj, dict) else {}
        return [(meta, self.render(obj))] * len(chunks)


STORED = _Stored(lambda o: isinstance(o, dict) and "_source_meta" in o, lambda o: iter([("", "\n\n".join(walk({k: v for k, v in o.items() if k != "_source_meta"})), o["_source_meta"])]), re.compile("$^"))

ALL = (STORED, CVE, ATTACK, NIST, TRIALS, LABELS, FHIR, CWE)
