"""A session over one document, with the tools an agent may call.

The session holds a document's text and settings on the driver; what it derives
is made by the same functions that the batch operators run on executors. Content
leaves it only after a person has approved this very version: any change of what
the snapshot covers takes the approval back.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..functions.text import PY_WS
from ..operators.convert import MODES, convert_text
from ..operators.paging import CURSOR_MAX, PAGE_CHARACTERS, PAGE_ITEMS, page_at, truncate_json
from ..operators.assets import MAIL, URL
from ..operators.entities import LEAST_SCORE, family_of
from ..operators.rules import RULES
from ..operators.scan import Lines, spans
from ..operators.spans import SAME_MODEL, SAME_RULE, put_together, weight
from .samples import SAMPLES

# Bounds of inputs.
MAX_TEXT, MAX_IDS, MAX_ID = 200_000, 100, 100


class ToolError(ValueError):
    """A call that can't be done; the message says why."""


def _bounded(args: dict, name: str, low: int, high: int, default: int) -> int:
    v = args.get(name, default)
    if isinstance(v, bool) or not isinstance(v, int) or not low <= v <= high:
        raise ToolError(f"{name} has to be a whole number between {low} and {high}.")
    return v


def _consolidated(found: list[dict]) -> list[dict]:
    ranked = sorted(found, key=lambda f: (-weight(f), f["start"] - f["end"], f["start"]))
    kept = []
    for i, f in enumerate(ranked):
        share = max((min(f["end"], g["end"]) - max(f["start"], g["start"]) for g in ranked[:i]), default=0)
        if share < SAME_RULE * (f["end"] - f["start"]) or share <= 0:
            kept.append(f)
    return sorted(kept, key=lambda f: (f["start"], -f["end"]))


@dataclass
class Session:
    """One document; ``detector`` gives (start, end, label, score) for the deep scan, ``sink`` takes copied or exported text."""

    markdown: str = ""
    mode: str = "readable"
    append_references: bool = True
    file_name: str | None = None
    warnings: list[str] = field(default_factory=list)
    sample: str = SAMPLES["chatgpt"]
    detector: Callable[[str], list[tuple[int, int, str, float]]] | None = None
    sink: Callable[[str, str], bool] | None = None

    def __post_init__(self):
        self._approved: str | None = None
        self._deep: list[dict] = []
        self.deep_status = "idle"
        self._derive()

    # -- what follows from the text --

    def _derive(self) -> None:
        self.text, self.references, self.broken = convert_text(self.markdown, self.mode, self.append_references)
        rows = []
        lines = Lines(self.markdown)
        for order, a, b in spans(self.markdown):
            r = RULES[order - 1]
            rows.append(
                {"id": f"rule-{r.id}-{a}-{b}", "type": r.type, "severity": r.severity, "title": r.title, "detail": r.detail, "placeholder": r.placeholder, "start": a, "end": b,
                 "line": lines.of(a), "source": "rule", "confidence": None}
            )
        rules = _consolidated(rows)

        def apart(m: dict) -> bool:
            return all(min(m["end"], r["end"]) - max(m["start"], r["start"]) < SAME_MODEL * min(m["end"] - m["start"], r["end"] - r["start"]) for r in rules)

        self.findings = sorted([*rules, *filter(apart, self._deep)], key=lambda f: (f["start"], -f["end"]))

    def _snapshot(self) -> str:
        return json.dumps([self.markdown, self.text, self.mode, self.append_references, self.broken, [f["id"] for f in self.findings], self.deep_status, self.warnings], ensure_ascii=False)

    def _replace(self, text: str) -> None:
        self.markdown, self._deep, self.deep_status, self._approved = text, [], "idle", None
        self._derive()

    @property
    def approved(self) -> bool:
        return self._approved is not None and self._approved == self._snapshot()

    def approve(self) -> None:
        """A person's decision; no tool can make it."""
        if not self.markdown.strip(PY_WS) or not self.text.strip(PY_WS):
            raise ToolError("There is nothing to approve.")
        self._approved = self._snapshot()

    def _need_approval(self) -> None:
        if not self.approved:
            raise ToolError("A person has to approve this version first.")

    def _need_text(self) -> None:
        if not self.markdown.strip(PY_WS):
            raise ToolError("Add document content first.")

    def assets(self) -> list[dict]:
        rows = [{"type": "image" if r.kind == "image" else "link", "value": r.url, "label": r.label} for r in self.references]
        seen = {r["value"] for r in rows}
        for m in re.finditer(URL, self.markdown):
            if m[0] not in seen:
                seen.add(m[0])
                rows.append({"type": "link", "value": m[0], "label": None})
        rows += [{"type": "email", "value": m[0], "label": None} for m in re.finditer(MAIL, self.markdown)]
        return rows

    def readiness(self) -> dict:
        checks = {
            "hasDocument": bool(self.markdown.strip(PY_WS)), "hasConvertedOutput": bool(self.text.strip(PY_WS)), "aiReadyMode": self.mode == "ai",
            "deepPrivacyScanComplete": self.deep_status == "complete", "noSafetyFindings": not self.findings, "noBrokenReferences": not self.broken,
        }
        passed = all(checks.values())
        state = "empty" if not checks["hasDocument"] else "ready" if passed and self.approved else "review"
        return {"readiness": state, "contentChecksPass": passed, "humanApprovalGranted": self.approved, "checks": checks}

    # -- the tools --

    def get_document_state(self, **_) -> dict:
        return {
            "markdownLength": len(self.markdown), "wordCount": len(self.markdown.split()), "outputLength": len(self.text), "conversionMode": self.mode,
            "appendReferences": self.append_references, "hasImportedFile": self.file_name is not None, "importWarningCount": len(self.warnings),
            "imageRedactionActive": False, "imageOcrCoordinatesReady": False, "imageRedactionSuggestionCount": 0, "referenceCount": len(self.references),
            "brokenReferenceCount": len(self.broken), "assetCount": len(self.assets()), "safetyFindingCount": len(self.findings), "deepScanStatus": self.deep_status,
            "humanApprovalGranted": self.approved,
        }

    def get_converted_text(self, **args) -> dict:
        self._need_approval()
        cursor, size = _bounded(args, "cursor", 0, CURSOR_MAX, 0), _bounded(args, "maxCharacters", 1, PAGE_CHARACTERS, PAGE_CHARACTERS)
        if cursor > len(self.text):
            raise ToolError("The cursor lies after the last character.")
        return page_at(self.text, cursor, self.mode, size)

    def set_document_content(self, text=None, **_) -> dict:
        if not isinstance(text, str) or len(text) > MAX_TEXT:
            raise ToolError(f"The text has to be a string of no more than {MAX_TEXT} characters.")
        self._replace(text)
        return {"updated": True, "markdownLength": len(text), "outputLength": len(self.text), "safetyFindingCount": len(self.findings)}

    def set_conversion_options(self, **args) -> dict:
        if not {"mode", "appendReferences"} & args.keys():
            raise ToolError("Give a mode, or whether to append references.")
        if args.get("mode", "plain") not in MODES:
            raise ToolError(f"The mode is one of {', '.join(MODES)}.")
        if not isinstance(args.get("appendReferences", True), bool):
            raise ToolError("appendReferences is true or false.")
        self.mode, self.append_references, self._approved = args.get("mode", self.mode), args.get("appendReferences", self.append_references), None
        self._derive()
        return {"updated": True, "conversionMode": self.mode, "appendReferences": self.append_references, "approvalReset": True}

    def _page(self, args: dict, items: list, name: str) -> tuple[list, dict]:
        cursor, limit = _bounded(args, "cursor", 0, CURSOR_MAX, 0), _bounded(args, "limit", 1, PAGE_ITEMS, PAGE_ITEMS)
        if cursor > len(items):
            raise ToolError(f"The cursor lies after the last entry of the {name} list.")
        end = min(cursor + limit, len(items))
        return items[cursor:end], {"cursor": cursor, "nextCursor": end if end < len(items) else None}

    def list_document_assets(self, **args) -> dict:
        self._need_approval()
        items = [{"category": "asset", **a} for a in self.assets()]
        items += [{"category": "reference", "type": r.kind, "value": r.url, "label": r.label} for r in self.references]
        items += [{"category": "broken-reference", "type": "reference", "value": b, "label": None} for b in self.broken]
        page, out = self._page(args, items, "asset")
        rows = []
        for i in page:
            value, cut = truncate_json(i["value"], 180, 280)
            label, label_cut = truncate_json(i["label"], 80, 100) if i["label"] else (None, False)
            rows.append({"category": i["category"], "type": i["type"], "value": value, "valueTruncated": cut, "label": label, "labelTruncated": label_cut})
        return {"items": rows, **out, "totalItems": len(items)}

    def get_safety_findings(self, **args) -> dict:
        page, out = self._page(args, self.findings, "findings")
        rows = [{**{k: f[k] for k in ("id", "type", "severity", "line", "source", "confidence")}, "title": f["title"][:100], "detail": f["detail"][:180], "placeholder": f["placeholder"][:60]} for f in page]
        return {"findings": rows, **out, "totalFindings": len(self.findings)}

    def get_handoff_readiness(self, **_) -> dict:
        return self.readiness()

    def prepare_agent_handoff(self, **args) -> dict:
        self._need_text()
        self.set_conversion_options(mode="ai", appendReferences=args.get("appendReferences", True))
        return {"updated": True, "conversionMode": "ai", "appendReferences": self.append_references, "approvalReset": True, "nextTool": "get_handoff_readiness"}

    def run_deep_privacy_scan(self, **_) -> dict:
        self._need_text()
        rows, lines = [], Lines(self.markdown)
        for a, b, label, score in self.detector(self.markdown) if self.detector else []:
            f = family_of(label)
            if f and 0 <= a < b <= len(self.markdown) and score >= LEAST_SCORE:
                rows.append({"id": f"local-ai-{a}-{b}-{f.pop('key')}", **f, "start": a, "end": b, "line": lines.of(a), "source": "local-ai", "confidence": score})
        self._deep, self.deep_status, self._approved = rows, "complete", None
        self._derive()
        return {"status": "complete", "findingCount": len(self.findings), "privacy": "local-only", "nextTool": "get_handoff_readiness"}

    def redact_document_findings(self, findingIds=None, **_) -> dict:  # noqa: N803 - the tool's own name for its input
        ids = findingIds
        if not isinstance(ids, list) or not 1 <= len(ids) <= MAX_IDS or not all(isinstance(i, str) and len(i) <= MAX_ID for i in ids):
            raise ToolError(f"findingIds has to list between 1 and {MAX_IDS} ids.")
        known = {f["id"]: f for f in self.findings}
        for i in ids:
            if i not in known:
                raise ToolError(f"No finding has the id {i}.")
        chosen = sorted((known[i] for i in dict.fromkeys(ids)), key=lambda f: (f["start"], -f["end"]))
        rows = [{"id": f["id"], "start_pos": f["start"], "end_pos": f["end"], "placeholder": f["placeholder"], "type": f["type"], "prio": weight(f)} for f in chosen]
        text, _, merged = put_together(self.markdown, rows, True)
        self._replace(text)
        return {"redacted": len(chosen), "overlapMerged": len(merged), "updated": True, "remainingFindingCount": len(self.findings), "approvalReset": True}

    def copy_converted_text(self, **_) -> dict:
        if not self.text:
            raise ToolError("Nothing has been converted yet.")
        self._need_approval()
        if self.sink is None or not self.sink("clipboard", self.text):
            raise ToolError("The text could not be copied.")
        return {"copied": True, "characters": len(self.text)}

    def download_converted_text(self, **_) -> dict:
        if not self.text:
            raise ToolError("Nothing has been converted yet.")
        self._need_approval()
        if self.sink is not None:
            self.sink("converted-text.txt", self.text)
        return {"downloadStarted": True, "filename": "converted-text.txt"}

    def clear_document(self, **_) -> dict:
        self.file_name, self.warnings = None, []
        self._replace("")
        return {"cleared": True, "approvalReset": True}

    def insert_sample_document(self, **_) -> dict:
        self._replace(self.sample)
        return {"inserted": True, "markdownLength": len(self.sample), "approvalReset": True}


#: The tools by name, and whether they only read.
TOOLS = {
    "get_document_state": True, "get_converted_text": True, "set_document_content": False, "set_conversion_options": False, "list_document_assets": True,
    "get_safety_findings": True, "get_handoff_readiness": True, "prepare_agent_handoff": False, "run_deep_privacy_scan": False, "redact_document_findings": False,
    "copy_converted_text": False, "download_converted_text": False, "clear_document": False, "insert_sample_document": False,
}


def call(session: Session, tool: str, arguments: dict | None = None) -> dict:
    """Calls a tool by name; raises ToolError for unknown tools and arguments that aren't an object."""
    if tool not in TOOLS:
        raise ToolError(f"Unknown tool: {tool}")
    if not isinstance(arguments if arguments is not None else {}, dict):
        raise ToolError("Input must be an object.")
    return getattr(session, tool)(**(arguments or {}))


def register(add: Callable[[str, Callable], None], remove: Callable[[str], None], session: Session) -> int:
    """Registers all tools or none; the number registered."""
    done = []
    try:
        for name in TOOLS:
            add(name, lambda args=None, n=name: call(session, n, args))
            done.append(name)
    except Exception:  # noqa: BLE001 - any failure takes all back
        for name in done:
            remove(name)
        return 0
    return len(done)


CALLS = "session_id long, seq int, tool string, result string, error string"


def run_calls(calls: DataFrame, detector: Callable[[str], list[tuple[int, int, str, float]]] | None = None) -> DataFrame:
    """Rows of CALLS: the result of each call, as JSON, or its error; ``calls`` has session_id, seq, tool and arguments (JSON).

    Each session is played in one task, in the order of seq. The tool "approve" is a person's decision.
    """
    import pandas as pd

    def play(pdf: pd.DataFrame) -> pd.DataFrame:
        session, rows = Session(detector=detector, sink=lambda kind, text: True), []
        for r in pdf.sort_values("seq").itertuples():
            result = error = None
            try:
                arguments = json.loads(r.arguments) if r.arguments else {}
                if r.tool == "approve":
                    session.approve()
                    result = {"approved": session.approved}
                else:
                    result = call(session, r.tool, arguments)
            except (ToolError, json.JSONDecodeError) as e:
                error = str(e)
            rows.append((r.session_id, r.seq, r.tool, None if result is None else json.dumps(result, ensure_ascii=False, separators=(",", ":")), error))
        return pd.DataFrame(rows, columns=["session_id", "seq", "tool", "result", "error"])

    return calls.groupBy("session_id").applyInPandas(play, CALLS)
