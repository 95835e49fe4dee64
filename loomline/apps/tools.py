"""The service's calls as tools, resources and a prompt of the Model Context Protocol, over lines of JSON-RPC.

Run: python -m loomline.apps.tools [root]
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Iterable, Iterator

from loomline.apps.service import SECONDS, Service
from loomline.operators import agent_rules, repo_map, reports
from loomline.operators.models import OUTPUT_TOKENS

PROTOCOL = "2024-11-05"
_TEXT, _NUMBER, _BOOL = {"type": "string"}, {"type": "number"}, {"type": "boolean"}
_GOAL, _PRIVACY, _FORM = {"type": "string", "enum": list(OUTPUT_TOKENS)}, {"type": "string", "enum": ["local-first", "cloud-ok"]}, {"type": "string", "enum": ["markdown", "json"]}
_TEXTS = {"type": "array", "items": _TEXT}
#: Names and arguments of the tools.
TOOLS = {
    "scan_workspace": ({"rootPath": _TEXT, "goal": _GOAL, "privacyMode": _PRIVACY, "timeoutMs": {"type": "integer", "minimum": 1, "maximum": 300_000}}, "Sums of a workspace's files as compact JSON."),
    "recommend_models": ({"rootPath": _TEXT, "goal": _GOAL, "privacyMode": _PRIVACY, "catalogPath": _TEXT, "tokenBudget": _NUMBER}, "Models for a workspace by its tokens, a goal and privacy."),
    "create_repo_map": ({"rootPath": _TEXT, "goal": _GOAL, "tokenBudget": _NUMBER, "enableSymbolExtraction": _BOOL, "maxSymbols": _NUMBER, "format": _FORM}, "A map of a workspace's important files and symbols."),
    "generate_agent_rules": ({"rootPath": _TEXT, "target": {"type": "string", "enum": list(agent_rules.FILES)}, "mode": {"type": "string", "enum": list(agent_rules.BEHAVIOUR)}, "goal": _GOAL, "privacyMode": _PRIVACY}, "Rules for an agent in a mode."),
    "generate_report": ({"rootPath": _TEXT, "goal": _GOAL, "privacyMode": _PRIVACY, "catalogPath": _TEXT, "includeRepoMap": _BOOL, "format": _FORM}, "A report of a scan and the models for it."),
    "validate_model_catalog": ({"catalogPath": _TEXT}, "What is wrong with a model catalogue."),
    "compact_completed_goal": ({"goal": _GOAL, "summary": _TEXT, "changedFiles": _TEXTS, "decisions": _TEXTS, "nextSteps": _TEXTS, "sourceTokens": _NUMBER}, "A finished goal as short context."),
    "estimate_files_tokens": ({"filePaths": _TEXTS, "workspaceRoot": _TEXT, "targetModel": _TEXT, "contextBudget": {"type": "integer", "minimum": 1}}, "Tokens of some files, and whether they fit."),
}
REQUIRED = {"compact_completed_goal": ["goal", "summary"], "estimate_files_tokens": ["filePaths"]}
RESOURCES = {"workspace://summary": ("Workspace Summary", "scan"), "model-catalog://models": ("Model Catalog Summary", "catalog")}
PROMPT = "optimize_coding_agent_for_workspace"


class UnknownMethod(Exception):
    """A method that the server hasn't got."""


class Malformed(Exception):
    """JSON that is no request."""


class Tools:
    def __init__(self, service: Service) -> None:
        self.service = service

    def call(self, name: str, a: dict) -> str:
        """What a tool says, as text."""
        s, goal, privacy = self.service, a.get("goal", "build-mvp"), a.get("privacyMode", "local-first")
        dump = lambda x: json.dumps(x, ensure_ascii=False)
        schema = TOOLS[name][0]
        for field, value in a.items():
            allowed = schema.get(field, {}).get("enum")
            if allowed and value not in allowed:
                raise ValueError(f"invalid {field}: {value}")
        if missing := [f for f in REQUIRED.get(name, []) if f not in a]:
            raise ValueError("missing " + ", ".join(missing))
        if name == "scan_workspace":
            return dump(s.scan_summary(a.get("rootPath"), a.get("goal"), a.get("timeoutMs", SECONDS * 1000) / 1000))
        if name == "recommend_models":
            tokens = s.scan_summary(a.get("rootPath"))["totalEstimatedTokens"]
            return dump(s.compact_recommendation(s.recommend(tokens, goal, privacy, a.get("tokenBudget"), a.get("catalogPath"))))
        if name == "create_repo_map":
            made = s.repo_map(a.get("rootPath"), a.get("goal"), a.get("tokenBudget", 64_000), a.get("enableSymbolExtraction", True), int(a.get("maxSymbols", 500)))
            return dump(made.compact()) if a.get("format") == "json" else repo_map.markdown(made)
        if name == "generate_agent_rules":
            return s.rules(a.get("rootPath"), a.get("target", "generic"), a.get("mode", "normal"), goal, privacy).content
        if name == "generate_report":
            return s.report(a.get("rootPath"), goal, privacy, a.get("catalogPath"), a.get("format", "markdown"), a.get("includeRepoMap", False))
        if name == "validate_model_catalog":
            return dump(s.validate(a.get("catalogPath")))
        if name == "compact_completed_goal":
            text, tokens, saved = reports.finished_goal(a["goal"], a["summary"], a.get("changedFiles", []), a.get("decisions", []), a.get("nextSteps", []), a.get("sourceTokens"))
            return dump({"content": text, "estimatedTokens": tokens, "savedTokens": saved})
        return dump(s.estimate_files(a["filePaths"], a.get("workspaceRoot"), a.get("contextBudget"), a.get("targetModel")))

    def answer(self, method: str, p: dict) -> dict:
        if method == "initialize":
            return {"protocolVersion": PROTOCOL, "serverInfo": {"name": "loomline", "version": "1"}, "capabilities": {"tools": {}, "resources": {}, "prompts": {}}}
        if method == "tools/list":
            return {"tools": [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": f} | ({"required": REQUIRED[n]} if n in REQUIRED else {})} for n, (f, d) in TOOLS.items()]}
        if method == "tools/call":
            text = lambda t, bad=False: {"content": [{"type": "text", "text": t}]} | ({"isError": True} if bad else {})
            if p.get("name") not in TOOLS:
                return text(f"Unknown tool: {p.get('name')}", True)
            try:
                return text(self.call(p["name"], p.get("arguments") or {}))
            except Exception as error:  # noqa: BLE001 - a tool's failure is an answer of the protocol
                return text(str(error), True)
        if method == "resources/list":
            return {"resources": [{"uri": u, "name": n, "mimeType": "application/json"} for u, (n, _) in RESOURCES.items()]}
        if method == "resources/templates/list":
            return {"resourceTemplates": []}
        if method == "resources/read":
            uri = p.get("uri")
            told = json.dumps(self.service.latest.get(RESOURCES[uri][1], {"error": "nothing yet"}), ensure_ascii=False) if uri in RESOURCES else "Unknown resource"
            return {"contents": [{"uri": uri, "text": told}]}
        if method == "prompts/list":
            return {"prompts": [{"name": PROMPT, "arguments": [{"name": n, "required": n == "goal"} for n in ("goal", "tokenBudget", "privacyMode")]}]}
        if method == "prompts/get":
            a = p.get("arguments") or {}
            told = self.service.prompt(a.get("goal", "build-mvp"), int(a["tokenBudget"]) if a.get("tokenBudget") else None, a.get("privacyMode", "local-first")) if p.get("name") == PROMPT else "Unknown prompt"
            return {"messages": [{"role": "user", "content": {"type": "text", "text": told}}]}
        raise UnknownMethod(method)

    def serve(self, lines: Iterable[str]) -> Iterator[str]:
        """A line of JSON for each request; notifications have no answer."""
        for line in lines:
            if not line.strip():
                continue
            told: dict = {"jsonrpc": "2.0", "id": None}
            try:
                asked = json.loads(line)
                if not isinstance(asked, dict):
                    raise Malformed("a request is an object")
                if "id" not in asked:
                    continue
                if not isinstance(asked["id"], str | int | float | None) or isinstance(asked["id"], bool):
                    raise Malformed("an id is a string or a number")
                told["id"] = asked["id"]
                method, given = asked.get("method"), asked.get("params")
                if not isinstance(method, str):
                    raise Malformed("a method is a string")
                if given is not None and not isinstance(given, dict) or isinstance(given, dict) and not isinstance(given.get("arguments") or {}, dict):
                    raise ValueError("params and arguments are objects")
                told["result"] = self.answer(method, given or {})
            except json.JSONDecodeError:
                told["error"] = {"code": -32700, "message": "not JSON"}
            except Malformed as error:
                told["error"] = {"code": -32600, "message": str(error)}
            except UnknownMethod as error:
                told["error"] = {"code": -32601, "message": f"unknown method: {error}"}
            except (ValueError, TypeError, AttributeError) as error:
                told["error"] = {"code": -32602, "message": str(error)}
            except Exception as error:  # noqa: BLE001 - one failed request mustn't end the server
                told["error"] = {"code": -32603, "message": f"{type(error).__name__}: {error}"[:2000]}
            yield json.dumps(told, ensure_ascii=False)


def main(write: Callable[[str], object] = sys.stdout.write) -> None:
    from pyspark.sql import SparkSession

    for told in Tools(Service(SparkSession.builder.getOrCreate(), *sys.argv[1:2])).serve(sys.stdin):
        write(told + "\n")
        sys.stdout.flush()


if __name__ == "__main__":
    main()
