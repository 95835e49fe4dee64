"""Settings by which clients of the tool server find it, and what a build leaves behind."""

from __future__ import annotations

import json
import os

from loomline.apps.service import Service, now
from loomline.operators import repo_map
from loomline.sources.catalog import write_text

#: Clients.
CLIENTS = ("cursor", "continue", "claude-desktop", "generic")
ABOUT = "Local-first workspace analysis and AI model recommendations"


def client_config(client: str, workspace: str, command: list[str], name: str = "loomline") -> str:
    """A client's settings that start the tool server over a workspace."""
    if client not in CLIENTS:
        raise ValueError(f"unknown client: {client}")
    start = {"command": command[0], "args": [*command[1:], workspace]}
    if client == "continue":
        head = ["experimental:", "  modelContextProtocolServers:", "    - transport: stdio", f"      command: {json.dumps(start['command'])}", "      args:"]
        return "\n".join([*head, *[f"        - {json.dumps(a)}" for a in start["args"]], f"      description: {ABOUT}", ""])
    own = start | {"description": ABOUT} | ({"disabled": False, "autoApprove": []} if client == "claude-desktop" else {})
    return json.dumps({"mcpServers": {name: own}}, indent=2)


def build_artefacts(service: Service, root: str, folder: str, goal: str = "build-mvp", privacy: str = "cloud-ok") -> dict[str, str]:
    """Writes the report and the repository map of a build; their paths and the sums that a build step gives on."""
    os.makedirs(folder, exist_ok=True)
    report = service.report(root, goal, privacy, form="json")
    found, _, real = service.scan(root)
    made = repo_map.create(found, 64_000, real, now(), goal, found.select("path", "text"))
    paths = {"report": os.path.join(folder, "workspace-report.json"), "repo-map": os.path.join(folder, "repo-map.md")}
    write_text(report, paths["report"], force=True)
    write_text(repo_map.markdown(made), paths["repo-map"], force=True)
    summary = json.loads(report)["summary"]
    return paths | {"total-tokens": str(summary["totalEstimatedTokens"]), "included-files": str(summary["includedFiles"])}
