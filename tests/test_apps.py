"""The command line, the tool server, the store of reports and agent rules, over a small project of their own."""

from __future__ import annotations

import json
import threading
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from loomline.apps import cli, clients, http_store
from loomline.apps.service import Service, time_limit
from loomline.apps.tools import TOOLS, Tools
from loomline.operators import agent_rules, repo_map
from loomline.sources import catalog
from loomline.sources.files import read_folder, scan_folder

FILES = {
    "package.json": '{"name": "demo", "dependencies": {"react": "1", "vite": "2"}}', "tsconfig.json": "{}", "README.md": "# Demo\n\nA small project.\n", ".gitignore": "*.log\nprivate/\n", "src/index.ts": "import { a } from './util';\nexport class App {\n  run() { return a; }\n}\n",
    "src/util.ts": "export const a = 1, b = 2;\nfunction hidden() {}\n", "tests/index.test.ts": "import '../src/index';\n", "notes.log": "x\n", "private/x.ts": "export const no = 1;\n", ".env": "A=1\n", "src/[id].ts": "export type Id = string;\n", "dist/out.min.js": "var a=1\n",
    "Zeta.md": "z\n", "alpha.md": "a\n", **{f"tests/part{i}.test.ts": f"test({i});\n" for i in range(25)},
}
MODELS = {"version": "2.0", "updatedAt": "2026-01-05", "models": [
    {"id": f"m{i}", "displayName": f"Model {i}", "provider": "P" if i < 3 else "Q", "contextWindow": 100_000 * (i + 1), "maxOutputTokens": 8000, "inputPricePerMillion": i * 1.0, "outputPricePerMillion": i * 2.0, "cachedInputPricePerMillion": None,
     "supportsTools": True, "supportsImages": False, "supportsLocal": i == 0, "privacyMode": "local" if i == 0 else "cloud", "codingScore": 50 + 10 * i, "reasoningScore": None, "latencyScore": 70, "updatedAt": "2026-01-05"} for i in range(5)]}


@pytest.fixture
def project(tmp_path):
    for path, text in FILES.items():
        place = tmp_path / "demo" / path
        place.parent.mkdir(parents=True, exist_ok=True)
        place.write_text(text)
    (tmp_path / "demo" / "catalogs").mkdir()
    (tmp_path / "demo" / "catalogs" / "models.json").write_text(json.dumps(MODELS))
    return tmp_path / "demo"


def test_read_folder_reads_what_it_lists(spark, project):
    raw, warnings = read_folder(spark, str(project))
    got = {r.path: r for r in raw.collect()}
    assert "private/x.ts" not in got and got["notes.log"]._ignored == "matches ignore pattern" and got["notes.log"].text is None
    assert got["src/[id].ts"].text == FILES["src/[id].ts"] and got["README.md"].bytes == len(FILES["README.md"]) and warnings.isEmpty()
    order = [r.path for r in sorted(got.values(), key=lambda r: r.ord)]
    assert order.index("alpha.md") < order.index("README.md") < order.index("Zeta.md")  # not by code point
    assert read_folder(spark, str(project / "catalogs"), exclude=["*"])[0].where("text is not null").count() == 0


def test_scan_folder_with_cache(spark, project):
    first, _ = scan_folder(spark, str(project), cache=".cache")
    assert first.where("cache_hit").count() == 0
    second, _ = scan_folder(spark, str(project), exclude=[".cache"], cache=".cache")
    assert second.where("cache_hit").count() >= len(FILES) - 1
    got = {r.path: r for r in second.collect()}
    assert got[".env"].excluded_reason == "potential secret file" and got["src/util.ts"].included and got["dist/out.min.js"].excluded_reason == "generated"


def test_cache_outlives_a_cut_save(spark, tmp_path):
    scan = spark.createDataFrame([("a", 1, 5, ["x"])], "path string, bytes long, estimated_tokens long, risk_flags array<string>").withColumn("mtime", F.timestamp_seconds(F.lit(1)))
    catalog.save_cache(scan, f"file://{tmp_path}/c")
    place = tmp_path / "c" / "version=3"
    (place / "tokenizer=heuristic-v1").rename(place / "tokenizer=heuristic-v1.old")
    assert catalog.load_cache(spark, f"file://{tmp_path}/c").count() == 1
    catalog.save_cache(scan, f"file://{tmp_path}/c")
    assert catalog.load_cache(spark, f"file://{tmp_path}/c").count() == 1 and not (place / "tokenizer=heuristic-v1.old").exists()


def test_catalogue_defaults():
    assert catalog.parse_catalogue([{"id": "a"}])["version"] == "1.0" and len(catalog.parse_catalogue([{}])["updatedAt"]) == 10
    assert catalog.parse_catalogue(MODELS)["version"] == "2.0" and catalog.parse_catalogue({"models": 3})["models"] == catalog.parse_catalogue(None)["models"] == []


def test_repo_map_and_budget(spark, project):
    service = Service(spark, str(project))
    made = service.repo_map(goal="debug")
    text = repo_map.markdown(made)
    assert [f["path"] for f in made.of("entry")] == ["src/index.ts"] and made.notes == []
    assert {s["name"] for s in made.symbols} == {"App", "App.run", "a", "b", "hidden", "Id"}
    assert {(i["path"], i["resolved"]) for i in made.imports} == {("src/index.ts", "src/util.ts"), ("tests/index.test.ts", "src/index.ts")}
    assert "| `src/index.ts` | Likely entry point |" in text and "## Key Symbols" in text and "- `.env`" not in text.split("## Risk")[1].split("##")[0]
    assert made.estimated_tokens > 300 and f"- **Estimated Repo Map Tokens:** {made.estimated_tokens:,}" in text
    small = service.repo_map(goal="debug", budget=made.estimated_tokens - 200)
    assert small.estimated_tokens <= small.budget + 60 and small.notes[0].startswith("Budget of ") and "preserved" in small.notes[1]
    assert {f["path"] for f in small.of("entry")} == {"src/index.ts"} and len(small.files) < len(made.files)
    least = service.repo_map(goal="debug", budget=50)
    assert "cannot fit" in least.notes[-1] and {n for f in least.files for n in f["lists"]} <= {"entry", "config", "docs", "important"}
    for budget in (0, -1, float("nan"), float("inf")):
        with pytest.raises(ValueError):
            service.repo_map(budget=budget)
    plain = service.repo_map(with_symbols=False)
    assert plain.symbols == [] and plain.compact()["symbolCount"] == 0 and made.compact()["entryPointCount"] == 1


def test_budget_takes_the_fewest(spark, project):
    """Against a loop that takes one file after another."""
    found, _, _ = Service(spark, str(project)).scan()
    made = repo_map.create(found, 100_000, files=found.select("path", "text"))
    order = [r.path for r in repo_map.trim_order(repo_map.entries(found)).orderBy("n", "ord").collect()]
    for budget in range(made.estimated_tokens - 5, made.estimated_tokens - 400, -23):
        noted = repo_map.replace(made, budget=budget, notes=[f"Budget of {budget:,} tokens exceeded; lower-priority sections were trimmed."])
        gone, now = 0, made
        while now.estimated_tokens > budget and gone < len(order):
            gone += 1
            now = repo_map.settled(noted.without(set(order[:gone])))
        got = repo_map.within_budget(repo_map.replace(made, budget=budget), order)
        assert len(made.files) - len(got.files) == gone


def test_paths_stay_in_the_root(spark, project, tmp_path, monkeypatch):
    service = Service(spark, str(project))
    (tmp_path / "other.json").write_text("[]")
    for bad in ("..", "/", "nowhere"):
        with pytest.raises(ValueError, match="disallowed"):
            service.inside(bad)
    with pytest.raises(ValueError, match="outside"):
        service.catalogue_path(str(tmp_path / "other.json"))
    monkeypatch.setenv("LOOMLINE_CATALOG_PATH", "catalogs/models.json")
    assert service.catalogue_path().endswith("demo/catalogs/models.json")
    monkeypatch.delenv("LOOMLINE_CATALOG_PATH")
    assert service.catalogue_path() == str(project / "catalogs" / "models.json")
    with pytest.raises(ValueError, match="outside the root"):
        service.estimate_files(["src/util.ts", "../x"])
    told = service.estimate_files(["src/util.ts", "src/none.ts", "src/../README.md"], budget=100, model="m1")
    assert [f["exists"] for f in told["files"]] == [True, False, False] and told["files"][1]["error"] == "file not found" and told["targetModel"]["fits"]
    assert told["budget"] == {"contextBudget": 100, "fits": True, "utilizationPercent": told["totalTokens"]}


def test_time_limit(spark):
    with pytest.raises(TimeoutError), time_limit(spark, 0.5):
        spark.range(1 << 40).selectExpr("sum(id % 7)").collect()
    with time_limit(spark, 60):
        assert spark.range(5).count() == 5
    assert spark.range(5).count() == 5


def test_tools(spark, project):
    server = Tools(Service(spark, str(project)))
    ask = lambda *asked: [json.loads(x) for x in server.serve(json.dumps({"jsonrpc": "2.0", "id": i, "method": m, "params": p}) for i, (m, p) in enumerate(asked))]
    call = lambda name, **a: ("tools/call", {"name": name, "arguments": a})
    first = ask(("initialize", {}), ("tools/list", {}), ("resources/list", {}), ("resources/read", {"uri": "workspace://summary"}), ("prompts/list", {}), ("nothing", {}))
    assert [t["name"] for t in first[1]["result"]["tools"]] == list(TOOLS) and "nothing yet" in first[3]["result"]["contents"][0]["text"] and first[5]["error"]["code"] == -32601
    told = ask(
        call("scan_workspace", goal="debug"), call("recommend_models", privacyMode="cloud-ok"), call("create_repo_map", format="json"), call("generate_agent_rules", target="cursor", mode="concise"), call("generate_report"),
        call("validate_model_catalog"), call("compact_completed_goal", goal="debug", summary="Done."), call("estimate_files_tokens", filePaths=["README.md"]), call("nope"), call("scan_workspace", goal="bad"), call("estimate_files_tokens"),
    )
    said = [t["result"]["content"][0]["text"] for t in told]
    assert [t["result"].get("isError", False) for t in told] == [False] * 8 + [True] * 3
    summary = json.loads(said[0])
    assert summary["goal"] == "debug" and summary["topFiles"] and sum(x["percentage"] for x in summary["languages"]) == pytest.approx(1, abs=1e-3)
    rec = json.loads(said[1])
    assert len({rec[t]["modelId"] for t in ("cheapestSufficient", "balanced", "highConfidence")}) == 3 and rec["balanced"]["cost"].startswith("$")
    assert said[3].startswith("# cursor Agent Rules") and said[4].startswith("# Workspace Model Report") and json.loads(said[5])["valid"] and json.loads(said[7])["totalTokens"] > 0
    after = ask(("resources/read", {"uri": "workspace://summary"}), ("resources/read", {"uri": "model-catalog://models"}), ("prompts/get", {"name": "optimize_coding_agent_for_workspace", "arguments": {"goal": "debug", "tokenBudget": "5000"}}), ("prompts/get", {"name": "optimize_coding_agent_for_workspace", "arguments": {"goal": "x"}}))
    assert json.loads(after[0]["result"]["contents"][0]["text"]) == json.loads(said[1]) or json.loads(after[0]["result"]["contents"][0]["text"])["rootPath"] == str(project)
    assert json.loads(after[1]["result"]["contents"][0]["text"])["providers"] == ["P", "Q"] and "~5,000 tokens" in after[2]["result"]["messages"][0]["content"]["text"] and after[3]["error"]["code"] == -32602
    assert [json.loads(x) for x in server.serve(["{", '{"method": "x"}', ""])][0]["error"]["code"] == -32700


def test_no_model_is_an_error(spark, project):
    service = Service(spark, str(project))
    with pytest.raises(ValueError, match="no models are eligible"):
        (project / "catalogs" / "models.json").write_text(json.dumps(MODELS["models"][1:]))
        service.recommend(1000, privacy="local-first")
    (project / "catalogs" / "models.json").write_text(json.dumps(MODELS["models"][1:2]))
    told = service.recommend(10**9, privacy="cloud-ok")
    assert told["rejected"] == ["m1"] and told["assumptions"][-1].startswith("No model fits") and "limited fitting" in told["balanced"]["reasons"][-1] and "limited" not in str(told["cheapestSufficient"]["reasons"])


def test_command_line(spark, project, capsys, monkeypatch):
    def say(*argv):
        code = cli.main([str(x) for x in argv], spark)
        out = capsys.readouterr()
        return code, out.out, out.err

    code, out, _ = say("init", project, "--dry-run")
    assert code == 0 and "[DRY RUN] Inferred configuration for typescript project (Single Package)" in out and not (project / cli.CONFIG).exists()
    assert say("init", project)[0] == 0 and json.loads((project / cli.CONFIG).read_text())["tokenBudget"]["warnAt"] == 102_400
    assert say("init", project)[0] == 1 and say("init", project, "--force", "--goal", "debug")[0] == 0 and (project / (cli.CONFIG + ".bak")).exists()
    code, out, _ = say("scan", project)
    assert code == 0 and "Top 10 Token-Heavy Files:" in out and "Risk Files:" in out and "  - .env [secret]" in out
    assert json.loads(say("scan", project, "--format", "json")[1])["included_files"] >= 8 and "| Metric | Value |" in say("scan", project, "--format", "markdown")[1]
    assert "--- Balanced ---" in say("recommend", project, "--privacy", "cloud-ok")[1]
    assert say("repo-map", project, "--output", project / "map.md")[0] == 0 and (project / "map.md").read_text().startswith("# Repo Map")
    assert say("repo-map", project, "--output", project / "map.md")[0] == 1
    assert json.loads(say("repo-map", project, "--format", "json", "--no-symbols")[1])["symbols"] == []
    assert "Written: .cursorrules" in say("rules", project, "--target", "cursor")[1] and say("rules", project, "--target", "cursor")[0] == 1
    assert say("rules", project, "--target", "all", "--yes")[0] == 0 and (project / ".github" / "copilot-instructions.md").exists()
    assert json.loads(say("report", project, "--format", "json", "--privacy", "cloud-ok")[1])["schemaVersion"] == "1.0.0"
    assert "Completed Goal" in say("compact", "--goal", "debug", "--summary", "Fixed.")[1]
    assert json.loads(say("catalog", "validate", project / "catalogs" / "models.json")[1])["modelCount"] == 5
    assert json.loads(say("mcp-config", "--target", "cursor", "--workspace", project)[1])["mcpServers"]["loomline"]["args"][-1] == str(project)
    with pytest.raises(SystemExit):
        say("repo-map", project, "--budget", "0")


def test_build_artefacts(spark, project, tmp_path):
    told = clients.build_artefacts(Service(spark, str(project)), ".", str(tmp_path / "out"))
    assert json.loads(open(told["report"]).read())["summary"]["includedFiles"] == int(told["included-files"]) and open(told["repo-map"]).read().startswith("# Repo Map")
    assert "transport: stdio" in clients.client_config("continue", "/w", ["python", "-m", "x"])
    with pytest.raises(ValueError):
        clients.client_config("other", "/w", ["x"])


@pytest.mark.parametrize("mode", list(agent_rules.BEHAVIOUR))
def test_agent_rules(mode):
    for target, name in agent_rules.FILES.items():
        made = agent_rules.generate(target, mode, 12345, ["A", "B"])
        assert made.file_name == name and "12,345" in made.content and made.token_budget == {"concise": 16000, "patch-only": 32000, "caveman": 8000}.get(mode, 64000)
        assert all(f"`{p}`" in made.content for p in made.avoid_files)
    assert set(agent_rules.generate_all(mode=mode)) == {"cursor", "claude", "generic", "windsurf", "copilot", "gemini"}
    with pytest.raises(ValueError):
        agent_rules.generate("other", mode)


def test_http_store(tmp_path):
    report = {"schemaVersion": "1.0.0", "title": "t", "generatedAt": "2026-01-01T00:00:00Z", "workspacePath": "/w", "goal": None, "recommendations": None, "summary": dict.fromkeys(("totalFiles", "includedFiles", "excludedFiles", "totalEstimatedTokens", "includedTokens"), 1)} | {k: [] for k in ("topTokenConsumers", "topFolders", "languages", "warnings", "assumptions", "optimizationChecklist")}
    with http_store.server(str(tmp_path), "secret") as http:
        threading.Thread(target=http.serve_forever, daemon=True).start()
        base = f"http://127.0.0.1:{http.server_port}"

        def ask(method, path, body=None, **headers):
            asked = urllib.request.Request(base + path, None if body is None else body if isinstance(body, bytes) else json.dumps(body).encode(), {k.replace("_", "-"): v for k, v in headers.items()}, method=method)
            try:
                with urllib.request.urlopen(asked) as told:
                    return told.status, json.loads(told.read()), told.headers
            except urllib.error.HTTPError as error:
                return error.code, json.loads(error.read()), error.headers

        bearer = {"Authorization": "Bearer secret"}
        assert ask("GET", "/api/reports")[0] == 401 and ask("POST", "/api/reports", report)[0] == 401
        status, told, _ = ask("POST", "/api/reports", report, **bearer)
        assert status == 201 and ask("GET", f"/api/reports/{told['id']}", **bearer)[1] == report and ask("GET", "/api/reports/none", **bearer)[0] == 404
        assert ask("POST", "/api/reports", b"{", **bearer)[0] == 400 and ask("POST", "/api/reports", {}, **bearer)[0] == 400 and ask("POST", "/api/reports", b"x" * 1_000_001, **bearer)[0] == 413
        assert ask("POST", "/api/session", {"token": "no"})[0] == 401 and ask("GET", "/x")[0] == 404
        cookie = ask("POST", "/api/session", {"token": "secret"})[2]["Set-Cookie"]
        assert "HttpOnly; SameSite=Strict" in cookie
        session = {"Cookie": cookie.split(";")[0]}
        assert [r["id"] for r in ask("GET", "/api/reports", **session)[1]] == [told["id"]] and ask("POST", "/api/reports", report, **session)[0] == 401
        assert ask("DELETE", "/api/session", **session)[0] == 200 and ask("GET", "/api/reports", **session)[0] == 401
        http.shutdown()
    with http_store.server(str(tmp_path), None) as http:
        threading.Thread(target=http.serve_forever, daemon=True).start()
        base = f"http://127.0.0.1:{http.server_port}"
        assert ask("POST", "/api/session", {"token": "x"})[0] == 503 and ask("GET", "/api/reports")[0] == 503
        http.shutdown()


def test_sessions_are_pruned(monkeypatch):
    own = http_store.Sessions()
    monkeypatch.setattr(http_store, "MOST_SESSIONS", 3)
    names = [own.open() for _ in range(5)]
    assert [own.has(n) for n in names] == [False, False, True, True, True] and not own.has(None)
    monkeypatch.setattr(http_store.time, "time", lambda: 1e12)
    assert not own.has(names[-1]) and len(own.until) == 3 and own.open() and len(own.until) == 1
