"""Settings files, policies over them, project stacks and the text of a finished goal."""

from __future__ import annotations

import json

import pytest

from loomline.functions.tokens import estimate_text
from loomline.operators import reports
from loomline.sources import settings

POLICY = {"schemaVersion": "1.0", "defaultGoal": "debug", "maxTokenBudget": 1000, "exclude": ["dist/**", "x"], "modelProfiles": [{"id": "a", "allowedProviders": ["p"]}], "activeProfile": "a"}


def test_settings_under_a_policy(tmp_path):
    own, policy = tmp_path / "own.json", tmp_path / "policy.json"
    assert settings.load_settings(str(own), str(policy)) == settings.DEFAULTS
    own.write_text(json.dumps({"exclude": ["dist/**"], "tokenBudget": {"warnAt": 5}, "other": 1}))
    policy.write_text(json.dumps(POLICY))
    got = settings.load_settings(str(own), str(policy))
    assert (got["defaultGoal"], got["privacyMode"], got["exclude"], got["other"]) == ("debug", "local-first", ["dist/**", "x"], 1)
    assert got["tokenBudget"] == {"defaultContextBudget": 1000, "maxFullWorkspaceScan": 1_000_000, "warnAt": 5}
    assert settings.active_profile(got["teamPolicy"])["allowedProviders"] == ["p"] and settings.active_profile(None) is None


@pytest.mark.parametrize("wrong", [[], None, {"defaultGoal": "x"}, {"privacyMode": 1}, {"exclude": [""]}, {"tokenBudget": 3}, {"tokenBudget": {"warnAt": 0}}, {"tokenBudget": {"warnAt": True}}])
def test_wrong_settings(wrong):
    with pytest.raises(ValueError):
        settings.parse_settings(wrong)


@pytest.mark.parametrize("wrong", [{"schemaVersion": "2"}, {"maxTokenBudget": 1.5}, {"activeProfile": "b"}, {"modelProfiles": [{"id": "a"}, {"id": "a"}]}, {"modelProfiles": [{"id": " "}]}, {"exclude": "x"}])
def test_wrong_policies(wrong):
    with pytest.raises(ValueError):
        settings.parse_policy(POLICY | wrong)


def test_project_stack(spark):
    def stack(*files):
        return settings.project_stack(spark.createDataFrame(list(files), "path string, text string")).first()

    web = stack(("package.json", '{"dependencies": {"react": "1"}, "devDependencies": {"jest": "2"}}'), ("tsconfig.json", ""), ("nx.json", ""), ("sub/Cargo.toml", ""))
    assert (web.primary_language, web.is_monorepo, web.frameworks, web.budget) == ("typescript", True, ["React", "Testing (Vitest/Jest)"], 200_000)
    assert web.excludes == [*settings.DEFAULTS["exclude"], "dist", "build", ".next", ".turbo", "coverage", "storybook-static"]
    rust = stack(("Cargo.toml", None), ("package.json", '{"dependencies": {"vue": "1"}}'))
    assert (rust.primary_language, rust.frameworks, rust.excludes[-1]) == ("rust", [], "target")
    assert stack(("package.json", "not json")).primary_language == "javascript" and stack().primary_language == "generic"


def test_finished_goal():
    text, tokens, saved = reports.finished_goal("debug", "fixed *it*", changed=["a|b.ts"], next_steps=["test"], source_tokens=1000)
    assert text == "# Completed Goal Context\n\n- **Goal:** `debug`\n- **Outcome:** fixed \\*it\\*\n\n## Changed Files\n\n- `a&#124;b.ts`\n\n## Next Steps\n\n- test"
    assert (tokens, saved) == (estimate_text(text), 1000 - estimate_text(text))
    assert reports.finished_goal("debug", "x")[2] is None and reports.finished_goal("debug", "x", source_tokens=1)[2] == 0
