"""A map's size without some files, from lines weighed once, against its Markdown made anew."""

from __future__ import annotations

import random

from loomline.operators import repo_map


def some_map(n: int, seed: int) -> tuple[repo_map.RepoMap, list[str]]:
    rng = random.Random(seed)
    files = []
    for i in range(n):
        lists = [x for x in (*repo_map.TAKEN, *repo_map.KEPT) if rng.random() < 0.25] or ["test"]
        files.append({"path": rng.choice(["src/é", "a b/`c", "x"]) + f"{i - i % 9 if i % 9 == 1 else i}.ts", "estimated_tokens": rng.randrange(99_999), "priority": rng.choice([40, 60, 90]), "reason": "Likely | entry", "map_language": rng.choice([None, "Type Script"]), "lists": lists})
    pick = lambda k: [rng.choice(files) for _ in range(k)]
    symbols = [{"path": f["path"], "name": "s", "kind": "class", "exported": True, "priority": 5} for f in pick(n // 3)]
    imports = [{"path": f["path"], "source": f"./m{i % 20}", "kind": "import", "resolved": "x" if i % 2 else None} for i, f in enumerate(pick(n))]
    routes = [{"path": f["path"], "route": "/r", "framework": "express", "reason": "GET /r"} for f in pick(n // 5)]
    order = list(dict.fromkeys(f["path"] for f in files if not set(f["lists"]) & set(repo_map.KEPT)))
    rng.shuffle(order)
    return repo_map.RepoMap("/r", "now", 1, ["a: 1", "b"], ["c"], 5, [("src", 1, 2)], [("TypeScript", 1, 2)], files, pick(30), pick(40), symbols, imports, routes, ["note"]), order


def test_sizes_without_files():
    for seed, n in enumerate((0, 1, 5, 30, 200)):
        made, order = some_map(max(n, 1), seed) if n else (some_map(1, 0)[0].without({f["path"] for f in some_map(1, 0)[0].files}), [])
        size = repo_map.Sizes(made, order)
        for gone in range(0, len(order) + 1, max(1, len(order) // 40)):
            assert size(gone) == repo_map.settled(made.without(set(order[:gone]))).estimated_tokens
        told = repo_map.settled(made)
        assert f"**Estimated Repo Map Tokens:** {told.estimated_tokens:,}" in repo_map.markdown(told)


def test_fitting_makes_few_texts(monkeypatch):
    """Of whole lists: one for each try would take hours for millions of files."""
    made, order = some_map(300, 7)
    lines, whole = [], repo_map.markdown
    monkeypatch.setattr(repo_map, "markdown", lambda *a: lines.append(whole(*a)) or lines[-1])
    repo_map.within_budget(repo_map.replace(made, budget=9000), order)
    assert sum(len(x) for x in lines) < 16 * len(whole(made))
