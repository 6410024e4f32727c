import json

import pytest

from packwright.__main__ import main
from packwright.plans.service import Service, index_tree


@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, text in {
        "auth/login.py": "from db.users import load_user\n\ndef check_login(name):\n    return load_user(name)\n",
        "db/users.py": "def load_user(name):\n    return name\n",
        "db/keys.py": "password = 'hunter2222'\n\ndef key():\n    return load_user('x')\n",
        "README.md": "# Users\nHow to load a user.\n",
    }.items():
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_text(text)
    folder = f"file://{tmp_path_factory.mktemp('index')}"
    assert index_tree(spark, f"file://{root}", folder) and not index_tree(spark, f"file://{root}", folder)
    return f"file://{root}", folder


def test_tools(spark, tree):
    s = Service(spark, *tree)
    found = s.call("search_codebase", {"query": "where is load_user defined", "limit": 3})
    assert found["results"][0]["path"] == "db/users.py" and found["index_health"] == {"status": "current", "files_indexed": 4, "changes": {}}
    assert s.call("find_callers", {"name": "load_user"}) == {"callers": ["auth/login.py", "db/keys.py"]}
    assert s.call("graph_search", {"path": "db/users.py"}) == {"symbols": [{"name": "load_user", "kind": "function"}]}
    assert s.call("call_chain", {"start": "check_login", "goal": "load_user"}) == {"chain": ["check_login", "load_user"]}
    held = s.call("get_file_context", {"path": "db/keys.py"})
    assert held["content"] is None and held["secrets_detected"] == ["password"] and held["dependencies"] == ["db/users.py"]
    assert "auth" in {d["keyword"] for d in s.call("get_domain_map")["domains"]} and s.call("get_status")["indexed"]
    pack = s.call("pack_context", {"query": "load user", "format": "md", "session": "a"})
    assert pack["files"] == 4 and "hunter2222" not in pack["pack"] and "def load_user" in pack["pack"]
    assert "def load_user" not in s.call("pack_context", {"query": "load user", "format": "md", "session": "a"})["pack"]
    assert s.call("session_clear") == {"cleared": 1}


def test_errors_limits_and_cache(spark, tree, tmp_path):
    now = [0.0]
    s = Service(spark, *tree, per_minute=2, clock=lambda: now[0])
    code = lambda name, **a: s.call(name, a).get("error")
    assert code("nothing") == "TOOL_NOT_FOUND" and code("search_codebase", query=" ") == "INVALID_ARGUMENT" and code("search_codebase", query="x", limit=51) == "INVALID_ARGUMENT"
    assert code("search_codebase", query="x") == "RATE_LIMIT_EXCEEDED"
    assert code("get_file_context", path="../x") == "INVALID_ARGUMENT" and code("pack_context", query="x", format="pdf") == "INVALID_ARGUMENT"
    first = s.call("get_status")
    assert s.call("get_status") is first
    now[0] = 31.0
    assert s.call("get_status") is not first
    assert Service(spark, tree[0], f"file://{tmp_path}").call("get_index_status")["error"] == "INDEX_NOT_FOUND"


def test_command_line(spark, tree, capsys):
    assert main(["callers", tree[0], "load_user", "--index", tree[1]]) == 0
    assert "auth/login.py" in json.loads(capsys.readouterr().out)["callers"]
    assert main(["search", tree[0], "", "--index", tree[1]]) == 1 and json.loads(capsys.readouterr().out)["error"] == "INVALID_ARGUMENT"
