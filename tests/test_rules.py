"""Each rule on small hand-made projects, plus the edges of the line model."""

from __future__ import annotations

import json

import pytest

from auditlake.operators import rules
from auditlake.operators.lines import file_lines
from auditlake.plans.scan import builtin_scan

KEY = "sk-" + "ab12" * 12


def scan(files, **kw):
    rows = rules.scan(files, **kw).collect()
    return sorted((r.rule_id, r.file, r.line) for r in rows)


def ids(found):
    return {f[0] for f in found}


@pytest.mark.parametrize(
    "path, text, expected",
    [
        ("src/config.ts", f"const key = '{KEY}';", {"SEC-001"}),
        ("src/config.ts", "const key = 'your_api_key_here';", set()),
        (".env.sample", f"OPENAI={KEY}", {"SEC-002"}),
        ("src/a.js", f"// const key = '{KEY}';", set()),
        ("src/a.js", f"  * key '{KEY}'", set()),
        ("src/u.js", "const r = eval(userInput);", {"SEC-003"}),
        ("src/u.js", "// Don't use eval()", set()),
        ("src/u.js", "retrieval(1); myexec (x)", set()),
        ("src/u.py", "éval(1); xéeval (2)", set()),
        ("src/db.ts", "db.query(`SELECT * FROM u WHERE id = ${id}`);", {"SEC-004"}),
        ("src/db.py", 'cur.execute("select 1 where a = %s" % x)', {"SEC-004"}),
        ("src/db.py", "q = f'select {x}'", {"SEC-004"}),
        ("src/db.py", "# SELECT a + b", {"SEC-004"}),
        ("src/s.js", "res.setHeader('Access-Control-Allow-Origin', '*');", {"SEC-006"}),
        ("src/s.js", "h = {'Access-Control-Allow-Origin': 'https://a.invalid'}", {"SEC-006"}),
        ("src/s.js", 'get("http://shop.invalid/v1/items")', {"SEC-007"}),
        ("src/s.js", 'get("http://localhost:3000/v1/items")', set()),
        ("src/s.js", 'get("http://x.y")', set()),
        ("src/s.js", 'get("http://localhost:1", "http://shop.invalid/v1")', {"SEC-007"}),
        ("src/a.ts", "localStorage.setItem('auth_token', t);", {"SEC-009"}),
        ("src/d.js", "console.log('k', process.env.KEY);", {"SEC-010"}),
        ("src/d.js", "Console.log('k', process.env.KEY);", set()),
        ("src/d.js", "x = 'SERVICE_ROLE'", {"SEC-011"}),
        ("lib/d.js", "x = 'SERVICE_ROLE'", set()),
        ("myapp/d.js", "x = 'service_role'", {"SEC-011"}),
        ("src/r.js", "app.get('/api/users', (req, res) => {});", {"SEC-005"}),
        ("src/r.js", "app.get('/api/users', requireAuth, h);", set()),
        ("src/r.js", "// guard\nrouter.post('/payment/new', h);", set()),
        ("src/r.js", "router.post('/payment/new', h);\n\n// guard", {"SEC-005"}),
        ("src/r.tsx", "app.get('/api/users', h);", set()),
        ("src/m.py", "@app.get('/api/users')\ndef f():\n    return []", {"SEC-005"}),
        ("src/m.py", "@app.get('/api/users')\ndef f(u=Depends(x)):\n    return []", set()),
        ("src/m.py", "@app.get('/api/u')\n1\n2\n3\n4\nDepends", set()),
        ("src/m.py", "@app.get('/api/u')\n1\n2\n3\n4\n5\nDepends", {"SEC-005"}),
        ("src/r.js", "app.get('/admin/settings', h);", {"SEC-005", "SEC-008"}),
        ("src/r.js", "app.get('/admin/settings', requireAdmin, h);", {"SEC-005"}),
        ("src/r.js", "app.post('/x/internal/job', run); // 'auth'", {"SEC-008"}),
        ("src/r.js", "x = 'auth\napp.post('/x/internal/job', run);", {"SEC-008"}),
        ("src/ok.ts", "const k = process.env.OPENAI_API_KEY;\nexport { k };\n", set()),
        ("readme.md", f"const key = '{KEY}';", set()),
        ("build/a.js", f"const key = '{KEY}';", set()),
        ("src/build", f"const key = '{KEY}';", set()),
        ("yarn.lock", f"key = '{KEY}';", set()),
    ],
)
def test_single_file(make_files, path, text, expected):
    assert ids(scan(make_files({path: text}))) == expected


def test_match_over_a_line_break_counts_on_its_first_line(make_files):
    text = "x\npassword\n\n =\n 'Hunter2Hunter2'\npassword = 'Hunter3Hunter3'\n"
    found = scan(make_files({"src/a.py": text}), rules=rules.SECRET_RULES)
    assert found == [("SEC-001", "src/a.py", 2), ("SEC-001", "src/a.py", 6)]


def test_broken_match_in_a_comment_line_is_dropped(make_files):
    text = "# api_key =\n'abcdefgh12345678'\napi_key =\n'abcdefgh12345678'"
    assert scan(make_files({"src/a.py": text})) == [("SEC-001", "src/a.py", 3)]


def test_several_matches_on_one_line(make_files):
    text = f"a = '{KEY}'; b = '{KEY}'; c = 'AKIA{'Z9' * 8}'"
    rows = rules.scan(make_files({"src/a.py": text})).collect()
    assert sorted((r.sub_seq, r.match_start) for r in rows) == [(2, 0), (11, 0), (11, 1)]


def test_line_breaks(make_files, spark):
    text = "a\r\nb\rc\x0cd e\x85f\n\n"
    lines = {r.line: r.text for r in file_lines(make_files({"a.py": text})).collect()}
    assert lines == {1: "a", 2: "b", 3: "c", 4: "d", 5: "e", 6: "f", 7: ""}
    assert file_lines(make_files({"a.py": "", "b.py": "\n"})).count() == 1
    found = scan(make_files({"a.py": "x\reval(1) eval(2)\r\neval(3)"}))
    assert [f[2] for f in found] == [2, 3, 4]


def test_snippet_is_stripped_and_cut(make_files):
    text = " \t eval(" + "x" * 100 + ") "
    (row,) = rules.scan(make_files({"a.py": text})).collect()
    assert row.snippet == "eval(" + "x" * 75


@pytest.mark.parametrize(
    "ignore, flagged",
    [(None, True), (".env\n", False), ("# .env\n", True), (" .env* \n", False),
     (".env.local\n", False), ("*.env\n", True)],
)
def test_env_file_and_gitignore(make_files, ignore, flagged):
    tree = {"cfg/.env.local": "A=1"}
    if ignore is not None:
        tree[".gitignore"] = ignore
    assert (scan(make_files(tree)) == [("SEC-002", "cfg/.env.local", 1)]) is flagged


def test_env_example_and_json_env_are_clean(make_files):
    assert scan(make_files({".env.example": "A=1", ".env.json": "{}"})) == []


def test_gitignore_of_another_project_does_not_count(make_files):
    files = make_files({".env": "A=1"}, "p1").unionByName(make_files({".gitignore": ".env"}, "p2"))
    assert scan(files) == [("SEC-002", ".env", 1)]


def package(**sections):
    return json.dumps(sections)


def test_internal_names(make_files):
    text = package(
        dependencies={"express": "^4", "my-internal-utils": "^1", "x-core-y": "workspace:*"},
        devDependencies={"my-internal-utils": "^2", "@acme/ui-internal": "1"},
        peerDependencies={"a-private": {"v": 1}},
    )
    rows = rules.scan(
        make_files({"sub/package.json": text, ".npmrc": ""}), rules=rules.rules_of("SEC-012")
    ).collect()
    assert [(r.line, r.snippet) for r in sorted(rows, key=lambda r: r.match_start)] == [
        (0, "my-internal-utils: ^2"), (0, 'a-private: {"v":1}')]


def test_scoped_names_without_registry(make_files):
    deps = {f"@acme{i}/x": "1" for i in range(7)} | {"@types/node": "1", "@w/y": "workspace:^"}
    (row,) = rules.scan(make_files({"package.json": package(dependencies=deps)})).collect()
    assert row.message.startswith("Scoped packages found (7)")
    assert row.snippet == ", ".join(f"@acme{i}/x" for i in range(5))
    with_registry = make_files({"package.json": package(dependencies=deps), ".npmrc": "r"})
    assert scan(with_registry) == []


def test_odd_package_files_give_error_rows_not_failures(make_files):
    files = make_files({
        "a/package.json": '{"dependencies": null}', "b/package.json": "[1]",
        "c/package.json": "not json", "d/package.json": '{"devDependencies": ["x-internal"]}',
        "e/package.json": '{"dependencies": {"x-internal": "1"}}',
    })
    assert scan(files) == [("SEC-012", "e/package.json", 0)]
    errors = {r.file: r.error for r in rules.dependency_errors(files).collect()}
    assert set(errors) == {"a/package.json", "b/package.json", "d/package.json"}


def test_golden_order(make_files):
    """Five findings at known lines, in report order."""
    text = "\n".join([
        "// demo", "", "// keys",
        'const API_KEY = "sk-live-' + "abc123def456" * 2 + '";',
        'const DB_PASSWORD = "Sup3rS3cret!";',
        'const JWT_SECRET = "mysupersecretjwtkey";', "", "// run", "function run(x) {",
        "  return eval(x);", "}", "", "// sql", "function user(id) {",
        "  const query = `SELECT * FROM users WHERE id = ${id}`;", "  return db.get(query);",
        "}", "", "function search(term) {",
        "  const sql = \"SELECT * FROM products WHERE name = '\" + term + \"'\";",
        "  node.innerHTML = term;", "}",
    ])
    rows = builtin_scan(make_files({"demo.js": text})).collect()
    assert [(r.rule_id, r.line) for r in rows] == [
        ("SEC-001", 4), ("SEC-001", 5), ("SEC-003", 10), ("SEC-004", 15), ("SEC-004", 20)]


def test_all_rules_equal_the_single_rules(make_files):
    tree = {
        "src/a.js": f"k = '{KEY}'\neval(x)\napp.get('/admin/x', h)\nfetch('http://a.invalid/bcdef')",
        ".env": "A=1", "package.json": package(dependencies={"x-internal": "1", "@q/z": "2"}),
    }
    files = make_files(tree)
    single = [r for rule in dict.fromkeys(r.rule_id for r in rules.ALL_RULES)
              for r in scan(files, rules=rules.rules_of(rule))]
    assert scan(files) == sorted(single)


def test_custom_rule(make_files):
    rule = rules.pattern_rule("MY-1", r"tok_[0-9]{6}", "Own token", severity="MEDIUM")
    rows = rules.scan(make_files({"a.py": "x = tok_123456, tok_654321"}), rules=[rule]).collect()
    assert [(r.rule_id, r.message, r.severity) for r in rows] == [
        ("MY-1", "Own token detected", "MEDIUM")] * 2


def test_root_takes_part_in_client_folders(make_files):
    files = make_files({"x.js": "service_role"}, root="/home/app/web")
    assert scan(files) == [("SEC-011", "x.js", 1)]
