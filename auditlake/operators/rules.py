"""Detection rules over file texts: one narrow pass from files to findings.

Plan shape: eligible files -> array of candidate units (lines that match a
cheap combined trigger, plus one unit per env file and per package.json) ->
explode units -> array of hits -> explode hits -> look up rule texts. The file
content is read once and nothing is shuffled; only the finished hits meet the
per-project side table (root ``.gitignore`` / ``.npmrc``).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake import catalog
from auditlake.functions import text as tx
from auditlake.functions.scale import SALT_BUCKETS
from auditlake.functions.sql import all_of, any_of, array, has_any, matches, quote, strings
from auditlake.operators.selection import eligible_files
from auditlake.schemas import FINDING_COLUMNS

LINE, ENV_FILE, PACKAGE = 0, 1, 2
_NO_HITS = "cast(array() AS array<struct<rule:int,pos:bigint,message:string,snippet:string>>)"


@dataclass(frozen=True)
class Trigger:
    """Cheap test that every line a rule flags passes.

    ``words``: lower-case texts of which the line holds at least one; ``needs``:
    a text that must be on the line too. ``sql`` builds any other condition
    from the names of the line and of its lower-case form.
    """

    words: tuple[str, ...] = ()
    needs: str = ""
    sql: Callable[[str, str], str] | None = None

    def guarded_words(self) -> list[tuple[str, str]]:
        """(guard, word): a rarer mark that is tested before the word."""
        pairs = []
        for word in self.words:
            marks = [m for m in ("_", "-", "://") if m in word]
            pairs.append((self.needs or (marks[0] if marks else ""), word))
        return pairs


@dataclass(frozen=True)
class Rule:
    """One catalogue entry.

    ``trigger`` is a cheap test that every flagged line passes. ``test`` is the
    SQL condition of a line rule over the unit columns (text, around, ahead,
    suffix, root, path). ``pattern`` marks match rules: one finding per match,
    comment lines and placeholder values dropped.
    """

    rule_id: str
    seq: int
    sub: int
    severity: str
    message: str
    fix: str
    trigger: Trigger | None = None
    test: str | None = None
    pattern: str | None = None


def any_word(*words: str) -> Trigger:
    """Trigger: the line holds one of these lower-case words."""
    return Trigger(words)


def pattern_rule(
    rule_id: str,
    pattern: str,
    label: str,
    severity: str = "CRITICAL",
    fix: str = catalog.RULE_TEXTS["SEC-001"][2],
    trigger: Trigger | None = None,
    seq: int = 13,
    sub: int = 1,
) -> Rule:
    """A user rule that behaves like the built-in secret patterns."""
    return Rule(
        rule_id, seq, sub, severity, f"{label} detected", fix,
        trigger or Trigger(sql=lambda text, low: matches(text, pattern)), pattern=pattern,
    )


# ------------------------------------------------------------- rule catalogue
# Lower-case words of which a flagged line holds at least one; plain substring
# tests cost a fraction of one big alternation.
_SECRET_WORDS = [
    ["api_key", "api-key", "apikey", "api_secret", "api-secret", "apisecret"],
    ["akia"], ["aws"], ["eyj"], ["-----begin"], ["ghp_"], ["github_pat_"],
    ["sk_live_"], ["rk_live_"], ["sg."], ["sk-"], ["sk-"],
    ["passw", "pwd"],
]
_SQL_VERBS = ["select", "insert", "update", "delete", "drop", "truncate"]


def _sql_trigger(text: str, low: str) -> str:
    return any_of(
        all_of(has_any(low, ["+", "{"]), has_any(low, _SQL_VERBS)), has_any(low, ["execute("])
    )


def _begins(*marks: str) -> str:
    """The line's first visible characters are one of the (escaped) marks."""
    return matches("text", f"^{tx.SPACE}*(?:{'|'.join(marks)})")


_ROUTE_FILE = f"suffix IN ({strings(catalog.ROUTE_SUFFIXES)})"
_ROUTE_METHOD = r"(?i)(?:app|router)\.(?:get|post|put|delete|patch)"
_UNQUOTED = f"regexp_replace(around, {quote(catalog.QUOTED_RUN)}, '')"
# the project root is part of the path these folders are looked up in
_FULL_PATH = "concat_ws('/', nullif(root, ''), path)"

_TESTS = {
    "SEC-003": all_of(matches("text", catalog.EVAL_CALL), f"NOT {_begins('//', '#')}"),
    "SEC-004": matches("text", catalog.SQL_TEXT),
    "SEC-005/express": all_of(
        _ROUTE_FILE, matches("text", catalog.EXPRESS_ROUTE), f"NOT {_begins('@')}",
        f"NOT {matches('around', catalog.EXPRESS_AUTH)}",
    ),
    "SEC-005/decorator": all_of(
        _ROUTE_FILE, matches("text", catalog.DECORATOR_ROUTE),
        f"NOT {matches('ahead', catalog.DECORATOR_AUTH)}",
    ),
    "SEC-006": matches("text", catalog.CORS_HEADER),
    "SEC-007": all_of(matches("text", catalog.PLAIN_HTTP), matches("text", catalog.LONG_URL)),
    "SEC-008": all_of(
        _ROUTE_FILE, matches("text", catalog.ADMIN_ROUTE),
        f"NOT {matches(_UNQUOTED, catalog.ADMIN_AUTH)}",
    ),
    "SEC-009": matches("text", catalog.STORED_TOKEN),
    "SEC-010": matches("text", catalog.LOGGED_ENV),
    "SEC-011": all_of(
        matches("text", catalog.SERVICE_ROLE), has_any(_FULL_PATH, catalog.CLIENT_FOLDERS)
    ),
}
_route_trigger = Trigger(("app.", "router."), needs="(")
_TRIGGERS = {
    "SEC-003": Trigger(("eval", "exec"), needs="("),
    "SEC-004": Trigger(sql=_sql_trigger),
    "SEC-005/express": _route_trigger,
    "SEC-005/decorator": _route_trigger,
    "SEC-006": any_word("access-control-allow-origin"),
    "SEC-007": any_word("http://"),
    "SEC-008": _route_trigger,
    "SEC-009": Trigger(("localstorage.set",), needs="("),
    "SEC-010": Trigger(("console.",), needs="("),
    "SEC-011": any_word("service_role"),
}


def _catalogued(key: str) -> Rule:
    """Rule of a RULE_TEXTS key; the second rule of an id has sub number 1."""
    severity, message, fix = catalog.RULE_TEXTS[key]
    rule_id = key.split("/")[0]
    sub = int(key in ("SEC-005/decorator", "SEC-012/scopes"))
    return Rule(
        rule_id, int(rule_id[-3:]), sub, severity, message, fix,
        _TRIGGERS.get(key), _TESTS.get(key),
    )


SECRET_RULES = [
    pattern_rule("SEC-001", pattern, label, trigger=any_word(*words), seq=1, sub=i)
    for i, ((pattern, label), words) in enumerate(zip(catalog.SECRETS, _SECRET_WORDS), 1)
]
ENV_RULE = _catalogued("SEC-002")
NAMES_RULE = _catalogued("SEC-012/names")
SCOPES_RULE = _catalogued("SEC-012/scopes")
LINE_RULES = [_catalogued(key) for key in _TESTS]
ALL_RULES = [*SECRET_RULES, ENV_RULE, *LINE_RULES, NAMES_RULE, SCOPES_RULE]


def rules_of(*rule_ids: str, sub: int | None = None) -> list[Rule]:
    return [
        r for r in ALL_RULES if r.rule_id in rule_ids and (sub is None or r.sub == sub)
    ]


# ----------------------------------------------------------------- scan units
def _spanning(rules: Sequence[Rule]) -> list[int]:
    return [r.sub for r in rules if r.seq == 1 and r.sub in catalog.SPANNING_SECRETS]


def _moved_space(sub: int) -> str:
    """Copy of ``_text`` with the white space inside matches moved behind them.

    Every match then sits on the line it starts on and the number of line
    breaks before any position outside a match stays the same.
    """
    keyword, value = catalog.SPANNING_SECRETS[sub]
    sp = tx.SPACE
    pattern = f"(?i)({keyword})({sp}*)([=:])({sp}*)({value})"
    return f"regexp_replace(_text, {quote(pattern)}, '$1$3$5$2$4')"


def _broken_match(subs: Sequence[int]) -> str:
    """Pattern: a keyword and its ``=`` / value separated by a line break."""
    words = "|".join(catalog.SPANNING_SECRETS[s][0] for s in subs)
    sp = tx.SPACE
    return rf"(?i)(?:{words})(?:{sp}*?\n{sp}*[=:]|{sp}*[=:]{sp}*?\n)"


def _window(first: str, last: str) -> str:
    """Lines ``first .. last`` of the file joined by line breaks."""
    return f"array_join(slice(_lines, {first}, {last} - {first} + 1), '\\n')"


def _is_candidate(rules: Sequence[Rule], text: str, low: str) -> str:
    """SQL: does any rule's trigger fire? Words are tested under shared guards."""
    triggers = dict.fromkeys(r.trigger for r in rules if r.trigger)
    by_guard: dict[str, dict[str, None]] = {}
    tests = []
    for trigger in triggers:
        if trigger.sql is not None:
            tests.append(trigger.sql(text, low))
        for guard, word in trigger.guarded_words():
            by_guard.setdefault(guard, {})[word] = None
    for guard, words in by_guard.items():
        found = has_any(low, words)
        tests.append(all_of(has_any(low, [guard]), found) if guard else found)
    return any_of(*tests)


def _line_units(rules: Sequence[Rule]) -> str:
    """SQL: array of candidate line units of one file."""
    candidate = _is_candidate(rules, "element_at(_lines, i)", "element_at(_lows, i)")
    line = "element_at(_lines, i)"
    around = ahead = "cast(null AS string)"
    if any(r.seq in (5, 8) for r in rules):
        route = matches(line, _ROUTE_METHOD)
        around = f"CASE WHEN {route} THEN {_window('greatest(i - 1, 1)', '(i + 1)')} END"
        ahead = f"CASE WHEN {route} THEN {_window('i', '(i + 5)')} END"
    spans = "".join(f", element_at(_span{s}, i) AS span{s}" for s in _spanning(rules))
    numbers = f"filter(sequence(1, size(_lines)), i -> {candidate})"
    unit = (
        f"struct({LINE} AS kind, i AS line, {line} AS text, {around} AS around, "
        f"{ahead} AS ahead{spans})"
    )
    return f"CASE WHEN size(_lines) > 0 THEN transform({numbers}, i -> {unit}) END"


def _scan_units(
    files: DataFrame, rules: Sequence[Rule], carry: Sequence[str] = ()
) -> DataFrame:
    """Explode eligible files into candidate units."""
    spans = _spanning(rules)
    span_fields = "".join(f",span{s}:string" for s in spans)
    unit_type = (
        "array<struct<kind:int,line:int,text:string,around:string,ahead:string"
        f"{span_fields}>>"
    )
    groups: list[str] = []
    df = files
    if any(r.trigger for r in rules):
        # one column per step: an expression used several times is evaluated
        # once only if it is a column of its own
        df = df.withColumn(
            "_text", F.when(F.col("suffix") != ".json", tx.unify_breaks(F.col("content")))
        )
        df = df.withColumns({"_low": F.lower("_text"), "_lines": tx.lines_of(F.col("_text"))})
        steps = {"_lows": F.split("_low", "\n")}
        if spans:
            words = [w for s in spans for w in _SECRET_WORDS[s - 1]]
            steps["_broken"] = F.expr(
                all_of(has_any("_low", words), matches("_text", _broken_match(spans)))
            )
        df = df.withColumns(steps)
        if spans:
            df = df.withColumns(
                {
                    f"_span{s}": F.expr(f"CASE WHEN _broken THEN split({_moved_space(s)}, '\\n') END")
                    for s in spans
                }
            )
        groups.append(_line_units(rules))
    blanks = ", null" * (2 + len(spans))
    if ENV_RULE in rules:
        groups.append(
            "CASE WHEN suffix NOT IN ('.json', '.example') AND name LIKE '.env%' "
            f"THEN array(struct({ENV_FILE}, 1, ''{blanks})) END"
        )
    if NAMES_RULE in rules or SCOPES_RULE in rules:
        # only this column, not every text, travels to the explode
        package = F.when(F.col("name") == "package.json", F.col("content"))
        df = df.withColumn("_package", package)
        groups.append(
            f"CASE WHEN _package IS NOT NULL THEN array(struct({PACKAGE}, 0, _package{blanks})) END"
        )
    units = ", ".join(
        f"coalesce(cast({g} AS {unit_type}), cast(array() AS {unit_type}))" for g in groups
    )
    # the array expression is exploded in place: naming it first would make the
    # optimizer evaluate it a second time for an inferred "not empty" filter
    return df.select(
        "project", "root", "path", "name", "suffix", *carry, F.expr(f"inline(concat({units}))")
    )


# --------------------------------------------------------------- units -> hits
def _hit(rule: int, pos: str, message: str = "null", snippet: str = "null") -> str:
    return (
        f"struct({rule} AS rule, cast({pos} AS bigint) AS pos, "
        f"cast({message} AS string) AS message, cast({snippet} AS string) AS snippet)"
    )


def _match_hits(index: int, rule: Rule, spanning: Sequence[int]) -> str:
    """SQL: one hit per kept match of a pattern rule on the unit's line."""
    spans = rule.seq == 1 and rule.sub in spanning
    text = f"coalesce(span{rule.sub}, text)" if spans else "text"
    placeholder = "|".join(w.replace(".", r"\.") for w in catalog.PLACEHOLDERS)
    kept = (
        f"filter(regexp_extract_all({text}, {quote(rule.pattern)}, 0), "
        f"m -> NOT {matches('lower(m)', placeholder)})"
    )
    return (
        f"CASE WHEN {matches(text, rule.pattern)} "
        f"THEN transform({kept}, (m, j) -> {_hit(index, 'j')}) ELSE {_NO_HITS} END"
    )


def _unreadable_sections(content: str) -> str:
    """SQL: dependency sections that are present but are not JSON objects."""
    return (
        f"filter({array(catalog.DEPENDENCY_SECTIONS)}, s -> "
        f"array_contains(json_object_keys({content}), s) AND NOT startswith("
        f"coalesce(element_at(from_json({content}, 'map<string,string>'), s), ''), '{{'))"
    )


def _package_entries(content: str) -> str:
    """SQL: entries of the dependency sections in order, duplicates included.

    Null for a text that is not JSON or has an unreadable section.
    """
    sections = ", ".join(
        f"coalesce(map_entries(from_json(get_json_object({content}, '$.{s}'), "
        "'map<string,string>')), cast(array() AS array<struct<key:string,value:string>>))"
        for s in catalog.DEPENDENCY_SECTIONS
    )
    readable = all_of(
        f"try_parse_json({content}) IS NOT NULL", f"size({_unreadable_sections(content)}) = 0"
    )
    return f"CASE WHEN {readable} THEN concat({sections}) END"


def _package_hits(index: dict[str, int], public_scopes: Sequence[str]) -> list[str]:
    """SQL: hits of the dependency rules over the entries in ``_deps``.

    A later section overrides a version but a name keeps its first position.
    Versions are looked up only for names that a rule may flag.
    """
    names = "array_distinct(transform(_deps, e -> e.key))"
    value = "element_at(filter(_deps, e -> e.key = n), -1).value"
    workspace = (
        f"(contains(coalesce({value}, ''), 'workspace:') AND NOT "
        f"{matches(f'coalesce({value}, {quote(str())})', r'^[{\[]')})"
    )
    parts = []
    if "names" in index:
        kept = (
            f"filter({names}, n -> NOT startswith(n, '@') AND "
            f"{has_any('n', catalog.INTERNAL_NAME_PARTS)} AND NOT {workspace})"
        )
        message = (
            "concat('Package \\'', n, "
            + quote("' looks like an internal package — dependency confusion risk") + ")"
        )
        hit = _hit(index["names"], "j", message, f"concat(n, ': ', coalesce({value}, 'None'))")
        parts.append(f"transform({kept}, (n, j) -> {hit})")
    if "scopes" in index:
        public = any_of(*[f"startswith(n, {quote(s)})" for s in public_scopes] or ["false"])
        kept = (
            f"filter({names}, n -> startswith(n, '@') AND NOT {public} AND NOT {workspace})"
        )
        message = (
            "concat('Scoped packages found (', size(k), "
            + quote(") but no .npmrc — ensure registry is correct") + ")"
        )
        hit = _hit(index["scopes"], "0", message, "array_join(slice(k, 1, 5), ', ')")
        parts.append(f"transform(filter(array({kept}), k -> size(k) > 0), k -> {hit})")
    return parts


def side_inputs(files: DataFrame) -> DataFrame:
    """Per project: env-like lines of the root ``.gitignore``; has ``.npmrc``?

    Reads root files only; with a table written by ``sources.files`` the filter
    prunes to the small partition that holds them.
    """
    if "lane" in files.columns:
        files = files.where(F.col("lane") == "root")
    roots = files.where(F.col("path").isin(".gitignore", ".npmrc"))
    active = F.filter(
        F.transform(tx.split_lines(F.col("content")), tx.strip),
        lambda t: t.startswith(".env"),
    )
    return roots.groupBy("project").agg(
        F.flatten(
            F.collect_list(F.when(F.col("path") == ".gitignore", active))
        ).alias("ignored_env"),
        F.bool_or(F.col("path") == ".npmrc").alias("has_npmrc"),
    )


def _catalogue(rules: Sequence[Rule]) -> str:
    """SQL: literal array of the rules' fixed fields, looked up by position."""
    rows = ", ".join(
        f"struct({quote(r.rule_id)} AS rule_id, {quote(r.severity)} AS severity, "
        f"{catalog.SEVERITIES.index(r.severity)} AS sev_rank, {quote(r.message)} AS fixed_message, "
        f"{quote(r.fix)} AS fix, {r.seq} AS rule_seq, {r.sub} AS sub_seq)"
        for r in rules
    )
    return f"array({rows})"


def scan(
    files: DataFrame,
    root_files: DataFrame | None = None,
    rules: Sequence[Rule] = tuple(ALL_RULES),
    extra_rules: Sequence[Rule] = (),
    public_scopes: Sequence[str] = tuple(catalog.PUBLIC_SCOPES),
    skipped_dirs: Sequence[str] = tuple(catalog.SKIPPED_DIRS),
    tool: str = "builtin",
    domain: str = "security",
    carry: Sequence[str] = (),
) -> DataFrame:
    """Findings of the given rules over a ``files`` table, in no particular order.

    ``root_files`` may name a smaller table holding the root ``.gitignore`` /
    ``.npmrc`` rows; by default they are looked up in ``files``. ``carry`` names
    further file columns to keep with each finding. Works on streams too.
    """
    rules = [*rules, *extra_rules]
    spanning = _spanning(rules)
    units = _scan_units(eligible_files(files, skipped_dirs), rules, carry)

    singles, match_lists = [], []
    package_index: dict[str, int] = {}
    for i, rule in enumerate(rules, 1):
        if rule.pattern is not None:
            match_lists.append(_match_hits(i, rule, spanning))
        elif rule.test is not None:
            singles.append(f"CASE WHEN kind = {LINE} AND {rule.test} THEN {_hit(i, '0')} END")
        elif rule == ENV_RULE:
            singles.append(f"CASE WHEN kind = {ENV_FILE} THEN {_hit(i, '0')} END")
        else:
            package_index["names" if rule == NAMES_RULE else "scopes"] = i
    lists = []
    if singles:
        lists.append(f"array_compact(array({', '.join(singles)}))")
    if match_lists:
        kept_line = all_of(
            f"kind = {LINE}", f"NOT {has_any('name', catalog.SECRET_FREE_NAMES)}",
            "NOT " + _begins("//", "#", r"\*"),
        )
        lists.append(
            f"CASE WHEN {kept_line} THEN concat({', '.join(match_lists)}) ELSE {_NO_HITS} END"
        )
    if package_index:
        units = units.withColumn(
            "_deps", F.expr(f"CASE WHEN kind = {PACKAGE} THEN {_package_entries('text')} END")
        )
        found = ", ".join(_package_hits(package_index, public_scopes))
        lists.append(f"CASE WHEN _deps IS NOT NULL THEN concat({found}) ELSE {_NO_HITS} END")
    hits = units.select(
        "project", "path", "name", *carry, "line", "text",
        F.expr(f"inline(concat({', '.join(lists)}))"),
    ).withColumn("_rule", F.expr(f"element_at({_catalogue(rules)}, rule)"))
    snippet = (
        f"coalesce(snippet, substring(regexp_replace(text, "
        f"{quote(f'^{tx.SPACE}+|{tx.SPACE}+$')}, ''), 1, {tx.SNIPPET_CHARS}))"
    )
    findings = hits.selectExpr(
        "project", "name", *carry,
        "_rule.rule_id", "_rule.severity", "_rule.sev_rank", "path AS file", "line",
        "coalesce(message, _rule.fixed_message) AS message", f"{snippet} AS snippet",
        "_rule.fix", f"{quote(domain)} AS domain", f"{quote(tool)} AS tool",
        "'' AS category", "'' AS url", "_rule.rule_seq", "_rule.sub_seq", "pos AS match_start",
    )
    if ENV_RULE in rules or SCOPES_RULE in rules:
        findings = _settle_with_side_inputs(
            findings, side_inputs(files if root_files is None else root_files)
        )
    return findings.select(*FINDING_COLUMNS, *carry)


def _settle_with_side_inputs(findings: DataFrame, side: DataFrame) -> DataFrame:
    """Drop findings that a root ``.gitignore`` or ``.npmrc`` makes void.

    Only the two rules that need it meet their project's row, salted; other findings have a
    null key and a salt of their own each, so they spread over all tasks.
    """
    asked = F.col("rule_id").isin("SEC-002", "SEC-012")
    place = F.xxhash64("file", "line", "match_start")
    salted = findings.withColumn("_side_project", F.when(asked, F.col("project"))).withColumn(
        "_side_salt", F.when(asked, F.pmod(place, F.lit(SALT_BUCKETS))).otherwise(place))
    salts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALT_BUCKETS - 1).cast("bigint")))
    joined = salted.join(
        side.withColumnRenamed("project", "_side_project").withColumn("_side_salt", salts),
        ["_side_project", "_side_salt"], "left",
    ).drop("_side_project", "_side_salt")
    ignored = (
        "arrays_overlap(coalesce(ignored_env, cast(array() AS array<string>)), "
        f"array({strings(catalog.ENV_IGNORE_LINES)}, name))"
    )
    return joined.where(
        f"NOT (rule_id = 'SEC-002' AND {ignored}) AND NOT (rule_id = 'SEC-012' "
        f"AND sub_seq = {SCOPES_RULE.sub} AND coalesce(has_npmrc, false))"
    )


def dependency_errors(
    files: DataFrame, skipped_dirs: Sequence[str] = tuple(catalog.SKIPPED_DIRS)
) -> DataFrame:
    """One error row per package.json whose shape the rules cannot read."""
    packages = eligible_files(files, skipped_dirs).where(F.col("name") == "package.json")
    bad = _unreadable_sections("content")
    error = (
        "CASE WHEN try_parse_json(content) IS NULL THEN null "
        "WHEN NOT startswith(schema_of_variant(try_parse_json(content)), 'OBJECT') "
        "THEN 'package.json is not an object' "
        f"WHEN size({bad}) > 0 THEN concat('unreadable dependency section: ', "
        f"array_join({bad}, ', ')) END"
    )
    return packages.select(
        "project", F.col("path").alias("file"), F.expr(error).alias("error")
    ).where(F.col("error").isNotNull())


def unread_files(
    files: DataFrame, skipped_dirs: Sequence[str] = tuple(catalog.SKIPPED_DIRS)
) -> DataFrame:
    """One error row per file that the rules should look at but whose text is null."""
    reason = F.col("unread") if "unread" in files.columns else F.lit(None).cast("string")
    return eligible_files(files, skipped_dirs).where(F.col("content").isNull()).select(
        "project", F.col("path").alias("file"),
        F.coalesce(reason, F.lit("no text")).alias("error"),
    )
