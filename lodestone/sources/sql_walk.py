"""Constructs of SQL text: which statement reads, writes and calls what. Text is lexed, put into a tree by its brackets, and each
statement walks its own clauses; bodies of routines are walked as blocks. What is not understood becomes a note, never a guess."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from lodestone.functions.identity import argument_types
from lodestone.sources.sql_text import masked, parts

LEX = re.compile(r"""(?P<name>(?:"(?:[^"]|"")+"|[^\W\d]\w*)(?:\s*\.\s*(?:"(?:[^"]|"")+"|[^\W\d]\w*|\*))*)|(?P<sign>:=|::|<=|>=|<>|!=|=>|\|\||[^\s\w])|(?P<number>\d[\w.]*)""")
# Functions of the language itself, which are no calls of the catalogue's routines.
BUILTINS = set("""sum avg count min max now coalesce nullif greatest least round abs lower upper trim substring extract date_trunc to_char to_date row_number rank dense_rank
lag lead format concat concat_ws length current_date timezone generate_series""".split())
# Words of the grammar that may stand before a bracket.
WORDS = set("""select from where group by having order limit offset union intersect except all distinct on using join inner left right full outer cross natural lateral as and or not
in exists between like ilike is null case when then else end values set into insert update delete merge with recursive returning over partition filter within any some array row
cast interval matched do nothing for if elsif return perform execute call materialized window rows range conflict key primary foreign references check unique default only
numeric varchar char character decimal float timestamp time bit varying precision table tablesample ordinality fetch overlaps similar collate asc desc nulls first last""".split())
CLAUSES = set("where group having order limit offset fetch union intersect except window returning on using join inner left right full cross natural set when values for".split())
SETS = ("union", "intersect", "except")


@dataclass
class Token:
    kind: str  # name, sign, number, group
    text: str
    start: int
    end: int
    inside: list = field(default_factory=list)

    @property
    def word(self) -> str:
        return self.text.lower() if self.kind == "name" else self.text


@dataclass
class Item:
    scope: str
    kind: str
    start: int
    end: int
    reads: list[str] = field(default_factory=list)
    writes: list[str] = field(default_factory=list)
    calls: list[str] = field(default_factory=list)
    branch: tuple[str, ...] = ()
    details: dict = field(default_factory=dict)


def folded(name: str) -> str:
    """Parts without quotes; unquoted ones in lower case."""
    found = re.findall(r'"(?:[^"]|"")+"|[^\s.]+', name)
    return ".".join(p[1:-1].replace('""', '"') if p[0] == '"' else p.lower() for p in found)


def tree(code: str, start: int = 0, end: int | None = None) -> list[Token]:
    """Tokens of a stretch of code; a pair of brackets is one token of kind group. ValueError where they do not match."""
    out: list[Token] = []
    stack: list[Token] = []
    for m in LEX.finditer(code, start, len(code) if end is None else end):
        here = stack[-1].inside if stack else out
        if m[0] in "([":
            stack.append(Token("group", m[0], m.start(), m.end()))
            here.append(stack[-1])
        elif m[0] in ")]":
            if not stack or (stack[-1].text + m[0]) not in ("()", "[]"):
                raise ValueError("brackets do not match")
            stack.pop().end = m.end()
        else:
            here.append(Token(m.lastgroup, m[0], m.start(), m.end()))
    if stack:
        raise ValueError("brackets do not match")
    return out


def cut(tokens: list[Token], mark: str) -> list[list[Token]]:
    out: list[list[Token]] = [[]]
    for t in tokens:
        if t.kind == "sign" and t.text == mark:
            out.append([])
        else:
            out[-1].append(t)
    return out if out != [[]] else []


def parameter(text: str) -> dict:
    """mode, name, type and default of one parameter of a routine."""
    head, default = re.split(r"\s+default\s+|\s*(?::=|=)\s*", text, maxsplit=1, flags=re.I) if re.search(r"\bdefault\b|=", text, re.I) else (text, None)
    words = head.split()
    mode = words.pop(0).lower() if words[0].lower() in ("in", "out", "inout", "variadic") and len(words) > 1 else "in"
    one = " ".join(words)
    named = len(words) > 1 and not one.lower().startswith(("double precision", "character varying", "timestamp with", "timestamp without", "time with", "time without", "bit varying"))
    return {k: v for k, v in (("mode", mode), ("name", folded(words[0]) if named else None), ("type", " ".join(words[named:])), ("default", default)) if v}


class Walk:
    """The items and notes of one file."""

    def __init__(self, text: str):
        self.text, self.items, self.notes = text, [], []
        self.code, self.bodies, issues = masked(text, identifiers=False, literal="0")
        for i in issues:
            self.note(0, i)

    def note(self, at: int, reason: str) -> None:
        if (at, reason) not in self.notes:
            self.notes.append((at, reason))

    def source(self, tokens: list[Token]) -> str:
        return " ".join(self.text[tokens[0].start : tokens[-1].end].split()) if tokens else ""

    def add(self, scope: str, kind: str, tokens: list[Token], branch: tuple = (), **details) -> Item:
        item = Item(scope, kind, tokens[0].start, tokens[-1].end, branch=branch, details={k: v for k, v in details.items() if v not in (None, [], "")})
        self.items.append(item)
        return item

    # Statements --------------------------------------------------------------------------------------------------

    def file(self) -> None:
        env: dict[str, str] = {}  # temporary tables last to the file's end
        try:
            for statement in cut(tree(self.code), ";"):
                if statement:
                    self.statement(statement, "", env)
        except ValueError as e:
            self.note(0, str(e))

    def statement(self, t: list[Token], scope: str, env: dict[str, str], branch: tuple = ()) -> None:
        words = [x.word for x in t]
        first = words[0]
        if first == "with":
            rest, env = self.common(t, scope, env, branch)
            if rest:
                self.statement(rest, scope, env, branch)
        elif first in ("select", "values") or (t[0].kind == "group" and len(t) >= 1):
            self.query(t, scope, env, branch)
        elif first == "insert":
            at = 2 if len(t) > 2 and words[1] == "into" else 1
            columns = [folded(x[0].text) for x in cut(t[at + 1].inside, ",") if x] if len(t) > at + 1 and t[at + 1].kind == "group" and not self.is_query(t[at + 1]) else []
            item = self.add(scope, "INSERT", t, branch, target_columns=columns)
            item.writes.append(self.named(t[at].text, env))
            rest = t[at + 1 + bool(columns) :]
            self.clauses(rest, item, scope, env, branch, query="SELECT")
        elif first in ("update", "delete"):
            at = 1 + (len(words) > 1 and words[1] in ("from", "only"))
            item = self.add(scope, first.upper(), t, branch)
            item.writes.append(self.named(t[at].text, env))
            rest = t[at + 1 :]
            if first == "update" and (k := next((i for i, x in enumerate(rest) if x.word == "set"), None)) is not None:
                stop = next((i for i in range(k, len(rest)) if rest[i].word in ("from", "where", "returning")), len(rest))
                item.details["assignments"] = [self.source(a) for a in cut(rest[k + 1 : stop], ",")]
            self.clauses(rest, item, scope, env, branch, using_reads=first == "delete")
        elif first == "merge":
            item = self.add(scope, "MERGE", t, branch)
            item.writes.append(self.named(t[2].text, env))
            item.details["branches"] = self.branches(t)
            self.clauses(t[3:], item, scope, env, branch, using_reads=True)
        elif first == "create":
            self.create(t, words, env, branch, scope)
        elif first in ("grant", "revoke"):
            on = words.index("on") if "on" in words else None
            to = next((i for i, w in enumerate(words) if w in ("to", "from")), len(t))
            if on is not None and on + 1 < len(t):
                names = t[on + 1 + (words[on + 1] == "table") : to]
                self.add(scope or folded(names[0].text), first.upper(), t, branch, privileges=[self.source(p) for p in cut(t[1:on], ",")], on=[folded(n[0].text) for n in cut(names, ",") if n], grantees=[folded(n[0].text) for n in cut([x for x in t[to + 1 :] if x.word not in ("with", "grant", "option")], ",") if n], grant_option="option" in words[to:] or None)
            else:
                self.add(scope, first.upper(), t, branch)
        elif first in ("alter", "drop", "comment", "truncate"):
            item = self.add(scope, first.upper(), t, branch, text=self.source(t))
            names = [x for x in t[1:] if x.kind == "name" and x.word not in ("table", "view", "materialized", "index", "function", "procedure", "schema", "column", "on", "if", "exists", "only", "cascade", "restrict", "constraint", "is")]
            if names:
                item.writes.append(folded(names[0].text))
            if first == "alter":
                for a in cut(t[3:], ","):
                    w = [x.word for x in a]
                    if "add" in w and any(k in w for k in ("constraint", "primary", "unique", "check", "foreign")):
                        self.constraint(a[w.index("add") + 1 :], folded(names[0].text) if names else "", branch)
        elif first == "call" and len(t) > 1:
            self.add(scope, "CALL", t, branch).calls.append(folded(t[1].text))
        elif first in ("do",):
            self.add(scope, "DO", t, branch)
            self.body(t, scope or f"unresolved+do@{self.line(t[0].start)}", env)
        else:
            self.note(t[0].start, f"not understood: {first}")

    def create(self, t: list[Token], words: list[str], env: dict, branch: tuple, outer: str) -> None:
        at = 1
        while at < len(t) and words[at] in ("or", "replace", "temp", "temporary", "unlogged", "global", "local", "unique", "materialized", "recursive", "constraint"):
            at += 1
        what = words[at] if at < len(t) else ""
        name_at = at + 1
        while name_at < len(t) and words[name_at] in ("if", "not", "exists", "concurrently"):
            name_at += 1
        if what == "schema":
            return
        if name_at >= len(t) or t[name_at].kind != "name":
            self.note(t[0].start, f"not understood: create {what}")
            return
        name = folded(t[name_at].text)
        rest, low = t[name_at + 1 :], words[name_at + 1 :]
        temporary = "temp" in words[:at] or "temporary" in words[:at]
        as_ = low.index("as") if "as" in low else None
        if what == "view":
            self.add(name, "MATERIALIZED_VIEW" if "materialized" in words[:at] else "VIEW", t, branch, output_columns=[folded(c[0].text) for c in cut(rest[0].inside, ",") if c] if rest and rest[0].kind == "group" else None)
            if as_ is not None:
                self.statement(rest[as_ + 1 :], name, env, branch)
        elif what == "table" and as_ is not None:
            ref = f"@temp:{name}" if temporary else name
            self.add(outer or name, "CTAS", t, branch, temporary=temporary or None).writes.append(ref)
            if temporary:
                env[name] = ref
            stop = len(rest) - (2 if low[-2:] == ["no", "data"] or low[-2:] == ["with", "data"] else 0) - (low[-3:-2] == ["with"] and low[-1:] == ["data"])
            self.statement(rest[as_ + 1 : stop], outer or name, env, branch)
        elif what == "table":
            ref = f"@temp:{name}" if temporary else name
            lifetime = self.source(rest[low.index("commit") + 1 :]) if "commit" in low else None
            columns, own = [], []
            for c in cut(rest[0].inside, ",") if rest and rest[0].kind == "group" else []:
                if c and c[0].word in ("constraint", "primary", "unique", "check", "foreign", "exclude", "like"):
                    own.append(c)
                elif c:
                    columns.append(self.source(c))
                    if any(x.word in ("primary", "unique", "check", "references") for x in c):
                        own.append(c)
            self.add(outer or name, "CREATE_TABLE", t, branch, columns=columns, temporary=temporary or None, on_commit=lifetime).writes.append(ref)
            if temporary:
                env[name] = ref
            for c in own:
                self.constraint(c, name, branch)
        elif what in ("function", "procedure"):
            group = next((x for x in rest if x.kind == "group"), None)
            listed = self.text[group.start + 1 : group.end - 1] if group else ""
            head = rest[rest.index(group) + 1 :] if group else rest
            hw = [x.word for x in head]
            stop = next((i for i, w in enumerate(hw) if w in ("language", "as", "immutable", "stable", "volatile", "security", "strict", "cost", "begin")), len(head))
            returns = self.source(head[1:stop]) if hw[:1] == ["returns"] else None
            parameters = [parameter(p) for p in parts(listed) if p]
            try:
                name += "(" + ",".join(argument_types(listed)) + ")"  # overloads are scopes of their own
            except ValueError as e:
                self.note(t[0].start, str(e))
            self.add(name, what.upper(), t, branch, parameters=parameters, returns=returns, returns_table=bool(returns and returns.lower().startswith(("table", "setof"))) or None, volatility=next((w for w in hw if w in ("immutable", "stable", "volatile")), None))
            language = hw[hw.index("language") + 1] if "language" in hw and hw.index("language") + 1 < len(hw) else "sql"
            if language in ("plpgsql", "sql"):
                self.body(t, name, env)
            else:
                self.note(t[0].start, f"language {language}")
        elif what == "index":
            on = low.index("on") if "on" in low else None
            group = next((x for x in rest if x.kind == "group"), None)
            where = low.index("where") if "where" in low else None
            self.add(folded(rest[on + 1].text) if on is not None else name, "INDEX", t, branch, name=name, unique="unique" in words[:at] or None, method=low[low.index("using") + 1] if "using" in low else None, columns=[self.source(c) for c in cut(group.inside, ",")] if group else None, where=self.source(rest[where + 1 :]) if where is not None else None)
        elif what == "trigger":
            on = low.index("on") if "on" in low else None
            timing = next((w for w in low if w in ("before", "after", "instead")), None)
            run = next((i for i, w in enumerate(low) if w in ("function", "procedure")), None)
            item = self.add(folded(rest[on + 1].text) if on is not None else name, "TRIGGER", t, branch, name=name, timing=timing, events=[w for w in low[: on or 0] if w in ("insert", "update", "delete", "truncate")], level="row" if "row" in low else "statement")
            if run is not None and run + 1 < len(rest):
                item.calls.append(folded(rest[run + 1].text))
        else:
            self.note(t[0].start, f"not understood: create {what}")

    def constraint(self, c: list[Token], table: str, branch: tuple) -> None:
        w = [x.word for x in c]
        name = folded(c[w.index("constraint") + 1].text) if "constraint" in w[:-1] else None
        if "using" in w and "index" in w:
            self.note(c[0].start, "constraint using an index")
        for word, kind in (("primary", "PRIMARY KEY"), ("unique", "UNIQUE"), ("check", "CHECK"), ("references", "FOREIGN KEY")):
            if word in w:
                at = w.index(word)
                inline = w[0] not in ("constraint", "primary", "unique", "check", "foreign")
                group = next((x for x in c[at if word != "references" else 0 :] if x.kind == "group"), None)
                listed = [self.source(x) for x in cut(group.inside, ",")] if group and kind != "CHECK" else None
                columns = None if kind == "CHECK" else [folded(c[0].text)] if inline or not listed else listed
                item = self.add(table, "CONSTRAINT", c, branch, constraint=kind, name=name, columns=columns, expression=self.source(group.inside) if group and kind == "CHECK" else None)
                if word == "references":
                    item.reads.append(folded(c[at + 1].text))

    # Queries -----------------------------------------------------------------------------------------------------

    def is_query(self, group: Token) -> bool:
        while group.kind == "group" and group.inside:
            if group.inside[0].word in ("select", "with", "values"):
                return True
            group = group.inside[0]
        return False

    def named(self, name: str, env: dict[str, str]) -> str:
        name = folded(name)
        return env.get(name, name)

    def common(self, t: list[Token], scope: str, env: dict, branch: tuple) -> tuple[list[Token], dict]:
        """The rest of a statement after its WITH, and the names that it may use."""
        env, at = dict(env), 1
        if t[1].word == "recursive":
            self.note(t[0].start, "recursive query")
            at = 2
        while at < len(t) and t[at].kind == "name":
            name, start = folded(t[at].text), at
            at += 1
            columns = [folded(c[0].text) for c in cut(t[at].inside, ",") if c] if at < len(t) and t[at].kind == "group" else None
            at += columns is not None
            while at < len(t) and t[at].kind != "group":
                at += 1
            if at >= len(t):
                self.note(t[start].start, "common table without a query")
                return [], env
            item = self.add(scope, "CTE", t[start : at + 1], branch, name=name, columns=columns)
            item.writes.append(f"@cte:{name}")
            inner = dict(env) | ({name: f"@cte:{name}"} if t[1].word == "recursive" else {})
            if t[at].inside:
                self.statement(t[at].inside, scope, inner, branch)
            env[name] = f"@cte:{name}"
            at += 1
            if at < len(t) and t[at].text == ",":
                at += 1
            else:
                break
        return t[at:], env

    def query(self, t: list[Token], scope: str, env: dict, branch: tuple, kind: str = "SELECT") -> None:
        """Each arm of a set operation is a query of its own."""
        arms: list[list[Token]] = [[]]
        for x in t:
            if x.word in SETS:
                arms.append([])
            elif not (x.word in ("all", "distinct") and not arms[-1]):
                arms[-1].append(x)
        for arm in filter(None, arms):
            if arm[0].kind == "group":
                if arm[0].inside:
                    self.statement(arm[0].inside, scope, env, branch)
                continue
            if arm[0].word == "values":
                continue
            w = [x.word for x in arm]
            stop = next((i for i, x in enumerate(w) if x in ("from", "into") or (x in CLAUSES and i)), len(arm))
            listed = cut(arm[1 + (w[1:2] == ["distinct"]) : stop], ",")
            columns, formulas = [], []
            for c in filter(None, listed):
                if c[-1].text.endswith("*") and (len(c) == 1 or c[-1].kind == "name"):
                    self.note(c[0].start, "wildcard output")
                alias = folded(c[-1].text).split(".")[-1] if c[-1].kind == "name" and (len(c) == 1 or c[-2].word == "as" or c[-2].kind in ("name", "group", "number")) else None
                body = c[:-2] if len(c) > 2 and c[-2].word == "as" else c
                columns.append(alias or self.source(c))
                if len(body) > 1 and not (len(body) == 2 and body[0].kind == body[1].kind == "name"):
                    formulas.append(self.source(body))
            item = self.add(scope, kind, arm, branch, columns=columns, formulas=formulas)
            if "into" in w:
                end = next((i for i in range(w.index("into") + 1, len(w)) if w[i] in ("from", *CLAUSES)), len(w))
                item.details["into"] = [folded(x.text) for x in arm[w.index("into") + 1 : end] if x.kind == "name" and x.word != "strict"]
            self.clauses(arm, item, scope, env, branch)

    def clauses(self, t: list[Token], item: Item, scope: str, env: dict, branch: tuple, query: str | None = None, using_reads: bool = False) -> None:
        """Reads, calls and conditions of one statement's own tokens; queries in brackets are statements of their own. query: a
        SELECT at this level is one too (of an INSERT)."""
        w = [x.word for x in t]
        if query and (k := next((i for i, x in enumerate(w) if x in ("select", "with") or (t[i].kind == "group" and self.is_query(t[i]))), None)) is not None:
            stop = next((i for i in range(k, len(w)) if w[i] == "conflict" or (w[i] == "returning")), len(t))
            stop -= stop < len(t) and w[stop] == "conflict"
            self.statement(t[k:stop], scope, env, branch)
            t, w = t[:k] + t[stop:], w[:k] + w[stop:]
        conditions, i = [], 0
        while i < len(t):
            x = t[i]
            if x.word in ("from", "join") or (using_reads and x.word == "using"):
                i = self.relations(t, w, i + 1, item, scope, env, branch, many=x.word != "join")
                continue
            if x.word in ("where", "having") or (x.word == "on" and w[i + 1 : i + 2] != ["conflict"]):
                stop = next((k for k in range(i + 1, len(t)) if w[k] in CLAUSES and w[k] not in ("left", "right") or w[k] in ("left", "right") and t[k + 1 : k + 2] and t[k + 1].kind == "name"), len(t))
                conditions.append(self.source(t[i + 1 : stop]))
            if x.word == "group" and w[i + 1 : i + 2] == ["by"]:
                stop = next((k for k in range(i + 2, len(t)) if w[k] in CLAUSES), len(t))
                item.details["group_by"] = [self.source(g) for g in cut(t[i + 2 : stop], ",")]
            self.value(t, i, item, scope, env, branch)
            i += 1
        if conditions:
            item.details["conditions"] = item.details.get("conditions", []) + conditions

    def value(self, t: list[Token], i: int, item: Item, scope: str, env: dict, branch: tuple) -> None:
        """Calls and queries of one token."""
        x = t[i]
        if x.kind != "group":
            return
        before = t[i - 1] if i else None
        if x.text == "(" and before is not None and before.kind == "name" and before.word not in WORDS:
            name = folded(before.text)
            if name not in BUILTINS:
                if "." not in name:
                    self.note(before.start, f"unqualified call: {name}")
                item.calls.append(name)
        if self.is_query(x):
            self.query([x], scope, env, branch)
        else:
            for k in range(len(x.inside)):
                self.value(x.inside, k, item, scope, env, branch)

    def relations(self, t: list[Token], w: list[str], i: int, item: Item, scope: str, env: dict, branch: tuple, many: bool) -> int:
        """Names after FROM, JOIN or USING from token i on; the place after them."""
        while i < len(t):
            while i < len(t) and w[i] in ("lateral", "only"):
                i += 1
            if i >= len(t):
                break
            if t[i].kind == "group":
                if self.is_query(t[i]):
                    self.query([t[i]], scope, env, branch)
                else:
                    inside = t[i].inside
                    self.clauses([Token("name", "from", t[i].start, t[i].start), *inside], item, scope, env, branch)
                i += 1
            elif t[i].kind == "name" and i + 1 < len(t) and t[i + 1].kind == "group" and t[i + 1].text == "(":
                self.value(t, i + 1, item, scope, env, branch)
                i += 2
            elif t[i].kind == "name":
                item.reads.append(self.named(t[i].text, env))
                if "." not in t[i].text and folded(t[i].text) not in env:
                    self.note(t[i].start, f"no schema: {folded(t[i].text)}")
                i += 1
            else:
                return i
            while i < len(t) and t[i].text != "," and w[i] not in CLAUSES and w[i] not in SETS and w[i] not in ("from", "into"):
                i += 1  # an alias and its columns
            if not (many and i < len(t) and t[i].text == ","):
                break
            i += 1
        return i

    def branches(self, t: list[Token]) -> list[dict]:
        w, out = [x.word for x in t], []
        at = [i for i, x in enumerate(w) if x == "when"] + [len(t)]
        for a, b in zip(at, at[1:], strict=False):
            then = w.index("then", a, b) if "then" in w[a:b] else b
            and_ = w.index("and", a, then) if "and" in w[a:then] else then
            out.append({"match": self.source(t[a + 1 : and_]).upper(), "condition": self.source(t[and_ + 1 : then]) or None, "action": w[then + 1].upper() if then + 1 < b else None, "does": self.source(t[then + 1 : b])})
        return out

    # Bodies ------------------------------------------------------------------------------------------------------

    def body(self, t: list[Token], scope: str, env: dict) -> None:
        for a, b in self.bodies:
            if t[0].start <= a <= t[-1].end or self.follows(t, a):
                inner = Walk(self.text[a:b])
                inner.block(scope, dict(env))
                for item in inner.items:
                    item.start, item.end = item.start + a, item.end + a
                self.items += inner.items
                self.notes += [(at + a, reason) for at, reason in inner.notes]

    def follows(self, t: list[Token], at: int) -> bool:
        """Whether a quoted body at the end of a statement, which the lexer blanked, belongs to it."""
        return t[-1].end <= at and ";" not in self.code[t[-1].end : at]

    def block(self, scope: str, env: dict) -> None:
        try:
            statements = [s for s in cut(tree(self.code), ";") if s]
        except ValueError as e:
            self.note(0, str(e))
            return
        path: list[str] = []
        declared = statements and statements[0][0].word == "declare"
        for s in statements:
            if declared:
                k = next((i for i, x in enumerate(s) if x.word == "begin"), None)
                if k is None:
                    continue
                declared, s = False, s[k:]
            self.step(s, scope, env, path)

    def step(self, s: list[Token], scope: str, env: dict, path: list[str]) -> None:
        """One statement of a block, and what stands before it without a semicolon of its own."""
        while s:
            w = [x.word for x in s]
            if w[0] in ("begin",):
                s = s[1:]
            elif w[0] in ("if", "elsif", "elseif") and "then" in w:
                k = w.index("then")
                condition = self.source(s[1:k])
                if w[0] != "if" and path:
                    path.pop()
                path.append(f"{'if' if w[0] == 'if' else 'elsif'} {condition}")
                item = self.add(scope, "IF", s[: k + 1], tuple(path[:-1]), condition=condition)
                for i in range(1, k):
                    self.value(s, i, item, scope, env, tuple(path[:-1]))
                s = s[k + 1 :]
            elif w[0] == "else":
                if path:
                    path[-1] = "else of " + path[-1]
                s = s[1:]
            elif w[0] == "end":
                if w[1:2] == ["if"] and path:
                    path.pop()
                return
            elif w[0] in ("loop", "while", "for", "foreach") and "loop" in w:
                self.note(s[0].start, "loop")
                k = w.index("loop")
                inner = next((i for i in range(k) if w[i] == "select"), None)
                if inner is not None:
                    self.query(s[inner:k], scope, env, tuple(path))
                s = s[k + 1 :]
            elif w[0] == "exception":
                self.note(s[0].start, "exception handler")
                k = w.index("then") if "then" in w else len(w) - 1
                s = s[k + 1 :]
            else:
                self.simple(s, w, scope, env, tuple(path))
                return

    def simple(self, s: list[Token], w: list[str], scope: str, env: dict, branch: tuple) -> None:
        if len(s) > 1 and s[0].kind == "name" and w[1] in (":=", "="):
            item = self.add(scope, "ASSIGN", s, branch, target=folded(s[0].text), expression=self.source(s[2:]))
            self.clauses(s[2:], item, scope, env, branch)
        elif w[0] == "return":
            item = self.add(scope, "RETURN", s, branch, expression=self.source(s[1 + (w[1:2] in (["query"], ["next"])) :]))
            rest = s[1:]
            if w[1:2] == ["query"] and len(s) > 2:
                self.statement(s[2:], scope, env, branch)
            else:
                self.clauses(rest, item, scope, env, branch)
        elif w[0] == "perform":
            self.query([Token("name", "select", s[0].start, s[0].end), *s[1:]], scope, env, branch, kind="PERFORM")
        elif w[0] == "execute":
            self.dynamic(s, w, scope, branch)
        elif w[0] in ("raise", "null", "get", "open", "close", "fetch", "continue", "exit", "declare", "case", "commit", "rollback"):
            if w[0] not in ("raise", "null", "commit", "rollback"):
                self.note(s[0].start, f"not understood: {w[0]}")
        else:
            self.statement(s, scope, env, branch)

    def dynamic(self, s: list[Token], w: list[str], scope: str, branch: tuple) -> None:
        """A template's own names are read; those that come as it runs are unknown."""
        m = re.match(r"\s*(?:format\s*\(\s*)?'((?:[^']|'')*)'", self.text[s[0].end : s[-1].end], re.I)
        item = self.add(scope, "EXECUTE", s, branch, template=m[1].replace("''", "'") if m else None)
        if not m:
            self.note(s[0].start, "dynamic statement")
            return
        filled, unknown = re.sub(r"%\d*\$?[IL]|%\d*\$?s|\$\d+", "unresolved_part", m[1].replace("''", "'")), re.findall(r"%\d*\$?[ILs]", m[1])
        inner = Walk(filled)
        inner.file()
        item.details |= {"command": inner.items[0].kind, "unresolved_parts": len(unknown)} if inner.items else {"unresolved_parts": len(unknown)}
        for i in inner.items:
            item.reads += [x for x in i.reads if "unresolved_part" not in x]
            item.writes += [x for x in i.writes if "unresolved_part" not in x]
            item.calls += [x for x in i.calls if "unresolved_part" not in x]
        if unknown:
            self.note(s[0].start, "dynamic names")

    def line(self, at: int) -> int:
        return self.text.count("\n", 0, at) + 1


def constructs(text: str) -> tuple[list[tuple], list[tuple[int, str]]]:
    """(rows, notes). rows: scope, construct, ordinal within both in the text's order, first line, last line, reads, writes,
    calls (distinct, first places first), branch, details as JSON. notes: (line, reason)."""
    walk = Walk(text)
    walk.file()
    seen: dict[tuple[str, str], int] = {}
    rows = []
    for i in sorted(walk.items, key=lambda i: (i.start, -i.end)):
        scope = i.scope or f"unresolved+{i.kind.lower()}@{walk.line(i.start)}"
        seen[scope, i.kind] = seen.get((scope, i.kind), 0) + 1
        once = lambda x: list(dict.fromkeys(x))
        rows.append((scope, i.kind, seen[scope, i.kind], walk.line(i.start), walk.line(max(i.start, i.end - 1)), once(i.reads), once(i.writes), once(i.calls), list(i.branch), json.dumps(i.details, sort_keys=True)))
    return rows, sorted({(walk.line(a), r) for a, r in walk.notes})
