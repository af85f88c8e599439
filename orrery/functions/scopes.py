"""What a source file declares, imports and calls, by its tokens and scopes.

A file is cut into tokens once, so that comments, strings, templates and regular expressions hide what stands in them; brackets are paired;
then declarations are read where a scope allows them, each with the token at which it ends. Parents and callers are the scopes around. Python
files go through Python's own parser. Of Vue, Svelte and Astro files the first script is read, of Razor files the code blocks, at their places in the file. A file that can't be read, or whose language isn't covered, gives null: its lines are then read by patterns.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Families by the end of a path.
FAMILIES = {"js": "js", "jsx": "js", "mjs": "js", "cjs": "js", "ts": "js", "tsx": "js", "cs": "csharp", "java": "java", "go": "go", "py": "python"}
#: Files whose code stands in script elements, or in blocks behind a mark.
SCRIPTED, RAZOR = {"vue", "svelte", "astro"}, {"razor", "cshtml"}
FACT = "fact string, label string, kind string, start_line int, end_line int, parent string, caller string, begin int, stop int"
TYPES = {"csharp": {"class", "interface", "struct", "record", "enum"}, "java": {"class", "interface", "record", "enum"}}
#: Words in front of a bracket that call nothing: those of all families, and each one's own.
_ALL = "if for while switch catch return function class new super do else case throw import const var default try this"
PLAIN = {
    "js": set(f"{_ALL} async await typeof delete void in of yield with instanceof".split()),
    "csharp": set(f"{_ALL} await typeof void in foreach lock using fixed sizeof checked unchecked when is as out ref base yield and or not".split()),
    "java": set(f"{_ALL} void instanceof synchronized assert yield".split()),
    "go": set("if for switch return else case import const var func go defer select range map chan interface struct type".split()),
}
#: Words in front of a member's type.
MODIFIERS = set("public private protected internal static abstract async get set readonly override virtual sealed partial extern unsafe new final native default synchronized required declare accessor volatile const file ref".split())
#: What stands before a function or class that is part of an expression.
EXPRESSION = set("= ( , : ? => & | ! [ + - * return typeof new await yield void in of case".split())

_COMMENT, _LONG = r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)", r'"""[\s\S]*?(?:"""|\Z)'
_DOUBLE, _SINGLE = r'"(?:\\[\s\S]|[^"\\\n])*"', r"'(?:\\[\s\S]|[^'\\\n])*'"
_WORD = r"(?P<word>[^\W\d][\w$]*|[$#][\w$]+)|(?P<number>\d[\w.]*)|(?P<mark>=>|\?\.|[^\s])"
TOKENS = {
    "js": re.compile(rf"(?P<skip>\s+|{_COMMENT})|(?P<string>{_DOUBLE}|{_SINGLE})|{_WORD}"),
    "csharp": re.compile(rf'(?P<skip>\s+|{_COMMENT}|(?<=\n)[ \t]*\#[^\n]*)|(?P<string>\$*{_LONG}|\$?@\$?"(?:""|[^"])*(?:"|\Z)|\$?{_DOUBLE}|{_SINGLE})|{_WORD}'),
    "java": re.compile(rf"(?P<skip>\s+|{_COMMENT})|(?P<string>{_LONG}|{_DOUBLE}|{_SINGLE})|{_WORD}"),
    "go": re.compile(rf"(?P<skip>\s+|{_COMMENT})|(?P<string>{_DOUBLE}|`[^`]*(?:`|\Z)|{_SINGLE})|{_WORD}"),
}
_TEMPLATE = re.compile(r"(?:\\[\s\S]|[^`\\$]|\$(?!\{))*(`|\$\{|\Z)")
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
_BEFORE_REGEX = set("( , = : [ ! & | ? { } ; + - * % ~ ^ < > => return typeof case in of".split()) | {""}


class Source:
    """A file's tokens: ``kind`` (word, string, number or mark), ``text``, ``line``, ``at``, ``to``; the partner of each bracket."""

    def __init__(self, family: str, content: str, inside: bool = False):
        self.inside = inside  # whether members stand at the top, as inside a type
        self.family, self.kind, self.text, self.line, self.at, self.to = family, [], [], [], [], []
        pattern, pos, line, seen, templates = TOKENS[family], 0, 1, 0, []
        while pos < len(content):
            m = pattern.match(content, pos)
            kind, text, end = m.lastgroup, m.group(), m.end()
            if family == "js" and (text == "`" or text == "}" and templates and templates[-1] == 0):
                templates = templates[:-1] if text == "}" else templates
                m = _TEMPLATE.match(content, end)
                kind, end = "string", m.end()
                if m.group(1) == "${":
                    templates.append(0)
            elif family == "js" and text == "/" and (self.text[-1] if self.text else "") in _BEFORE_REGEX and (m := _REGEX.match(content, pos)):
                kind, end = "string", m.end()
            elif templates and text in "{}":
                templates[-1] += 1 if text == "{" else -1
            if kind != "skip":
                line, seen = line + content.count("\n", seen, pos), pos
                for held, value in ((self.kind, kind), (self.text, text), (self.line, line), (self.at, pos), (self.to, end)):
                    held.append(value)
            pos = end
        self.content, self.n = content, len(self.text)
        self.pair = self.pairs()

    def pairs(self) -> list[int]:
        """Partner of each bracket. One without a partner ends with the file; other tokens are their own."""
        pair, opened = list(range(self.n)), {"(": [], "[": [], "{": []}
        partner = {")": "(", "]": "[", "}": "{"}
        for i, (kind, text) in enumerate(zip(self.kind, self.text, strict=True)):
            if kind == "mark" and text in opened:
                opened[text].append(i)
            elif kind == "mark" and text in partner and opened[partner[text]]:
                j = opened[partner[text]].pop()
                pair[i], pair[j] = j, i
        for rest in opened.values():
            for i in rest:
                pair[i] = self.n - 1
        return pair

    def is_(self, i: int, *texts: str) -> bool:
        return 0 <= i < self.n and self.kind[i] != "string" and self.text[i] in texts

    def word(self, i: int) -> bool:
        return 0 <= i < self.n and self.kind[i] == "word"

    def find(self, i: int, *texts: str, stop: int | None = None) -> int:
        """First of some marks from i on, brackets left out; -1 where there is none."""
        stop = self.n if stop is None else stop
        while i < stop:
            if self.is_(i, *texts):
                return i
            i = self.pair[i] + 1 if self.is_(i, "(", "[", "{") else i + 1
        return -1

    def angles(self, i: int) -> int:
        """Behind the type arguments that open at i, or i if it isn't such a list."""
        depth = 0
        for j in range(i, min(self.n, i + 200)):
            if self.is_(j, "<"):
                depth += 1
            elif self.is_(j, ">"):
                depth -= 1
                if not depth:
                    return j + 1
            elif not (self.word(j) or self.is_(j, ",", ".", "?", "[", "]", "|", "&", ":", "(", ")", "{", "}", "extends") or self.kind[j] == "string"):
                return i
        return i


Unit = tuple[int, int, int, str, bool]  # first and last token, token of the name, kind ('' for what only hides its tokens), whether it is a type


def javascript(s: Source) -> Iterator[Unit]:
    bodies: set[int] = set()
    open_: list[int] = []
    for i in range(s.n):
        text, last = s.text[i], s.text[i - 1] if i else ""
        if s.kind[i] == "mark" and text in ("(", "[", "{"):
            open_.append(i)
        elif s.kind[i] == "mark" and text in (")", "]", "}") and open_:
            open_.pop()
        if s.kind[i] != "word":
            continue
        stated = last not in EXPRESSION and (not i or s.kind[i - 1] != "number")
        if text == "function" and (stated or last == "async" and s.text[i - 2] not in EXPRESSION):
            name = i + 2 if s.is_(i + 1, "*") else i + 1
            start = s.angles(name + 1) if s.is_(name + 1, "<") else name + 1
            if s.word(name) and s.is_(start, "("):
                body = s.find(s.pair[start] + 1, "{", ";")
                if body >= 0 and s.is_(body, "{"):
                    yield i - (last == "async"), s.pair[body], name, "function", False
        elif text == "class" and stated and s.word(i + 1):
            body = s.find(i + 2, "{")
            if body >= 0:
                bodies.add(body)
                yield i, s.pair[body], i + 1, "class", True
        elif last in ("const", "let") and s.word(i):
            end = arrow(s, i)
            if end:
                yield i, end, i, "symbol", False
        elif text not in PLAIN["js"] and s.is_(i + 1, "(", "<") and last not in ("function", ".", "new", "?.", "*", "class", "extends") and not (last == "*" and s.is_(i - 2, "function")):
            inside = bool(open_) and open_[-1] in bodies
            start = s.angles(i + 1) if s.is_(i + 1, "<") else i + 1
            after = s.pair[start] + 1 if s.is_(start, "(") else -1
            if inside and s.is_(after, ":"):
                after = s.find(after, "{", ";", "}")
            if s.is_(after, "{") and (inside or s.line[after] == s.line[after - 1]):
                first = i
                while first and s.text[first - 1] in MODIFIERS and s.word(first - 1):
                    first -= 1
                yield first, s.pair[after], i, "function", False


def arrow(s: Source, name: int) -> int:
    """Last token of the arrow function that a name is given, or 0."""
    at = name + 1
    if s.is_(at, ":"):
        at = s.find(at, "=", ";", stop=min(s.n, at + 200))
    if at < 0 or not s.is_(at, "="):
        return 0
    at += 1 + s.is_(at + 1, "async")
    at = s.angles(at) if s.is_(at, "<") else at
    if s.is_(at, "("):
        at = s.pair[at] + 1
        at = s.find(at, "=>", ";", stop=min(s.n, at + 60)) if s.is_(at, ":") else at
    elif s.word(at):
        at += 1
    if not s.is_(at, "=>"):
        return 0
    at += 1
    if s.is_(at, "{"):
        return s.pair[at]
    last = at
    while at < s.n and not s.is_(at, ";", ",", ")", "]", "}"):
        if at > last and s.line[at] > s.line[last] and s.text[last] not in EXPRESSION and not s.is_(at, ".", "?.", "?", ":", "+", "-", "*", "&", "|"):
            break
        last = s.pair[at] if s.is_(at, "(", "[", "{") else at
        at = last + 1
    return last


def members(s: Source) -> Iterator[Unit]:
    """Types and their methods and properties, of C# and Java: a member's head is read up to its body or end."""
    types, todo = TYPES[s.family], [(0, s.n, s.inside)]
    while todo:
        i, stop, inside = todo.pop()
        while i < stop:
            i = yield from member(s, i, stop, inside, types, todo)


def member(s: Source, first: int, stop: int, inside: bool, types: set[str], todo: list) -> Iterator[Unit]:
    """Reads one member; returns the token behind it and adds the scopes inside to ``todo``."""
    j, kind, name, typed, event = first, "", -1, 0, False
    while j < stop:
        text = s.text[j]
        if s.kind[j] == "word":
            if not kind and text == "namespace":
                at = s.find(j, "{", ";", stop=stop)
                if at >= 0 and s.is_(at, "{"):
                    todo.append((at + 1, s.pair[at], False))
                    return s.pair[at] + 1
                return at + 1 if at >= 0 else stop
            if not kind and text in types and s.word(j + 1):
                kind, name = text, j + 1 + (text == "record" and s.is_(j + 1, "class", "struct"))
                j = name + 1
                continue
            event |= text in ("event", "delegate", "operator", "using", "import", "package")
            typed += text not in MODIFIERS
        elif s.kind[j] == "mark":
            if text == "@":
                j += 1
                while s.is_(j + 2, ".") or s.is_(j + 1, "."):
                    j += 2
                j = s.pair[j + 1] + 1 if s.is_(j + 1, "(") else j + 1
                continue
            if text == "[":
                yield from ((k, k, k, "", False) for k in range(j, s.pair[j]))
                j = s.pair[j] + 1
                continue
            if text == "<" and s.angles(j) > j:
                j = s.angles(j)
                continue
            if text == "(":
                if not kind and (j == first or s.text[j - 1] in MODIFIERS or s.is_(j - 1, "]")):  # the type is a tuple
                    j = s.pair[j] + 1
                    continue
                if not kind:
                    name = j - 1
                    while name > first and not s.word(name):
                        name -= 1
                    chain = name
                    while s.is_(chain - 1, "."):
                        chain -= 2
                    before = any(s.word(k) and s.text[k] not in MODIFIERS for k in range(first, chain))
                    kind = "method" if before and not event and inside else "other"
                j = s.pair[j] + 1
                continue
            if text in ("=>", "=", ";", "{"):
                break
            if text == "}":
                return j + 1
        j += 1
    else:
        return stop
    mark = s.text[j]
    end = s.pair[j] if mark == "{" else j
    if mark in ("=>", "="):
        end = s.find(j + 1, ";", stop=stop)
        end = end if end >= 0 else stop - 1
    if not kind and inside and not event and typed >= 2 and mark in ("{", "=>") and s.family == "csharp" and s.word(j - 1):
        kind, name = "property", j - 1
        if mark == "{" and s.is_(end + 1, "="):
            end = max(end, s.find(end + 1, ";", stop=stop))
    if kind in types or kind in ("method", "property"):
        yield first, end, name, kind, kind in types
    elif kind == "other" and inside:
        yield name, name, name, "", False
    if mark == "{" and kind in types and kind != "enum":
        todo.append((j + 1, s.pair[j], True))
    return end + 1


def golang(s: Source) -> Iterator[Unit]:
    i = 0
    while i < s.n:
        if s.is_(i, "func"):
            name = s.pair[i + 1] + 1 if s.is_(i + 1, "(") else i + 1
            body = s.find(name + 1, "{")
            while body > 0 and s.is_(body - 1, "struct", "interface"):
                body = s.find(s.pair[body] + 1, "{")
            if s.word(name) and body >= 0:
                yield i, s.pair[body], name, "function", False
                i = s.pair[body]
        elif s.is_(i, "type") and s.is_(i + 1, "("):
            end, at = s.pair[i + 1], i + 2
            while at < end:
                if s.word(at) and s.line[at] > s.line[at - 1]:
                    yield i, end, at, "symbol", False
                at = s.pair[at] + 1 if s.is_(at, "(", "[", "{") else at + 1
            i = end
        elif s.is_(i, "type") and s.word(i + 1):
            end = i + 1
            while end + 1 < s.n and s.line[end + 1] == s.line[end]:
                end = s.pair[end + 1] if s.is_(end + 1, "(", "[", "{") else end + 1
            yield i, end, i + 1, "symbol", False
            i = end
        elif s.is_(i, "(", "[", "{"):
            i = s.pair[i]
        i += 1


READERS = {"js": javascript, "csharp": members, "java": members, "go": golang}


def imported(s: Source) -> Iterator[tuple[int, str]]:
    """Token and name of each import."""
    quoted = lambda i: 0 <= i < s.n and s.kind[i] == "string"
    for i in range(s.n):
        if s.family == "js" and s.is_(i, "import") and not s.is_(i + 1, "(", ".") and not s.is_(i - 1, ".", "?."):
            at = i + 1
            while at < s.n and not quoted(at) and (s.word(at) or s.is_(at, ",", "*", "{", "}")):
                at += 1
            if quoted(at) and (at == i + 1 or s.is_(at - 1, "from")):
                yield at, s.text[at].strip("'\"")
        elif s.family == "go" and s.is_(i, "import"):
            for at in range(i + 1, s.pair[i + 1] + 1 if s.is_(i + 1, "(") else min(s.n, i + 3)):
                if quoted(at) and s.text[at][0] == '"':
                    yield at, s.text[at].strip('"')
        elif s.family in ("csharp", "java") and s.is_(i, "using", "import") and (s.is_(i - 1, ";", "}", "global", ")") or not i or s.line[i] > s.line[i - 1]):
            at = i + 1 + s.is_(i + 1, "static")
            at += 2 * s.is_(at + 1, "=")
            end = at
            while s.word(end) or s.is_(end, ".", "*"):
                end += 1
            if end > at and s.is_(end, ";"):
                yield at, "".join(s.text[at:end])


def called(s: Source, names: set[int]) -> Iterator[int]:
    """Tokens of names that are called; names that are declared there are not."""
    for i in range(s.n):
        if s.kind[i] != "word" or i in names or s.text[i] in PLAIN[s.family]:
            continue
        at = i + 1 + s.is_(i + 1, "?.")
        if s.family == "js" and s.is_(at, "<"):
            at = s.angles(at)
        if not s.is_(at, "(") or s.is_(i - 1, "@", "function", "func", "class"):
            continue
        first = i
        while s.is_(first - 1, ".") and s.word(first - 2):
            first -= 2
        if not s.is_(first - 1, "new"):
            yield i


def scoped(s: Source) -> list[dict]:
    units = sorted(READERS[s.family](s), key=lambda u: (u[0], -u[1]))
    names, out, around = {u[2] for u in units}, [], []
    units = [u for u in units if u[3]]
    row = lambda fact, label, kind, i, j, parent, caller: dict(fact=fact, label=label, kind=kind, start_line=s.line[i], end_line=s.line[j] + s.content.count("\n", s.at[j], s.to[j]), parent=parent, caller=caller, begin=s.at[i], stop=s.to[j])
    events = sorted([(u[0], 0, u) for u in units] + [(i, 1, i) for i in called(s, names)] + [(i, 2, label) for i, label in imported(s)], key=lambda e: e[:2])
    for at, what, it in events:
        while around and around[-1][1] < at:
            around.pop()
        if what == 0:
            parent = next((s.text[u[2]] for u in reversed(around) if u[4] and u[3] in ("class", "struct", "interface", "record")), "")
            out.append(row("symbol", s.text[it[2]], it[3], it[0], it[1], parent, None))
            around.append(it)
        elif what == 1:
            out.append(row("call", s.text[it], "call", it, it, "", s.text[around[-1][2]] if around else None))
        elif it:
            out.append(row("import", it, "import", at, at, "", None))
    return out


def python(content: str) -> list[dict]:
    starts, lines = [0], content.split("\n")
    for line in lines:
        starts.append(starts[-1] + len(line) + 1)
    at = lambda line, col: starts[line - 1] + len(lines[line - 1].encode()[:col].decode(errors="ignore"))
    out, todo = [], [(ast.parse(content), "", None)]
    row = lambda fact, label, kind, n, parent, caller, line=None: dict(fact=fact, label=label, kind=kind, start_line=line or n.lineno, end_line=line or n.end_lineno, parent=parent, caller=caller, begin=at(n.lineno, n.col_offset), stop=at(n.end_lineno, n.end_col_offset))
    while todo:
        node, parent, caller = todo.pop()
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            is_class = isinstance(node, ast.ClassDef)
            out.append(row("symbol", node.name, "class" if is_class else "function", node, parent, None))
            outer = node.decorator_list
            todo += [(x, parent, caller) for x in outer]
            todo += [(x, node.name if is_class else parent, node.name) for x in ast.iter_child_nodes(node) if x not in outer]
            continue
        if isinstance(node, ast.Import):
            out += [row("import", a.name, "import", node, "", None) for a in node.names]
        elif isinstance(node, ast.ImportFrom) and node.module and not node.level:
            out.append(row("import", node.module, "import", node, "", None))
        elif isinstance(node, ast.Call) and isinstance(node.func, (ast.Name, ast.Attribute)):
            label = node.func.id if isinstance(node.func, ast.Name) else node.func.attr
            out.append(row("call", label, "call", node, "", caller, node.func.end_lineno))
        todo += [(x, parent, caller) for x in ast.iter_child_nodes(node)]
    return sorted(out, key=lambda r: (r["begin"], -r["stop"], r["fact"]))


_SCRIPT, _TYPED = re.compile(r"<script\b([^>]*)>(.*?)</script>", re.IGNORECASE | re.DOTALL), re.compile(r"""\blang\s*=\s*["']?(?:ts|typescript)\b""", re.IGNORECASE)


def only(content: str, kept: list[tuple[int, int]]) -> str:
    """The content with blanks for all but some stretches, so that lines and places stay what they are."""
    blank = lambda part: re.sub(r"[^\n]", " ", part)
    out, at = [], 0
    for start, stop in kept:
        out += [blank(content[at:start]), content[start:stop]]
        at = stop
    return "".join([*out, blank(content[at:])])


def script_of(content: str) -> str | None:
    """The first script element's body in its place; null where there is none or it is blank."""
    m = _SCRIPT.search(content)
    return only(content, [m.span(2)]) if m and m.group(2).strip() else None


def blocks_of(content: str) -> str:
    """The C# blocks of a Razor file in their places: what stands between the braces behind ``@code``, ``@functions`` and ``@``. All of it where there is none."""
    kept = []
    for m in re.finditer(r"@(?:code|functions)?\s*\{", content):
        if not kept or m.start() >= kept[-1][1]:
            block = Source("csharp", content[m.end() - 1 :])
            kept.append((m.end(), m.end() - 1 + (block.at[block.pair[0]] if block.is_(block.pair[0], "}") else len(content))))
    return only(content, kept) if kept else content


def facts_of(path: str | None, content: str | None) -> list[dict] | None:
    """Facts of one file by place; null where its lines must be read instead."""
    ending = (path or "").rpartition(".")[2].lower()
    family = FAMILIES.get(ending)
    if content is not None and ending in SCRIPTED:
        script = script_of(content.replace("\r\n", "\n"))
        return None if script is None else scoped(Source("js", script))
    if content is not None and ending in RAZOR:
        return scoped(Source("csharp", blocks_of(content.replace("\r\n", "\n")), True))
    if family is None or content is None:
        return None
    if family == "python":
        try:
            return python(content.replace("\r\n", "\n"))
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return None
    return scoped(Source(family, content.replace("\r\n", "\n")))


def facts(path: Column, content: Column) -> Column:
    """Array of facts: symbols, imports and calls with lines from 1, and where the text (line ends as ``\\n``) of each begins and stops."""
    kinds = [f.split(" ") for f in FACT.split(", ")]
    kind = pa.list_(pa.struct([(n, pa.string() if t == "string" else pa.int32()) for n, t in kinds]))

    @F.arrow_udf(f"array<struct<{', '.join(f'{n}: {t}' for n, t in kinds)}>>")
    def read(paths: pa.Array, contents: pa.Array) -> pa.Array:
        return pa.array([facts_of(p.as_py(), c.as_py()) for p, c in zip(paths, contents, strict=True)], kind)

    return read(path, content)
