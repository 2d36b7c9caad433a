"""Definitions, occurrences and call edges of C++, GLSL, Rust, TypeScript and C# by their syntax.

A file becomes tokens with matched brackets; a descent through its scopes (namespaces, records, functions, blocks) recognises
declarations at the beginning of statements by each language's rules and reads all else as expressions. A name is a definition
where it is declared, a call where arguments follow it (also behind a qualifier, an object or template arguments) or where a Rust
macro is used, and else a reference. Functions nest; a call belongs to the innermost named one.
"""

from __future__ import annotations

import re
from bisect import bisect_right

#: What a file consists of; comments are kept apart, and names are looked at last but for single signs.
COMMENT = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
TEXTS = {
    "cpp": r"^[ \t]*\#(?:[^\n\\]|\\.)*|R\"(?P<d>[^\s()\\]*)\(.*?\)(?P=d)\"|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])+'",
    "rust": r"r(?P<d>\#*)\".*?\"(?P=d)|b?\"(?:\\.|[^\"\\])*\"|b?'(?:\\[^\n]+?|[^'\\\n])'|'[A-Za-z_]\w*",
    "ts": r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`",
    "csharp": r"^[ \t]*\#[^\n]*|\$?@\$?\"(?:\"\"|[^\"])*\"|\$?\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])+'",
}
SIGNS = r"(?P<id>[^\W\d][\w$]*|\$[\w$]*)|\d[\w.]*|::|->|=>|&&|\|\||[<>=!]=|<<|\S"
#: Words of each language that are never names.
WORDS = {
    "cpp": "if for while switch catch return sizeof alignof decltype else new delete throw static_assert defined operator class struct union enum namespace template typename using typedef public private protected virtual static inline const constexpr volatile mutable explicit friend extern auto void int long short char bool float double unsigned signed noexcept override final default case break continue do goto try this nullptr true false co_await co_return co_yield in out inout uniform",
    "rust": "if for while match loop return fn else let mut pub struct enum union trait impl mod use const static type where unsafe async await move ref self Self super crate dyn as in break continue extern true false box",
    "ts": "if for while switch catch return function else new delete throw typeof instanceof await async class interface enum type namespace module const let var import export from default extends implements public private protected static readonly abstract declare get set void null undefined true false this super case break continue do try finally in of yield keyof is as infer never any unknown string number boolean",
    "csharp": "if for foreach while switch catch return else new throw typeof nameof sizeof lock using await async class struct interface enum record delegate namespace public private protected internal static readonly abstract virtual override sealed partial const void int long short byte char bool float double decimal string object var get set init this base null true false case break continue do try finally in out ref is as params where yield default operator event unsafe extern",
}
WORDS = {lang: frozenset(w.split()) for lang, w in WORDS.items()}
READ = {lang: re.compile(rf"(?P<comment>{COMMENT})|(?P<text>{texts})|{SIGNS}", re.S | re.M) for lang, texts in TEXTS.items()}
RECORDS = {"cpp": {"class", "struct", "union", "enum"}, "rust": {"struct", "enum", "union", "trait", "type"}, "ts": {"class", "interface", "enum", "type"}, "csharp": {"class", "struct", "interface", "enum", "record", "delegate"}}
SPACES = {"cpp": {"namespace"}, "rust": {"mod"}, "ts": {"namespace", "module"}, "csharp": {"namespace"}}
#: Words and signs that may stand before a declaration's own word, and what ends a name's reach as template arguments.
BEFORE = {"pub", "export", "default", "declare", "abstract", "public", "private", "protected", "internal", "static", "sealed", "partial", "readonly", "unsafe", "async", "extern", "const", "inline", "typedef", "final", "crate", "new", "virtual", "override", "constexpr", "friend"}
TYPES = {"auto", "int", "long", "short", "char", "bool", "float", "double", "unsigned", "signed"}
NO_ARGUMENTS = {";", "{", "}", "&&", "||", "==", "!=", "<<", "+", "/", "%", "!"}


class Source:
    def __init__(self, text: str, lang: str):
        self.lang = "cpp" if lang == "glsl" else "ts" if lang in ("tsx", "svelte") else lang
        self.exports = lang not in ("cpp", "glsl")
        self.raw = text.split("\n")
        self.words = WORDS[self.lang]
        breaks = [m.start() for m in re.finditer("\n", text)]
        self.t, self.line, self.name, self.string, self.comments = [], [], [], [], []
        at, read = 0, READ[self.lang]
        while m := read.search(text, at):
            at, found = m.end(), m[0]
            line = bisect_right(breaks, m.start() - 1) + 1
            if m["comment"]:
                self.comments.append((line, line + found.count("\n"), found, len(self.t)))
                continue
            if m["text"]:
                if found.lstrip().startswith("#"):
                    continue
            elif self.lang == "ts" and found == "/" and (not self.t or self.t[-1] in "(,=:[!&|?{};" or self.t[-1] in ("return", "=>", "&&", "||")) and (r := re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/\w*").match(text, m.start())):
                at, found = r.end(), "''"  # a pattern
            self.t.append(found)
            self.line.append(line)
            self.name.append(bool(m["id"]) and found not in self.words)
            self.string.append(bool(m["text"]))
        self.n = len(self.t)
        self.close = self._brackets()
        self.typed: set[int] = set()  # where template arguments end that aren't called
        self.defs, self.occ, self.edges = [], [], []
        self._block(0, self.n, [], None, "top")

    def _brackets(self) -> list[int]:
        """For each opening bracket its closing one, or the end."""
        close, stack = [self.n] * self.n, []
        for i, x in enumerate(self.t):
            if x in ("(", "[", "{"):
                stack.append(i)
            elif x in (")", "]", "}"):
                want = {")": "(", "]": "[", "}": "{"}[x]
                while stack and self.t[stack[-1]] != want and x == "}":
                    close[stack.pop()] = i
                if stack and self.t[stack[-1]] == want:
                    close[stack.pop()] = i
        return close

    def _is(self, i: int, *signs: str) -> bool:
        return i < self.n and self.t[i] in signs

    def _past_arguments(self, i: int) -> int:
        """Behind the template arguments that begin at i, or i if they aren't any."""
        if not self._is(i, "<"):
            return i
        depth, j = 0, i
        while j < min(self.n, i + 300):
            x = self.t[j]
            if x in NO_ARGUMENTS or self.string[j] and self.lang != "rust":
                return i
            if x == "<":
                depth += 1
            elif x == ">":
                depth -= 1
                if not depth:
                    return j + 1
            elif x in ("(", "["):
                j = self.close[j]
            j += 1
        return i

    def _path(self, i: int) -> int:
        """Behind a path of names from i on: A::B, in C# namespaces A.B; i if there is none."""
        j = i
        while j < self.n and self.name[j]:
            j += 1
            k = self._past_arguments(j) if self.lang != "ts" else j
            if self._is(k, "::") or (self.lang == "csharp" and self._is(k, ".")):
                j = k + 1
            else:
                break
        return j

    def _doc(self, start: int, at: int) -> str | None:
        """The comments right above a declaration, or between its attributes, without their marks."""
        above, row = [], self.line[start]
        for first, last, text, token in reversed(self.comments):
            if token > at:
                continue
            if start < token <= at:
                above.append(text)
            elif token == start and last == row - 1:
                above.append(text)
                row = first
            else:
                break
        lines = [re.sub(r"^\s*(?://[/!]?|/\*+!?|\*+(?!/))|\*+/\s*$", "", x).strip() for text in reversed(above) for x in text.split("\n")]
        return "\n".join(x for x in lines if x) or None

    def _define(self, start: int, at: int, body: int | None, end: int, scope: list[str], kind: str, name: str | None = None, listed: bool = True) -> str:
        """Notes a definition; start: its statement, at: its name, body: where its text begins, end: its last token."""
        name = name or self.t[at]
        short = name.rsplit("::", 1)[-1]
        self.occ.append({"name": short, "role": "def", "line": self.line[at]})
        full = name if "::" in name and self.lang == "cpp" else "::".join([*scope, name])
        if listed:
            stop = body if body is not None else end
            head = " ".join(self.raw[k].strip() for k in range(self.line[start] - 1, self.line[min(stop, self.n - 1)]))
            # A body on the declaration's line isn't part of its signature.
            head = re.sub(r"\s+", " ", head.split("{")[0] if body is not None else head).strip()
            doc = self._doc(start, at)
            public = self.exports and any(self._is(k, "pub", "export", "public") for k in range(start, at))
            self.defs.append({"name": full, "kind": kind, "line": self.line[start], "end_line": self.line[min(end, self.n - 1)], "signature": head[:200], "has_doc": doc is not None, "exported": public, "doc": doc})
        return full

    def _call(self, i: int, name: str, fn: str | None) -> None:
        short = name.rsplit("::", 1)[-1]
        for x in dict.fromkeys((name, short)):
            self.occ.append({"name": x, "role": "call", "line": self.line[i]})
        if fn is not None:
            self.edges.append({"caller": fn, "callee": name, "line": self.line[i], "text": self.raw[self.line[i] - 1].strip()})

    def _expressions(self, i: int, end: int, scope: list[str], fn: str | None) -> None:
        """Names, calls and blocks of tokens that declare nothing."""
        while i < end:
            x = self.t[i]
            if x == "{":
                stop = min(self.close[i], end)
                self._block(i + 1, stop, scope, fn, "body")
                i = stop + 1
            elif self.string[i]:
                named = self.lang == "cpp" and x.startswith('"') and i > 1 and (self._is(i - 1, "(") and self._is(i - 2, "system", "ZoneScopedN", "ZoneNamedN") or self._is(i - 1, ",") and i > 3 and self._is(i - 4, "ZoneNamedN"))
                if named:
                    self.occ.append({"name": x[1:-1], "role": "def", "line": self.line[i]})
                i += 1
            elif self.name[i]:
                j = self._path(i) if self.lang in ("cpp", "rust") else i + 1
                while j > i + 1 and not self.name[j - 1]:
                    j -= 1  # a path's last sign is a name
                macro = self.lang == "rust" and self._is(j, "!") and self._is(j + 1, "(", "[", "{")
                k = j + 1 if macro else self._past_arguments(j + 1 if self.lang == "rust" and self._is(j, "::") and self._is(j + 1, "<") else j)
                if self.lang == "ts" and self._is(k, "?") and self._is(k + 1, ".") and self._is(k + 2, "("):
                    k += 2
                made = i > 0 and self.t[i - 1] == "new" and self.lang != "rust"
                # After a type comes a variable, whatever it is made from.
                made |= self.lang == "cpp" and (i in self.typed or i > 0 and (self.name[i - 1] or self.t[i - 1] in TYPES))
                if not self._is(k, "("):
                    self.typed.add(k if k > j else -1)
                called = (macro or self._is(k, "(")) and not made
                if called and self.lang == "ts" and self.t[i - 1 : i] != ["."] and (body := self._ts_body(self.close[k] + 1, end)):
                    self._function(i, i, k, body, scope, fn)
                    i = self.close[body] + 1
                    continue
                names = [k for k in range(i, j) if self.name[k]]
                if called:
                    # Qualifiers are names that are used; the path as a whole is what is called.
                    whole = "::".join(self.t[k] for k in names) if len(names) == sum(self.t[k] == "::" for k in range(i, j)) + 1 else self.t[names[-1]]
                    for k in names[:-1]:
                        self.occ.append({"name": self.t[k], "role": "ref", "line": self.line[k]})
                    self._call(names[-1], whole, fn)
                else:
                    for k in names:
                        self.occ.append({"name": self.t[k], "role": "ref", "line": self.line[k]})
                i = j
            else:
                i += 1

    def _function(self, start: int, at: int, args: int, body: int | None, scope: list[str], fn: str | None, name: str | None = None, end: int | None = None) -> None:
        """A function: its head's other names, its arguments and its body."""
        stop = self.close[body] if body is not None and self.t[body] == "{" else end if end is not None else self.close[args]
        full = self._define(start, at, body, stop, scope, "Function", name)
        self._expressions(args, min(self.close[args] + 1, self.n), scope, full)
        inner = [*scope, (name or self.t[at]).rsplit("::", 1)[-1]]
        if body is not None:
            i = next((k for k in range(self.close[args] + 1, body) if self.t[k] == ":"), body) if self.lang == "cpp" else body
            self._expressions(self.close[args] + 1, i, scope, full)
            while i < body:  # a member and what it is made from
                if self.name[i]:
                    self.occ.append({"name": self.t[i], "role": "ref", "line": self.line[i]})
                elif self.t[i] in ("(", "{"):
                    self._expressions(i + 1, min(self.close[i], body), scope, full)
                    i = self.close[i]
                i += 1
            if self.t[body] == "{":
                self._block(body + 1, stop, inner, full, "body")
            else:
                self._expressions(body, stop, inner, full)

    def _ts_body(self, i: int, end: int) -> int | None:
        """The brace of a body behind arguments that end before i, past a type."""
        if self._is(i, ":"):
            i += 1
            while i < end and (self.name[i] or self.t[i] in self.words or self.t[i] in (".", "|", "[", "]", "<", ">", ",")):
                i += 1
        return i if i < end and self._is(i, "{") else None

    def _statement_end(self, i: int, end: int) -> int:
        """The semicolon or the end of the block that a statement from i on reaches first, or the end."""
        while i < end:
            if self.t[i] in (";", "{"):
                return i
            i = self.close[i] + 1 if self.t[i] in ("(", "[") else i + 1
        return end

    def _block(self, i: int, end: int, scope: list[str], fn: str | None, place: str) -> None:
        while i < end:
            j = self._declaration(i, end, scope, fn, place)
            if j is None:
                j = self._statement_end(i, end)
                if j < end and self.t[j] == "{":
                    j = min(self.close[j], end)
                self._expressions(i, min(j + 1, end), scope, fn)
                j += 1
            i = max(j, i + 1)

    def _declaration(self, start: int, end: int, scope: list[str], fn: str | None, place: str) -> int | None:
        """Behind the declaration that begins at start; None if there is none."""
        lang, i = self.lang, start
        while i < end:  # attributes, decorators, template heads and modifiers
            if self._is(i, "[") and lang in ("cpp", "csharp") and i == start or self._is(i, "#") and self._is(i + 1, "["):
                i = self.close[i + (self.t[i] == "#")] + 1
            elif self._is(i, "@") and lang == "ts":
                i = self._path(i + 1)
                i = self.close[i] + 1 if self._is(i, "(") else i
            elif self._is(i, "template"):
                i = max(self._past_arguments(i + 1), i + 1)
            elif self.t[i] in BEFORE and not (lang == "rust" and (self.t[i] == "static" or self.t[i] == "const" and not self._is(i + 1, "fn", "unsafe", "async"))) and not (lang == "ts" and self.t[i] == "const"):
                i += 1
                if self._is(i, "(") and self.t[i - 1] == "pub":
                    i = self.close[i] + 1
                elif i < end and self.string[i] and self.t[i - 1] == "extern":
                    i += 1
                    if self._is(i, "{"):
                        self._block(i + 1, min(self.close[i], end), scope, fn, place)
                        return self.close[i] + 1
            else:
                break
        if i >= end:
            return None
        word = self.t[i]
        if word in SPACES[lang]:
            j = self._path(i + 1)
            if not self._is(j, "{"):
                return self._statement_end(i, end) + 1 if self._is(j, ";") else None
            name = "".join(self.t[i + 1 : j]).replace(".", "::")
            self._block(j + 1, min(self.close[j], end), [*scope, name] if name else scope, fn, "top")
            return self.close[j] + 1
        if lang == "rust" and word == "impl":
            j = self._past_arguments(i + 1)
            body = self._statement_end(j, end)
            of = next((k + 1 for k in range(j, body) if self.t[k] == "for"), j)
            self._expressions(j, body, scope, fn)
            name = next((self.t[k] for k in range(of, body) if self.name[k]), "")
            if body < end and self.t[body] == "{":
                self._block(body + 1, min(self.close[body], end), [*scope, name], fn, "record")
                return self.close[body] + 1
            return body + 1
        if word in RECORDS[lang] and not (lang == "csharp" and word == "delegate"):
            return self._record(start, i, end, scope, fn)
        if lang == "rust":
            return self._rust(start, i, end, scope, fn)
        if lang == "ts":
            return self._ts(start, i, end, scope, fn, place)
        return self._c_like(start, i, end, scope, fn, place)

    def _record(self, start: int, i: int, end: int, scope: list[str], fn: str | None) -> int | None:
        at = i + 1
        while at < end and (self.t[at] in ("class", "struct") or self._is(at, "[") and self.lang == "cpp"):
            at = self.close[at] + 1 if self._is(at, "[") else at + 1
        if at >= end or not self.name[at]:
            return None
        path = self._path(at)
        name_at = max(k for k in range(at, path) if self.name[k] and (k == at or self.t[k - 1] == "::"))
        stop = self._statement_end(path, end)
        has_body = stop < end and self.t[stop] == "{"
        if self.lang == "cpp" and not (has_body and (path == stop or self._is(path, ":", "final", "<")) or not has_body and path == stop):
            return None  # the type of something else
        last = self.close[stop] if has_body else stop
        full = self._define(start, name_at, stop if has_body else None, last, scope, "Record", listed=has_body or self.lang != "cpp")
        self._expressions(path, stop, scope, fn)
        if has_body:
            inner = [*scope, self.t[name_at]] if "::" not in full or self.lang != "cpp" else full.split("::")
            if self.t[i] == "enum" or self.lang == "rust" and self.t[i] != "trait":
                self._expressions(stop + 1, min(last, end), inner, fn)
            else:
                self._block(stop + 1, min(last, end), inner, fn, "record")
        return last + 1

    def _rust(self, start: int, i: int, end: int, scope: list[str], fn: str | None) -> int | None:
        if self._is(i, "const", "static"):
            at = i + 1 + self._is(i + 1, "mut")
            if at < end and self.name[at] and self._is(at + 1, ":"):
                stop = self._value_end(at, end)
                self._define(start, at, None, stop, scope, "Constant")
                self._expressions(at + 1, stop, scope, fn)
                return stop + 1
            return None
        if not self._is(i, "fn") or i + 1 >= end:
            return None
        args = self._past_arguments(i + 2)
        if not self._is(args, "("):
            return None
        stop = self._statement_end(self.close[args] + 1, end)
        self._function(start, i + 1, args, stop if stop < end and self.t[stop] == "{" else None, scope, fn, end=stop)
        return (self.close[stop] if stop < end and self.t[stop] == "{" else stop) + 1

    def _value_end(self, i: int, end: int) -> int:
        while i < end and self.t[i] not in (";", ","):
            i = self.close[i] + 1 if self.t[i] in ("(", "[", "{") else i + 1
        return min(i, end)

    def _ts(self, start: int, i: int, end: int, scope: list[str], fn: str | None, place: str) -> int | None:
        while self._is(i, "get", "set", "async", "*") and not self._is(i + 1, "(", "=", ":", ";", "<"):
            i += 1
        if self._is(i, "function"):
            at = i + 1 + self._is(i + 1, "*")
            args = self._past_arguments(at + 1)
            if at < end and self.name[at] and self._is(args, "("):
                body = self._ts_body(self.close[args] + 1, end)
                stop = self._statement_end(self.close[args] + 1, end) if body is None else body
                self._function(start, at, args, body, scope, fn, end=stop)
                return (self.close[body] if body is not None else stop) + 1
            return None
        bound = self._is(i, "const", "let", "var")
        at = i + 1 if bound else i
        if not bound and place != "record" or at >= end or not (self.name[at] or self._is(at, "constructor")):
            return None
        k = at + 1
        while k < end and self.t[k] not in ("=", ";", "{", "(", "}", "=>"):
            k += 1
        if self._is(k, "("):  # a method
            body = None if bound else self._ts_body(self.close[k] + 1, end)
            if body is None and (bound or self._past_arguments(at + 1) != k):
                return None
            self._function(start, at, k, body, scope, fn, end=self.close[k])
            return (self.close[body] if body is not None else self.close[k]) + 1
        if not self._is(k, "="):
            return None
        v = k + 1 + self._is(k + 1, "async")
        v = self._past_arguments(v)
        args = v + 1 if self._is(v, "function") else v
        while self._is(v, "function") and args < end and not self._is(args, "("):
            args += 1
        arrow = self.close[args] + 1 if self._is(args, "(") else args + 1
        while arrow < end and self._is(args, "(") and not self._is(v, "function") and self.t[arrow] not in ("=>", ";", "{", "(", ")", ","):
            arrow += 1
        if not (self._is(arrow, "=>") or self._is(v, "function")):
            return None
        body = arrow + 1 if self._is(arrow, "=>") else self._ts_body(self.close[args] + 1, end)
        if body is None or body >= end:
            return None
        stop = self.close[body] if self._is(body, "{") else self._value_end(body, end)
        if self._is(args, "("):
            self._function(start, at, args, body, scope, fn, end=stop)
        else:
            full = self._define(start, at, body, stop, scope, "Function")
            self._expressions(args, body, scope, full)
            self._block(body + 1, stop, [*scope, self.t[at]], full, "body") if self._is(body, "{") else self._expressions(body, stop, [*scope, self.t[at]], full)
        return stop + (not self._is(body, "{") or 1)

    def _c_like(self, start: int, i: int, end: int, scope: list[str], fn: str | None, place: str) -> int | None:
        """Functions and properties of C++ and C#: a type, a name, arguments, and a body or none."""
        lang, k, at = self.lang, i, None
        while k < end and self.t[k] not in (";", "{", "}", "=", "=>", ":") and not self.string[k]:
            if self.t[k] == "operator" and lang == "cpp":
                at = k
                k += 1
                while k < end and not (self._is(k, "(") and not (k == at + 1 and self._is(k + 1, ")"))):
                    k += 1
                break
            if self.t[k] == "(":
                break
            j = self._path(k) if lang == "cpp" else self._past_arguments(k + 1) if self.name[k] else k
            if self.name[k]:
                at, k = k, max(j, k + 1)
                if lang == "cpp":
                    k = max(self._past_arguments(k), k)
                continue
            at = None if self.t[k] not in ("~",) else at
            k = self.close[k] + 1 if self.t[k] == "[" else k + 1
        if k >= end or at is None:
            return None
        if self.t[k] != "(":
            if lang == "csharp" and place == "record" and at > i and self._is(k, "{", "=>") and self.name[at]:  # a property
                stop = self.close[k] if self.t[k] == "{" else self._value_end(k, end)
                self._expressions(i, at, scope, fn)
                full = self._define(start, at, k, stop, scope, "Property")
                self._expressions(k, stop, scope, full)
                return stop + 1
            return None
        head = at
        if lang == "cpp" and at > i and self.t[at - 1] == "~":
            head = at - 1
        names = [self.t[m] for m in range(at, k) if self.name[m] and (m == at or self.t[m - 1] in ("::", "~"))] if self.t[at] != "operator" else ["".join(self.t[at:k])]
        names[-1] = "~" * (head < at or self._is(k - 2, "~")) + names[-1]
        name = "::".join(names)
        built = place == "record" and scope and names[-1].lstrip("~") == scope[-1].rsplit("::", 1)[-1] or len(names) > 1 and names[-1].lstrip("~") == names[-2]
        typed = head > i
        if not (typed or built or head > start and place == "record") or place == "body" and lang == "cpp":
            return None
        j = self.close[k] + 1
        while j < end and self.t[j] not in (";", "{", "=>", "=", ","):
            if self.t[j] == ":" and lang == "cpp":  # initialisers
                j += 1
                while j < end and self.t[j] != ";":
                    if self.t[j] == "{" and not (self.name[j - 1] or self.t[j - 1] == ">"):
                        break
                    j = self.close[j] + 1 if self.t[j] in ("(", "[", "{") else j + 1
                break
            j = self.close[j] + 1 if self.t[j] in ("(", "[") else j + 1
        if j >= end or self._is(j, ",") or lang == "csharp" and place == "body" and not self._is(j, "{", "=>"):
            return None
        self._expressions(i, head, scope, fn)
        last = next((m for m in range(k - 1, at - 1, -1) if self.name[m]), at)
        if self._is(j, "{"):
            self._function(start, last, k, j, scope, fn, name)
            return self.close[j] + 1
        if self._is(j, "=>"):
            stop = self._value_end(j, end)
            self._function(start, last, k, j, scope, fn, name, stop)
            return stop + 1
        stop = self._statement_end(j, end)
        self._define(start, last, None, stop, scope, "Function", name, listed=lang == "csharp")
        self._expressions(k, stop, scope, fn)
        return stop + 1


def rows(text: str, lang: str) -> tuple[list[dict], list[dict], list[dict]]:
    """Definitions, occurrences and call edges; nothing of a file whose brackets nest too deeply to be read."""
    try:
        s = Source(text, lang)
    except RecursionError:
        return [], [], []
    return s.defs, s.occ, s.edges
