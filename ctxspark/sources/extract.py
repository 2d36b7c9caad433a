"""Parsers of one file's text into rows: Markdown sections and links, definitions, occurrences and call edges of source code.

They hold state from line to line (fences, heading stacks, brace depth), so they are Python; Spark applies them to Arrow
batches of files with ``mapInPandas``. Python is parsed by its own syntax tree, C-family languages, Rust, TypeScript and C# by `trees`.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

from . import trees

#: Languages by extension, and folders that are never entered.
LANGUAGES = {
    "cpp": "h hpp hh cpp cc cxx", "rust": "rs", "python": "py pyi", "daslang": "das", "glsl": "glsl vert frag comp geom tesc tese vs fs",
    "ts": "ts mts cts js mjs cjs", "tsx": "tsx", "svelte": "svelte", "csharp": "cs",
}
PRUNED = [".git", "build", "vendor", "target", "node_modules", ".cache", "bin", "obj", "publish", ".wineprefix", "pacman-overlay", "__pycache__"]
BY_EXTENSION = {e: lang for lang, es in LANGUAGES.items() for e in es.split()}


def language(path: str) -> str | None:
    return BY_EXTENSION.get(path.rsplit(".", 1)[-1].lower()) if "." in path.rsplit("/", 1)[-1] else None


def slug(heading: str) -> str:
    return re.sub(r"[^\w]+", "-", heading.lower()).strip("-") or "section"


def front_matter(text: str) -> tuple[dict[str, str], list[str], int]:
    """Values, tags and the number of lines of the block between `---` lines at the top."""
    lines = text.split("\n")
    if not lines or lines[0].strip() != "---":
        return {}, [], 0
    values: dict[str, str] = {}
    tags: list[str] = []
    key = ""
    for i, line in enumerate(lines[1:], 1):
        if line.strip() == "---":
            return values, list(dict.fromkeys(tags)), i + 1
        item = re.match(r"\s*-\s+(.*)", line)
        pair = re.match(r"([\w-]+):\s*(.*)", line)
        if item and key == "tags":
            tags.append(item[1].strip().strip("\"'"))
        elif pair:
            key = pair[1]
            values[key] = pair[2].strip().strip("\"'")
            if key == "tags" and pair[2].strip():
                tags += [t.strip().strip("\"'") for t in pair[2].strip().strip("[]").split(",") if t.strip()]
    return {}, [], 0


def sections(text: str) -> Iterator[dict]:
    """Sections between ATX headings outside fences; what stands before the first one has level 0. Equal slugs of a file get
    ordinals. Closing hashes are dropped; setext headings aren't headings."""
    values, tags, skip = front_matter(text)
    lines = text.split("\n")
    stack: list[tuple[int, str]] = []
    seen: dict[str, int] = {}
    fence = ""
    now = {"heading": "", "heading_level": 0, "heading_path": [], "start_line": skip + 1}
    body: list[str] = []
    out = []

    def close(end: int) -> None:
        if now["heading_level"] or "".join(body).strip():
            s = slug(now["heading"])
            seen[s] = seen.get(s, 0) + 1
            out.append(now | {"anchor": s if seen[s] == 1 else f"{s}#{seen[s]}", "ordinal": seen[s], "end_line": end, "body": "\n".join(body).strip("\n"), "tags": tags})

    for i, line in enumerate(lines[skip:], skip + 1):
        mark = re.match(r" {0,3}(`{3,}|~{3,})(.*)", line)
        if fence:
            if mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence) and not mark[2].strip():
                fence = ""
        elif mark and not (mark[1][0] == "`" and "`" in mark[2]):
            fence = mark[1]
        elif head := re.match(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$", line):
            close(i - 1)
            level, name = len(head[1]), (head[2] or "").strip()
            while stack and stack[-1][0] >= level:
                stack.pop()
            stack.append((level, name))
            now = {"heading": name, "heading_level": level, "heading_path": [n for _, n in stack], "start_line": i}
            body = []
            continue
        body.append(line)
    close(len(lines))
    yield from out


def links(text: str) -> Iterator[dict]:
    """Wiki links [[target|label]] and inline links [label](target), not images, outside code; parentheses may nest."""
    i, fence = 0, False
    for line in text.split("\n"):
        if re.match(r" {0,3}(```|~~~)", line):
            fence = not fence
            continue
        if fence:
            continue
        line, i = re.sub(r"`[^`]*`", lambda m: " " * len(m[0]), line), 0
        while i < len(line):
            if line.startswith("[[", i) and (end := line.find("]]", i)) > 0:
                raw = line[i : end + 2]
                yield {"raw": raw, "target": raw[2:-2].split("|")[0].strip(), "is_external": False}
                i = end + 2
            elif line[i] == "[" and (i == 0 or line[i - 1] not in "!\\") and (mid := line.find("](", i)) > 0:
                depth, j = 1, mid + 2
                if line.startswith("<", j):
                    j = max(line.find(">", j), j)
                while j < len(line) and depth:
                    depth += {"(": 1, ")": -1}.get(line[j], 0)
                    j += 1
                if depth:
                    i += 1
                    continue
                target = line[mid + 2 : j - 1].strip()
                target = target[1 : target.find(">")] if target.startswith("<") else target.split(" ")[0]
                yield {"raw": line[i:j], "target": target, "is_external": external(target)}
                i = j
            else:
                i += 1


def external(target: str) -> bool:
    return bool(re.match(r"[A-Za-z][A-Za-z0-9+.-]+:", target)) or target.startswith("//")


def python_rows(text: str) -> tuple[list[dict], list[dict], list[dict]]:
    """Definitions, occurrences and call edges of Python source; nothing if it can't be parsed."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return [], [], []
    lines = text.split("\n")
    defs, occ, edges = [], [], []

    def name_of(node) -> str | None:
        if isinstance(node, ast.Name):
            return node.id
        return node.attr if isinstance(node, ast.Attribute) else None

    def walk(node, scope: list[str], fn: str | None) -> None:
        for child in ast.iter_child_nodes(node):
            inner, owner = scope, fn
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                kind = "Record" if isinstance(child, ast.ClassDef) else "Function"
                name = "::".join([*scope, child.name])
                defs.append({"name": name, "kind": kind, "line": child.lineno, "end_line": child.end_lineno, "signature": lines[child.lineno - 1].strip(), "has_doc": ast.get_docstring(child) is not None, "doc": ast.get_docstring(child), "exported": not child.name.startswith("_")})
                occ.append({"name": child.name, "role": "def", "line": child.lineno})
                inner = [*scope, child.name]
                owner = name if kind == "Function" else fn
            elif isinstance(child, ast.Call):
                if callee := name_of(child.func):
                    occ.append({"name": callee, "role": "call", "line": child.lineno})
                    if fn:
                        edges.append({"caller": fn, "callee": callee, "line": child.lineno, "text": lines[child.lineno - 1].strip()})
            elif isinstance(child, (ast.Name, ast.Attribute)) and not (isinstance(node, ast.Call) and node.func is child):
                occ.append({"name": name_of(child), "role": "ref", "line": child.lineno})
            walk(child, inner, owner)

    walk(tree, [], None)
    return defs, occ, edges


STRIP = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])'|`(?:\\.|[^`\\])*`", re.S)


def _blank(m: re.Match) -> str:
    s = m[0]
    return re.sub(r"[^\n]", " ", s) if s.startswith("/") else s[0] + re.sub(r"[^\n]", " ", s[1:-1]) + s[-1]


def code_rows(path: str, text: str) -> tuple[list[dict], list[dict], list[dict]]:
    lang = language(path)
    if lang == "python":
        return python_rows(text)
    if lang == "svelte":
        keep = [False] * len(text)
        for m in re.finditer(r"<script[^>]*>(.*?)</script>", text, re.S):
            keep[m.start(1) : m.end(1)] = [True] * (m.end(1) - m.start(1))
        text, lang = "".join(c if k or c == "\n" else " " for c, k in zip(text, keep)), "ts"
    if lang == "daslang":
        found = [d | {"kind": "Function" if re.search(r"\bdef\b", d["signature"]) else "Record", "end_line": d["line"], "has_doc": False, "exported": "public" in d["signature"], "doc": None} for d in das_symbols(text)]
        return found, [{"name": d["name"], "role": "def", "line": d["line"]} for d in found], []
    return trees.rows(text, lang) if lang in ("cpp", "rust", "ts", "tsx", "csharp", "glsl") else ([], [], [])


def record_fields(text: str) -> Iterator[dict]:
    """Fields of C++ and Rust records, with the reason why one isn't plain data."""
    clean = STRIP.sub(_blank, text)
    for m in re.finditer(r"\b(?:struct|class)\s+([A-Za-z_]\w*)[^;{()]*\{", clean):
        depth, j = 1, m.end()
        while j < len(clean) and depth:
            depth += {"{": 1, "}": -1}.get(clean[j], 0)
            j += 1
        body = re.sub(r"\{[^{}]*\}", "{}", clean[m.end() : j - 1])
        n = 0
        for part in re.split(r"[;,](?![^<(]*[>)])", body):
            part = re.sub(r"\b(public|private|protected)\s*:", "", part).strip()
            rust = re.match(r"(?:pub(?:\([^)]*\))?\s+)?([a-z_]\w*)\s*:(?!:)\s*(.+)$", part, re.S)
            cpp = re.match(r"(?!using|typedef|friend|template|static)([\w:<>,\s*&]+?)\s+([A-Za-z_]\w*)\s*(?:=[^=].*|\{\})?$", part, re.S)
            if rust or cpp:
                name, ty = (rust[1], rust[2]) if rust else (cpp[2], cpp[1])
                ty = re.sub(r"\s+", " ", ty.strip())
                why = next((w for w, pat in (("pointer", r"[*&]|Box<|Rc<|Arc<"), ("string", r"\bstring\b|String"), ("container", r"vector<|Vec<|map<|HashMap<"), ("callback", r"function<|dyn ")) if re.search(pat, ty)), None)
                yield {"type": m[1], "name": name, "ty": ty, "ord": n, "non_pod_reason": why}
                n += 1


def das_symbols(text: str) -> Iterator[dict]:
    for i, line in enumerate(text.split("\n"), 1):
        if m := re.match(r"\s*(?:\[[^\]]*\]\s*)?(?:def|struct|class|enum)\s+(?:public\s+|private\s+)?([A-Za-z_]\w*)", line):
            yield {"name": m[1], "line": i, "signature": line.strip()}


def zone_names(text: str) -> Iterator[dict]:
    """Names that profilers show: the literal of a system or zone macro."""
    for m in re.finditer(r"(?:\.system(?:<[^>]*>)?|ZoneScopedN|ZoneNamedN)\(\s*(?:\w+\s*,\s*)?\"([^\"]+)\"", text):
        yield {"name": m[1], "line": text.count("\n", 0, m.start()) + 1}
