"""Text expressions: tokenizers, snippets, slugs, names, fuzzy scores and number formats. All are built-in Spark expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stop words of the search and option tokenizers.
STOP = ["the", "and", "for", "with", "that", "this", "from", "are", "was", "but", "not", "you", "your", "use", "using", "into", "when", "which", "have", "has", "its", "can"]


def tokens(text: Column) -> Column:
    """Search tokens: lower-cased runs of letters and digits of two UTF-8 bytes or more, without stop words, repeats kept."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: (F.octet_length(t) >= 2) & ~t.isin(STOP))


def option_tokens(text: Column) -> Column:
    """Option tokens: ASCII letters and digits, two or more, without stop words."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: (F.length(t) >= 2) & ~t.isin(STOP))


def idea_tokens(text: Column) -> Column:
    """Idea tokens: ASCII letters and digits, three or more; stop words stay."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: F.length(t) > 2)


def overlap(a: Column, b: Column, mode: str = "multiset") -> Column:
    """Similarity of two token arrays. `multiset` counts a's tokens that b has, repeats included, so it is asymmetric and may
    exceed 1; `set` is the Jaccard similarity of the different tokens. Empty arrays have similarity 0."""
    if mode == "set":
        both = F.size(F.array_intersect(a, b))
        value = both / F.size(F.array_union(a, b))
    else:
        both = F.size(F.filter(a, lambda t: F.array_contains(b, t)))
        value = both / (F.size(a) + F.size(b) - both)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(value)


def snippet(body: Column, terms: list[str], chars: int = 280) -> Column:
    """From the start of the line with the earliest hit of any term: `chars` characters, line breaks as spaces, trimmed, and
    " …" if the text goes on."""
    lower = F.lower(body)
    found = F.array_compact(F.array(*[F.nullif(F.locate(t, lower), F.lit(0)) for t in terms])) if terms else F.array().cast("array<int>")
    at = F.coalesce(F.array_min(found), F.lit(1))
    head = F.substring(body, F.lit(1), at - 1)
    line = at - F.length(F.substring_index(head, "\n", -1))
    rest = F.substring(body, line, F.lit(2**31 - 1))
    cut = F.regexp_replace(F.replace(F.substring(rest, F.lit(1), F.lit(chars)), F.lit("\n"), F.lit(" ")), r"^\s+|\s+$", "")
    return F.when(F.length(rest) > chars, F.concat(cut, F.lit(" …"))).otherwise(cut)


def clean(text: Column) -> Column:
    """White space squeezed, and back-ticks, stars, hashes and bars at both ends taken away."""
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(text, r"\s+", " ")), r"^[`*#|]+|[`*#|]+$", ""))


def sentence(text: Column) -> Column:
    return F.when(text.rlike(r"[.!?]$"), text).otherwise(F.concat(text, F.lit(".")))


def squeeze(text: Column, cap: int) -> Column:
    """White space squeezed and the text capped with an ellipsis."""
    one = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(one) > cap, F.concat(F.substring(one, 1, cap), F.lit("…"))).otherwise(one)


def highlight(text: Column, terms: list[str], before: str = "<mark>", after: str = "</mark>") -> Column:
    """Every hit of a term, in any case, between marks."""
    for t in terms:
        text = F.regexp_replace(text, rf"(?i)(\Q{t}\E)", f"{before}$1{after}")
    return text


def segment(name: Column) -> Column:
    """The last part of a name qualified by ``::``."""
    return F.element_at(F.split(name, "::"), -1)


def normal_symbol(name: Column, depth: int = 8) -> Column:
    """A symbol without leading ``::`` and template arguments (up to `depth` levels), reduced to its last segment."""
    name = F.regexp_replace(F.trim(name), "^(::)+", "")
    for _ in range(depth):
        name = F.regexp_replace(name, "<[^<>]*>", "")
    return segment(F.regexp_replace(name, r"\s+", ""))


def fuzzy_score(needle: str, name: Column) -> Column:
    """How near a name is to the one sought, lower is better; null if it isn't a candidate.

    0 the same, 1 but for case, 10 + difference of lengths if one ends with the other, 40 + difference if it contains it (both
    only if the longer is at most twice as long), 20 + edit distance up to 2 for similar lengths and shapes.
    """
    n, c = F.lit(needle.lower()), F.lower(name)
    size, long = len(needle), F.length(name)
    apart = F.abs(long - size)
    close = (long >= min(size, 4)) & (F.greatest(long, F.lit(size)) <= 2 * F.least(long, F.lit(size))) & (long > 0) & F.lit(size > 0)
    ends = c.endswith(n) | n.endswith(c)
    holds = F.contains(c, n) | (F.lit(size >= 4) & F.contains(n, c))
    letters = lambda x: F.array_distinct(F.filter(F.split(x, ""), lambda y: y != ""))
    shape = (F.substring(c, 1, 3) == F.substring(n, 1, 3)) & (F.least(long, F.lit(size)) >= 3) | (F.size(F.array_intersect(letters(c), letters(n))) * 2 >= F.greatest(long, F.lit(size)))
    edits = F.levenshtein(n, c, 2)
    near = F.lit(size <= 40) & long.between(4, 40) & (apart <= 2) & shape & (edits >= 0)
    score = F.when(name == needle, 0).when(c == n, 1).when(close & ends, 10 + apart).when(close & holds, 40 + apart).when(near, 20 + edits)
    return F.when(name.rlike(r"^[A-Za-z_][A-Za-z0-9_]*$"), score)


def heading_slug(text: Column) -> Column:
    s = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", "-")
    return F.coalesce(F.nullif(F.trim(s, F.lit("-")), F.lit("")), F.lit("section"))


def idea_slug(text: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(F.substring(text, 1, 64)), r"[^a-z0-9 \-_/]", ""), r"[ \-_/]+", "-")
    return F.coalesce(F.nullif(F.trim(s, F.lit("-")), F.lit("")), F.lit("idea"))


def defect_slug(text: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(F.substring(text, 1, 48)), r"[^a-z0-9 \-_]", ""), r"[ \-_]+", "-")
    return F.trim(s, F.lit("-"))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def folder(path: Column, depth: int) -> Column:
    """The first `depth` folders of a path; "." for a file at the top."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) < 2, F.lit(".")).otherwise(F.array_join(F.slice(parts, F.lit(1), F.least(F.lit(depth), F.size(parts) - 1)), "/"))


def approx_tokens(text: Column) -> Column:
    """A quarter of the UTF-8 bytes, rounded down."""
    return F.expr("0").cast("long") + F.floor(F.octet_length(text) / 4).cast("long")


def grouped(n: Column) -> Column:
    """Digits in groups below a million; two decimals and M, B, T or Q from there on."""
    short = lambda by, unit: F.concat(F.regexp_replace(F.format_string("%.2f", n / F.lit(float(by))), r"\.?0+$", ""), F.lit(unit))
    return F.when(n >= 10**15, short(10**15, "Q")).when(n >= 10**12, short(10**12, "T")).when(n >= 10**9, short(10**9, "B")).when(n >= 10**6, short(10**6, "M")).otherwise(F.format_number(n, 0))


def byte_size(n: Column) -> Column:
    """Signed bytes in binary units with one decimal."""
    a = F.abs(n)
    unit = lambda by, u: F.concat(F.format_string("%.1f", n / F.lit(float(by))), F.lit(u))
    return F.when(a >= 1 << 30, unit(1 << 30, " GiB")).when(a >= 1 << 20, unit(1 << 20, " MiB")).when(a >= 1 << 10, unit(1 << 10, " KiB")).otherwise(F.concat(n.cast("string"), F.lit(" B")))


def ago(seconds: Column) -> Column:
    s = F.greatest(seconds.cast("long"), F.lit(0))
    d, h, m = (F.floor(s / 86400).cast("long"), F.floor(s % 86400 / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"))
    return F.when(d > 0, F.format_string("%dd %dh ago", d, h)).when(h > 0, F.format_string("%dh %dm ago", h, m)).otherwise(F.format_string("%dm ago", m))


def percent(part: Column, whole: Column) -> Column:
    """One decimal; 100 only if nothing is left, so 99.95 stays 99.9."""
    text = F.format_string("%.1f", part / whole * 100)
    return F.when(whole == 0, F.lit("0")).when(part >= whole, F.lit("100")).when(text == "100.0", F.lit("99.9")).otherwise(text)


def paths_overlap(a: Column, b: Column) -> Column:
    """Equal, or one is a folder above the other."""
    return (a == b) | a.startswith(F.concat(b, F.lit("/"))) | b.startswith(F.concat(a, F.lit("/")))


def folders_above(path: Column) -> Column:
    """A path and every folder above it: two paths overlap exactly if one is in the other's array."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def doc_kind(path: Column) -> Column:
    """rule, note, lore or doc, by path."""
    p = F.lower(path)
    return F.when(p.contains("rules/") | p.endswith(".mdc"), "rule").when(p.contains("notes/"), "note").when(p.contains("lore/"), "lore").otherwise("doc")


#: Artifact kinds by extension.
ARTIFACTS = {"image": ["png", "jpg", "jpeg", "webp", "gif", "svg"], "json": ["json", "jsonl"], "log": ["log", "txt"], "trace": ["csv", "tracy"], "model": ["glb", "gltf", "blend", "obj"], "archive": ["zip", "gz", "tar", "zst"]}


def artifact_kind(path: Column) -> Column:
    ext, out = F.lower(F.substring_index(path, ".", -1)), F.lit("other")
    for kind, names in ARTIFACTS.items():
        out = F.when(ext.isin(names), F.lit(kind)).otherwise(out)
    return out


#: What the path of a secret has in it or ends with, and folders and endings of generated files.
SECRET_PARTS = [".env", "id_rsa", "credentials", "secret"]
SECRET_ENDS = [".pem", ".key"]
GENERATED_ROOTS = ["target", "build"]
GENERATED_FOLDERS = ["target", "build", "node_modules", ".cache", "__pycache__", "obj"]
GENERATED_ENDS = [".blend1"]


def looks_secret(path: Column) -> Column:
    """Whether a path has a secret's name in it, in any case."""
    p = F.lower(path)
    return reduce(or_, [F.contains(p, F.lit(x)) for x in SECRET_PARTS] + [F.endswith(p, F.lit(x)) for x in SECRET_ENDS])


def looks_generated(path: Column) -> Column:
    """Whether a file lies in a folder of generated files (for some, also at the top), or has such an ending."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    folders = F.slice(F.split(p, "/"), F.lit(1), F.size(F.split(p, "/")) - 1)
    inner = F.slice(folders, F.lit(2), F.greatest(F.size(folders) - 1, F.lit(0)))
    return F.arrays_overlap(inner, F.lit(GENERATED_FOLDERS)) | F.coalesce(F.get(folders, F.lit(0)).isin(GENERATED_ROOTS), F.lit(False)) | reduce(or_, [F.endswith(p, F.lit(x)) for x in GENERATED_ENDS])


def looks_binary(path: Column) -> Column:
    names = "png jpg jpeg webp gif blend blend1 glb gltf bkkbp dll so dylib exe wasm bin pdb a o obj".split()  # fixed values
    return F.lower(F.substring_index(path, ".", -1)).isin(names)


def outcome(ok: Column, text: Column, returned: Column, low: int = 25) -> Column:
    """What became of a call, from its answer: an error's text or a result's first line says whether nothing was found or the
    call was invalid; cut, empty and small results have outcomes of their own."""
    missing = r"not found|no definition|unsupported|no such|cannot find|cannot read|no top-level|unknown symbol|no matches|no matching|no test file"  # fixed values
    wrong = r"is required|requires[: ]|invalid |unknown mode|must be|must provide|must end with|expected "  # fixed values
    head = F.lower(F.substring_index(text, "\n", 1))
    empty_line = F.lower(text).rlike(r"(?m)\n\s*(\(no matching occurrences\)|\(no matching hooks)")
    return (
        F.when(~ok & F.lower(text).rlike(wrong), "invalid")
        .when(~ok & F.lower(text).rlike(missing), "not_found")
        .when(~ok, "error")
        .when(F.contains(text, F.lit("truncated by token_budget")) | F.contains(text, F.lit("more; raise")), "truncated")
        .when(head.rlike(missing), "not_found")
        .when(head.rlike(wrong), "invalid")
        .when(empty_line, "not_found")
        .when(returned == 0, "empty")
        .when(returned <= low, "low_yield")
        .otherwise("ok")
    )
