"""Symbols, calls and conditionals from source text of seven languages.

One scanner serves the brace languages: comments and literals are blanked out (positions
kept), brackets are matched once, then patterns find headers in the blanked text and the
matched brackets give their bodies. Python is read through its own ``ast``. Lines and
columns count from 0. A construct that the patterns do not know is skipped, never an error;
unbalanced brackets become parse-error rows.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from dataclasses import dataclass, field

# Extensions and the languages they stand for.
LANGUAGES = {
    "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript",
    "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "java": "java", "rs": "rust", "py": "python", "pyi": "python", "go": "go", "cs": "csharp",
}
JS = ("typescript", "javascript")
#: Words that look like a call or a header but are none, in every brace language and in each.
RESERVED = "if for while switch catch return new else do try throw case in super"
OWN_RESERVED = {
    "js": "function typeof await import delete void of class let const var yield async with instanceof",
    "java": "synchronized assert instanceof class interface enum",
    "csharp": "using lock fixed foreach when sizeof nameof typeof await class struct checked unchecked default",
    "rust": "fn loop match impl where let unsafe move await struct mut ref dyn as",
    "go": "func go defer select range chan var const type struct map",
}


def reserved(lang: str) -> frozenset[str]:
    return frozenset(f"{RESERVED} {OWN_RESERVED['js' if lang in JS else lang]}".split())


@dataclass
class Found:
    symbols: list[dict] = field(default_factory=list)
    calls: list[dict] = field(default_factory=list)
    conditionals: list[dict] = field(default_factory=list)
    errors: list[dict] = field(default_factory=list)


def language_of(path: str) -> str | None:
    return LANGUAGES.get(path.rsplit(".", 1)[-1]) if "." in path else None


def blanked(text: str, lang: str) -> str:
    """``text`` with comments and literals overwritten by blanks, the literals' quotes kept."""
    parts = [r"//[^\n]*", r"/\*.*?(?:\*/|\Z)"]
    if lang == "rust":
        parts += [r'r(#*)".*?"\1', r'b?"(?:\\.|[^"\\])*"', r"'(?:\\.[^']*|[^'\\\n])'"]
    elif lang == "csharp":
        parts += [r'[$@]*@[$@]*"(?:""|[^"])*"', r'\$?"(?:\\.|[^"\\\n])*"', r"'(?:\\.[^'\n]*|[^'\\\n])'"]
    elif lang == "java":
        parts += [r'""".*?"""', r'"(?:\\.|[^"\\\n])*"', r"'(?:\\.[^'\n]*|[^'\\\n])'"]
    elif lang == "go":
        parts += [r"`[^`]*`", r'"(?:\\.|[^"\\\n])*"', r"'(?:\\.[^'\n]*|[^'\\\n])'"]
    else:
        parts += [r"`(?:\\.|[^`\\])*`", r'"(?:\\.|[^"\\\n])*"', r"'(?:\\.|[^'\\\n])*'", r"(?<=[=(,:;!&|?{}\n])[ \t]*/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*"]
    keep = lambda m: "".join(c if c == "\n" else " " for c in m[0])

    def quoted(m: re.Match) -> str:
        inner = keep(m)
        return m[0][0] + inner[1:-1] + m[0][-1] if m[0][0] in "\"'`" and len(m[0]) > 1 else inner

    return re.sub("|".join(parts), quoted, text, flags=re.S)


def matched(code: str) -> tuple[dict[int, int], list[int]]:
    """Position of each opening bracket's closing one, and the positions that match nothing."""
    pairs, open_, odd = {}, [], []
    closes = {")": "(", "]": "[", "}": "{"}
    for m in re.finditer(r"[()\[\]{}]", code):
        c = m[0]
        if c in "([{":
            open_.append(m.start())
        elif open_ and code[open_[-1]] == closes[c]:
            pairs[open_.pop()] = m.start()
        else:
            odd.append(m.start())
    return pairs, [*open_, *odd]


# What may lead a header, and the header of each kind: (kind, pattern). The name is group "n".
ID = r"[A-Za-z_$][\w$]*"
_MODS = r"(?P<mods>(?:(?:public|private|protected|internal|static|final|abstract|async|override|virtual|readonly|sealed|partial|synchronized|native|default|unsafe|extern|new|export|declare|get|set|const|accessor)\s+)*)"
_TYPE = r"(?:[A-Za-z_][\w.]*(?:\s*<[^;{}()]*?>)?(?:\s*\[\s*\])*\??\s+)"
HEADERS: dict[str, list[tuple[str, str]]] = {
    "js": [
        ("class", rf"(?P<mods>(?:export\s+|default\s+|abstract\s+|declare\s+)*)\bclass\s+(?P<n>{ID})"),
        ("function", rf"(?P<mods>(?:export\s+|default\s+|declare\s+|async\s+)*)\bfunction\s*\*?\s*(?P<n>{ID})?\s*(?:<[^>(]*>)?\s*\("),
        ("function", rf"(?P<mods>(?:export\s+)?)(?:\b(?:const|let|var)\s+)?(?P<n>{ID})\s*(?::[^=;(){{}}]*)?[=:]\s*(?:async\s+)?(?:function\b\s*\*?\s*(?:{ID})?\s*)?(?:\((?=[^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::[^=;{{}}]+)?(?:=>|\{{))|{ID}\s*=>)"),
        ("method", rf"(?m:^)[ \t]*(?P<mods>(?:(?:public|private|protected|static|async|override|readonly|abstract|get|set|\*)\s+)*)\*?(?P<n>#?{ID})\s*(?:<[^>(]*>)?\((?=[^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::[^=;{{}}]+)?\{{)"),
        ("function", r"(?P<mods>)(?P<n>)(?<=[(,=>?:&|\[])\s*(?:async\s+)?\((?=[^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::[^=;{}()]+)?=>)"),
        ("function", rf"(?P<mods>)(?P<n>)(?<=[(,?&|\[])\s*(?:async\s+)?{ID}\s*=>"),
    ],
    "java": [
        ("class", rf"{_MODS}\bclass\s+(?P<n>{ID})"),
        ("constructor", rf"(?<=[{{}};\n)])[ \t]*{_MODS}(?P<n>[A-Z]\w*)\s*\((?=[^()]*(?:\([^()]*\)[^()]*)*\)\s*(?:throws\s+[\w.,\s]+)?\{{)"),
        ("method", rf"{_MODS}(?:<[^>]*>\s*)?{_TYPE}(?P<n>{ID})\s*\((?=[^()]*(?:\([^()]*\)[^()]*)*\)\s*(?:throws\s+[\w.,\s]+)?[{{;])"),
    ],
    "csharp": [
        ("class", rf"{_MODS}\bclass\s+(?P<n>{ID})"),
        ("constructor", rf"(?<=[{{}};\n)])[ \t]*{_MODS}(?P<n>[A-Z]\w*)\s*\((?=[^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::\s*(?:base|this)\s*\([^)]*\)\s*)?\{{)"),
        ("method", rf"{_MODS}{_TYPE}(?P<n>{ID})\s*(?:<[^>(]*>)?\((?=[^()]*(?:\([^()]*\)[^()]*)*\)\s*(?:where[^{{;]*)?(?:[{{;]|=>))"),
    ],
    "rust": [
        ("class", r"(?P<mods>(?:pub(?:\([^)]*\))?\s+)?)\bstruct\s+(?P<n>\w+)"),
        ("class", r"(?P<mods>)\bimpl\b(?:\s*<[^{]*?>)?\s+(?:[\w:<>,' ]+?\s+for\s+)?(?P<n>\w+(?:<[^{]*?>)?)(?=\s*(?:where[^{]*)?\{)"),
        ("function", r"(?P<mods>(?:pub(?:\([^)]*\))?\s+)?)(?:(?:const|async|unsafe|extern\s*(?:\"[^\"]*\")?)\s+)*\bfn\s+(?P<n>\w+)"),
    ],
    "go": [
        ("function", r"(?P<mods>)(?m:^)func\s+(?P<n>\w+)\s*(?:\[[^\]]*\])?\("),
        ("method", r"(?P<mods>)(?m:^)func\s*\([^)]*\)\s*(?P<n>\w+)\s*\("),
    ],
}

# Looked for at a place of the code, never in a copy of its rest: what a file costs follows its length.
GOES_ON, JOINED = re.compile(r"\s*[.?:&|+\-*/=,)\]]"), re.compile(r"\s*[.?:&|+\-*/]")
TYPED = re.compile(r">\s*(?:\?\.|\.|::|->)\s*$")
NO_HEADER, EXPORTED = re.compile(r"\s*(?:return|else|throw|new|await|case)\b"), re.compile(r"(?:\s*(?:export|default|declare)\s+)*")


class Scanner:
    def __init__(self, path: str, text: str, lang: str):
        self.path, self.text, self.lang = path, text, lang
        self.code = blanked(text, lang)
        self.pairs, odd = matched(self.code)
        self.back = {b: a for a, b in self.pairs.items()}
        self.breaks = [m.start() for m in re.finditer("\n", text)]
        self.odd, self.words = odd, reserved(lang)

    def line(self, at: int) -> int:
        return bisect_right(self.breaks, at - 1) if at else 0

    def column(self, at: int) -> int:
        n = self.line(at)
        return at - (self.breaks[n - 1] + 1 if n else 0)

    def skip(self, at: int) -> int:
        while at < len(self.code) and self.code[at].isspace():
            at += 1
        return at

    def block_end(self, at: int) -> int:
        """End of the statement or block that begins at ``at``."""
        at = self.skip(at)
        if at < len(self.code) and self.code[at] == "{":
            return self.pairs.get(at, len(self.code) - 1)
        m = re.compile(r"(?:if|for|while|switch|match)\b").match(self.code, at)
        if m:
            inner = self.if_parts(at)[1] if m[0] == "if" else self.body_of(m.end())
            return inner
        return self.statement_end(at)

    def statement_end(self, at: int) -> int:
        while at < len(self.code):
            c = self.code[at]
            if c in "([{":
                at = self.pairs.get(at, len(self.code) - 1)
            elif c == ";" or c in ")]}":
                return at if c == ";" else at - 1
            elif c == "\n" and self.lang in (*JS, "go") and not GOES_ON.match(self.code, at):
                return at - 1
            at += 1
        return len(self.code) - 1

    def body_of(self, at: int) -> int:
        """End of the block after a header that begins at ``at``, skipping its brackets."""
        while at < len(self.code):
            c = self.code[at]
            if c == "{":
                return self.pairs.get(at, len(self.code) - 1)
            if c == ";":
                return at
            if c in "([":
                at = self.pairs.get(at, at)
            at += 1
        return len(self.code) - 1

    def if_parts(self, at: int) -> tuple[int, int, int, str]:
        """(branches, end, start of the first block, condition) of the if at ``at``; an else-if counts as one more branch."""
        head = at + 2
        if self.lang in ("rust", "go"):
            start = head
            while start < len(self.code) and self.code[start] != "{":
                start = self.pairs.get(start, start) + 1 if self.code[start] in "([" else start + 1
            condition, block = self.text[head:start].strip(), start
        else:
            open_ = self.skip(head)
            close = self.pairs.get(open_, open_) if open_ < len(self.code) and self.code[open_] == "(" else open_
            condition, block = self.text[open_ + 1 : close].strip(), close + 1
        end, branches = self.block_end(block), 1
        m = re.compile(r"\s*else\b\s*").match(self.code, end + 1)
        if m:
            branches, end = 2, self.block_end(m.end())
        return branches, end, block, condition

    def headers(self) -> list[tuple[str, int, int, int, str, str]]:
        """(kind, start, end, position of the name, name, modifiers), outermost first."""
        found, taken = [], set()
        key = "js" if self.lang in JS else self.lang
        for kind, pattern in HEADERS[key]:
            for m in re.finditer(pattern, self.code):
                name = m["n"] or ""
                if name in self.words or m.end() in taken:
                    continue
                mods = m["mods"] or ""
                start = m.start() + len(m[0]) - len(m[0].lstrip())
                if kind in ("method", "constructor") and NO_HEADER.match(self.code, m.start()):
                    continue
                if re.search(r"\b(?:export|default|declare)\s*$", mods) or mods.startswith("export"):
                    start = EXPORTED.match(self.code, m.start()).end()
                taken.add(m.end())
                found.append([kind, start, self.end_of(kind, m), m.start("n") if m["n"] else start, name, mods])
        return sorted(found, key=lambda f: (f[1], -f[2]))

    def end_of(self, kind: str, m: re.Match) -> int:
        at = m.end()
        if self.code[at - 1] == "(":  # the parameters
            at = self.pairs.get(at - 1, at - 1) + 1
        tail = re.compile(r"\s*(?::[^=;{}]+)?=>\s*").match(self.code, at) or (re.match(r"\s*", self.code[at:at]) if m[0].rstrip().endswith("=>") else None)
        if self.code[m.end() - 2 : m.end()] == "=>" or tail:
            at = tail.end() if tail and tail.end() > at else self.skip(at)
            if self.code[at : at + 1] == "{":
                return self.pairs.get(at, len(self.code) - 1)
            return self.statement_end_before_comma(at)
        return self.body_of(at)

    def statement_end_before_comma(self, at: int) -> int:
        while at < len(self.code):
            c = self.code[at]
            if c in "([{":
                at = self.pairs.get(at, len(self.code) - 1)
            elif c in ",;)]}" or c == "\n" and not JOINED.match(self.code, at):
                return at - 1
            at += 1
        return len(self.code) - 1

    def visibility(self, name: str, mods: str) -> str:
        if self.lang == "go":
            return "public" if name[:1].isupper() else "default"
        if self.lang == "rust":
            return "public" if "pub" in mods else "default"
        words = mods.split()
        if self.lang in JS and "export" in words:
            return "public"
        return next((w for w in ("public", "private", "protected") if w in words), "default")

    def symbols(self) -> list[dict]:
        out, classes = [], []
        for kind, start, end, at, name, mods in self.headers():
            classes = [c for c in classes if c[1] >= start]
            inside = classes[-1][0] if classes else None
            if self.lang in JS and kind == "method":
                kind = "constructor" if name == "constructor" else "getter" if "get" in mods.split() else "setter" if "set" in mods.split() else "method"
            name = name or "<anonymous>"
            out.append({"name": name, "qualified_name": f"{inside}.{name}" if inside and kind != "class" else name, "kind": kind, "file_path": self.path, "line": self.line(start), "column": self.column(start),
                        "signature": self.text[start : end + 1].split("\n")[0], "body_start": self.line(start), "body_end": self.line(end), "visibility": self.visibility(name, mods), "_at": at})
            if kind == "class":
                classes.append((name, end))
        return out

    def before(self, at: int) -> str:
        """The last character before ``at`` that is no white space."""
        at -= 1
        while at >= 0 and self.code[at].isspace():
            at -= 1
        return self.code[at] if at >= 0 else ""

    def dotted(self, at: int) -> bool:
        """Whether a dot, a double colon or an arrow stands before ``at``."""
        at -= 1
        while at >= 0 and self.code[at].isspace():
            at -= 1
        return at >= 0 and (self.code[at] == "." or self.code[max(0, at - 1) : at + 1] in ("::", "->"))

    def ending(self, pattern: str, end: int) -> re.Match | None:
        """The match of ``pattern`` that ends at ``end``, looked for in windows that grow until it lies inside one.

        What is not found grows its window only where it may begin before it: behind white
        space alone, or behind the types in angle brackets that stand before a dot.
        """
        find, size = re.compile(pattern), 256
        while True:
            low = max(0, end - size)
            m = find.search(self.code, low, end)
            if low == 0 or m and m.start() > low:
                return m
            if m is None and not self.code[low:end].isspace() and not ("<" in pattern and TYPED.search(self.code, low, end)):
                return None
            size *= 4

    def leading(self, pattern: str, end: int) -> re.Match | None:
        """As :meth:`ending`, for a pattern that finds something in nearly any code: the window grows until it does."""
        find, size = re.compile(pattern), 256
        while True:
            low = max(0, end - size)
            m = find.search(self.code, low, end)
            if low == 0 or m and m.start() > low:
                return m
            size *= 4

    def calls(self, named: set[int]) -> list[dict]:
        found = []
        sep = r"(?:\s*(?:\?\.|\.|::|->)\s*)"
        for m in re.finditer(rf"({ID})\s*(?:::)?(?:<[\w\s,.<>\[\]?:&']*>)?\s*\(", self.code):
            name, at = m[1], m.start(1)
            if name in self.words or at in named or self.code[m.end() - 2] == "!":
                continue
            start = at
            while True:  # the receiver: names and bracketed parts joined by dots
                left = self.ending(rf"(?:({ID})|([)\]]))\s*(?:<[^<>]*>)?{sep}$", start) if self.dotted(start) else None
                if not left:
                    break
                if left[1]:
                    start = left.start(1)
                else:
                    start = self.back.get(left.start(2), left.start(2))
                    lead = self.ending(rf"({ID})\s*$", start)
                    if lead and lead[1] not in self.words:
                        start = lead.start(1)
                if start == 0:
                    break
            if self.ending(r"\b(?:new|function|fn|func|class|let)\s*\*?\s*$", start) or self.lang == "rust" and self.before(m.end() - 1) == "!":
                continue
            text = re.sub(r"\s+", " ", self.text[start : m.end(1)]).strip()
            if self.lang in JS:
                text = re.sub(r"^(?:this|self)\.(?=[\w$]+$)", "", text)
            elif self.lang == "java":
                text = re.sub(r"\s*\.\s*", ".", text)
            found.append((start, -self.pairs.get(m.end() - 1, m.end() - 1), {"callee_name": text, "file_path": self.path, "line": self.line(start), "column": self.column(start), "name_column": self.column(at)}))
        return [c for *_, c in sorted(found, key=lambda f: f[:2])]  # outer calls first, as in a walk from the root

    def conditionals(self) -> list[dict]:
        found = []

        def add(kind: str, at: int, end: int, branches: int, condition: str) -> None:
            found.append({"kind": kind, "file_path": self.path, "line": self.line(at), "column": self.column(at), "end_line": self.line(end), "branches": branches, "condition_text": condition, "_at": at})

        for m in re.finditer(r"\bif\b", self.code):
            if self.ending(r"\belse\s*$", m.start()):
                continue  # an else-if belongs to its first if
            branches, end, _, condition = self.if_parts(m.start())
            add("if", m.start(), end, branches, condition)
        for m in re.finditer(r"\bmatch\b(?=[^;{}]*\{)" if self.lang == "rust" else r"\bswitch\b", self.code):
            end = self.body_of(m.end())
            open_ = self.back.get(end, end)
            body = self.code[open_ + 1 : end]
            depth = re.sub(r"\([^()]*\)|\[[^\[\]]*\]", "", body)
            while re.search(r"\{[^{}]*\}", depth):
                depth = re.sub(r"\{[^{}]*\}", ";", depth)
            cases = len(re.findall(r"=>", depth)) if self.lang == "rust" else len(re.findall(r"\b(?:case|default)\b(?!\s*\()", depth))
            add("match" if self.lang == "rust" else "switch", m.start(), end, cases or 2, self.text[m.end() : open_].strip().removeprefix("(").removesuffix(")").strip())
        if self.lang in (*JS, "java", "csharp"):
            for m in re.finditer(r"(?<![?.])\?(?![?.:>,)\]])", self.code):
                rest = self.code[m.end() : self.statement_end(m.end()) + 1]
                if not re.search(r":(?!:)", re.sub(r"\{[^{}]*\}", "", rest)) or re.match(r"\s*(?:extends|super)\b", rest):
                    continue  # a label's or an optional's mark, or the wildcard of a generic type
                lead = self.leading(r"(?:^|[=(,;{}\[]|\breturn\b|=>)([^=(,;{}\[]*(?:\([^()]*\)[^=(,;{}\[]*)*)$", m.start())
                if lead and re.search(r"\bextends\b", lead[1]):
                    continue  # a type that hangs on another
                start = m.start() - len(re.sub(r"^\s*(?:return\b|=>)?\s*", "", lead[1])) if lead else m.start()
                add("ternary", start, m.end() + len(rest.rstrip()) - 1, 2, self.text[start : m.start()].strip())
        found.sort(key=lambda f: f["_at"])
        return [{k: v for k, v in f.items() if k != "_at"} for f in found]


def _python(path: str, text: str) -> Found:
    out = Found()
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError) as e:
        out.errors.append({"file_path": path, "line": (getattr(e, "lineno", 1) or 1) - 1, "column": max(0, (getattr(e, "offset", 1) or 1) - 1), "message": str(getattr(e, "msg", e))})
        return out
    rows = text.split("\n")
    lines = re.findall(r"[^\r\n]*(?:\r\n|\n|\r)|[^\r\n]+\Z", text)

    def segment(node: ast.expr) -> str:
        """The node's source, as ``ast.get_source_segment`` has it, which splits the whole text for each node."""
        own = [x.encode() for x in lines[node.lineno - 1 : node.end_lineno]]
        own[-1] = own[-1][: node.end_col_offset]
        return b"".join([own[0][node.col_offset :], *own[1:]]).decode()

    def visit(node: ast.AST, cls: str | None) -> None:
        here = cls
        if isinstance(node, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
            is_class, name = isinstance(node, ast.ClassDef), node.name
            seen = "public" if name.startswith("__") and name.endswith("__") or not name.startswith("_") else "private" if name.startswith("__") else "protected"
            out.symbols.append({"name": name, "qualified_name": f"{cls}.{name}" if cls and not is_class else name, "kind": "class" if is_class else "method" if cls else "function", "file_path": path, "line": node.lineno - 1, "column": node.col_offset,
                                "signature": rows[node.lineno - 1][node.col_offset :], "body_start": node.lineno - 1, "body_end": node.end_lineno - 1, "visibility": seen})
            here = name if is_class else cls
        elif isinstance(node, ast.Call):
            at = node.func.end_col_offset - len(node.func.attr) if isinstance(node.func, ast.Attribute) else node.func.col_offset
            out.calls.append({"callee_name": segment(node.func), "file_path": path, "line": node.lineno - 1, "column": node.col_offset, "name_column": at})
        elif isinstance(node, ast.If):
            branches, last = 1, node
            while last.orelse:
                branches += 1
                if len(last.orelse) == 1 and isinstance(last.orelse[0], ast.If) and rows[last.orelse[0].lineno - 1].lstrip().startswith("elif"):
                    last = last.orelse[0]
                else:
                    break
            out.conditionals.append({"kind": "if", "file_path": path, "line": node.lineno - 1, "column": node.col_offset, "end_line": node.end_lineno - 1, "branches": branches, "condition_text": segment(node.test)})
        elif isinstance(node, ast.Match):
            out.conditionals.append({"kind": "match", "file_path": path, "line": node.lineno - 1, "column": node.col_offset, "end_line": node.end_lineno - 1, "branches": len(node.cases) or 2, "condition_text": segment(node.subject)})
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.If) and isinstance(node, ast.If) and child in node.orelse and len(node.orelse) == 1 and rows[child.lineno - 1].lstrip().startswith("elif"):
                for inner in ast.iter_child_nodes(child):  # an elif is no conditional of its own
                    visit_else(child, inner, here)
            else:
                visit(child, here)

    def visit_else(owner: ast.If, child: ast.AST, cls: str | None) -> None:
        if isinstance(child, ast.If) and len(owner.orelse) == 1 and child is owner.orelse[0] and rows[child.lineno - 1].lstrip().startswith("elif"):
            for inner in ast.iter_child_nodes(child):
                visit_else(child, inner, cls)
        else:
            visit(child, cls)

    visit(tree, None)
    return out


def scan(path: str, text: str, lang: str, kinds: tuple[str, ...] = ("symbols", "calls", "conditionals")) -> Found:
    """Never raises: what cannot be read becomes an error row. Only ``kinds`` are looked for in a brace language, and its symbols where its calls are."""
    if lang not in {*LANGUAGES.values()}:
        return Found(errors=[{"file_path": path, "line": 0, "column": 0, "message": f"Unsupported language: {lang}"}])
    try:
        if lang == "python":
            found = _python(path, text)
            return Found(*[getattr(found, k) if k in kinds else [] for k in ("symbols", "calls", "conditionals")], found.errors)
        s = Scanner(path, text, lang)
        symbols = s.symbols() if {"symbols", "calls"} & set(kinds) else []
        named = {x.pop("_at") for x in symbols}
        errors = [{"file_path": path, "line": s.line(at), "column": s.column(at), "message": "Unmatched bracket"} for at in s.odd[:1]]
        return Found(symbols if "symbols" in kinds else [], s.calls(named) if "calls" in kinds else [], s.conditionals() if "conditionals" in kinds else [], errors)
    except RecursionError:
        return Found(errors=[{"file_path": path, "line": 0, "column": 0, "message": "Nested too deeply"}])


# Imports: by lines, as text.


def quoted(text: str) -> str | None:
    """The first text in double, else single quotes, else backticks."""
    return next((m[1] for q in "\"'`" if (m := re.search(f"{q}([^{q}]*){q}", text))), None)


def _named(inner: str, pick) -> list[str]:
    return [n for part in inner.split(",") if (n := pick(part.strip()))]


def imports(path: str, text: str, lang: str) -> list[dict]:
    out: list[dict] = []
    add = lambda source, names: out.append({"source": source, "specifiers": names, "file_path": path})
    last = lambda s: re.split(r"\.|::", s)[-1].strip()
    block = False
    for raw in text.splitlines():
        row = raw.strip()
        if lang in JS:
            if row.startswith("import ") and (source := quoted(row)) is not None:
                rest = row[7:]
                if m := re.search(r"\{([^}]*)\}", rest):
                    names = _named(m[1], lambda p: p.split(" as ", 1)[1].strip() if " as " in p else p)
                elif m := re.search(r"\* as (\S+) ", rest):
                    names = [m[1]]
                else:
                    name = rest.split(" from ")[0].strip().removeprefix("type ") if " from " in rest else ""
                    names = [name] if name and not re.search(r"[{*]", name) else []
                add(source, names)
            if "require(" in row and (source := quoted(row.split("require(", 1)[1])) is not None:
                names, lead = [], row.split("=", 1)[0].strip() if "=" in row else ""
                if lead.startswith("const "):
                    name = lead[6:].strip()
                    names = _named(name[1:-1], lambda p: p) if name.startswith("{") and name.endswith("}") else [name]
                add(source, names)
        elif lang == "python":
            if m := re.match(r"from\s+(\S+)\s+import\s+(.*)", row):
                add(m[1], [n for n in _named(m[2].strip("() "), lambda p: p.split(" as ")[-1].strip()) if n != "*"])
            elif row.startswith("import "):
                for part in row[7:].split(","):
                    module = part.split(" as ")[0].strip()
                    if module:
                        add(module, [module])
        elif lang in ("java", "csharp"):
            word = "import " if lang == "java" else "using "
            if row.startswith(word) and row.endswith(";") and not (lang == "csharp" and ("=" in row or "(" in row)):
                source = row[len(word) : -1].strip().removeprefix("static ").strip()
                add(source, [last(source)])
        elif lang == "rust":
            if row.startswith("use ") and row.endswith(";"):
                path_ = row[4:-1].strip()
                before, brace, inner = path_.partition("{")
                if not brace:
                    add(path_, [path_.rsplit("::", 1)[-1]])
                elif "}" in inner:
                    add(before.removesuffix("::"), _named(inner.split("}")[0], lambda p: p))
        elif lang == "go":
            if re.match(r"import\s*\(", row):
                block = True
            elif block and row.startswith(")"):
                block = False
            elif (block or row.startswith("import ")) and (source := quoted(row)) is not None:
                add(source, [source.rsplit("/", 1)[-1]])
    return out
