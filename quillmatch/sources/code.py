"""Source texts to tokens, trees, functions and symbols. Python goes through the standard library's parser, HTML through
its HTML parser; Rust, Kotlin, C++ and TypeScript through a lexer and an island parser that knows declarations, control
flow, calls, names, literals and operators. Node counts can differ from a full grammar's; all else works on what is here.

Every function takes texts in Arrow batches, as none of this can be said in column expressions."""

from __future__ import annotations

import ast
import re
import sys
from collections import Counter
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..arrow import small_batches
from ..operators.trees import NODE_SCHEMA, OPERATOR_TOKENS, rows

BLOCK, IF, FOR, WHILE, SWITCH, RETURN, BREAK, CONTINUE, TRY, THROW, LAMBDA = 0, 1, 2, 3, 4, 5, 8, 7, 9, 10, 45
CALL, VARIABLE, NUMBER, STRING, FUNCTION, CLASS, STRUCT, ENUM, INTERFACE, VAR_DECL, PARAM, IMPORT, PACKAGE, OTHER, UNKNOWN = 43, 50, 51, 52, 60, 61, 62, 63, 64, 65, 66, 81, 82, 85, 99
KEYWORDS = {
    "if": IF, "else": BLOCK, "for": FOR, "while": WHILE, "loop": WHILE, "do": WHILE, "match": SWITCH, "when": SWITCH, "switch": SWITCH, "return": RETURN, "break": BREAK, "continue": CONTINUE,
    "try": TRY, "catch": TRY, "throw": THROW, "raise": THROW, "let": VAR_DECL, "val": VAR_DECL, "var": VAR_DECL, "const": VAR_DECL, "static": VAR_DECL, "use": IMPORT, "import": IMPORT, "package": PACKAGE, "mod": PACKAGE, "namespace": PACKAGE,
}
TYPES = {"class": CLASS, "struct": STRUCT, "enum": ENUM, "trait": INTERFACE, "interface": INTERFACE, "object": CLASS, "union": STRUCT, "impl": PACKAGE}
STARTERS = {"rust": ("fn",), "kotlin": ("fun",), "typescript": ("function",), "cpp": ()}
_OP = {t: k for k, tokens in OPERATOR_TOKENS.items() for t in tokens if not t.isalpha()}
#: Rows that a worker gathers before it hands them on.
PART_ROWS = 1 << 13
STUB_BODY = re.compile(r"\b(todo|unimplemented|unreachable)!|\bTODO\(|NotImplementedError|error\(\"not implemented", re.I)
MARK = re.compile(r"(?<![a-z0-9_])(todo|stub|placeholder|fixme|unimplemented|notimplemented|notimplementederror)(?![a-z0-9_])|not (yet )?implemented", re.I)


_RAW_STRING, _LIFETIME, _NUMBER, _NAME = (re.compile(x) for x in (r'b?r(#*)"', r"'[A-Za-z_]\w*(?!')", r"[0-9][\w.]*", r"(r#)?[A-Za-z_]\w*"))
_SIGN = re.compile(r"::|\?\.|->|=>|===|!==|[=!<>+\-*/%&|^]=|&&|\|\||\+\+|--|<<|>>")


def lex(text: str, lang: str) -> list[tuple[str, str, int]]:
    """(kind, text, line): comment, string, number, name, op. Block comments nest; an unclosed one ends with the text."""
    out, i, line, n = [], 0, 1, len(text)
    while i < n:
        c = text[i]
        start = i
        if c.isspace():
            i += 1
            line += c == "\n"
            continue
        if text.startswith("//", i):
            i = text.find("\n", i)
            i = n if i < 0 else i
            kind = "comment"
        elif text.startswith("/*", i):
            depth, i = 1, i + 2
            while i < n and depth:
                if text.startswith("/*", i):
                    depth, i = depth + 1, i + 2
                elif text.startswith("*/", i):
                    depth, i = depth - 1, i + 2
                else:
                    i += 1
            kind = "comment"
        elif lang == "rust" and (m := _RAW_STRING.match(text, i)):
            end = text.find('"' + m[1], m.end())
            i, kind = (n if end < 0 else end + 1 + len(m[1])), "string"
        elif lang == "kotlin" and text.startswith('"""', i):
            end = text.find('"""', i + 3)
            i, kind = (n if end < 0 else end + 3), "string"
        elif c == "'" and lang == "rust" and (m := _LIFETIME.match(text, i)):
            i, kind = m.end(), "lifetime"
        elif c in "\"'" or (c == "`" and lang == "typescript"):
            i += 1
            while i < n and text[i] != c and not (text[i] == "\n" and c != "`"):
                i += 2 if text[i] == "\\" else 1
            i, kind = min(n, i + 1), "string"
        elif c == "`" and lang == "kotlin":
            end = text.find("`", i + 1)
            i, kind = (n if end < 0 else end + 1), "name"
        elif m := _NUMBER.match(text, i):
            i, kind = m.end(), "number"
        elif m := _NAME.match(text, i):
            i, kind = m.end(), "name"
        elif m := _SIGN.match(text, i):
            i, kind = m.end(), "op"
        else:
            i, kind = i + 1, "op"
        out.append((kind, text[start:i], line))
        line += text.count("\n", start, i)
    return out


def strip_code(text: str, lang: str = "kotlin") -> tuple[str, str]:
    """The text with comments and strings as blanks, line ends kept, and the comments without their signs."""
    comments = []
    for kind, t, _ in lex(text, lang):
        if kind == "comment":
            body = t[2:-2] if t.startswith("/*") and t.endswith("*/") and len(t) > 3 else t[2:]
            comments.append("\n".join(re.sub(r"^\s*\*+ ?", "", x) for x in body.split("\n")))
    return blanked(text, lang), "\n".join(comments)


def _of_trait(toks: list[tuple[str, str, int]], i: int) -> bool:
    """Whether the head of an impl, which begins at i, names a trait: "for" before the body, and not as "for<"."""
    while i + 1 < len(toks) and toks[i][1] not in ("{", ";", "}"):
        if toks[i][1] == "for" and toks[i + 1][1] != "<":
            return True
        i += 1
    return False


def island(text: str, lang: str) -> tuple:
    """A tree of (type, [children]) or (type, label)."""
    toks = [t for t in lex(text, lang) if t[0] not in ("comment", "lifetime")]
    # calls of Python by Python take no stack of the machine, so brackets may nest as deep as there are any
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 2 * sum(t[1] in ("(", "[", "{") or t[1] in TYPES for t in toks) + 2000))
    i = 0

    def upto(closer: str | None, stop_line: bool = False) -> list[tuple]:
        nonlocal i
        out: list[tuple] = []
        while i < len(toks):
            kind, t, line = toks[i]
            if t == closer:
                i += 1
                return out
            if closer is None and t in ")}]":
                i += 1
                continue
            if closer is not None and t in ("}",) and closer != "}":
                return out
            i += 1
            if kind == "string":
                out.append((STRING, t))
            elif kind == "number":
                out.append((NUMBER, t))
            elif kind == "name" and t in STARTERS.get(lang, ()) and i < len(toks):
                out.append(function())
            elif kind == "name" and t in TYPES:
                label, begin = [], i
                while i < len(toks) and toks[i][1] not in ("{", ";", "}") and (lang != "kotlin" or toks[i][2] == line or toks[i][1] in (":", ",", "(", ")")):
                    if toks[i][0] == "name":
                        label.append((VARIABLE, toks[i][1]))
                    i += 1
                body = []
                if i < len(toks) and toks[i][1] == "{":
                    i += 1
                    body = [(BLOCK, upto("}"))]
                made = TYPES[t]
                if t == "impl":  # of a trait, it and its body are flattened away later; else it is a block like a class's body
                    made = PACKAGE if _of_trait(toks, begin) else BLOCK
                    body = [(made, b[1]) for b in body]
                elif t == "object" and lang == "kotlin" and label and toks[begin - 2][1] != "companion" and not (body and body[0][1]):
                    made = PACKAGE  # an empty object marks a module
                out.append((made, [*label, *body]))
            elif kind == "name" and t in KEYWORDS:
                out.append((KEYWORDS[t], []))
            elif kind == "name":
                if i < len(toks) and toks[i][1] == "(":
                    save = i
                    i += 1
                    args = upto(")")
                    if lang == "cpp" and i < len(toks) and (toks[i][1] == "{" or toks[i][1] in ("const", "noexcept", "override", "final")) and t not in KEYWORDS:
                        while i < len(toks) and toks[i][1] not in ("{", ";"):
                            i += 1
                        if i < len(toks) and toks[i][1] == "{":
                            i += 1
                            out.append((FUNCTION, [(VARIABLE, t), *((PARAM, [a]) for a in args if a[0] == VARIABLE), (BLOCK, upto("}"))]))
                            continue
                        i = save + 1
                        args = upto(")")
                    out.append((CALL, [(VARIABLE, t), *args]))
                else:
                    out.append((VARIABLE, t))
            elif t == "{":
                inner = upto("}")
                if out and out[-1][0] in (IF, FOR, WHILE, SWITCH, TRY, PACKAGE) and out[-1][1] == []:
                    out[-1] = (out[-1][0], [(BLOCK, inner)])
                else:
                    out.append((BLOCK, inner))
            elif t in "([":
                out += upto(")" if t == "(" else "]")
            elif t in _OP:
                out.append((_OP[t], t))
        return out

    def function() -> tuple:
        nonlocal i
        name = ""
        while i < len(toks) and toks[i][1] not in ("(", "{", ";"):
            if toks[i][0] == "name":
                name = toks[i][1]
            i += 1
        params: list[tuple] = []
        if i < len(toks) and toks[i][1] == "(":
            i += 1
            params = [(PARAM, [a]) for a in upto(")") if a[0] == VARIABLE]
        line = toks[i - 1][2] if i else 0
        while i < len(toks) and toks[i][1] not in ("{", ";", "=") and not (lang == "kotlin" and toks[i][2] > line):
            i += 1
        body: list[tuple] = []
        if i < len(toks) and toks[i][1] == "{":
            i += 1
            body = [(BLOCK, upto("}"))]
        return FUNCTION, [(VARIABLE, name), *params, *body]

    return OTHER, upto(None)


_PY = {
    ast.FunctionDef: FUNCTION, ast.AsyncFunctionDef: FUNCTION, ast.ClassDef: CLASS, ast.If: IF, ast.For: FOR, ast.AsyncFor: FOR, ast.While: WHILE, ast.Match: SWITCH, ast.Return: RETURN, ast.Break: BREAK, ast.Continue: CONTINUE, ast.Try: TRY, ast.Raise: THROW,
    ast.Call: CALL, ast.Lambda: LAMBDA, ast.Assign: VAR_DECL, ast.AnnAssign: VAR_DECL, ast.AugAssign: 79, ast.BinOp: 75, ast.Compare: 76, ast.BoolOp: 77, ast.Import: IMPORT, ast.ImportFrom: IMPORT, ast.Attribute: 42, ast.Subscript: 41, ast.IfExp: 46,
}


def python_tree(text: str) -> tuple:
    """A tree of a Python text; one that doesn't parse is a single unknown node."""

    def walk(n: ast.AST) -> tuple:
        if isinstance(n, ast.Name):
            return VARIABLE, n.id
        if isinstance(n, ast.arg):
            return PARAM, [(VARIABLE, n.arg)]
        if isinstance(n, ast.Constant):
            return (STRING if isinstance(n.value, (str, bytes)) else 53 if isinstance(n.value, bool) else 54 if n.value is None else NUMBER), repr(n.value)
        kids = [walk(k) for k in ast.iter_child_nodes(n) if not isinstance(k, (ast.expr_context, ast.operator, ast.cmpop, ast.boolop, ast.unaryop))]
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            kids = [(VARIABLE, n.name), *kids]
        if isinstance(n, ast.Attribute):
            kids.append((VARIABLE, n.attr))
        return _PY.get(type(n), OTHER), kids

    try:
        return walk(ast.parse(text))
    except (SyntaxError, ValueError, RecursionError):
        return (UNKNOWN,)


class _Html(HTMLParser):
    VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

    def __init__(self, types: dict[str, int]):
        super().__init__()
        self.types, self.root = types, (PACKAGE, [])
        self.stack = [("", self.root[1])]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = (self.types.get(tag, UNKNOWN), [])
        self.stack[-1][1].append(node)
        if tag not in self.VOID:
            self.stack.append((tag, node[1]))

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k][0] == tag:
                del self.stack[k:]
                return


def html_tree(text: str, types: dict[str, int]) -> tuple:
    p = _Html(types)
    p.feed(text)
    p.close()
    return p.root


def _each_text(files: DataFrame, of: Callable[[str, str | None, str | None], list[tuple]], schema: str) -> DataFrame:
    """The rows that ``of`` makes of each unit, lang and text of files. A worker holds about ``PART_ROWS`` of them, whatever
    a batch of texts makes, and those of one text."""
    small_batches(files.sparkSession)
    fields = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: list[tuple] = []
        for b in batches:
            for k in range(b.num_rows):
                part += of(*(c[k].as_py() for c in b.columns))
                if len(part) >= PART_ROWS:
                    yield record(part)
                    part = []
        if part:
            yield record(part)

    def record(part: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in part], f.type) for k, f in enumerate(fields)], schema=fields)

    return files.select("unit", "lang", "text").mapInArrow(run, schema)


def parse_nodes(files: DataFrame, types: dict[str, int] | None = None) -> DataFrame:
    """Nodes of the trees of files (unit, lang, text). A null text has no nodes."""

    def run(unit: str, lang: str | None, text: str | None) -> list[tuple]:
        if text is None:
            return []
        return rows(unit, html_tree(text, types or {}) if lang == "html" else python_tree(text) if lang == "python" else island(text, lang or ""))

    return _each_text(files, run, NODE_SCHEMA)


_DECL = {
    "rust": re.compile(r"(?P<attrs>(?:#\[[^\]]*\]\s*)*)(?P<vis>pub(?:[(][^)]*[)])? +)?(?:async\s+|unsafe\s+|const\s+(?=fn))*(?P<what>fn|struct|enum|trait|impl|const|type|mod)\b\s*(?P<rest>[^{;]*)"),
    "kotlin": re.compile(r"(?P<attrs>(?:@\w+(?:[(][^)]*[)])?\s*)*)(?P<vis>(?:public|private|internal|protected)\s+)?(?P<mod>(?:(?:data|sealed|enum|open|abstract|inline|override|suspend|const|companion|value|annotation|operator|infix|expect|actual)\s+)*)(?P<what>fun|class|interface|object|typealias|val|var)\b(?P<rest>[^{=\n]*)"),
    "cpp": re.compile(r"(?P<attrs>)(?P<vis>)(?:template *<[^>]*> *)?(?P<what>class|struct|enum(?:\s+class)?)\s+(?P<rest>[A-Za-z_]\w*[^;{]*)(?=\{)|(?P<fn>[A-Za-z_~][\w:~]*)\s*[(](?P<args>[^()]*)[)]\s*(?:(?:final|override|noexcept|const)\s*)*(?=[{])"),
}
_CPP_WORDS = {"if", "for", "while", "switch", "catch", "return", "sizeof", "else", "do", "new", "delete", "throw"}


def blanked(text: str, lang: str) -> str:
    """The text with comments and strings as blanks, so positions and lines stay."""
    out, at = list(text), 0
    for kind, t, _ in lex(text, lang):
        at = text.index(t, at)
        if kind in ("comment", "string"):
            out[at : at + len(t)] = [c if c == "\n" else " " for c in t]
        at += len(t)
    return "".join(out)


def closing(code: str, at: int) -> int:
    """The position after the brace that closes the one at ``at``; the end of the text if none does."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(code, at):
        depth += 1 if m[0] == "{" else -1
        if depth == 0:
            return m.end()
    return len(code)


def declarations(text: str, lang: str) -> list[dict]:
    """Symbols in order: kind, name, parent, public, line, is_test, is_stub, and the body and arguments of functions."""
    if lang == "python":
        return _python_declarations(text)
    code = blanked(text, lang)
    pattern = _DECL.get("kotlin" if lang == "kotlin" else "cpp" if lang in ("cpp", "typescript") else "rust")
    out: list[dict] = []
    scopes: list[tuple[int, str, bool, str]] = []  # end, name, test, kind
    for m in pattern.finditer(code):
        scopes = [s for s in scopes if s[0] > m.start()]
        group = m.groupdict()
        what, rest = group.get("what"), (group.get("rest") or "").strip()
        line = text.count("\n", 0, m.start() + len(group.get("attrs") or "")) + 1
        opens = code.find("{", m.end() - (1 if code[m.end() - 1 : m.end()] == "{" else 0))
        stop = re.compile(r"[;\n}]" if lang == "kotlin" else r"[;}]").search(code, m.end())
        has = opens >= 0 and (stop is None or opens < stop.start() or not code[m.end() : opens].strip())
        end = closing(code, opens) if has else m.end()
        parent = next((s[1] for s in reversed(scopes) if s[3] not in ("FUNCTION", "IMPL_METHOD", "MODULE")), "")
        owner = next((s[3] for s in reversed(scopes) if s[3] != "MODULE"), "")
        test = any(s[2] for s in scopes) or "#[test]" in (group.get("attrs") or "") or "cfg(test)" in (group.get("attrs") or "") or bool(re.search(r"@Test(?=[\s(]|$)", group.get("attrs") or ""))
        kind, name, args = "", "", group.get("args") or ""
        if group.get("fn"):
            kind, name = "FUNCTION", group["fn"]
            if name in _CPP_WORDS:
                continue
            kind = "IMPL_METHOD" if parent or "::" in name else kind
        elif what in ("fn", "fun"):
            bare = re.sub(r"^\s*<[^>]*>\s*", "", rest)
            head = re.match(r"(?:(?P<recv>[\w.]+)(?:<[^>]*>)?\.)?(?P<name>`[^`]+`|[\w#]+)", bare)
            if not head:
                continue
            name, parent = head["name"].strip("`"), head["recv"] or parent
            kind = "IMPL_METHOD" if parent else "FUNCTION"
            args = bare[bare.find("(") + 1 : bare.rfind(")")] if "(" in bare and ")" in bare else ""
        elif what == "impl":
            target = re.split(r"\bfor\b", re.sub(r"<[^<>]*>", "", rest))[-1]
            name, kind = (re.match(r"\s*&?\s*([\w:]+)", target) or ["", ""])[1].split("::")[-1], "IMPL"
        elif what == "mod":
            name, kind = (re.match(r"\w+", rest) or [""])[0], "MODULE"
        else:
            name = (re.match(r"`?(\w+)", re.sub(r"^class\s+", "", rest)) or ["", ""])[1]
            mod = group.get("mod") or ""
            if what == "object" and "companion" in mod:
                name = name or "Companion"
            kind = {"struct": "STRUCT", "class": "STRUCT", "enum": "ENUM", "enum class": "ENUM", "trait": "TRAIT", "interface": "TRAIT", "object": "STRUCT", "const": "CONST", "val": "CONST", "var": "CONST", "type": "TYPE_ALIAS", "typealias": "TYPE_ALIAS"}[re.sub(r"\s+", " ", what)]
            if lang == "kotlin" and what == "class" and ("enum" in mod or "sealed" in mod):
                kind = "ENUM"
            if what in ("val", "var") and owner in ("FUNCTION", "IMPL_METHOD"):
                continue
        if not name:
            continue
        body = text[opens + 1 : end - 1] if has else ""
        fn = kind in ("FUNCTION", "IMPL_METHOD")
        plain = code[opens + 1 : end - 1].strip() if has else ""
        stub = fn and has and (not plain or bool(STUB_BODY.search(plain)))
        public = "pub" in (group.get("vis") or "") if lang == "rust" else "private" not in (group.get("vis") or "")
        if kind != "MODULE":
            out.append({"kind": kind, "name": name, "parent": parent if kind != "IMPL" else "", "public": public, "line": line, "end_line": text.count("\n", 0, end) + 1, "is_test": test, "is_stub": stub, "has_body": has, "args": args.strip(), "body": body})
        if has:
            scopes.append((end, name, test, kind))
    return out


def _python_declarations(text: str) -> list[dict]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
    out = []

    def walk(n: ast.AST, parent: str) -> None:
        for k in ast.iter_child_nodes(n):
            if isinstance(k, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                fn = not isinstance(k, ast.ClassDef)
                body = "\n".join(ast.unparse(x) for x in k.body)
                bare = [x for x in k.body if not (isinstance(x, ast.Expr) and isinstance(x.value, ast.Constant) and isinstance(x.value.value, str))]
                stub = fn and all(isinstance(x, ast.Pass) or (isinstance(x, ast.Expr) and isinstance(x.value, ast.Constant) and x.value.value is ...) or (isinstance(x, ast.Raise) and "NotImplementedError" in ast.unparse(x)) for x in bare)
                args = ", ".join(a.arg for a in k.args.args) if fn else ""
                out.append({"kind": ("IMPL_METHOD" if parent else "FUNCTION") if fn else "STRUCT", "name": k.name, "parent": parent, "public": not k.name.startswith("_"), "line": k.lineno, "end_line": k.end_lineno, "is_test": fn and k.name.startswith("test_"), "is_stub": stub, "has_body": True, "args": args, "body": body})
                walk(k, parent if fn else k.name)
            else:
                walk(k, parent)

    walk(tree, "")
    return out


SYMBOL_SCHEMA = "unit string, id long, kind string, name string, parent string, qualified string, public boolean, line int, end_line int, is_test boolean, is_stub boolean, has_body boolean, args string, body string"


def symbols(files: DataFrame) -> DataFrame:
    """Declarations of files (unit, lang, text); ids number them within their unit."""

    names = [c.split()[0] for c in SYMBOL_SCHEMA.split(", ")]

    def run(unit: str, lang: str | None, text: str | None) -> list[tuple]:
        found = ({"unit": unit, "id": k, "qualified": f"{d['parent']}.{d['name']}" if d["parent"] else d["name"], **d} for k, d in enumerate(declarations(text or "", lang or "")))
        return [tuple(d[n] for n in names) for d in found]

    return _each_text(files, run, SYMBOL_SCHEMA)


IGNORED_NAMES = frozenset("it this self Self super pub fn fun function def mut public private internal override in as is def new null None true false True False".split())


def identifiers(files: DataFrame) -> DataFrame:
    """unit, term and n: names of two characters or more outside imports, comments and strings."""

    def run(unit: str, lang: str | None, text: str | None) -> list[tuple]:
        body = re.sub(r"(?m)^\s*(?:pub\s+)?(?:use|import|package|from|#\s*include)\b[^\n]*", "", text or "")
        words = Counter(t.strip("`") for kind, t, _ in lex(body, lang or "") if kind == "name" and t not in KEYWORDS and t not in TYPES)
        return [(unit, w, n) for w, n in words.items() if len(w) > 1 and w not in IGNORED_NAMES]

    return _each_text(files, run, "unit string, term string, n long")


def comments(files: DataFrame) -> DataFrame:
    """unit and counts of documentation, line and block comments, their lines, and the documentation's text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for unit, lang, text in zip(b["unit"], b["lang"], b["text"]):
                found = re.findall(r'"""(?s:.*?)"""|(?m:^\s*#[^\n]*)', text or "") if lang == "python" else [t for kind, t, _ in lex(text or "", lang or "") if kind == "comment"]
                doc = [t for t in found if t.startswith(("/**", "///", "//!", '"""')) and t != "/**/"]
                line = [t for t in found if t not in doc and t.lstrip().startswith(("//", "#"))]
                size = lambda x: sum(t.count("\n") + 1 for t in x)
                out.append((unit, len(doc), len(line), len(found) - len(doc) - len(line), size(doc), size(found), "\n".join(doc)))
            yield pd.DataFrame(out, columns=["unit", "doc", "line", "block", "doc_lines", "comment_lines", "doc_text"])

    return files.select("unit", "lang", "text").mapInPandas(run, "unit string, doc int, line int, block int, doc_lines int, comment_lines int, doc_text string")


def parameters(args: str, lang: str) -> list[str]:
    """Names of parameters: before the colon where types follow, else the last word."""
    out, depth, part = [], 0, ""
    for c in args + ",":
        if c in "<([{":
            depth += 1
        elif c in ">)]}":
            depth -= 1
        if c == "," and depth <= 0:
            bare = part.split("=")[0].strip()
            m = re.search(r"(\w+)\s*:", bare) if lang in ("kotlin", "rust", "typescript") else re.search(r"(\w+)\s*(\[\])?$", bare)
            if m and m[1] not in ("self", "void", "const", "int", "char", "double", "float", "bool", "auto"):
                out.append(m[1])
            part = ""
        else:
            part += c
    return out


def unused_parameters(files: DataFrame) -> DataFrame:
    """unit, line, name and param: parameters that a body never names; C++ marks use by a cast to void, and a Kotlin
    parameter that begins with an underscore passes if ``upstream`` (the text it was ported from) leaves it unused too."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            up = b["upstream"] if "upstream" in b else [None] * len(b)
            for unit, lang, text, source in zip(b["unit"], b["lang"], b["text"], up):
                for d in declarations(text or "", lang or ""):
                    if d["kind"] not in ("FUNCTION", "IMPL_METHOD") or not d["has_body"]:
                        continue
                    for p in parameters(d["args"], lang):
                        if re.search(rf"\b{re.escape(p)}\b", d["body"]):
                            continue
                        snake = re.sub(r"(?<=.)([A-Z])", r"_\1", p).lower()
                        if lang == "kotlin" and p.startswith("_") and re.search(rf"\b_?{re.escape(snake.lstrip('_'))}\b", source or "") and re.search(rf"\b_{re.escape(snake.lstrip('_'))}\b", source or ""):
                            continue
                        out.append((unit, d["line"], d["name"], p))
            yield pd.DataFrame(out, columns=["unit", "line", "name", "param"])

    columns = ["unit", "lang", "text", *(["upstream"] if "upstream" in files.columns else [])]
    return files.select(*columns).mapInPandas(run, "unit string, line int, name string, param string")


_FOREIGN = [
    (r"\bfn\s+\w+\s*\(", "fn"), (r"\blet\s+(?:mut\s+)?\w+", "let"), (r"\bpub(?:[(][^)]*[)])? +(?:use|mod|trait|enum|struct|fn)\b", "pub"), (r"\bimpl\b[^;{]*\{", "impl"), (r"\bmacro_rules\s*!", "macro_rules"),
    (r"#\s*\[[^\]]+\]", "attribute"), (r"\b(?:vec|format|println|assert_eq|assert_ne|debug_assert|todo|unimplemented)!\s*[(\[{]", "macro"), (r"\bmatch\s+[^;{]+\{", "match"), (r"\buse\s+\w[\w:]*(?:::|\{)", "use"),
]
_NOTES = [(r"(?im)^\s*(?://+|\*)?\s*kotlin\s*:", "translator-note"), (r"(?i)[(]\s*from +impl\b", "impl-note"), (r"(?i)\blifetimes?\b|(?:^|[(;,<:&\s])'[a-z_]\w*\b", "lifetime"), (r"\b(?:dyn|usize|Box|transmute|unsafe)\b", "rust-term"), (r"Send\s*\+\s*Sync", "auto-trait")]
_HEADER = re.compile(r"^\s*(?:port-lint: *(?:tests|source) +\S+|(?i:transliterated\s+from:)\s+\S+)\s*$")


def contamination_reasons(text: str) -> list[str]:
    """What in a Kotlin text was left over from Rust: in code, in comments, and as suppressions. Of foreign syntax, none
    is added once there are four reasons."""
    code, notes = strip_code(text, "kotlin")
    notes = "\n".join(x for x in notes.split("\n") if not _HEADER.match(x))
    out: list[str] = []

    def add(reason: str) -> None:
        if reason not in out:
            out.append(reason)

    for part, where in ((code, "code"), (notes, "comments")):
        for m in re.finditer(r"(?a)\b[^\W\d_][^\W_]*_\w*", part):
            if re.fullmatch(r"[a-z][a-z0-9]*(?:_[a-z0-9]+)+_?", m[0]):
                add(f"snake_case {m[0]} in {where}")
                break
        for pattern, name in _FOREIGN:
            if re.search(pattern, part):
                add(f"{name} in {where}")
                if len(out) >= 4:
                    break
    if any(re.search("functionname|unused", m[1]) for m in re.finditer(r"@(?:file:)? *suppress *[(]([^)]*)", text.lower())):
        add("suppression")
    if "UNCHECKED_CAST" in text and (" as Self" in text or " as ParametersSpec" in text):
        add("unchecked cast")
    for pattern, name in _NOTES:
        if re.search(pattern, notes):
            add(f"{name} in comments")
    return out


def contamination(files: DataFrame, most: int = 6) -> DataFrame:
    """unit and its reasons, six at most, joined."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"unit": b["unit"], "reasons": [";".join(contamination_reasons(t or "")[:most]) for t in b["text"]]})

    return files.select("unit", "text").mapInPandas(run, "unit string, reasons string")


def strip_test_blocks(text: str) -> str:
    """A Rust text without the items under cfg(test)."""
    code = blanked(text, "rust")
    while m := re.search(r"#\[cfg\(test\)\]\s*", code):
        opens, semi = code.find("{", m.end()), code.find(";", m.end())
        end = semi + 1 if 0 <= semi < (opens if opens >= 0 else len(code)) else closing(code, opens) if opens >= 0 else len(code)
        text, code = text[: m.start()] + text[end:], code[: m.start()] + code[end:]
    return text


def array_lint(files: DataFrame) -> DataFrame:
    """unit and counts of what in a Python text leans on numpy: imports, names, casts, conversions, operators between its
    values, subscripts; a text that doesn't parse counts as one ``other``."""
    names = ["unit", "imports", "names", "casts", "conversions", "operators", "subscripts", "other"]

    def count(text: str) -> list[int]:
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError):
            return [0, 0, 0, 0, 0, 0, 1]
        alias, c = set(), Counter()
        for n in ast.walk(tree):
            if isinstance(n, ast.Import):
                found = {(a.asname or a.name).split(".")[0] for a in n.names if a.name.split(".")[0] == "numpy"}
                alias |= found
                c["imports"] += len(found)
            elif isinstance(n, ast.ImportFrom) and (n.module or "").split(".")[0] == "numpy":
                alias |= {a.asname or a.name for a in n.names}
                c["imports"] += 1
        rooted = lambda x: isinstance(x, ast.Name) and x.id in alias or isinstance(x, (ast.Attribute, ast.Call, ast.Subscript)) and rooted(x.func if isinstance(x, ast.Call) else x.value) or isinstance(x, ast.BinOp) and (rooted(x.left) or rooted(x.right))
        for n in ast.walk(tree):
            if isinstance(n, ast.Name) and n.id in alias:
                c["names"] += 1
            elif isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id in ("float", "int", "bool") and n.args and rooted(n.args[0]):
                c["casts"] += 1
            elif isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute) and n.func.attr in ("item", "tolist", "astype", "numpy"):
                c["conversions"] += 1
            elif isinstance(n, ast.BinOp) and (rooted(n.left) or rooted(n.right)):
                c["operators"] += 1
            elif isinstance(n, ast.Subscript) and rooted(n.value):
                c["subscripts"] += 1
        return [c[k] for k in names[1:]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([[u, *count(t or "")] for u, t in zip(b["unit"], b["text"])], columns=names)

    return files.select("unit", "text").mapInPandas(run, "unit string, " + ", ".join(f"{n} int" for n in names[1:]))
