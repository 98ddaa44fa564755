"""Scalar column functions: scoring, labels, tiers, filters, paths."""

from __future__ import annotations

from collections import Counter
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words a description's keywords leave out.
STOP_WORDS = ("the", "a", "in", "for", "to", "of", "and", "or", "is", "it")
# Names and patterns that mark likely entry points.
LIFECYCLE = ("ngOnInit", "ngOnDestroy", "ngAfterViewInit", "useEffect", "useState", "componentDidMount", "componentWillUnmount", "componentDidUpdate")
MAPPINGS = ("@RequestMapping", "@GetMapping", "@PostMapping", "@PutMapping", "@DeleteMapping", "@Scheduled")
ENTRY_WORDS = ("Component", "Handler", "Controller", "route", "handler", "middleware")
CLASS_ENDINGS = r"(Controller|Handler|Service)$"
FILE_WORDS = "(?i)route|controller|handler"
# Substrings of a callee that mark a sink, the first type that matches wins.
SINKS = (
    ("database_query", ("query", "execute", "sql", "find", "save", "insert", "update", "delete")),
    ("http_response", ("send", "json", "write", "render", "redirect", "res.")),
    ("file_write", ("writeFile", "appendFile", "createWriteStream")),
    ("command_execution", ("exec", "spawn", "execSync")),
    ("logging", ("log", "warn", "error", "debug", "info", "console.")),
)
# Names that belong to the language or to well-known libraries.
BUILT_INS = tuple("""
console Math JSON Object Array String Number Boolean Date RegExp Error Promise Map Set WeakMap WeakSet Symbol Proxy
Reflect parseInt parseFloat isNaN isFinite setTimeout setInterval clearTimeout clearInterval fetch require process
Buffer global globalThis window document navigator
React useState useEffect useCallback useMemo useRef useContext useReducer useLayoutEffect useImperativeHandle
createElement createContext forwardRef memo lazy Suspense Fragment StrictMode createRef
StyleSheet Platform Dimensions PixelRatio Animated Alert Linking AppState Keyboard BackHandler
dispatch emit on off once addEventListener removeEventListener subscribe unsubscribe
path fs os url http https crypto stream events util child_process cluster net tls dns readline zlib assert querystring
express app router axios lodash _ moment dayjs chalk debug winston pino joi yup zod prisma knex sequelize mongoose
redis pg supertest request response res req next
describe it test expect jest vi cy beforeAll afterAll beforeEach afterEach
Partial Required Readonly Record Pick Omit Exclude Extract NonNullable ReturnType InstanceType
""".split())


def node_id(file: Column, line: Column, name: Column) -> Column:
    return F.concat_ws(":", file, line.cast("string"), name)


def keywords(description: Column) -> Column:
    """Lower-case alphanumeric words without stop words."""
    words = F.transform(F.split(description, r"\s+"), lambda w: F.lower(F.regexp_replace(w, "[^a-zA-Z0-9]", "")))
    return F.filter(words, lambda w: (w != "") & ~w.isin(*STOP_WORDS))


def _bigrams(s: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - 1, F.lit(1))), lambda i: F.substr(s, i, F.lit(2)))


def dice(a: Column, b: Column) -> Column:
    """Sørensen-Dice over bigrams, as multisets, white space left out; 1 for equal texts, 0 if one is shorter than 2."""
    a, b = (F.regexp_replace(x, r"\s+", "") for x in (a, b))
    x, y = _bigrams(a), _bigrams(b)
    count = lambda arr, g: F.size(F.filter(arr, lambda v: v == g))
    common = F.aggregate(F.array_distinct(x), F.lit(0), lambda acc, g: acc + F.least(count(x, g), count(y, g)))
    return F.when(a == b, 1.0).when((F.length(a) < 2) | (F.length(b) < 2), 0.0).otherwise(2.0 * common / (F.length(a) + F.length(b) - 2))


def bare(name: Column) -> Column:
    """A lower-cased name without white space, as :func:`similarity` takes it: made once, it serves every keyword."""
    return F.translate(F.lower(name), " \t\n\x0b\f\r", "")


def _near(word: str, low: Column) -> Column:
    """:func:`dice` of a keyword and a bare name. The keyword's bigrams are known, so most need no more than a look whether the name holds them."""
    own = Counter(word[i : i + 2] for i in range(max(len(word) - 1, 1)))
    # one that the keyword has more than once is counted, overlaps too
    held = [low.contains(g).cast("int") if n == 1 else F.least(F.lit(n), F.regexp_count(low, F.lit(f"(?={g})"))) for g, n in own.items()]
    return F.when(low == word, 1.0).when((F.length(low) < 2) | F.lit(len(word) < 2), 0.0).otherwise(2.0 * reduce(lambda a, b: a + b, held) / (F.length(low) + (len(word) - 2)))


def similarity(words: list[str], name: Column, qualified: Column, bare_name: Column | None = None, bare_qualified: Column | None = None) -> Column:
    """The best of all keywords against the lower-cased names, with 0.3 more where one contains it; at most 1."""
    n, q = F.lower(name), F.lower(qualified)
    a, b = (bare(c) if p is None else p for c, p in ((name, bare_name), (qualified, bare_qualified)))
    each = [F.greatest(_near(w, a), _near(w, b)) + F.when(n.contains(w) | q.contains(w), 0.3).otherwise(0.0) for w in words]
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(0.0), *each))


def _any(col: Column, parts: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [col.contains(p) for p in parts])


def boost(name: Column, qualified: Column, signature: Column, file: Column, visibility: Column) -> Column:
    rules = [
        F.when(_any(signature, MAPPINGS), 0.9),
        F.when((name == "main") & signature.contains("String[]"), 0.9),
        F.when(name.isin(*LIFECYCLE), 0.8),
        F.when((visibility == "public") & F.substring_index(qualified, ".", 1).rlike(CLASS_ENDINGS), 0.7),
        F.when(_any(name, ENTRY_WORDS) | _any(qualified, ENTRY_WORDS), 0.6),
        F.when(file.rlike(FILE_WORDS), 0.5),
    ]
    return F.coalesce(*rules, F.lit(0.0))


def reason(near: Column, lift: Column, name: Column, signature: Column) -> Column:
    why = (
        F.when((lift >= 0.9) & _any(signature, MAPPINGS), "Spring annotation detected")
        .when((lift >= 0.9) & (name == "main") & signature.contains("String[]"), "Java main method")
        .when(lift >= 0.9, None)
        .when(lift >= 0.8, "framework lifecycle method")
        .when(lift >= 0.7, "public method on Controller/Handler/Service class")
        .when(lift >= 0.6, "matches entry point naming pattern")
        .when(lift >= 0.5, "located in route/controller/handler file")
    )
    said = F.when(near > 0.3, F.concat(F.lit("name similarity: "), F.floor(near * 100 + 0.5).cast("string"), F.lit("%")))
    return F.concat_ws("; ", said, why)


def sink(name: Column, qualified: Column) -> Column:
    """The first sink type of which a pattern occurs in either name, any case; null if none."""
    n, q = F.lower(name), F.lower(qualified)
    out = F.lit(None).cast("string")
    for kind, parts in reversed(SINKS):
        low = tuple(p.lower() for p in parts)
        out = F.when(_any(n, low) | _any(q, low), kind).otherwise(out)
    return out


def built_in(name: Column) -> Column:
    """The name, or what stands before its first dot, is a built-in."""
    return name.isin(*BUILT_INS) | (name.contains(".") & F.substring_index(name, ".", 1).isin(*BUILT_INS))


def match_field(query: str, name: Column, qualified: Column, file: Column, kind: Column) -> Column:
    q = query.lower()
    return F.when(F.lower(name).contains(q), "name").when(F.lower(qualified).contains(q), "qualifiedName").when(F.lower(file).contains(q), "filePath").when(F.lower(kind).contains(q), "kind")


def preset(which: str, kind: Column, cover: Column, complex_: Column, unresolved: Column) -> Column:
    """Whether a node passes a named filter. ``cover`` in percent; null passes neither coverage filter."""
    rule = {
        "functions": kind == "function",
        "conditionals": kind == "conditional",
        "uncovered": F.coalesce(cover < 50, F.lit(False)),
        "high-complexity": F.coalesce(complex_ > 10, F.lit(False)),
        "dead-code": F.coalesce(cover == 0, F.lit(False)),
        "hide-library": ~unresolved,
    }
    return rule.get(which, F.lit(True))


def visibility_state(hide_library: bool, unresolved: Column, passes: Column, matches: Column) -> Column:
    hidden = unresolved if hide_library else F.lit(False)
    return F.when(hidden, "hidden").when(passes & matches, "highlighted").otherwise("dimmed")


def edge_state(source: Column, target: Column) -> Column:
    return F.when((source == "hidden") | (target == "hidden"), "hidden").when((source == "dimmed") & (target == "dimmed"), "dimmed").otherwise("shown")


def complexity_tier(c: Column) -> Column:
    return F.when(c <= 5, "low").when(c <= 10, "medium").otherwise("high")


def churn_tier(c: Column) -> Column:
    return F.when(c > 10, "high").when(c > 3, "medium").otherwise("low")


def transitive_match(name: Column, arguments: Column | None = None, query: str = "") -> Column:
    returns = F.lower(name).rlike("^(get|calculate|compute|fetch)")
    told = F.when(returns, "return_value").otherwise("parameter_pass")
    if arguments is None:
        return told
    return F.when(F.coalesce(F.exists(arguments, lambda a: F.lower(a).contains(query.lower())), F.lit(False)), "parameter_pass").otherwise(told)


def truncated(text: Column, most: int) -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most - 3), F.lit("...")))


def mermaid_id(id_: Column) -> Column:
    return F.regexp_replace(id_, "[^a-zA-Z0-9]", "_")


def mermaid_escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit('"'), F.lit("#quot;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def mermaid_label(name: Column, file: Column, line: Column) -> Column:
    last = F.substring_index(file, "/", -1)
    return F.concat(mermaid_escaped(truncated(name, 40)), F.lit("<br/>"), mermaid_escaped(truncated(last, 30)), F.lit(":"), (line + 1).cast("string"))


#: How each edge kind is drawn.
ARROWS = {"call": "-->|call|", "conditional_flow": "-.->|conditional|", "callback": "==>|callback|", "cycle_back_edge": "--x|cycle|", "depth_limited": "-->|...|"}


def mermaid_edge(source: Column, target: Column, kind: Column) -> Column:
    arrow = reduce(lambda a, kv: F.when(kind == kv[0], kv[1]).otherwise(a), ARROWS.items(), F.lit("-->"))
    return F.concat_ws(" ", mermaid_id(source), arrow, mermaid_id(target))


def relative_path(path: Column) -> Column:
    """From the first src, lib, packages or app directory (in that order) on; else at most the last three parts."""
    p = F.translate(path, "\\", "/")
    marked = [F.when(F.instr(p, f"/{m}/") > 0, F.substr(p, F.instr(p, f"/{m}/") + 1)) for m in ("src", "lib", "packages", "app")]
    parts = F.split(p, "/")
    roots = F.array(*map(F.lit, ("src", "lib", "packages", "app")))
    last = F.array_max(F.transform(F.filter(F.transform(parts, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: F.array_contains(roots, s["x"])), lambda s: s["i"]))
    tail = F.array_join(F.slice(parts, F.greatest(F.size(parts) - 2, F.lit(1)), F.lit(3)), "/")
    return F.coalesce(*marked, F.when(last.isNotNull(), F.array_join(F.slice(parts, last + 1, F.size(parts)), "/")), F.when(F.size(parts) > 3, tail), p, F.lit(""))


def joined_path(base: Column, relative: Column) -> Column:
    """``relative`` resolved against ``base``, ``.`` and ``..`` taken out."""
    step = lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(s == ".", acc).otherwise(F.concat(acc, F.array(s)))
    return F.array_join(F.aggregate(F.split(relative, "/"), F.split(base, "/"), step), "/")
