"""The engine's SQL dialect as Spark SQL: a token rewrite, and the checks of strict mode."""

from __future__ import annotations

import re

TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)|(?P<string>'(?:[^']|'')*')|(?P<quoted>"(?:[^"]|"")*"|`(?:[^`]|``)*`)|(?P<frame>\{\w+\})|(?P<number>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<word>[A-Za-z_]\w*)|(?P<param>\$\d+)|(?P<sysvar>@@[\w.]+)|(?P<op>->>|->|::|<=|>=|<>|!=|\|\||.)""",
    re.S,
)
#: Types of the dialect that Spark calls otherwise.
TYPES = {
    "text": "STRING", "jsonb": "STRING", "json": "STRING", "uuid": "STRING", "inet": "STRING", "bytea": "BINARY", "blob": "BINARY", "bytes": "BINARY",
    "timestamptz": "TIMESTAMP_NTZ", "timestamp": "TIMESTAMP_NTZ", "datetime": "TIMESTAMP_NTZ", "integer": "BIGINT", "int": "BIGINT", "smallint": "BIGINT",
    "serial": "BIGINT", "bigserial": "BIGINT", "smallserial": "BIGINT", "float": "DOUBLE", "real": "DOUBLE", "bool": "BOOLEAN", "numeric": "DECIMAL", "dec": "DECIMAL",
}
FUNCTIONS = {"version()": "'tidemill'", "database()": "current_database()"}
#: Microseconds since midnight, as the dialect stores a time.
CURRENT_TIME = "pmod(unix_micros(current_timestamp()), 86400000000L)"
#: What strict mode turns away: the dialect has no such statements.
REJECTED = {"over": "window functions", "union": "set operations", "intersect": "set operations", "except": "set operations", "with": "common table expressions"}


class DialectError(ValueError):
    """A statement that the dialect does not have."""


def tokens(text: str) -> list[tuple[str, str]]:
    return [(m.lastgroup, m[0]) for m in TOKEN.finditer(text)]


def _key(kind: str, text: str) -> str:
    """The path step of a JSON key: a name, or the index of an array."""
    if kind == "number":
        return f"[{text}]"
    name = text[1:-1].replace("''", "'")
    return f"[{name}]" if name.isdigit() else "." + (name if re.fullmatch(r"\w+", name) else "['" + name.replace("'", "\\'") + "']")


def json_get(operand: str, step: str, as_text: bool) -> str:
    if as_text:
        return f"get_json_object({operand}, '${step}')"
    return f"to_json(try_variant_get(try_parse_json({operand}), '${step}', 'variant'))"


def _operand(out: list[str]) -> str:
    """Takes the expression at the end of what was written: a name with qualifiers, or a call or parentheses."""
    while out and not out[-1].strip():
        out.pop()
    parts: list[str] = []
    if out and out[-1].endswith(")"):
        depth = 0
        while out:
            t = out.pop()
            parts.append(t)
            depth += t.count(")") - t.count("(") if not t.startswith("'") else 0
            if depth == 0:
                break
        if out and re.fullmatch(r"\w+", out[-1]):
            parts.append(out.pop())
    elif out:
        parts.append(out.pop())
        while len(out) >= 2 and out[-1] == ".":
            parts += [out.pop(), out.pop()]
    return "".join(reversed(parts))


def translate(text: str, args: list | None = None, strict: bool = False) -> tuple[str, dict]:
    """Spark SQL and its named arguments. $n and ? are bound to args by place and may not be mixed."""
    toks = tokens(text.strip().rstrip(";"))
    if strict:
        check(toks)
    if any(t.lower() == "in" for _, t in toks):
        toks = tokens(without_null_aware_joins(numbered(text.strip().rstrip(";"))))
    out: list[str] = []
    places, by_number, i = 0, False, 0

    def ahead(j: int) -> int:
        while j < len(toks) and toks[j][0] == "space":
            j += 1
        return j

    while i < len(toks):
        kind, t = toks[i]
        low = t.lower()
        if kind == "quoted" and t[0] == '"':
            out.append("`" + t[1:-1].replace('""', '"').replace("`", "``") + "`")
        elif kind == "string":
            out.append("'" + t[1:-1].replace("\\", "\\\\").replace("''", "\\'") + "'")
        elif kind == "op" and t in ("->", "->>"):
            j = ahead(i + 1)
            out.append(json_get(_operand(out), _key(*toks[j]), t == "->>"))
            i = j
        elif kind == "op" and t == "?":
            j = ahead(i + 1)
            if j < len(toks) and toks[j][0] == "string" and out and re.search(r"[\w`)]\s*$", "".join(out[-2:])):
                out.append(f"coalesce(array_contains(json_object_keys({_operand(out)}), {toks[j][1]}), false)")
                i = j
            else:
                out.append(f":p{places}")
                places += 1
        elif kind == "param":
            out.append(f":p{int(t[1:]) - 1}")
            by_number = True
        elif kind == "sysvar":
            out.append("NULL")
        elif kind == "word" and low == "current_time":
            j = ahead(i + 1)
            if "".join(x[1] for x in toks[j : j + 2]) == "()":
                i = j + 1
            out.append(CURRENT_TIME)
        elif kind == "word" and low == "select" and (j := ahead(i + 1)) < len(toks) and toks[j][1].lower() == "from":
            out.append(f"{t} *")
        elif kind == "word" and low == "limit" and (b := ahead(ahead(i + 1) + 1)) < len(toks) and toks[b][1] == ",":
            c = ahead(b + 1)
            out.append(f"LIMIT {toks[c][1]} OFFSET {toks[ahead(i + 1)][1]}")
            i = c
        elif kind == "word" and low == "timestamp" and (j := ahead(i + 1)) < len(toks) and toks[j][0] == "string":
            out.append("TIMESTAMP_NTZ")
        elif kind == "word" and low in TYPES and (before := [x for x in out if x.strip()][-1:]) and before[0].upper() in ("AS", "::") and _in_cast(out):
            out.append(TYPES[low])
        elif kind == "word" and low in ("version", "database") and "".join(x[1] for x in toks[i + 1 : i + 3]) == "()":
            out.append(FUNCTIONS[f"{low}()"])
            i += 2
        else:
            out.append(t)
        i += 1
    if places and by_number:
        raise DialectError("? and $n in one statement")
    return "".join(out), {f"p{k}": v for k, v in enumerate(args or [])}


def numbered(text: str) -> str:
    """text with each ? that is a place for a value as $1, $2 ... over the whole statement, so that its parts can be read one by one."""
    toks, out, n = tokens(text), [], 0
    for i, (kind, t) in enumerate(toks):
        if kind == "op" and t == "?":
            before = next((x for x in reversed(toks[:i]) if x[0] != "space"), ("", ""))
            after = next((x for x in toks[i + 1 :] if x[0] != "space"), ("", ""))
            if not (after[0] == "string" and (before[0] in ("word", "quoted") or before[1] == ")")):  # else: whether a JSON key is there
                n, t = n + 1, f"${n + 1}"
        out.append(t)
    if n and any(kind == "param" for kind, _ in toks):
        raise DialectError("? and $n in one statement")
    return "".join(out)


def clauses(text: str, *words: str) -> list[str | None]:
    """text cut at the words, in this order, that stand outside parentheses and strings: what is before the first, and after each; None: it is not there."""
    out: list[str | None] = [""] + [None] * len(words)
    depth, at = 0, 0
    for kind, t in tokens(text):
        depth += (t == "(") - (t == ")")
        hit = next((k for k in range(at, len(words)) if kind == "word" and depth == 0 and t.upper() == words[k]), None)
        if hit is not None:
            at = hit + 1
            out[at] = ""
        else:
            out[at] += t
    return [None if x is None else x.strip() for x in out]


#: After a table these words go on with the statement; any other is the table's alias.
AFTER_TABLE = {"where", "join", "on", "group", "order", "left", "right", "full", "cross", "inner", "limit", "using", "having", "offset", "union", "intersect", "except", "semi", "anti", "natural", "set"}


def with_tables(text: str, known: dict[str, str]) -> tuple[str, set[str]]:
    """text with {name} for each table that a FROM list or a JOIN names, and the names. known: names by their lower case."""
    toks, out, used = tokens(text), [], set()
    lists, waiting = [False], False  # for each depth of parentheses: whether a comma goes on with a FROM list
    real = [i for i, (kind, _) in enumerate(toks) if kind != "space"]
    following = dict(zip(real, [*real[1:], None]))
    for i, (kind, t) in enumerate(toks):
        low, after = t.lower(), following.get(i)
        if kind == "space":
            out.append(t)
            continue
        name = known.get(t[1:-1].lower() if kind == "quoted" else low) if waiting and kind in ("word", "quoted") else None
        if name is not None and (after is None or toks[after][1] not in ("(", ".")):
            used.add(name)
            alias = after is not None and (toks[after][0] == "quoted" or toks[after][0] == "word" and toks[after][1].lower() not in AFTER_TABLE)
            out.append(f"{{{name}}}" + ("" if alias else f" AS `{name}`"))
            waiting = False
            continue
        waiting = False
        if t == "(":
            lists.append(False)
        elif t == ")":
            lists = lists[:-1] or [False]
        elif kind == "word" and low in ("from", "join"):
            lists[-1], waiting = True, True
        elif kind == "word" and low in AFTER_TABLE - {"left", "right", "full", "cross", "inner", "semi", "anti", "natural"} or low == "select":
            lists[-1] = False
        elif t == "," and lists[-1]:
            waiting = True
        out.append(t)
    return "".join(out), used


NAMES_TABLE = {"from", "join", "into", "update", "table", "describe", "desc", "exists"}
SYSTEM = {"information_schema", "pg_catalog"}


def in_database(text: str, current: str) -> str:
    """text with the current database's name taken from before its tables; tables of other databases are turned away."""
    toks = tokens(text)
    real = [i for i, (kind, _) in enumerate(toks) if kind != "space"]
    for n, i in enumerate(real[:-3]):
        (_, verb), (kind, db), (_, dot), (last, _) = (toks[j] for j in real[n : n + 4])
        if verb.lower() in NAMES_TABLE and kind in ("word", "quoted") and dot == "." and last in ("word", "quoted"):
            db = db.strip('`"')
            if db.lower() in SYSTEM:
                continue
            if db != current:
                raise DialectError(f"{db} is not the database in use")
            toks[real[n + 1]] = toks[real[n + 2]] = ("space", "")
    return "".join(t for _, t in toks)


def _condition_is_plain(real: list[tuple[str, str]], at: int) -> bool:
    """Whether the WHERE that real[at] stands in is a row of conditions joined by AND, none of them negated as a whole."""
    depth, begin = 0, None
    for k in range(at - 1, -1, -1):
        t = real[k][1].lower()
        depth += (t == ")") - (t == "(")
        if depth < 0:
            return False
        if depth == 0 and t == "where":
            begin = k
            break
    if begin is None:
        return False
    for k in range(begin + 1, len(real)):
        t, after = real[k][1].lower(), real[k + 1][1].lower() if k + 1 < len(real) else ""
        depth += (t == "(") - (t == ")")
        if depth < 0 or depth == 0 and t in ("group", "order", "having", "limit"):
            return True
        if depth == 0 and (t in ("or", "case") or t == "not" and after not in ("in", "exists", "null", "like", "between")):
            return False
    return True


def without_null_aware_joins(text: str) -> str:
    """text with `x NOT IN (SELECT ...)` as an anti join and two one-row checks, in a plain WHERE.

    The planner broadcasts the subquery of a NOT IN whatever its size, as a null on either side decides. Here the join is of equal keys; a null
    in the subquery, and a null on the left side against a subquery with rows, are asked for apart.
    """
    while True:
        real = [(k, t) for k, t in tokens(text) if k != "space"]
        low = [t.lower() for _, t in real]
        n = next((i for i in range(1, len(low) - 3) if low[i : i + 4] == ["not", "in", "(", "select"] and _condition_is_plain(real, i)), None)
        if n is None:
            return text
        depth, end = 0, n + 2
        while True:
            depth += (low[end] == "(") - (low[end] == ")")
            if depth == 0:
                break
            end += 1
        begin = n - 1
        if real[begin][0] not in ("word", "quoted", "number", "string"):
            return text
        while begin >= 2 and real[begin - 1][1] == ".":
            begin -= 2
        said = lambda x: " ".join(t for _, t in x).replace(" . ", ".").replace("{ ", "{").replace(" }", "}")
        left, sub = said(real[begin:n]), said(real[n + 3 : end])
        rows = f"FROM ({sub}) AS __s(__v)"
        new = f"NOT EXISTS (SELECT 1 {rows} WHERE __s.__v = {left}) AND NOT EXISTS (SELECT 1 {rows} WHERE __s.__v IS NULL) AND ({left} IS NOT NULL OR NOT EXISTS (SELECT 1 {rows}))"
        text = " ".join((said(real[:begin]), new, said(real[end + 1 :])))


def _in_cast(out: list[str]) -> bool:
    """Whether the last AS belongs to a CAST, and not to an alias."""
    if [x for x in out if x.strip()][-1] == "::":
        return True
    depth = 0
    for k in range(len(out) - 1, -1, -1):
        if out[k] == ")":
            depth += 1
        elif out[k] == "(":
            if depth == 0:
                return k > 0 and out[k - 1].lower() in ("cast", "try_cast")
            depth -= 1
    return False


def check(toks: list[tuple[str, str]]) -> None:
    """Raises for what the dialect turns away."""
    real = [(k, t) for k, t in toks if k != "space"]
    for n, (kind, t) in enumerate(real):
        low, after = t.lower(), real[n + 1][1].lower() if n + 1 < len(real) else ""
        if kind == "word" and low in REJECTED:
            raise DialectError(f"{REJECTED[low]} are not supported")
        if t in ("=", "<>", "!=", "<", ">", "<=", ">=") and after == "null":
            raise DialectError("comparison with NULL; use IS NULL")
        if low == "like" and real[n + 1][0] == "string":
            pattern = real[n + 1][1][1:-1]
            if "_" in pattern or "%" in pattern[:-1]:
                raise DialectError("LIKE takes a prefix only")
        if low == "not" and after in ("like", "between"):
            raise DialectError(f"NOT {after.upper()} is not supported")
        if low == "in" and after == "(":
            inner = [x[1].lower() for x in real[n + 2 : n + 400]]
            if "null" in inner[: inner.index(")") if ")" in inner else None] and "select" not in inner[:1]:
                raise DialectError("NULL in an IN list")


def in_lists(text: str) -> list[tuple[str, list[tuple[str, str]]]]:
    """(column, literals) of each IN list that holds nothing but literals."""
    real = [(k, t) for k, t in tokens(text) if k != "space"]
    out = []
    for n, (_, t) in enumerate(real):
        if t.lower() != "in" or n + 1 >= len(real) or real[n + 1][1] != "(":
            continue
        k = n - 2 if n and real[n - 1][1].lower() == "not" else n - 1
        end = next((j for j in range(n + 2, len(real)) if real[j][1] == ")"), None)
        if k < 0 or end is None or real[k][0] not in ("word", "quoted"):
            continue
        inner, literals, sign = real[n + 2 : end], [], ""
        for kind, x in inner:
            if x == "-":
                sign = "-"
            elif x != ",":
                literals.append((kind, sign + x))
                sign = ""
        if all(kind in ("string", "number") for kind, _ in literals):
            out.append((real[k][1].strip('`"'), literals))
    return out
