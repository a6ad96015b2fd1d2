"""Secret scans by assignment-aware lexing.

Source and configuration text is cut into tokens (strings, comments, names,
operators, brackets, line ends) in one pass, and a small parser over them finds
name-literal pairs: quoted keys, dotted and indexed names, names with a type,
``=``, ``:``, ``:=``, ``=>``, quoted or bare literals, joined parts, arguments of
a call, block values, elements of markup, and a name and its value given as two
keys.  Names may be of any length and stand at any distance.  Constants
propagate, also from a later line: a name among the parts of a value stands for
its own literals.  A literal is scored by how sensitive its target name is and
by its own form.  Comments are read on their own and define no constants for the
code.  Three plain patterns (assign, access, hex) run beside it, and their spans
always stay.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from rivulet.llm.common import ship, slices, text_of

# The base patterns. A means ASCII letters only in either case.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "literal")

#: Sensitive parts of names and their weight.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "accesskey": 1.0,
    "privatekey": 1.0, "secretkey": 1.0, "authkey": 0.9, "signingkey": 0.9, "encryptionkey": 0.9, "credential": 0.9, "credentials": 0.9,
    "bearer": 0.8, "authorization": 0.8, "auth": 0.6, "key": 0.6, "salt": 0.6, "cert": 0.6, "session": 0.6, "pin": 0.6,
}
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|changeme|change_me|example|placeholder|none|null|true|false|undefined|todo|your[\w-]*|<.*>|\$\{.*\}|%\(.*\)s|\{\{.*\}\})$")
#: Every name of weight holds one of these, so texts without any are not cut into tokens.
HINT = re.compile("pass|pwd|secret|token|key|credential|bearer|auth|salt|cert|session|pin", re.IGNORECASE)
_STRING = r"""\"\"\"(?:[^\\]|\\.)*?\"\"\"|\'\'\'(?:[^\\]|\\.)*?\'\'\'|"(?:[^"\\\n]|\\[^\n])*"|(?<!\w)'(?:[^'\\\n]|\\[^\n])*'|`[^`\n]*`"""
TOKEN = re.compile(
    rf"""(?P<string>{_STRING})|(?P<comment>/\*(?:.*?\*/|.*)|<!--(?:.*?-->|.*)|(?<![:/\w])//[^\n]*|(?<![^\s;])\#[^\n]*)|(?P<name>[A-Za-z_$][\w$]*(?:[.\-][A-Za-z_][\w$]*)*)"""
    r"""|(?P<pass>[=!<>]==?|=~|::|->|[0-9][\w.]*)|(?P<op>:=|=>|\+=|=|:)|(?P<line>\n)|(?P<close>[)\]}])|(?P<open>[(\[{])|(?P<mark>[;,<>|&?!*+])""",
    re.DOTALL,
)
VALUE = re.compile(rf"""[ \t]*(?:(?P<string>{_STRING})|(?P<call>(?:new[ \t]+)?[A-Za-z_$][\w$]*(?:(?:\.|::)[\w$]+)*[ \t]*\()|(?P<bare>[^\s"'`,;(){{}}\[\]<>=:]+(?:==?(?![^\s"'`,;(){{}}\[\]<>]))?))""", re.DOTALL)
#: The same without comments, for what stands in one.
PLAIN = re.compile(TOKEN.pattern.replace("(?P<comment>", "(?P<comment>(?!)"), re.DOTALL)
JOIN = re.compile(r"[ \t]*(?:\+|\|\||\.\.?(?=[ \t]*[\"'$A-Za-z_])|&)?[ \t]*(?:\\?\n[ \t]*(?=[\"'+.]))?[ \t]*(?:\+[ \t]*)?")
SPACE, COMMA, CLOSE = re.compile(r"\s*"), re.compile(r"\s*,\s*"), re.compile(r"\s*\)")
BLOCK = re.compile(r"[ \t]*[|>][+\-0-9]*[ \t]*\n((?:[ \t]*\n)*)([ \t]+)")
MARKUP = re.compile(r"<([A-Za-z_][\w:.\-]*)(?:\s[^<>]*)?>\s*([^<>\s]+)\s*</\1\s*>")
ASSIGNED = re.compile(r"[ \t]*=(?![=~])")
REFERENCE = re.compile(r"[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*")
#: Calls whose first argument names what they look up.
LOOKUPS = {"get", "getenv", "env", "environ", "property", "getproperty", "setting", "config", "fetch", "lookup"}
#: Types that are not taken for constants of that name.
TYPES = {"str", "string", "bytes", "bytearray", "char", "any", "object", "text", "none", "null", "undefined"}
WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
LEAST_SCORE = 0.75


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def name_weight(name: str) -> float:
    parts = [w.lower() for w in WORD.findall(name)]
    pairs = [a + b for a, b in zip(parts, parts[1:])]
    return max((SENSITIVE.get(x, 0.0) for x in parts + pairs), default=0.0)


def literal_weight(value: str) -> float:
    if len(value) < 6 or PLACEHOLDER.match(value) or any(c.isspace() for c in value):
        return 0.0
    kinds = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(1.0, 0.35 + 0.1 * kinds + 0.1 * min(entropy(value), 4.5))


class Parts(list):
    """A value: (literal, start, end) and names that stand for others' literals."""


def _inner(token: str, start: int) -> tuple[str, int, int]:
    """A string token without its quotes."""
    n = 3 if len(token) > 5 and token[:3] in ('"""', "\'\'\'") else 1
    return token[n:-n], start + n, start + len(token) - n


def _block(text: str, at: int) -> tuple[str, int, int] | None:
    """The indented lines after ``|`` or ``>``, joined without white space."""
    m = BLOCK.match(text, at)
    if not m:
        return None
    start, stop, pos = m.end(), m.end(), m.end()
    while True:
        end = text.find("\n", pos)
        end = len(text) if end < 0 else end
        stop = end
        if not text.startswith(m[2], end + 1):
            break
        pos = end + 1 + len(m[2])
    return "".join(text[start:stop].split()), start, stop


def _value(text: str, at: int, depth: int = 0) -> tuple[Parts, int]:
    """The parts of the value that begins at ``at``, and where it ends."""
    parts = Parts()
    if not depth and (block := _block(text, at)):
        return Parts([block]), block[2]
    if depth:
        at = SPACE.match(text, at).end()
    while m := VALUE.match(text, at):
        if m["string"]:
            parts.append(_inner(m["string"], m.start("string")))
            at = m.end()
        elif m["call"]:
            name = m["call"].rstrip("( \t").rsplit(".", 1)[-1].lower()
            at, first = m.end(), True
            while depth < 8:
                own, end = _value(text, at, depth + 1)
                if not (first and name in LOOKUPS):
                    parts += own
                first, comma = False, COMMA.match(text, end)
                if not comma or end == at:
                    break
                at = comma.end()
            close = CLOSE.match(text, end) if depth < 8 else None
            at = close.end() if close else (end if depth < 8 else at)
        else:
            value = m["bare"]
            at = m.end()
            if REFERENCE.fullmatch(value):
                # With a digit it may be a literal as well as a name.
                parts.append((value, m.start("bare"), at, value) if re.search(r"\d", value) else value)
            elif re.fullmatch(r"[A-Za-z_][\w.]*[?!]", value) and ASSIGNED.match(text, at):
                return Parts(), at  # a type
            else:
                parts.append((value, m.start("bare"), at))
        more = JOIN.match(text, at)
        joined = text[at : more.end()]
        if not (("+" in joined or "||" in joined or "&" in joined or "." in joined) or (m["string"] and joined.strip(" \t") == "" and text[more.end() : more.end() + 1] in ("\"", "'"))):
            break
        at = more.end()
    return parts, at


def _target(tokens: list, at: int) -> str | None:
    """The name that ends before token number ``at``; of an index in quotes, its last one.  A closing bracket holds the number of its opening one."""
    at -= 1
    while at >= 0 and tokens[at][1] == "]":
        start = tokens[at][2]
        if start is None:
            return None
        if at - start == 2 and tokens[at - 1][0] == "string":
            return _inner(tokens[at - 1][1], 0)[0]
        at = start - 1
    while at >= 0 and tokens[at][1] in ("?", "!"):
        at -= 1
    if at >= 0 and tokens[at][0] == "name":
        return tokens[at][1]
    if at >= 0 and tokens[at][0] == "string":
        inner = _inner(tokens[at][1], 0)[0]
        return inner if re.fullmatch(r"[A-Za-z_][\w.\- ]*", inner) else None
    return None


def _assignments(text: str, nested: bool) -> tuple[list[tuple[str, Parts]], list[tuple[int, int]]]:
    """(target name, value) in order, and where the comments are."""
    found, comments, tokens, opened, colon, named = [], [], [], [], -1, ""
    for m in (PLAIN if nested else TOKEN).finditer(text):
        kind = m.lastgroup
        if kind == "comment":
            comments.append((m.start(), m.end()))
        elif kind == "line" or (kind == "mark" and m[0] in ";,"):
            tokens, opened, colon = [], [], -1
        elif kind == "open":
            opened.append(len(tokens))
            tokens.append((kind, m[0], None))
        elif kind == "close":
            tokens.append((kind, m[0], opened.pop() if opened else None))
        elif kind != "op":
            tokens.append((kind, m[0], None))
        else:
            names = [n for n in (_target(tokens, len(tokens)), _target(tokens, colon) if m[0] == "=" and colon > 0 else None) if n]
            if names:
                parts, _ = _value(text, m.end())
                literal = parts[0][0] if len(parts) == 1 and isinstance(parts[0], tuple) else parts[0] if len(parts) == 1 else ""
                # ``name: X`` and ``value: Y`` are X with the value Y.
                if named and names[0].lower() == "value":
                    names.append(named)
                named = literal if names[0].lower() in ("name", "key") else named
                found += [(n, parts) for n in names if parts and (len(names) == 1 or n.lower() not in TYPES)]
            if m[0] == ":":
                colon = len(tokens)
            tokens.append((kind, m[0], None))
    return found, comments


def _one(parts: Parts, literals: list) -> tuple[str, int, int] | None:
    """What a name stands for elsewhere: its joined literal, or the longest of several that do not lie side by side."""
    if literals and all(isinstance(p, tuple) and len(p) == 3 for p in parts):
        return "".join(x[0] for x in literals), literals[0][1], literals[-1][2]
    return max(literals, key=lambda x: len(x[0]), default=None)


def pairs_of(text: str, nested: bool = False) -> list[tuple[str, str, int, int]]:
    """(name, literal, start, end) in order; a name in a value stands for the literal given to it last before, or else first after."""
    found, comments = _assignments(text, nested)
    if "</" in text:
        found += [(m[1].rsplit(":", 1)[-1], Parts([(m[2], m.start(2), m.end(2))])) for m in MARKUP.finditer(text)]
    out, later = [], {}
    for last in (False, True):
        latest, first = {}, {}
        for n, parts in found:
            literals = []
            for p in parts:
                name = p if isinstance(p, str) else p[3] if len(p) > 3 else None
                given = (latest.get(name) or later.get(name)) if name and name != n else None
                literals += [given] if given else [p[:3]] if isinstance(p, tuple) else []
            one = _one(parts, literals)
            if one:
                latest[n] = one
                first.setdefault(n, one)
                if last and one[0] == "".join(x[0] for x in literals):
                    out.append((n, *one))
                elif last:
                    # Parts in several places count by what they make together.
                    whole = "".join(x[0] for x in literals)
                    out += [(n, whole, x[1], x[2]) for x in literals]
        later = first
    for start, end in comments:
        inner = text[start + 1 : end]
        if HINT.search(inner):
            out += [(n, v, s + start + 1, e + start + 1) for n, v, s, e in pairs_of(inner, True)]
    return out


def literal_spans(text: str) -> list[tuple[int, int, float]]:
    found = {}
    if ("=" in text or ":" in text or "</" in text) and HINT.search(text):
        for name, value, start, end in pairs_of(text):
            score = math.sqrt(name_weight(name) * literal_weight(value))
            if score >= LEAST_SCORE:
                found[start, end] = max(score, found.get((start, end), 0.0))
    return [(s, e, score) for (s, e), score in sorted(found.items())]


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base patterns, by start, then kind as listed."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _render(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _scan(batches):
    for b in slices(batches):
        rows = []
        for t in b.column(1).to_pylist():
            base = base_spans(t)
            more = literal_spans(t)
            kinds = [k for _, k, _ in base]
            every = sorted(base + [(s, 3, e) for s, e, _ in more])
            rows.append((kinds.count(0), kinds.count(1), kinds.count(2), _render(base), _render(every), max((x for *_, x in more), default=0.0)))
        cols = list(zip(*rows)) if rows else [()] * 6
        kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.float64()]
        yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds)]], ["doc_id", "n_assign", "n_access", "n_hex", "base_spans", "spans", "top_score"])


def secret_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_spans, spans, top_score: one row per input row, in one pass without a shuffle.

    Spans are ``kind:start:end`` in code points, end exclusive, by start, then
    kind.  Null and empty texts have none; repeated rows repeat their result.
    """
    slim = ship(docs).select(docs["doc_id"].alias("doc_id"), text_of(docs).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(_scan, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_spans string, spans string, top_score double")


def digest(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()
