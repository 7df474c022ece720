r"""Rule text to Java regular expressions.

Rules are written in Python's regular-expression dialect.  Spark evaluates Java's.
The two agree on syntax almost everywhere and disagree on what ``\w``, ``\s``, ``\d``,
``\b``, ``.`` and ``$`` mean outside ASCII, so those are spelled out.  A rule that
cannot be said in Java raises :class:`RuleError`; nothing falls back to Python.
"""

from __future__ import annotations

import re

try:  # the parse tree of a rule, used only to find a literal every match contains
    from re import _constants as _ops
    from re import _parser as _tree
except ImportError:  # pragma: no cover - older layouts
    _tree = _ops = None

# --- fixed values: character classes, spelled as Java class members -----------
WORD = r"\p{L}\p{N}_"
DIGIT = r"\p{Nd}"
SPACE = (
    r"\t\n\x0B\f\r\x1C-\x20\x85\xA0"
    r"\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
)

_INLINE_FLAGS = re.compile(r"\A\(\?([a-zA-Z]+)\)")
_BEFORE_WORD = f"(?<![{WORD}])"
_AFTER_WORD = f"(?![{WORD}])"
_ESCAPES = {
    "w": f"[{WORD}]",
    "W": f"[^{WORD}]",
    "s": f"[{SPACE}]",
    "S": f"[^{SPACE}]",
    "d": DIGIT,
    "D": r"\P{Nd}",
    "b": f"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))",
    "B": f"(?:(?<=[{WORD}])(?=[{WORD}])|(?<![{WORD}])(?![{WORD}]))",
    "Z": r"\z",
}
_CLASS_ESCAPES = {"w": WORD, "s": SPACE, "d": DIGIT, "b": r"\x08"}


class RuleError(ValueError):
    """A rule is empty or cannot be expressed in the regex dialect Spark uses."""


def sql_literal(value: str) -> str:
    """A string literal for SQL text."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def is_word_char(ch: str) -> bool:
    return ch == "_" or ch.isalnum()


def inline_flags(source: str) -> str:
    """Letters of a leading global flag group, e.g. ``i`` for ``(?i)abc``."""
    found = _INLINE_FLAGS.match(source)
    return found.group(1) if found else ""


def _flag_group(ignore_case: bool, extra: str = "") -> str:
    # d: only \n ends a line, as in Python.  u with i: fold case beyond ASCII.
    return "(?d" + ("iu" if ignore_case else "") + extra + ")"


def phrase_to_java(source: str, case_sensitive: bool = False) -> str:
    """Whole-word literal; any run of white space may separate its words."""
    tokens = source.split()
    if not tokens:
        raise RuleError("phrase pattern is empty")
    body = f"[{SPACE}]+".join(re.escape(token) for token in tokens)
    if is_word_char(tokens[0][0]):
        body = _starting_word(tokens[0][0]) + body[1:]
    tail = _AFTER_WORD if is_word_char(tokens[-1][-1]) else ""
    return _flag_group(not case_sensitive) + body + tail


def _starting_word(ch: str) -> str:
    """A letter with no word character before it; the letter goes first, being rarer."""
    return f"{ch}(?<![{WORD}]{ch})"


def regex_to_java(source: str, case_sensitive: bool | None = None, groups_before: int = 0) -> str:
    """A Python regex as a Java one; case matters unless ``(?i)`` or told otherwise.

    ``groups_before`` shifts numbered back-references when the pattern is to be embedded
    behind that many groups.
    """
    if not source.strip():
        raise RuleError("regex pattern is empty")
    flags = inline_flags(source)
    if set(flags) - set("ims"):
        raise RuleError(f"inline flag(s) {flags!r} have no Spark counterpart")
    ignore_case = "i" in flags or case_sensitive is False
    body = source[len(flags) + 3 :] if flags else source
    extra = "".join(f for f in "ms" if f in flags)
    return _flag_group(ignore_case, extra) + _translate(body, groups_before)


def after_prefix(java: str) -> str:
    """The same pattern with the text before its first match as group 1."""
    flags, _, body = java.partition(")")
    return rf"{flags})\A([\s\S]*?)(?:{body})"


_ATOM = re.compile(
    r"\\(?:x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|N\{[^}]*\}|[0-9]{1,3}|.)"  # an escape
    r"|\[\^?\]?(?:\\.|[^\]\\])*\]"  # a class
    r"|(?:[*+?]|\{\d+(?:,\d*)?\}|\{,\d+\})[?+]?"  # how often
    r"|.",
    re.S,
)
_WORD_CLASS = re.compile(r"\[(?:[a-z](?:-[a-z])?|[A-Z](?:-[A-Z])?|[0-9](?:-[0-9])?|\\[wd])+\]")


def _is_word(atom: str) -> bool:
    """Can the atom be nothing but one word character?"""
    return atom in (r"\w", r"\d") or (len(atom) == 1 and atom.isascii() and atom.isalnum()) or bool(_WORD_CLASS.fullmatch(atom))


def _at_least_once(quantifier: str) -> bool:
    return quantifier[0] == "+" or bool(re.match(r"\{0*[1-9]", quantifier))


def _is_quantifier(atom: str) -> bool:
    return atom[0] in "*+?" or (atom[0] == "{" and len(atom) > 1)


def _ends_in_word(text: str) -> bool:
    """Does rule text only match what ends in a word character?  False if that cannot be told."""
    atoms = _ATOM.findall(text)
    while atoms:
        last = atoms.pop()
        if not _is_quantifier(last):
            return _is_word(last)
        if not atoms or not _is_word(atoms[-1]):
            return False
        if _at_least_once(last):
            return True
        atoms.pop()  # may be absent, so what stands before it must end in a word as well
    return False


def _begins_with_word(text: str) -> bool:
    atoms = _ATOM.findall(text)
    return bool(atoms) and _is_word(atoms[0]) and (len(atoms) == 1 or not _is_quantifier(atoms[1]) or _at_least_once(atoms[1]))


def _alternatives(group: str) -> list[str]:
    """Top-level alternatives of a group's inside."""
    out, depth, in_class, start, i = [], 0, False, 0, 0
    while i < len(group):
        ch = group[i]
        if ch == "\\":
            i += 1
        elif in_class:
            in_class = ch != "]"
        elif ch == "[":
            in_class = True
        elif ch in "()":
            depth += 1 if ch == "(" else -1
        elif ch == "|" and depth == 0:
            out.append(group[start:i])
            start = i + 1
        i += 1
    return [*out, group[start:]]


def _group_spans(body: str) -> dict[int, int]:
    """Opening to closing position of every plain group."""
    spans, opened, in_class, i = {}, [], False, 0
    while i < len(body):
        ch = body[i]
        if ch == "\\":
            i += 1
        elif in_class:
            in_class = ch != "]"
        elif ch == "[":
            in_class = True
            i += body[i + 1 : i + 3].startswith(("]", "^]")) * (1 + (body[i + 1] == "^"))
        elif ch == "(":
            opened.append(i)
        elif ch == ")" and opened:
            spans[opened.pop()] = i
        i += 1
    return spans


def _inside(body: str, start: int, end: int) -> str | None:
    """What a capturing or plain non-capturing group holds; other groups are not read."""
    inner = body[start + 1 : end]
    if inner.startswith("?:"):
        return inner[2:]
    return None if inner.startswith("?") else inner


def _word_edge(body: str, i: int, spans: dict[int, int]) -> str:
    """The word-edge test at ``i``; only the half that its neighbours leave open.

    Beside something that must be a word character one look in the other direction says
    it all, which is several times cheaper than the general test.
    """
    before, after = body[:i], body[i + 2 :]
    closed = {end: start for start, end in spans.items()}
    ends = [before]
    if before.endswith(")") and not before.endswith("\\)") and i - 1 in closed:
        inner = _inside(body, closed[i - 1], i - 1)
        ends = _alternatives(inner) if inner else [""]
    if all(_ends_in_word(x) for x in ends):
        return _AFTER_WORD
    starts = [after]
    if after.startswith("(") and i + 2 in spans:
        end = spans[i + 2]
        inner = _inside(body, i + 2, end)
        optional = body[end + 1 : end + 2] in ("?", "*", "{")
        starts = _alternatives(inner) if inner and not optional else [""]
    if all(_begins_with_word(x) for x in starts):
        return _BEFORE_WORD
    return _ESCAPES["b"]


def _translate(body: str, groups_before: int = 0) -> str:
    out: list[str] = []
    spans = _group_spans(body)
    in_class = negated = False
    class_start = -1
    i = 0
    while i < len(body):
        ch = body[i]
        if ch == "\\":
            if i + 1 >= len(body):
                raise RuleError("pattern ends in a bare backslash")
            letter, following, after = body[i + 1], body[i + 2 : i + 3], body[i + 3 : i + 4]
            if letter == "b" and not in_class:
                edge = _word_edge(body, i, spans)
                if edge == _BEFORE_WORD and following.isalnum() and after not in ("+", "{"):
                    out.append(_starting_word(following))
                    i += 3
                    continue
                out.append(edge)
            elif letter.isdigit() and letter != "0" and not in_class:
                out.append(f"\\{int(letter) + groups_before}")
            else:
                out.append(_escape(letter, in_class, negated))
            i += 2
            continue
        if in_class:
            if ch == "]" and i > class_start:
                in_class = False
                out.append("]")
            else:
                out.append("\\" + ch if ch in "[]&~" else ch)
        elif ch == "[":
            in_class = True
            negated = body[i + 1 : i + 2] == "^"
            class_start = i + (2 if negated else 1)
            out.append("[^" if negated else "[")
            i += 1 if negated else 0
        elif body.startswith("(?P<", i):
            out.append("(?<")
            i += 3
        elif body.startswith("(?P=", i):
            name, _, _ = body[i + 4 :].partition(")")
            out.append(rf"\k<{name}>")
            i += 4 + len(name)
        else:
            out.append(ch)
        i += 1
    return "".join(out)


def _escape(letter: str, in_class: bool, negated: bool) -> str:
    if in_class:
        if letter in "WSD":
            if negated:
                raise RuleError(rf"\{letter} inside a negated class")
            return _ESCAPES[letter]
        return _CLASS_ESCAPES.get(letter, "\\" + letter)
    return _ESCAPES.get(letter, "\\" + letter)


def required_words(source: str) -> tuple[str, ...]:
    """The folded words of an ASCII phrase: each must stand in the text as a whole word."""
    return tuple(re.findall(r"[a-z0-9_]+", source.lower())) if source.isascii() else ()


#: Most spellings of one place in a rule that it is filed under.
SPELLINGS = 24


def whole_words(source: str, kind: str) -> tuple[str, ...]:
    """Folded ASCII words of which every match holds at least one, as a whole word; empty if unknown.

    A rule can be filed under them: a text without any of these words cannot match it.
    """
    if kind == "phrase":
        found = required_words(source)
        return (max(found, key=len),) if found else ()
    if _tree is None:
        return ()
    try:
        parsed = _tree.parse(source)
    except re.error:
        return ()
    return tuple(sorted(_word_options(list(parsed), False, False) or ()))


def _spellings(op, arg) -> list[str] | None:
    """Every string of word characters that a parse node can match, or None."""
    if op is _ops.LITERAL:
        return [chr(arg)] if is_word_char(chr(arg)) else None
    if op is _ops.IN:
        each = [chr(x) if kind is _ops.LITERAL else "" for kind, x in arg]
        return each if len(each) <= 4 and all(x and is_word_char(x) for x in each) else None
    if op is _ops.MAX_REPEAT and tuple(arg[:2]) == (0, 1):
        inner = _spelled(list(arg[2]))
        return None if inner is None else ["", *inner]
    if op is _ops.SUBPATTERN and not arg[1] and not arg[2]:
        return _spelled(list(arg[3]))
    if op is _ops.BRANCH:
        parts = [_spelled(list(branch)) for branch in arg[1]]
        return None if None in parts else [x for part in parts for x in part]
    return None


def _spelled(items) -> list[str] | None:
    out = [""]
    for op, arg in items:
        more = _spellings(op, arg)
        if more is None or len(out) * len(more) > SPELLINGS:
            return None
        out = [x + y for x in out for y in more]
    return out


def _parts_words(op, arg) -> bool:
    """Is there certainly no word character on either side of the node's place?"""
    if op is _ops.AT:
        return arg is _ops.AT_BOUNDARY
    if op is _ops.LITERAL:
        return not is_word_char(chr(arg))
    if op is _ops.IN:
        return all((kind is _ops.LITERAL and not is_word_char(chr(x))) or (kind is _ops.CATEGORY and x is _ops.CATEGORY_SPACE) for kind, x in arg)
    return op is _ops.MAX_REPEAT and arg[0] >= 1 and len(arg[2]) == 1 and _parts_words(*arg[2][0])


def _word_options(items: list, left: bool, right: bool) -> set[str] | None:
    """The best set of whole words that a sequence implies; ``left`` and ``right`` say that words end at its ends."""
    parted = [left, *[_parts_words(*item) for item in items], right]
    options: list[set[str]] = []
    start = 0
    while start < len(items):
        end, words = start, [""]
        while end < len(items) and (more := _spellings(*items[end])) is not None and len(words) * len(more) <= SPELLINGS:
            words = [x + y for x in words for y in more]
            end += 1
        if end > start and parted[start] and parted[end + 1] and all(w and w.isascii() for w in words):
            options.append({w.lower() for w in words})
        op, arg = items[start]
        if op in (_ops.SUBPATTERN, _ops.BRANCH):
            inner, edges = None, (parted[start], parted[start + 2])
            if op is _ops.SUBPATTERN and not arg[1] and not arg[2]:
                inner = _word_options(list(arg[3]), *edges)
            elif op is _ops.BRANCH:
                parts = [_word_options(list(branch), *edges) for branch in arg[1]]
                inner = set().union(*parts) if all(parts) else None
            if inner:
                options.append(inner)
        start = max(end, start + 1)
    return max(options, key=lambda s: (min(map(len, s)), -len(s)), default=None)


def required_literals(source: str, kind: str) -> tuple[str, ...]:
    """ASCII literals of which every match contains at least one; empty if unknown.

    A plain substring test on these is far cheaper than the regex and decides most
    records, so it runs first.  It can only say "cannot match"; it never labels.
    """
    if kind == "phrase":
        runs = re.findall(r"[^\s]+", source)
        runs = [r for r in runs if r.isascii()]
        return (max(runs, key=len).lower(),) if runs else ()
    if _tree is None:
        return ()
    try:
        found = _best_literals(_tree.parse(source))
    except re.error:
        return ()
    found = found or set()
    telling = lambda x: len(x) >= 2 or not (x.isalnum() or x.isspace())
    usable = found and all(telling(x) and x.isascii() and x.isprintable() for x in found)
    return tuple(sorted(x.lower() for x in found)) if usable else ()


def _best_literals(items) -> set[str] | None:
    """Literal sets implied by a sequence of parse nodes; keep the most selective."""
    options: list[set[str]] = []
    run = ""
    for op, arg in list(items) + [(None, None)]:
        if op is _ops.LITERAL and op is not None:
            run += chr(arg)
            continue
        if run:
            options.append({run})
            run = ""
        inner = None
        if op is None:
            continue
        if op is _ops.SUBPATTERN and not arg[1] and not arg[2]:
            inner = _best_literals(arg[3])
        elif op is _ops.ASSERT and arg[0] >= 0:
            inner = _best_literals(arg[1])
        elif op is _ops.MAX_REPEAT and arg[0] >= 1:
            inner = _best_literals(arg[2])
        elif op is _ops.BRANCH:
            parts = [_best_literals(branch) for branch in arg[1]]
            if all(parts) and len(parts) <= 12:
                inner = set().union(*parts)
        if inner:
            options.append(inner)
    return max(options, key=lambda s: (min(map(len, s)), -len(s)), default=None)
