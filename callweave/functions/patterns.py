"""Equivalent, cheaper forms of find-anywhere patterns.

The regular-expression matcher of the JVM tries every alternative at every
character. Most characters cannot start a match, so each pattern gets a
look-ahead for its possible first characters: one class test then decides most
positions, and several patterns can share one scan of the text. A match is found
in exactly the same texts.

Only patterns whose every construct means the same to the parser used here and to the
matcher are rewritten, see :func:`understood`; all others stay as they are.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import lru_cache

try:
    from re import _parser as sre
except ImportError:  # Python before 3.11
    import sre_parse as sre

#: An optional opening of clause characters. It can match the empty string, so
#: at the start of a find-anywhere pattern it never decides a match.
CLAUSE_OPENING = "(，|。|！|？)?[^，。！？]*"
#: Anything before a match on the first line.
LINE_OPENING = "^.*"
WIDEST_RANGE = 64
#: Beyond this many words one scan with the pattern is cheaper than word searches.
MOST_WORDS = 10


#: Flags, look-around, named groups, references, quotes and escapes that either stand for
#: something else in the two syntaxes or tie a part of a pattern to another part.
_SPECIAL = re.compile(r"\(\?(?!:)|\\[0-9kQEGXRNzZabcehvHVpP]|\[\^?\]|\\\\x|\{,")


@lru_cache(maxsize=None)
def understood(pattern: str) -> bool:
    """Whether a pattern may be split and guarded without changing what it finds."""
    if _SPECIAL.search(pattern) or _parsed(pattern) is None:
        return False
    in_class, escaped, before = False, False, ""
    for char in pattern:
        if escaped:
            escaped, before = False, ""
            continue
        if in_class and (char == "[" or char == before == "&"):
            return False  # classes inside classes, intersections
        escaped = char == "\\"
        if char == "[":
            in_class = True
        elif char == "]":
            in_class = False
        before = char
    return True


def alternatives(pattern: str) -> list[str]:
    """The alternatives of a pattern's outermost level."""
    found, depth, in_class, escaped = [""], 0, False, False
    for char in pattern:
        if escaped:
            escaped = False
        elif char == "\\":
            escaped = True
        elif in_class:
            in_class = char != "]"
        elif char == "[":
            in_class = True
        elif char in "()":
            depth += 1 if char == "(" else -1
        elif char == "|" and depth == 0:
            found.append("")
            continue
        found[-1] += char
    return found


def _first(items) -> tuple[set[str], bool] | None:
    """First characters of a parsed sequence and whether it can be empty."""
    found: set[str] = set()
    for op, value in items:
        step = _first_of_item(op, value)
        if step is None:
            return None
        found |= step[0]
        if not step[1]:
            return found, False
    return found, True


def _first_of_item(op, value) -> tuple[set[str], bool] | None:
    if op is sre.LITERAL:
        return {chr(value)}, False
    if op is sre.SUBPATTERN:
        return _first(value[-1])
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        step = _first(value[2])
        return step and (step[0], step[1] or value[0] == 0)
    if op is sre.BRANCH:
        steps = [_first(items) for items in value[1]]
        if None in steps:
            return None
        return set().union(*(s[0] for s in steps)), any(s[1] for s in steps)
    if op is sre.IN:
        chars: set[str] = set()
        for kind, member in value:
            if kind is sre.LITERAL:
                chars.add(chr(member))
            elif kind is sre.RANGE and member[1] - member[0] < WIDEST_RANGE:
                chars.update(map(chr, range(member[0], member[1] + 1)))
            else:
                return None
        return chars, False
    return None


def first_characters(pattern: str) -> set[str] | None:
    """All characters a match can start with; ``None`` when unknown or empty."""
    parsed = _parsed(pattern)
    step = parsed and _first(parsed)
    return step[0] if step and not step[1] else None


def _needed(items) -> set[str] | None:
    """Words of which every match of a parsed sequence contains one; the fewest found."""
    choices: list[set[str]] = []
    run = ""
    for op, value in items:
        if op is sre.LITERAL:
            run += chr(value)
            continue
        if run:
            choices.append({run})
            run = ""
        if op is sre.SUBPATTERN:
            words = _needed(value[-1])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[0] > 0:
            words = _needed(value[2])
        elif op is sre.BRANCH:
            parts = [_needed(part) for part in value[1]]
            words = None if None in parts else set().union(*parts)
        elif op is sre.IN and all(kind is sre.LITERAL for kind, _ in value):
            words = {chr(member) for _, member in value}
        else:
            words = None
        if words:
            choices.append(words)
    if run:
        choices.append({run})
    return min(choices, key=lambda w: (len(w), -min(map(len, w))), default=None)


def _parsed(pattern: str):
    python_form = re.sub(r"\\x\{([0-9a-fA-F]{4})\}", r"\\u\1", pattern)
    try:
        parsed = sre.parse(python_form)
    except (re.error, OverflowError):
        return None
    return parsed if parsed.state.flags == re.UNICODE.value and parsed.state.groupdict == {} else None


def needed_words(patterns: Sequence[str]) -> list[str] | None:
    """Words of which a text contains at least one if any pattern is found in it.

    ``None`` when there are no such words, or too many to search for one by one.
    """
    words: set[str] = set()
    for pattern in patterns:
        parsed = _parsed(pattern)
        found = parsed and _needed(parsed)
        if not found:
            return None
        words |= found
    shortest = {w for w in words if not any(o != w and o in w for o in words)}
    return sorted(shortest) if len(shortest) <= MOST_WORDS else None


def plain_words(patterns: Sequence[str]) -> tuple[list[str], tuple[str, ...]]:
    """Alternatives that are words without pattern characters, and the others."""
    parts = list(dict.fromkeys(a for p in patterns for a in alternatives(p)))
    words = [p for p in parts if not re.search(r"[\\^$.|?*+()\[\]{}]", p)]
    if len(words) > MOST_WORDS:
        return [], tuple(parts)
    return words, tuple(p for p in parts if p not in words)


def _ahead(chars: set[str]) -> str:
    """Look-ahead for one of ``chars``. A class of Han characters is tested one by
    one, so the test for the Han block comes first."""
    inside = "".join(re.sub(r"([\\\]\[^&-])", r"\\\1", c) for c in sorted(chars))
    if len(chars) > 2 and all("\u4e00" <= c <= "\u9fa5" for c in chars):
        return f"(?=[\u4e00-\u9fa5&&[{inside}]])"
    return f"(?=[{inside}])"


def _opens(pattern: str, opening: str) -> bool:
    """Whether the opening stands there as a whole, without a further quantifier."""
    return pattern.startswith(opening) and pattern[len(opening) : len(opening) + 1] not in set("?+*{")


def _guarded(pattern: str) -> tuple[str, set[str] | None]:
    """One alternative with its look-ahead, and its first characters."""
    opening = ""
    while _opens(pattern, CLAUSE_OPENING):
        pattern = pattern[len(CLAUSE_OPENING):]
    if _opens(pattern, LINE_OPENING):
        opening, pattern = LINE_OPENING, pattern[len(LINE_OPENING):]
    rest = pattern.removesuffix(".*")
    if (len(rest) - len(rest.rstrip("\\"))) % 2 == 0:  # else the dot is escaped
        pattern = rest
    chars = first_characters(pattern)
    guarded = opening + (_ahead(chars) if chars else "") + pattern
    return guarded, None if opening else chars


@lru_cache(maxsize=None)
def one_scan(patterns: tuple[str, ...]) -> str:
    """One pattern found wherever any of ``patterns`` is."""
    parts = [_guarded(a) for p in dict.fromkeys(patterns) for a in alternatives(p)]
    free = [(text, chars) for text, chars in parts if chars]
    bound = [text for text, chars in parts if not chars]
    if len(free) > 1:
        shared = _ahead(set().union(*(chars for _, chars in free)))
        scan = [f"{shared}(?:{'|'.join(text for text, _ in free)})"]
    else:
        scan = [text for text, _ in free]
    return "|".join(bound + scan)
