"""Regular expressions of the linear-time dialect, for Python and for Spark's Java engine.

What that dialect lacks (look-around, back-references, possessive and atomic groups) is refused.
``$`` and ``\\z`` match only at the very end, ``\\d \\w \\s`` are ASCII, and ``\\s`` has no
vertical tab.
"""

from __future__ import annotations

from functools import lru_cache

_CLASS = {"d": "0-9", "w": "0-9A-Za-z_", "s": "\\t\\n\\f\\r "}
_ESCAPES = set("AbBzadDfnprPQEstvwWSx0") | set("\\.+*?()|[]{}^$/-_\"' ,:;<>=!@#%&~`")


class InvalidPattern(ValueError):
    """A pattern outside the dialect."""


def _translate(pattern: str, end: str, java: bool) -> str:
    out: list[str] = []
    i, n, inside = 0, len(pattern), False
    while i < n:
        c = pattern[i]
        if c == "\\":
            if i + 1 >= n:
                raise InvalidPattern("trailing backslash")
            e = pattern[i + 1]
            if e.isdigit() and e != "0" or e not in _ESCAPES and ord(e) < 128:
                raise InvalidPattern(f"invalid escape \\{e}")
            if e == "z" and not inside:
                out.append(end)
            elif e in _CLASS:
                out.append(_CLASS[e] if inside else f"[{_CLASS[e]}]")
            elif e.lower() in _CLASS and not inside:
                out.append(f"[^{_CLASS[e.lower()]}]")
            elif e in "pP":
                j = i + 2
                name = pattern[j : j + 1]
                if name == "{":
                    close = pattern.find("}", j)
                    if close < 0:
                        raise InvalidPattern("unclosed class name")
                    name, j = pattern[j + 1 : close], close
                if not name:
                    raise InvalidPattern("missing class name")
                negated = name.startswith("^")
                name = name.lstrip("^")
                sign = "P" if (e == "P") != negated else "p"
                long = java and len(name) > 2
                out.append(f"\\{sign}{{{'Is' if long else ''}{name}}}")
                i = j + 1
                continue
            elif e == "a":
                out.append("\\x07")
            elif e == "/":
                out.append("/")
            else:
                out.append(c + e)
            i += 2
            continue
        if inside:
            if c == "]" and i > inside_at:
                inside = False
            elif c == "[" and pattern[i + 1 : i + 2] == ":":
                close = pattern.find(":]", i)
                name = pattern[i + 2 : close] if close > 0 else ""
                posix = {"alpha": "A-Za-z", "digit": "0-9", "alnum": "0-9A-Za-z", "upper": "A-Z", "lower": "a-z", "space": "\\t\\n\\x0b\\f\\r ", "punct": "!-/:-@\\[-`{-~", "xdigit": "0-9A-Fa-f", "word": "0-9A-Za-z_"}.get(name)
                if posix is None:
                    raise InvalidPattern("unknown character class")
                out.append(posix)
                i = close + 2
                continue
            elif c in "[&":
                out.append("\\")
            out.append(c)
        elif c == "[":
            inside, inside_at = True, i + 1 + (pattern[i + 1 : i + 2] == "^")
            out.append(c)
            if pattern[inside_at : inside_at + 1] == "]":
                out.append(pattern[i + 1 : inside_at] + "\\]")
                i = inside_at
                inside_at += 1
        elif c == "(" and pattern[i + 1 : i + 2] == "?":
            rest = pattern[i + 2 : i + 4]
            if rest[:1] in ("=", "!", ">", "#", "(", "|") or rest in ("<=", "<!") or pattern[i + 2 : i + 4] in ("P=", "P>"):
                raise InvalidPattern("look-around and conditions are not in the dialect")
            if rest.startswith("P<"):
                out.append("(?<" if java else "(?P<")
                i += 4
                continue
            if rest.startswith("<"):
                out.append("(?<" if java else "(?P<")
                i += 3
                continue
            out.append(c)
        elif c == "$":
            out.append(end)
        elif c == "+" and out and pattern[i - 1] in "+*?}" and pattern[i - 2 : i - 1] != "\\":
            raise InvalidPattern("possessive repeat")
        else:
            out.append(c)
        i += 1
    if inside:
        raise InvalidPattern("unclosed class")
    return "".join(out)


@lru_cache(maxsize=4096)
def compiled(pattern: str):
    """A Python matcher (``search``); raises ``InvalidPattern``."""
    import regex

    try:
        return regex.compile(_translate(pattern, r"\Z", java=False))
    except regex.error as e:
        raise InvalidPattern(str(e)) from None


def java(pattern: str) -> str:
    """The pattern for ``rlike``; raises ``InvalidPattern``."""
    compiled(pattern)
    return _translate(pattern, r"\z", java=True)
