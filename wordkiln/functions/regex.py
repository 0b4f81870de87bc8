"""From the rules' regular expressions to the JVM's, and to the oracle's."""

from __future__ import annotations

import re

#: Whitespace as str.split() takes it.
SPACE = r"[\s\x1C-\x1F]"
FLAGS = "(?iuU)"


def quoted(text: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", text)


def word_pattern(text: str) -> str:
    """text as whole words, whatever its case."""
    return rf"{FLAGS}\b{quoted(text)}\b"


def replacement(template: str) -> str:
    r"""A template with \1 or \g<1> as the JVM writes it; its own signs $ and \ are taken as they are."""
    out, at = [], 0
    for m in re.finditer(r"\\g<(\w+)>|\\(\d{1,2})|\\(.)", template):
        out.append(_literal(template[at : m.start()]))
        if m[1] or m[2]:
            name = m[1] or m[2]
            out.append(f"${name}" if name.isdigit() else "${" + name + "}")
        else:
            out.append(_literal({"n": "\n", "t": "\t", "r": "\r"}.get(m[3], m[3])))
        at = m.end()
    return "".join(out) + _literal(template[at:])


def _literal(text: str) -> str:
    return text.replace("\\", "\\\\").replace("$", "\\$")


def jvm(pattern: str) -> str:
    """A pattern with this module's flags; named groups are written alike in both."""
    return FLAGS + re.sub(r"\(\?P<(\w+)>", r"(?<\1>", pattern)
